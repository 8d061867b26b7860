"""Pair scores against a comparison of everything with everything, and how many pairs common surnames and titles make."""

import random
from itertools import combinations

from foliospark.operators import resolve

SCHEMA = "book string, source string, pos long, name string, roles array<string>, chunks array<string>, variants array<string>, accents array<string>"


def score(x, y):
    """The points of two names of the pool, from the rule's table."""
    fx, fy = x.f, y.f
    same = lambda u, v: u is not None and u != "" and u == v
    title = same(fx.title, fy.title)
    common = len(set(x.chunks) & set(y.chunks))
    lower = lambda p: {r.lower() for r in p.roles}
    got = 100 * (fx.normalized == fy.normalized) + 95 * (same(fx.base, fy.base) and fx.title == fy.title) + 40 * same(fx.surname, fy.surname) + 20 * title + 15 * same(fx.given, fy.given)
    got += 22 * (fx.is_generic and title) + 22 * (fy.is_generic and title) + min(20, 4 * common) + 12 * bool(lower(x) & lower(y))
    return got + 50 * bool({v.lower() for v in x.variants} & {v.lower() for v in y.variants})


def people_of(spark, rows):
    return resolve.pool(spark.createDataFrame(rows, SCHEMA), "book").persist()


def test_all_pairs_that_reach_the_link_are_found(spark):
    rng = random.Random(12)
    first, last, titles = ["John", "Jim", "Ann", ""], ["Smith", "Hawkins", "Trent", ""], ["Mr", "Dr.", "Captain", "the Doctor", "", "", ""]
    rows = []
    for i in range(260):
        name = " ".join(x for x in (rng.choice(titles), rng.choice(first), rng.choice("abcdefgh") if rng.random() < 0.4 else "", rng.choice(last)) if x)
        some = lambda xs, n: rng.sample(xs, rng.randrange(n))
        rows.append((rng.choice("ab"), "entities", i, name, some(["Sailor", "sailor", "cook", "nurse"], 3), some([f"c{k}" for k in range(9)], 7), some(["aa", "bb", "cc", "dd", "ee", "ff"], 2), []))
    people = people_of(spark, rows)
    by_book = {}
    for p in people.collect():
        by_book.setdefault(p.book, []).append(p)
    want = {(b, *sorted((x.norm, y.norm))): score(x, y) for b, ps in by_book.items() for x, y in combinations(ps, 2) if score(x, y) >= resolve.LINK}
    got = {(r.book, r.a, r.b): r.score for r in resolve.scored_pairs(people, "book").collect()}
    assert got == want and len(want) > 300


def test_a_common_surname_makes_no_pairs_by_itself(spark):
    """3000 names of one surname, and as many of one title, that have nothing else in common: none is compared, as the plan's rows show."""
    rows = [("b", "entities", i, f"Given{i} Smith", [], [f"c{i % 200}"], [], []) for i in range(3000)]
    rows += [("b", "entities", 5000 + i, f"Captain N{i} Last{i}", ["sailor"], [f"c{i % 200}"], [], []) for i in range(3000)]
    people = people_of(spark, rows)
    pairs = resolve.scored_pairs(people, "book")
    assert pairs.collect() == []
    plan = pairs._jdf.queryExecution().executedPlan()

    def made(node):
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() and node.metrics().contains("numOutputRows") else []
        kids = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        return own + [n for k in kids for n in made(k)]

    assert max(made(plan), default=0) < 150_000
