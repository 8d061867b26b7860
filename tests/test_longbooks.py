"""Chunks of long books by pointers, against the fold within a row and a sequential walk."""

import random

import pytest

from foliospark.operators import ingest, longbooks, scans
from foliospark.plans import registry

KINDS = ["Chapter IV", "PART TWO", "* * *", "one two three.", "one two three four five", 'she said "no"', "LOUD LINE", "Contents", "x ..... 12", "w " * 25 + "end."]
SCHEMA = "doc_id int, para_no int, text string"


def some_books(n, most, seed):
    rng = random.Random(seed)
    return [(b, i, rng.choice(KINDS)) for b in range(n) for i in range(rng.randrange(1, most))]


def shown(rows, columns):
    return sorted(str([r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize(("shift", "args"), [(10, (3, 8, 12)), (4, (3, 8, 12)), (10, (5, 5, 5)), (10, (1, 30, 200))])
def test_equal_to_the_fold_in_a_row(spark, shift, args):
    frame = spark.createDataFrame(some_books(25, 70, 1), SCHEMA)
    want = ingest.chunk_records(ingest.gathered(frame), "doc_id", *args)
    got = longbooks.chunk_records(frame, "doc_id", *args, shift=shift)
    assert got.columns == want.columns
    assert shown(got.collect(), want.columns) == shown(want.collect(), want.columns)


def walk(paras, least, target, most):
    """(first paragraph, words) of each chunk."""
    out, start, words = [], 0, 0
    for i, p in enumerate(paras):
        w, chapter, scene = len(p.split()), p == "Chapter IV", p == "* * *"
        if i > start and (words >= least if chapter else words >= target if scene else words + w > most):
            out.append((start, words))
            start, words = i, 0
        words += w
        if not chapter and not scene and words >= target and (p[-1] in ".\"'" or p in ("PART TWO", "LOUD LINE")):
            out.append((start, words))
            start, words = i + 1, 0
    return [*out, (start, words)] if start < len(paras) else out


def test_one_book_of_many_paragraphs(spark):
    rng = random.Random(5)
    paras = [rng.choice(KINDS) for _ in range(20_000)]
    frame = spark.createDataFrame([(7, i, p) for i, p in enumerate(paras)], SCHEMA)
    got = longbooks.chunk_records(frame, "doc_id", 20, 60, 90).orderBy("chunk_no").collect()
    want = walk(paras, 20, 60, 90)
    assert [(r.chunk_no, r.word_count) for r in got] == [(n, w) for n, (_, w) in enumerate(want)]
    ends = [s for s, _ in want[1:]] + [len(paras)]
    assert all(r.text == "\n\n".join(paras[s:e]) + "\n" for r, (s, _), e in zip(got, want, ends, strict=True))


def test_states_go_up_and_down_several_levels_of_blocks(spark):
    """As above, by blocks of 16 paragraphs, and blocks of 16 such, so that tables are composed; a round of pointers over all paragraphs is needed no more."""
    assert not hasattr(longbooks, "reached")
    rng = random.Random(9)
    books = {b: [rng.choice(KINDS) for _ in range(n)] for b, n in ((1, 6000), (2, 300), (3, 16), (4, 1))}
    frame = spark.createDataFrame([(b, i, p) for b, paras in books.items() for i, p in enumerate(paras)], SCHEMA)
    got = longbooks.chunk_records(frame, "doc_id", 20, 60, 90, shift=4).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.word_count) for r in got] == [(b, n, w) for b, paras in books.items() for n, (_, w) in enumerate(walk(paras, 20, 60, 90))]


def test_a_block_equals_the_walk_from_every_state(spark):
    """A block's table and starts, for each number of words that the chunk before may have, are those of the walk."""
    rng = random.Random(10)
    for _ in range(60):
        least, target, most = sorted(rng.randrange(1, 25) for _ in range(3))
        w = longbooks.np.array([rng.choice((0, 1, 3, 9, 40)) for _ in range(rng.randrange(1, 30))])
        chapter, scene, ends = (longbooks.np.array([rng.random() < p for _ in w]) for p in (0.15, 0.2, 0.4))
        block = longbooks.Block(w, chapter, scene, ends, least, target, most)
        exits, begun = block.table()
        for state in range(most + 3):
            filled, words, starts, closes = state > 0, state - 1 if state else 0, [], []
            for i, n in enumerate(w.tolist()):
                if filled and (words >= least if chapter[i] else words >= target if scene[i] else words + n > most):
                    closes.append(i)
                    filled = False
                if not filled:
                    starts.append(i)
                    filled, words = True, 0
                words += n
                if not chapter[i] and not scene[i] and ends[i] and words >= target:
                    filled = False
            start, by = block.starts(state)
            assert (longbooks.np.flatnonzero(start).tolist(), longbooks.np.flatnonzero(by).tolist()) == (starts, closes)
            assert (exits[state], begun[state]) == (1 + min(words, most + 1) if filled else 0, len(starts))


def test_odd_tables(spark):
    """Null books are none; one paragraph is one chunk; an empty table has none; bounds out of order are refused."""
    frame = spark.createDataFrame([(None, 0, "a."), (1, 0, "a."), (2, 0, "PART ONE")], SCHEMA)
    assert [(r.doc_id, r.text, r.part_hint) for r in longbooks.chunk_records(frame, least=1, target=2, most=3).orderBy("doc_id").collect()] == [(1, "a.\n", None), (2, "PART ONE\n", "PART ONE")]
    assert longbooks.chunk_records(frame.where("false")).collect() == []
    with pytest.raises(ValueError, match="least"):
        longbooks.chunk_records(frame, least=5, target=2, most=3)


def test_prefix_folds_over_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(-50, 400), rng.randrange(10), n) for n in range(300)]
    frame = spark.createDataFrame(rows, "g string, pos long, v long, n long")
    levels = scans.levels_of(frame, "pos", shift=3)
    for backwards in (False, True):
        got = scans.preceded(frame, ["g"], "pos", {"s": ("sum", frame["v"]), "least": ("min", frame["v"]), "most": ("max", frame["v"])}, levels, 3, ("n",), backwards).collect()
        for r in got:
            other = [x[2] for x in rows if x[0] == r.g and ((x[1], x[3]) > (r.pos, r.n) if backwards else (x[1], x[3]) < (r.pos, r.n))]
            assert (r.s, r.least, r.most) == (sum(other), min(other, default=None), max(other, default=None))


def test_long_books_are_cleaned_once(spark, monkeypatch):
    """The paragraphs that the walk reads again and again come from a written table, so that no text is cleaned a second time."""
    plans, walk_ = [], longbooks.chunk_records
    monkeypatch.setattr(longbooks, "chunk_records", lambda paras, **args: (plans.append(paras._jdf.queryExecution().toString()), walk_(paras, **args))[1])
    registry.long_book_chunks(spark, "/root/testdata/sf0.001").count()
    assert plans and "MapInArrow" not in plans[0] and "Window" not in plans[0]
