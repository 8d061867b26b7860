"""The near-duplicate groups against all pairs of texts by their exact Jaccard similarity."""

import random

from foliospark.llm import simhash

SIZE, SIMILARITY = 5, 0.8


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + SIZE]) for i in range(max(1, len(w) - SIZE + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def brute_groups(rows):
    """{row number: the smallest id of its group} of the rows (id, text) whose text others with another id resemble."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and None not in (rows[i][0], rows[j][0]) and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= SIMILARITY):
                of = [of[j] if x == of[i] else x for x in of]
    groups = {}
    for (d, _), x in zip(rows, of, strict=True):
        groups.setdefault(x, set()).add(d)
    return {i: min(groups[x]) for i, x in enumerate(of) if len(groups[x]) > 1}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(spark, rows):
    return {(r.doc_id, r.component_id) for r in simhash.verified_groups(frame(spark, rows)).collect()}


def brute(rows):
    return {(rows[i][0], least) for i, least in brute_groups(rows).items()}


def edited(rng, words, least, most):
    """A copy of words whose similarity is in [least, most), by changing words one by one."""
    while True:
        out = list(words)
        for _ in range(len(words)):
            out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
            j = jaccard(shingles(" ".join(words)), shingles(" ".join(out)))
            if j < most:
                break
        if least <= j:
            return out


def repeated_phrases(rng):
    """Texts whose fingerprints are all fixed by a phrase that is repeated; the first of them resembles none."""
    own = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(6)]
    menu = "home products contact " * 60
    texts = [menu + " ".join(w) for w in [own[0], own[1], edited(rng, own[1], 0.85, 0.95), own[2], edited(rng, own[2], 0.85, 0.95), own[3]]]
    return list(enumerate(texts))


def test_texts_that_share_a_fingerprint_are_compared_with_each_other(spark):
    rows = repeated_phrases(random.Random(1))
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, SIZE)) for _, t in rows}) == 1
    assert brute(rows) == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert found(spark, rows) == brute(rows)


def test_pairs_just_above_the_similarity_are_all_found(spark):
    rng, rows = random.Random(2), []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(rng, words, *((0.8, 0.85), (0.85, 0.9), (0.72, 0.8))[k % 3])))]
    assert len(brute(rows)) == 80
    assert found(spark, rows) == brute(rows)


def test_chains_and_dense_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, words, 0.8, 0.95)) for _ in range(80)] + [" ".join(words[i : i + 60]) for i in range(0, 60, 4)]
    rows = [*enumerate(texts), (200, texts[3]), (201, "a b"), (202, "a  b"), (203, ""), (204, ""), (205, None), (206, None), (207, " "), (None, texts[3])]
    assert found(spark, rows) == brute(rows) | {(201, 201), (202, 201)}


def test_each_text_of_a_repeated_id_has_its_own_group(spark):
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3)]
    near = [" ".join(edited(rng, w, 0.85, 0.95)) for w in words]
    rows = [(1, " ".join(words[0])), (2, " ".join(words[1])), (5, near[0]), (5, near[1]), (5, " ".join(words[2])), (6, near[2])]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == sorted([rows[0], rows[1], rows[4]])


def long_texts(rng):
    """Long texts, unlike but for a passage that each shares with the next, and so prefix keys; then copies of some, one with parities of another width."""
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [new(200) for _ in range(11)]
    rows = [shared[i] + new(1400 + 65 * i) + shared[i + 1] for i in range(10)]
    for i, part, extra in ((3, 0.015, 60), (4, 0.06, 0), (5, 0.01, 0), (8, 0.015, 100)):
        copy = list(rows[i])
        for _ in range(int(part * len(copy))):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows.append(copy + new(extra))
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_sets_of_long_texts_are_fetched_only_where_parities_leave_a_pair_alike(spark, monkeypatch):
    """Before, all unlike long texts that shared a key had their sets joined to every pair, a number that grows with the square of the input."""
    rows, real, kinds = long_texts(random.Random(6)), simhash.cut, []

    def cut(df, kind):
        out = real(df, kind)
        kinds.extend([{r.id for r in out.select("id").collect()}] if kind == "sets" else [])
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    assert found(spark, rows) == brute(rows) == {(3, 3), (10, 3), (5, 5), (12, 5), (8, 8), (13, 8)}
    assert set().union(*kinds) and len(set().union(*kinds)) <= 8


def test_parities_of_two_widths_never_rule_out_alike_sets(spark):
    rng = random.Random(7)
    sets = [[rng.getrandbits(64) for _ in range(n)] for n in (1100, 2040, 2040)]
    sets += [sets[1] + [rng.getrandbits(64) for _ in range(500)], sets[2][:1700] + [rng.getrandbits(64) for _ in range(900)], sets[0][:1090], sets[0][:900]]
    hashes = [simhash.np.unique(simhash.np.array(s, simhash.np.uint64)) for s in sets]
    nodes = [(i, len(h), simhash.parities(h, 1 << (len(h) - 1).bit_length()).tolist() if len(h) > simhash.WIDE_FROM else None) for i, h in enumerate(hashes)]
    frame = spark.createDataFrame(nodes, "id long, n int, wide array<bigint>")
    pairs = [(i, j, 0.0) for j in range(len(sets)) for i in range(j)]
    got = {(r.x, r.y) for r in simhash._still_close(spark.createDataFrame(pairs, "x long, y long, far double"), frame, SIMILARITY).collect()}
    alike = {(i, j) for i, j, _ in pairs if jaccard(set(sets[i]), set(sets[j])) >= SIMILARITY}
    # No wide parities, or none that can be compared: those stay.
    unknown = {(i, j) for i, j, _ in pairs if 6 in (i, j)}
    assert alike == {(1, 3), (0, 5), (0, 6), (5, 6)} and alike | unknown <= got and not {(1, 2), (2, 3), (2, 4), (0, 1)} & got


def test_the_map_of_wanted_rows_loses_none(spark):
    rows = spark.range(200_000).selectExpr("id", "id % 7 AS other")
    wanted = rows.where("id % 100 = 3")
    got = {r.id for r in simhash._among(rows, wanted, ["id", "other"]).collect()}
    assert set(range(3, 200_000, 100)) <= got and len(got) < 2_200
