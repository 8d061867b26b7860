"""Queries of the registry against their SQL, and the folds against plain models of their rules."""

import random
import re
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions import jsonx, names
from foliospark.functions import text as T
from foliospark.operators import ingest, jobs, merge, resolve
from foliospark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region benchmark embeddings nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda p: sorted(map(str, p[cols].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


def heading(s):
    return bool(re.match(r"chapter\s+[ivxlcdm0-9]+\b", s, re.I) or re.match(r"part\s+\w+", s, re.I) or (len(s) <= 90 and s == s.upper() and re.search("[A-Z]", s)))


def chunks_model(paras, least, target, most):
    out, no, words, filled = [], 0, 0, False
    for p in paras:
        w = len(p.split())
        chapter, scene = bool(re.match(r"chapter\s+[ivxlcdm0-9]+\b", p, re.I)), p == "* * *"
        close = filled and (words >= least if chapter else words >= target if scene else words + w > most)
        if close:
            no, words = no + 1, 0
        out.append(no)
        words, filled = words + w, True
        if not chapter and not scene and words >= target and (p[-1] in ".\"'" or heading(p)):
            no, words, filled = no + 1, 0, False
    return out


def test_chunker_follows_the_rules(spark):
    rng = random.Random(3)
    kinds = ["Chapter IV", "PART TWO", "* * *", "one two three.", "one two three four five", 'she said "no"', "LOUD LINE"]
    books = [[rng.choice(kinds) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    df = spark.createDataFrame([(b, i, p) for b, ps in enumerate(books) for i, p in enumerate(ps)], "doc_id int, para_no int, text string")
    got = {}
    for r in ingest.chunked(df, least=3, target=8, most=12).collect():
        got[r.doc_id, r.para_no] = r.chunk_no
    for b, ps in enumerate(books):
        assert [got[b, i] for i in range(len(ps))] == chunks_model(ps, 3, 8, 12)


def test_cleaning_removes_page_markers_and_repeated_headers(spark):
    text = "My Header\nCHAPTER I\nOne sen-\ntence here.\n1\nMy Header\nPage 2\nmore.\n\nMy Header\n3"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    stats = {r.doc_id: r for r in ingest.clean_stats(df).collect()}
    assert (stats[1].removed_page_markers, stats[1].removed_repeated_headers) == (3, 3)
    paras = [(r.kind, r.text) for r in ingest.clean_paragraphs(df).where("doc_id = 1").orderBy("para_no").collect()]
    assert paras == [("heading", "CHAPTER I"), ("text", "One sentence here. more.")]


def test_chunk_hints_and_offsets(spark):
    paras = ["CHAPTER I", "one two three.", "CHAPTER II", "four five six."]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(paras)], "doc_id int, para_no int, text string")
    got = ingest.chunk_records(ingest.gathered(df), least=1, target=5, most=8).orderBy("chunk_no").collect()
    assert [r.chapter_hint for r in got] == ["CHAPTER I", "CHAPTER II"]
    assert got[0].start_offset == 0 and got[1].start_offset == got[0].end_offset and got[0].chunk_id == "chunk_000"
    parts = spark.createDataFrame([(1, i, p) for i, p in enumerate(["PART ONE", "a b c d e.", "PART TWO", "f g h."])], "doc_id int, para_no int, text string")
    got = ingest.chunk_records(ingest.gathered(parts), least=1, target=5, most=8).orderBy("chunk_no").collect()
    assert [(r.part_hint, r.text) for r in got] == [("PART ONE", "PART ONE\n\na b c d e.\n"), ("PART TWO", "PART TWO\n\nf g h.\n")]
    early = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a b c d", "PART TWO of all of it"])], "doc_id int, para_no int, text string")
    got = ingest.chunk_records(ingest.gathered(early), least=1, target=5, most=8).orderBy("chunk_no").collect()
    assert [r.part_hint for r in got] == ["PART TWO of all of it"] * 2
    with pytest.raises(ValueError):
        ingest.chunked(df, least=9, target=5, most=8)


def test_json_recovery_and_string_lists(spark):
    rows = [(1, 'noise {"chapters": ["I", 1, "II"]} tail'), (2, '{"a":1}{"b":2}'), (3, None), (4, '{"chapters": "x"}')]
    df = spark.createDataFrame(rows, "id int, raw string").select("id", jsonx.recover(F.col("raw")).alias("v"))
    got = {r.id: r for r in df.select("id", F.col("v").isNull().alias("none"), jsonx.strings(F.col("v"), "$.chapters").alias("c")).collect()}
    assert got[1].c == ["I", "II"] and got[2].none and got[3].none and got[4].c == []


def test_name_forms_and_rules(spark):
    df = spark.createDataFrame([("the Capt. Flint",), ("Dr. Livesey",), ("doctor",), ("The The Doctor",)], "n string")
    f = [r.f for r in df.select(names.form(F.col("n")).alias("f")).collect()]
    assert (f[0].title, f[0].surname) == ("captain", "flint") and f[2].is_generic and f[3].is_generic
    pair = spark.createDataFrame([("Dr. Livesey", "doctor"), ("Jim Hawkins", "Hawkins"), ("Mr. Hands", "Hands")], "a string, b string")
    none = F.array().cast("array<string>")
    rule = names.match_rule(names.form(F.col("a")), names.form(F.col("b")), none, none)
    assert [r.r.score for r in pair.select(rule.alias("r")).collect()] == [78, 0, 88]
    more = [("the captain", "captain", 100), ("Dr. Livesey", "Doctor Livesey", 100), ("The", "é", 100), ("Mr. A Hands", "mister b hands", 96), ("sir", "mr x", 0)]
    pair = spark.createDataFrame(more, "a string, b string, want int")
    assert all(r.r.score == r.want for r in pair.select("want", rule.alias("r")).collect())
    roles = names.match_rule(names.form(F.lit("doctor")), names.form(F.lit("Dr. Livesey")), F.array(F.lit("Physician")), F.array(F.lit("innkeeper")))
    assert spark.range(1).select(roles.alias("r")).first().r.score == 78


def test_first_fit_takes_the_first_group(spark):
    rows = [("b", 0, "Dr. Livesey", []), ("b", 1, "Jim", []), ("b", 2, "doctor", ["a doctor"]), ("b", 3, "Dr. Smith", []), ("b", 4, "jim", [])]
    got = merge.first_fit(spark.createDataFrame(rows, "book string, pos long, name string, roles array<string>"), "book").orderBy("pos").collect()
    assert [r.group_no for r in got] == [0, 1, 0, 0, 1]


def test_progress_keeps_the_last_values(spark):
    rows = [(1, 1, "chunk_start", "c1", "structure", None), (1, 2, "pass_success", "c1", "structure", 44.2), (1, 3, "pass_start", "c1", "dialogue", None)]
    e = spark.createDataFrame(rows, "run int, i int, event_type string, chunk string, pass string, reported_tps double")
    p = jobs.progress(e, ["run"], "i").first()
    assert (p.current_pass, p.reported_tps, p.last_event_type) == ("dialogue", 44.2, "pass_start")
    assert jobs.current_chunk(e, ["run"], "i").first().current_chunk == "c1"
    assert spark.range(1).select(T.chunk_index(F.lit("chunk_001"))).first()[0] == 2


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_rounding_follows_the_exact_value(spark):
    rng = random.Random(1)
    xs = [2.675, 0.125, -2.5, 6945.95, 0.0] + [rng.randrange(10**6) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", *[T.rounded(F.col("x"), n).alias(f"r{n}") for n in (1, 2)]).collect()
    assert all(r.r1 == round(r.x, 1) and r.r2 == round(r.x, 2) for r in got)


def test_shown_texts(spark):
    one = spark.createDataFrame([("a/b/My Book.v2.PDF", ".hidden", "x", 1536, 59.96)], "f string, g string, h string, n long, s double")
    r = one.select(T.file_name(F.col("f")), T.file_name(F.col("g")), T.file_name(F.col("h")), T.byte_size(F.col("n")), T.seconds(F.col("s")), T.seconds(F.lit(None).cast("double")), T.age(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 00:01:00.25"))).first()
    assert tuple(r) == ("my_bookv2.PDF", "hidden.pdf", "x.pdf", "1.5 KB", "60.0s", "-", "60.2s")
    assert spark.range(1).select(T.is_toc_like(F.lit("Chapter IX9"))).first()[0] is False


def test_shown_sizes_and_seconds_at_ties(spark):
    """A tie goes to the even digit, as 961.25 KB, and what rounds to zero from below keeps its sign."""
    sizes, secs = [984320, 984384, 1023 * 1024 + 768, 1310720, 1 << 40, 1500], [-0.04, -0.05, -0.06, 0.04, 0.25, -1.25, 0.0]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(T.byte_size(F.col("n"))).collect()]
    assert got == [f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" for n in sizes] and got[0] == "961.2 KB"
    assert [r[0] for r in spark.createDataFrame([(x,) for x in secs], "s double").select(T.seconds(F.col("s"))).collect()] == [f"{x:.1f}s" for x in secs]


def test_shown_values_of_negative_zero_and_of_nulls(spark, tmp_path):
    """A balance just below zero is stored as -0.0 and shown so; what is null is null."""
    rows = [(0, -0.0, "MACHINERY"), (1, 0.0, "BUILDING"), (2, -0.04, "BUILDING"), (3, None, "HOUSEHOLD"), (4, 1.92, None), (None, 5000.0, "FURNITURE")]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["shown_values"]).fetchall()
    got = registry.shown_values(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.c_custkey: r.seconds for r in got} == {0: "-0.0s", 1: "0.0s", 2: "-0.0s", 3: None, 4: "1.9s", None: "5000.0s"}


def test_progress_of_a_run_whose_chunks_end_but_never_begin(spark, tmp_path):
    """Ten chunks completed of nine and none begun: there is no current chunk, so that the query has no index, as its SQL."""
    rows = [(7 * i, datetime(2024, 1, 6, 0, i), 1, "purchase", 1.5) for i in range(10)] + [(1, datetime(2024, 1, 7), 2, "signup", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["run_progress"]).df()
    got = registry.run_progress(spark, str(tmp_path)).toPandas()
    assert got[want.columns].sort_values("user_id").astype(str).values.tolist() == want.sort_values("user_id").astype(str).values.tolist()
    assert got.set_index("user_id").current_chunk_index.to_dict() == {1: -1, 2: 2}


def test_cleaning_takes_lines_of_many_documents_at_once(spark, monkeypatch):
    """Cleaning is one pass over Arrow arrays, and cut into pieces of any size it gives the same; texts that aren't valid UTF-8 don't stop it."""
    texts = ["A\nb-\nc\n1\n\n" * 4, None, "", "\n", "x\u2003\u3000y\nCHAPTER\u2009IV\x85\nÄ B\nß B\n* * *\nz .... 3", None, "Hd\n" * 3 + "k", "t"] * 3
    whole = pa.array(texts)
    want = [tuple(r) for r in zip(*[c.to_pylist() for c in ingest._cleaned(whole)], strict=True)]
    monkeypatch.setattr(ingest, "CLEAN_BYTES", 30)
    pieces = list(ingest._pieces(whole))
    got = [r for start, n in pieces for r in zip(*[c.to_pylist() for c in ingest._cleaned(whole.slice(start, n))], strict=True)]
    assert len(pieces) > 5 and got == want and want[1] == (None,) * 6
    assert [p["kind"] for p in want[4][-1]] == ["text", "heading", "heading", "text", "scene_break", "toc"]
    docs = spark.createDataFrame([(1, bytearray(b"a\xff b"))], "doc_id int, b binary").select("doc_id", F.expr("CAST(b AS STRING)").alias("text"))
    made = ingest.cleaned(docs)
    assert made.first().raw_word_count == 2 and "MapInArrow" in made._jdf.queryExecution().toString()


def test_chunk_summaries_shuffle_no_text(spark):
    """The table is read once and without its texts; turns without a conversation, of equal place and role among them, count as in the SQL."""
    plan = registry.chunk_summaries(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "text" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "A\n" * 5), (5, "x \t\n" * 4 + "y"), (6, "t\nh\n* * *\nc\ns"), (6, "t")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("paras", F.lit(1)).withColumn("_t", F.lit(1))
    got = {r.doc_id: r for r in ingest.clean_stats(docs.where("text IS NULL OR text <> 't'")).collect()}
    assert got[1].raw_char_count is None and (got[2].n_lines, got[2].clean_char_count) == (1, 1) and got[4].removed_repeated_headers == 0 and got[5].removed_repeated_headers == 4
    assert [(r.kind, r.text) for r in ingest.paragraphs(docs.where("doc_id = 6 AND text <> 't'")).orderBy("para_no").collect()] == [("text", "t h"), ("scene_break", "* * *"), ("text", "c s")]
    assert ingest.chunk_records(ingest.cleaned(docs.limit(0))).collect() == []
    kept = ingest.plain_lines(spark.createDataFrame([(1, "My Book\n12\n\nab1\nabc d")], "doc_id int, text string"), "my book")
    assert kept.first().text == "abc d"


def test_answers_of_a_model_decide(spark):
    people = [("b", "entities", i, n, [], [], [], []) for i, n in enumerate(["Dr. Livesey", "the doctor", "Doctor Livesey", "Jim"])]
    pool = resolve.pool(spark.createDataFrame(people, "book string, source string, pos long, name string, roles array<string>, chunks array<string>, variants array<string>, accents array<string>").withColumn("chunks", F.array(F.lit("c1"))), "book")
    pairs = resolve.scored_pairs(pool, "book")
    groups = resolve.clusters(pool, pairs, "book").cache()
    assert [r.name for r in groups.orderBy("member_no").collect()] == ["Doctor Livesey", "Dr. Livesey", "the doctor"]
    said = {"good": 'Well: {"merge": 1, "confidence": "high", "members_to_merge": ["the doctor", "the doctor", 4], "canonical_name": " "}', "bad": "no"}
    good, bad = (resolve.adjudicated(pool, groups, pairs, "book", lambda payload, k=k: said[k]).first() for k in said)
    assert (good.canonical_name, good.merge, good.members_to_merge, good.error) == ("Doctor Livesey", True, ["the doctor"], None)
    assert (bad.canonical_name, bad.merge, bad.confidence, bad.error) == ("Doctor Livesey", False, "review", "no JSON object in the answer")
    with pytest.raises(ValueError):
        resolve.scored_pairs(pool, "book", 40)
