"""Records per chunk in the merged documents, and small operators that no query covers."""

import json

from pyspark.sql import functions as F

from foliospark.operators import book, control, merge, resolve

SCHEMA = "book string, chunk_id string, pos int, pass string, doc string"
OUTPUTS = [
    ("b", "chunk_000", 0, "entities", '{"characters": ["Jim", 3, "Jim"], "places": "x"}'),
    ("b", "chunk_000", 0, "dossiers", '{"dossiers": [{"name": "Jim"}, 4]}'),
    ("b", "chunk_000", 0, "timing", '{"total_duration_seconds": 1.5, "passes": {"dialogue": 0.25}}'),
    ("b", "chunk_001", 1, "timing", '{"passes": [1]}'),
    ("b", "chunk_002", 2, "structure", '{"status": "ok"}'),
    ("c", "chunk_000", 0, "structure", "{}"),
]


def test_records_per_chunk(spark):
    merged = book.Merged(spark.createDataFrame(OUTPUTS, SCHEMA))
    docs = {(r.book, r.name): json.loads(r.body) for r in merged.artifacts().collect()}
    kinds = ("characters", "places", "objects", "identity_notes")
    none = dict.fromkeys(kinds, [])
    ids = ["chunk_000", "chunk_001", "chunk_002"]
    assert docs["b", "entities_merged"]["per_chunk"] == [{"chunk_id": i, **none, **({"characters": ["Jim", 3, "Jim"]} if n == 0 else {})} for n, i in enumerate(ids)]
    assert docs["b", "dossiers_merged"]["per_chunk"] == [{"chunk_id": i, "character_dossiers": [{"name": "Jim"}] if n == 0 else []} for n, i in enumerate(ids)]
    summary = docs["b", "book_merged"]["timing_summary"]
    assert (summary["book_total_duration_seconds"], summary["pass_total_duration_seconds"]) == (1.5, {"dialogue": 0.25})
    assert summary["per_chunk"] == [{"chunk_id": ids[0], "total_duration_seconds": 1.5, "passes": {"dialogue": 0.25}}, *[{"chunk_id": i, "total_duration_seconds": None, "passes": {}} for i in ids[1:]]]
    assert docs["c", "book_merged"]["timing_summary"] == {"book_total_duration_seconds": 0.0, "pass_total_duration_seconds": {}, "per_chunk": [{"chunk_id": "chunk_000", "total_duration_seconds": None, "passes": {}}]}


def test_sums_of_seconds_round_to_the_even_digit(spark):
    rows = spark.createDataFrame([("a", "x", 0.0625), ("a", "x", 0.0), ("a", "y", 2.0005), ("b", "x", 1 / 3)], "b string, p string, s double")
    got = {(r.b, r.p): (r.total_seconds, r.n) for r in merge.timing_rollup(rows, ["b"], "p", "s").collect()}
    assert got == {("a", "x"): (round(0.0625, 3), 2), ("a", "y"): (round(2.0005, 3), 1), ("b", "x"): (0.333, 1)}


def test_older_groups_by_normal_form(spark):
    rows = spark.createDataFrame([("b", 2, "JIM"), ("b", 1, "Jim "), ("b", 3, "Silver"), ("b", 4, " "), ("c", 9, "jim")], "b string, pos int, name string")
    assert {(r.b, r.pos): r.canonical_name for r in merge.exact_groups(rows, ["b"]).collect()} == {("b", 1): "Jim ", ("b", 2): "Jim ", ("b", 3): "Silver", ("c", 9): "jim"}


def test_manuscripts_with_their_latest_ingest(spark):
    jobs = spark.createDataFrame(
        [("j1", "m1", "ingest", "2024-01-01 00:00:00", [("ingest", "failed", "oops")]), ("j2", "m1", "full", "2024-01-02 00:00:00", [("ingest", "succeeded", None), ("merge", "pending", None)]), ("j3", "m1", "merge", "2024-01-03 00:00:00", [("merge", "pending", None)]), ("j4", None, "ingest", "2024-01-04 00:00:00", [("ingest", "running", None)])],
        "job_id string, manuscript_id string, pipeline string, updated_at string, stage_runs array<struct<name:string,status:string,error:string>>",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    jobs = jobs.withColumn("stage_runs", F.transform("stage_runs", lambda s: s.withField("started_at", F.lit(None).cast("timestamp")).withField("finished_at", F.lit(None).cast("timestamp"))))
    got = {r.manuscript_id: r.latest_ingest for r in control.with_latest_ingest(spark.createDataFrame([("m1", "x"), ("m2", "y")], "manuscript_id string, title string"), jobs).collect()}
    assert (got["m1"].job_id, got["m1"].status, got["m1"].pipeline) == ("j2", "succeeded", "full") and got["m2"] is None


def test_the_reported_rate_goes_first(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (0.0, 3.0), (None, 3.0), (None, 0.0), (None, None)], "a double, b double")
    assert [r[0] for r in rows.select(control.throughput(F.col("a"), F.col("b"))).collect()] == [2.0, 3.0, 3.0, None, None]


def test_profiles_are_kept_by_name_and_version(spark):
    fields = "config_profile_id string, name string, config_path string, version string, checksum string, metadata map<string,string>"
    old = spark.createDataFrame([("p1", "n", "/a", "1", "x", {"k": "v"}, "2020", "2020")], fields + ", created_at string, updated_at string")
    new = spark.createDataFrame([("q1", "n", "/b", "1", "y", None, "2021"), ("q2", "n", "/c", "2", "z", {}, "2022"), ("q3", "n", "/d", "2", None, {"m": "1"}, "2023")], fields + ", at string")
    got = control.upsert_profiles(old, new)
    assert got.columns == old.columns
    assert sorted(map(tuple, got.collect()), key=str) == [("p1", "n", "/b", "1", "y", None, "2020", "2021"), ("q2", "n", "/d", "2", None, {"m": "1"}, "2022", "2023")]
    asked = spark.createDataFrame([("r1", "p1"), ("r2", "none"), ("r3", ""), ("r4", None)], "request string, config_profile_id string")
    told = {r.request: r for r in control.with_profile(asked, got).collect()}
    assert told["r1"].config_profile.config_path == "/b" and [told[r].profile_error for r in ("r1", "r2", "r3", "r4")] == [None, control.UNKNOWN_PROFILE + "none", None, None]


def test_names_that_are_no_members_are_flagged(spark):
    groups = spark.createDataFrame([("b", 0, 0, "jim", "Jim"), ("b", 0, 1, "jim hawkins", "Jim Hawkins")], "book string, group_no int, member_no int, norm string, name string")
    answers = spark.createDataFrame([("b", 0, ["JIM", "Silver"]), ("b", 1, ["x"]), ("c", 0, None)], "book string, group_no int, members_to_merge array<string>")
    assert {(r.book, r.group_no): r.not_members for r in resolve.flagged(answers, groups, "book").collect()} == {("b", 0): ["Silver"], ("b", 1): ["x"], ("c", 0): []}
