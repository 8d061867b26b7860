"""Files of runs and archives, written here and read back."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import control, passes
from foliospark.sources import archives, artifacts


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_outputs_of_passes(spark, tmp_path):
    for chunk in ("chunk_2", "chunk_10"):
        for name in passes.PASS_FILES:
            put(tmp_path / "my book" / chunk / f"{name}.json", '{"pov": "x"}')
    put(tmp_path / "my book" / "chunk_10" / "dialogue.json", "{bad")
    put(tmp_path / "my book" / "chunk_10" / "notes.json", "{}")
    put(tmp_path / "my book" / "other" / "dialogue.json", "{}")
    put(tmp_path / "my book" / "chunk_manifest.json", json.dumps({"book_title": "B", "chunks": [{"chunk_id": "chunk_2", "n": 1}, {"chunk_id": "chunk_2", "n": 2}, {"n": 3}]}))
    got = artifacts.pass_files(spark, str(tmp_path)).cache()
    assert got.count() == 10 and {(r.chunk_id, r.pos) for r in got.collect()} == {("chunk_2", 0), ("chunk_10", 1)}
    (bad,) = got.where("load_error IS NOT NULL").collect()
    assert (bad.book, bad.chunk_id, bad["pass"], bad.doc, bad.load_error) == ("my book", "chunk_10", "dialogue", "{}", "Could not parse dialogue.json")
    entries = artifacts.manifest(spark, str(tmp_path))
    assert [(r.book_title, r.chunk_id, json.loads(r.e)["n"]) for r in entries.withColumn("e", F.to_json("entry")).collect()] == [("B", "chunk_2", 2)]
    joined = artifacts.with_manifest(got.select("book", "chunk_id").distinct(), entries)
    assert {r.chunk_id: r.has for r in joined.select("chunk_id", F.col("manifest_entry").isNotNull().alias("has")).collect()} == {"chunk_2": True, "chunk_10": False}
    assert artifacts.pass_files(spark, str(tmp_path / "none")).collect() == []


def test_chunk_texts_and_documents(spark, tmp_path):
    for n in (1, 2, 10):
        put(tmp_path / "in" / "b" / f"chunk_{n}.txt", f"text {n}\n")
    put(tmp_path / "in" / "b" / "x.md", "no")
    got = artifacts.chunk_files(spark, str(tmp_path / "in")).orderBy("place").collect()
    assert [(r.name, r.text) for r in got] == [("chunk_1.txt", "text 1\n"), ("chunk_2.txt", "text 2\n"), ("chunk_10.txt", "text 10\n")]
    docs = spark.createDataFrame([("b", "merge_report", '{"a":[1],"b":"é"}'), ("c", "merge_report", "{}")], "book string, name string, body string")
    artifacts.write_json(docs, str(tmp_path / "out"), ["book", "name"])
    back = {r.book: r.body for r in artifacts.read_texts(spark, str(tmp_path / "out"), ["book", "name"]).collect()}
    assert back == {"b": '{\n  "a": [\n    1\n  ],\n  "b": "é"\n}', "c": "{}"}


def test_a_job_store(spark, tmp_path):
    job = {"job_id": "1", "pipeline": "merge", "status": "queued", "created_at": "2024-01-01T00:00:00Z", "options": {"a": "b"}, "stage_runs": [{"name": "merge", "status": "pending"}], "artifacts": []}
    put(tmp_path / "1.json", json.dumps(job))
    put(tmp_path / "_workers.json", '[{"worker_id": "w"}]')
    put(tmp_path / "_artifact_index.json", '{"1": [{"name": "x"}]}')
    got = artifacts.job_store(spark, str(tmp_path))
    assert [(r.job_id, r.options, r.stage_runs[0].status) for r in got["jobs"].collect()] == [("1", {"a": "b"}, "pending")]
    assert got["workers"].count() == 1 and got["users"].count() == 0 and got["artifact_index"].first().job_id == "1"


def test_configurations():
    whole = "\n".join(f"{s}: {{}}" for s in artifacts.SECTIONS)
    assert set(artifacts.config(whole)) == set(artifacts.SECTIONS)
    for bad in ("", "- a", "paths: {}"):
        with pytest.raises(ValueError):
            artifacts.config(bad)


def jobs(spark):
    asked = spark.createDataFrame([("j1", "ingest", "m1"), ("j2", "full", "m1")], "job_id string, pipeline string, manuscript_id string")
    for c in control.REQUEST:
        asked = asked if c == "manuscript_id" else asked.withColumn(c, F.lit(None).cast("string"))
    made = control.created(asked.withColumn("options", F.lit(None).cast("map<string,string>")), now())
    files = F.array(F.struct(F.lit("raw_text").alias("name"), F.concat(F.lit("/r/"), "job_id", F.lit("/raw.txt")).alias("path"), F.lit("text").alias("kind"), F.lit("ingest").alias("stage"), F.lit(None).cast("map<string,string>").alias("metadata")))
    return made.withColumn("artifacts", files.cast(f"array<{control.ARTIFACT}>")).withColumn("stage_runs", F.transform("stage_runs", lambda s: s.withField("stdout_path", F.lit("/r/j1/raw.txt"))))


def test_an_archive_there_and_back(spark):
    books = spark.createDataFrame([("m1", "book", "My Book", "/src", None), ("m2", "two", "!", "/none", "u")], "manuscript_id string, book_slug string, title string, source_path string, owner_user_id string")
    files = spark.createDataFrame([("/src/a.txt", b"A"), ("/src/d/b.txt", b"B"), ("/r/j1/raw.txt", b"raw"), ("/srcx/c", b"no")], "path string, content binary")
    out = archives.exported(books, jobs(spark), files, now()).cache()
    packed = {r.manuscript_id: r for r in out.collect()}
    assert packed["m1"].name == "my_book_archive.zip" and packed["m2"].name == "two_archive.zip"
    with zipfile.ZipFile(io.BytesIO(packed["m1"].content)) as z:
        assert sorted(z.namelist()) == ["bundle.json", "jobs/j1/artifacts/raw_text/raw.txt", "source/a.txt", "source/d/b.txt"]
        bundle = json.loads(z.read("bundle.json"))
    assert bundle["manuscript"]["source_relpath"] == "source" and [j["artifacts"][0]["bundle_path"] for j in bundle["jobs"]] == ["jobs/j1/artifacts/raw_text/raw.txt", None]
    rows = [("a", bytes(packed["m1"].content)), ("b", b"no zip"), ("c", None)]
    found = archives.opened(spark.createDataFrame(rows, "path string, content binary")).cache()
    assert {r.path: r.error for r in found.where("member IS NULL").collect()} == {"a": None, "b": "Uploaded archive is not a valid zip bundle", "c": "Uploaded archive is not a valid zip bundle"}
    taken = spark.createDataFrame([("book",), ("book_imported_2",)], "book_slug string")
    made, again = archives.imported(found, taken, F.concat(F.lit("/imports/"), "path"), now())
    m = made.first()
    assert (m.book_slug, m.title, m.source_path) == ("book_imported_3", "My Book (Imported 3)", "/imports/a/source")
    got = {r.options["_original_job_id"]: r for r in again.collect()}
    assert got["j1"].status == "paused" and got["j1"].artifacts[0].path == "/imports/a/jobs/j1/artifacts/raw_text/raw.txt" == got["j1"].stage_runs[0].stdout_path
    assert got["j2"].artifacts[0].path == "/r/j2/raw.txt" and [s.status for s in got["j2"].stage_runs] == ["paused"] * 5


def test_requests_and_stages(spark):
    own = jobs(spark)
    with pytest.raises(Exception, match="unknown pipeline"):
        control.created(own.select(F.lit("x").alias("job_id"), F.lit("none").alias("pipeline"), *control.REQUEST, "options"), now()).collect()
    run = control.claimed(own, "w", now(), include=("full",)).first()
    assert (run.job_id, run.status, run.stage_runs[0].status, run.options["_worker_id"]) == ("j2", "running", "running", "w")
    assert control.claimed(own, "w", now(), exclude=("ingest", "full")).collect() == []
    failed = control.marked(own, "ingest", "failed", now(), "oops").orderBy("job_id").first()
    assert (failed.status, failed.stage_runs[0].error) == ("failed", "oops")
    paused = control.marked(own, "ingest", "paused", now(), "later").first()
    assert paused.status == "paused" and paused.stage_runs[0].status == "paused"
    files = spark.createDataFrame([("/r/j1/raw.txt", b"abcdef")], "path string, content binary")
    one = control.artifact(own, files, "j1", "raw_text", most=3).first()
    assert (one.exists, one.size_bytes, one.preview) == (True, 6, "abc") and control.artifact(own, files, "j2", "raw_text").first().exists is False
    assert control.artifact(own, files, "j1", "none").collect() == []
    books, left, gone = control.deleted_with_data(spark.createDataFrame([("m1", "/src/a"), ("m2", "/b")], "manuscript_id string, source_path string"), own, spark.createDataFrame([("m1",)], "manuscript_id string"))
    assert [r.manuscript_id for r in books.collect()] == ["m2"] and left.collect() == [] and [r.path for r in gone.orderBy("place").collect()] == ["/r/j2/raw.txt", "/r/j1/raw.txt", "/src/a"]


def test_manuscripts_are_kept_by_slug_and_owner(spark):
    old = spark.createDataFrame([("m1", "b", "T", "/s", "txt", 1, None, None, "2020-01-01", "2020-01-01")], "manuscript_id string, book_slug string, title string, source_path string, document_type string, file_size_bytes long, owner_user_id string, owner_username string, created_at string, updated_at string")
    new = spark.createDataFrame([("n1", "b", "T2", "/t", " ", 2, None, None, "2021-01-01"), ("n2", "b", "T3", "/u", "PDF", 3, "u", "U", "2021-01-02")], "manuscript_id string, book_slug string, title string, source_path string, document_type string, file_size_bytes long, owner_user_id string, owner_username string, at string")
    got = {r.owner_user_id: r for r in control.upsert_manuscripts(old, new).collect()}
    assert (got[None].manuscript_id, got[None].title, got[None].document_type, got[None].created_at, got[None].updated_at) == ("m1", "T2", "txt", "2020-01-01", "2021-01-01")
    assert (got["u"].manuscript_id, got["u"].document_type) == ("n2", "pdf")


def test_artifacts_are_offered_in_order_without_a_shuffle(spark):
    """Preferred ones first, then by name and path; no directories and none known to be missing; each as it is."""
    rows = [("j1", [("z", "/b", "text", "s", None), ("z", "/a", "text", "s", {"exists": "true"}), ("report_pdf", "/r", "pdf", "report", {}), ("a", "/d", "directory", "s", {}), ("b", "/m", "text", "s", {"exists": "false"}), ("book_merged", "/bm", "json", None, None)]), ("j2", [])]
    got = control.shown_artifacts(spark.createDataFrame(rows, f"job_id string, artifacts array<{control.ARTIFACT}>"))
    assert [(r.job_id, r.place, r.name, r.path, r.kind, r.metadata) for r in sorted(got.collect(), key=lambda r: r.place)] == [
        ("j1", 1, "book_merged", "/bm", "json", None), ("j1", 2, "report_pdf", "/r", "pdf", {}), ("j1", 3, "z", "/a", "text", {"exists": "true"}), ("j1", 4, "z", "/b", "text", None)
    ]
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
