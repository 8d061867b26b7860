"""Streams over files written here, and a report from rule-based passes."""

import json
import os

from pyspark.sql import functions as F

from foliospark.operators import jobs, passes, report, resolve
from foliospark.operators.book import Merged, resolved_artifacts
from foliospark.streaming import runlog


def at(minute, **k):
    return json.dumps({"timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", **k})


LOG = [
    at(0, run="a", event_type="chunk_start", chunk="c1"), "", "{bad", "[1]", at(1, run="a", event_type="pass_start", **{"pass": "structure"}),
    at(2, run="a", event_type="chunk_success", chunk="c1", reported_tps=40.5), at(3, run="b", event_type="chunk_failure", chunk="c9"), json.dumps({"run": "b", "timestamp": "?", "event_type": "note"}),
]


def drain(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_progress_of_a_stream_equals_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(LOG[:5]))
    (tmp_path / "in" / "2.jsonl").write_text("\n".join(LOG[5:]))
    batch = runlog.progress(runlog.events(spark.read.text(str(tmp_path / "in"))), ["run"]).collect()
    stream = runlog.progress(runlog.events(runlog.read_lines(spark, str(tmp_path / "in"), 1)), ["run"])
    got = drain(stream, tmp_path, "progress_all", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) == 2
    a = next(r for r in got if r.run == "a")
    assert (a.chunks_completed, a.current_pass, a.reported_tps) == (1, "structure", 40.5)


def test_quiet_runs_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([at(0, run="a"), at(0, run="b"), at(0, run="a")], [at(9, run="b")], [at(15, run="b")], [at(16, run="b")])):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(rows))
        os.utime(tmp_path / "in" / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    lines = runlog.events(runlog.read_lines(spark, str(tmp_path / "in"), 1))
    got = drain(runlog.quiet(lines.withWatermark("ts", "0 seconds"), "run"), tmp_path, "quiet_runs", "append")
    assert [(r.run, r.last.minute) for r in got if r.state == "quiet"] == [("a", 0)]
    assert len(drain(runlog.once(lines, ["run", "ts"]), tmp_path, "once_only", "append")) == 5
    counts = drain(runlog.windowed_counts(lines, ["run"], width="5 minutes", late="0 seconds"), tmp_path, "windowed", "append")
    assert {(r.run, r.start.minute, r.n) for r in counts} >= {("a", 0, 2), ("b", 0, 1), ("b", 5, 1)}


def test_append_writes_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(LOG))
    assert runlog.append(runlog.events(runlog.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_log_is_read_in_its_order(spark, tmp_path):
    rows = [at(0, run="a", event_type="chunk_start", chunk="chunk_001"), at(1, run="a", event_type="pass_start", model="m", **{"pass": "structure"}), json.dumps({"run": "a", "event_type": "pass_end", "estimated_tps": 3})]
    (tmp_path / "1.jsonl").write_text("\n".join(rows))
    log = runlog.read_log(spark, str(tmp_path))
    runs = spark.createDataFrame([("a", 3), ("b", 2), ("c", 0)], "run string, chunks_total int")
    got = {r.run: r for r in jobs.full_progress(log, runs, ["run"], "place", "ts").collect()}
    a = got["a"]
    assert (a.last_event_type, a.last_event_at, a.current_model, a.estimated_tps, a.current_pass_index, a.pass_percent) == ("pass_end", None, "m", 3.0, 1, 0.0)
    assert (a.current_chunk, a.current_chunk_index, a.chunk_percent, [e.event_type for e in a.recent_events]) == ("chunk_001", 2, 33.3, ["chunk_start", "pass_start", "pass_end"])
    assert (got["b"].chunks_completed, got["b"].chunk_percent, got["b"].current_chunk, got["c"].chunk_percent) == (0, 0.0, None, 0.0)


def test_report_of_two_books(spark):
    rows = [("a", 0, 'Chapter I\n"No," said Jim. Then he met Mr. Hands | there.'), ("a", 1, "Chapter II\nI saw Ben."), ("b", 0, "")]
    chunks = spark.createDataFrame(rows, "book string, pos int, text string")
    out = passes.run(chunks, passes.rules, ["book", "pos"], pause=0).withColumn("chunk_id", F.concat(F.lit("chunk_00"), "pos"))
    extra = [("a", 0, "timing", '{"total_duration_seconds": 2.0005, "passes": {"structure": 1, "x": "y"}}', "chunk_000"), ("a", 1, "dossiers", '{"character_dossiers": [{"name": "Jim", "accent": "a"}, {"name": "jim", "accent": "b", "biography": "Long ago."}]}', "chunk_001")]
    out = out.where("NOT (book = 'a' AND pos = 1 AND pass = 'dossiers')").select("book", "pos", "pass", "doc", "chunk_id").union(spark.createDataFrame(extra, "book string, pos int, pass string, doc string, chunk_id string")).cache()
    m = Merged(out)
    got = report.book_report("book", chunks, m.structure, m.dialogue, m.entities, m.dossiers, m.conflicts, m.names, m.report, m.timing).cache()
    cells = {(r.book, r.section, r.label): r.cell for r in got.collect()}
    assert cells["a", "Summary", "Chunks merged"] == "2" and cells["a", "Chapter List", "2"] == "Chapter II" and cells["a", "Timing", "Book total duration (s)"] == "2.001"
    assert cells["a", "Character-Level Conflicts", "Jim"] == "accent_conflict - high: a, b" and cells["a", "Biography evidence", "Jim"] == "Long ago."
    assert cells["a", "Merge Report", "timing"] == "1 present, missing: chunk_001" and cells["b", "Merge Report", "structure"] == "1 present, missing: —"
    assert cells["b", "Summary", "Chapters"] == "0" and cells["b", "Dialogue", "Attributed speakers"] == "—"
    text = {r.book: r.text for r in report.markdown(got, "book").collect()}
    assert text["a"].startswith("## Summary\n\n| | |\n|-|-|\n| Chunks merged | 2 |") and "Mr. Hands" in text["a"] and set(text) == {"a", "b"}
    docs = {(r.book, r.name): json.loads(r.body) for r in m.artifacts().collect()}
    assert len(docs) == 14 and docs["a", "merge_report"]["missing"] == {"timing": ["chunk_001"]} and docs["b", "dossiers_merged"]["character_dossiers"] == []
    (jim,) = [d for d in docs["a", "dossiers_merged"]["character_dossiers"] if d["name"] == "Jim"]
    assert jim["merge_confidence"] == "safe" and jim["accents"] == ["a", "b"] and "chunk_001" in jim["chunks"] and jim["source_dossiers"][-1]["dossier"]["biography"] == "Long ago."
    assert docs["a", "book_merged"]["structure"]["chapters"] == ["Chapter I", "Chapter II"] and docs["a", "conflict_report"]["summary"]["character_conflict_count"] == 1
    people = m.pool()
    pairs = resolve.scored_pairs(people, "book")
    groups = resolve.clusters(people, pairs, "book").cache()
    ask = lambda payload: json.dumps({"merge": True, "members_to_merge": json.loads(payload)["group_id"] and ["Jim", 3]})
    answers = resolve.adjudicated(people, groups, pairs, "book", ask)
    done = {(r.book, r.name): json.loads(r.body) for r in resolved_artifacts(m, people, groups, pairs, answers).collect()}
    assert len(done) == 8 and done["a", "resolution_report"]["candidate_group_count"] == len(done["a", "resolution_candidates"]["groups"])
