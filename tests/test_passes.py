"""Model passes with models that fail on purpose, and the merges against outputs written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import passes


def answers(*rows):
    return [(b, i, p, json.dumps(d)) for b, i, p, d in rows]


def test_answers_are_recovered():
    assert passes.parsed('noise {"a": {"b": 1}} end') == {"a": {"b": 1}} and passes.parsed("[1]") == [1]
    for bad in ("", "no object", '{"a": 1}{"b": 2}'):
        with pytest.raises(ValueError):
            passes.parsed(bad)
    assert [passes.idle_seconds(180, 1.5, n, 600) for n in range(5)] == [180, 270, 405, 600, 600]


def test_retries_and_failures(spark):
    def model(name, prompt, idle):
        if "slow" in prompt and idle < 5:
            raise TimeoutError(f"idle {idle}")
        if "broken" in prompt and name == "entities":
            return "{"
        return passes.rules(name, prompt)

    rows = [("a", 0, 'Chapter I\n"No," said Jim. He met Mr. Hands.'), ("a", 1, "slow"), ("b", 0, "broken"), ("b", 1, None)]
    chunks = spark.createDataFrame(rows, "book string, chunk int, text string")
    out = passes.run(chunks, model, ["book", "chunk"], idle=4, retries=1, pause=0).cache()
    got = {(r.book, r.chunk, r["pass"]): r for r in out.collect()}
    assert len(got) == 4 + 4 + 3 + 4
    assert got["a", 1, "structure"].attempts == 2 and got["a", 0, "structure"].attempts == 1
    assert got["b", 0, "entities"].error and got["b", 0, "entities"].doc is None and ("b", 0, "dossiers") not in got
    assert [(r.book, r.chunk) for r in passes.resumed(chunks, out, ["book", "chunk"]).collect()] == [("b", 0)]
    times = passes.timings(out, ["book", "chunk"]).collect()
    assert len(times) == 3 and all(set(r.passes) == {"structure", "dialogue", "entities", "dossiers"} for r in times)
    assert json.loads(got["a", 0, "dialogue"].doc)["explicitly_attributed_speakers"] == ["Jim"]
    assert "Mr. Hands" in [d["name"] for d in json.loads(got["a", 0, "dossiers"].doc)["character_dossiers"]]
    with pytest.raises(Exception, match="pass entities"):
        passes.run(chunks, model, ["book", "chunk"], idle=9, retries=0, stop=True).collect()


def test_structure_and_dialogue_of_a_book(spark):
    rows = answers(
        ("a", 0, "structure", {"chapters": ["I", 7], "parts": []}), ("a", 1, "structure", {"chapters": [], "chapter_titles": ["II", "I"], "scene_breaks": ["***"]}),
        ("a", 0, "dialogue", {"pov": "x", "dialogue": True, "explicitly_attributed_speakers": ["Jim", "Ben"]}), ("a", 1, "dialogue", {"pov": "y", "dialogue": "yes", "explicitly_attributed_speakers": ["Ben", "Al"]}),
        ("b", 0, "dialogue", []), ("b", 0, "structure", None),
    )
    out = spark.createDataFrame(rows + [("b", 1, "structure", "{bad"), ("b", 2, "dialogue", None)], "book string, pos int, pass string, doc string")
    assert {(r.book, r.kind): r["values"] for r in passes.structure_merge(out, "book").collect()} == {("a", "chapters"): ["I", "II"], ("a", "scene_breaks"): ["***"]}
    d = {r.book: r for r in passes.dialogue_merge(out, "book").collect()}
    assert (d["a"].dominant_pov, d["a"].observed_pov_values, d["a"].explicitly_attributed_speakers) == ("x", ["x", "y"], ["Jim", "Ben", "Al"])
    assert d["b"].dominant_pov is None and d["b"].dialogue_present_in_chunks == 0 and d["b"].explicitly_attributed_speakers == []


def test_dossiers_of_a_book(spark):
    rows = answers(
        ("a", 0, "dossiers", {"character_dossiers": [{"name": "Dr. Livesey", "role": "physician", "roles": ["magistrate"], "aliases": "none"}, {"name": " "}, 3]}),
        ("a", 2, "dossiers", {"dossiers": [{"name": "Jim", "spoken_dialogue": True}, {"name": "the doctor", "role": "physician", "accent": "plain", "vocal_notes": ["x"]}]}),
        ("a", 3, "dossiers", {"character_dossiers": []}),
    )
    out = spark.createDataFrame(rows, "book string, pos int, pass string, doc string")
    got = passes.dossier_merge(out, "book").orderBy("group_no").collect()
    assert [(r.canonical_name, r.chunks, r.n_dossiers, r.merge_confidence, r.merge_reasons) for r in got] == [("Dr. Livesey", [0, 2], 2, "probable", ["generic_title_to_single_titled_name_candidate"]), ("Jim", [2], 1, "single", [])]
    assert got[0].variants == ["Dr. Livesey", "the doctor"] and got[0].roles == ["physician", "magistrate"] and got[0].accents == ["plain"]
    assert got[0].aliases == [] and got[1].spoken_dialogue_values == ["true"] and got[0].vocal_notes == []


def test_values_of_other_types_are_left_out(spark):
    odd = [{"name": 7}, "x", {"name": "A", "accent": 5, "role": ["r"], "spoken_dialogue": None, "aliases": [" a ", "", 3, "a"]}, {"name": "a", "spoken_dialogue": "True", "identity_status": {"k": 1}}, {"name": "a", "spoken_dialogue": True}, {"name": "a", "spoken_dialogue": False}]
    out = spark.createDataFrame(answers(("b", 0, "dossiers", {"character_dossiers": odd})), "book string, pos int, pass string, doc string")
    (r,) = passes.dossier_merge(out, "book").collect()
    assert (r.canonical_name, r.accents, r.roles, r.identity_status_values, r.spoken_dialogue_values, r.aliases) == ("A", [], [], [], ["True", "false"], [" a ", "", "a"])
    assert r.surface_variants == ["A", "a"] and len(r.source_dossiers) == 4
    flags = answers(("b", 0, "dialogue", {"dialogue": "false", "internal_thought": 0, "unattributed_dialogue_present": [], "pov": 3}), ("b", 1, "dialogue", {"dialogue": 0.0, "internal_thought": {"a": 1}, "pov": ""}))
    d = passes.dialogue_merge(spark.createDataFrame(flags, "book string, pos int, pass string, doc string"), "book").first()
    assert (d.dialogue_present_in_chunks, d.internal_thought_present_in_chunks, d.unattributed_dialogue_present_in_chunks, d.observed_pov_values) == (1, 1, 0, [])
    shapes = answers(("b", 0, "structure", {"chapters": [1], "chapter_titles": ["I"], "scene_breaks": [1, "1", {"a": 2}], "status": None}))
    s = spark.createDataFrame(shapes, "book string, pos int, pass string, doc string")
    assert {r.kind: r["values"] for r in passes.structure_merge(s, "book").collect()} == {"scene_breaks": ["1", '{"a":2}']}
    assert passes.structure_chunks(s, "book").first().chapters == ["1"]


def test_a_slice_of_chunks_and_rates(spark):
    chunks = spark.createDataFrame([(n,) for n in ("c_10.txt", "c_2.txt", "c_1.txt", "c_3.txt")], "name string")
    names = lambda **k: [r.name for r in passes.sliced(chunks, "name", **k).collect()]
    assert names(start_at="c_10", limit=2) == ["c_10.txt", "c_2.txt"] and names(start_at="x") == [] and len(names()) == 4
    one = spark.createDataFrame([("a b c", 0.0, None), ("a b c", 2.0, 7.0)], "t string, s double, r double")
    assert [r[0] for r in one.select(passes.tokens_estimate(F.col("t"), F.col("s"), F.col("r"))).collect()] == [3000.0, 7.0]
