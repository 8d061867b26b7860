"""What books with very many chunks need: no sort of all their values, no list beside each of its elements, no whole table in one task."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import jsonx, names
from foliospark.operators import folds, merge, passes
from foliospark.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def outputs(spark, rows):
    docs = [("b", pos, "dossiers", json.dumps({"character_dossiers": found})) for pos, found in rows]
    return spark.createDataFrame(docs, "book string, pos int, pass string, doc string")


def test_values_in_order_without_sorting_all_of_them(spark):
    rows = spark.createDataFrame([("b", 2, 0, "x"), ("b", 1, 1, "y"), ("b", 1, 0, "z"), ("b", None, 5, "n"), ("b", 0, 0, "x"), ("b", -1, 999_999_999, "m")], "book string, pos int, i int, value string")
    got = passes._in_order(rows, "book", [])
    assert got.first()["values"] == ["n", "m", "x", "z", "y"]
    assert "SortAggregate" not in plan(got)


@pytest.mark.parametrize("values, shown", [([True, "True", False], ["true", "false"]), (["True", True], ["True"]), (["true", True], ["true", "true"]), ([1, "1", 1.5, {"a": None}], ["1", "1.5", '{"a":null}'])])
def test_spoken_values_are_shown_as_they_first_came(spark, values, shown):
    got = passes.dossier_merge(outputs(spark, [(i, [{"name": "Ann", "spoken_dialogue": x}]) for i, x in enumerate(values)]), "book")
    assert got.first()["spoken_dialogue_values"] == shown


def test_null_scene_breaks_are_shown(spark):
    rows = spark.createDataFrame([("b", 0, "structure", '{"scene_breaks": [null, "None", true, "None "]}')], "book string, pos int, pass string, doc string")
    got = passes.structure_merge(rows, "book").where("kind = 'scene_breaks'").first()
    assert got["values"] == ["null", "true", "None "]


def test_names_before_aliases_and_sources_in_order(spark):
    rows = [(3, [{"name": "Ann Lee", "aliases": ["Annie"]}, {"name": "ann lee", "aliases": []}]), (1, [{"name": "ANN LEE", "aliases": ["A."]}])]
    got = passes.dossier_merge(outputs(spark, rows), "book").first()
    assert got["surface_variants"] == ["ANN LEE", "Ann Lee", "ann lee", "A.", "Annie"]
    assert (got["chunks"], got["n_dossiers"], [s["chunk"] for s in got["source_dossiers"]]) == ([1, 3], 3, [1, 3, 3])
    assert got["canonical_name"] == "ANN LEE" and got["place"] == 0


def test_sources_are_not_listed_where_nobody_asks(spark):
    got = passes.dossier_merge(outputs(spark, [(0, [{"name": "Ann"}])]), "book")
    assert "ExistingRDD" not in plan(got.select("book", "group_no", "chunks"))
    assert "ExistingRDD" in plan(got.select("book", "source_dossiers"))


def test_conflicts_without_joining_dossiers_to_themselves(spark):
    rows = [(0, [{"name": "Ann", "role": " cook ", "accent": "plain"}]), (1, [{"name": "Ann", "role": "cook", "accent": "broad"}]), (2, [{"name": "Ann", "vocal_notes": "low"}])]
    out = outputs(spark, rows)
    dossiers = passes.dossier_merge(out, "book")
    entities = merge.entity_merge(passes.entity_mentions(out, "book"), ["book", "kind"], "value", F.col("pos"), "pos")
    people = passes.conflict_report("book", dossiers.localCheckpoint(), entities, passes.dialogue_merge(out, "book"), passes.structure_chunks(out, "book")).where("scope = 'character'")
    assert "Join" not in plan(people)
    assert [(r["type"], r["severity"], r["values"], r["message"]) for r in people.collect()] == [("accent_conflict", "high", ["plain", "broad"], "Multiple accent recommendations observed for Ann.")]


def test_group_confidence_carries_no_list_beside_its_elements(spark):
    surface = spark.createDataFrame([("b", 0, ["Ann", "Annie", "Lee"]), ("b", 1, ["Bo"])], "book string, group_no bigint, surface_variants array<string>")
    notes = spark.createDataFrame([("b", 5, "Annie", "Ann", "probable", "r2"), ("b", 3, "Lee", "Annie", "safe", "r1"), ("b", 4, "Bo", "Ann", "safe", "r1"), ("b", 1, "Bo", None, None, None)], "book string, pos bigint, name string, target_name string, confidence string, reason string")
    got = merge.group_confidence(surface, notes, "book")
    assert "array_contains" not in plan(got)
    assert {r["group_no"]: (r["merge_confidence"], r["merge_reasons"]) for r in got.collect()} == {0: ("safe", ["r1", "r2"]), 1: ("single", [])}


def test_parts_are_dealt_out_before_their_json_is_read(spark):
    cores = spark.sparkContext.defaultParallelism
    assert registry.t(spark, SF, "part").rdd.getNumPartitions() < cores
    assert registry._dossier_docs(spark, SF).rdd.getNumPartitions() >= cores
    assert len(re.findall("RepartitionByExpression|REPARTITION_BY_NUM", plan(registry._dossier_docs(spark, SF)))) == 1


def test_tried_passes_come_by_the_batch_and_keep_their_keys(spark):
    chunks = spark.createDataFrame([(None, 0, "a"), (7, 1, None), (7, 2, "bad"), (2**62 + 1, 3, "b")], "book bigint, pos int, text string").coalesce(1)
    model = lambda name, prompt, idle: "{" if prompt == "bad" and name == "dialogue" else json.dumps({"said": prompt})
    got = passes.run(chunks, model, ["book", "pos"], passes=("structure", "dialogue"), retries=0, pause=0)
    rows = {(r["book"], r["pos"], r["pass"]): r for r in got.collect()}
    assert set(rows) == {(b, p, n) for b, p in ((None, 0), (7, 1), (7, 2), (2**62 + 1, 3)) for n in ("structure", "dialogue")}
    assert rows[7, 1, "structure"]["doc"] == '{"said": ""}' and rows[7, 2, "dialogue"]["doc"] is None and rows[7, 2, "dialogue"]["error"]
    assert "MapInArrow" in plan(got)


def test_a_text_is_parsed_once(spark):
    got = spark.createDataFrame([('{"a": 1}',), ("1, 2",), ("",), (None,), ('{"a":',)], "doc string").select(jsonx.whole(F.col("doc")).alias("v"))
    assert [r[0] for r in got.select(F.to_json("v")).collect()] == ['{"a":1}', None, None, None, None]
    assert len(re.findall("parse_json|parseJson", got._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_dossiers_are_read_from_json_once(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(passes, "kept", lambda df, kind: plans.setdefault(kind, (plan(df), df.localCheckpoint()))[1])
    rows = [(0, [{"name": "Ann", "role": " cook ", "roles": ["x", 1, None, " "], "accent": 3, "spoken_dialogue": None, "biography": ""}]), (1, [{"name": "ann", "spoken_dialogue": [1], "personality_traits": ["a", " b "], "identity_status": "known"}])]
    got = passes.dossier_merge(outputs(spark, rows), "book").first()
    assert [kind for kind, (p, _) in plans.items() if re.search("parse_json|parseJson", p)] == ["dossier-values"]
    assert (got["roles"], got["accents"], got["spoken_dialogue_values"], got["biographies"]) == ([" cook ", "x", " "], [], ["[1]"], [])
    assert (got["personality_traits"], got["identity_status_values"], got["n_dossiers"]) == (["a", " b "], ["known"], 2)
    assert [json.loads(s["dossier"])["name"] for s in got["source_dossiers"]] == ["Ann", "ann"]


def test_a_name_met_before_is_not_placed_anew(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(folds, "streamed", lambda rows, keys, order, begin, schema: held.update(begin=begin))
    merge.first_fit(spark.createDataFrame([], "book string, pos long, name string, roles array<string>"), "book")
    step = held["begin"]()
    full = {"book": "b", "name": "Ann", "normalized": "ann", "title": None, "base": "ann", "surname": "ann", "state": "free"}
    assert [list(step(full | {"pos": i}))[0][3:5] for i in range(2)] == [(0, None), (0, 0)]
    # Once a form has led to nothing new, its parts are not looked at again.
    assert list(step({k: full[k] for k in ("book", "name", "normalized", "state")} | {"pos": 2})) == [("b", 2, "Ann", 0, 0, "Ann", "safe", "exact_normalized_match", 100)]


def test_groups_of_repeated_names_as_by_all_pairs(spark):
    deal = random.Random(5)
    said = ["Dr. Ann Lee", "doctor lee", "Lee", "Ann Lee", "the Doctor", "captain", "Capt. Bo", "Bo", "Miss Bo", "captain bo lee", "Mr. Lee", "mr", "stranger", "the", "Captain Lee"]
    rows = [("b" if i % 3 else "c", i, deal.choice(said[: 2 + i // 12]), [[], ["surgeon"], ["an old sailor"], ["cook"]][deal.randrange(4)]) for i in range(180)]
    df = spark.createDataFrame(rows, "book string, pos long, name string, roles array<string>")
    f = df.withColumn("f", names.form(F.col("name"))).localCheckpoint()
    a, b = f.alias("a"), f.alias("b")
    rule = names.match_rule(F.col("a.f"), F.col("b.f"), F.col("a.roles"), F.col("b.roles"))
    pairs = a.join(b, F.expr("a.book = b.book AND a.pos < b.pos")).select(F.col("a.pos").alias("x"), F.col("b.pos").alias("y"), rule.alias("r")).where("r.score > 0")
    met = {(r["x"], r["y"]): r["r"] for r in pairs.collect()}
    group, made, want = {}, {}, set()
    for book, pos, name, _ in rows:
        hits = [p for p in group if (p, pos) in met]
        if hits:
            group[pos] = min(group[p] for p in hits)
            at = min(p for p in hits if group[p] == group[pos])
            want.add((book, pos, name, group[pos], at, rows[at][2], *met[at, pos]))
        else:
            group[pos] = made.setdefault(book, 0)
            made[book] += 1
            want.add((book, pos, name, group[pos], None, None, None, None, None))
    assert {tuple(r) for r in merge.first_fit(df, "book").collect()} == want
