"""Names that differ in case and accents only, with and without a collation."""

from pyspark.sql import functions as F

from foliospark.functions import names
from foliospark.operators import merge, resolve

ROWS = [("b", 0, "Élodie"), ("b", 1, "elodie"), ("b", 2, "ÉLODIE "), ("b", 3, "Elodie-Anne"), ("b", 4, "“Elodie”"), ("b", 5, "日本"), ("b", 6, "?!"), ("c", 7, "ELODIE")]


def test_entities(spark):
    mentions = spark.createDataFrame(ROWS, "book string, pos int, name string")
    got = merge.entity_merge(mentions, ["book"], "name", F.col("pos"), "pos", "UNICODE_CI_AI")
    assert sorted((r.book, r.norm, r.canonical, r.variants, r.n_mentions) for r in got.collect()) == [
        ("b", "elodie anne", "Elodie-Anne", ["Elodie-Anne"], 1), ("b", "élodie", "Élodie", ["Élodie", "elodie", "ÉLODIE ", "“Elodie”"], 4), ("b", "日本", "日本", ["日本"], 1), ("c", "elodie", "ELODIE", ["ELODIE"], 1),
    ]
    plain = merge.entity_merge(mentions, ["book"], "name", F.col("pos"), "pos")
    assert {(r.book, r.norm): r.n_mentions for r in plain.collect()} == {("b", "lodie"): 2, ("b", "elodie"): 2, ("b", "elodie anne"): 1, ("c", "elodie"): 1}


def test_pool(spark):
    rows = resolve.pool_rows(spark.createDataFrame(ROWS, "book string, pos int, name string"), "book", "entities")
    got = {(r.book, r.norm): r.variants for r in resolve.pool(rows, "book", "UNICODE_CI_AI").collect()}
    assert got["b", "élodie"] == ["Élodie", "elodie", "ÉLODIE ", "“Elodie”"] and ("b", "elodie") not in got and got["c", "elodie"] == ["ELODIE"]
    assert {r.norm for r in resolve.pool(rows, "book").collect()} == {"lodie", "elodie", "elodie anne", ""}


def test_keys_are_equal_under_the_collation(spark):
    pair = spark.createDataFrame([("Élodie", "elodie", True), ("Zoë  X", "ZOE_x", True), ("a", "b", False), ("ø", "o", True), ("ß", "b", False)], "a string, b string, same boolean")
    for r in pair.select("same", (names.key_of(F.col("a"), "UNICODE_CI_AI") == names.key_of(F.col("b"), "UNICODE_CI_AI")).alias("got")).collect():
        assert r.got == r.same
