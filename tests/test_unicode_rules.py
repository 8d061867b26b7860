"""Line rules on white space and digits beyond ASCII, against Python's own str methods and re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import ingest

SPACES = [" ", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　"]
PARTS = ["Chapter", "CHAPTER", "part", "page", "IV", "7", "٣", "१२", "/", "* * *", "***", "- - -", ".....", "a", "é", "½", "Contents", "​", "᠎", "end."]
RULES = {
    "page": (T.PAGE_MARKER, re.compile(r"^\s*(?:page\s+\d+|\d+/\d+|\d+)\s*$", re.I)),
    "chapter": (T.CHAPTER, re.compile(r"^\s*chapter\s+[ivxlcdm0-9]+\b", re.I)),
    "part": (T.PART, re.compile(r"^\s*part\s+\w+", re.I)),
    "scene": (T.SCENE_BREAK, re.compile(r"^\s*(?:\*\s*\*\s*\*|-\s*-\s*-|•\s*•\s*•)\s*$")),
    "toc": (T.TOC_LEADER, re.compile(r"\.{3,}\s*\d+\s*$")),
}


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(8)
    return ["".join(rng.choice(PARTS + SPACES * 2) for _ in range(rng.randrange(7))) for _ in range(3000)] + ["a b　c", "٣", "　Chapter 1", "Chapter 1"]


def test_rules_equal_pythons(spark, lines):
    c = F.col("line")
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", T.word_count(c).alias("n"), T.strip(c).alias("strip"), T.collapse(c).alias("collapse"), *[c.rlike(p).alias(k) for k, (p, _) in RULES.items()]).collect()
    for r in got:
        assert (r.n, r.strip, r.collapse) == (len(re.findall(r"\S+", r.line)), r.line.strip(), re.sub(r"\s+", " ", r.line).strip()), repr(r.line)
        for k, (_, p) in RULES.items():
            assert r[k] == bool(p.search(r.line)), (k, r.line)


def natural(name):
    return [(1, int(p)) if p.isdecimal() else (0, p.lower()) for p in re.split(r"(\d+)", name)]


def test_natural_order_of_digit_runs_of_any_length(spark):
    rng = random.Random(2)
    names = ["chunk_2", "chunk_10", "chunk_99999999999999999999", "chunk_0100000000000000000000", "chunk_٣", "chunk_", "Chunk_4", "chunk_000", "7", ""]
    names += ["".join(rng.choice(["a", "B", "1", "0", "22", "٣", "_"]) for _ in range(rng.randrange(8))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()]
    assert got == sorted(names, key=lambda n: (natural(n), n.encode()))


def test_pages_and_headings_in_a_text(spark):
    text = "　Chapter 1\nOne two　three.\n٣\n \npage ١٢\n\x85Part one\nfour\xa0five"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    stats = ingest.clean_stats(docs).first()
    assert (stats.removed_page_markers, stats.raw_word_count, stats.clean_word_count) == (2, len(text.split()), len(text.split()) - 3)
    assert [(r.kind, r.text) for r in ingest.clean_paragraphs(docs).orderBy("para_no").collect()] == [("heading", "Chapter 1"), ("text", "One two three."), ("heading", "Part one"), ("text", "four five")]
