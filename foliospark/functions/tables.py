"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliospark.functions import text as T

_KINDS = {"int": IntegerType(), "bigint": LongType(), "string": StringType()}
CHUNK = [StructField(n, _KINDS[t]) for n, t in (("chunk_no", "int"), ("first_para", "bigint"), ("n_paragraphs", "int"), ("word_count", "bigint"), ("char_count", "bigint"), ("part_hint", "string"), ("chapter_hint", "string"), ("text", "string"))]
WORD, CHAPTER, PART, SCENE = (regex.compile(p) for p in (T.WORD, T.CHAPTER, T.PART, T.SCENE_BREAK))


class Chunks:
    """SELECT * FROM folio_chunks(TABLE(paragraphs), least, target, most): the chunks of each book's paragraphs.

    The table has book, para_no and text, and is partitioned by book and ordered by para_no without being asked to. Rules as in
    ingest.chunk_records(). The walk holds the open chunk alone, so a book may be larger than a row; it is one task's work, see operators.longbooks
    for more tasks. Null texts are empty paragraphs; rows of a null book are one book.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, least: AnalyzeArgument, target: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"book", "para_no", "text"} <= set(rows.dataType.names):
            raise ValueError("the first argument is a table with book, para_no and text")
        if not (least.isConstantExpression and target.isConstantExpression and most.isConstantExpression) or not least.value <= target.value <= most.value:
            raise ValueError("least <= target <= most is needed, three constants")
        return AnalyzeResult(schema=StructType([rows.dataType["book"], *CHUNK]), partitionBy=[PartitioningColumn("book")], orderBy=[OrderingColumn("para_no")])

    def __init__(self):
        self.no, self.part, self.chapter, self.book = 0, None, None, None
        self._open()

    def _open(self) -> None:
        self.texts, self.words, self.first = [], 0, None

    def _close(self, part: str | None, chapter: str | None) -> tuple:
        body = "\n\n".join(self.texts) + "\n"
        row = (self.book, self.no, self.first, len(self.texts), self.words, len(body), part, chapter, body)
        self.no += 1
        self._open()
        return row

    def eval(self, row: Row, least: int, target: int, most: int) -> Iterator[tuple]:
        text, self.book = row["text"] or "", row["book"]
        words, chapter, part, scene = len(WORD.findall(text)), bool(CHAPTER.search(text)), bool(PART.search(text)), bool(SCENE.search(text))
        self.part = text if part else self.part  # a part counts for the chunk that it closes
        full = self.words >= least if chapter else self.words >= target if scene else self.words + words > most
        if self.texts and full:
            yield self._close(self.part, self.chapter)
        self.chapter = text if chapter else self.chapter
        self.first = row["para_no"] if self.first is None else self.first
        self.texts.append(text)
        self.words += words
        heading = text != "" and (chapter or part or (len(text) <= 90 and text == text.upper() and regex.search("[A-Z]", text)))
        if not chapter and not scene and self.words >= target and (text[-1:] in (".", '"', "'") or heading):
            yield self._close(self.part, self.chapter)

    def terminate(self) -> Iterator[tuple]:
        if self.texts:
            yield self._close(self.part, self.chapter)


def register(spark: SparkSession, name: str = "folio_chunks") -> None:
    spark.udtf.register(name, F.udtf(Chunks))
