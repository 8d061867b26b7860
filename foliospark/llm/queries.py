"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, conversations, language, media, packing, quality, secrets, sharding, simhash, substring, topk, toxicity, txlog
from foliospark.llm.common import fitted, fold, table

#: Bounds of the labelled rows that the classifiers are fitted on.
TOXICITY_ROWS, QUALITY_ROWS, LANGUAGE_ROWS = 8000, 3000, 3000
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from a bounded sample of the labelled rows outside the held-out fold."""
    learn = labels.where(fold(mod=5) != 0)
    return fitted(toxicity.labelled(docs, learn, "toxic", TOXICITY_ROWS), toxicity.train)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(mod=5) == 0).alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", "worst_score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(fold(mod=3) != 1)
    model = fitted(toxicity.labelled(docs, learn, "quality", QUALITY_ROWS), quality.train)
    return quality.score(docs, model).select("doc_id", (fold(mod=3) == 1).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(language.labelled(docs.where(fold(mod=3) != 1), LANGUAGE_ROWS), language.train)
    return language.score(docs, model).select("doc_id", (fold(mod=3) == 1).alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op12_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_bpe, op3_toxicity, op4_quality, op5_language, op6_substring_dedup, op7_topk, op8_secrets, op9_simhash, op10_media, op11_sharding, op12_transactions, op13_conversations)}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
bad AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 50)) AS p FROM s JOIN f USING (win) WHERE f.first < s.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM words w LEFT JOIN bad b ON w.doc_id = b.doc_id AND w.p = b.p WHERE b.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


#: CRC-32's table by its rule, and the CRC of a text's UTF-8 bytes.
CRC_TABLE_SQL = "crcs AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc_sql(text: str) -> str:
    held = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {held}, lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295)"


#: With rollbacks that keep their savepoint, a change is undone by the next savepoint or end of its transaction only if a rollback comes before them.
OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
h AS (SELECT coalesce('=' || source, '') AS stream, doc_id, text, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crcs WHERE doc_id IS NOT NULL),
k AS (SELECT *, CASE WHEN h % 41 <= 1 THEN 'commit' WHEN h % 41 = 2 THEN 'abort' WHEN h % 41 <= 4 THEN 'savepoint' WHEN h % 41 <= 6 THEN 'rollback' ELSE 'change' END AS op, h // 100 % 3000 AS key,
  text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS live FROM h),
n AS (SELECT stream, doc_id, op, key, live, CASE WHEN live AND op = 'change' THEN {crc_sql("key || ':' || text")} ELSE 0 END AS v,
  min(CASE WHEN op IN ('commit', 'abort') THEN doc_id END) OVER w AS closer, min(CASE WHEN op <> 'change' THEN doc_id END) OVER w AS mark
  FROM k, crcs WINDOW w AS (PARTITION BY stream ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT n.*, CASE WHEN m.op = 'rollback' THEN 'rollback' WHEN e.op = 'commit' THEN 'commit' ELSE 'abort' END AS outcome FROM n LEFT JOIN k m ON m.doc_id = n.mark LEFT JOIN k e ON e.doc_id = n.closer WHERE n.op = 'change'),
e AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 + 1 AS epoch FROM k WHERE op = 'commit'),
a AS (SELECT epoch, key, live::BIGINT AS n, v FROM c JOIN e ON e.doc_id = c.closer WHERE outcome = 'commit' QUALIFY row_number() OVER (PARTITION BY epoch, key ORDER BY closer DESC, c.doc_id DESC) = 1),
d AS (SELECT epoch, n - coalesce(lag(n) OVER w, 0) AS n, v - coalesce(lag(v) OVER w, 0) AS v FROM a WINDOW w AS (PARTITION BY key ORDER BY epoch)),
s AS (SELECT epoch, coalesce(sum(n), 0) AS n, coalesce(sum(v), 0) AS v FROM (SELECT DISTINCT epoch FROM e) LEFT JOIN d USING (epoch) GROUP BY epoch)
SELECT 'state' AS kind, CAST(epoch AS BIGINT) AS id, CAST(sum(n) OVER (ORDER BY epoch) AS BIGINT) AS n, CAST(sum(v) OVER (ORDER BY epoch) AS BIGINT) AS value FROM s
UNION ALL SELECT outcome, doc_id, CASE outcome WHEN 'rollback' THEN mark ELSE closer END, CAST(key AS BIGINT) FROM c WHERE outcome <> 'commit'
"""


#: The primes of XXH64.
XXH64 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_WORD = "18446744073709551615::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"((({a}) * {b}::UHUGEINT) & {_WORD})"


def _turned(a: str, by: int) -> str:
    return f"(((({a}) * {1 << by}::UHUGEINT) & {_WORD}) + ({a}) // {1 << (64 - by)}::UHUGEINT)"


def _hash_steps(rows: str, name: str, out: str, value: str, seed: str, wide: bool = True) -> str:
    """CTEs from rows to `name`, which adds `out`: XXH64 of a long's (or an int's) bytes with a seed, as an unsigned word."""
    p1, p2, p3, p4, p5 = XXH64
    if wide:
        first = [f"(({seed}) + {p5}::UHUGEINT + 8) & {_WORD} AS x, {_times(value, p2)} AS y", f"x, {_turned('y', 31)} AS y", f"xor(x, {_times('y', p1)}) AS x", f"{_turned('x', 27)} AS x", f"({_times('x', p1)} + {p4}::UHUGEINT) & {_WORD} AS x"]
    else:
        first = [f"xor((({seed}) + {p5}::UHUGEINT + 4) & {_WORD}, {_times(value, p1)}) AS x", f"{_turned('x', 23)} AS x", f"({_times('x', p2)} + {p3}::UHUGEINT) & {_WORD} AS x"]
    last = [f"{_times(f'xor(x, x // {1 << 33}::UHUGEINT)', p2)} AS x", f"{_times(f'xor(x, x // {1 << 29}::UHUGEINT)', p3)} AS x", f"xor(x, x // {1 << 32}::UHUGEINT) AS {out}"]
    steps, at = [], rows
    for i, step in enumerate([*first, *last]):
        to = name if i == len(first) + len(last) - 1 else f"{name}_{i}"
        steps.append(f"{to} AS (SELECT {'*' if i == 0 else '* EXCLUDE (x' + (', y' if wide and i < 3 else '') + ')'}, {step} FROM {at})")
        at = to
    return ", ".join(steps)


#: The jumps one by one, and slots in the order of the hash of what tells rows apart. Ids are at least 0, as in the table.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crcs),
{_hash_steps("d", "k", "h", "doc_id::UHUGEINT", "42::UHUGEINT")},
j AS (SELECT doc_id, size, text_crc32, h AS seed, h, -1::BIGINT AS b, 0::BIGINT AS j FROM k
 UNION ALL SELECT doc_id, size, text_crc32, seed, h, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(h // 8589934592::UHUGEINT + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, size, text_crc32, seed, j, ({_times("h", sharding.MULTIPLIER)} + 1) & {_WORD} AS h FROM j WHERE j < 16)),
g AS (SELECT doc_id, size, text_crc32, seed, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 16 THEN 16 ELSE b END AS INTEGER) AS grown_shard FROM j WHERE j >= 16),
{_hash_steps("g", "s1", "h1", "size::UHUGEINT", "seed")}, {_hash_steps("s1", "s2", "h2", "text_crc32::UHUGEINT", "h1")}, {_hash_steps("s2", "s3", "h3", "grown_shard::UHUGEINT", "h2", False)}
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h3, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s3
"""


def oracle_sql() -> dict:
    return {"op6_substring_dedup": OP6_SQL, "op7_topk": OP7_SQL, "op11_sharding": OP11_SQL, "op12_transactions": OP12_SQL}
