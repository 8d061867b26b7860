"""Pass outputs of chunks to book-level tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import names as N
from foliospark.functions import text as T
from foliospark.operators import folds

# What more than `over` distinct values of an attribute are called.
CONFLICTS = (
    ("roles", "role_conflict", "medium", 1),
    ("accents", "accent_conflict", "high", 1),
    ("spoken_dialogue_values", "spoken_dialogue_conflict", "high", 1),
    ("identity_status_values", "identity_status_conflict", "medium", 1),
    ("vocal_notes", "vocal_notes_drift", "low", 2),
)


def first_seen(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Distinct values per key with the place of their first appearance and their count."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias("first_pos"), F.count("*").alias("cnt"))


def dominant(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The most frequent value per key; ties go to the one seen first."""
    best = F.max_by(value, F.struct(F.col("cnt"), -F.col("first_pos")))
    return first_seen(rows.where(F.col(value).isNotNull() & (F.col(value) != "")), keys, value, order).groupBy(*keys).agg(best.alias("dominant"))


def entity_merge(mentions: DataFrame, keys: list[str], value: str, order: Column, chunk: str, collation: str | None = None) -> DataFrame:
    """Mentions grouped by normal form: canonical (seen first), variants and chunks in the order in which they appear.

    With a collation they are grouped by names.key_of() instead, and norm is the folded canonical form.
    """
    rows = mentions.withColumn("norm", N.key_of(F.col(value), collation)).where("norm <> ''").withColumn("_pos", order)
    variants = rows.groupBy(*keys, "norm", F.col(value).alias("_v")).agg(F.min("_pos").alias("_p"))
    listed = lambda v, p: F.transform(F.array_sort(F.collect_list(F.struct(F.col(p), F.col(v)))), lambda r: r[v])
    a = variants.groupBy(*keys, "norm").agg(F.min_by("_v", "_p").alias("canonical"), listed("_v", "_p").alias("variants"))
    chunks = rows.groupBy(*keys, "norm", F.col(chunk).alias("_c")).agg(F.min("_pos").alias("_p"), F.count("*").alias("_n"))
    b = chunks.groupBy(*keys, "norm").agg(listed("_c", "_p").alias("chunks"), F.sum("_n").alias("n_mentions"))
    out = a.join(b, [*keys, "norm"])
    return out if collation is None else out.withColumn("norm", N.folded(F.col("canonical")))


def completeness(chunks: DataFrame, present: DataFrame, passes: tuple, key: str, keys: list[str] = ()) -> DataFrame:
    """(keys, pass, present, missing, missing_ids) over all chunks. present: (keys, key, pass) of the outputs that exist, malformed ones too."""
    ids = [*keys, key]
    wanted = chunks.select(*ids).distinct().withColumn("pass", F.explode(F.array(*[F.lit(p) for p in passes])))
    have = present.select(*ids, "pass").distinct().withColumn("_has", F.lit(1))
    gone = F.col("_has").isNull()
    listed = F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct(T.natural_key(F.col(key).cast("string")).alias("n"), F.col(key).cast("string").alias("k"))))), lambda r: r["k"])
    return wanted.join(have, [*ids, "pass"], "left").groupBy(*keys, "pass").agg(F.count("_has").alias("present"), F.count_if(gone).alias("missing"), listed.alias("missing_ids"))


def conflicts(values: DataFrame, keys: list[str], rules: tuple = CONFLICTS) -> DataFrame:
    """(keys, type, severity, n_values, values) from values(keys, attribute, value, pos): attributes with more distinct non-empty values than allowed.

    The values are trimmed and in the order of their first pos.
    """
    cleaned = values.withColumn("value", T.strip(F.col("value"))).where("value <> ''")
    first = cleaned.groupBy(*keys, "attribute", "value").agg(F.min("pos").alias("_p"))
    counted = first.groupBy(*keys, "attribute").agg(F.count("*").alias("n_values"), in_order("value", "_p").alias("values"))
    rule = F.element_at(F.create_map(*[x for a, t, s, n in rules for x in (F.lit(a), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(n).alias("over")))]), F.col("attribute"))
    return counted.withColumn("rule", rule).where("n_values > rule.over").select(*keys, "rule.type", "rule.severity", "n_values", "values")


def in_order(value: str, pos: str) -> Column:
    """The values of a group as a list in the order of pos."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda r: r["v"])


FIT = "group_no bigint, target_pos bigint, target_name string, confidence string, reason string, score int"


def first_fit(candidates: DataFrame, key: str) -> DataFrame:
    """(key, pos, name, group_no, target_pos, target_name, confidence, reason, score) of candidates(key, pos, name, roles).

    Each candidate, in the order of pos (unique in a key), joins the first group that holds a member it matches (names.match_rule); the
    target is the first such member, null where a group begins. Order decides, so a key's candidates are one fold; what it remembers
    are not pairs but, for each of the few things by which names match, the first member of each group that has it.
    """
    f = N.form(F.col("name"))
    own = candidates.select(key, F.col("pos").cast("bigint").alias("pos"), "name", f.alias("f"), "roles")
    own = own.select(key, "pos", "name", *[f"f.{c}" for c in ("normalized", "title", "base", "surname")], N.role_state(F.col("f.title"), F.col("roles")).alias("state"))
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in (key, "pos", "name"))

    def begin():
        first: dict[tuple, dict[int, tuple]] = {}
        lowest: dict[tuple, int] = {}
        # What a form and its state lead to; it holds until a member brings its group something new to match by.
        known: dict[tuple, tuple] = {}
        made = 0

        def step(row: dict):
            nonlocal made
            plain, state = row["normalized"], row["state"]
            if (fit := known.get((plain, state))) is None:
                fit = place(plain, row["title"], row["base"], row["surname"], state, (row["pos"], row["name"]))
            yield row[key], row["pos"], row["name"], *fit

        def place(plain, title, base, surname, state, member):
            nonlocal made
            fit = {"free": ("free",), "hit": ("hit", "none", "miss"), "none": ("hit", "none"), "miss": ("hit",)}[state]
            has, wants = [("name", plain)], [(("name", plain), "safe", "exact_normalized_match", 100)]
            if surname and title:
                has += [("titled surname", surname, title), ("titled base", base), ("named", title, state)]
                wants += [(("titled surname", surname, title), "safe", "same_title_same_surname", 96), (("bare base", base), "probable", "bare_name_matches_titled_full_name", 88)]
                wants += [(("generic", title, s), "probable", "generic_title_to_single_titled_name_candidate", 78) for s in fit]
            elif surname:
                has += [("bare base", base)]
                wants += [(("titled base", base), "probable", "bare_name_matches_titled_full_name", 88)]
            elif title:
                has += [("generic", title, state)]
                wants += [(("named", title, s), "probable", "generic_title_to_single_titled_name_candidate", 78) for s in fit]
            met = [lowest[w[0]] for w in wants if w[0] in lowest]
            group = min(met, default=made)
            made += not met
            # Rules come in the order of their rank, so of those that lead to the same member the first counts.
            targets = [(first[k][group], -score, c, r) for k, c, r, score in wants if group in first.get(k, ())]
            (at, name), score, confidence, reason = min(targets, default=((None, None), None, None, None))
            found = group, at, name, confidence, reason, None if score is None else -score
            new = [h for h in has if group not in first.get(h, ())]
            for h in new:
                first.setdefault(h, {})[group] = member
                lowest[h] = min(group, lowest.get(h, group))
            if new:
                known.clear()
            else:
                known[plain, state] = found
            return found

        return step

    return folds.streamed(own, [key], ["pos"], begin, f"{kinds}, {FIT}")


def group_label(members: DataFrame, keys: list[str]) -> DataFrame:
    """The name that stands for a group: titled and long base first, then the longer name, then the earlier one."""
    members = members.groupBy(*keys, "name").agg(F.min("pos").alias("pos"))
    f = N.form(F.col("name"))
    size = F.when(f["base"] == "", 0).otherwise(F.size(F.split(f["base"], " ")))
    rank = F.struct((f["title"].isNotNull().cast("int") + size).alias("s"), F.length("name").alias("l"), (-F.col("pos")).alias("p"))
    return members.groupBy(*keys).agg(F.max_by("name", rank).alias("label"))


def group_confidence(surface: DataFrame, notes: DataFrame, book: str) -> DataFrame:
    """(book, group_no, merge_confidence, merge_reasons) of surface(book, group_no, surface_variants).

    A note (first_fit's row with a target) counts for every group of the book whose surface variants hold both its names: safe goes
    before probable, single stands for none, and reasons are in the order of the notes.
    """
    distinct = notes.where("target_name IS NOT NULL").groupBy(book, "name", "target_name", "confidence", "reason").agg(F.min("pos").alias("_p"))
    each = surface.select(book, "group_no", F.explode("surface_variants").alias("name"))
    met = each.join(distinct, [book, "name"]).join(each.withColumnRenamed("name", "target_name"), [book, "group_no", "target_name"])
    reasons = met.groupBy(book, "group_no", "reason").agg(F.min("_p").alias("_p"), F.bool_or(F.col("confidence") == "safe").alias("_safe"))
    found = reasons.groupBy(book, "group_no").agg(F.bool_or("_safe").alias("_safe"), in_order("reason", "_p").alias("merge_reasons"))
    known = F.when(F.col("_safe"), "safe").when(F.col("_safe").isNotNull(), "probable").otherwise("single")
    return surface.select(book, "group_no").join(found, [book, "group_no"], "left").select(book, "group_no", known.alias("merge_confidence"), F.coalesce("merge_reasons", F.array().cast("array<string>")).alias("merge_reasons"))


def exact_groups(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The older merge of dossiers: candidates(keys, pos, name) with norm and canonical_name, the first name of each normal form; empty forms go."""
    own = candidates.withColumn("norm", N.norm(F.col("name"))).where("norm <> ''")
    return own.join(own.groupBy(*keys, "norm").agg(F.min_by("name", "pos").alias("canonical_name")), [*keys, "norm"])


def timing_summary(timings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_seconds, passes) from timings(keys, doc): sums of the numbers among the JSON's values, rounded to three places."""
    v = jsonx.whole(F.col("doc"))
    own = timings.select(*keys, v.alias("v"))
    total = own.groupBy(*keys).agg(T.rounded(F.coalesce(F.sum(jsonx.number(F.col("v"), "$.total_duration_seconds")), F.lit(0.0)), 3).alias("total_seconds"))
    entries = F.map_entries(F.try_variant_get("v", "$.passes", "map<string,variant>"))
    each = own.select(*keys, F.explode(entries).alias("e")).select(*keys, F.col("e.key").alias("pass"), jsonx.number(F.col("e.value"), "$").alias("s")).where("s IS NOT NULL")
    sums = each.groupBy(*keys, "pass").agg(T.rounded(F.sum("s"), 3).alias("s"))
    passes = sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pass", "s")))).alias("passes"))
    return total.join(passes, list(keys), "left").withColumn("passes", F.coalesce("passes", F.create_map().cast("map<string,double>")))


def timing_rollup(passes: DataFrame, keys: list[str], name: str, seconds: str) -> DataFrame:
    """(keys, name, total_seconds, n): sums rounded to three places, a tie to the even digit."""
    return passes.groupBy(*keys, name).agg(T.rounded(F.sum(seconds).cast("double"), 3).alias("total_seconds"), F.count("*").alias("n"))


def numbered(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """rows with row_no from 1, the first `most` per key."""
    return rows.withColumn("row_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("row_no") <= most)


