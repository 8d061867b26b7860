"""Identity resolution: pair scores by blocking, clusters around seeds, and applying a map of variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import names as N
from foliospark.functions import text as T
from foliospark.operators import folds

#: From this score on two names may be one character.
LINK = 45


#: The sources of the pool, in the order in which they count.
SOURCES = ("entities", "entities_normalized", "dialogue", "dossiers", "conflict_report")
LISTS = ("roles", "chunks", "variants", "accents")


def pool_rows(rows: DataFrame, key: str, source: str, name: str = "name", pos: str = "pos", **lists: Column) -> DataFrame:
    """rows as input of pool(): (key, source, pos, name, roles, chunks, variants, accents), lists that aren't given empty, blank names dropped."""
    empty = F.array().cast("array<string>")
    got = [F.coalesce(lists[x].cast("array<string>"), empty).alias(x) if x in lists else empty.alias(x) for x in LISTS]
    return rows.select(key, F.lit(source).alias("source"), F.col(pos).cast("bigint").alias("pos"), F.col(name).alias("name"), *got).where(T.strip(F.col("name")) != "")


def character_pool(book: str, entities: DataFrame, normalized: DataFrame, speakers: DataFrame, dossiers: DataFrame, conflicts: DataFrame) -> DataFrame:
    """pool() of a book's five sources.

    entities, speakers: (book, pos, name). normalized: (book, pos, canonical, variants, chunks). dossiers: (book, pos, name, roles,
    chunks, variants, surface_variants, accents). conflicts: (book, pos, name, variants, surface_variants, chunks).
    """
    c, both = F.col, F.concat("variants", "surface_variants")
    parts = [
        pool_rows(entities, book, "entities"),
        pool_rows(normalized, book, "entities_normalized", "canonical", variants=c("variants"), chunks=c("chunks")),
        pool_rows(speakers, book, "dialogue"),
        pool_rows(dossiers, book, "dossiers", roles=c("roles"), chunks=c("chunks"), variants=both, accents=c("accents")),
        pool_rows(conflicts, book, "conflict_report", variants=both, chunks=c("chunks")),
    ]
    return pool(reduce(DataFrame.unionByName, parts), book)


def pool(rows: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    """(key, norm, name, first, f, sources, roles, chunks, variants, accents) from rows as pool_rows() makes them.

    Names are grouped by normal form, an empty one too; the first name stands for the group, `first` is its place. Lists hold each value once in the order
    of its first appearance, a row's name before its variants; sources keep repeats. With a collation names are grouped by names.key_of(), and norm is the
    folded first name.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    own = rows.withColumn("norm", N.key_of(F.col("name"), collation)).withColumn("at", F.struct(rank.alias("rank"), "pos")).withColumn("variants", F.concat(F.array("name"), "variants"))

    def listed(x: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", x))), lambda r: r[x])))

    out = own.groupBy(key, "norm").agg(
        F.min_by("name", "at").alias("name"),
        F.min("at").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda r: r["source"]).alias("sources"),
        *[listed(x).alias(x) for x in LISTS],
    ).withColumn("f", N.form(F.col("name"), N.RESOLVER_TITLES, N.RESOLVER_GENERIC))
    return out if collation is None else out.withColumn("norm", N.folded(F.col("name")))


def scored_pairs(people: DataFrame, key: str, least: int = LINK) -> DataFrame:
    """(key, a, b, score, reasons) with a < b by normal form, of pairs of pool() that reach `least`, LINK at least.

    A pair's points decide what it must share, so nothing is compared with everything, and no surname or title blocks by itself. Equal forms
    have 100 and variants 50 points. A surname has 40, so it needs a title (20), a given name (15), a role (12) or two chunks (4 each)
    besides. Without it there are title and given name with a role or three chunks; title and role with four chunks; given name and role with five;
    and a title that stands alone (20 and 22) with the same title, a role or a chunk, or another that stands alone.
    """
    if least < LINK:
        raise ValueError(f"pairs below {LINK} points aren't found")
    f = F.col("f")
    lower = F.array_distinct(F.transform("roles", lambda r: F.lower(r)))
    spoken = F.array_distinct(F.transform("variants", lambda v: N.norm(v)))
    own = people.select(key, "norm", "f", "chunks", lower.alias("roles"), spoken.alias("spoken"))

    title, given, surname, alone = f["title"], f["given"], f["surname"], F.coalesce(f["is_generic"], F.lit(False))
    chunks = F.array_compact(F.array_distinct("chunks"))
    empty = F.array().cast("array<struct<tag:string,chunk:string,need:int,asks:boolean>>")

    def block(kind, parts, chunk=None, need=1, asks=None):
        """What pairs must share: a tag of parts, none of them null, with `need` chunks; at least one of the two asks for it."""
        tag = F.concat_ws("\u0001", F.lit(kind), *parts)
        made = F.struct(tag.alias("tag"), (chunk if chunk is not None else F.lit("")).cast("string").alias("chunk"), F.lit(need).alias("need"), (asks if asks is not None else F.lit(True)).alias("asks"))
        return F.when(reduce(lambda x, y: x & y, [p.isNotNull() for p in parts]), made)

    each = lambda values, of: F.coalesce(F.array_compact(F.transform(values, of)), empty)
    role_chunk = lambda kind, part, need: F.coalesce(F.flatten(F.transform("roles", lambda r: each(chunks, lambda c: block(kind, [part, r], c, need)))), empty)
    single = [block("n", [f["normalized"]]), block("st", [surname, title]), block("sg", [surname, given]), F.when(alone, block("tt", [title]))]
    several = [
        each("spoken", lambda v: block("v", [v])), each("roles", lambda r: block("sr", [surname, r])), each(chunks, lambda c: block("sc", [surname], c, 2)),
        each("roles", lambda r: block("tgr", [title, given, r])), each(chunks, lambda c: block("tgc", [title, given], c, 3)), role_chunk("trc", title, 4), role_chunk("grc", given, 5),
        each("roles", lambda r: block("ar", [title, r], asks=alone)), each(chunks, lambda c: block("ac", [title, c], asks=alone)),
    ]
    rows = own.select(key, "norm", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*single)), *several))).alias("b")).select(key, "norm", "b.*")
    x, y = rows.where("asks").alias("x"), rows.alias("y")
    met = x.join(y, [key, "tag", "chunk"]).where("x.norm < y.norm OR (x.norm > y.norm AND NOT y.asks)").groupBy(key, "tag", F.least("x.norm", "y.norm").alias("a"), F.greatest("x.norm", "y.norm").alias("b")).agg(F.count("*").alias("n"), F.max("x.need").alias("need"))
    asked = met.where("n >= need").select(key, "a", "b").distinct()
    facts = lambda n: own.select(key, F.col("norm").alias(n), F.struct("f", "chunks", "roles", "spoken").alias(f"_{n}"))
    pairs = asked.join(facts("a"), [key, "a"]).join(facts("b"), [key, "b"])
    x, y = F.col("_a"), F.col("_b")
    fx, fy = x["f"], y["f"]
    eq = lambda u, v: F.coalesce((u == v) & (u != ""), F.lit(False))
    common = F.size(F.array_intersect(x["chunks"], y["chunks"]))
    same_title = eq(fx["title"], fy["title"])
    points = [
        ("exact_normalized_match", fx["normalized"] == fy["normalized"], F.lit(100)),
        ("same_base_tokens_and_title", eq(fx["base"], fy["base"]) & fx["title"].eqNullSafe(fy["title"]), F.lit(95)),
        ("same_surname", eq(fx["surname"], fy["surname"]), F.lit(40)),
        ("same_title", same_title, F.lit(20)),
        ("same_given_name", eq(fx["given"], fy["given"]), F.lit(15)),
        ("generic_title_to_titled_name", fx["is_generic"] & same_title, F.lit(22)),
        ("generic_title_to_titled_name", fy["is_generic"] & same_title, F.lit(22)),
        ("chunk_overlap", common > 0, F.least(F.lit(20), common * 4)),
        ("role_overlap", F.arrays_overlap(x["roles"], y["roles"]), F.lit(12)),
        ("variant_overlap", F.arrays_overlap(x["spoken"], y["spoken"]), F.lit(50)),
    ]
    score = reduce(lambda p, q: p + q, [F.when(met, n).otherwise(0) for _, met, n in points])
    reasons = F.array_compact(F.array(*[F.when(met, reason) for reason, met, _ in points]))
    return pairs.select(key, "a", "b", score.alias("score"), reasons.alias("reasons")).where(F.col("score") >= least)


def clusters(people: DataFrame, pairs: DataFrame, key: str, least: int = 2, most: int = 8) -> DataFrame:
    """(key, group_no, member_no, norm, name): stars around seeds taken in natural order; used names are skipped, a group keeps its first `most` names.

    Names beyond `most`, a seed too, stay free and may seed or join a later group. The order decides, so a key's linked names are one fold
    that remembers the names used; with `least` below two, names without links are groups too.
    """
    place = F.struct(T.natural_key(F.col("name")).alias("n"), F.col("first").alias("first"))
    names = people.select(key, "norm", "name", place.alias("place"))
    edges = pairs.select(key, "a", "b").union(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    near = edges.join(names.withColumnRenamed("norm", "b"), [key, "b"]).groupBy(key, F.col("a").alias("norm")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("b").alias("norm"), "name"))).alias("near"))
    own = names.join(near, [key, "norm"], "inner" if least > 1 else "left")
    # The seed takes its own place among its neighbours, so that the fold has nothing to sort.
    seated = F.array_sort(F.concat(F.array(F.struct("place", "norm", "name")), F.coalesce("near", F.array().cast(near.schema["near"].dataType))))
    rows = own.select(key, "place", "norm", F.transform(seated, lambda r: F.struct(r["norm"].alias("norm"), r["name"].alias("name"))).alias("star"))

    def begin():
        used: set[str] = set()
        made = 0

        def step(row: dict):
            nonlocal made
            if row["norm"] in used:
                return
            group = [m for m in row["star"] if m["norm"] not in used]
            if len(group) >= least:
                for i, m in enumerate(group[:most]):
                    used.add(m["norm"])
                    yield row[key], made, i, m["norm"], m["name"]
                made += 1

        return step

    return folds.streamed(rows, [key], ["place"], begin, f"`{key}` {rows.schema[key].dataType.simpleString()}, group_no bigint, member_no int, norm string, name string")


def payloads(people: DataFrame, groups: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, group_no, payload): a group's members with what is known of them, as the JSON that an adjudicating model is asked with.

    pairing_reasons holds the reasons of all names that the group's pairs with its seed link; here of the members that are left.
    """
    f = F.col("f")
    member = F.struct("name", F.col("norm").alias("normalized"), f["title"].alias("title"), f["surname"].alias("surname"), f["given"].alias("given"), f["is_generic"].alias("is_generic"), "roles", "chunks", "variants", "accents", "sources")
    own = groups.join(people.drop("name", "first"), [key, "norm"])
    members = own.groupBy(key, "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_no", member.alias("m")))), lambda r: r["m"]).alias("members"))
    x, y = (groups.select(key, "group_no", F.col("norm").alias(n), F.col("name").alias(f"{n}_name")) for n in ("a", "b"))
    why = pairs.join(x, [key, "a"]).join(y, [key, "group_no", "b"]).select(key, "group_no", "a_name", "b_name", "score", "reasons")
    reasons = why.groupBy(key, "group_no").agg(F.array_sort(F.collect_list(F.struct("a_name", "b_name", "score", "reasons"))).alias("pairing_reasons"))
    group_id = F.concat(F.lit("group_"), T.padded(F.col("group_no"), 3))
    out = members.join(reasons, [key, "group_no"], "left").withColumn("group_id", group_id)
    return out.select(key, "group_no", F.to_json(F.struct("group_id", "members", "pairing_reasons")).alias("payload"))


ANSWER = "canonical_name string, merge boolean, confidence string, members_to_merge array<string>, members_to_keep_separate array<string>, reasons array<string>"


def adjudicated(people: DataFrame, groups: DataFrame, pairs: DataFrame, key: str, model) -> DataFrame:
    """(key, group_no, raw, error, canonical_name, merge, confidence, members_to_merge, members_to_keep_separate, reasons), one call of the model per group.

    model: a function payload -> text, run on the executors; SYSTEM holds what it is to be told. An answer that holds no JSON object gives an
    error and no merge. Where it names no canonical name, group_label's rule chooses one of the members.
    """
    asked = payloads(people, groups, pairs, key)

    def call(batches):
        for pdf in batches:
            out = []
            for payload in pdf["payload"]:
                try:
                    out.append((model(payload), None))
                except Exception as e:  # what a model client raises is unknown; the failure is the row's result
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pdf[[key, "group_no"]].assign(raw=[r for r, _ in out], error=[e for _, e in out])

    rows = asked.mapInPandas(call, f"`{key}` {asked.schema[key].dataType.simpleString()}, group_no bigint, raw string, error string")
    v = F.col("v")
    lists = [F.array_distinct(jsonx.strings(v, f"$.{x}")).alias(x) for x in ("members_to_merge", "members_to_keep_separate", "reasons")]
    answers = rows.withColumn("v", jsonx.recover(T.strip(F.col("raw")))).select(
        key, "group_no", "raw", F.coalesce("error", F.when(v.isNull(), "no JSON object in the answer")).alias("error"),
        F.nullif(T.strip(jsonx.string(v, "$.canonical_name")), F.lit("")).alias("named"), jsonx.truthy(v, "$.merge").alias("merge"),
        F.when(jsonx.get(v, "$.confidence").isNull(), "review").otherwise(jsonx.shown(jsonx.get(v, "$.confidence"))).alias("confidence"), *lists,
    )
    return canonical(answers, groups, key)


def canonical(answers: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """answers(key, group_no, named, ...) with canonical_name: the name given, else the member that group_label's rule chooses."""
    f = N.form(F.col("name"), N.RESOLVER_TITLES, N.RESOLVER_GENERIC)
    size = F.when(f["base"] == "", 0).otherwise(F.size(F.split(f["base"], " ")))
    rank = F.struct(f["title"].isNotNull().cast("int") + size, F.length("name"), -F.col("member_no"))
    label = groups.groupBy(key, "group_no").agg(F.max_by("name", rank).alias("_label"))
    return answers.join(label, [key, "group_no"], "left").withColumn("canonical_name", F.coalesce("named", "_label")).drop("named", "_label")


def flagged(answers: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """answers with not_members: of the names that an answer merges, those that are no member of its group by their normal form; they count all the same."""
    held = groups.groupBy(key, "group_no").agg(F.collect_set("norm").alias("_held"))
    strange = F.filter("members_to_merge", lambda m: ~F.coalesce(F.array_contains("_held", N.norm(m)), F.lit(False)))
    return answers.join(held, [key, "group_no"], "left").withColumn("not_members", F.coalesce(strange, F.array().cast("array<string>"))).drop("_held")


# What an adjudicating model is told, in short.
SYSTEM = """You decide which names in a group stand for one character of a book.
Answer with one JSON object: canonical_name, merge, confidence, members_to_merge, members_to_keep_separate, reasons.
Merge only names that the evidence ties together; keep the others separate."""


def resolution_map(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, norm, variant, canonical_name, confidence, reasons): of merged groups' variants the last written wins.

    responses: keys, group_no, merge, canonical_name, confidence, members_to_merge and, if known, reasons. Variants needn't be members of
    the group; an empty normal form is a key like any other.
    """
    why = F.col("reasons") if "reasons" in responses.columns else F.array().cast("array<string>")
    rows = responses.where("merge").select(*keys, "group_no", "canonical_name", "confidence", why.alias("reasons"), F.posexplode("members_to_merge").alias("i", "variant"))
    last = F.max_by(F.struct("variant", "canonical_name", "confidence", "reasons"), F.struct("group_no", "i"))
    return rows.withColumn("norm", N.norm(F.col("variant"))).where("norm IS NOT NULL").groupBy(*keys, "norm").agg(last.alias("r")).select(*keys, "norm", "r.*")


def resolved(names: DataFrame, variants: DataFrame, keys: list[str], name: str) -> DataFrame:
    """names with resolved: the canonical name of its variant, else the name itself. Spark broadcasts the map only below its size threshold."""
    own = names.withColumn("norm", N.norm(F.col(name)))
    return own.join(variants.select(*keys, "norm", "canonical_name"), [*keys, "norm"], "left").withColumn("resolved", F.coalesce("canonical_name", name)).drop("canonical_name", "norm")


def annotated(dossiers: DataFrame, variants: DataFrame, keys: list[str], surface: str = "variants", name: str = "canonical_name") -> DataFrame:
    """dossiers with resolved_name, resolution_confidence and resolution_reasons from the first of their surface variants that is mapped; else the name and nulls.

    dossiers need a column `group_no` that, with the keys, tells them apart.
    """
    ids = [*keys, "group_no"]
    each = dossiers.select(*ids, F.posexplode(surface).alias("i", "_v")).withColumn("norm", N.norm(F.col("_v")))
    why = F.col("reasons") if "reasons" in variants.columns else F.lit(None).cast("array<string>")
    known = variants.select(*keys, "norm", F.col("canonical_name").alias("_c"), "confidence", why.alias("_w"))
    first = each.join(known, [*keys, "norm"]).groupBy(*ids).agg(F.min_by(F.struct("_c", "confidence", "_w"), "i").alias("_r"))
    out = dossiers.join(first, ids, "left").withColumn("resolved_name", F.coalesce("_r._c", name))
    return out.withColumn("resolution_confidence", F.col("_r.confidence")).withColumn("resolution_reasons", F.col("_r._w")).drop("_r")


def resolution_report(groups: DataFrame, responses: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key: candidate groups, groups with an answer, merged groups and mapped variants."""
    asked = groups.groupBy(*keys).agg(F.countDistinct("group_no").alias("n_groups"))
    got = responses.groupBy(*keys).agg(F.countDistinct("group_no").alias("n_resolved"), F.countDistinct(F.when(F.col("merge"), F.col("group_no"))).alias("n_merged"))
    mapped = variants.groupBy(*keys).agg(F.count("*").alias("n_variants"))
    return asked.join(got, keys, "left").join(mapped, keys, "left").na.fill(0, ["n_resolved", "n_merged", "n_variants"])
