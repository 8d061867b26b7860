"""Model passes over chunks: structure, dialogue, entities and dossiers, with retries, and the merge of their outputs per book.

A model is a function (pass, prompt, idle_seconds) -> text. It runs on the executors and may be any client; rules() needs none. Chunks
are independent and a chunk's passes follow one another, so the passes are one map without a shuffle.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.functions import jsonx
from foliospark.functions import text as T
from foliospark.operators import jobs, merge
from foliospark.storage import kept

Model = Callable[[str, str, float], str]
OUTPUT = "pass string, raw string, doc string, seconds double, attempts int, error string"
#: So many characters of answers a task holds before it passes them on.
HELD = 8_000_000


def parsed(raw: str):
    """The JSON value that a model's answer is, else the object between its first { and its last }."""
    try:
        return json.loads(raw)
    except ValueError:
        a, b = raw.find("{"), raw.rfind("}")
        if a < 0 or b < a:
            raise
        return json.loads(raw[a : b + 1])


def idle_seconds(base: float, backoff: float, failures: int, most: float) -> int:
    return int(min(most, max(1, round(base * backoff**failures))))


def dossier_prompt(text: str, entities: dict, dialogue: dict) -> str:
    found = {"characters": entities.get("characters", []), "dialogue_info": dialogue}
    return f"EXCERPT:\n{text.strip()}\n\nEXTRACTION_DATA:\n{json.dumps(found, indent=2, ensure_ascii=False)}\n"


def attempted(model: Model, name: str, prompt: str, retries: int, idle: float, backoff: float, most: float, pause: float) -> tuple:
    """(raw, value, seconds of the last attempt, attempts, error). Only a TimeoutError makes the next attempt wait longer."""
    idles, raw, seconds, error = 0, None, 0.0, None
    for attempt in range(1, retries + 2):
        began = time.monotonic()
        try:
            raw = model(name, prompt, idle_seconds(idle, backoff, idles, most))
            value = parsed(raw)
            return raw, value, time.monotonic() - began, attempt, None
        except Exception as e:  # what a model client raises is unknown; the failure is the row's result
            idles += isinstance(e, TimeoutError)
            seconds, error = time.monotonic() - began, f"{type(e).__name__}: {e}"
        if attempt <= retries:
            time.sleep(pause)
    return raw, None, seconds, retries + 1, error


def run(
    chunks: DataFrame, model: Model, keys: list[str], text: str = "text", passes: tuple = jobs.PASSES,
    retries: int = 1, idle: float = 180, backoff: float = 1.5, most: float = 600, pause: float = 0.5, stop: bool = False,
) -> DataFrame:
    """(keys, pass, raw, doc, seconds, attempts, error), a row for each pass that was tried.

    After a pass has failed in all its attempts, the chunk's later passes are left out; with `stop` the job fails instead. Null texts are
    empty excerpts. `doc` is the JSON of the answer. A lost task asks the model again for its chunks: write the rows, then use resumed().
    """

    found = to_arrow_schema(StructType.fromDDL(OUTPUT))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0
            for i, body in enumerate(batch.column(len(keys)).to_pylist()):
                values = {}
                for name in passes:
                    excerpt = body or ""
                    known = [v if isinstance(v := values.get(p), dict) else {} for p in ("entities", "dialogue")]
                    prompt = dossier_prompt(excerpt, *known) if name == "dossiers" else excerpt
                    raw, values[name], seconds, tries, error = attempted(model, name, prompt, retries, idle, backoff, most, pause)
                    doc = None if error else json.dumps(values[name], ensure_ascii=False)
                    rows.append((name, raw, doc, seconds, tries, error))
                    at.append(i)
                    held += len(raw or "") + len(doc or "")
                    if error and stop:
                        raise RuntimeError(f"pass {name} of {[c[i].as_py() for c in batch.columns[:-1]]}: {error}")
                    if error:
                        break
                if held >= HELD:
                    yield _tried(batch, keys, at, rows, found)
                    at, rows, held = [], [], 0
            if rows:
                yield _tried(batch, keys, at, rows, found)

    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return chunks.select(*keys, text).mapInArrow(each, f"{kinds}, {OUTPUT}")


def _tried(batch: pa.RecordBatch, keys: list[str], at: list[int], rows: list[tuple], found: pa.Schema) -> pa.RecordBatch:
    """Tried passes of the chunks `at` places of a batch; a table for each chunk alone would cost more than the passes by rules."""
    own = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), found, strict=True)]
    return pa.RecordBatch.from_arrays(own + columns, names=[*keys, *found.names])


def resumed(chunks: DataFrame, written: DataFrame, keys: list[str], passes: tuple = jobs.PASSES) -> DataFrame:
    """Chunks without a good output of every pass. Chunks with a null key are always open."""
    done = written.where("error IS NULL").where(F.col("pass").isin(*passes)).groupBy(*keys).agg(F.countDistinct("pass").alias("_n")).where(F.col("_n") == len(passes))
    return chunks.join(done, keys, "left_anti")


def timings(written: DataFrame, keys: list[str], passes: tuple = jobs.PASSES) -> DataFrame:
    """(keys, total_seconds, passes map) of the chunks whose passes all succeeded."""
    good = written.where("error IS NULL")
    got = good.groupBy(*keys).agg(F.sum("seconds").alias("total_seconds"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("pass", "seconds")))).alias("passes"), F.countDistinct("pass").alias("_n"))
    return got.where(F.col("_n") == len(passes)).drop("_n")


SPEAKER = re.compile(r'[,.!?]"\s+(?:said|asked|cried|replied|answered)\s+((?:the\s+)?\w+(?:\s+[A-Z]\w+)?)|([A-Z]\w+)\s+(?:said|asked|cried|replied|answered)\b')
NAME = re.compile(r"(?<![.!?]\s)(?<!^)(?<![\"\n])\b(?:(?:Mr|Mrs|Dr|Capt)\.\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*")


def rules(name: str, prompt: str, idle: float = 0) -> str:
    """A model of plain rules, so that the whole flow runs without one. Its findings are rough and always the same."""
    lines = [x.strip() for x in prompt.split("\n")]
    if name == "structure":
        found = {"chapters": r"chapter\s+[ivxlcdm0-9]+\b", "parts": r"part\s+(?:[ivxlcdm0-9]+|one|two|three|four|five|six)\b", "scene_breaks": r"(?:\* ?\* ?\*|- - -)$"}
        return json.dumps({k: [x for x in lines if re.match(p, x, re.I)] for k, p in found.items()} | {"status": ""})
    if name == "dialogue":
        quotes = len(re.findall(r'"[^"\n]+"', prompt))
        speakers = [a or b for a, b in SPEAKER.findall(prompt)]
        narration = re.sub(r'"[^"\n]*"', " ", prompt)
        pov = "first-person" if re.search(r"\b(?:I|my|we)\b", narration) else "third-person" if re.search(r"\b(?:he|she|they)\b", narration, re.I) else "unknown"
        return json.dumps({"pov": pov, "dialogue": quotes > 0, "internal_thought": False, "explicitly_attributed_speakers": list(dict.fromkeys(speakers)), "unattributed_dialogue_present": quotes > len(speakers)})
    if name == "entities":
        return json.dumps({"characters": list(dict.fromkeys(NAME.findall(prompt))), "places": [], "objects": [], "identity_notes": []})
    characters = json.loads(prompt.rpartition("EXTRACTION_DATA:\n")[2])["characters"]
    return json.dumps({"character_dossiers": [{"name": c, "aliases": [], "roles": [], "biography": "", "personality_traits": []} for c in characters]})


def _docs(outputs: DataFrame, name: str) -> DataFrame:
    return outputs.where(F.col("pass") == name).withColumn("v", jsonx.whole(F.col("doc")))


def place_of(pos: Column, *more: Column) -> Column:
    """The order of (pos, more...) as one decimal, missing places first; more: one or two numbers below 10^9, none negative. A least decimal is found by a hash aggregate, a least struct only by sorting all rows."""
    at = F.coalesce(pos.cast("bigint"), F.lit(-(2**63))).cast("decimal(19,0)")
    for x in more:
        at = (at * F.lit(10**9) + x).cast("decimal(38,0)")
    return at


def _in_order(rows: DataFrame, book: str, keys: list[str], value: str = "value", identity: str | None = None, at: Column | None = None) -> DataFrame:
    """Values of rows(book, keys, pos, i, value) as one list per key, each once by its identity, in the order of their first appearance.

    at: their order, if it isn't (pos, i). identity: a column of what jsonx.identity() gives where value is what shown() does.
    """
    at = place_of(F.col("pos"), F.col("i")) if at is None else at
    own = rows.select(book, *keys, F.col(identity or value).alias("_id"), at.alias("_at"), F.coalesce((F.col(value) != F.col(identity or value)).cast("int"), F.lit(0)).alias("_other"))
    # The value is not carried along: whether it is spelt as its identity is the order's last digit.
    first = own.groupBy(book, *keys, "_id").agg(F.min((F.col("_at") * 2 + F.col("_other")).cast("decimal(38,0)")).alias("_f"))
    shown = F.when(F.col("_f") % 2 == 0, F.col("_id")).otherwise(jsonx.shown_as(F.col("_id")))
    return first.select(book, *keys, "_f", shown.alias("_v")).groupBy(book, *keys).agg(merge.in_order("_v", "_f").alias("values"))


def _either(new: str, old: str, take):
    """take() of the newer key, or of the older one where the newer holds nothing, an empty list included."""
    v = F.col("v")
    return F.when(jsonx.truthy(v, f"$.{new}"), take(v, f"$.{new}")).otherwise(take(v, f"$.{old}"))


def structure_chunks(outputs: DataFrame, book: str) -> DataFrame:
    """(book, pos, chapters, parts, scene_breaks, status) of each chunk's structure pass: values that aren't strings as JSON, status an empty text where there is none."""
    shown = lambda v, path: F.transform(jsonx.items(v, path), jsonx.shown)
    status = F.coalesce(jsonx.shown(jsonx.get(F.col("v"), "$.status")), F.lit(""))
    return _docs(outputs, "structure").select(book, "pos", _either("chapters", "chapter_titles", shown).alias("chapters"), _either("parts", "part_divisions", shown).alias("parts"), shown(F.col("v"), "$.scene_breaks").alias("scene_breaks"), status.alias("status"))


def structure_merge(outputs: DataFrame, book: str) -> DataFrame:
    """(book, kind, values): chapters, parts and scene breaks of a book in order, from outputs(book, pos, pass, doc).

    Chapters and parts are strings; scene breaks may be any JSON value, then shown as JSON.
    """
    texts = lambda v, path: F.transform(jsonx.strings(v, path), lambda s: F.struct(s.alias("value"), s.alias("id")))
    any_ = lambda v, path: F.transform(jsonx.items(v, path), lambda x: F.struct(jsonx.shown(x).alias("value"), jsonx.identity(x).alias("id")))
    found = (("chapters", _either("chapters", "chapter_titles", texts)), ("parts", _either("parts", "part_divisions", texts)), ("scene_breaks", any_(F.col("v"), "$.scene_breaks")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("found")) for k, c in found])
    rows = _docs(outputs, "structure").select(book, "pos", F.inline(kinds)).select(book, "kind", "pos", F.posexplode("found").alias("i", "x")).select(book, "kind", "pos", "i", "x.value", "x.id")
    return _in_order(rows, book, ["kind"], identity="id")


def dialogue_chunks(outputs: DataFrame, book: str) -> DataFrame:
    """(book, pos, pov, dialogue, internal_thought, explicitly_attributed_speakers, unattributed_dialogue_present) of each chunk's dialogue pass."""
    v = F.col("v")
    flags = [jsonx.truthy(v, f"$.{k}").alias(k) for k in ("dialogue", "internal_thought", "unattributed_dialogue_present")]
    speakers = F.transform(jsonx.items(v, "$.explicitly_attributed_speakers"), jsonx.shown)
    return _docs(outputs, "dialogue").select(book, "pos", jsonx.shown(jsonx.get(v, "$.pov")).alias("pov"), flags[0], flags[1], speakers.alias("explicitly_attributed_speakers"), flags[2])


def dialogue_merge(outputs: DataFrame, book: str) -> DataFrame:
    """A row per book: counts of chunks, points of view with the most frequent one (first seen on ties), and speakers in order. Only strings are views or speakers; flags count as in truthy()."""
    rows = _docs(outputs, "dialogue")
    true = lambda k: F.count_if(jsonx.truthy(F.col("v"), f"$.{k}"))
    counts = rows.groupBy(book).agg(
        true("dialogue").alias("dialogue_present_in_chunks"),
        true("internal_thought").alias("internal_thought_present_in_chunks"),
        true("unattributed_dialogue_present").alias("unattributed_dialogue_present_in_chunks"),
    )
    pov = rows.select(book, "pos", F.lit(0).alias("i"), jsonx.string(F.col("v"), "$.pov").alias("value")).where("value <> ''")
    speakers = rows.select(book, "pos", F.posexplode(jsonx.strings(F.col("v"), "$.explicitly_attributed_speakers")).alias("i", "value"))
    empty = F.array().cast("array<string>")
    out = counts.join(merge.dominant(pov, [book], "value", F.col("pos")).withColumnRenamed("dominant", "dominant_pov"), book, "left")
    for name, part in (("observed_pov_values", pov), ("explicitly_attributed_speakers", speakers)):
        out = out.join(_in_order(part, book, []).withColumnRenamed("values", name), book, "left").withColumn(name, F.coalesce(name, empty))
    return out


ENTITY_KINDS = ("characters", "places", "objects", "identity_notes")


def entity_mentions(outputs: DataFrame, book: str, kinds: tuple = ENTITY_KINDS) -> DataFrame:
    """(book, kind, pos, i, value) of the entity lists; merge.entity_merge() groups them."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), jsonx.strings(F.col("v"), f"$.{k}").alias("found")) for k in kinds])
    return _docs(outputs, "entities").select(book, "pos", F.inline(each)).select(book, "kind", "pos", F.posexplode("found").alias("i", "value"))


def entity_lists(outputs: DataFrame, book: str) -> DataFrame:
    """(book, kind, values): the exact names of each kind, each once in the order of their first appearance."""
    return _in_order(entity_mentions(outputs, book), book, ["kind"])


# Single and list attributes of a dossier and the lists of a merged dossier that they go to.
SINGLE = {"role": "roles", "biography": "biographies", "vocal_notes": "vocal_notes", "accent": "accents", "identity_status": "identity_status_values"}
LISTED = {"aliases": "aliases", "roles": "roles", "personality_traits": "personality_traits"}
MERGED = ("variants", "aliases", "roles", "biographies", "personality_traits", "vocal_notes", "accents", "spoken_dialogue_values", "identity_status_values")


#: Places in a book count chunks by this step; a chunk has far fewer dossiers, so this keeps the order without a window over the book.
PLACES = 1_000_000


def chunk_of(pos: Column) -> Column:
    """The chunk of a dossier's place in its book."""
    return F.floor(pos / PLACES).cast("int")


def dossier_rows(outputs: DataFrame, book: str) -> DataFrame:
    """(book, chunk, pos, name, aliases, roles, v): the dossiers with a name that is a text, pos counting over the book's chunks in order.

    The older key counts if the newer holds no list; what isn't an object is no dossier, and what isn't a string no alias or role.
    """
    found = F.coalesce(F.try_variant_get("v", "$.character_dossiers", "array<variant>"), F.try_variant_get("v", "$.dossiers", "array<variant>"))
    rows = _docs(outputs, "dossiers").select(book, F.col("pos").alias("chunk"), F.posexplode(found).alias("i", "v"))
    named = rows.where(jsonx.kind(F.col("v")).startswith("OBJECT")).withColumn("name", jsonx.string(F.col("v"), "$.name")).where(T.strip(F.col("name")) != "")
    v = F.col("v")
    roles = F.array_distinct(F.filter(F.concat(F.array(T.strip(jsonx.string(v, "$.role"))), jsonx.trimmed_strings(v, "$.roles")), lambda r: r.isNotNull() & (r != "")))
    return named.select(book, "chunk", (F.col("chunk").cast("bigint") * PLACES + F.col("i")).alias("pos"), "name", jsonx.trimmed_strings(v, "$.aliases").alias("aliases"), roles.alias("roles"), "v")


def dossier_values(dossiers: DataFrame, book: str) -> DataFrame:
    """(book, pos, name, aliases, roles, told, spoken) of dossier_rows(): all that their merge reads, plain texts and lists, so that it may be written once and no JSON read again.

    told: the SINGLE attributes that are texts and the LISTED ones as they are listed. spoken: how a spoken_dialogue is shown, and its identity.
    """
    v = F.col("v")
    told = [jsonx.string(v, f"$.{a}").alias(f"one_{a}") for a in SINGLE] + [jsonx.strings(v, f"$.{a}").alias(f"all_{a}") for a in LISTED]
    spoken = jsonx.get(v, "$.spoken_dialogue")
    said = F.when(jsonx.kind(spoken) != "VOID", F.struct(jsonx.shown(spoken).alias("value"), jsonx.identity(spoken).alias("id")))
    return dossiers.select(book, "pos", "name", "aliases", "roles", F.struct(*told).alias("told"), said.alias("spoken"))


def entity_chunks(outputs: DataFrame, book: str, kinds: tuple = ENTITY_KINDS) -> DataFrame:
    """(book, pos, kinds): the lists of each chunk's entities pass as they are, VARIANTs; an empty one for anything that is no list."""
    return _docs(outputs, "entities").select(book, "pos", *[jsonx.items(F.col("v"), f"$.{k}").alias(k) for k in kinds])


def dossier_chunks(outputs: DataFrame, book: str) -> DataFrame:
    """(book, pos, character_dossiers): the objects in each chunk's list of dossiers, the older key's if the newer holds no list."""
    found = F.coalesce(F.try_variant_get("v", "$.character_dossiers", "array<variant>"), F.try_variant_get("v", "$.dossiers", "array<variant>"), F.array().cast("array<variant>"))
    return _docs(outputs, "dossiers").select(book, "pos", F.filter(found, lambda x: jsonx.kind(x).startswith("OBJECT")).alias("character_dossiers"))


def timing_chunks(outputs: DataFrame, book: str) -> DataFrame:
    """(book, pos, total_duration_seconds, passes): what each chunk's timing says, VARIANTs; passes is an empty object where it is none."""
    passes_ = jsonx.get(F.col("v"), "$.passes")
    own = F.when(jsonx.kind(passes_).startswith("OBJECT"), passes_).otherwise(F.parse_json(F.lit("{}")))
    return _docs(outputs, "timing").select(book, "pos", jsonx.get(F.col("v"), "$.total_duration_seconds").alias("total_duration_seconds"), own.alias("passes"))


def dossier_merge(outputs: DataFrame, book: str, notes: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """A row per book and group of dossiers of one character.

    (book, group_no, place, canonical_name, surface_variants, chunks, n_dossiers, merge_confidence, merge_reasons, source_dossiers, MERGED):
    lists hold each value once and in order, surface variants all names before all aliases; place numbers a book's groups by the natural order
    of their names. An attribute of another type than the one meant is left out. notes, said: resolver_notes() and dossier_values() of the outputs, if they are at hand.

    What the dossiers say, the notes, one fold of each book, and the groups' lists are used several times and written once.
    """
    own = dossier_rows(outputs, book)
    said = kept(dossier_values(own, book), "dossier-values") if said is None else said
    notes = kept(resolver_notes(said, book), "notes") if notes is None else notes
    grouped = notes.select(book, "pos", "group_no")
    members = said.join(grouped, [book, "pos"])
    keys = [book, "group_no"]

    def entry(to, rank, values, ids=None):
        pairs = F.transform(values, lambda x: F.struct(x.alias("value"), x.alias("id"))) if ids is None else F.arrays_zip(values.alias("value"), ids.alias("id"))
        return F.struct(F.lit(to).alias("attribute"), F.lit(rank).alias("rank"), pairs.cast("array<struct<value:string,id:string>>").alias("found"))

    one = lambda c: F.array_compact(F.array(F.nullif(c, F.lit(""))))
    lists = [entry("variants", 0, F.array("name")), entry("names", 0, F.array("name")), entry("names", 1, F.col("aliases"))]
    lists += [entry(to, 0, one(F.col(f"told.one_{a}"))) for a, to in SINGLE.items()]
    lists += [entry(to, 1, F.col(f"told.all_{a}")) for a, to in LISTED.items()]
    lists += [F.struct(F.lit("spoken_dialogue_values").alias("attribute"), F.lit(0).alias("rank"), F.when(F.col("spoken").isNotNull(), F.array("spoken")).alias("found"))]
    flat = members.select(*keys, "pos", F.inline(F.array(*lists))).select(*keys, "attribute", "pos", "rank", F.posexplode("found").alias("i", "x")).select(*keys, "attribute", "pos", "rank", "i", "x.value", "x.id")
    # A place counts its rank before its number in a list; of a group's surface variants the names of all members come before their aliases.
    ranked = place_of(F.col("pos"), F.col("rank").cast("bigint") * 10**8 + F.col("i"))
    at = F.when(F.col("attribute") == "names", ranked + F.col("rank") * F.lit(Decimal(10) ** 32)).otherwise(ranked)
    found = _in_order(flat, book, ["group_no", "attribute"], identity="id", at=at.cast("decimal(37,0)")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "values")))).alias("attributes"))
    by_name = kept(found, "dossier-lists")
    empty = F.array().cast("array<string>")
    values = by_name.select(*keys, *[F.coalesce(F.try_element_at("attributes", F.lit(a)), empty).alias(to) for a, to in (("names", "surface_variants"), *((m, m) for m in MERGED))])
    # Places are numbered on the names alone, so that a book's lists and dossiers never meet in one task.
    label = merge.group_label(notes, keys).withColumnRenamed("label", "canonical_name")
    label = label.withColumn("place", F.row_number().over(W.partitionBy(book).orderBy(T.natural_key(F.col("canonical_name")), "group_no")) - 1)
    chunk = F.expr(f"(pos - pmod(pos, {PLACES})) div {PLACES}").cast(own.schema["chunk"].dataType)
    chunks = notes.groupBy(*keys).agg(F.array_sort(F.collect_set(chunk)).alias("chunks"), F.count("*").alias("n_dossiers"))
    source = own.join(grouped, [book, "pos"]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk", F.to_json("v").alias("dossier")))), lambda r: F.struct(r["chunk"].alias("chunk"), r["dossier"].alias("dossier"))).alias("source_dossiers"))
    known = merge.group_confidence(values.select(*keys, "surface_variants"), notes, book)
    # Every group has sources; by a left join they are not computed where nobody asks for them.
    out = label.join(values, keys).join(chunks, keys).join(source, keys, "left").join(known, keys)
    return out.select(*keys, "canonical_name", "surface_variants", *MERGED, "chunks", "n_dossiers", "source_dossiers", "merge_confidence", "merge_reasons", "place")


def resolver_notes(dossiers: DataFrame, book: str) -> DataFrame:
    """merge.first_fit of dossier_rows() or dossier_values(): a row per dossier with its group; those with a target are the notes on why it joined."""
    return merge.first_fit(dossiers.select(book, "pos", "name", "roles"), book)


def conflict_report(book: str, dossiers: DataFrame, entities: DataFrame, dialogue: DataFrame, statuses: DataFrame) -> DataFrame:
    """(book, scope, place, name, kind, type, severity, values, variants, surface_variants, chunks, merge_confidence, message).

    scope character: attributes of a merged dossier with several values. scope entity: a kind's normal forms with several
    surface variants. scope global: several points of view, or several non-blank structure statuses. dossiers: dossier_merge();
    entities: merge.entity_merge() by book and kind; dialogue: dialogue_merge(); statuses: structure_chunks().
    """
    c = F.col
    # A group's lists lie in its row, distinct and in order, so its conflicts are found there: no join of the dossiers with themselves.
    told = lambda a: F.array_distinct(F.filter(F.transform(a, T.strip), lambda x: x != ""))
    each = F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(n).alias("over"), told(a).alias("values")) for a, t, s, n in merge.CONFLICTS]))
    facts = dossiers.select(book, "place", c("canonical_name").alias("name"), "variants", "surface_variants", c("chunks").cast("array<string>").alias("chunks"), "merge_confidence", each).where(F.size("values") > c("over"))
    message = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), c("type"))
    people = facts.select(book, F.lit("character").alias("scope"), "place", "name", F.lit(None).cast("string").alias("kind"), "type", "severity", "values", "variants", "surface_variants", "chunks", "merge_confidence", F.concat(message, F.lit(" observed for "), "name", F.lit(".")).alias("message"))
    none = {"variants": "array<string>", "surface_variants": "array<string>", "chunks": "array<string>", "merge_confidence": "string", "kind": "string", "name": "string", "place": "int", "severity": "string"}

    def rows(df, **cols):
        got = {x: cols.get(x, F.lit(None).cast(none[x]) if x in none else None) for x in people.columns[1:]}
        return df.select(book, *[v.alias(k) for k, v in got.items()])

    varied = entities.where(F.size("variants") > 1)
    order = F.row_number().over(W.partitionBy(book, "kind").orderBy(T.natural_key(c("canonical")), "norm")) - 1
    forms = rows(varied.withColumn("_n", order), scope=F.lit("entity"), place=c("_n"), name=c("canonical"), kind=c("kind"), type=F.lit("entity_variants"), values=c("variants"), variants=c("variants"), chunks=c("chunks").cast("array<string>"), message=F.concat(F.lit("Multiple surface variants map to "), "canonical", F.lit(".")))
    views = rows(dialogue.where(F.size("observed_pov_values") > 1), scope=F.lit("global"), place=F.lit(0), type=F.lit("multiple_pov_values"), severity=F.lit("medium"), values=c("observed_pov_values"), message=F.lit("Multiple POV values were observed across chunks."))
    stated = _in_order(statuses.select(book, "pos", F.lit(0).alias("i"), T.strip(c("status")).alias("value")).where("value <> ''"), book, []).where(F.size("values") > 1)
    states = rows(stated, scope=F.lit("global"), place=F.lit(1), type=F.lit("structure_status_variation"), severity=F.lit("low"), values=c("values"), message=F.lit("Multiple structure status values were observed across chunks."))
    return reduce(DataFrame.unionByName, [people, forms, views, states])


# What a conflict's message begins with.
MESSAGES = {
    "role_conflict": "Multiple roles", "accent_conflict": "Multiple accent recommendations", "spoken_dialogue_conflict": "Conflicting spoken_dialogue values",
    "identity_status_conflict": "Multiple identity_status values", "vocal_notes_drift": "Many vocal note variants",
}


def conflict_summary(report: DataFrame, books: DataFrame, book: str) -> DataFrame:
    """(book, character_conflict_count, entity_variant_note_count, global_conflict_count): characters with conflicts, forms with variants, global ones; zeros for the other books."""
    scope = F.col("scope")
    got = report.groupBy(book).agg(
        F.countDistinct(F.when(scope == "character", F.col("place"))).alias("character_conflict_count"), F.count_if(scope == "entity").alias("entity_variant_note_count"), F.count_if(scope == "global").alias("global_conflict_count")
    )
    return books.select(book).distinct().join(got, book, "left").na.fill(0)


def merge_report(book: str, chunks: DataFrame, outputs: DataFrame, dossiers: DataFrame) -> DataFrame:
    """(book, chunk_count, present_counts map, missing map of ids, resolver_merge_count). chunks: (book, chunk_id); outputs: (book, chunk_id, pass) that exist, malformed ones too."""
    each = merge.completeness(chunks, outputs, PASS_FILES, "chunk_id", [book])
    counts = each.groupBy(book).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("present") > 0, F.struct("pass", "present"))))).alias("present_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.struct("pass", "missing_ids"))))).alias("missing"),
    )
    merged = dossiers.groupBy(book).agg(F.count_if(F.size("surface_variants") > 1).alias("resolver_merge_count"))
    n = chunks.groupBy(book).agg(F.countDistinct("chunk_id").alias("chunk_count"))
    return n.join(counts, book).join(merged, book, "left").na.fill(0, ["resolver_merge_count"]).select(book, "chunk_count", "present_counts", "missing", "resolver_merge_count")


#: The outputs of a chunk that is complete.
PASS_FILES = (*jobs.PASSES, "timing")


def chunk_summary(outputs: DataFrame, book: str, chunk: str = "chunk_id") -> DataFrame:
    """(book, chunk, passes_completed, STRUCTURE, DIALOGUE, ENTITIES lists, n_characters, n_dossiers, timing, line) of chunks that have any result.

    outputs: (book, chunk, pass, doc), doc null where it can't be parsed. One pivot by pass; lists keep only what is there, as JSON.
    """
    passes = F.col("pass")
    docs = {p: F.first(F.when(passes == p, jsonx.whole(F.col("doc"))), ignorenulls=True).alias(p) for p in PASS_FILES}
    wide = outputs.groupBy(book, chunk).agg(*docs.values())
    done = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), p) for p in jobs.PASSES]))
    shown = lambda p, k: jsonx.shown(jsonx.get(F.col(p), f"$.{k}")).alias(k)
    listed = lambda p, k: F.transform(jsonx.items(F.col(p), f"$.{k}"), jsonx.shown).alias(k)
    lists = [listed("structure", k) for k in ("chapters", "parts", "scene_breaks")] + [listed("dialogue", "explicitly_attributed_speakers")] + [listed("entities", k) for k in ENTITY_KINDS] + [listed("dossiers", "character_dossiers")]
    singles = [shown("structure", "status")] + [shown("dialogue", k) for k in ("pov", "dialogue", "internal_thought", "unattributed_dialogue_present")]
    got = wide.select(book, chunk, done.alias("passes_completed"), *lists, *singles, F.to_json("timing").alias("timing"))
    size = F.size
    line = F.concat_ws(" | ", F.col(chunk).cast("string"), F.concat(size("passes_completed").cast("string"), F.lit("/4 passes")), F.concat(size("characters").cast("string"), F.lit(" characters")), F.concat(size("character_dossiers").cast("string"), F.lit(" dossiers")))
    any_ = (size("passes_completed") > 0) | (F.coalesce("timing", F.lit("{}")) != "{}")
    return got.where(any_).withColumn("line", line)


def tokens_estimate(text: Column, seconds: Column, reported: Column) -> Column:
    """The rate that a runtime reports, else words per second of what it has written, over a millisecond at least."""
    return F.coalesce(reported, T.word_count(text) / F.greatest(seconds, F.lit(0.001)))


def sliced(chunks: DataFrame, name: str, start_at: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks in the plain order of their names, from the first called start_at, with or without its ending, on (none if there is none); `limit` of them at most."""
    own = chunks
    if start_at:
        stem = F.regexp_replace(F.col(name), r"(?<=[^.])\.[^.]*$", "")
        there = chunks.where((F.col(name) == start_at) | (stem == start_at)).agg(F.min(name).alias("_s"))
        own = chunks.join(F.broadcast(there), F.col(name) >= F.col("_s")).drop("_s")
    own = own.orderBy(name)
    return own if limit is None else own.limit(limit)
