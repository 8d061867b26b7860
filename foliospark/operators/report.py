"""Tables of a book report and their Markdown, for any number of books at once.

Reports are (book, section, section_no, row_no, label, cell). Empty cells are a dash; long ones are cut with an ellipsis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.jobs import PASSES
from foliospark.operators.merge import CONFLICTS

# Caps of the report's tables and the widths of its cells.
MOST_ENTITIES, MOST_CONFLICTS, MOST_NOTES, CELL, BIOGRAPHY, TITLE, VALUE, NAMES, NOTE = 40, 60, 20, 220, 1000, 180, 160, 120, 110
DOSSIER_FIELDS = ("variants", "aliases", "roles", "personality_traits", "accents", "vocal_notes", "spoken_dialogue_values", "identity_status_values", "chunks")


def cell(c: Column, most: int = CELL) -> Column:
    return T.or_dash(T.truncate(c, most))


def joined(values: Column, most: int = CELL) -> Column:
    return cell(F.array_join(values, ", "), most)


def section(rows: DataFrame, book: str, no: int, name: str, order: list, label: Column, value: Column, most: int | None = None) -> DataFrame:
    """A table of the report, rows numbered from 1 per book, the first `most` of them."""
    numbered = rows.withColumn("_no", F.row_number().over(W.partitionBy(book).orderBy(*order)))
    kept = numbered if most is None else numbered.where(F.col("_no") <= most)
    return kept.select(book, F.lit(no).alias("section_no"), F.lit(name).alias("section"), F.col("_no").alias("row_no"), label.cast("string").alias("label"), value.cast("string").alias("cell"))


def fields(rows: DataFrame, book: str, no: int, name: str, pairs: list[tuple[str, Column]]) -> DataFrame:
    """A table of one row per (label, value) from a table of one row per book."""
    each = F.posexplode(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("cell")) for k, v in pairs]))
    got = rows.select(book, each.alias("i", "p"))
    return got.select(book, F.lit(no).alias("section_no"), F.lit(name).alias("section"), (F.col("i") + 1).alias("row_no"), "p.label", cell(F.col("p.cell")).alias("cell"))


def book_report(book: str, chunks: DataFrame, structure: DataFrame, dialogue: DataFrame, entities: DataFrame, dossiers: DataFrame, conflicts: DataFrame, names: DataFrame | None = None, merged: DataFrame | None = None, timing: DataFrame | None = None) -> DataFrame:
    """All tables of the books in `chunks`(book, ...).

    The other inputs are what passes.structure_merge, dialogue_merge, merge.entity_merge (with `kind`), passes.dossier_merge and
    conflict_report return and, for their tables, passes.entity_lists (names), merge_report (merged) and merge.timing_summary (timing).
    """
    c = F.col
    size = lambda kind: F.coalesce(F.max(F.when(c("kind") == kind, F.size("values"))), F.lit(0))
    counts = structure.groupBy(book).agg(size("chapters").alias("n_chapters"), size("parts").alias("n_parts"), size("scene_breaks").alias("n_breaks"))
    n_chunks = chunks.groupBy(book).agg(F.count("*").alias("n_chunks"))
    n_people = entities.where("kind = 'characters'").groupBy(book).agg(F.sum(F.size("variants")).alias("n_characters"))
    n_dossiers = dossiers.groupBy(book).agg(F.count("*").alias("n_dossiers"))
    scope = c("scope")
    n_conflicts = conflicts.groupBy(book).agg(F.countDistinct(F.when(scope == "character", c("place"))).alias("n_people"), F.count_if(scope == "entity").alias("n_forms"), F.count_if(scope == "global").alias("n_global"))
    base = reduce(lambda a, b: a.join(b, book, "left"), [n_chunks, counts, n_people, n_dossiers, dialogue, n_conflicts])
    n = lambda k: F.coalesce(c(k), F.lit(0))
    out = [
        fields(base, book, 1, "Summary", [("Chunks merged", n("n_chunks")), ("Dominant POV", c("dominant_pov")), ("Chapters", n("n_chapters")), ("Characters", n("n_characters")), ("Merged dossiers", n("n_dossiers"))]),
        fields(base, book, 3, "Structure", [("Chapters detected", n("n_chapters")), ("Parts detected", n("n_parts")), ("Scene breaks recorded", n("n_breaks"))]),
    ]
    if timing is not None:
        total = F.struct(F.lit("Book total duration (s)").alias("label"), c("total_seconds").alias("s"))
        each = F.transform(F.map_entries("passes"), lambda e: F.struct(F.concat(F.lit("Total "), e["key"], F.lit(" duration (s)")).alias("label"), e["value"].alias("s")))
        rows = timing.select(book, F.posexplode(F.concat(F.array(total), each)).alias("i", "r"))
        out.append(section(rows, book, 2, "Timing", ["i"], c("r.label"), c("r.s")))
    heads = structure.select(book, "kind", F.posexplode("values").alias("i", "value"))
    out += [section(heads.where(c("kind") == kind), book, no, title, ["i"], c("_no"), cell(c("value"), TITLE)) for no, kind, title in ((4, "chapters", "Chapter List"), (5, "parts", "Part List"))]
    out.append(fields(base, book, 6, "Dialogue", [
        ("Dominant POV", c("dominant_pov")), ("Observed POV values", F.array_join("observed_pov_values", ", ")), ("Chunks with dialogue", n("dialogue_present_in_chunks")),
        ("Chunks with internal thought", n("internal_thought_present_in_chunks")), ("Chunks with unattributed dialogue", n("unattributed_dialogue_present_in_chunks")),
        ("Attributed speakers", F.array_join("explicitly_attributed_speakers", ", ")),
    ]))
    if names is not None:
        values = names.select(book, "kind", F.posexplode("values").alias("i", "value"))
        out.append(section(values, book, 7, "Entities", ["kind", "i"], c("kind"), cell(c("value"), VALUE)))
    by_name = W.partitionBy(book, "kind").orderBy(T.natural_key(c("canonical")), "norm")
    forms = entities.withColumn("_k", F.row_number().over(by_name)).where(c("_k") <= MOST_ENTITIES)
    out.append(section(forms, book, 8, "Normalized Entities", ["kind", "_k"], F.concat("kind", F.lit(": "), "canonical"), F.concat(joined(c("variants"), NAMES), F.lit(" ("), F.array_join(c("chunks").cast("array<string>"), ", "), F.lit(")"))))
    lists = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"), joined(c(f).cast("array<string>")).alias("x")) for i, f in enumerate(DOSSIER_FIELDS)])
    out.append(section(dossiers.select(book, "place", "canonical_name", F.inline(lists)), book, 9, "Dossiers", ["place", "i"], F.concat("canonical_name", F.lit(": "), "f"), c("x")))
    lives = dossiers.select(book, "place", "canonical_name", F.posexplode("biographies").alias("i", "b"))
    out.append(section(lives, book, 10, "Biography evidence", ["place", "i"], c("canonical_name"), cell(c("b"), BIOGRAPHY)))
    out.append(fields(base, book, 11, "Conflict Report", [("Character conflicts", n("n_people")), ("Entity variant notes", n("n_forms")), ("Global conflicts", n("n_global"))]))
    stated = F.concat("severity", F.lit(": "), F.array_join("values", ", "))
    rule = F.array_position(F.array(*[F.lit(t) for _, t, *_ in CONFLICTS]), c("type"))
    people = conflicts.where(scope == "character").groupBy(book, "place", "name").agg(F.array_sort(F.collect_list(F.struct(rule.alias("r"), "type", stated.alias("s")))).alias("k"))
    kinds, said = F.array_join(F.transform("k", lambda k: k["type"]), ", "), F.array_join(F.transform("k", lambda k: k["s"]), " | ")
    out.append(section(people, book, 12, "Character-Level Conflicts", ["place"], c("name"), F.concat(kinds, F.lit(" - "), cell(said, NOTE)), MOST_CONFLICTS))
    out.append(section(conflicts.where(scope == "global"), book, 13, "Global Conflicts", ["place"], F.concat("severity", F.lit(": "), "type"), cell(F.concat(F.array_join("values", ", "), F.lit(" — "), "message"), NAMES)))
    notes = conflicts.where((scope == "entity") & (c("place") < MOST_NOTES))
    out.append(section(notes, book, 14, "Entity Variant Notes", ["kind", "place"], F.concat("kind", F.lit(": "), cell(c("name"), 30)), joined(c("variants"), NAMES)))
    if merged is not None:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.coalesce(F.element_at("present_counts", p), F.lit(0)).alias("n"), F.array_join(F.element_at("missing", p), ", ").alias("m")) for i, p in enumerate((*PASSES, "timing"))])
        out.append(section(merged.select(book, F.inline(each)), book, 15, "Merge Report", ["i"], c("p"), F.concat(c("n").cast("string"), F.lit(" present, missing: "), T.or_dash(c("m")))))
    return reduce(DataFrame.unionByName, out)


def markdown(report: DataFrame, book: str) -> DataFrame:
    """(book, text): a report's tables as Markdown. One book's report is bounded by its caps and its dossiers."""
    plain = lambda k: F.replace(F.replace(T.or_dash(F.col(k)), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), plain("label"), F.lit(" | "), plain("cell"), F.lit(" |"))
    own = report.select(book, "section_no", "section", F.struct("row_no", line.alias("line")).alias("r"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    tables = own.groupBy(book, "section_no", "section").agg(F.concat(F.lit("## "), F.first("section"), F.lit("\n\n| | |\n|-|-|\n"), rows).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("section_no", "t")))
    return tables.groupBy(book).agg(F.concat(F.array_join(F.transform(parts, lambda r: r["t"]), "\n\n"), F.lit("\n")).alias("text"))
