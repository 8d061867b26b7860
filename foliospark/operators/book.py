"""Book-level documents: the merged and the resolved artifacts as JSON, a row per book and artifact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import merge, passes, resolve
from foliospark.storage import kept


def listed(rows: DataFrame, book: str, order: list, value: Column, name: str) -> DataFrame:
    """(book, name): a book's values as one array in order."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = rows.select(book, F.struct(F.struct(*keys).alias("k"), value.alias("v")).alias("r"))
    # VARIANTs in the values have no order, so only the keys are compared.
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return rows.groupBy(book).agg(F.transform(F.array_sort(F.collect_list("r"), by_key), lambda r: r["v"]).alias(name))


def _joined(books: DataFrame, book: str, parts: list[DataFrame]) -> DataFrame:
    """One row per book; lists that a book has no rows for are empty."""
    out = reduce(lambda a, b: a.join(b, book, "left"), parts, books.select(book).distinct())
    lists = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in out.schema if f.dataType.typeName() == "array"}
    return out.withColumns(lists) if lists else out


def _doc(df: DataFrame, book: str, name: str, columns: list | None = None) -> DataFrame:
    own = [c for c in df.columns if c != book] if columns is None else columns
    return df.select(book, F.lit(name).alias("name"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("body"))


class Merged:
    """The merge of outputs(book, chunk_id, pos, pass, doc) per book, each part a table of its own in the shared folder; artifacts() gives the documents.

    chunks: (book, chunk_id, pos) of all chunks, by default those with an output.
    """

    def __init__(self, outputs: DataFrame, book: str = "book", chunks: DataFrame | None = None):
        self.book = book
        self.outputs = outputs = kept(outputs.select(book, "chunk_id", "pos", "pass", "doc"), "outputs")
        self.chunks = kept(outputs.select(book, "chunk_id", "pos").distinct() if chunks is None else chunks, "chunks")
        self.structure = kept(passes.structure_merge(outputs, book), "structure")
        self.structure_chunks = kept(passes.structure_chunks(outputs, book), "structure-chunks")
        self.dialogue = kept(passes.dialogue_merge(outputs, book), "dialogue")
        self.dialogue_chunks = passes.dialogue_chunks(outputs, book)
        self.names = kept(passes.entity_lists(outputs, book), "names")
        self.entities = kept(merge.entity_merge(passes.entity_mentions(outputs, book), [book, "kind"], "value", passes.place_of(F.col("pos"), F.col("i")), "pos"), "entities")
        said = kept(passes.dossier_values(passes.dossier_rows(outputs, book), book), "dossier-values")
        self.notes = kept(passes.resolver_notes(said, book), "notes")
        self.dossiers = kept(passes.dossier_merge(outputs, book, self.notes, said), "dossiers")
        self.timing = kept(merge.timing_summary(outputs.where(F.col("pass") == "timing"), [book]), "timing")
        self.report = kept(passes.merge_report(book, self.chunks, outputs, self.dossiers), "report")
        self.conflicts = kept(passes.conflict_report(book, self.dossiers, self.entities, self.dialogue, self.structure_chunks), "conflicts")

    def _ids(self, positions: str) -> Column:
        """Chunk positions as ids, by a map of the book's chunks that named() adds."""
        return F.transform(positions, lambda p: F.element_at("_ids", p.cast("int")))

    def named(self, rows: DataFrame) -> DataFrame:
        ids = self.chunks.groupBy(self.book).agg(F.map_from_entries(F.collect_set(F.struct(F.col("pos").cast("int"), "chunk_id"))).alias("_ids"))
        return rows.join(ids, self.book)

    def per_chunk(self, rows: DataFrame, **empty: Column) -> DataFrame:
        """(book, per_chunk): a record of each chunk in order, with the columns of rows(book, pos, ...), or what `empty` says of them where a chunk has none."""
        own = self.chunks.select(self.book, "pos", "chunk_id").join(rows, [self.book, "pos"], "left")
        fields = [F.coalesce(F.col(x), empty[x]).alias(x) if x in empty else F.col(x) for x in rows.columns if x not in (self.book, "pos")]
        return listed(own, self.book, ["pos"], F.struct("chunk_id", *fields), "per_chunk")

    def documents(self) -> dict[str, DataFrame]:
        b, c = self.book, F.col
        books = self.chunks
        at = self.chunks.select(b, "pos", "chunk_id")
        lists = lambda df, kinds: [df.where(c("kind") == k).select(b, c("values").alias(k)) for k in kinds]
        per_chunk = self.per_chunk
        status = listed(at.join(self.structure_chunks, [b, "pos"], "left"), b, ["pos"], F.struct("chunk_id", F.coalesce("status", F.lit("")).alias("status")), "statuses")
        structure = _joined(books, b, [*lists(self.structure, ("chapters", "parts", "scene_breaks")), per_chunk(self.structure_chunks), status])
        dialogue = _joined(books, b, [self.dialogue, per_chunk(self.dialogue_chunks)])
        form = F.struct("canonical", "variants", self._ids("chunks").alias("chunks"))
        forms = self.named(self.entities)
        normalized = [listed(forms.where(c("kind") == k), b, [T.natural_key(c("canonical")), "norm"], form, f"{k}_normalized") for k in passes.ENTITY_KINDS]
        none = F.array().cast("array<variant>")
        entities = _joined(books, b, [self.per_chunk(passes.entity_chunks(self.outputs, b), **dict.fromkeys(passes.ENTITY_KINDS, none)), *lists(self.names, passes.ENTITY_KINDS), *normalized])
        source = F.transform("source_dossiers", lambda s: F.struct(F.element_at("_ids", s["chunk"].cast("int")).alias("chunk_id"), F.parse_json(s["dossier"]).alias("dossier")))
        dossier = F.struct(c("canonical_name").alias("name"), "canonical_name", "surface_variants", *passes.MERGED, self._ids("chunks").alias("chunks"), "merge_confidence", c("merge_reasons").alias("merge_reason"), source.alias("source_dossiers"))
        merged = listed(self.named(self.dossiers), b, ["place"], dossier, "character_dossiers")
        said = self.notes.where("target_name IS NOT NULL")
        note = F.struct(c("name").alias("source_name"), "target_name", "confidence", "reason", "score", F.element_at("_ids", passes.chunk_of(c("pos"))).alias("chunk_id"))
        dossiers = _joined(books, b, [self.per_chunk(passes.dossier_chunks(self.outputs, b), character_dossiers=none), merged, listed(self.named(said), b, ["pos"], note, "resolver_notes")])
        clash = F.struct("type", "severity", "values", "message")
        people = self.conflicts.where("scope = 'character'").groupBy(b, "place", "name", "variants", "surface_variants", "chunks", "merge_confidence").agg(F.array_sort(F.collect_list(clash)).alias("conflicts"))
        parts = [listed(people, b, ["place"], F.struct("name", "variants", "surface_variants", "chunks", "merge_confidence", "conflicts"), "character_conflicts")]
        forms_noted = self.conflicts.where("scope = 'entity'")
        parts += [listed(forms_noted.where(c("kind") == k), b, ["place"], F.struct(c("name").alias("canonical"), "variants", "chunks", "message"), f"{k}_normalized") for k in passes.ENTITY_KINDS]
        parts += [listed(self.conflicts.where("scope = 'global'"), b, ["place"], clash, "global_conflicts"), dossiers.select(b, "resolver_notes")]
        flat = _joined(books, b, parts).join(passes.conflict_summary(self.conflicts, books, b), b)
        counts = F.struct("character_conflict_count", "entity_variant_note_count", "global_conflict_count").alias("summary")
        clashes = flat.select(b, counts, "character_conflicts", F.struct(*[f"{k}_normalized" for k in passes.ENTITY_KINDS]).alias("entity_variant_notes"), "global_conflicts", "resolver_notes")
        return {"structure_merged": structure, "dialogue_merged": dialogue, "entities_merged": entities, "dossiers_merged": dossiers, "conflict_report": clashes, "merge_report": self.report}

    def artifacts(self) -> DataFrame:
        """(book, name, body): the seven merged documents of each book as JSON."""
        b = self.book
        parts = {name: kept(_doc(df, b, name), name) for name, df in self.documents().items()}
        held = [df.select(b, F.parse_json("body").alias(name)) for name, df in parts.items()]
        each = self.per_chunk(passes.timing_chunks(self.outputs, b), passes=F.parse_json(F.lit("{}")))
        summary = F.struct(F.coalesce("total_seconds", F.lit(0.0)).alias("book_total_duration_seconds"), F.coalesce("passes", F.create_map().cast("map<string,double>")).alias("pass_total_duration_seconds"), "per_chunk")
        timing = each.join(self.timing, b, "left").select(b, summary.alias("timing_summary"))
        whole = reduce(lambda x, y: x.join(y, b, "left"), [*held, timing])
        fields = [F.col(b).cast("string").alias("book_slug"), "merge_report", "timing_summary", "conflict_report", *[F.col(f"{p}_merged").alias(p) for p in ("structure", "dialogue", "entities", "dossiers")]]
        return reduce(DataFrame.union, [*parts.values(), _doc(whole, b, "book_merged", fields)])

    def pool(self) -> DataFrame:
        """resolve.character_pool() of what was merged."""
        b, c = self.book, F.col
        ids = lambda df: self.named(df).withColumn("chunks", self._ids("chunks"))
        people = self.names.where("kind = 'characters'").select(b, F.posexplode("values").alias("pos", "name"))
        order = F.row_number().over(merge.W.partitionBy(b).orderBy(T.natural_key(c("canonical")), "norm"))
        forms = ids(self.entities.where("kind = 'characters'")).withColumn("pos", order)
        speakers = self.dialogue.select(b, F.posexplode("explicitly_attributed_speakers").alias("pos", "name"))
        dossiers = ids(self.dossiers).withColumn("pos", c("place")).withColumn("name", c("canonical_name"))
        clashes = self.conflicts.where("scope = 'character'").withColumn("pos", c("place")).dropDuplicates([b, "place"])
        return resolve.character_pool(b, people, forms, speakers, dossiers, clashes.withColumn("chunks", F.array().cast("array<string>")))


def resolved_artifacts(merged: Merged, people: DataFrame, groups: DataFrame, pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """(book, name, body): resolution_candidates, resolution_map, resolution_report and book_resolved of each book.

    people, groups, pairs and answers: resolve.pool(), clusters(), scored_pairs() and adjudicated().
    """
    b, c = merged.book, F.col
    books = merged.chunks
    people, groups, pairs, answers = kept(people, "people"), kept(groups, "groups"), kept(pairs, "pairs"), kept(answers, "answers")
    number = F.concat(F.lit("group_"), T.padded(c("group_no"), 3))
    members = groups.groupBy(b, "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_no", "name"))), lambda m: m["name"]).alias("members"))
    asked = members.join(resolve.payloads(people, groups, pairs, b), [b, "group_no"])
    candidates = _joined(books, b, [listed(asked, b, ["group_no"], F.struct(number.alias("group_id"), "members", F.parse_json("payload").alias("payload")), "groups")])
    entry = F.struct(number.alias("group_id"), "canonical_name", "merge", "confidence", "members_to_merge", "members_to_keep_separate", "reasons")
    known = kept(resolve.resolution_map(answers, [b]), "known")
    by_norm = known.groupBy(b).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm", F.struct("variant", "canonical_name", "confidence", "reasons"))))).alias("variant_to_canonical"))
    mapped = _joined(books, b, [listed(answers, b, ["group_no"], entry, "resolutions"), by_norm]).withColumn("variant_to_canonical", F.coalesce("variant_to_canonical", F.create_map().cast(by_norm.schema["variant_to_canonical"].dataType)))
    report = books.select(b).distinct().join(resolve.resolution_report(groups, answers, known, [b]), b, "left").na.fill(0)
    names = {"n_groups": "candidate_group_count", "n_resolved": "resolved_group_count", "n_merged": "merged_group_count", "n_variants": "variant_mapping_count"}
    told = report.select(b, *[c(k).alias(v) for k, v in names.items()])
    people_ = merged.names.where("kind = 'characters'").select(b, F.posexplode("values").alias("i", "name"))
    resolved = resolve.resolved(people_, known, [b], "name").groupBy(b, "resolved").agg(F.min("i").alias("i"))
    annotated = resolve.annotated(merged.dossiers, known, [b], "surface_variants")
    marked = F.struct(c("canonical_name").alias("name"), c("resolved_name").alias("resolved_canonical_name"), c("resolution_confidence").alias("resolver_confidence"), c("resolution_reasons").alias("resolver_reasons"))
    body = merged.artifacts().where("name = 'book_merged'").select(b, F.parse_json("body").alias("book_merged"))
    whole = _joined(books, b, [listed(resolved, b, ["i"], c("resolved"), "characters_resolved"), listed(annotated, b, ["place"], marked, "character_dossiers"), body, _doc(mapped, b, "m").select(b, F.parse_json("body").alias("resolution_map"))])
    return reduce(DataFrame.union, [_doc(candidates, b, "resolution_candidates"), _doc(mapped, b, "resolution_map"), _doc(told, b, "resolution_report"), _doc(whole, b, "book_resolved")])
