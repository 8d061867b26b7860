"""A manuscript with its jobs and files as one archive, and back: a ZIP of the files and a bundle.json that tells what they are.

An archive is built and read in one task's memory, like any file of Spark's binaryFile source; manuscripts are independent of one another.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import text as T
from foliospark.operators import control, jobs

VERSION = 1


def _ancestors(path: Column) -> Column:
    """The path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def members(manuscripts: DataFrame, table: DataFrame, files: DataFrame) -> DataFrame:
    """(manuscript_id, root, owner, member, content): the files(path, content) that belong to a manuscript, and where they go in its archive.

    Its source goes to source/, an artifact to jobs/<job>/artifacts/<name>/; a folder brings all files under it. One equi-join by the files' paths and folders.
    """
    plain = lambda p: F.regexp_replace(p, "(?<=.)/+$", "")
    sources = manuscripts.where("source_path <> ''").select("manuscript_id", plain(F.col("source_path")).alias("root"), F.lit("source").alias("folder"))
    own = table.join(manuscripts.select("manuscript_id"), "manuscript_id", "left_semi").select("manuscript_id", "job_id", F.inline("artifacts"))
    artifacts = own.select("manuscript_id", plain(F.col("path")).alias("root"), F.concat(F.lit("jobs/"), "job_id", F.lit("/artifacts/"), "name").alias("folder"))
    held = files.select("path", "content", F.explode(_ancestors(F.col("path"))).alias("root"))
    below = F.substr("path", F.length("root") + 2)
    name = F.element_at(F.split("path", "/"), -1)
    got = sources.union(artifacts).join(held, "root")
    return got.select("manuscript_id", "root", "folder", F.concat("folder", F.lit("/"), F.when(F.col("path") == F.col("root"), name).otherwise(below)).alias("member"), (F.col("path") == F.col("root")).alias("single"), "content")


def exported(manuscripts: DataFrame, table: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """(manuscript_id, name, content): each manuscript's archive. manuscripts: manuscript_id, book_slug, title, source_path and more; table: control.JOB."""
    found = members(manuscripts, table, files)
    places = found.groupBy("manuscript_id", "root", "folder").agg(F.max(F.when(F.col("single"), F.col("member"))).alias("one")).select("manuscript_id", "folder", F.coalesce("one", "folder").alias("place"))
    bundled = places.groupBy("manuscript_id").agg(F.map_from_entries(F.collect_set(F.struct("folder", "place"))).alias("places"))
    with_jobs = table.where("manuscript_id IS NOT NULL").groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "job_id", F.to_json(F.struct(*table.columns)).alias("j")))).alias("jobs"))
    head = manuscripts.select("manuscript_id", T.archive_name(F.col("title"), F.col("book_slug")).alias("name"), F.to_json(F.struct(*manuscripts.columns)).alias("manuscript"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"))
    rows = head.join(with_jobs, "manuscript_id", "left").join(bundled, "manuscript_id", "left")
    rows = rows.select("manuscript_id", "name", "manuscript", "at", F.coalesce(F.transform("jobs", lambda j: j["j"]), F.array().cast("array<string>")).alias("jobs"), F.to_json("places").alias("places"))

    def build(key: tuple, head: pd.DataFrame, body: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in head.itertuples():
            places = json.loads(r.places) if isinstance(r.places, str) else {}
            entries = []
            for j in map(json.loads, r.jobs):
                paths = [a | {"bundle_path": places.get(f"jobs/{j['job_id']}/artifacts/{a['name']}")} for a in j.get("artifacts", [])]
                entries.append({"job": j, "artifacts": paths})
            bundle = {"bundle_version": VERSION, "exported_at": r.at, "manuscript": json.loads(r.manuscript) | {"source_relpath": places.get("source")}, "jobs": entries}
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for m in body.drop_duplicates("member").sort_values("member").itertuples():
                    z.writestr(m.member, bytes(m.content))
                z.writestr("bundle.json", json.dumps(bundle, indent=2, ensure_ascii=False) + "\n")
            out.append((r.manuscript_id, r.name, held.getvalue()))
        return pd.DataFrame(out, columns=["manuscript_id", "name", "content"])

    kind = manuscripts.schema["manuscript_id"].dataType.simpleString()
    return rows.groupBy("manuscript_id").cogroup(found.select(F.col("manuscript_id").alias("_m"), "member", "content").groupBy("_m")).applyInPandas(build, f"manuscript_id {kind}, name string, content binary")


def opened(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, member, content, bundle, error): the files of each archive, and one row with its bundle, or with what is wrong with it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, body in zip(pdf[key], pdf[content], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(body or b""))) as z:
                        inside = [n for n in z.namelist() if not n.endswith("/")]
                        if "bundle.json" not in inside:
                            raise ValueError("Archive is missing bundle.json")
                        bundle = z.read("bundle.json").decode("utf-8")
                        json.loads(bundle)
                        rows += [(name, n, z.read(n), None, None) for n in inside if n != "bundle.json"]
                        rows.append((name, None, None, bundle, None))
                except zipfile.BadZipFile:
                    rows.append((name, None, None, None, "Uploaded archive is not a valid zip bundle"))
                except json.JSONDecodeError:
                    rows.append((name, None, None, None, "Archive bundle manifest is not valid JSON"))
                except (ValueError, OSError) as e:
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "member", "content", "bundle", "error"])

    kind = archives.schema[key].dataType.simpleString()
    return archives.select(key, content).mapInPandas(read, f"`{key}` {kind}, member string, content binary, bundle string, error string")


def imported(found: DataFrame, taken: DataFrame, root: Column, now: Column, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(manuscripts, jobs) of opened() archives, as new ones. taken: (book_slug) in use; root: the folder that an archive's files went to.

    Slugs that are taken get the first free _imported_N, their titles (Imported N). What wasn't over is paused; artifacts and output paths lead into the
    root; options note the archive and the job's old id. New ids are uuids, so write the result before it is used twice.
    """
    v, c = F.col("v"), F.col
    own = found.where("bundle IS NOT NULL").select(key, jsonx.whole(F.col("bundle")).alias("v"), root.alias("root"))
    title = F.coalesce(F.nullif(jsonx.string(v, "$.manuscript.title"), F.lit("")), F.lit("Imported Manuscript"))
    slug = F.coalesce(F.nullif(T.slug(F.coalesce(F.nullif(jsonx.string(v, "$.manuscript.book_slug"), F.lit("")), title)), F.lit("")), F.lit("imported_manuscript"))
    named = own.select("*", title.alias("title"), slug.alias("_slug"))
    names = jobs.import_identity(taken.select(F.col("book_slug").alias("_slug")), named.select("_slug"), "_slug")
    there = jsonx.string(v, "$.manuscript.source_relpath")
    number = F.regexp_extract("new_name", "_imported_([0-9]+)$", 1)
    books = named.join(names, "_slug").select(
        key, "v", "root", F.uuid().alias("manuscript_id"), F.col("new_name").alias("book_slug"), F.when(F.col("new_name") == F.col("_slug"), F.col("title")).otherwise(F.concat("title", F.lit(" (Imported "), number, F.lit(")"))).alias("title"),
        F.when(there != "", F.concat("root", F.lit("/"), there)).otherwise(F.col("root")).alias("source_path"), jsonx.string(v, "$.manuscript.document_type").alias("document_type"),
        F.try_variant_get("v", "$.manuscript.file_size_bytes", "bigint").alias("file_size_bytes"), jsonx.string(v, "$.manuscript.owner_user_id").alias("owner_user_id"), jsonx.string(v, "$.manuscript.owner_username").alias("owner_username"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    each = books.select("*", F.explode(jsonx.items(v, "$.jobs")).alias("e"))
    job = F.from_json(F.to_json(jsonx.get(F.col("e"), "$.job")), control.JOB)
    paths = F.from_json(F.coalesce(F.to_json(jsonx.get(F.col("e"), "$.artifacts")), F.lit("[]")), "array<struct<name:string,path:string,kind:string,stage:string,metadata:map<string,string>,bundle_path:string>>")
    rows = each.withColumn("j", job).withColumn("a", paths)
    moved = lambda a: F.when(a["bundle_path"] != "", F.concat("root", F.lit("/"), a["bundle_path"])).otherwise(a["path"])
    to = F.map_from_entries(F.transform(F.filter("a", lambda a: a["path"].isNotNull()), lambda a: F.struct(a["path"], moved(a))))
    rows = rows.withColumn("_to", to)
    follow = lambda p: F.coalesce(F.try_element_at("_to", p), p)
    stages = F.transform("j.stage_runs", lambda s: s.withField("status", control.imported_status(F.coalesce(s["status"], F.lit("pending")))).withField("stdout_path", follow(s["stdout_path"])).withField("stderr_path", follow(s["stderr_path"])))
    artifacts = F.transform("a", lambda a: F.struct(a["name"], moved(a).alias("path"), a["kind"], a["stage"], a["metadata"]))
    options = F.map_concat(F.map_filter(F.coalesce("j.options", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("_imported_from_archive", "_original_job_id")), F.create_map(F.lit("_imported_from_archive"), F.lit("true"), F.lit("_original_job_id"), F.col("j.job_id")))
    made = rows.select(
        F.uuid().alias("job_id"), "j.pipeline", control.imported_status(F.coalesce("j.status", F.lit("queued"))).alias("status"), now.alias("created_at"), now.alias("updated_at"), "book_slug", "title", "manuscript_id",
        F.lit(None).cast("string").alias("config_profile_id"), "j.config_path", c("source_path").alias("input_path"), "j.owner_user_id", "j.owner_username", options.alias("options"),
        stages.cast(f"array<{control.STAGE}>").alias("stage_runs"), artifacts.cast(f"array<{control.ARTIFACT}>").alias("artifacts"),
    )
    return books.drop("v", "root"), made
