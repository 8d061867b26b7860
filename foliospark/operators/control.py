"""The job table as data: jobs with their stages and artifacts, manuscripts, and what requests make of them.

Every operator takes tables and returns the changed rows or the whole new table; taking locks and storing is the caller's business.
Times come in as a column or literal `now`, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.text import let
from foliospark.operators import jobs as J

# Pipelines and their stages, and the artifacts of an ingest.
PIPELINES = {
    "ingest": ("ingest",),
    "orchestrate": ("orchestrate",),
    "merge": ("merge",),
    "resolve": ("resolve",),
    "report": ("report",),
    "full": ("ingest", "orchestrate", "merge", "resolve", "report"),
}
INGEST_ARTIFACTS = ("ingest_manifest", "raw_text", "clean_text", "chunk_manifest")
# Artifacts that are listed first.
PREFERRED = ("book_merged", "merge_report", "conflict_report", "book_resolved", "resolution_map", "resolution_report", "report_pdf", "orchestrator_log")
# What jobs and requests are told.
RECOVERED, PAUSED, CANCELLED = "Recovered from stale running state", "Paused by housekeeping", "Cancelled by housekeeping"
NO_INGEST, MISSING_ARTIFACT, UNKNOWN_PROFILE = "No ingest results available for this manuscript yet", "Missing ingest artifact: ", "Unknown config profile: "
CONTROL_KEYS = ("_pause_requested_at", "_cancel_requested_at", "_cancel_reason", "_control_target_status", "_worker_id", "_claimed_at")

STAGE = "struct<name:string,status:string,started_at:timestamp,finished_at:timestamp,error:string,command:array<string>,exit_code:int,stdout_path:string,stderr_path:string>"
ARTIFACT = "struct<name:string,path:string,kind:string,stage:string,metadata:map<string,string>>"
JOB = (
    "job_id string, pipeline string, status string, created_at timestamp, updated_at timestamp, book_slug string, title string, manuscript_id string, config_profile_id string, "
    f"config_path string, input_path string, owner_user_id string, owner_username string, options map<string,string>, stage_runs array<{STAGE}>, artifacts array<{ARTIFACT}>"
)
REQUEST = ("book_slug", "title", "manuscript_id", "config_profile_id", "config_path", "input_path", "owner_user_id", "owner_username")


def created(requests: DataFrame, now: Column) -> DataFrame:
    """A queued job, its stages pending, per request (job_id, pipeline, REQUEST, options). Requests for a pipeline that doesn't exist fail the query."""
    stage = lambda s: F.struct(F.lit(s).alias("name"), F.lit("pending").alias("status"))
    stages = F.create_map(*[x for p, names in PIPELINES.items() for x in (F.lit(p), F.array(*[stage(s) for s in names]))])
    empty = {f.strip(): F.lit(None) for f in ("started_at", "finished_at", "error", "command", "exit_code", "stdout_path", "stderr_path")}
    pending = F.transform(F.element_at(stages, F.col("pipeline")), lambda s: F.struct(s["name"].alias("name"), s["status"].alias("status"), *[v.alias(k) for k, v in empty.items()]))
    known = F.when(F.col("pipeline").isin(*PIPELINES), F.col("pipeline")).otherwise(F.raise_error(F.concat(F.lit("unknown pipeline: "), F.coalesce("pipeline", F.lit("null")))))
    return requests.select(
        "job_id", known.alias("pipeline"), F.lit("queued").alias("status"), now.alias("created_at"), now.alias("updated_at"), *REQUEST,
        F.coalesce("options", F.create_map().cast("map<string,string>")).alias("options"), pending.cast(f"array<{STAGE}>").alias("stage_runs"), F.array().cast(f"array<{ARTIFACT}>").alias("artifacts"),
    )


def visible(rows: DataFrame, user_id: str | None, role: str | None = None, owner: str = "owner_user_id", auth_required: bool = True) -> DataFrame:
    """Rows that an actor may see: all for an admin or where no authentication is required, else the actor's own; none without an actor."""
    if not auth_required or (user_id is not None and role == "admin"):
        return rows
    return rows.where(F.lit(user_id is not None)).where(F.col(owner).eqNullSafe(F.lit(user_id)))


def listed(jobs: DataFrame, manuscript_id: str | None = None, pipeline: str | None = None) -> DataFrame:
    """Jobs by falling creation time, then job_id; blank filters don't count."""
    for name, value in (("manuscript_id", manuscript_id), ("pipeline", pipeline)):
        jobs = jobs.where(F.col(name) == value) if value else jobs
    return jobs.orderBy(F.desc("created_at"), "job_id")


def updated(jobs: DataFrame, changed: DataFrame, key: str = "job_id") -> DataFrame:
    """The table with the changed rows in place of those of their keys; new keys are added."""
    return jobs.join(changed.select(key), key, "left_anti").select(jobs.columns).unionByName(changed.select(jobs.columns))


def deleted(jobs: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.join(gone.select(key), key, "left_anti").select(jobs.columns)


def artifact_index(jobs: DataFrame) -> DataFrame:
    """(job_id, name, path, kind, stage, metadata) of all artifacts; order by job_id and name."""
    return jobs.select("job_id", F.inline("artifacts"))


def shown_artifacts(jobs: DataFrame) -> DataFrame:
    """(job_id, place, name, ...): artifacts to offer, the preferred ones first, then by name; no directories and none known to be missing."""
    # A job is one row, so its artifacts are put in order within it, without a shuffle.
    rank = lambda a: F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), a["name"])
    offered = lambda a: ~F.coalesce(a["kind"] == "directory", F.lit(False)) & ~F.coalesce(F.element_at(a["metadata"], "exists") == "false", F.lit(False))
    keyed = lambda a, i: F.struct(F.when(rank(a) > 0, rank(a)).otherwise(len(PREFERRED) + 1).alias("rank"), a["name"].alias("name"), a["path"].alias("path"), i.alias("i"))
    order = F.array_sort(F.transform(F.filter("artifacts", offered), keyed))
    held = jobs.select("job_id", F.filter("artifacts", offered).alias("_a"), F.posexplode(order).alias("_p", "_k"))
    return held.select("job_id", F.get("_a", F.col("_k.i")).alias("_x"), (F.col("_p") + 1).alias("place")).select("job_id", "_x.*", "place")


def artifact(jobs: DataFrame, files: DataFrame, job_id: str, name: str, most: int = 4000) -> DataFrame:
    """(job_id, artifact, exists, size_bytes, preview, content): a job's first artifact of that name. files: (path, content) as binary.

    Texts have a preview of `most` characters; content is a JSON artifact's VARIANT.
    """
    found = jobs.where(F.col("job_id") == job_id).select("job_id", F.get(F.filter("artifacts", lambda a: a["name"] == name), F.lit(0)).alias("artifact")).where("artifact IS NOT NULL")
    held = files.select(F.col("path").alias("_p"), F.col("content").alias("_b"))
    text = F.when(F.col("artifact.kind").isin("text", "json", "jsonl"), F.decode("_b", "UTF-8"))
    rows = found.join(held, F.col("artifact.path") == F.col("_p"), "left").withColumn("_t", text)
    return rows.select("job_id", "artifact", F.col("_p").isNotNull().alias("exists"), F.octet_length("_b").cast("bigint").alias("size_bytes"), F.left("_t", F.lit(most)).alias("preview"), F.when(F.col("artifact.kind") == "json", F.try_parse_json("_t")).alias("content"))


def _stage(s: Column, **changes: Column) -> Column:
    """A stage with some of its fields replaced."""
    out = s
    for name, value in changes.items():
        out = out.withField(name, value)
    return out


def _first(stages: Column, status: str) -> Column:
    """The index of the first stage of a status, 0 if there is none (indexes count from 1)."""
    return F.array_position(F.transform(stages, lambda s: s["status"]), status)


def _change(stages: Column, at: Column, change) -> Column:
    return F.transform(stages, lambda s, i: F.when(i + 1 == at, change(s)).otherwise(s))


def _put(options: Column, entries: dict[str, Column]) -> Column:
    kept = F.map_filter(F.coalesce(options, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*entries))
    return F.map_concat(kept, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]))


def requested(jobs: DataFrame, action: str, now: Column, reason: str) -> DataFrame:
    """The jobs after a request to cancel or pause them. Jobs that have ended stay as they are.

    A job that isn't running ends at once, with its running or else its first stage; a running one is asked to, and its stage notes the reason.
    """
    asked, target, stamp = {"cancel": ("cancel_requested", "cancelled", "_cancel_requested_at"), "pause": ("pause_requested", "paused", "_pause_requested_at")}[action]
    status, stages = F.col("status"), F.col("stage_runs")
    over, idle, at = status.isin(*J.TERMINAL), status.isin("queued", "paused"), _first(stages, "running")
    ended = _change(stages, F.greatest(at, F.lit(1)), lambda s: _stage(s, status=F.lit(target), finished_at=now, error=F.lit(reason)))
    noted = _change(stages, at, lambda s: _stage(s, error=F.lit(reason)))
    entries = {stamp: now, "_cancel_reason": F.lit(reason), "_control_target_status": F.lit(target)}
    return _with(jobs, ~over, status=F.when(idle, target).otherwise(asked), stage_runs=F.when(idle, ended).otherwise(noted), updated_at=now, options=_put(F.col("options"), entries))


def _with(jobs: DataFrame, where: Column, **changes: Column) -> DataFrame:
    """jobs with the columns changed in the rows that meet a condition."""
    met = F.coalesce(where, F.lit(False))
    return jobs.select(*[F.when(met, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns])


def rerun(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs after a request to run them: a paused job is queued and keeps what has succeeded, one that has ended begins anew."""
    status, stages = F.col("status"), F.col("stage_runs")
    paused, over, none = status == "paused", status.isin(*J.TERMINAL), F.lit(None)
    kept = F.transform(stages, lambda s: F.when(s["status"] != "succeeded", _stage(s, status=F.lit("pending"), finished_at=none.cast("timestamp"), error=none.cast("string"))).otherwise(s))
    blank = {"started_at": none.cast("timestamp"), "finished_at": none.cast("timestamp"), "error": none.cast("string"), "command": F.array().cast("array<string>"), "exit_code": none.cast("int"), "stdout_path": none.cast("string"), "stderr_path": none.cast("string")}
    anew = F.transform(stages, lambda s: _stage(s, status=F.lit("pending"), **blank))
    options = F.when(paused, F.map_filter("options", lambda k, _: ~k.isin(*CONTROL_KEYS))).otherwise(F.col("options"))
    return _with(jobs, paused | over, status=F.lit("queued"), updated_at=now, stage_runs=F.when(paused, kept).otherwise(anew), options=options, artifacts=F.when(over, F.array().cast(f"array<{ARTIFACT}>")).otherwise(F.col("artifacts")))


def claimed(jobs: DataFrame, worker_id: str, now: Column, include: tuple = (), exclude: tuple = ()) -> DataFrame:
    """The job that a worker takes next, as it is then: the oldest queued one of the pipelines asked for, running, its first stage begun."""
    pipeline = F.col("pipeline")
    taken = J.claim(jobs, "status", ["created_at", "job_id"], pipeline.isin(*include) if include else None, pipeline.isin(*exclude) if exclude else None)
    begun = _change(F.col("stage_runs"), F.lit(1), lambda s: _stage(s, status=F.lit("running"), started_at=F.coalesce(s["started_at"], now)))
    return _with(taken, F.lit(True), status=F.lit("running"), updated_at=now, stage_runs=begun, options=_put(F.col("options"), {"_worker_id": F.lit(worker_id), "_claimed_at": now}))


def _older(ts: Column, now: Column, seconds: int) -> Column:
    return ts <= now - F.make_dt_interval(secs=F.lit(seconds))


def recovered(jobs: DataFrame, worker_id: str, now: Column, seconds: int = 600) -> DataFrame:
    """The changed rows of running jobs claimed `seconds` or longer ago: queued again, the first running stage pending. Without a claim none recovers."""
    at = F.element_at("options", "_claimed_at").try_cast("timestamp")
    stale = jobs.where((F.col("status") == "running") & _older(at, now, seconds))
    none = F.lit(None)
    pending = _change(F.col("stage_runs"), _first(F.col("stage_runs"), "running"), lambda s: _stage(s, status=F.lit("pending"), started_at=none.cast("timestamp"), finished_at=none.cast("timestamp"), error=F.lit(RECOVERED)))
    return _with(stale, F.lit(True), status=F.lit("queued"), updated_at=now, stage_runs=pending, options=_put(F.col("options"), {"_recovered_by": F.lit(worker_id), "_recovered_at": now}))


def finalized(jobs: DataFrame, now: Column, seconds: int = 15) -> DataFrame:
    """The changed rows of requests to pause or cancel that are `seconds` or longer old: the state asked for, cancelled if none is noted."""
    option = lambda k: F.nullif(F.element_at("options", k), F.lit(""))
    at = F.coalesce(option("_pause_requested_at"), option("_cancel_requested_at"), F.col("updated_at").cast("string")).try_cast("timestamp")
    stale = jobs.where(F.col("status").isin("cancel_requested", "pause_requested") & _older(at, now, seconds))
    target = F.coalesce(option("_control_target_status"), F.lit("cancelled"))
    why = F.when(target == "paused", PAUSED).otherwise(CANCELLED)
    ended = _change(F.col("stage_runs"), _first(F.col("stage_runs"), "running"), lambda s: _stage(s, status=target, finished_at=now, error=F.coalesce(F.nullif(s["error"], F.lit("")), why)))
    return _with(stale, F.lit(True), status=target, updated_at=now, stage_runs=ended)


def marked(jobs: DataFrame, stage: str, event: str, now: Column, message: str | None = None) -> DataFrame:
    """The jobs after one of their stages began (running), succeeded, failed, or was ended as cancelled or paused.

    A job has succeeded when all its stages have. A stage that the job doesn't have changes the job's own columns alone.
    """
    stages, none = F.col("stage_runs"), F.lit(None).cast("string")
    said = F.lit(message).cast("string")
    change = {
        "running": lambda s: _stage(s, status=F.lit("running"), started_at=F.coalesce(s["started_at"], now), error=none),
        "succeeded": lambda s: _stage(s, status=F.lit("succeeded"), started_at=F.coalesce(s["started_at"], now), finished_at=now, error=none),
    }.get(event, lambda s: _stage(s, status=F.lit(event), finished_at=now, error=said))
    at = F.array_position(F.transform(stages, lambda s: s["name"]), stage)
    out = _with(jobs, F.lit(True), updated_at=now, stage_runs=_change(stages, at, change))
    done = F.forall("stage_runs", lambda s: s["status"] == "succeeded")
    status = F.when(done, "succeeded").otherwise(F.col("status")) if event == "succeeded" else F.lit(event)
    return out.withColumn("status", status)


def latest_ingest(jobs: DataFrame) -> DataFrame:
    """(manuscript_id, job_id, pipeline, status, started_at, finished_at, updated_at, error): each manuscript's ingest stage of its last updated job that has one."""
    own = jobs.where("manuscript_id IS NOT NULL").withColumn("_s", F.get(F.filter("stage_runs", lambda s: s["name"] == "ingest"), F.lit(0))).where("_s IS NOT NULL")
    last = J.latest(own, ["manuscript_id"], [F.desc("updated_at"), "job_id"])
    return last.select("manuscript_id", "job_id", "pipeline", "_s.status", "_s.started_at", "_s.finished_at", "updated_at", "_s.error")


def with_latest_ingest(manuscripts: DataFrame, jobs: DataFrame) -> DataFrame:
    """manuscripts with latest_ingest, a struct, null where there is none."""
    got = latest_ingest(jobs)
    return manuscripts.join(got.select("manuscript_id", F.struct(*[c for c in got.columns if c != "manuscript_id"]).alias("latest_ingest")), "manuscript_id", "left")


def ingest_results(manuscripts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(manuscript_id, job_id, artifacts, error): the four artifacts of each manuscript's latest ingest, or what is missing."""
    last = latest_ingest(jobs).select("manuscript_id", "job_id")
    rows = manuscripts.select("manuscript_id").join(last, "manuscript_id", "left").join(jobs.select("job_id", "artifacts"), "job_id", "left")

    def entry(name: str) -> Column:
        first = F.get(F.filter("artifacts", lambda a: a["name"] == name), F.lit(0))
        return let(first, lambda a: F.when(a.isNotNull(), F.struct(F.lit(name).alias("name"), a.alias("artifact"))))

    found = F.map_from_entries(F.array_compact(F.array(*[entry(n) for n in INGEST_ARTIFACTS])))
    missing = F.get(F.filter(F.array(*[F.lit(n) for n in INGEST_ARTIFACTS]), lambda n: ~F.map_contains_key("_a", n)), F.lit(0))
    own = rows.withColumn("_a", F.coalesce(found, F.create_map().cast(f"map<string,{ARTIFACT}>")))
    error = F.when(F.col("job_id").isNull(), NO_INGEST).when(missing.isNotNull(), F.concat(F.lit(MISSING_ARTIFACT), missing))
    return own.withColumn("error", error).select("manuscript_id", "job_id", F.when(F.col("error").isNull(), F.col("_a")).alias("artifacts"), "error")


def paths(manuscripts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(manuscript_id, place, path): what a full deletion removes, each path once, the deepest first, so that folders come after their files."""
    stages = F.flatten(F.transform("stage_runs", lambda s: F.array(s["stdout_path"], s["stderr_path"])))
    own = jobs.where("manuscript_id IS NOT NULL").select("manuscript_id", F.explode(F.concat(stages, F.transform("artifacts", lambda a: a["path"]))).alias("path"))
    own = own.join(manuscripts.select("manuscript_id"), "manuscript_id", "left_semi")
    plain = F.regexp_replace(F.regexp_replace("path", r"/(?:\./)*(?:/|\.$)*", "/"), "(?<=.)/$", "")
    rows = manuscripts.select("manuscript_id", F.col("source_path").alias("path")).union(own).where("path <> ''").select("manuscript_id", plain.alias("path")).distinct()
    depth = F.size(F.filter(F.split("path", "/"), lambda p: p != "")) + F.col("path").startswith("/").cast("int")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("manuscript_id").orderBy(F.desc(depth), F.desc("path"))))


def deleted_with_data(manuscripts: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manuscripts, jobs, paths to remove) after manuscripts and their jobs are deleted. gone: (manuscript_id)."""
    them = manuscripts.join(gone.select("manuscript_id"), "manuscript_id", "left_semi")
    return deleted(manuscripts, gone, "manuscript_id"), deleted(jobs, gone, "manuscript_id"), paths(them, jobs)


def imported_status(status: Column) -> Column:
    """The state that a job or stage of an archive has after its import: what wasn't over is paused."""
    return F.when(status.isin("queued", "running", "pause_requested", "cancel_requested", "pending"), "paused").otherwise(status)


def upsert_manuscripts(manuscripts: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after changes(manuscript_id, book_slug, title, source_path, document_type, file_size_bytes, owner_user_id, owner_username, at), in the order of at.

    A manuscript is one by slug and owner, null owners equal. It keeps its id and creation time, and its type where a change has none.
    """
    old = manuscripts.select("*", F.col("created_at").alias("_at"), F.lit(0).alias("_new"))
    new = changes.select(*[c for c in changes.columns if c != "at"], F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.col("at").alias("_at"), F.lit(1).alias("_new"))
    order = F.struct("_new", "_at", "manuscript_id")
    last = {c: F.max_by(c, order).alias(c) for c in ("title", "source_path", "file_size_bytes", "owner_username", "updated_at")}
    kind = F.nullif(F.lower(T.strip(F.col("document_type"))), F.lit(""))
    rows = old.unionByName(new.select(old.columns)).groupBy("book_slug", "owner_user_id").agg(
        F.min_by("manuscript_id", order).alias("manuscript_id"), F.min_by("created_at", order).alias("created_at"), F.max_by(kind, F.when(kind.isNotNull(), order)).alias("document_type"), *last.values()
    )
    return rows.select(manuscripts.columns)


def upsert_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """The table (config_profile_id, name, config_path, version, checksum, metadata, created_at, updated_at) after changes(config_profile_id, name, config_path, version, checksum, metadata, at), in the order of at.

    A profile is one by name and version. It keeps its id and creation time and takes all else from the last change; a new one has its first change's id. Null names or versions are equal.
    """
    old = profiles.select("*", F.col("created_at").alias("_at"), F.lit(0).alias("_new"))
    new = changes.select(*[c for c in changes.columns if c != "at"], F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.col("at").alias("_at"), F.lit(1).alias("_new"))
    order = F.struct("_new", "_at", "config_profile_id")
    # A struct holds null values too, which max_by of the column alone would pass over.
    last = F.max_by(F.struct("config_path", "checksum", "metadata", "updated_at"), order).alias("_last")
    rows = old.unionByName(new.select(old.columns)).groupBy("name", "version").agg(F.min_by("config_profile_id", order).alias("config_profile_id"), F.min_by("created_at", order).alias("created_at"), last)
    return rows.select("config_profile_id", "name", "version", "created_at", "_last.*").select(profiles.columns)


def with_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests with config_profile, the profile of their config_profile_id as a struct, and profile_error where one is asked for that doesn't exist; an empty id asks for none."""
    known = profiles.select(F.col("config_profile_id").alias("_id"), F.struct(*profiles.columns).alias("config_profile"))
    asked = F.nullif(F.col("config_profile_id"), F.lit(""))
    out = requests.join(known, asked == F.col("_id"), "left").drop("_id")
    return out.withColumn("profile_error", F.when(asked.isNotNull() & F.col("config_profile").isNull(), F.concat(F.lit(UNKNOWN_PROFILE), asked)))


def throughput(reported: Column, estimated: Column) -> Column:
    """The rate shown: the reported one unless there is none or it is zero, else the estimate."""
    return F.coalesce(F.nullif(reported, F.lit(0.0)), F.nullif(estimated, F.lit(0.0)))
