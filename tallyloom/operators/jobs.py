"""Queries over jobs, batches, files and logs, and the transitions of job states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "running", "done", "error", "canceled", "mismatch")


def status_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, status: str, states: Sequence[str]) -> DataFrame:
    """Every parent with its number of children and of those in each state; children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"), *[F.count_if(F.col(status) == s).alias(f"_{i}") for i, s in enumerate(states)])
    joined = parents.join(counts, parents[parent_key] == F.col("_k"), "left")
    return joined.select(*[parents[c] for c in parents.columns], F.coalesce("_n", F.lit(0)).alias("total"), *[F.coalesce(f"_{i}", F.lit(0)).alias(s) for i, s in enumerate(states)])


def data_stats(jobs: DataFrame, files: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: numbers of jobs, files and cached documents, done and failed jobs, and stored megabytes."""
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"))
    f = files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576, 1).alias("megabytes"))
    c = cache.agg(F.count("*").alias("cached"), F.coalesce(F.sum("num_pages"), F.lit(0)).alias("pages"))
    return j.join(f, F.lit(True)).join(c, F.lit(True))


def transition(jobs: DataFrame, ids: DataFrame, allowed: Sequence[str], changes: Mapping[str, Column]) -> DataFrame:
    """Named jobs in an allowed state change the given columns; a wrong state means no change."""
    named = jobs.join(ids.select("id").distinct().withColumn("_named", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("_named"), F.lit(False)) & F.col("status").isin(*allowed)
    out = named.withColumn("_go", go)
    return out.select(*[(F.when(F.col("_go"), changes[c]).otherwise(F.col(c)) if c in changes else F.col(c)).alias(c) for c in jobs.columns])


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(jobs, ids, ("queued", "running"), {"status": F.lit("canceled")})


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(jobs, ids, ("error", "canceled", "done", "mismatch"), {"status": F.lit("queued"), "cursor": F.lit(0), "error": F.lit(None).cast("string")})


def override_mismatch(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(jobs, ids, ("mismatch",), {"status": F.lit("queued")})


def reuse_results(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with an identical finished source (id, source_id) take its results and are done."""
    source = jobs.filter("status = 'done'").select(F.col("id").alias("source_id"), F.col("result").alias("_result"))
    found = sources.join(source, "source_id").select("id", "_result", "source_id")
    joined = jobs.join(found, "id", "left")
    take = F.col("_result").isNotNull() & (F.col("status") != "done")
    return joined.select(*[(F.when(take, F.col("_result")).otherwise(F.col(c)) if c == "result" else F.when(take, F.lit("done")).otherwise(F.col(c)) if c == "status" else F.when(take, F.col("source_id")).otherwise(F.col(c)) if c == "duplicate_of" else F.col(c)).alias(c) for c in jobs.columns])


def trial_copies(jobs: DataFrame, ids: DataFrame, first_id: int) -> DataFrame:
    """New queued copies of the named jobs that point to their sources, which stay as they are."""
    picked = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    new = picked.withColumn("source_job_id", F.col("id")).withColumn("id", F.lit(first_id) + F.col("id")).withColumn("status", F.lit("queued"))
    return jobs.unionByName(new.select(*jobs.columns))


def bulk_action(jobs: DataFrame, requested: DataFrame, owner: str, action: str) -> DataFrame:
    """An action on the requested jobs that belong to the owner."""
    mine = requested.join(jobs.filter(F.col("email") == owner), "id", "left_semi")
    actions = {"cancel": cancel, "retry": retry, "reprocess": retry, "proceed": override_mismatch}
    if action not in actions:
        raise ValueError(f"unknown action {action!r}")
    return actions[action](jobs, mine)


def next_job(jobs: DataFrame) -> DataFrame:
    """The running job, else the first queued one."""
    open_ = jobs.filter(F.col("status").isin("running", "queued"))
    return open_.orderBy((F.col("status") != "running").cast("int"), "created_at", "id").limit(1)


def active_job(jobs: DataFrame) -> DataFrame:
    """The newest active job, else the newest of all."""
    return jobs.orderBy(F.when(F.col("status").isin("running", "queued"), 0).otherwise(1), F.desc("created_at"), F.desc("id")).limit(1)


def in_states(jobs: DataFrame, *states: str) -> DataFrame:
    return jobs.filter(F.col("status").isin(*states)).orderBy("created_at", "id")


def active_batches(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("queued", "running") & F.col("batch_id").isNotNull()).select("batch_id").distinct()


def latest(rows: DataFrame, order: Sequence[str], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page of the newest rows, ``most`` at the utmost (the feature of such lists)."""
    return rows.orderBy(*[F.desc(c) for c in order]).offset(max(0, offset)).limit(min(max(1, limit), most))


def claim_notifications(batches: DataFrame, jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batches with the claims, claimed ones with counts): complete batches without an open job, not yet notified."""
    counts = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status").isin("queued", "running")).alias("open"))
    claimed = batches.filter("upload_complete AND notified_at IS NULL").join(counts, batches["id"] == counts["batch_id"]).filter("open = 0 AND total > 0").select("id", "total", "done", "failed")
    marked = batches.join(claimed.select("id", F.lit(True).alias("_now")), "id", "left")
    return marked.select(*[F.when(F.col("_now"), now).otherwise(F.col(c)).alias(c) if c == "notified_at" else F.col(c) for c in batches.columns]), claimed


def delete_jobs(jobs: DataFrame, files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their files without the named ones; running jobs stay."""
    gone = jobs.join(ids.select("id").distinct(), "id", "left_semi").filter("status <> 'running'").select("id")
    return jobs.join(gone, "id", "left_anti"), files.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")


def child_order(runs: DataFrame, order: str = "created_at") -> DataFrame:
    """Runs with each copy directly after the run it was made from."""
    parents = runs.select(F.col("id").alias("_pid"), F.col(order).alias("_porder"))
    placed = runs.join(parents, runs["source_job_id"] == parents["_pid"], "left")
    root = F.when(F.col("_pid").isNull(), F.col(order)).otherwise(F.col("_porder"))
    return placed.orderBy(F.desc(root), F.coalesce("_pid", "id"), F.col("_pid").isNotNull(), F.desc(order), "id").select(*[runs[c] for c in runs.columns])


def append_log(log: Column, entries: Column) -> Column:
    return F.concat(F.coalesce(log, F.array().cast("array<string>")), entries)
