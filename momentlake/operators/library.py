"""Clip libraries: ownership, unclaimed artifacts, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import fingerprint


def by_owner(clips: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Clips with the job and the user they belong to; newest first is the reader's orderBy."""
    return clips.join(jobs.hint("shuffle_merge"), "job_id").join(users.hint("shuffle_merge"), "user_id")


def unclaimed(artifacts: DataFrame, clips: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Artifacts (subpath, has_clip, has_posts) with both files that no clip row claims, with details (subpath, ...) where known."""
    free = artifacts.where("has_clip and has_posts").join(clips.select("subpath").distinct().hint("shuffle_merge"), "subpath", "left_anti")
    return free if details is None else free.join(details.hint("shuffle_merge"), "subpath", "left")


def pending(inputs: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """inputs with their fingerprint (of the columns) that have no complete result (fingerprint, complete); broken results are done again."""
    marked = inputs.withColumn("fingerprint", fingerprint(F.struct(*columns)))
    done = results.where("complete").select("fingerprint").distinct()
    return marked.join(done.hint("shuffle_merge"), "fingerprint", "left_anti")


def merged_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """One result per fingerprint: new ones before old ones, complete before broken."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = old.columns
    return both.groupBy("fingerprint").agg(F.max_by(F.struct(*columns), F.struct("complete", "_new")).alias("r")).select("r.*")
