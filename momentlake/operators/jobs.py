"""Job logs: redaction, incidents, progress, errors, alarms, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact_secrets
from ..scratch import once
from .islands import CHUNK_SECONDS, running_before, with_previous

# Ordered rules of a log line's category.
RULES = (
    (r"ProxyError|Unable to connect to proxy|127\.0\.0\.1.*port=9", "network"), (r"ass_read_file|libass track|fopen failed", "captions"), (r"no space left|disk full|not enough space", "disk"),
    (r"429|rate.limit|quota|insufficient.credit|available credits|spending limit|provider credits", "quota"), (r"401|403|invalid.api.key|authenticationerror", "credentials"), (r"cuda|cudnn|cublas|out of memory", "compute"),
    (r"failed|error|exception|traceback|dropping|could not be parsed", "processing"), (r"warning|retry|skipping|fallback", "warning"),
)
RECOVERED = r"\[scout\].*(invalid_candidate|local fallback|local_heat_fallback|ValueError)"
# A stage's share of the whole job's progress.
BANDS = {"audio_pull": (0, 12), "transcribe": (12, 30), "scout": (12, 30), "scan": (30, 50), "review": (50, 55), "ranking": (55, 60), "cut": (60, 80), "layout": (80, 99), "encode": (60, 99), "done": (100, 100)}
# Phrases of lost content, and the ordered keywords of a job's error category.
GAP_PHRASES = ("skipping undecodable chunk", "dropping this window", "dropping all", "failed to finish clip", "failed to cut clip", "ERROR missing batch", "ERROR invalid scoring")
ERROR_WORDS = (
    ("insufficient_credits", ("insufficient credits",)), ("transcript_empty", ("no speech detected",)), ("ffmpeg", ("ffmpeg", "ffprobe")), ("timeout", ("connectionerror", "timeout", "timed out")),
    ("kick_source", ("kick", "streamlink", "m3u8", "playback url")), ("quota", ("429", "rate limit", "quota")), ("unknown", ("traceback",)),
)
PROVIDERS = (("openai", ("openai",)), ("xai", ("x.ai", "xai", "grok")), ("together", ("together", "parakeet")))


def incident(line: Column) -> Column:
    """STRUCT<category, severity, message, action> of a log line, or null: the first rule that matches; recovered scout trouble is a warning."""
    category = F.when(line.rlike(f"(?i){RECOVERED}"), "warning")
    for pattern, name in RULES:
        category = category.when(line.rlike(f"(?i){pattern}"), name)
    message = redact_secrets(line)
    low = F.lower(line)
    who = None
    for name, words in PROVIDERS:
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        who = F.when(hit, name) if who is None else who.when(hit, name)
    action = F.when(category == "credentials", F.concat(F.lit("check the key of "), F.coalesce(who, F.lit("the provider")))).otherwise(F.concat(F.lit("check "), category))
    return F.when(category.isNotNull(), F.struct(category.alias("category"), F.when(category == "warning", "warning").otherwise("error").alias("severity"), F.substring(message, F.greatest(F.lit(1), F.length(message) - 1199), F.lit(1200)).alias("message"), action.alias("action")))


def recovered(message: Column) -> Column:
    """Whether the scout got over what a message tells of; such messages are never collapsed."""
    return message.rlike(f"(?i){RECOVERED}")


def incidents(lines: DataFrame) -> DataFrame:
    """Incidents of log lines (job_id, event_id, line)."""
    return lines.withColumn("i", incident(F.col("line"))).where("i is not null").select("job_id", "event_id", "i.*")


def collapsed_incidents(found: DataFrame, last: int = 100, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """Runs of equal messages as one row with count; the last 100 runs of each job. What recovered by itself is never collapsed.

    Runs are found within chunks of ids; of each chunk only the first and the last run can go on over its bounds, and these are joined
    over one row per chunk.
    """
    rows = found.withColumn("_chunk", F.floor(F.col("event_id").cast("double") / chunk))
    inside = Window.partitionBy("job_id", "_chunk").orderBy("event_id")
    fresh = F.coalesce(F.lag("message").over(inside) != F.col("message"), F.lit(True)) | recovered(F.col("message"))
    numbered = rows.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(inside))
    runs = numbered.groupBy("job_id", "_chunk", "_run").agg(F.min("event_id").alias("event_id"), F.count("*").alias("count"), F.first("category").alias("category"), F.first("severity").alias("severity"), F.first("message").alias("message"))
    edges = runs.groupBy("job_id", "_chunk").agg(F.max("_run").alias("_runs"), F.min_by("message", "_run").alias("_head"), F.max_by(F.struct("message", "event_id"), "_run").alias("_tail"))
    chunks = Window.partitionBy("job_id").orderBy("_chunk")
    goes_on = F.coalesce((F.lag("_tail").over(chunks)["message"] == F.col("_head")) & ~recovered(F.col("_head")), F.lit(False))
    edges = edges.withColumn("_goes_on", goes_on)
    opener = F.when(~F.col("_goes_on") | (F.col("_runs") > 1), F.col("_tail.event_id"))
    edges = edges.select("job_id", "_chunk", "_goes_on", F.last(opener, ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_opener"))
    joined = runs.join(edges.hint("shuffle_merge"), ["job_id", "_chunk"]).withColumn("_first", F.when((F.col("_run") == 1) & F.col("_goes_on"), F.col("_opener")).otherwise(F.col("event_id")))
    whole = joined.groupBy("job_id", "_first").agg(F.sum("count").alias("count"), F.first("category").alias("category"), F.first("severity").alias("severity"), F.first("message").alias("message")).withColumnRenamed("_first", "event_id")
    order = Window.partitionBy("job_id").orderBy(F.desc("event_id"))
    return whole.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last).drop("_n")


def parse_progress(line: Column) -> Column:
    """STRUCT<stage, pct, eta, minutes> of `PROGRESS stage pct [eta_seconds n]` or `PROGRESS estimate minutes`; null for other lines."""
    estimate = F.regexp_extract(line, r"^PROGRESS\s+estimate\s+([0-9.]+)", 1)
    stage, pct = F.regexp_extract(line, r"^PROGRESS\s+(\S+)\s+-?\d+(\s|$)", 1), F.regexp_extract(line, r"^PROGRESS\s+\S+\s+(-?\d+)(\s|$)", 1)
    eta = F.regexp_extract(line, r"^PROGRESS\s+\S+\s+-?\d+\s+eta_seconds\s+(\d+)", 1)
    number = lambda c, t: F.when(c != "", c).try_cast(t)
    return F.when(estimate != "", F.struct(F.lit(None).cast("string").alias("stage"), F.lit(None).cast("int").alias("pct"), F.lit(None).cast("int").alias("eta"), number(estimate, "double").alias("minutes"))).when(
        (stage != "") & (stage != "estimate"), F.struct(stage.alias("stage"), number(pct, "int").alias("pct"), number(eta, "int").alias("eta"), F.lit(None).cast("double").alias("minutes"))
    )


def overall_progress(samples: DataFrame) -> DataFrame:
    """samples (job_id, t, seq, stage, pct) with overall: the stage's band filled by pct, never falling; an unknown stage keeps the value so far."""
    p = F.greatest(F.lit(0), F.least(F.lit(100), F.col("pct")))
    mapped = None
    for stage, (a, b) in BANDS.items():
        value = F.least(F.lit(100.0), F.bround(a + (b - a) * p / 100))
        mapped = F.when(F.col("stage") == stage, value) if mapped is None else mapped.when(F.col("stage") == stage, value)
    rows = samples.withColumn("_mapped", mapped)
    before = running_before(rows, ["job_id"], "t", ["seq"], "max", F.col("_mapped"), "_so_far")
    return before.withColumn("overall", F.coalesce(F.greatest("_so_far", "_mapped"), F.lit(0.0))).drop("_so_far", "_mapped")


def job_eta(progress: DataFrame, keep: int = 24) -> DataFrame:
    """overall_progress rows with eta: seconds left by the movement over the last 24 changes; null before 3 changes, 5 s and 2 points, and at 100."""
    prev = with_previous(progress, ["job_id"], "t", ["seq"], ["overall"])
    marked = prev.withColumn("_changed", F.coalesce(F.col("prev.overall") != F.col("overall"), F.lit(True)))
    counted = running_before(marked, ["job_id"], "t", ["seq"], "sum", F.col("_changed").cast("long"), "_n").withColumn("_n", F.col("_n") + F.col("_changed").cast("long"))
    counted = once(counted)
    changes = counted.where("_changed").select("job_id", F.col("_n").alias("_first"), F.col("t").alias("_t0"), F.col("overall").alias("_p0"))
    joined = counted.withColumn("_first", F.greatest(F.lit(1), F.col("_n") - (keep - 1))).join(changes.hint("shuffle_merge"), ["job_id", "_first"], "left")
    dt, dp = F.col("t") - F.col("_t0"), F.col("overall") - F.col("_p0")
    eta = F.when((F.least(F.col("_n"), F.lit(keep)) >= 3) & (dt >= 5) & (dp >= 2) & (F.col("overall") < 100), F.bround((100 - F.col("overall")) * dt / dp))
    return joined.withColumn("eta", eta).drop("prev", "_changed", "_n", "_first", "_t0", "_p0")


def recent_rate_eta(samples: DataFrame, rows: int = 8) -> DataFrame:
    """samples (job_id, t, processed, total) with eta by the rate over the last 8 samples; null without progress."""
    order = Window.partitionBy("job_id").orderBy("t").rowsBetween(-(rows - 1), 0)
    dt, dp = F.col("t") - F.first("t").over(order), F.col("processed") - F.first("processed").over(order)
    return samples.withColumn("eta", F.when((dt > 0) & (dp > 0), F.bround((F.col("total") - F.col("processed")) * dt / dp, 1)))


def content_gaps(lines: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for p in GAP_PHRASES:
        hit = hit | F.contains("line", F.lit(p))
    return lines.groupBy("job_id").agg(F.bool_or(hit).alias("content_gaps"))


def error_category(lines: DataFrame, last: int = 200) -> DataFrame:
    """Per job the first category of which a keyword stands in its last 200 lines; empty if none does."""
    order = Window.partitionBy("job_id").orderBy(F.desc("event_id"))
    tail = lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last).withColumn("_low", F.lower("line"))
    flags, chosen = [], None
    for name, words in ERROR_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains("_low", F.lit(w))
        flags.append(F.bool_or(hit).alias(name))
        chosen = F.when(F.col(name), name) if chosen is None else chosen.when(F.col(name), name)
    return tail.groupBy("job_id").agg(*flags).select("job_id", chosen.otherwise("").alias("error_category"))


def retryable_exports(lines: DataFrame, longest: float = 600.0) -> DataFrame:
    """Failed exports that can be tried again (a report): job_id, target, trim_start, duration; each target once, from its first line."""
    failed = lines.where(F.contains("line", F.lit("failed to finish clip")) & F.contains("line", F.lit("Command '")))
    args = F.regexp_extract_all(F.regexp_extract("line", r"Command '(.*)' returned", 1), F.lit(r"'([^']*)'"), F.lit(1))
    after = lambda flag: F.get(F.col("args"), F.array_position("args", flag).cast("int"))
    rows = failed.select("job_id", "event_id", args.alias("args")).where(F.size("args") > 0)
    rows = rows.select("job_id", "event_id", F.element_at("args", -1).alias("target"), after("-ss").try_cast("double").alias("trim_start"), after("-t").try_cast("double").alias("duration"))
    good = rows.where((F.col("trim_start") >= 0) & (F.col("duration") > 0) & (F.col("duration") <= longest))
    return good.groupBy("job_id", "target").agg(F.min_by(F.struct("trim_start", "duration"), "event_id").alias("c")).select("job_id", "target", "c.*")


def monitor(lines: DataFrame, tokens: str = "error|traceback|checkpoint") -> DataFrame:
    """Lines worth showing, and those at which a job's `running` turned false: job_id, event_id, line, stopped."""
    at = lines.withColumn("_at", F.col("event_id").cast("double"))
    prev = with_previous(at, ["job_id"], "_at", ["event_id"], ["running"])
    stopped = F.coalesce(F.col("prev.running") & ~F.col("running"), F.lit(False))
    return prev.withColumn("stopped", stopped).where(F.col("line").rlike(f"(?i){tokens}") | F.col("stopped")).select("job_id", "event_id", "line", "stopped")


def export_summary(exports: DataFrame) -> DataFrame:
    """Per job: attempted, succeeded, failed, complete."""
    good = F.count_if(F.col("ok"))
    return exports.groupBy("job_id").agg(F.count("*").alias("attempted"), good.alias("succeeded"), (F.count("*") - good).alias("failed"), (F.count("*") == good).alias("complete"))


def failure_alarm(chunks: DataFrame, share: float = 0.15, least: int = 10) -> DataFrame:
    """Jobs of which over 15 % of at least 10 chunks failed."""
    counted = chunks.groupBy("job_id").agg(F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("failed"))
    return counted.where((F.col("seen") >= least) & (F.col("failed") > share * F.col("seen")))


def running_limits(jobs: DataFrame, soft: int = 3, hard: int = 8) -> DataFrame:
    """Per user: running jobs, verdict (ok, soft or hard), and whether two run on one channel."""
    running = jobs.where(F.col("status").isin("running", "queued", "resolving_source"))
    per = running.groupBy("user_id", "channel").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("running"), (F.max("n") > 1).alias("channel_conflict")).withColumn("verdict", F.when(F.col("running") >= hard, "hard").when(F.col("running") >= soft, "soft").otherwise("ok"))


def expired_artifacts(artifacts: DataFrame, now: Column, days: int) -> DataFrame:
    """Artifacts of customers in their media folders older than the days kept, one at least (a report; nothing is deleted)."""
    old = F.unix_timestamp("mtime") < F.unix_timestamp(now) - max(1, days) * 86400
    return artifacts.where(F.col("path").rlike(r"(^|/)u[^/]*/(vod|vod_stream|live|_uploads)/[^/]+$") & old)


def export_recipe_errors() -> Column:
    """What is wrong with an edit recipe; empty for a good one."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    overlay = F.coalesce("overlay_seconds", F.lit(3.0))
    return F.array_compact(F.array(
        F.when(~(finite("start") & finite("end")) | F.isnan(overlay) | (F.abs(overlay) == float("inf")), "not finite"), F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "bad span"), F.when((overlay < 0) | (overlay > 60), "bad overlay"),
        F.when(~F.coalesce(F.col("aspect").isin("9:16", "16:9", "1:1", "4:3", "4:5"), F.lit(False)), "bad aspect"), F.when(~F.coalesce(F.col("track").isin("off", "auto", "lock"), F.lit(False)), "bad track"),
        F.when(~F.coalesce(F.col("layout").isin("follow", "center", "split2"), F.lit(False)), "bad layout"), F.when(F.col("captions_enabled").isNull(), "bad captions"), F.when(F.length(F.coalesce("overlay_text", F.lit(""))) > 160, "long overlay"),
    ))
