"""Live detection on Structured Streaming: rolling windows, pending moments, progressive scouting, log incidents.

Batch and stream share their decisions: the pure functions here take rows in stream-time order and are called by the state handlers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Settings
from ..functions.links import chunk_start
from ..operators.islands import fold_sorted, running_before
from ..operators.scorers import Scorer
from ..scratch import materialize, release
from ..sources.files import POINTER, list_artifacts, read_replaced, replace_table
from .flush import Moment, flush


def live_words(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of words from a growing folder of Parquet or JSON files, with `ts`, the event time."""
    fmt = "json" if path.rstrip("/").endswith(".json") else "parquet"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
    return raw if "ts" in raw.columns else raw.withColumn("ts", F.timestamp_seconds("start"))


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A stream of finished media chunks: path, length and the start time in the name. The writer renames a chunk when it's finished."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "chunk_*.ts").load(path)
    return files.select("path", "length", chunk_start(F.col("path")).alias("ts"))


def finished_chunks(listing: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Of a listing of files (path, length), those whose writer is done with them: all but the newest name of each folder, and that one too if it is as long as in `before`, an earlier listing."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = listing.withColumns({"_name": name, "_folder": F.regexp_extract("path", r"^(.*)/[^/]+$", 1)})
    newest = named.groupBy("_folder").agg(F.max("_name").alias("_newest"))
    rows = named.join(newest.hint("shuffle_merge"), "_folder")
    if before is None:
        return rows.where("_name < _newest").select(*listing.columns)
    known = before.select("path", F.col("length").alias("_length"))
    return rows.join(known.hint("shuffle_merge"), "path", "left").where((F.col("_name") < F.col("_newest")) | F.coalesce(F.col("length") == F.col("_length"), F.lit(False))).select(*listing.columns)


def poll_chunks(path: str, out: str, pattern: str = "chunk_*.ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for writers that don't rename: each trigger lists the folder and appends to out/chunks the chunks that are finished.

    Rows are path, length, ts (from the name) and epoch. The newest chunk of a folder is held back until a newer one appears, or until
    its length stood still from one trigger to the next; each chunk comes once, also if a trigger is repeated. The listing before is a
    replaced table at out/listing.
    """

    def poll(trigger: DataFrame, epoch: int) -> None:
        spark = trigger.sparkSession
        exists = lambda name: _exists(spark, f"{out}/{name}")
        listing = materialize(list_artifacts(spark, path, pattern).select("path", "length"), "listing")
        ready = finished_chunks(listing, read_replaced(spark, f"{out}/listing") if exists(f"listing/{POINTER}") else None)
        if exists("chunks"):
            ready = ready.join(spark.read.parquet(f"{out}/chunks").select("path").hint("shuffle_merge"), "path", "left_anti")
        done = ready.withColumns({"ts": chunk_start(F.col("path")), "epoch": F.lit(epoch).cast("long")})
        done.write.mode("append").parquet(f"{out}/chunks")
        replace_table(listing, f"{out}/listing")
        release(listing)

    return poll


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)  # noqa: SLF001


def rolling_windows(words: DataFrame, settings: Settings = DEFAULTS, watermark: str = "150 seconds") -> DataFrame:
    """Windows of 75 s every 30 s per source (source_id, ts, start, text): win_start, win_end, text, n_words. Works on streams and tables."""
    if words.isStreaming:
        words = words.withWatermark("ts", watermark)
    by = words.groupBy("source_id", F.window("ts", f"{settings.live_window:g} seconds", f"{settings.live_slide:g} seconds"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "word_idx", "text")))
    out = by.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_words"))
    return out.select("source_id", F.unix_timestamp("window.start").cast("double").alias("win_start"), F.unix_timestamp("window.end").cast("double").alias("win_end"), F.col("window.end").alias("ts"), "text", "n_words")


def quiet_sessions(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates (source_id, ts, score) between quiet gaps: session_start, session_end, n, best."""
    s = candidates.groupBy("source_id", F.session_window("ts", f"{settings.quiet_seconds:g} seconds")).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return s.select("source_id", F.unix_timestamp("session_window.start").cast("double").alias("session_start"), F.unix_timestamp("session_window.end").cast("double").alias("session_end"), "n", "best")


def strong_windows(scored: DataFrame, least: float = 60.0) -> DataFrame:
    """Windows exported as they are, without merging."""
    return scored.where(F.col("score") >= least)


class Pending:
    """Candidates of one source that wait for their moment to end."""

    def __init__(self, settings: Settings, rows: list[tuple[float, float, float]] | None = None) -> None:
        self.settings, self.rows = settings, rows or []

    def advance(self, now: float) -> list[tuple[float, float, float]]:
        """The waiting candidates if, at stream time `now`, it has been quiet for 18 s since the last or 90 s since the first; else none."""
        if self.rows and (now - self.rows[-1][1] > self.settings.quiet_seconds or now - self.rows[0][0] > self.settings.max_wait_seconds):
            done, self.rows = self.rows, []
            return done
        return []

    def take(self, start: float, end: float, score: float | None) -> list[tuple[float, float, float]]:
        """A scored window (None or low scores only move the time): what it flushes."""
        if score is not None and score >= self.settings.candidate_threshold:
            self.rows.append((start, end, score))
        return self.advance(end)


FLUSHED = "source_id string, flush_id long, start double, end double, score double"


def _islands(scored: DataFrame, order: list[str], settings: Settings) -> DataFrame:
    """scored with `island`: how many rows of its source before it certainly left nothing waiting.

    A row that is no candidate and ends over the quiet time after the last candidate flushes all that waits, whatever that is. So what
    comes after it doesn't depend on what came before, and islands of one source can be replayed by different tasks.
    """
    candidate = F.coalesce(~F.isnan("score") & (F.col("score") >= settings.candidate_threshold), F.lit(False))
    marked = running_before(scored, ["source_id"], "end", order, "last", F.when(candidate, F.struct("end")), "_last")
    empties = ~candidate & F.coalesce(F.col("end") - F.col("_last.end") > settings.quiet_seconds, F.lit(True))
    return running_before(marked.withColumn("_empties", empties).drop("_last"), ["source_id"], "end", order, "sum", F.col("_empties").cast("long"), "island").drop("_empties")


def _numbered(replayed: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of replayed islands with flushes and clips numbered over the source: prefix sums over the islands' counts, which stand in rows without a start."""
    replayed = materialize(replayed, "islands")
    counts = replayed.where("start is null").select("source_id", "island", "flush_id", "clip_id")
    ahead = running_before(counts, ["source_id"], "island", [], "sum", F.col("flush_id"), "_flushes")
    ahead = running_before(ahead, ["source_id"], "island", [], "sum", F.col("clip_id"), "_clips").select("source_id", "island", "_flushes", "_clips")
    rows = replayed.where("start is not null").join(ahead.hint("shuffle_merge"), ["source_id", "island"])
    placed = rows.withColumns({"flush_id": F.col("flush_id") + F.col("_flushes"), "clip_id": F.col("clip_id") + F.col("_clips")}).drop("island", "_flushes", "_clips")
    return placed if most is None else placed.where(F.col("clip_id") < most)


def pending_moments_batch(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """pending_moments over a table: each source's windows are replayed in end order; what still waits at the end is flushed last.

    Islands of windows (see _islands) are replayed apart and their flushes numbered by prefix sums, so a channel with a third of all
    rows is spread over tasks; only candidates that follow each other without a quiet moment are taken by one. Some jobs run when this
    is called.
    """
    named = scored.select(F.col("source_id").cast("string").alias("source_id"), "start", "end", F.col("score").cast("double").alias("score"))
    rows = _islands(named, ["start", "score"], settings)
    schema = "source_id string, island long, flush_id long, clip_id long, start double, end double, score double"
    return _numbered(fold_sorted(rows, ["source_id", "island"], ["end", "start", "score"], ["start", "end", "score"], lambda: _Replay(settings), _Replay.take, schema, _Replay.finish)).drop("clip_id")


class _Replay:
    """One island's windows in order, and the number of its next flush."""

    def __init__(self, settings: Settings) -> None:
        self.waiting, self.flushes, self.key = Pending(settings), 0, ("", 0)

    def take(self, row: tuple) -> list[tuple]:
        *self.key, start, end, score = row
        return self._done(self.waiting.take(start, end, None if pd.isna(score) else score))

    def _done(self, rows: list[tuple]) -> list[tuple]:
        out = [(*self.key, self.flushes, 0, *r) for r in rows]
        self.flushes += bool(rows)
        return out

    def finish(self) -> list[tuple]:
        return [*self._done(self.waiting.rows), (*self.key, self.flushes, 0, None, None, None)]


MOMENTS = "source_id string, flush_id long, clip_id long, start double, end double, score double, topic string, text string"


class Channel:
    """One source's waiting candidates, and how many flushes and clips it has had."""

    def __init__(self, scorer: Scorer, settings: Settings, most: int | None, waiting: list[Moment] | None = None, flushes: int = 0, clips: int = 0) -> None:
        self.scorer, self.settings, self.most = scorer, settings, most
        self.waiting, self.flushes, self.clips = waiting or [], flushes, clips

    def take(self, row: Moment | None, now: float) -> list[tuple]:
        """A scored window (None only moves the time): the clips that it flushes."""
        if row is not None and row.score >= self.settings.candidate_threshold:
            self.waiting.append(row)
        w, s = self.waiting, self.settings
        return self.flush() if w and (now - w[-1].end > s.quiet_seconds or now - w[0].start > s.max_wait_seconds) else []

    def flush(self) -> list[tuple]:
        """(flush_id, clip_id, start, end, score, topic, text) of what is cut, as long as the source has clips left."""
        rows, self.waiting = self.waiting, []
        if not rows:
            return []
        moments = flush(rows, self.scorer, self.settings)
        moments = moments if self.most is None else moments[: max(0, self.most - self.clips)]
        out = [(self.flushes, self.clips + i, m.start, m.end, m.score, m.topic, m.text) for i, m in enumerate(moments)]
        self.flushes, self.clips = self.flushes + 1, self.clips + len(out)
        return out


def moment(start: float, end: float, score: float | None, topic: str | None, text: str | None) -> Moment | None:
    return None if pd.isna(score) else Moment(float(start), float(end), float(score), topic or "", text or "")


class _ChannelReplay(Channel):
    key: tuple = ("", 0)

    def row(self, row: tuple) -> list[tuple]:
        *self.key, start, end, score, topic, text = row
        return [(*self.key, *r) for r in self.take(moment(start, end, score, topic, text), end)]

    def finish(self) -> list[tuple]:
        last = [(*self.key, *r) for r in self.flush()]
        return [*last, (*self.key, self.flushes, self.clips, None, None, None, None, None)]


def flushed_moments_batch(scored: DataFrame, scorer: Scorer, settings: Settings = DEFAULTS, most: int | None = None) -> DataFrame:
    """flushed_moments over a table: each source's windows are replayed in end order; what still waits at the end is flushed last.

    Islands are replayed apart, as in pending_moments_batch; the cap on a source's clips holds over the numbers that prefix sums give them.
    """
    named = scored.select(F.col("source_id").cast("string").alias("source_id"), "start", "end", F.col("score").cast("double").alias("score"), "topic", "text")
    order = ["start", "score", "topic", "text"]
    schema = MOMENTS.replace("flush_id", "island long, flush_id", 1)
    replayed = fold_sorted(_islands(named, order, settings), ["source_id", "island"], ["end", *order], ["start", "end", "score", "topic", "text"], lambda: _ChannelReplay(scorer, settings, None), _ChannelReplay.row, schema, _ChannelReplay.finish)
    return _numbered(replayed, most)


def recent_chunks(chunks: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` chunks of each source (source_id, ts, path): what a cut can still reach; older media may be deleted."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("path"))
    return chunks.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= keep).drop("_age")


def progressive_windows(windows: DataFrame, settings: Settings = DEFAULTS, lead: float = 30.0) -> DataFrame:
    """From a stream of (source_id, ts, safe_end, start, end): each window once, when its end plus 30 s is below the safe end and enough of the source is known."""
    out = "source_id string, start double, end double"

    def handle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (done,) = state.get if state.exists else (-1.0,)
        rows = pd.concat(list(parts))
        safe = float(rows["safe_end"].max())
        ready = rows[(rows["end"] + lead < safe) & (rows["end"] > done)] if safe >= 2 * settings.window_seconds + lead else rows.iloc[:0]
        if len(ready):
            state.update((float(ready["end"].max()),))
        chosen = ready.drop_duplicates(["start", "end"]).sort_values("end")
        yield pd.DataFrame({"source_id": [key[0]] * len(chosen), "start": chosen["start"].to_numpy(), "end": chosen["end"].to_numpy()})

    return windows.groupBy("source_id").applyInPandasWithState(handle, out, "done double", "append", GroupStateTimeout.NoTimeout)


def live_incidents(lines: DataFrame) -> DataFrame:
    """Incidents of a stream of log lines, row by row."""
    from ..operators.jobs import incidents

    return incidents(lines)


def live_progress(samples: DataFrame) -> DataFrame:
    """From a stream of (job_id, ts, stage_value), the job's progress so far; a job without news for 180 s is reported quiet once the watermark passes."""
    out = "job_id string, overall double, quiet boolean"

    def handle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (best,) = state.get if state.exists else (0.0,)
        if state.hasTimedOut:
            yield pd.DataFrame({"job_id": [key[0]], "overall": [best], "quiet": [True]})
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        best = max(best, float(rows["stage_value"].max()))
        state.update((best,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 180_000)
        yield pd.DataFrame({"job_id": [key[0]], "overall": [best], "quiet": [False]})

    return samples.withWatermark("ts", "10 seconds").groupBy("job_id").applyInPandasWithState(handle, out, "best double", "append", GroupStateTimeout.EventTimeTimeout)


def live_eta(samples: DataFrame, keep: int = 24) -> DataFrame:
    """From a stream of (job_id, ts, stage_value), each sample's job_id, ts, overall and eta: jobs.job_eta over the changes so far."""
    out = "job_id string, ts timestamp, overall double, eta double"

    def handle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, n = state.get if state.exists else ([], [], 0)
        times, values, made = list(times), list(values), []
        for ts, value in pd.concat(list(parts)).sort_values("ts")[["ts", "stage_value"]].itertuples(index=False, name=None):
            overall = max([0.0 if pd.isna(value) else float(value), *values[-1:]])
            t = ts.timestamp()
            if not values or overall != values[-1]:
                times, values, n = [*times, t][-keep:], [*values, overall][-keep:], n + 1
            dt, dp = t - times[0], overall - values[0]
            known = len(values) >= 3 and dt >= 5 and dp >= 2 and overall < 100
            made.append((key[0], ts, overall, float(round((100 - overall) * dt / dp)) if known else None))
        state.update((times, values, n))
        yield pd.DataFrame(made, columns=["job_id", "ts", "overall", "eta"])

    return samples.groupBy("job_id").applyInPandasWithState(handle, out, "times array<double>, shown array<double>, n long", "append", GroupStateTimeout.NoTimeout)


def upsert_results(path: str, key: list[str], parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key the result folder doesn't have yet; a repeated batch adds nothing.

    Results lie in `parts` folders by a hash of the key (column `part`), so a batch reads the keys of its own folders only.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        there = _exists(spark, path)
        new = batch.dropDuplicates(key).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
        if there:
            mine = [r[0] for r in batch.select(F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).distinct().collect()]  # `parts` at most
            known = spark.read.parquet(path).where(F.col("part").isin(mine)).select(*key, "part")
            new = new.join(known.hint("shuffle_merge"), [*key, "part"], "left_anti")
        # One file per folder and batch.
        new.repartition("part").write.mode("append").partitionBy("part").parquet(path)

    return write
