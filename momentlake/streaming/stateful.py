"""Channels, jobs and accounts that remember: processors with keyed state and event-time timers.

State lies in Spark's RocksDB store, a key's rows of one micro-batch are handled together, and timers fire once the watermark has
passed them. What a processor decides is plain code that the batch operators use too. Processors take and give rows: a data frame per
key would cost more than the few rows it holds, and so would a call of the state store per row. Only ledgers, whose accounts are many
and have few events each, deal accounts into groups and take a group's events as a frame.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Settings
from ..operators.jobs import incidents, recovered
from ..operators.ledger import LEDGER, Account
from ..operators.scorers import Scorer
from .flush import Moment
from .live import FLUSHED, MOMENTS, Channel, Pending, moment

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a session that names another keeps what it names."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _names(schema: str) -> list[str]:
    return [f.split()[0].strip("`") for f in schema.split(", ")]


class Keyed(StatefulProcessor):
    """A processor with one timer per key; `schema` is that of its rows, of which the key is the first column."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def made(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        row = Row(*_names(self.schema))
        return (row(key[0], *r) for r in rows)

    def wake(self, before: int | None, seconds: float | None) -> int | None:
        """The key's only timer: just after this time, or none. `before` is the one that is set, which only this changes; gives the one set now."""
        return self.ring(before, None if seconds is None else int(seconds * 1000) + 1)

    def ring(self, before: int | None, at: int | None) -> int | None:
        """As wake, at this millisecond."""
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        return at


def _by(*fields: str) -> Callable[[Row], tuple]:
    """Order by these fields, nulls first."""
    return lambda r: tuple((r[f] is not None, r[f]) if r[f] is not None else (False,) for f in fields)


def _now(timers) -> float:
    return timers.getCurrentWatermarkInMs() / 1000


def _due(waiting: list, settings: Settings) -> float | None:
    """When what waits is flushed if nothing more comes: quiet since the last end, or too long since the first start."""
    row = lambda r: (r.start, r.end) if isinstance(r, Moment) else r[:2]
    return min(row(waiting[-1])[1] + settings.quiet_seconds, row(waiting[0])[0] + settings.max_wait_seconds) if waiting else None


class _PendingMoments(Keyed):
    schema = FLUSHED

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "start double, end double, score double")
        # Outlives every flush, so that a channel that falls silent and comes back goes on counting.
        self.flushes = handle.getValueState("flushes", "n long, wake long, held boolean")

    def _run(self, key: tuple, timers, rows: list[tuple], rang: bool = False) -> Iterator[Row]:
        n, wake, held = self.flushes.get() or (0, None, False)
        pending, out = Pending(self.settings, [tuple(r) for r in self.waiting.get()] if held else []), []
        # The watermark is stream time that has passed before these rows came.
        for take in [lambda: pending.advance(_now(timers)), *[lambda r=r: pending.take(*r) for r in rows]]:
            done = take()
            out += [(n, *r) for r in done]
            n += bool(done)
        if pending.rows:
            self.waiting.put(pending.rows)
        elif held:
            self.waiting.clear()
        # Spark takes away a timer that has rung.
        self.flushes.update((n, self.wake(None if rang else wake, _due(pending.rows, self.settings)), bool(pending.rows)))
        return self.made(key, out)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = [(r["start"], r["end"], None if r["score"] is None or r["score"] != r["score"] else r["score"]) for r in sorted(rows, key=_by("end", "start", "score"))]
        return self._run(key, timerValues, known)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._run(key, timerValues, [], rang=True)


class _FlushedMoments(Keyed):
    schema = MOMENTS

    def __init__(self, scorer: Scorer, settings: Settings, most: int | None) -> None:
        self.scorer, self.settings, self.most = scorer, settings, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "start double, end double, score double, topic string, text string")
        self.counts = handle.getValueState("counts", "flushes long, clips long, wake long")

    def _run(self, key: tuple, timers, rows: list[tuple], rang: bool = False) -> Iterator[Row]:
        flushes, clips, wake = self.counts.get() or (0, 0, None)
        channel = Channel(self.scorer, self.settings, self.most, [Moment(*r) for r in self.waiting.get()], flushes, clips)
        out = channel.take(None, _now(timers))
        for r in rows:
            out += channel.take(moment(*r), float(r[1]))
        w = channel.waiting
        self.waiting.put([(m.start, m.end, m.score, m.topic, m.text) for m in w]) if w else self.waiting.clear()
        self.counts.update((channel.flushes, channel.clips, self.wake(None if rang else wake, _due(w, self.settings))))
        return self.made(key, out)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = sorted(rows, key=_by("end", "start", "score", "topic", "text"))
        return self._run(key, timerValues, [(r["start"], r["end"], r["score"], r["topic"], r["text"]) for r in came])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._run(key, timerValues, [], rang=True)


def pending_moments(scored: DataFrame, settings: Settings = DEFAULTS, watermark: str = "150 seconds") -> DataFrame:
    """Flushed groups of candidates from a stream of scored windows (source_id, ts, start, end, score): source_id, flush_id, start, end, score.

    Rows of a micro-batch are taken by end, start and score; windows without a score must come too, for they move the stream's time. The
    watermark moves it as well: a channel of which nothing more comes is flushed when the watermark has passed its last end by the quiet
    time, or its first start by the maximal wait. Flushes are numbered over the channel's whole life.
    """
    use_rocksdb(scored.sparkSession)
    return scored.withWatermark("ts", watermark).groupBy("source_id").transformWithState(_PendingMoments(settings), FLUSHED, "Append", "EventTime")


def flushed_moments(scored: DataFrame, scorer: Scorer, settings: Settings = DEFAULTS, most: int | None = None, watermark: str = "150 seconds") -> DataFrame:
    """Clips of a stream of scored windows (source_id, ts, start, end, score, topic, text), at most `most` per source over its life.

    Candidates wait as in pending_moments; a flush groups them, scores the groups' texts anew, decides between merged moment, peak
    and nothing, and takes repeats out, best first. Re-scoring runs inside the processor, so the scorer should answer fast.
    """
    use_rocksdb(scored.sparkSession)
    return scored.withWatermark("ts", watermark).groupBy("source_id").transformWithState(_FlushedMoments(scorer, settings, most), MOMENTS, "Append", "EventTime")


# --- incidents ----------------------------------------------------------------------------------------------

_RUN = "run long, event_id long, count long, category string, severity string, message string"


class _Runs(Keyed):
    def __init__(self, last: int, key_type: str) -> None:
        self.last, self.schema = last, f"job_id {key_type}, {_RUN}, gone boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", _RUN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ring = [list(r) for r in self.ring.get()]
        changed: dict[int, tuple] = {}
        came = sorted(rows, key=_by("event_id"))
        for event, category, severity, message, alone in ((r["event_id"], r["category"], r["severity"], r["message"], r["alone"]) for r in came):
            if ring and ring[-1][5] == message and not alone:
                ring[-1][2] += 1
            else:
                ring.append([ring[-1][0] + 1 if ring else 0, event, 1, category, severity, message])
            changed[ring[-1][0]] = (*ring[-1], False)
            if len(ring) > self.last:
                old = ring.pop(0)
                changed[old[0]] = (*old, True)
        self.ring.put([tuple(r) for r in ring])
        return self.made(key, list(changed.values()))


def live_collapsed_incidents(lines: DataFrame, last: int = 100) -> DataFrame:
    """From a stream of log lines (job_id, event_id, line), runs of equal messages: job_id, run (0, 1, ...), event_id (its first), count, category, severity, message, gone.

    Each job keeps its last runs in a ring. A micro-batch emits the runs that it began or lengthened, as they are after it, and with
    `gone` those that fell out of the ring; a sink that upserts by job and run holds the ring (see current_runs). Lines of a job are
    taken by event id within a micro-batch and must not come before those of an earlier one. What recovered by itself is never collapsed.
    """
    use_rocksdb(lines.sparkSession)
    found = incidents(lines).withColumn("alone", recovered(F.col("message")))
    processor = _Runs(last, dict(lines.dtypes)["job_id"])
    return found.groupBy("job_id").transformWithState(processor, processor.schema, "Append", "None")


def current_runs(emitted: DataFrame) -> DataFrame:
    """What live_collapsed_incidents has emitted so far, as each job's ring stands now."""
    newest = emitted.groupBy("job_id", "run").agg(F.max_by(F.struct("event_id", "count", "category", "severity", "message", "gone"), F.struct("gone", "count")).alias("r"))
    return newest.select("job_id", "run", "r.*").where(~F.col("gone")).drop("gone")


# --- late words ---------------------------------------------------------------------------------------------

_VIEW = "kind string, revision long, win_start double, win_end double, text string, n_words long"


class _Words(Keyed):
    def __init__(self, settings: Settings, lateness: float, key_type: str) -> None:
        self.settings, self.lateness, self.schema = settings, lateness, f"source_id {key_type}, {_VIEW}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffer = handle.getListState("words", "start double, word_idx long, text string")
        self.mark = handle.getValueState("mark", "mark double, revision long, late long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        length, slide = self.settings.live_window, self.settings.live_slide
        mark, revision, late = self.mark.get() or (float("-inf"), 0, 0)
        came = sorted((r["start"], r["word_idx"], r["text"] or "") for r in rows)
        on_time = [w for w in came if w[0] >= mark - self.lateness]
        out = [("late", revision, w[0], w[0], w[2], late + i + 1) for i, w in enumerate(w for w in came if w[0] < mark - self.lateness)]
        words = sorted([*map(tuple, self.buffer.get()), *on_time])
        now = max([mark, *[w[0] for w in on_time]])
        spans = lambda at: range(int((at - length) // slide) + 1, int(at // slide) + 1)  # noqa: E731  windows that hold a time
        fresh = {k for w in on_time for k in spans(w[0])}
        held: dict[int, list[str]] = {}
        for w in words:
            for k in spans(w[0]):
                # Windows that have just closed, and closed ones that a late word changes.
                if k * slide + length <= now and (k * slide + length > mark or k in fresh):
                    held.setdefault(k, []).append(w[2])
        out += [("window", revision, float(k * slide), float(k * slide + length), " ".join(texts), len(texts)) for k, texts in sorted(held.items())]
        # A word that may still come can change a window that began a window's length before it.
        kept = [w for w in words if w[0] >= now - self.lateness - length]
        self.buffer.put(kept) if kept else self.buffer.clear()
        self.mark.update((now, revision + 1, late + len(came) - len(on_time)))
        return self.made(key, out)


def buffered_windows(words: DataFrame, settings: Settings = DEFAULTS, lateness: float = 150.0) -> DataFrame:
    """From a stream of words (source_id, start, word_idx, text): source_id, kind, revision, win_start, win_end, text, n_words.

    Rows of kind `window` are sliding windows that closed, or that a late word changed after that; the highest revision of a window is
    how it stands (see latest_windows). Rows of kind `late` are words that came more than `lateness` seconds behind the latest word of
    their source in earlier micro-batches: they change nothing and are meant for a side table; n_words counts the source's late words.
    A source's buffer holds the words of `lateness` seconds and one window's length; older ones are dropped from its state.
    """
    use_rocksdb(words.sparkSession)
    processor = _Words(settings, lateness, dict(words.dtypes)["source_id"])
    return words.groupBy("source_id").transformWithState(processor, processor.schema, "Append", "None")


def latest_windows(emitted: DataFrame) -> DataFrame:
    """Of what buffered_windows has emitted, each window as it stands: source_id, win_start, win_end, text, n_words."""
    newest = emitted.where("kind = 'window'").groupBy("source_id", "win_start").agg(F.max_by(F.struct("win_end", "text", "n_words"), "revision").alias("w"))
    return newest.select("source_id", "win_start", "w.*")


def late_words(emitted: DataFrame) -> DataFrame:
    """Of what buffered_windows has emitted, the words that came too late: source_id, start, text."""
    return emitted.where("kind = 'late'").select("source_id", F.col("win_start").alias("start"), "text")


# --- ledger -------------------------------------------------------------------------------------------------

#: So many of an account's jobs lie in its group's one value; of more, those that have come to an end longest ago lie in a map.
RECENT_JOBS = 256
#: Accounts are dealt into so many groups; a group's accounts are read and written together.
ACCOUNT_GROUPS = 2048


class _Ledger(Keyed):
    """A group of accounts. Its state is a few texts: a call of the state store costs as much as dozens of accounts in one of them."""

    def __init__(self, recent: int = RECENT_JOBS) -> None:
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # [[account_id, balance, held, how many jobs lie in the map, [[job_id, hold, status], ...]], ...]
        self.accounts = handle.getValueState("accounts", "accounts string")
        # Each a list of events as they came, whose fields are texts or null.
        self.waiting = handle.getListState("waiting", "events string")
        self.clock = handle.getValueState("clock", "wake long")
        self.jobs = handle.getMapState("jobs", "account_id string, job_id long", "hold double, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [(int(r["at"].min()), r["event"].tolist()) for r in rows]
        self.waiting.appendValue((f"[{','.join(chain.from_iterable(events for _, events in came))}]",))
        first, wake = min(at for at, _ in came), (self.clock.get() or (None,))[0]
        if first <= timerValues.getCurrentWatermarkInMs() * 1000:
            return self._settle(timerValues, wake)
        if wake is None or first // 1000 + 1 < wake:
            self.clock.update((self.ring(wake, first // 1000 + 1),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return self._settle(timerValues, None)  # Spark takes away a timer that has rung

    def _settle(self, timers, wake: int | None) -> Iterator[pd.DataFrame]:
        """Apply, in order of time, the events that the watermark has passed; later ones wait, for an earlier one may still come."""
        events: dict[tuple, list] = {}
        for e in chain.from_iterable(json.loads(r[0]) for r in self.waiting.get()):
            events.setdefault((e[0], e[2]), e)
        now = timers.getCurrentWatermarkInMs() * 1000
        ready, wait = [], []
        for e in events.values():
            (ready if int(e[1]) <= now else wait).append(e)
        ready.sort(key=lambda e: (int(e[1]), e[2] is not None, int(e[2] or 0)))
        stored = self.accounts.get()
        accounts = {a: rest for a, *rest in json.loads(stored[0])} if stored else {}
        touched: dict[str | None, Account] = {}
        out = []
        for e in ready:
            account = touched.get(e[0])
            if account is None:
                balance, held, older, jobs = accounts.get(e[0]) or (0.0, 0.0, 0, [])
                account = touched[e[0]] = Account(balance, held, _Jobs(self.jobs, jobs, older, (e[0],)))
            out += [(e[0], *row) for row in account.apply(*_event(e))]
        for a, account in touched.items():
            accounts[a] = (account.balance, account.held, *account.jobs.parted(self.recent))
        if touched:
            self.accounts.update((_text([(a, *rest) for a, rest in accounts.items()]),))
        self.waiting.put([(_text(wait),)]) if wait else self.waiting.clear()
        self.clock.update((self.ring(wake, min(int(e[1]) for e in wait) // 1000 + 1 if wait else None),))
        return iter([_ledger_frame(out)] if out else [])


def _text(values: list) -> str:
    return json.dumps(values, separators=(",", ":"))


def _event(e: list) -> tuple:
    """What Account.apply takes, of an event's texts; what isn't a number is unknown."""
    whole = lambda x: None if x is None else int(x)
    number = lambda x: None if x is None or x == "NaN" else float(x)
    _, _, event_id, kind, job, amount, kept, crashed, capture_amount = e
    return whole(event_id), kind, whole(job), number(amount), whole(kept), None if crashed is None else crashed == "true", number(capture_amount)


def _ledger_frame(rows: list[tuple]) -> pd.DataFrame:
    """Whole numbers stay exact beside nulls."""
    names = ["account_id", *_names(LEDGER)]
    return pd.DataFrame({n: pd.Series(c, dtype="float64" if n in ("amount", "balance", "held") else object) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


class _Jobs:
    """The jobs of an account, as a mapping over the recent ones in its value and the older ones in a map state, where their keys begin with `key`."""

    def __init__(self, state, recent: list, older: int, key: tuple = ()) -> None:
        self.state, self.older, self.key, self.recent = state, older, key, {job: (hold, status) for job, hold, status in recent}

    def get(self, job: int) -> tuple | None:
        if job in self.recent or not self.older:
            return self.recent.get(job)
        found = self.state.getValue((*self.key, job))
        return None if found is None else tuple(found)

    def __setitem__(self, job: int, value: tuple) -> None:
        self.recent.pop(job, None)
        self.recent[job] = value

    def parted(self, most: int) -> tuple[int, list[tuple]]:
        """How many jobs the map holds and the rest, once the oldest of more than `most` have gone to it."""
        if len(self.recent) > most:
            for job in list(self.recent)[: len(self.recent) - most // 2]:
                self.state.updateValue((*self.key, job), self.recent.pop(job))
                self.older += 1
        return self.older, [(job, *value) for job, value in self.recent.items()]


def live_ledger(events: DataFrame, watermark: str = "150 seconds", groups: int = ACCOUNT_GROUPS) -> DataFrame:
    """Ledger rows of a stream of account events (see ledger.replay for their columns, and `ts`): account_id, event_id, job_id, kind, amount, balance, held.

    Events wait until the watermark has passed them and are applied in order of ts and event_id, so their order of arrival doesn't
    matter within the watermark; those that come behind it are dropped by Spark. Repeated events change nothing: waiting ones are known
    by their event_id, applied ones by what their job has come to.

    Accounts are dealt into `groups` by their hash, for a stream's whole life. A micro-batch reads and writes the groups whose events it
    settles, whole but for older jobs: take about as many as there are thousands of accounts, and not fewer than tasks.
    """
    use_rocksdb(events.sparkSession)
    kind, account = events.schema["account_id"].dataType, F.col("account_id")
    binary = kind.typeName() == "binary"  # not every one is a text
    text = lambda c: F.col(c).cast("string")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    number = lambda c: F.col(c).cast("double").cast("string")
    event = F.to_json(F.array(F.hex(account) if binary else text("account_id"), at.cast("string"), text("event_id"), "kind", text("job_id"), number("amount"), text("kept"), text("crashed"), number("capture_amount")))
    dealt = events.withWatermark("ts", watermark).select(F.pmod(F.hash(account), F.lit(groups)).alias("group_id"), "ts", at.alias("at"), event.alias("event"))
    rows = dealt.groupBy("group_id").transformWithStateInPandas(_Ledger(), f"account_id string, {LEDGER}", "Append", "EventTime")
    return rows.withColumn("account_id", F.unhex(account) if binary else account.cast(kind))


def ordered_runs(streams: list[DataFrame], make: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """What a stateful stream has written once each of the tables has arrived and been worked off, one after the other, restarting between them.

    Arrivals, results and checkpoints lie under root. Meant for replays and checks: each run takes all that is new as one micro-batch.
    """
    spark = streams[0].sparkSession
    for i, rows in enumerate(streams):
        rows.write.parquet(f"{root}/in/{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        run = make(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(make(stream).schema).parquet(f"{root}/out")
