"""Holds of accounts of any size, and account events as batch and stream."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from momentlake.operators import ledger
from momentlake.streaming import stateful

HOLDS = "account_id string, hold_id long, amount double"


def plain(holds, accounts):
    left, out = dict(accounts), {}
    for a, h, amount in sorted(holds, key=lambda r: r[1]):
        have = left.get(a, 0.0) or 0.0
        ok = amount is not None and amount == amount and round(amount * 1e6) <= round(have * 1e6)
        left[a] = round(have * 1e6 - (round(amount * 1e6) if ok else 0)) / 1e6
        out[h] = (ok, left[a])
    return out


def holds_of(rng, n):
    """A third of all holds are of one account; amounts from tenths to more than any balance, some equal, zero or unknown."""
    kinds = [lambda: rng.randrange(1, 30) / 10, lambda: float(rng.randrange(1, 400)), lambda: rng.choice([0.0, 64.0, 128.0, 256.0]), lambda: rng.choice([None, float("nan"), 1e9])]
    return [("hot" if i % 3 == 0 else f"a{i % 9}" if i % 2 else f"s{i % 200}", i, rng.choices(kinds, [5, 3, 1, 0.3])[0]()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_large_accounts_equal_small_ones(spark, seed):
    rng = random.Random(seed)
    rows = holds_of(rng, 3_000)
    accounts = [("hot", 5000.3), *[(f"a{i}", float(rng.randrange(-5, 2000))) for i in range(8)], ("s1", None)]
    holds, opening = spark.createDataFrame(rows, HOLDS).repartition(5), spark.createDataFrame(accounts, "account_id string, balance double")
    want = plain(rows, accounts)
    for large in (10**9, 100):
        got = {r["hold_id"]: (r["accepted"], r["balance"]) for r in ledger.accept_holds(holds, opening, large).collect()}
        assert got == want
    assert sum(ok for ok, _ in want.values()) > 200


def test_adverse_amounts(spark):
    """Powers of two going down, holds that only just fail, and balances that are used up exactly."""
    rows = [("p", i, float(2 ** (20 - i))) for i in range(21)] + [("p", 100 + i, 1.0) for i in range(40)] + [("q", 200 + i, 100.0 - i * 0.999999) for i in range(90)] + [("z", 300 + i, 0.0) for i in range(30)] + [("n", 400 + i, 5.0 if i % 2 else -5.0) for i in range(30)]
    accounts = [("p", float(2**20 + 2**19 + 7)), ("q", 100.0), ("z", 0.0), ("n", 3.0)]
    got = {r["hold_id"]: (r["accepted"], r["balance"]) for r in ledger.accept_holds(spark.createDataFrame(rows, HOLDS), spark.createDataFrame(accounts, "account_id string, balance double"), 20).collect()}
    assert got == plain(rows, accounts)


def test_large_account_is_spread(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("account_id"), F.col("id").alias("hold_id"), (F.col("id") % 7 + 1).cast("double").alias("amount"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        out = ledger.accept_holds(rows, spark.createDataFrame([("hot", 30_000.0)], "account_id string, balance double"), 1_000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan  # of the small accounts, here none
        assert out.where("accepted").agg(F.sum("amount")).first()[0] <= 30_000 and out.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    none = spark.createDataFrame([], HOLDS)
    assert ledger.accept_holds(none, spark.createDataFrame([], "account_id string, balance double"), 0).count() == 0


EVENTS = "account_id string, t double, event_id long, kind string, job_id long, amount double, kept long, crashed boolean, capture_amount double"


def account_events(rng, accounts=4, jobs=40):
    rows, n = [], 0
    for a in range(accounts):
        rows.append((f"a{a}", 1000.0, n, "purchase", 10_000 + a, float(rng.randrange(100, 900)), None, None, None))
        n += 1
        for j in range(jobs):
            job, at = a * 1000 + j, 1010.0 + j * 40 + a
            rows.append((f"a{a}", at, n, "hold", job, float(rng.randrange(1, 80)), None, None, None))
            if rng.random() < 0.9:
                rows.append((f"a{a}", at + rng.randrange(1, 200), n + 1, "finish", job, None, rng.randrange(3), rng.random() < 0.3, rng.choice([None, 10.0, 500.0])))
            n += 2
    return rows


def test_stream_of_repeated_and_reordered_events_gives_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = account_events(rng)
    # Each event comes up to 100 s late, and a fifth of them again later.
    arrivals = [(r[1] + rng.uniform(0, 100), r) for r in rows] + [(r[1] + rng.uniform(0, 500), r) for r in rows if rng.random() < 0.2]
    arrivals.sort(key=lambda x: x[0])
    end = [("clock", 50_000.0, 10**6, "purchase", 10**6, 1.0, None, None, None)]
    parts = [arrivals[i * len(arrivals) // 4 : (i + 1) * len(arrivals) // 4] for i in range(4)] + [[(0, e) for e in end]]
    frames = [spark.createDataFrame([r for _, r in p], EVENTS).withColumn("ts", F.timestamp_seconds("t")) for p in parts]
    out = stateful.ordered_runs(frames, stateful.live_ledger, str(tmp_path))
    want = ledger.replay(spark.createDataFrame(rows + rows[::7], EVENTS).withColumn("ts", F.timestamp_seconds("t")))
    key = lambda df: sorted(tuple(r) for r in df.where("account_id != 'clock'").select("account_id", "event_id", "kind", "amount", "balance", "held").collect())
    assert key(out) == key(want) and len(key(want)) > 200


def test_account_rules():
    a = ledger.Account()
    assert a.apply(1, "purchase", 900, 50.0, None, None, None) == [(1, 900, "purchase", 50.0, 50.0, 0.0)] and a.apply(2, "purchase", 900, 50.0, None, None, None) == []
    assert a.apply(3, "hold", 1, 60.0, None, None, None) == [(3, 1, "rejected", 60.0, 50.0, 0.0)] and a.apply(4, "finish", 1, None, 2, False, None) == []
    assert [r[2:] for r in a.apply(5, "hold", 2, 30.0, None, None, None)] == [("hold", 30.0, 20.0, 30.0)] and a.apply(6, "hold", 2, 1.0, None, None, None) == []
    assert [r[2:] for r in a.apply(7, "finish", 2, None, 1, True, 12.0)] == [("capture", 12.0, 20.0, 18.0), ("release", 18.0, 38.0, 0.0)] and a.apply(8, "finish", 2, None, 1, True, 12.0) == []
    assert [r[2:] for r in a.apply(9, "hold", 3, 8.0, None, None, None)] == [("hold", 8.0, 30.0, 8.0)] and [r[2:] for r in a.apply(10, "finish", 3, None, 0, False, None)] == [("refund", 8.0, 38.0, 0.0)]
    assert a.apply(11, "finish", 4, None, 1, False, None) == [] and a.apply(12, "hold", 4, 1.0, None, None, None) == []  # ended before it was held


def applied(rows):
    """Ledger rows of events, account by account, in plain Python."""
    books, out = {}, []
    for a, _, event, kind, job, amount, kept, crashed, capture in sorted(rows, key=lambda r: (r[1], r[2])):
        out += [(a, *r) for r in books.setdefault(a, ledger.Account()).apply(event, kind, job, None if amount != amount else amount, kept, crashed, capture)]
    return sorted(out, key=str)


def many_accounts():
    """Five hundred accounts of few events, one unknown, with ids beyond 2^53, endless credit, unknown amounts and jobs without a number."""
    rng, big = random.Random(5), 2**60
    rows = account_events(rng, 500, 3)
    rows += [(None, 1000.0, big, "purchase", big, 50.0, None, None, None), (None, 1020.000001, big + 1, "hold", big + 1, 20.5, None, None, None), (None, 1090.0, big + 2, "finish", big + 1, None, 1, None, 3.25)]
    rows += [("null", 1000.0, big + 3, "purchase", big, float("inf"), None, None, None), ("null", 1021.0, big + 4, "hold", None, 7.0, None, None, None), ("null", 1022.0, big + 5, "hold", big + 9, float("nan"), None, None, None)]
    return rows


def test_many_accounts_share_few_states(spark, tmp_path):
    """What the state store is asked for grows with the groups, not with the accounts, and each account's rows are its own."""
    rows = many_accounts()
    rng = random.Random(6)
    rng.shuffle(rows)
    parts = [rows[:700], rows[700:] + rows[:300], [("clock", 50_000.0, 1, "purchase", 1, 1.0, None, None, None)]]
    seen = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(f"{EVENTS}, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        made = stateful.live_ledger(stream, watermark="1000 seconds", groups=5)
        run = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        seen += [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    got = [tuple(r) for r in spark.read.schema(made.schema).parquet(f"{tmp_path}/out").where("account_id IS DISTINCT FROM 'clock'").collect()]
    assert sorted(got, key=str) == applied(rows) and len(got) > 1_500
    assert made.schema == spark.createDataFrame([], f"account_id string, {ledger.LEDGER}").schema
    assert 0 < max(seen) < 100


class Store:
    """States of one group, and how often they are asked."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def __getattr__(self, name):
        store = self

        class State:
            value, items = None, {}

            def get(self):
                store.calls += 1
                return iter(self.value or ()) if name == "getListState" else self.value

            def update(self, value):
                store.calls, self.value = store.calls + 1, value

            put = update

            def appendValue(self, value):  # noqa: N802
                store.calls, self.value = store.calls + 1, [*(self.value or ()), value]

            def clear(self):
                store.calls, self.value = store.calls + 1, None

        return lambda *_: State()

    def registerTimer(self, at):  # noqa: N802
        self.calls, _ = self.calls + 1, self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls, _ = self.calls + 1, self.timers.remove(at)


class Timers:
    def __init__(self, seconds):
        self.getCurrentWatermarkInMs = lambda: int(seconds * 1000)


def test_calls_of_the_state_store_don_t_grow_with_accounts():
    texts = lambda *e: json.dumps([None if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in e])
    counts = []
    for accounts in (3, 300):
        store, ledgers, rows = Store(), stateful._Ledger(), account_events(random.Random(7), accounts, 4)
        ledgers.init(store)
        frame = pd.DataFrame({"at": [int(r[1] * 1e6) for r in rows], "event": [texts(r[0], int(r[1] * 1e6), *r[2:]) for r in rows]})
        out = [*ledgers.handleInputRows((0,), iter([frame[:50], frame[50:]] if accounts > 3 else [frame]), Timers(0))]
        for now in (1050.0005, 5000.0):
            ring = [t for t in store.timers if t <= now * 1000]
            assert len(store.timers) == len(ring) == 1
            out += ledgers.handleExpiredTimer((0,), Timers(now), None)
            store.timers -= set(ring)
        assert not store.timers and sorted((tuple(r) for f in out for r in f.itertuples(index=False)), key=str) == applied(rows)
        counts.append(store.calls)
    assert counts[0] == counts[1] < 20
