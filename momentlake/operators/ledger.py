"""Credit ledgers: holds in order, settlement, balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, once, release
from .islands import fold_sorted, running_before
from .ranks import numbered

TERMINAL = ("completed", "completed_empty", "partial", "failed", "refunded")


def hold_amount(minutes: Column, rate: Column) -> Column:
    """Minutes times rate, rounded up to a tenth of a credit."""
    return F.ceil(minutes * rate * 10) / 10


def running_balance(transactions: DataFrame, chunk: float = 4096.0) -> DataFrame:
    """transactions (account_id, txn_id, delta) with balance after each, in txn_id order."""
    t = transactions.withColumn("_at", F.col("txn_id").cast("double"))
    return running_before(t, ["account_id"], "_at", ["txn_id"], "sum", F.col("delta"), "_before", chunk).withColumn("balance", F.col("_before") + F.col("delta")).drop("_before", "_at")


def account_summary(transactions: DataFrame) -> DataFrame:
    """Per account: balance and held, rounded to a tenth. kind: purchase, hold, capture, release, refund."""
    kind, amount = F.col("kind"), F.col("amount")
    balance = F.when(kind.isin("purchase", "release", "refund"), amount).when(kind == "hold", -amount).otherwise(0.0)
    held = F.when(kind == "hold", amount).when(kind.isin("capture", "release", "refund"), -amount).otherwise(0.0)
    return transactions.groupBy("account_id").agg(F.bround(F.sum(balance), 1).alias("balance"), F.bround(F.sum(held), 1).alias("held"))


def kept_clips(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """jobs with kept: how many clip rows each has."""
    counts = clips.groupBy("job_id").agg(F.count("*").alias("kept"))
    return jobs.join(counts.hint("shuffle_merge"), "job_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def settle(jobs: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """jobs (job_id, status, crashed, hold, kept, capture_amount) with new_status, captured, released, refunded.

    A terminal job changes nothing; one without a hold only gets its status; one without clips gets its hold back; else the hold, or
    the capture amount if that's less, is captured and the rest released.
    """
    done, held, none = F.col("status").isin(*terminal), F.col("hold").isNotNull(), F.col("kept") == 0
    crashed = F.coalesce("crashed", F.lit(False))
    take = F.least(F.coalesce("capture_amount", "hold"), F.col("hold"))
    pays = ~done & held & ~none
    status = F.when(done, F.col("status")).when(~held | none, F.when(crashed, "failed").otherwise("completed_empty")).otherwise(F.when(crashed, "partial").otherwise("completed"))
    zero = F.lit(0.0)
    return jobs.withColumns({"new_status": status, "captured": F.when(pays, take).otherwise(zero), "released": F.when(pays, F.col("hold") - take).otherwise(zero), "refunded": F.when(~done & held & none, F.col("hold")).otherwise(zero)})


def settlement_rows(settled: DataFrame) -> DataFrame:
    """Ledger rows (job_id, kind, amount) of settled jobs, none of amount 0."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("amount")) for k, c in (("capture", "captured"), ("release", "released"), ("refund", "refunded"))])
    return settled.select("job_id", F.explode(kinds).alias("t")).select("job_id", "t.kind", "t.amount").where("amount > 0")


#: Of a ledger row, all but its account.
LEDGER = "event_id long, job_id long, kind string, amount double, balance double, held double"


class Account:
    """An account's credits and its jobs (job_id to hold and status), event by event.

    Kinds of events: `purchase` (job_id is the payment's), `hold`, and `finish` (kept, crashed, capture_amount). Each gives ledger rows
    (event_id, job_id, kind, amount, balance, held): a hold that the balance doesn't cover gives a row `rejected` and fails its job; a
    finished job's hold is captured, released and refunded as in settle. A job that has come to an end, a hold of a known job and a
    known payment change nothing, so repeated events don't.
    """

    def __init__(self, balance: float = 0.0, held: float = 0.0, jobs=None) -> None:
        self.balance, self.held, self.jobs = balance, held, {} if jobs is None else jobs

    def apply(self, event_id: int, kind: str, job: int, amount: float | None, kept: int | None, crashed: bool | None, capture_amount: float | None) -> list[tuple]:
        hold, status = self.jobs.get(job) or (None, None)
        rows: list[tuple] = []

        def book(kind: str, amount: float, balance: float, held: float) -> None:
            if amount > 0:
                self.balance, self.held = self.balance + balance, self.held + held
                rows.append((event_id, job, kind, amount, self.balance, self.held))

        if status is not None and (status in TERMINAL or kind != "finish"):
            return rows
        if kind == "purchase":
            self.jobs[job] = (None, "completed")
            book("purchase", amount or 0.0, amount or 0.0, 0.0)
        elif kind == "hold":
            amount = amount or 0.0
            if amount <= self.balance:
                self.jobs[job] = (amount, "running")
                book("hold", amount, -amount, amount)
            else:
                self.jobs[job] = (None, "failed")
                rows.append((event_id, job, "rejected", amount, self.balance, self.held))
        elif kind == "finish":
            empty = hold is None or not kept
            self.jobs[job] = (hold, ("failed" if crashed else "completed_empty") if empty else ("partial" if crashed else "completed"))
            if hold is not None and empty:
                book("refund", hold, hold, -hold)
            elif hold is not None:
                take = hold if capture_amount is None else min(capture_amount, hold)
                book("capture", take, 0.0, -take)
                book("release", hold - take, hold - take, take - hold)
        return rows


class _Books(Account):
    account = None

    def take(self, row: tuple) -> list[tuple]:
        self.account, *event = (None if v != v else v for v in row)
        return [(self.account, *r) for r in self.apply(*event)]


def replay(events: DataFrame) -> DataFrame:
    """Ledger rows of account events (account_id, ts, event_id, kind, job_id, amount, kept, crashed, capture_amount) in order of ts and event_id: account_id and LEDGER.

    An account's events stream through one task, a job's outcome in memory each; see Account.
    """
    columns = ["event_id", "kind", "job_id", "amount", "kept", "crashed", "capture_amount"]
    return fold_sorted(events.select("account_id", "ts", *columns), ["account_id"], ["ts", "event_id"], columns, _Books, _Books.take, f"account_id {dict(events.dtypes)['account_id']}, {LEDGER}")


#: Balances and amounts are counted in millionths of a credit, so that sums don't depend on their order.
UNIT = 1_000_000
#: Accounts of more holds than this are worked off by many tasks, and their running sums in chunks of this many rows.
LARGE_ACCOUNT, CHUNK_ROWS = 100_000, 65_536.0


class _Balance:
    """What is left of an account, in units."""

    left: int | None = None

    def take(self, row: tuple) -> tuple:
        account, hold, amount, units, opening = row
        left = opening if self.left is None else self.left
        accepted = units == units and units is not None and units <= left
        self.left = left - int(units) if accepted else left
        return account, hold, amount, accepted, self.left / UNIT


def _in_units(amount: Column) -> Column:
    return F.when(amount.isNotNull() & ~F.isnan(amount), F.round(amount * UNIT)).try_cast("long")


def _phases(rows: DataFrame, opening: DataFrame) -> DataFrame:
    """Per account, sorted (pos, left): from row pos on, the balance is `left` and stays over half of it until the next pos.

    rows: account_id, n (1, 2, ... by hold), units. While an account has more than half of what a phase began with, it covers every
    hold of at most that half, and of the larger ones the first that fits ends the phase. So a phase ends at the first row where the
    running sum of the small holds leaves too little, or where a larger one fits: prefix sums and a minimum, however many rows there
    are. Each phase halves the balance; there are as many as its number of bits, far fewer as a rule, and holds that no longer fit drop out.
    """
    state, live, found = materialize(opening.select("account_id", F.lit(0).cast("long").alias("pos"), "left"), "phase"), rows, None
    found = [state]
    while True:
        at = state.where("left > 0").select("account_id", "pos", "left", (F.shiftright("left", 1) + 1).alias("half"))
        fits = materialize(live.select("account_id", "n", "units").join(at, "account_id").where("n > pos and units <= left"), "fits")
        small = F.col("units") < F.col("half")
        summed = running_before(fits, ["account_id"], "n", [], "sum", F.when(small, F.col("units")).otherwise(F.lit(0).cast("long")), "_spent", CHUNK_ROWS)
        rest = F.col("left") - F.col("_spent")
        ends = F.when(small, rest - F.col("units") < F.col("half")).otherwise(F.col("units") <= rest)
        state = materialize(summed.where(ends).groupBy("account_id").agg(F.min(F.struct("n", (rest - F.col("units")).alias("left"))).alias("e")).select("account_id", F.col("e.n").alias("pos"), "e.left"), "phase")
        if live is not rows:
            release(live)
        live = fits
        if state.isEmpty():
            break
        found.append(state)
    release(live)
    out = materialize(reduce(DataFrame.unionByName, found).groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("pos", "left"))).alias("phases")), "phases")
    for done in [*found, state]:
        release(done)
    return out


def _accept_in_phases(holds: DataFrame, opening: DataFrame) -> DataFrame:
    """account_id, hold_id, amount, accepted, balance for accounts (account_id, left) of any number of holds."""
    rows = materialize(numbered(holds, ["account_id"], ["hold_id"], "n"), "holds")
    phases = _phases(rows, opening)
    joined = rows.join(phases, "account_id").join(opening.withColumnRenamed("left", "opening"), "account_id")
    now = F.element_at(F.filter("phases", lambda p: p["pos"] < F.col("n")), -1)["left"]
    ends = F.exists("phases", lambda p: p["pos"] == F.col("n"))
    accepted = F.coalesce(F.col("units").isNotNull() & (ends | (F.col("units") < F.shiftright(now, 1) + 1)), F.lit(False))
    spent = running_before(joined.withColumn("accepted", accepted), ["account_id"], "n", [], "sum", F.when(F.col("accepted"), F.col("units")).otherwise(F.lit(0).cast("long")), "_spent", CHUNK_ROWS)
    left = F.col("opening") - F.col("_spent") - F.when(F.col("accepted"), F.col("units")).otherwise(0)
    return spent.select("account_id", "hold_id", "amount", "accepted", (left / UNIT).alias("balance"))


def accept_holds(holds: DataFrame, accounts: DataFrame, large: int = LARGE_ACCOUNT) -> DataFrame:
    """holds (account_id, hold_id, amount) with accepted and balance after, in hold_id order: a hold is accepted if the balance covers it.

    accounts: account_id, balance; an account without a row has 0. Amounts count to a millionth of a credit; null ones are never
    accepted. Holds of an account stream through one task in order; those of accounts with more than `large` holds (found by a count,
    which runs when this is called) are worked off by all tasks, phase by phase, with the same result. Only an account with negative
    amounts stays in one task whatever its size, for its balance could grow again.
    """
    named = holds.select("account_id", "hold_id", F.col("amount").cast("double").alias("amount"), _in_units(F.col("amount").cast("double")).alias("units"))
    rows = once(named)
    counts = rows.groupBy("account_id").agg(F.count("*").alias("_n"), F.min("units").alias("_least"))
    big = materialize(counts.where((F.col("_n") > large) & (F.col("_least") >= 0)).select("account_id"), "large")
    first = accounts.select("account_id", F.coalesce(_in_units(F.col("balance").cast("double")), F.lit(0).cast("long")).alias("left"))
    types = dict(holds.dtypes)
    schema = f"account_id {types['account_id']}, hold_id {types['hold_id']}, amount double, accepted boolean, balance double"

    def folded(some: DataFrame) -> DataFrame:
        joined = some.join(first, "account_id", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))
        return fold_sorted(joined, ["account_id"], ["hold_id"], ["hold_id", "amount", "units", "left"], _Balance, _Balance.take, schema)

    if big.isEmpty():
        release(big)
        return folded(rows)
    opening = materialize(big.join(first, "account_id", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long"))), "opening")
    return folded(rows.join(big, "account_id", "left_anti")).unionByName(_accept_in_phases(rows.join(big, "account_id", "left_semi"), opening))
