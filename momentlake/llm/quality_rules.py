"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on measures of the whole text. Expectation-maximisation over the counts of vote
patterns (at most 3^rules of them, whatever the input) estimates each rule's accuracy and the share of good texts; a text is kept
if its posterior probability of being good is at least a half, rather than if it passes all rules.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, occurrences, plain_spaces, words_between

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
ITERATIONS, LEAST_GOOD, MOST_GOOD = 40, 0.05, 0.95
#: rule: (measure, good from, good to, bad below, bad above); between them it abstains.
RULES: dict[str, tuple[str, float, float, float, float]] = {
    "length": ("n_words", 40, 100_000, 20, 1e9),
    "word_length": ("word_length", 2.5, 10.0, 1.8, 16.0),
    "symbols": ("symbols_per_word", 0.0, 0.03, -1.0, 0.25),
    "capitals": ("capital_share", 0.0, 0.2, -1.0, 0.5),
    "repeats": ("repeat_share", 0.0, 0.08, -1.0, 0.25),
    "dup_lines": ("dup_line_share", 0.0, 0.05, -1.0, 0.3),
    "shouts": ("shouts_per_word", 0.0, 0.05, -1.0, 0.3),
    "letters": ("letter_share", 0.85, 1.0, 0.7, 2.0),
    "lone_signs": ("lone_share", 0.0, 0.05, -1.0, 0.2),
    "variety": ("distinct_share", 0.3, 1.0, 0.1, 2.0),
}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that stand twice or more in the text (hashes of windows are compared)."""

    def covered(hashes: Column) -> Column:
        def pick(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end"))
            # Each window adds its words beyond the end of the one before.
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p + window - a["end"])).alias("n"), (p + window).alias("end")), lambda a: a["n"])

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(ordered, pick))

    def windows(single: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(single) - (window - 1)), lambda i: F.xxhash64(F.slice(single, i, window)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts and what the rules look at, from whole texts; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = bind(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = bind(words_between(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeated_words(w).alias("repeated"), F.size(F.filter(w, lambda x: (F.length(x) == 1) & x.rlike(r"[^\p{L}\p{N}]"))).alias("lone")))
    raw = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), counts.alias("w"), lines.alias("l"),
        F.length(F.replace(plain_spaces(t), F.lit(" "), F.lit(""))).alias("word_chars"), occurrences(t, "#*$%&|<>").alias("n_symbols"), occurrences(t, "!").alias("shouts"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("capitals"), F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("letters"),
    )
    words = F.greatest(F.col("w.n"), F.lit(1))
    return raw.select(
        "doc_id", F.col("w.n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.repeated").cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbols_per_word"), (F.col("shouts") / words).alias("shouts_per_word"),
        (F.col("capitals") / F.greatest("letters", F.lit(1))).alias("capital_share"), (F.col("letters") / F.greatest("word_chars", F.lit(1))).alias("letter_share"),
        (F.col("w.repeated") / words).alias("repeat_share"), (F.col("l.dup") / F.greatest(F.col("l.n"), F.lit(1))).alias("dup_line_share"),
        (F.col("w.lone") / words).alias("lone_share"),
        # A long text repeats words more: the share is of at most six times the root of its length.
        F.least(F.lit(1.0), F.col("w.distinct") / F.least(words.cast("double"), F.sqrt(words) * 6)).alias("distinct_share"),
    )


def vote(rule: str) -> Column:
    measure, low, high, bad_below, bad_above = RULES[rule]
    x = F.col(measure)
    return F.when((x < bad_below) | (x > bad_above), -1).when((x >= low) & (x <= high), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """(prior log odds, per rule the log odds that each vote speaks for good) by expectation-maximisation over (votes, how many texts).

    A rule's accuracy is its rate of each vote among good and among bad texts, the three votes smoothed by one text each; it starts
    from the guess that a text is bad if any rule says so.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    odds, prior = [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(rules)], 0.0
    total = sum(n for _, n in patterns)
    for step in range(ITERATIONS if total else 0):
        good, rates = 0.0, [{v: [1.0, 1.0] for v in (-1, 0, 1)} for _ in range(rules)]
        for votes, n in patterns:
            z = (-2.0 if -1 in votes else 2.0) if step == 0 else prior + sum(odds[r][v] for r, v in enumerate(votes))
            p = 1 / (1 + exp(-max(-40.0, min(40.0, z))))
            good += n * p
            for r, v in enumerate(votes):
                rates[r][v][0] += n * p
                rates[r][v][1] += n * (1 - p)
        share = min(MOST_GOOD, max(LEAST_GOOD, good / total))
        prior = log(share / (1 - share))
        for r in range(rules):
            sums = [sum(rates[r][v][c] for v in (-1, 0, 1)) for c in (0, 1)]
            odds[r] = {v: log(rates[r][v][0] / sums[0]) - log(rates[r][v][1] / sums[1]) for v in (-1, 0, 1)}
    return prior, odds


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, votes (by rule), posterior (of being good), kept.

    A null or empty text has no words and fails the base test. Null ids, repeated rows and repeated ids are rows of their own (each
    counts in the estimate, which holds the share of good texts between LEAST_GOOD and MOST_GOOD); other columns are ignored; an empty table gives no rows. Ties of the posterior at `least` are kept.
    """
    measured = materialize(measures(docs, doc_id, text), "measures").withColumns({f"v_{r}": vote(r) for r in RULES})
    names = [f"v_{r}" for r in RULES]
    patterns = measured.groupBy(*names).count().collect()  # at most 3^10 rows
    prior, weights = estimate([(tuple(r[n] for n in names), r["count"]) for r in sorted(patterns)])
    odds = F.lit(prior)
    for name, w in zip(names, weights, strict=True):
        odds = odds + F.when(F.col(name) == -1, w[-1]).when(F.col(name) == 1, w[1]).otherwise(w[0])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"v_{r}"))]).alias("votes"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
