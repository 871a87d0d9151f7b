"""Timed words: chunk plans, validity, ownership, overlap merge, captions, repair."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, once
from .intervals import points_in_intervals
from .islands import CHUNK_SECONDS, fold_sorted, running_before, with_island, with_previous


def chunk_plan(sources: DataFrame, minutes: float = 15, overlap: float = 8) -> DataFrame:
    """Per source of positive, finite duration: index, audio_start, audio_end, core_start, core_end."""
    if not (1 <= minutes <= 60 and 0 <= overlap <= 30):
        raise ValueError("chunks take 1 to 60 minutes and 0 to 30 seconds of overlap")
    s, d = minutes * 60, F.col("duration")
    good = sources.where((d > 0) & ~F.isnan(d) & (d < float("inf")))
    k = good.withColumn("index", F.explode(F.sequence(F.lit(0), (F.ceil(d / s) - 1).cast("int"))))
    i = F.col("index")
    return k.select("source_id", "index", F.greatest(F.lit(0.0), i * s - overlap).alias("audio_start"), F.least(d, (i + 1) * s + overlap).alias("audio_end"), (i * s).cast("double").alias("core_start"), F.least(d, (i + 1) * s).alias("core_end"))


def to_global(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative words (source_id, index, ...) with their chunk's columns and times on the source's clock."""
    joined = words.join(chunks.hint("shuffle_merge"), ["source_id", "index"])
    return joined.withColumns({"start": F.col("start") + F.col("audio_start"), "end": F.col("end") + F.col("audio_start")})


def word_errors(limit: Column | None = None, slack: float = 1.0) -> Column:
    """Array of what is wrong with a word; empty for a good one. limit: the length of its audio."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = [
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank"), F.when(~(finite("start") & finite("end")), "not finite"),
        F.when(~((F.col("start") >= 0) & (F.col("start") <= F.col("end"))), "bad times"),
        F.when(F.col("confidence").isNotNull() & (F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)), "bad confidence"),
    ]
    if limit is not None:
        rules.append(F.when(F.col("end") > limit + slack, "past the audio"))
    return F.array_compact(F.array(*rules))


def validate_words(words: DataFrame, limit: Column | None = None, slack: float = 1.0, mode: str = "quarantine") -> DataFrame:
    """words with `errors`; mode `fail` raises on the first bad row, when the plan runs."""
    marked = words.withColumn("errors", word_errors(limit, slack))
    if mode == "fail":
        return marked.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("invalid word: "), F.array_join("errors", ", ")))).otherwise(F.col("errors")))
    return marked


def owned_words(words: DataFrame) -> DataFrame:
    """Of words with chunk columns and global times, those whose midpoint lies in their chunk's core; text trimmed."""
    middle = (F.col("start") + F.col("end")) / 2
    return words.where((middle >= F.col("core_start")) & (middle < F.col("core_end"))).withColumn("text", F.trim("text"))


def low_confidence(words: DataFrame, least: float = 0.5) -> DataFrame:
    return words.where(F.col("uncertain") | F.coalesce(F.col("confidence") < least, F.lit(False)))


def safe_prefix(words: DataFrame, chunks: DataFrame, overlap: float) -> DataFrame:
    """Words that end before the safe end of their source: the core end of the last chunk of the unbroken done prefix, less the overlap unless all are done.

    chunks: source_id, index, core_end, done.
    """
    gap = chunks.groupBy("source_id").agg(F.min(F.when(~F.col("done"), F.col("index"))).alias("_gap"))
    ends = chunks.join(gap.hint("shuffle_merge"), "source_id").where(F.col("_gap").isNull() | (F.col("index") < F.col("_gap")))
    safe = ends.groupBy("source_id", "_gap").agg(F.max("core_end").alias("_last")).select("source_id", (F.col("_last") - F.when(F.col("_gap").isNull(), 0.0).otherwise(overlap)).alias("safe_end"))
    return words.join(safe.hint("shuffle_merge"), "source_id").where(F.col("end") <= F.col("safe_end"))


def boundaries(words: DataFrame, pause: float = 0.6) -> DataFrame:
    """(source_id, mark): ends of words that close a sentence or come before a pause."""
    rows = words.withColumn("_chunk", F.floor(F.col("start") / CHUNK_SECONDS))
    following = F.lead("start").over(Window.partitionBy("source_id", "_chunk").orderBy("start", "word_idx"))
    heads = rows.groupBy("source_id", "_chunk").agg(F.min("start").alias("_head"))
    # What follows the last word of a chunk is the first one of the next chunk that has words.
    after = heads.select("source_id", "_chunk", F.lead("_head").over(Window.partitionBy("source_id").orderBy("_chunk")).alias("_after"))
    joined = rows.withColumn("_next", following).join(after.hint("shuffle_merge"), ["source_id", "_chunk"])
    closes = F.rtrim("text").rlike(r"[.?!]$") | F.coalesce(F.coalesce("_next", "_after") - F.col("end") >= pause, F.lit(False))
    return joined.where(closes).select("source_id", F.col("end").alias("mark"))


def pauses(words: DataFrame, least: float = 0.4) -> DataFrame:
    """(source_id, mark): where gaps of at least `least` seconds between neighbouring words begin."""
    before = with_previous(words, ["source_id"], "start", ["word_idx"], ["end"], "_prev")
    return before.where(F.col("start") - F.col("_prev.end") >= least).select("source_id", F.col("_prev.end").alias("mark"))


@lru_cache(1 << 16)
def _words_key(text: str) -> str:
    return re.sub(r"[^\w]", "", text.casefold())


class _Word(NamedTuple):
    source_id: object
    text: str
    start: float
    end: float
    confidence: float | None
    speaker: str | None
    uncertain: bool


class _Seam:
    """The words of one seam (or source), chunk by chunk; merged words stay in (start, end) order, and leave once no later chunk can hear them."""

    def __init__(self) -> None:
        self.rows: list[_Word] = []
        self.chunk: tuple | None = None
        self.waiting: list[_Word] = []

    def take(self, row: tuple) -> list[_Word] | None:
        source, _, audio_start, index, text, start, end, confidence, speaker, uncertain = row
        done = self.merge() if self.chunk not in (None, (audio_start, index)) else None
        self.chunk = audio_start, index
        self.waiting.append(_Word(source, text, start, end, confidence if confidence == confidence else None, speaker, uncertain))
        return done

    def merge(self) -> list[_Word]:
        """Words of the waiting chunk meet those that end no earlier than a second before its audio; the ones before are done, as chunks come by the start of their audio."""
        words, self.waiting = self.waiting, []
        first = len(self.rows)
        while first and self.rows[first - 1].end >= self.chunk[0] - 1:
            first -= 1
        done, seam, taken, fresh = self.rows[:first], self.rows[first:], set(), []
        keys, starts = [_words_key(x.text) for x in seam], [x.start for x in seam]
        sorted_starts = all(x == x for x in starts)
        for word in words:
            key, start, end, twin, rivals = _words_key(word.text), word.start, word.end, None, []
            # A word that took another's place starts 0.55 s from it at most, so twice that finds all that are near.
            near = range(bisect_left(starts, start - NEAR), bisect_right(starts, start + NEAR)) if sorted_starts else range(len(seam))
            for i in near:
                a, b = abs(seam[i].start - start), abs(seam[i].end - end)
                # The latest of equally near twins wins, as the seam is looked through from its end.
                if a <= 0.55 and b <= 0.75 and keys[i] == key and i not in taken and (twin is None or a <= twin[0]):
                    twin = a, i
                if a < 0.15 and b < 0.2:
                    rivals.append(i)
            if twin:
                i = twin[1]
                taken.add(i)
                if (-1.0 if word.confidence is None else word.confidence) > (-1.0 if seam[i].confidence is None else seam[i].confidence):
                    seam[i] = word
                continue
            for i in rivals:
                seam[i] = seam[i]._replace(uncertain=True)
            fresh.append(word._replace(uncertain=True) if rivals else word)
        self.rows = sorted(seam + fresh, key=_place)
        return done

    def finish(self) -> list[_Word]:
        return self.merge() + self.rows


_MERGE_SCHEMA = "source_id string, text string, start double, end double, confidence double, speaker string, uncertain boolean"


def _merged(words: DataFrame) -> DataFrame:
    columns = ["audio_start", "index", "text", "start", "end", "confidence", "speaker", "uncertain"]
    return fold_sorted(words, ["source_id", "seam"], ["audio_start", "index", "start", "end", "text"], columns, _Seam, _Seam.take, _MERGE_SCHEMA, _Seam.finish)


#: Words whose starts lie further apart than this are neither one word nor rivals (0.55 and 0.15 s).
PAUSE = 0.6
NEAR, _place = 1.2, itemgetter(2, 3)


def _between_pauses(words: DataFrame) -> DataFrame:
    """words with `seam`: what is said, in any chunk, without a pause. Chunks that share such a stretch are folded together there, and only there.

    Stretches are named by their first start within time chunks; those that go on from the time chunk before take the name they have there.
    """
    by = Window.partitionBy("source_id", "_chunk").orderBy("start")
    opens = F.coalesce(F.col("start") - F.lag("start").over(by) > PAUSE, F.lit(True))
    rows = words.withColumn("_chunk", F.floor(F.col("start") / CHUNK_SECONDS)).withColumn("_opens", opens)
    rows = once(rows.withColumn("seam", F.max(F.when(F.col("_opens"), F.col("start"))).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens"))
    held = rows.groupBy("source_id", "_chunk").agg(F.min("start").alias("_head"), F.max("start").alias("_tail"), F.max("seam").alias("_last"))
    over = Window.partitionBy("source_id").orderBy("_chunk")
    held = held.withColumn("_fresh", F.coalesce(F.col("_head") - F.lag("_tail").over(over) > PAUSE, F.lit(True)))
    named = F.when(F.col("_fresh") | (F.col("_last") > F.col("_head")), F.col("_last"))
    carried = held.withColumn("_name", F.last(named, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    # Written, so that Spark knows how few go on.
    on = materialize(carried.where(~F.col("_fresh")).select("source_id", "_chunk", "_head", "_name"), "carried")
    joined = rows.join(on, ["source_id", "_chunk"], "left")
    return joined.withColumn("seam", F.when(F.col("seam") == F.col("_head"), F.col("_name")).otherwise(F.col("seam"))).drop("_chunk", "_head", "_name")


def merge_overlaps(words: DataFrame, chunk_seconds: float, overlap: float) -> DataFrame:
    """One transcript from overlapping chunks' words (source_id, index, audio_start, audio_end, text, start, end, confidence, speaker, uncertain).

    A word heard twice (same letters, start within 0.55 s, end within 0.75 s) is kept once, the more confident way; words that disagree
    at the same time are both kept and marked uncertain. Seams between chunks don't touch each other if chunk_seconds is over twice
    the overlap plus 3 s; then only the words near a seam are grouped, a minute of audio each, and the rest pass by. Otherwise every
    word may be heard several times, and what is said between two pauses is grouped.
    """
    words = words.select(F.col("source_id").cast("string").alias("source_id"), "index", "audio_start", "audio_end", "text", "start", "end", "confidence", "speaker", "uncertain")
    columns = ["source_id", "text", "start", "end", "confidence", "speaker", "uncertain"]
    if chunk_seconds <= 2 * overlap + 3:
        return _merged(_between_pauses(words))
    words, index = once(words), F.col("index")
    ends = words.select("source_id", "index", "audio_start", "audio_end").distinct()
    order = Window.partitionBy("source_id").orderBy("index")  # one row per chunk
    following, before = F.when(F.lead(index).over(order) == index + 1, F.lead("audio_start").over(order)), F.when(F.lag(index).over(order) == index - 1, F.lag("audio_end").over(order))
    # Written, so that Spark knows how small the table of chunks is.
    bounds = materialize(ends.select("source_id", "index", following.alias("next_start"), before.alias("prev_end")), "bounds")
    placed = words.join(bounds, ["source_id", "index"], "left")
    right = F.coalesce(F.col("start") <= F.col("prev_end") + 1.55, F.lit(False))
    left = F.coalesce(F.col("end") >= F.col("next_start") - 1, F.lit(False)) & ~right
    seamed = placed.withColumn("seam", F.when(right, index - 1).when(left, index))
    near = _merged(seamed.where("seam is not null"))
    return seamed.where("seam is null").select(*columns).unionByName(near)


def caption_groups(clips: DataFrame, words: DataFrame, size: int = 4) -> DataFrame:
    """Captions of each clip (source_id, clip_id, start, end): line, rel_start, rel_end, text, karaoke (text with centisecond tags)."""
    spoken = words.select("source_id", F.col("word_idx").alias("_idx"), F.col("start").alias("_at"), F.col("end").alias("_to"), F.trim("text").alias("_w"))
    inside = points_in_intervals(clips.select("source_id", "clip_id", "start", "end"), spoken, at="_at", closed=True)
    order = Window.partitionBy("source_id", "clip_id").orderBy("_at", "_idx")  # one clip's words
    numbered = inside.withColumn("line", F.floor((F.row_number().over(order) - 1) / size))
    following = F.lead("_at").over(Window.partitionBy("source_id", "clip_id", "line").orderBy("_at", "_idx"))
    length = F.greatest(F.lit(1), ((F.coalesce(following, F.col("_to")) - F.col("_at")) * 100).cast("int"))
    safe = F.replace(F.replace(F.replace("_w", F.lit("\\"), F.lit("")), F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))
    tagged = numbered.withColumn("_tag", F.concat(F.lit("{\\k"), length.cast("string"), F.lit("}"), safe))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_idx", "_w", "_tag", "_to")))
    grouped = tagged.groupBy("source_id", "clip_id", "line", "start").agg(ordered.alias("o"))
    return grouped.select("source_id", "clip_id", "line", (F.get("o", F.lit(0))["_at"] - F.col("start")).alias("rel_start"), (F.element_at("o", -1)["_to"] - F.col("start")).alias("rel_end"), F.array_join(F.transform("o", lambda x: x["_w"]), " ").alias("text"), F.array_join(F.transform("o", lambda x: x["_tag"]), " ").alias("karaoke"))


class _Ranges:
    """The ranges of one island that have been taken, by start."""

    def __init__(self) -> None:
        self.kept: list[tuple[float, float]] = []
        self.longest = 0.0

    def take(self, row: tuple) -> tuple | None:
        source, _, rank, candidate, start, end = row
        at = bisect_right(self.kept, (start, float("inf")))
        while at and self.kept[at - 1][0] >= start - self.longest:
            at -= 1
            if self.kept[at][1] >= start:
                return None
        insort(self.kept, (start, end))
        self.longest = max(self.longest, end - start)
        return source, rank, candidate, start, end


def repair_ranges(candidates: DataFrame, words: DataFrame, limit: int, least: float = 0.5, margin: float = 5.0, longest: float = 60.0) -> DataFrame:
    """At most `limit` ranges per source to transcribe again: uncertain words of the best candidates, widened, none starting in an earlier one.

    A range can only start in one that it touches, so islands of touching ranges are gone through apart, best first; the limit ends the
    choice among what they take, in the same order. A source of any length is spread over its islands.
    """
    doubtful = low_confidence(words, least).select("source_id", F.col("start").alias("_at"), F.col("end").alias("_to"))
    found = points_in_intervals(candidates.select("source_id", "candidate_id", "start", "end", "score"), doubtful, at="_at")
    ends = words.groupBy("source_id").agg(F.max("end").alias("_last"))
    spans = found.groupBy("source_id", "candidate_id", "score").agg(F.min("_at").alias("a"), F.max_by("_to", "_at").alias("b")).join(ends.hint("shuffle_merge"), "source_id")
    begin = F.greatest(F.lit(0.0), F.col("a") - margin)
    stop = F.least(F.least("_last", F.col("b") + margin), begin + longest)
    ranked = once(spans.select("source_id", (-F.col("score")).alias("rank"), "candidate_id", begin.cast("double").alias("start"), stop.cast("double").alias("end")))
    reached = running_before(ranked, ["source_id"], "start", ["candidate_id"], "max", F.col("end"), "_reach")
    islands = with_island(reached, ["source_id"], "start", ["candidate_id"], F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)))
    kinds = dict(ranked.dtypes)
    schema = f"source_id {kinds['source_id']}, rank {kinds['rank']}, candidate_id {kinds['candidate_id']}, start double, end double"
    small = islands.withColumn("island", F.xxhash64("island"))
    taken = fold_sorted(small, ["source_id", "island"], ["rank", "candidate_id"], ["rank", "candidate_id", "start", "end"], _Ranges, _Ranges.take, schema)
    order = Window.partitionBy("source_id").orderBy("rank", "candidate_id")
    chosen = taken.withColumn("range_id", F.row_number().over(order)).where(F.col("range_id") <= limit)
    return chosen.select("source_id", (F.col("range_id") - 1).alias("range_id"), "start", "end")


def repair_decisions(ranges: DataFrame, words: DataFrame, improved: DataFrame) -> DataFrame:
    """ranges with old_confidence, new_confidence and accepted. improved: source_id, range_id, text, start, end, confidence.

    New words replace old ones if they are more confident on the mean (none counts 0), at least half as many, and all inside the range.
    """
    old = points_in_intervals(ranges.select("source_id", "range_id", "start", "end"), words.select("source_id", F.col("start").alias("_at"), "confidence"), at="_at").groupBy("source_id", "range_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("old_confidence"), F.count("*").alias("old_words"))
    new = improved.join(ranges.select("source_id", "range_id", F.col("start").alias("_s"), F.col("end").alias("_e")).hint("shuffle_merge"), ["source_id", "range_id"]).groupBy("source_id", "range_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("new_confidence"), F.count("*").alias("new_words"), F.bool_and((F.col("start") >= F.col("_s")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_e") + 1)).alias("inside"))
    out = ranges.join(old.hint("shuffle_merge"), ["source_id", "range_id"], "left").join(new.hint("shuffle_merge"), ["source_id", "range_id"], "left")
    out = out.withColumns({"old_confidence": F.coalesce("old_confidence", F.lit(0.0)), "old_words": F.coalesce("old_words", F.lit(0)), "new_words": F.coalesce("new_words", F.lit(0))})
    good = (F.col("new_confidence") > F.col("old_confidence")) & (F.col("new_words") >= F.col("old_words") * 0.5) & F.col("inside")
    return out.withColumn("accepted", F.coalesce(good, F.lit(False))).drop("inside")


#: From a source and a range of its time, the words heard there: dicts of text, start, end, confidence, in the source's own time.
Transcriber = Callable[[object, float, float], list[dict]]


def retranscribe(ranges: DataFrame, transcriber: Transcriber, partitions: int | None = None) -> DataFrame:
    """Words (source_id, range_id, text, start, end, confidence) that a transcriber hears in the ranges; a range it fails on has none.

    One call per range; `partitions` bounds how many run at once.
    """
    kind = dict(ranges.dtypes)["source_id"]
    columns = ["source_id", "range_id", "text", "start", "end", "confidence"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for source, range_id, start, end in pdf.itertuples(index=False, name=None):
                try:
                    heard = transcriber(source, start, end)
                except Exception:  # noqa: BLE001  any failure of the user's transcriber leaves the old words
                    heard = []
                out += [(source, range_id, w["text"], float(w["start"]), float(w["end"]), w.get("confidence")) for w in heard]
            yield pd.DataFrame(out, columns=columns)

    wanted = ranges.select("source_id", F.col("range_id").cast("int"), "start", "end")
    if partitions:
        wanted = wanted.repartition(partitions)
    return wanted.mapInPandas(run, f"source_id {kind}, range_id int, text string, start double, end double, confidence double")


def repair(words: DataFrame, candidates: DataFrame, transcriber: Transcriber, limit: int) -> DataFrame:
    """words with the doubtful ranges of the best candidates transcribed again, where the new words are clearer."""
    words = once(words)
    ranges = once(repair_ranges(candidates, words, limit))
    improved = once(retranscribe(ranges, transcriber))
    return apply_repair(words, repair_decisions(ranges, words, improved), improved)


def apply_repair(words: DataFrame, decisions: DataFrame, improved: DataFrame) -> DataFrame:
    """words without those that start in an accepted range, and the improved words of these ranges."""
    accepted = decisions.where("accepted").select("source_id", "range_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = points_in_intervals(accepted, words.select("source_id", "word_idx", F.col("start").alias("_at")), "_s", "_e", "_at").select("source_id", "word_idx").distinct()
    kept = words.join(hit.hint("shuffle_merge"), ["source_id", "word_idx"], "left_anti")
    new = improved.join(accepted.select("source_id", "range_id").hint("shuffle_merge"), ["source_id", "range_id"], "left_semi")
    return kept.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in words.dtypes]))
