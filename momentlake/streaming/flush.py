"""What a flush of waiting candidates makes of them: groups, a new score for each, a decision, and no repeats.

Plain functions over the few candidates of one flush, for state handlers; `operators.moments` does the same to whole tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..config import Settings
from ..functions.text import NOISE_WORDS
from ..operators.moments import Kept
from ..operators.scorers import Scorer, score_texts


@dataclass(frozen=True)
class Moment:
    start: float
    end: float
    score: float
    topic: str = ""
    text: str = ""


def content_words(topic: str) -> set[str]:
    return set(re.sub(r"[^a-z0-9'\s]", " ", topic.lower()).split()) - set(NOISE_WORDS)


def same_topic(a: str, b: str, settings: Settings) -> bool:
    x, y = content_words(a), content_words(b)
    return bool(x and y) and len(x & y) / min(len(x), len(y)) >= settings.same_topic


def joins(before: Moment, row: Moment, settings: Settings) -> bool:
    """All tests but the span cap; live candidates have no class, so the limits are the usual ones."""
    s, same, gap = settings, same_topic(before.topic, row.topic, settings), row.start - before.end
    high, low = max(before.score, row.score), min(before.score, row.score)
    if high >= s.very_high:
        return same and low >= s.very_high_floor and gap <= s.very_high_gap
    if gap > s.merge_gap * (s.topic_gap_factor if same else 1):
        return False
    apart = high >= s.clip_threshold and low < s.peak_floor
    return not apart and (high - low <= s.compatible_delta or (same and low >= s.compatible_floor))


def grouped(rows: list[Moment], settings: Settings) -> list[list[Moment]]:
    groups: list[list[Moment]] = []
    for row in sorted(rows, key=lambda m: m.start):
        if groups and joins(groups[-1][-1], row, settings) and row.end - groups[-1][0].start <= settings.merge_span:
            groups[-1].append(row)
        else:
            groups.append([row])
    return groups


def decided(group: list[Moment], merged: float | None, settings: Settings) -> Moment | None:
    """The merged moment, its peak alone, or nothing."""
    s, peak = settings, max(group, key=lambda m: m.score)
    if merged is None:
        return peak if peak.score >= s.clip_threshold else None
    if merged < s.clip_threshold and peak.score < s.peak_fallback:
        return None
    diluted = len(group) > 1 and peak.score - sum(m.score for m in group) / len(group) >= s.dilution
    if diluted or merged < s.clip_threshold:
        return peak
    return replace(group[0], end=group[-1].end, score=merged, text=" ".join(m.text for m in group))


def flush(rows: list[Moment], scorer: Scorer, settings: Settings) -> list[Moment]:
    """The moments of one flush, in start order."""
    groups = grouped(rows, settings)
    scores = score_texts(scorer, [" ".join(m.text for m in g) for g in groups])
    moments = [m for g, (score, _) in zip(groups, scores, strict=True) if (m := decided(g, score, settings))]
    kept, stay = Kept(settings.overlap_share, settings.center_gap), []
    for m in sorted(moments, key=lambda m: (-m.score, m.start)):
        if not kept.meets(m.start, m.end):
            kept.add(m.start, m.end)
            stay.append(m)
    return sorted(stay, key=lambda m: m.start)
