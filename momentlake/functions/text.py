"""Text functions over columns: normalising, lexicons, gates, validators, redaction. All native."""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import ACTION, JUDGMENT, PHRASES

# Noise words of topic labels.
NOISE_WORDS = ("uh", "um", "like", "yeah", "yo", "bro", "chat", "okay", "ok", "alright", "you", "know", "i", "mean", "the", "a", "an", "and", "to", "of", "in", "on", "is", "it", "was", "were", "for", "with")
# Substrings that keep a window for scoring.
KEEP_SIGNALS = (
    "bro", "nah", "what", "why", "how", "crazy", "fight", "lying", "liar", "lied", "stop", "look", "watch", "wait", "oh my", "no way", "oh shit", "holy", "shut",
    "dumb", "pull up", "hop out", "security", "cops", "crash", "headbutt", "speechless", "silent", "quiet", "awkward", "embarrass", "embarrassing",
    "exposed", "caught", "admit", "admission", "confess", "reveal", "secret", "denied", "rejected", "kicked out", "sorry", "love", "hate", "scared", "cry",
    "laugh", "laughing", "money", "thousand", "dollar", "win", "lost", "fail", "again", "actually", "serious", "promise", "never", "first time", "clip it",
)
# Phrases of physical and social action.
ACTION_SIGNALS = ("look at", "watch this", "oh shit", "oh my god", "holy", "pull up", "hop out", "swing", "slap", "grab", "fall", "crash", "stuck", "keys", "cops", "security", "run", "chase", "fight", "headbutt", "bottle service", "throw money", "entry denied", "speechless", "froze", "went quiet", "playback")
# Signals of the local fallback scorer.
FALLBACK_SIGNALS = (
    "oh shit", "oh my god", "holy", "what the", "no way", "look at", "watch this", "pull up", "hop out", "swing", "slap", "grab", "fall", "crash", "stuck", "keys",
    "cops", "security", "run", "chase", "fight", "headbutt", "throw money", "denied", "speechless", "went quiet", "playback", "lying", "lied", "exposed", "caught",
    "kicked out", "argue", "argument", "bro what", "are you serious", "fuck you",
)
# Keywords of the scan-order heuristic.
PRIORITY_KEYWORDS = ("gift", "surprise", "crazy", "insane", "wow", "oh my god", "fight", "arrested", "banned", "slapped", "cheat", "shocked")
# Openers that bury a caption's hook.
WEAK_OPENERS = (r"^during\b", r"^in this clip\b", r"^in a recent\b", r"^recently,?\b", r"^earlier (today|this week)\b", r"^a clip (shows|of)\b", r"^this clip (shows|of)\b", r"^while (streaming|live)\b", r"^on stream,?\b")
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"


def normalize_text(text: Column) -> Column:
    """Lower case; all but a-z, 0-9, apostrophe and white space becomes a space; spaces collapse."""
    # One pass, and only over what isn't a single space already; characters one by one make a lookup table, where ranges are tested in turn.
    kept = string.ascii_lowercase + string.digits + "'"
    return F.trim(F.regexp_replace(F.lower(text), f"[^{kept}]{{2,}}|[^{kept} ]", " "))


def tokens(text: Column) -> Column:
    """Words between white space, none of them empty; of a null text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def stem(word: Column) -> Column:
    """Strip `ing` from words of over 6 letters, else `ed` from words of over 5."""
    n = F.length(word)
    return F.when(word.endswith("ing") & (n > 6), F.substring(word, F.lit(1), n - 3)).when(word.endswith("ed") & (n > 5), F.substring(word, F.lit(1), n - 2)).otherwise(word)


def _stemmed(word: str) -> str:
    return word[:-3] if word.endswith("ing") and len(word) > 6 else word[:-2] if word.endswith("ed") and len(word) > 5 else word


def stem_words(words: list[str] | tuple[str, ...]) -> list[str]:
    """A lexicon with the stems of its words, for stem_hit."""
    return sorted({_stemmed(w) for w in words} | set(words))


def _inflected(lexicon: list[str] | tuple[str, ...]) -> list[str]:
    """All words whose stem is a word or a stem of the lexicon, so that texts needn't be stemmed."""
    stems = set(stem_words(lexicon)) - {""}
    return sorted(w for s in stems for w in (s, s + "ing", s + "ed") if _stemmed(w) in stems)


def _one_pattern(phrases: list[str] | tuple[str, ...]) -> list[str]:
    r"""The patterns, those of the form \b(...)\b as one, so that a text is searched once for all of them."""
    plain = [p for p in phrases if re.fullmatch(r"\\b\((?!\?)[^()\\]*(?:\((?!\?)[^()\\]*\)[^()\\]*)*\)\\b", p)]
    return ([r"\b(" + "|".join(p[3:-3] for p in plain) + r")\b"] if plain else []) + [p for p in phrases if p not in plain]


def _strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def stem_hit(text: Column, lexicon: list[str] | tuple[str, ...], phrases: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a phrase pattern matches the normalised text, or one of its stems is in the lexicon (of words; their stems are added)."""
    plain = normalize_text(text)
    hit = F.arrays_overlap(F.split(plain, " "), _strings(_inflected(lexicon)))
    for p in _one_pattern(phrases):
        hit = hit | plain.rlike(p)
    return F.coalesce(hit, F.lit(False))


def has_action(text: Column) -> Column:
    """Whether something happens: a phrase of a moment, or a word of action."""
    return stem_hit(text, ACTION, PHRASES)


def has_judgment_signal(text: Column) -> Column:
    """Whether words of ego, money, hypocrisy or controversy occur."""
    return stem_hit(text, JUDGMENT)


def count_contained(text: Column, signals: list[str] | tuple[str, ...]) -> Column:
    """How many of the signals are substrings of the text."""
    return F.size(F.filter(_strings(signals), lambda s: F.contains(text, s)))


def any_contained(text: Column, signals: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the signals is a substring of the text; of a null text, none is."""
    return F.coalesce(reduce(or_, [F.contains(text, F.lit(s)) for s in signals], F.lit(False)), F.lit(False))


def name_only_spam(text: Column, names: list[str], lexicon: list[str] = ACTION, phrases: list[str] | tuple[str, ...] = PHRASES, own: str = "") -> Column:
    """Fewer than 25 content words, two or more other names, and no action."""
    plain = normalize_text(text)
    content = F.size(F.filter(tokens(plain), lambda w: ~w.isin(*NOISE_WORDS)))
    others = sorted({n.strip().lower() for n in names} - {own.lower()})
    return (content < 25) & (count_contained(plain, others) >= 2) & ~stem_hit(text, lexicon, phrases)


def _marked(low: Column, signals: tuple[str, ...]) -> Column:
    marks = lambda c: F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))
    return any_contained(low, signals) | (marks("?") >= 2) | (marks("!") >= 2)


def keep_local_window(text: Column, min_words: int = 8, signals: tuple[str, ...] = KEEP_SIGNALS) -> Column:
    """Enough words, and a signal, two question marks, two exclamation marks, or two upper-case words of over two letters."""
    words, low = tokens(text), F.lower(F.coalesce(text, F.lit("")))
    upper = F.size(F.filter(words, lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w))))
    return (F.size(words) >= min_words) & (_marked(low, signals) | (upper >= 2))


def warm_window(text: Column, min_words: int = 8, keep: tuple[str, ...] = KEEP_SIGNALS, action: tuple[str, ...] = ACTION_SIGNALS) -> Column:
    """The gate before scoring: enough words and an action phrase, or keep_local_window of the lower-cased text (so upper case never counts)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.size(tokens(text)) >= min_words) & (any_contained(low, action) | _marked(low, keep))


def content_words(topic: Column) -> Column:
    return F.array_distinct(F.filter(tokens(normalize_text(topic)), lambda w: ~w.isin(*NOISE_WORDS)))


def topic_overlap(a: Column, b: Column) -> Column:
    """Shared content words over those of the shorter label; 0 if either has none."""
    x, y = content_words(a), content_words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def local_score(text: Column, signals: tuple[str, ...] = FALLBACK_SIGNALS) -> Column:
    """40 plus at most 20: six per signal and two per exclamation or question mark."""
    low = F.lower(text)
    marks = F.length(text) - F.length(F.translate(text, "!?", ""))
    return F.lit(40.0) + F.least(F.lit(20), 6 * count_contained(low, signals) + 2 * marks)


def scan_priority(text: Column, names: list[str], keywords: tuple[str, ...] = PRIORITY_KEYWORDS) -> Column:
    low = F.lower(text)
    return 3 * count_contained(low, [n.strip().lower() for n in names if n.strip()]) + count_contained(low, keywords)


def fold_reactions(reason: Column, reactions: Column) -> Column:
    """The reason and the first three reactions without blank ones, joined by semicolons."""
    some = F.filter(F.slice(reactions, 1, 3), lambda r: F.trim(r) != "")
    return F.when(F.size(some) > 0, F.concat_ws("; ", reason, F.array_join(some, "; "))).otherwise(reason)


def redact_secrets(line: Column) -> Column:
    """Hide bearer tokens, API keys and URL query strings."""
    keys = F.regexp_replace(line, r"(?i)(bearer\s+|api[_-]?key[=: ]+)[^\s,]+", "$1[redacted]")
    return F.regexp_replace(keys, r"(https?://[^\s?]+)\?[^\s]+", "$1?[redacted]")


def redact_terms(text: Column, patterns: list[str]) -> Column:
    """Each pattern's matches, in any case, become [redacted]; spaces collapse."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", "[redacted]")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def caption_errors(caption: Column, long_form: Column | bool = False) -> Column:
    """Violated rules of a caption: length band, emoji, weak opener."""
    text = F.trim(caption)
    n, long_form = F.size(tokens(text)), long_form if isinstance(long_form, Column) else F.lit(long_form)
    weak = F.lit(False)
    for p in WEAK_OPENERS:
        weak = weak | text.rlike(f"(?i){p}")
    rules = F.array_compact(F.array(
        F.when(n < F.when(long_form, 20).otherwise(12), "too short"), F.when(n > F.when(long_form, 110).otherwise(85), "too long"),
        F.when(F.regexp_count(text, F.lit(EMOJI)) > 2, "too many emoji"), F.when(weak, "weak opener"),
    ))
    return F.when(text == "", F.array(F.lit("empty"))).otherwise(rules)


def strip_names(text: Column, names: list[str], allowed: Column) -> Column:
    """Remove names that aren't allowed (an array), in any case; spaces collapse where something was removed."""
    low = F.transform(allowed, F.lower)
    for name in names:
        hidden = ~F.array_contains(low, name.lower()) & F.contains(F.lower(text), F.lit(name.lower()))
        text = F.when(hidden, F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i){re.escape(name)}", ""), r"\s{2,}", " "))).otherwise(text)
    return text


def forbidden_names(names: list[str], allowed: Column) -> Column:
    """The names without the allowed ones, in any case, lower-cased."""
    return F.array_except(_strings([n.lower() for n in names]), F.transform(allowed, F.lower))


def names_present(text: Column, names: list[str]) -> Column:
    return F.filter(_strings([n for n in names if n]), lambda n: F.contains(F.lower(text), F.lower(n)))


def verify_quotes(text: Column, source: Column) -> Column:
    """Drop quoted spans of four or more characters that don't stand in the source, in any case."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{4,})"'), F.lit(1))
    bad = F.filter(quoted, lambda q: (F.trim(F.rtrim(q, F.lit("."))) != "") & ~F.contains(F.lower(source), F.lower(F.trim(F.rtrim(q, F.lit("."))))))
    clean = F.aggregate(bad, text, lambda t, q: F.replace(t, F.concat(F.lit('"'), q, F.lit('"')), F.lit("")))
    return F.when(F.contains(text, F.lit('"')), F.btrim(F.regexp_replace(clean, r"\s{2,}", " "), F.lit(" -:"))).otherwise(text)


def quote_or_blank(quote: Column, text: Column) -> Column:
    """The quote if it stands in the text, in any case; else an empty string."""
    return F.when(F.contains(F.lower(text), F.lower(quote)), quote).otherwise(F.lit(""))


def fallback_title(text: Column) -> Column:
    """The first sentence's first twelve words, trimmed of punctuation; a stock title if nothing is left."""
    seed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    first = F.get(F.split(seed, r"(?<=[.!?])\s+"), F.lit(0))
    short = F.btrim(F.array_join(F.slice(tokens(first), 1, 12), " "), F.lit(" .,!?:;"))
    return F.when(short == "", "Live Stream Moment").otherwise(short)


def caption_time(seconds: Column) -> Column:
    """h:mm:ss.cc"""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.format_string("%d:%02d:%05.2f", h, m, seconds % 60)


def has_secret(text: Column, patterns: tuple[str, ...] = (r"sk-[A-Za-z0-9_-]{20,}", r"xai-[A-Za-z0-9_-]{20,}")) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return F.coalesce(hit, F.lit(False))
