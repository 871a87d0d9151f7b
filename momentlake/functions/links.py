"""Names, links and fingerprints over columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts whose links are accepted, and the platform each belongs to.
PLATFORMS = {"kick.com": "kick", "www.kick.com": "kick", "twitch.tv": "twitch", "www.twitch.tv": "twitch", "youtube.com": "youtube", "www.youtube.com": "youtube", "youtu.be": "youtube", "m.youtube.com": "youtube"}


def fingerprint(value: Column) -> Column:
    """24 hex digits of the SHA-256 of a struct's JSON (nulls included)."""
    return F.substring(F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256), 1, 24)


def live_source(value: Column, default_platform: str = "kick", default_host: str = "kick.com") -> Column:
    """STRUCT<platform, slug, url> of a bare channel name or an accepted HTTPS link; null fields for anything else."""
    text = F.trim(F.coalesce(value, F.lit("")))
    bare = text.rlike(r"^[A-Za-z0-9_-]{1,80}$")
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    known = (F.try_parse_url(text, F.lit("PROTOCOL")) == "https") & host.isin(*PLATFORMS)
    platform = F.element_at(F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv]), host)
    path = F.btrim(F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit("")), F.lit("/"))
    last = F.element_at(F.split(path, "/"), -1)
    slug = F.substring(F.regexp_replace(F.when(last == "", platform).otherwise(last), r"[^\p{L}\p{N}_-]", "_"), 1, 80)
    linked = F.when(known, F.struct(platform.alias("platform"), slug.alias("slug"), text.alias("url")))
    named = F.struct(F.lit(default_platform).alias("platform"), text.alias("slug"), F.concat(F.lit(f"https://{default_host}/"), text).alias("url"))
    return F.when(F.contains(text, F.lit("://")), linked).when(bare, named)


def recording_id(url: Column, hosts: tuple[str, ...] = ("kick.com", "www.kick.com")) -> Column:
    """The id in /videos/<id> or /<channel>/videos/<id> on the given hosts, else null."""
    found = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/(?:[\w-]+/)?videos/([\w-]+)/?$", 1)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & (found != ""), found)


def chunk_start(name: Column) -> Column:
    """The time in chunk_<date>_<time>.ts, or null."""
    stamp = F.regexp_extract(name, r"chunk_(\d{8}_\d{6})\.ts$", 1)
    return F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd_HHmmss"))


def _objects(text: str) -> Iterator[object]:
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            yield decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue


def _playlists(value: object, wanted: str) -> Iterator[str]:
    """HTTPS playlists of the wanted id's objects that aren't live, in document order."""
    waiting = [value]
    while waiting:
        now = waiting.pop()
        children = list(now.values()) if isinstance(now, dict) else now if isinstance(now, list) else []
        if isinstance(now, dict) and now.get("is_live") is not True and str(now.get("id")) == wanted:
            links = [now.get("recording_url") or now.get("source")]
            yield from (u for u in links if isinstance(u, str) and re.match(r"https://.*\.m3u8", u, re.S))
        waiting += reversed(children)


def find_recordings(pages: DataFrame, key: str, html: str, wanted: str) -> DataFrame:
    """(key, recording) per page: the HTTPS playlist of the wanted id's object in any JSON on the page, scripts' pushed strings included; else null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for page, video in zip(pdf["html"], pdf["wanted"], strict=True):
                texts = [page or ""]
                for m in re.finditer(r"self\.__next_f\.push\(", texts[0]):
                    try:
                        pushed, _ = json.JSONDecoder().raw_decode(texts[0], m.end())
                        texts += [v for v in pushed if isinstance(v, str)]
                    except (ValueError, TypeError):
                        continue
                out.append(next((u for t in texts for o in _objects(t) if video for u in _playlists(o, video)), None))
            yield pd.DataFrame({"key": pdf["key"], "recording": pd.Series(out, dtype=object)})

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html"), F.col(wanted).cast("string").alias("wanted")).mapInPandas(run, f"key {kind}, recording string").withColumnRenamed("key", key)
