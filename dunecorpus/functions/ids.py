"""Identifiers and small parsers on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 200_000
# Upper bounds of the size bands.
SIZE_BANDS = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M"))


def _address(v: Column) -> tuple[Column, Column, Column]:
    """(host, the path's non-empty parts, the value of the parameter v) of an absolute address; empty for others."""
    host, path = (F.regexp_extract(v, r"^[a-zA-Z]+://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return host, F.filter(F.split(path, "/"), lambda p: p != ""), F.regexp_extract(v, r"[?&]v=([^&#]+)", 1)


def video_id(v: Column) -> Column:
    """The id in a video's address; anything that isn't one is an id itself."""
    v = F.trim(v)
    host, parts, parameter = _address(v)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    site = v.contains("youtube.com") | v.contains("youtu.be")
    of_site = F.when(host.endswith("youtu.be"), F.coalesce(first, F.lit(""))).when((first == "watch") & (parameter != ""), parameter)
    return F.when(site, of_site.when(first.isin("shorts", "embed", "live") & second.isNotNull(), second).otherwise(last)).otherwise(v)


def channel_ref(v: Column) -> Column:
    """struct(channel_id, handle): exactly one is set, none for other addresses of the site."""
    v = F.trim(v)
    _, parts, _ = _address(v)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    site, bare = v.contains("youtube.com"), v.rlike("^UC[A-Za-z0-9_-]{22}$")
    # what names the channel, and whether it is an id
    name = F.when(site, F.when(first.isin("channel", "c", "user"), second).when(first.startswith("@"), first)).otherwise(v)
    is_id = F.coalesce(F.when(site, first == "channel").otherwise(bare), F.lit(False))
    return F.struct(F.when(is_id, name).alias("channel_id"), F.when(~is_id & name.isNotNull(), F.concat(F.lit("@"), F.ltrim(name, F.lit("@")))).alias("handle"))


def username(v: Column) -> Column:
    """The name in a profile's address, or a bare one without its mark and slashes."""
    v = F.trim(v)
    own = F.regexp_extract(v, r"tiktok\.com/@([^/?#]+)", 1)
    return F.when(own != "", F.ltrim(own, F.lit("@"))).otherwise(F.btrim(F.ltrim(v, F.lit("@")), F.lit("/")))


def cookies(v: Column) -> Column:
    """array of struct(name, value) of a cookie header, in order; parts without ``=`` are skipped."""
    parts = F.filter(F.transform(F.split(v, ";"), F.trim), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("name"), F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def size_band(n: Column) -> Column:
    out = F.lit("10M<n<100M")
    for bound, label in reversed(SIZE_BANDS):
        out = F.when(n < bound, label).otherwise(out)
    return out


def external_id(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"ext_{kind}_"), F.substring(F.sha1(text), 1, 16))


def hash_bucket(prefix: str, gram: Column) -> Column:
    return F.crc32(F.concat(F.lit(prefix), gram)) % HASH_BUCKETS


def parsed_label(reply: Column, allowed: list[str]) -> Column:
    """The first ``label:`` line's value if it is allowed, else ``parse_error``."""
    label = F.lower(F.regexp_extract(reply, r"(?im)^\s*label:\s*([^\s]+)", 1))
    return F.when(label.isin(allowed), label).otherwise("parse_error")
