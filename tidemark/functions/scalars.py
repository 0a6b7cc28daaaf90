"""Scalar functions on columns: topic names, path components, file names, sizes, durability, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOPIC_BYTES = 128


def is_topic(t: Column) -> Column:
    """1 to 128 bytes of [a-z0-9._-], no dot at an edge, no two dots in a row. A null is no topic."""
    fine = F.octet_length(t).between(1, MAX_TOPIC_BYTES) & t.rlike(r"\A[a-z0-9_-]+(\.[a-z0-9_-]+)*\z")
    return F.coalesce(fine, F.lit(False))


def topic_error(t: Column) -> Column:
    """InvalidLength, DotEdge, or whichever of InvalidChar and DoubleDot comes first; null if it is a topic."""
    odd, dots = F.regexp_instr(t, F.lit(r"[^a-z0-9._-]")), F.regexp_instr(t, F.lit(r"\.\."))
    return (
        F.when(t.isNull() | ~F.octet_length(t).between(1, MAX_TOPIC_BYTES), "InvalidLength")
        .when(t.startswith(".") | t.endswith("."), "DotEdge")
        .when((odd > 0) & ((dots == 0) | (odd < dots + 1)), "InvalidChar")
        .when(dots > 0, "DoubleDot")
    )


def path_component(s: Column) -> Column:
    """Bytes outside [A-Za-z0-9._-] as %HH."""
    quoted = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("~"), F.lit("%7E"))


def segment_name(base: Column) -> Column:
    return F.format_string("%020d.log", base)


def index_name(base: Column) -> Column:
    return F.format_string("%020d.idx", base)


def part_name(part: Column) -> Column:
    return F.format_string("%010d", part)


def record_size(headers: Column, payload: Column) -> Column:
    size = F.lit(36) + F.coalesce(F.octet_length(headers), F.lit(0)) + F.coalesce(F.octet_length(payload), F.lit(0))
    return size.cast("long")


def effective_durability(level: Column) -> Column:
    """AfterReplicated is served as AfterFsync; an unknown level is null."""
    return F.when(level.isin("AfterWrite", "AfterFsync"), level).when(level == "AfterReplicated", "AfterFsync")


def unix_millis(ts: Column | None = None) -> Column:
    """Milliseconds since 1970 of a time stamp, or of now; never below zero."""
    return F.greatest(F.unix_millis(F.current_timestamp() if ts is None else ts), F.lit(0).cast("long"))
