"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's frequency is the number of a host's pages that contain it, divided by the host's pages. Lines
that reach ``ratio`` on a host, and ``least`` pages of it, are boilerplate there and are dropped from
all its pages.

Only 64-bit line hashes are shuffled for counting, once for each page and line, and counted on the
map side first. The boilerplate of a host is a short list (at most lines-per-page / ratio entries), kept as one array for
a host. The lists' size is measured: up to SENT_BYTES they are sent to all executors and no text is shuffled;
beyond that pages meet them in a plain left join on the host, in which adaptive execution splits a host with a third of all pages.
A page's own boilerplate is an intersection by hash, so a long list costs a page no more than its own lines.

Edge cases: lines are compared without surrounding spaces; blank lines are never dropped for their
frequency. A null text stays null; a text whose lines all go becomes empty; its row stays. A null
host is a host of its own. Repeated rows count as pages of their own. Extra columns pass through, whatever they are
called; one that is called like the count of dropped lines (``dropped``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import cut, free

RATIO, LEAST, SENT_BYTES = 0.01, 5, 32 << 20


def line_key(line: Column) -> Column:
    """64 bits of a line without surrounding spaces; they are compared within a host only."""
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, bad): the keys of the lines that reach ``ratio`` on a host. ``pages`` has host and lines."""
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), line_key))
    lines = pages.select("host", F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    joined = lines.join(totals, "host").filter(F.col("n") >= F.lit(ratio).cast("decimal(18,9)") * F.col("total"))
    return joined.groupBy("host").agg(F.collect_list("k").alias("bad"))


def drop_boilerplate(pages: DataFrame, host: Column, text: str, lines: Column | None = None, ratio: float = RATIO, least: int = LEAST, dropped: str = "n_dropped", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``pages`` with ``text`` rebuilt from the lines that stay, and the number dropped in the column ``dropped``.

    ``lines`` is an array of lines, unless the text is to be split at line feeds.
    """
    pages = pages.drop(dropped)
    lines = F.split(F.col(text), "\n") if lines is None else lines
    host = F.coalesce(host.cast("string"), F.lit("\u0000"))
    bad = cut(boilerplate(pages.select(host.alias("host"), lines.alias("lines")), ratio, least))
    size = bad.agg(F.sum(F.size("bad") * 8 + F.octet_length("host") + 64)).first()[0] or 0
    h, all_, b, here = free(pages.columns, "_host", "_lines", "_bad", "_here")
    bad = bad.toDF(h, b)
    joined = pages.withColumn(h, host).withColumn(all_, lines).join(F.broadcast(bad) if size <= sent_bytes else bad, h, "left")
    found = joined.withColumn(here, F.when(F.col(b).isNotNull(), F.array_intersect(F.transform(all_, line_key), b)))
    kept = F.filter(all_, lambda x: ~F.array_contains(here, line_key(x)) | (F.trim(x) == ""))
    changed = F.coalesce(F.size(here) > 0, F.lit(False))
    rebuilt = found.withColumn(h, F.when(changed, kept))
    n = F.when(changed, F.size(all_) - F.size(h)).otherwise(0).cast("long")
    whole = F.when(changed, F.array_join(h, "\n")).otherwise(F.col(text))
    return rebuilt.select(*[whole.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns], n.alias(dropped))


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str = "url") -> Column:
    """The lower-case host of a URL, or null."""
    found = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    return F.when(found != "", found)


def html_lines(html: str = "html") -> Column:
    """The texts between the block-level tags of a page."""
    bare = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>", "\n")
    broken = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|br|nav|article|section|header|footer|title|body|html|head|main|aside|form)\b[^>]*>", "\n")
    return F.filter(F.transform(F.split(F.regexp_replace(broken, r"<[^>]*>", ""), "\n+"), lambda x: F.trim(x)), lambda x: x != "")


def page_lines(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, text without boilerplate and n_dropped of every page."""
    lines = pages.select("page_id", host_of().alias("host"), F.array_join(html_lines(), "\n").alias("text"))
    return drop_boilerplate(lines, F.col("host"), "text", ratio=ratio, least=least)
