"""URL filters by a temporal list join, with DataFrame functions only.

A list is dated: an entry (pattern, kind, action, listed_at) adds or removes a host, a domain with its
subdomains, or a URL prefix up to a path segment. The entries of one pattern, in order of date, become disjoint
validity intervals. Every capture is held against the entries that were active when it was fetched: its
URL gives the few keys that could be listed (host, parent domains, path prefixes), and an equi-join on the
key with the fetch time inside the interval is the as-of join. At most one interval of a key holds at any
time, so the join never has more rows than there are keys of captures.

Captures and patterns are read by the same rules: scheme, user, port, query and fragment are left aside, host names are
lower-case and lose a dot at their end, empty path segments don't count; percent escapes and the case of paths stay as they
are. So the URL pattern ``a.com/`` is the whole host a.com, ``a.com//x`` is ``a.com/x``. A pattern may do without a scheme, a
capture may not; a domain pattern may begin with ``.`` or ``*.``.

Only prefixes of as many segments, and domains of as many labels, as some entry has are made into keys; others
could not be listed. So the work for a URL grows with its length, not with the square of it.

Edge cases: a null or malformed URL, or a null fetch time, matches nothing and is not blocked. Of
entries of a pattern with one date the removal wins. Repeated entries count once. Null or empty patterns, and null or unknown
kinds, actions or dates are ignored. Extra columns of captures pass through, whatever they are called; those called
blocked, n_entries or entry are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import cut, free

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*://"
REST = r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)(?::[0-9]*)?(?=[/?#]|$)([^?#]*)"
CAPTURE, PATTERN = f"^{SCHEME}{REST}", f"^(?:{SCHEME})?{REST}"


def host_of(url: Column, form: str = CAPTURE) -> Column:
    """The host of a URL, normalised; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, form, 1)), F.lit("."))


def steps_of(url: Column, form: str = CAPTURE) -> Column:
    """The path segments of a URL that aren't empty."""
    return F.filter(F.split(F.regexp_extract(url, form, 2), "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, kind, depth, valid_from, valid_to): when each pattern was listed; valid_to is open (null) for the last.

    ``entries`` has kind (host, domain, url), pattern, action (add, remove) and listed_at. depth is the number of a URL
    prefix's segments or of a domain's labels.
    """
    host = host_of(F.col("pattern"), PATTERN)
    domain = F.regexp_replace(host_of(F.regexp_replace("pattern", r"^(\*?\.)+", ""), PATTERN), r"^(\*?\.)+", "")
    steps = steps_of(F.col("pattern"), PATTERN)
    read = entries.filter("listed_at is not null and action in ('add', 'remove')").select("kind", "action", "listed_at", F.when(F.col("kind") == "domain", domain).otherwise(host).alias("host"), F.when(F.col("kind") == "url", steps).otherwise(F.array().cast("array<string>")).alias("steps"))
    letter = F.when(F.col("kind") == "host", "h:").when(F.col("kind") == "domain", "d:").when(F.col("kind") == "url", "u:")
    key = F.concat(letter, F.array_join(F.concat(F.array("host"), "steps"), "/"))
    depth = F.when(F.col("kind") == "domain", F.size(F.split("host", r"\."))).otherwise(F.size("steps"))
    known = read.filter("host <> ''").select(key.alias("key"), "kind", depth.alias("depth"), "action", "listed_at").filter("key is not null")
    daily = known.groupBy("key", "kind", "depth", "listed_at").agg(F.max("action").alias("action"))  # 'remove' sorts last
    w = Window.partitionBy("key").orderBy("listed_at")
    changes = daily.withColumn("before", F.lag("action").over(w)).filter("before is null or before <> action")
    return changes.withColumn("valid_to", F.lead("listed_at").over(w)).filter("action = 'add'").select("key", "kind", "depth", F.col("listed_at").alias("valid_from"), "valid_to")


def keys_of(url: Column, depths: dict[str, list[int]]) -> Column:
    """The list keys that could apply to a URL, given the depths that the list's domains and URL prefixes have."""
    host = host_of(url)
    labels, steps = F.split(host, r"\."), steps_of(url)
    sizes = lambda kind: F.array(*map(F.lit, depths.get(kind, []))).cast("array<int>")
    fit = lambda kind, most: F.filter(sizes(kind), lambda n: n <= most)
    domains = F.transform(fit("domain", F.size(labels)), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    prefixes = F.transform(fit("url", F.size(steps)), lambda n: F.concat(F.lit("u:"), F.array_join(F.concat(F.array(host), F.slice(steps, 1, n)), "/")))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("h:"), host)), domains, prefixes)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, id_: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, n_entries (active and matching) and entry (the first of them by key).

    Matches are gathered by id, fetch time and URL, so repeated captures share a verdict. List keys
    that a third of all captures have are dealt to many tasks by adaptive execution, whose runtime sizes
    also decide whether the list is sent to all. The different depths of the list (no more than the square root of twice
    its segments) are read by the driver first.
    """
    captures = captures.drop(*({"blocked", "n_entries", "entry"} - {id_, url, fetched}))
    listed = cut(intervals(entries))
    depths: dict[str, list[int]] = {}
    for kind, depth in listed.filter("kind <> 'host'").groupBy("kind", "depth").count().select("kind", "depth").orderBy("kind", "depth").collect():
        depths.setdefault(kind, []).append(depth)
    own = captures.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("at")).filter("url is not null and at is not null").distinct()
    asked = own.select("*", F.explode(keys_of(F.col("url"), depths)).alias("key"))
    hit = asked.join(listed.withColumnRenamed("key", "listed"), (F.col("key") == F.col("listed")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    i, u, t, n, e = free(captures.columns, "_id", "_url", "_at", "_n", "_entry")
    verdicts = hit.groupBy("id", "url", "at").agg(F.count("*").alias(n), F.min("key").alias(e)).toDF(i, u, t, n, e)
    joined = captures.join(verdicts, F.col(f"`{id_}`").eqNullSafe(F.col(i)) & (F.col(f"`{url}`") == F.col(u)) & (F.col(f"`{fetched}`") == F.col(t)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in captures.columns], F.col(n).isNotNull().alias("blocked"), F.coalesce(n, F.lit(0)).cast("long").alias("n_entries"), F.col(e).alias("entry"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): the pages table names no fetch time, so each page gets one from its id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(720)).cast("int")
    return pages.select("page_id", "url", F.timestamp_add("day", day, F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")).alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages: some add their host, their domain or their URL, some remove them again."""
    host = host_of(F.col("url"))
    path = F.regexp_extract("url", CAPTURE, 2)
    m = F.pmod(F.col("page_id"), F.lit(97))
    kind = F.when(m.isin(3, 50), "host").when(m.isin(7, 60), "domain").when(m.isin(11, 12, 13, 14, 70), "url")
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    pattern = F.when(kind == "host", host).when(kind == "domain", F.concat(F.element_at(F.split(host, r"\."), -3), F.lit("."), domain)).otherwise(F.concat(host, path))
    rows = pages.select(kind.alias("kind"), pattern.alias("pattern"), F.when(m >= 50, "remove").otherwise("add").alias("action"), F.timestamp_add("day", F.pmod(F.col("page_id") * 53, F.lit(720)).cast("int"), F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")).alias("listed_at"))
    return rows.filter("kind is not null")
