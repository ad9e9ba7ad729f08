"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries. The entries of one pattern, in order of their dates, become
validity intervals: an addition holds until the next entry of the pattern. A capture is judged by
the entries that were active when it was fetched: an as-of join on the patterns that can cover its
URL (its host, every parent domain, every path prefix up to the list's depth), each an equi-join
key. Of several active entries the most specific one rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

#: Interval rows that may be broadcast (about 100 bytes each); a larger list is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Patterns of one capture: the host and path are cut here, far above what hosts can have.
ENTRY = "pattern string, action string, category string, change string, at timestamp"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and last dot; null where there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(h, r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path without query and fragment, its case kept, without slashes at its ends."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(p, "^/+", ""), "/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, category, since, until) of the additions; until is null while one still holds.

    entries: pattern, action (block, allow), category, change (add, remove), at. Patterns are a host or
    domain (covers its subdomains too) or host/path (covers that path and what is below it). Entries
    without pattern or date are void; repeated entries count once; at equal dates removals come first.
    """
    log = entries.select(F.lower(F.substring_index("pattern", "/", 1)).alias("h"), "pattern", "action", "category", "change", "at").filter("pattern is not null and at is not null and change in ('add', 'remove')")
    log = log.withColumn("pattern", F.concat("h", F.expr("substring(pattern, length(h) + 1)"))).drop("h").distinct()
    turn = F.lead("at").over(Window.partitionBy("pattern", "action").orderBy("at", F.col("change") == "add", "category"))
    spans = log.withColumn("until", turn).filter("change = 'add' and (until is null or until > at)")
    return spans.select("pattern", "action", "category", F.col("at").alias("since"), "until")


def keys(h: Column, p: Column, depth: int) -> Column:
    """Every pattern that can cover host h and path p, to the given depth of paths."""
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if depth <= 0:
        return parents
    segments = F.split(p, "/+")
    n = F.when(p == "", 0).otherwise(F.least(F.size(segments), F.lit(depth)))
    below = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws("/", h, F.array_join(F.slice(segments, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(parents, below)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, fetched_at) with host, verdict, pattern, category and since.

    verdict is block, allow, or none. The longest active pattern rules; at one pattern allow comes
    before block, then the later addition, then the category. A URL without host, or a null URL or
    date, has verdict none. Equal captures are judged alike; empty tables give no rows.
    """
    spans = written(intervals(entries), "url-intervals")
    shape = spans.agg(F.count("*"), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    rows = captures.select(F.monotonically_increasing_id().alias("u"), "id", "url", "fetched_at")
    rows = written(rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), "url-captures")
    exploded = rows.filter("host is not null and fetched_at is not null").select("u", "fetched_at", F.explode(F.array_distinct(keys(F.col("host"), F.col("path"), shape[1] or 0))).alias("pattern"))
    side = F.broadcast(spans) if shape[0] <= BROADCAST_ROWS else spans
    active = exploded.join(side, "pattern").filter("since <= fetched_at and (until is null or fetched_at < until)")
    # min_by over the ruling order: reduced within each task before it shuffles, one row a capture.
    rank = F.struct((-F.length("pattern")).alias("x"), F.when(F.col("action") == "allow", 0).otherwise(1).alias("y"), (-F.unix_micros("since")).alias("z"), F.coalesce("category", F.lit("")).alias("c"))
    best = active.groupBy("u").agg(F.min_by(F.struct("action", "pattern", "category", "since"), rank).alias("m"))
    return rows.join(best, "u", "left").select("id", "url", "fetched_at", "host", F.coalesce("m.action", F.lit("none")).alias("verdict"), F.col("m.pattern").alias("pattern"), F.col("m.category").alias("category"), F.col("m.since").alias("since"))


def allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that are not blocked."""
    return judge(captures, entries).filter("verdict <> 'block'")


def _day(n: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(n.cast("int"))


def example_log(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages, for a table that comes without one: which hosts, and when, goes by the md5 of the host."""
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h is not null").distinct()
    a, b = F.ascii(F.substring(F.md5("h"), 1, 1)), F.ascii(F.substring(F.md5("h"), 2, 1))
    first = (b * 7) % 200
    entry = lambda when, pattern, action, category, change, at: F.when(when, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(category).alias("category"), F.lit(change).alias("change"), _day(at).alias("at")))
    log = F.array_compact(
        F.array(
            entry(a % 3 == 0, F.col("h"), "block", "spam", "add", first),
            entry((a % 3 == 0) & (b % 2 == 0), F.col("h"), "block", "spam", "remove", first + 60),
            entry((a % 3 == 0) & (b % 4 == 0), F.col("h"), "block", "malware", "add", first + 150),
            entry(a % 5 == 1, F.concat("h", F.lit("/en")), "block", "adult", "add", b % 100),
            entry((a % 3 == 0) & (b % 3 == 0), F.concat("h", F.lit("/fr")), "allow", "review", "add", F.lit(10)),
        )
    )
    return hosts.select(F.explode(log).alias("e")).select("e.*")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, verdict, pattern, category, since_on; a page without date gets one by its id."""
    captures = pages.select(F.col("page_id").alias("id"), "url", _day(F.pmod(F.col("page_id") * 7919, F.lit(365))).alias("fetched_at"))
    got = judge(captures, example_log(pages))
    return got.select(F.col("id").alias("page_id"), "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "verdict", "pattern", "category", F.date_format("since", "yyyy-MM-dd").alias("since_on"))
