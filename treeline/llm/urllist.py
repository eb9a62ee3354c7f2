"""URL filters by a temporal list join.

A list has dated entries (pattern, status, listed_on); a pattern is a host,
which also covers its subdomains, or a host and a path, which covers what is
below it. An entry holds from its date until the next entry of its pattern.
Each capture is judged by the entries that held on the day it was fetched:
the longest covering pattern with one decides.

The as-of join is an equality join: an interval is laid out over the months
it touches and meets the distinct (pattern, day) pairs of the captures there,
so hot hosts are joined once a day and not once a capture. Only the join that
brings the hits back to the distinct URLs of a day has all URLs of a hot host
and day under one key; adaptive execution splits it where it is skewed, as the
side of the hits has one row a key.

Defined cases: a URL without a host, or null, or a null fetch date is kept
and matches nothing; entries without pattern, date or status are left out;
several entries of a pattern on one day: ``block`` beats ``allow`` beats
``none``; status ``none`` ends an entry; ties in pattern length are between a
host and a host with path, where the path wins by being longer; an empty list
keeps every capture. Repeated captures are rows of their own; an empty table
of captures gives no rows; other columns are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import only, unused

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def patterns(url: Column) -> Column:
    """All patterns that cover a URL: its host's suffixes of two labels or more, and its host with each leading part of the path."""
    labels = F.split(F.lower(F.regexp_extract(url, HOST, 1)), r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(segments, lambda s, i: F.concat_ws("/", F.array_join(labels, "."), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(F.regexp_extract(url, HOST, 1) != "", F.concat(hosts, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, status, valid_from, valid_to`` (not included; null if open)."""
    known = only(entries, "pattern", "status", "listed_on").dropna()
    rank = F.when(F.col("status") == "block", 2).when(F.col("status") == "allow", 1).otherwise(0)
    days = known.groupBy("pattern", F.col("listed_on").cast("date").alias("valid_from")).agg(F.max(rank).alias("rank"))
    # A pattern's entries, one a day at most, are what one task orders.
    until = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return days.select("pattern", F.element_at(F.array(F.lit("none"), F.lit("allow"), F.lit("block")), F.col("rank") + 1).alias("status"), "valid_from", until.alias("valid_to"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``matched_pattern``, ``matched_from`` and ``blocked`` (replaced where it has such columns); it has ``url`` and ``fetched_on``."""
    captures = captures.drop("matched_pattern", "matched_from", "blocked")
    month = lambda c: F.trunc(c, "month")
    pages = captures.select(F.col("url").alias("page"), F.col("fetched_on").cast("date").alias("day")).dropna().distinct()
    asked = pages.select("page", "day", F.explode(F.array_distinct(patterns(F.col("page")))).alias("pattern"))
    keys = asked.select("pattern", "day").distinct()
    span = F.broadcast(pages.agg(month(F.min("day")).alias("low"), month(F.max("day")).alias("high")))  # one row
    held = intervals(entries).where("status <> 'none'").join(span, F.lit(True))
    held = held.withColumn("a", F.greatest(month("valid_from"), F.col("low"))).withColumn("b", F.least(month(F.coalesce("valid_to", "high")), F.col("high"))).where("a <= b")
    laid = held.select("pattern", "status", "valid_from", "valid_to", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    at = keys.withColumn("month", month("day")).join(laid, ["pattern", "month"]).where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    hits = asked.join(at.select("pattern", "day", "status", "valid_from"), ["pattern", "day"])
    order = F.struct(F.length("pattern"), F.col("pattern"))
    best = hits.groupBy("page", "day").agg(F.max_by(F.struct("pattern", "status", "valid_from"), order).alias("hit"))
    page, day, hit = (unused(captures, c) for c in ("page", "day", "hit"))
    best = best.select(F.col("page").alias(page), F.col("day").alias(day), F.col("hit").alias(hit))
    joined = captures.join(best, (F.col("url") == F.col(page)) & (F.col("fetched_on").cast("date") == F.col(day)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in captures.columns], F.col(f"{hit}.pattern").alias("matched_pattern"), F.col(f"{hit}.valid_from").alias("matched_from"), F.coalesce(F.col(f"{hit}.status") == "block", F.lit(False)).alias("blocked"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, made by a rule from each pattern's MD5, for the query and its SQL.

    A quarter of the hosts, and of the hosts with a first path segment, is
    blocked on some day, allowed later and blocked again; a few leave the list.
    """
    host, first = F.lower(F.regexp_extract("url", HOST, 1)), F.regexp_extract("url", HOST[:-1].replace("([^/:?#]+", "[^/?#]*/([^/?#]+)"), 1)
    made = pages.select(F.explode(F.array(host, F.concat_ws("/", host, first))).alias("pattern")).distinct().where("pattern <> '' AND NOT pattern LIKE '%/'")
    k = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int")
    dated = made.withColumn("k", k).where("k % 4 = 0")
    steps = F.array(F.struct(F.lit("block").alias("status"), F.lit(0).alias("after")), F.struct(F.lit("allow").alias("status"), (20 + F.col("k") % 90).alias("after")), F.struct(F.when(F.col("k") % 3 == 0, "none").otherwise("block").alias("status"), (150 + F.col("k") % 200).alias("after")))
    return dated.select("pattern", "k", F.explode(steps).alias("s")).select("pattern", F.col("s.status").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") % 365 + F.col("s.after")).alias("listed_on"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, fetched_on``; the day follows from the id, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetched_on"))


#: The rows of the query ``op3_url_filter`` in DuckDB's SQL.
ORACLE = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 730)::INT AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages
), made AS (
  SELECT DISTINCT unnest([host, host || '/' || seg[1]]) AS pattern FROM c WHERE host <> ''
), k AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS k FROM made WHERE pattern IS NOT NULL
), e AS (
  SELECT pattern, unnest(['block', 'allow', CASE WHEN k % 3 = 0 THEN 'none' ELSE 'block' END]) AS status, DATE '2024-01-01' + (k % 365 + unnest([0, 20 + k % 90, 150 + k % 200]))::INT AS listed_on FROM k WHERE k % 4 = 0
), d AS (
  SELECT pattern, listed_on, CASE max(CASE status WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS status FROM e GROUP BY ALL
), labels AS (
  SELECT *, string_split(host, '.') AS l FROM c WHERE host <> ''
), a AS (
  SELECT DISTINCT page_id, url, fetched_on, unnest(list_concat(
    list_transform(range(1, greatest(1, len(l) - 1) + 1), lambda i: array_to_string(l[i:], '.')),
    list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[:i], '/')))) AS pattern FROM labels
), j AS (
  SELECT a.page_id, a.url, a.fetched_on, a.pattern, d.status, d.listed_on FROM a ASOF JOIN d ON a.pattern = d.pattern AND a.fetched_on >= d.listed_on
), b AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, pattern DESC) AS n FROM j WHERE status <> 'none'
)
SELECT c.page_id, c.url, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, b.pattern AS matched_pattern, strftime(b.listed_on, '%Y-%m-%d') AS matched_from, coalesce(b.status = 'block', false) AS blocked
FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.url = c.url AND b.n = 1
"""
