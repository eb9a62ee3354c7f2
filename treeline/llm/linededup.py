"""Line deduplication by content-defined chunks of lines, in built-in functions only.

Each line has a hash; a rolling hash over a line and the one before it ends a
chunk where it is divisible by ``DIVISOR``, so inserted or lost lines move
only the boundaries beside them. A line of ``LONG_WORDS`` words or more is a
paragraph and a chunk by itself. Where no boundary comes, a chunk ends after
``MOST_LINES`` lines.

What can repeat is a run of lines that begins or ends at a boundary: a whole
chunk, the rest of a chunk from any line on, or its beginning up to any line.
So a passage is found from its first line on and up to its last one, although
the chunks at its edges hold lines around it too. A run has several lines; one
that would have a single line takes in the whole chunk beside it, and only
paragraphs are runs alone. Lines of runs that occur more than once in the
corpus are removed, except in the run that comes first (least doc_id, null
ones last, then the text's hash, then first place in it).

Lines travel as hashes and are grouped as lists of them; a text moves once, to
meet the numbers of the lines that it may lose. Then bytes are compared: every
line of a repeated run is grouped beside its hash, and a text with a hash that
stands for two different lines loses nothing. Texts are read once for their
hashes and once for what is left; no step grows faster than a text's lines.
Rows of one run meet in one key of a join; where a run is in very many texts,
adaptive execution splits that key (no row of it is grouped or sorted whole).

Defined cases: a null text stays null; an empty text has one empty line and
stays empty; runs of empty lines alone are no runs; rows that share doc_id and
text are one document to the removal (all lose the same lines); rows that
share a doc_id, or have none, with different texts are documents of their own;
runs that overlap an earlier copy of themselves in a text lose the
lines that go beyond it; ties can't be, as a place is unique; a text that
loses every line becomes empty, its row stays; an empty table gives no rows.
Other columns are carried through, but for ``lines`` and ``removed_lines``,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import only, unused, written

DIVISOR = 2
LONG_WORDS = 50
MOST_LINES = 64
TEXT = ["doc_id", "text_key"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, i, h, x, long`` of every line of every different row: its number from 0, short and long hash, and whether it is a paragraph."""
    rows = only(docs, "doc_id", "text").where("text IS NOT NULL")
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    h = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 7), 16, 10).cast("long")
    lines = lines.select(*TEXT, "i", h.alias("h"), F.xxhash64("line").alias("x"), (F.size(F.split("line", " ", LONG_WORDS)) >= LONG_WORDS).alias("long"))
    # Rows that repeat are brought together where the windows need a text's lines anyway.
    return lines.repartition(*TEXT).groupBy(*TEXT, "i").agg(*[F.first(c).alias(c) for c in ("h", "x", "long")])


def chunked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``start`` and ``stop``, the first and last line of each one's chunk."""
    w = Window.partitionBy(*TEXT).orderBy("i")
    rolled = F.pmod(F.col("h") * 31 + F.coalesce(F.lag("h").over(w), F.lit(0)), F.lit(1000003))
    ends = F.lead("i").over(w).isNull() | (F.pmod(rolled, F.lit(DIVISOR)) == 0) | F.col("long") | F.coalesce(F.lead("long").over(w), F.lit(False))
    out = lines.withColumn("ends", ends.cast("int"))
    out = out.withColumn("k", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min("i").over(Window.partitionBy(*TEXT, "k"))
    out = out.withColumn("first", first).withColumn("start", (F.col("first") + F.floor((F.col("i") - F.col("first")) / MOST_LINES) * MOST_LINES).cast("int"))
    return out.withColumn("stop", F.max("i").over(Window.partitionBy(*TEXT, "start"))).select(*TEXT, "i", "x", "long", "start", "stop")


def runs(lines: DataFrame) -> DataFrame:
    """``doc_id, text_key, a, b, run`` of every run: its first and last line, and the hashes of its lines."""
    c, w = Window.partitionBy(*TEXT, "start").orderBy("i"), Window.partitionBy(*TEXT).orderBy("i")
    out = chunked(lines).withColumns({"prefix": F.collect_list("x").over(c.rowsBetween(Window.unboundedPreceding, 0)), "suffix": F.collect_list("x").over(c.rowsBetween(0, Window.unboundedFollowing))})
    out = out.withColumns({"next_suffix": F.lead("suffix").over(w), "next_stop": F.lead("stop").over(w), "last_prefix": F.lag("prefix").over(w), "last_start": F.lag("start").over(w), "last_long": F.lag("long").over(w)})
    i, single_end, single_start = F.col("i"), F.col("i") == F.col("stop"), F.col("i") == F.col("start")
    run = lambda a, b, x: F.struct(a.alias("a"), b.alias("b"), x.alias("run"))
    from_here = (
        F.when(~single_end | F.col("long"), run(i, F.col("stop"), F.col("suffix")))
        .when(F.col("next_stop").isNotNull(), run(i, F.col("next_stop"), F.concat("suffix", "next_suffix")))
    )
    # What a run from an earlier line already is, is left out: whole chunks, and pairs of chunks of one line.
    paired = single_end & (F.col("last_start") == i - 1) & ~F.col("last_long")
    up_to_here = (
        F.when(~single_start & ~single_end, run(F.col("start"), i, F.col("prefix")))
        .when(single_start & ~F.col("long") & F.col("last_start").isNotNull() & ~paired, run(F.col("last_start"), i, F.concat("last_prefix", "prefix")))
    )
    out = out.select(*TEXT, F.explode(F.array_compact(F.array(from_here, up_to_here))).alias("r")).select(*TEXT, "r.*")
    empty = F.xxhash64(F.lit(""))
    return out.where((F.array_min("run") != empty) | (F.array_max("run") != empty))


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, again, removed``: the lines of each text that are in repeated runs, and those of them that it loses."""
    every = runs(hashed_lines(docs)).withColumn("own", F.row_number().over(Window.partitionBy(*TEXT, "run").orderBy("a")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc_id"), "text_key")
    twice = every.groupBy("run").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    lost = (F.col("own") > 1) | (place != F.col("first"))
    laid = every.join(twice, "run").select(*TEXT, F.explode(F.sequence("a", "b")).alias("i"), lost.cast("int").alias("lost"))
    lines = laid.groupBy(*TEXT, "i").agg(F.max("lost").alias("lost"))
    return lines.groupBy(*TEXT).agg(F.sort_array(F.collect_list("i")).alias("again"), F.sort_array(F.collect_list(F.when(F.col("lost") == 1, F.col("i")))).alias("removed"))


def without(lines: Column, removed: Column) -> Column:
    """The lines, of which some are left out: the stretches between them, laid end to end."""
    after = lambda k: F.coalesce(F.get(removed, k - 1), F.lit(-1)) + 1
    kept = F.transform(F.concat(removed, F.array(F.size(lines))), lambda at, k: F.slice(lines, after(k) + 1, at - after(k)))
    return F.flatten(kept)


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text that is left, ``lines`` (their number before) and ``removed_lines`` (numbers from 0)."""
    docs = docs.drop("lines", "removed_lines")
    doc_id, key, again, removed, known = (unused(docs, c) for c in ("_doc_id", "_text_key", "_again", "_removed", "_ambiguous"))
    lost = repeated(docs).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key), F.col("again").alias(again), F.col("removed").alias(removed))
    both = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.xxhash64("text").eqNullSafe(F.col(key)) & F.col("text").isNotNull(), "left").drop(doc_id, key)
    # The only table that holds whole texts; beside the shuffles it takes most of the disk, and zstd makes it a third smaller than snappy.
    both = written(both, "zstd")
    lines = split_lines(F.col("text"))
    compared = only(both, "text", again).where(F.col(again).isNotNull()).select(F.explode(F.transform(again, lambda i: F.get(lines, i))).alias("line"))
    pairs = compared.select(F.xxhash64("line").alias("x"), "line").distinct().groupBy("x").agg(F.count("*").alias("texts"))
    # One row. A hash of 64 bits hardly ever stands for two lines: among a trillion lines some 30,000 are expected to.
    ambiguous = pairs.where("texts > 1").agg(F.collect_list("x").alias(known))
    both = both.join(F.broadcast(ambiguous), F.lit(True))
    sure = (F.size(known) == 0) | ~F.exists(again, lambda i: F.array_contains(F.col(known), F.xxhash64(F.get(lines, i))))
    none = F.array().cast("array<int>")
    gone = F.when(F.col(removed).isNotNull() & sure, F.col(removed)).otherwise(none)
    both = both.withColumn(removed, gone)
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(without(lines, F.col(removed)), "\n"))
    number = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], number.alias("lines"), F.col(removed).alias("removed_lines"))


#: The rows of the query ``op6_line_dedup`` in DuckDB's SQL; runs are compared as lists of lines.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, md5(text) AS key, string_split(any_value(text), chr(10)) AS ls FROM documents WHERE text IS NOT NULL GROUP BY doc_id, md5(text)
), l AS (
  SELECT doc_id, key, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d
), m AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, len(string_split(line, ' ')) >= {LONG_WORDS} AS long FROM l
), e AS (
  SELECT *, lead(i) OVER w IS NULL OR ((h * 31 + coalesce(lag(h) OVER w, 0)) % 1000003) % {DIVISOR} = 0 OR long OR coalesce(lead(long) OVER w, false) AS ends FROM m WINDOW w AS (PARTITION BY doc_id, key ORDER BY i)
), k AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), f AS (
  SELECT *, min(i) OVER (PARTITION BY doc_id, key, k) AS first FROM k
), s AS (
  SELECT *, first + (i - first) // {MOST_LINES} * {MOST_LINES} AS start FROM f
), p AS (
  SELECT *, list(line) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix, list(line) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix, max(i) OVER (PARTITION BY doc_id, key, start) AS stop
  FROM s WINDOW c AS (PARTITION BY doc_id, key, start ORDER BY i)
), n AS (
  SELECT *, lead(suffix) OVER w AS next_suffix, lead(stop) OVER w AS next_stop, lag(prefix) OVER w AS last_prefix, lag(start) OVER w AS last_start FROM p WINDOW w AS (PARTITION BY doc_id, key ORDER BY i)
), r AS (
  SELECT doc_id, key, i AS a, stop AS b, suffix AS run FROM n WHERE i < stop OR long
  UNION SELECT doc_id, key, i, next_stop, list_concat(suffix, next_suffix) FROM n WHERE i = stop AND NOT long AND next_stop IS NOT NULL
  UNION SELECT doc_id, key, start, i, prefix FROM n WHERE i > start
  UNION SELECT doc_id, key, last_start, i, list_concat(last_prefix, prefix) FROM n WHERE i = start AND NOT long AND last_start IS NOT NULL
), u AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, key, run ORDER BY a) AS own FROM r WHERE len(list_filter(run, lambda t: t <> '')) > 0
), t AS (
  SELECT run, min((doc_id IS NULL, coalesce(doc_id, 0), key)) AS first FROM u GROUP BY run HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, key, unnest(range(a, b + 1)) AS i FROM u JOIN t USING (run) WHERE own > 1 OR (doc_id IS NULL, coalesce(doc_id, 0), key) <> first
), o AS (
  SELECT l.doc_id, l.key, count(*) AS lines, coalesce(string_agg(gone.i::VARCHAR, ',' ORDER BY l.i), '') AS removed, md5(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i), '')) AS kept_md5
  FROM l LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM l.doc_id AND gone.key = l.key AND gone.i = l.i GROUP BY l.doc_id, l.key
)
SELECT documents.doc_id, coalesce(o.lines, 0)::BIGINT AS lines, coalesce(o.removed, '') AS removed, o.kept_md5
FROM documents LEFT JOIN o ON o.doc_id IS NOT DISTINCT FROM documents.doc_id AND o.key = md5(documents.text)
"""
