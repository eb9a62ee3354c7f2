"""Places and exact order statistics of few large groups, with no group in one task.

Equal values are counted first, so a hot value is one row. The values of a group
that has many are cut into buckets at approximate quantiles; the buckets'
totals, a few rows a group, tell where each begins. Percentiles then order only
the buckets that hold the wanted places. Approximate quantiles depend on the
order in which their parts arrive, so they are written once: whatever reads
them, and a task that is run again, finds the same buckets. So are the counts,
unless the caller knows how large a group can be.

Defined cases: null values are left out (others should be finite); groups may
be null; a group without a value has no row; ties share what they are counted
for; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.storage import written

BUCKETS = 128
#: Values of a group up to which they are one bucket.
WHOLE = 8192


def _bucketed(counts: DataFrame, by: list[str], column: str, weights: list[str], buckets: int, most: int | None, whole: int) -> tuple[DataFrame, DataFrame]:
    """``counts`` with ``_g`` (the group) and ``_bucket``; the buckets with each weight's sum in and before them."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    if most is None:
        counts = written(counts)
        most = counts.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    grouped = counts.withColumn("_g", group)
    placed = grouped.withColumn("_bucket", F.lit(0))
    if most > whole:
        shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
        edges = grouped.groupBy(F.col("_g").alias("_eg")).agg(F.count("*").alias("_values"), F.percentile_approx(F.col(column).cast("double"), shares, F.lit(10 * buckets)).alias("_edges"))
        edges = written(edges.where(F.col("_values") > whole).drop("_values"))
        at = F.size(F.filter("_edges", lambda t: t <= F.col(column).cast("double")))
        placed = grouped.join(edges, F.col("_g") == F.col("_eg"), "left").withColumn("_bucket", F.when(F.col("_eg").isNull(), 0).otherwise(at)).drop("_eg", "_edges")
    totals = placed.groupBy(F.col("_g").alias("_tg"), F.col("_bucket").alias("_tb")).agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    earlier = Window.partitionBy("_tg").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    return placed, totals.withColumns({f"_before_{w}": F.coalesce(F.sum(f"_sum_{w}").over(earlier), F.lit(0)) for w in weights})


def running(counts: DataFrame, by: list[str], column: str, weights: dict[str, str], buckets: int = BUCKETS, whole: int = WHOLE) -> DataFrame:
    """``counts`` (a row a value) with, for each weight, the sum over the group's smaller values under the name given."""
    placed, totals = _bucketed(counts, by, column, list(weights), buckets, None, whole)
    inside = Window.partitionBy("_g", "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({name: F.coalesce(F.sum(w).over(inside), F.lit(0)) for w, name in weights.items()})
    out = own.join(totals, (F.col("_g") == F.col("_tg")) & (F.col("_bucket") == F.col("_tb")))
    return out.withColumns({name: F.col(name) + F.col(f"_before_{w}") for w, name in weights.items()}).select(*counts.columns, *weights.values())


def percentiles(rows: DataFrame, by: list[str], values: dict[str, Column], shares: list[float], buckets: int = BUCKETS, most: int | None = None, whole: int = WHOLE) -> DataFrame:
    """``by`` and, for each named value, the array of its percentiles (linear between neighbours) at the shares; null for a name without a value.

    ``most``, if known, is the number of rows of the largest group; groups of ``whole`` values or fewer aren't cut.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_of"), v.cast("double").alias("_v")) for k, v in values.items()])).alias("_s")
    counts = rows.select(*by, each).select(*by, "_s.*").where("_v IS NOT NULL").groupBy(*by, "_of", "_v").agg(F.count("*").alias("_n"))
    own = [*by, "_of"]
    placed, totals = _bucketed(counts, own, "_v", ["_n"], buckets, most, whole)
    size = F.sum("_sum__n").over(Window.partitionBy("_tg"))
    ends = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("_size") - 1)), F.ceil(q * (F.col("_size") - 1))) for q in map(F.lit, shares)])))
    wanted = F.filter(ends, lambda k: (k >= F.col("_before__n")) & (k < F.col("_before__n") + F.col("_sum__n")))
    asked = totals.withColumn("_size", size).withColumn("_ends", wanted).where(F.size("_ends") > 0)
    found = placed.join(asked, (F.col("_g") == F.col("_tg")) & (F.col("_bucket") == F.col("_tb")))
    first = F.col("_before__n") + F.coalesce(F.sum("_n").over(Window.partitionBy("_g", "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = found.withColumn("_first", first).select("_g", "_size", "_v", F.explode(F.filter("_ends", lambda k: (k >= F.col("_first")) & (k < F.col("_first") + F.col("_n")))).alias("_k"))
    at = hits.groupBy("_g").agg(F.max("_size").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))  # two places a share

    def share(q: float) -> Column:
        place = F.lit(q) * (F.col("_size") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = (F.element_at("_at", k) for k in (low, high))
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    told = at.select("_g.*", F.array(*map(share, shares)).alias("_p"))
    return told.groupBy(*by).agg(*[F.max(F.when(F.col("_of") == k, F.col("_p"))).alias(k) for k in values])


def medians(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``by`` and the median of each named value."""
    return percentiles(rows, by, values, [0.5]).select(*by, *[F.get(k, 0).alias(k) for k in values])
