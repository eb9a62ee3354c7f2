"""Agreement of raters and sensors: intraclass correlation, rank correlation, and their meta-analysis."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.threshold import rank_correlations
from treeline.settings import CONTEXT_EPS, EPS, Z95


def icc(rows: DataFrame, columns: list[str], by: list[str] = (), eps: float = CONTEXT_EPS) -> DataFrame:
    """``n, icc_a1, icc_ak`` of complete rows: two-way random effects, absolute agreement, from one pass of sums."""
    k = len(columns)
    mean = sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) / k
    full = rows.select(*by, *[F.col(c).cast("double").alias(f"r{i}") for i, c in enumerate(columns)], mean.alias("m")).dropna(subset=[f"r{i}" for i in range(k)])
    # Deviations from the row mean and the column variances are all that the sums of squares need.
    within = sum(((F.col(f"r{i}") - F.col("m")) ** 2 for i in range(k)), F.lit(0.0))
    s = full.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("m").alias("vm"), F.sum(within).alias("w"), F.avg("m").alias("g"), *[F.avg(f"r{i}").alias(f"c{i}") for i in range(k)])
    columns_ss = F.col("n") * sum(((F.col(f"c{i}") - F.col("g")) ** 2 for i in range(k)), F.lit(0.0))
    msr = k * F.col("n") * F.col("vm") / F.nullif(F.col("n") - 1, F.lit(0))
    msc = columns_ss / (k - 1)
    mse = (F.col("w") - columns_ss) / F.nullif((F.col("n") - 1) * (k - 1), F.lit(0))
    one, many = msr + (k - 1) * mse + k * (msc - mse) / F.col("n"), msr + (msc - mse) / F.col("n")
    value = lambda den: F.when((F.col("n") >= 3) & (F.abs(den) > eps), F.try_divide(msr - mse, den))
    return s.select(*by, "n", value(one).alias("icc_a1"), value(many).alias("icc_ak"))


def rank_correlation(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``N, rho`` per group over rows that have both; null where a column is constant."""
    return rank_correlations(rows.dropna(subset=[x, y]), x, y, by)


def with_p_values(rows: DataFrame) -> DataFrame:
    """``rows(N, rho)``, a row a group, with the two-sided ``p_value`` (null where it isn't defined)."""
    schema = rows.select("*", F.lit(None).cast("double").alias("p_value")).schema

    def valued(batches):
        for batch in batches:
            p = [t_two_sided(float("nan") if r is None else r, n) for r, n in zip(batch["rho"].to_pylist(), batch["N"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if math.isnan(v) else v for v in p], pa.float64())], names=schema.names)

    return rows.mapInArrow(valued, schema)


def fisher(rows: DataFrame) -> DataFrame:
    """``ci_low, ci_high`` beside ``N, rho``: null for three rows or fewer."""
    z = F.atanh(F.greatest(F.least(F.col("rho"), F.lit(0.999999)), F.lit(-0.999999)))
    half = F.when(F.col("N") > 3, Z95 / F.sqrt(F.greatest(F.col("N") - 3, F.lit(1))))
    return rows.withColumns({"ci_low": F.tanh(z - half), "ci_high": F.tanh(z + half)})


def random_effects(rows: DataFrame) -> DataFrame:
    """The pooled rank correlation of ``N, rho`` rows by random effects on Fisher's z; no row for fewer than two."""
    z = F.atanh(F.greatest(F.least(F.col("rho"), F.lit(0.999999)), F.lit(-0.999999)))
    used = rows.where("N > 3 AND rho IS NOT NULL").select(z.alias("z"), (F.col("N") - 3).cast("double").alias("w"))
    s = used.agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sww"), F.sum(F.col("w") * F.col("z")).alias("swz"), F.sum(F.col("w") * F.col("z") ** 2).alias("swzz")).where("k >= 2")
    q = F.greatest(F.col("swzz") - F.col("swz") ** 2 / F.col("sw"), F.lit(0.0))
    s = s.withColumn("Q", q).withColumn("df", F.col("k") - 1)
    c = F.col("sw") - F.col("sww") / F.col("sw")
    s = s.withColumn("tau2", F.when(c > 0, F.greatest((F.col("Q") - F.col("df")) / c, F.lit(0.0))).otherwise(0.0))
    # One row beside each of the few datasets.
    pooled = used.join(F.broadcast(s), F.lit(True)).groupBy("k", "Q", "df", "tau2").agg(F.sum(1 / (1 / F.col("w") + F.col("tau2"))).alias("wr"), F.sum(F.col("z") / (1 / F.col("w") + F.col("tau2"))).alias("wz"))
    mean, se = F.col("wz") / F.col("wr"), 1 / F.sqrt("wr")
    return pooled.select("k", F.tanh(mean).alias("rho"), F.tanh(mean - Z95 * se).alias("ci_low"), F.tanh(mean + Z95 * se).alias("ci_high"), "tau2", "Q", "df", F.when(F.col("Q") > 0, F.greatest((F.col("Q") - F.col("df")) / F.col("Q"), F.lit(0.0)) * 100).otherwise(0.0).alias("I2"))


def paired(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Sensor agreement of two columns: pairs, rank correlation, ICC(A,1), bias and mean absolute difference."""
    both = rows.dropna(subset=[x, y])
    gaps = both.groupBy(*by).agg(F.avg(F.col(y) - F.col(x)).alias("bias"), F.avg(F.abs(F.col(y) - F.col(x))).alias("mae"))
    return rank_correlation(both, x, y, by).join(icc(both, [x, y], by, EPS).drop("n", "icc_ak"), by).join(gaps, by)


def rating_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exact and within-one agreement of every pair of raters."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    means = rows.dropna(subset=columns).agg(*[F.avg(c.cast("double")).alias(f"{k}{i}") for i, (a, b) in enumerate(pairs) for k, c in (("e", gap(a, b) == 0), ("w", gap(a, b) <= 1))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"e{i}").alias("exact"), F.col(f"w{i}").alias("within1")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def rating_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean and sample deviation of each complete row."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    mean = sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) / len(columns)
    spread = sum(((F.col(c) - F.col("consensus")) ** 2 for c in columns), F.lit(0.0))
    full = rows.dropna(subset=columns).withColumns({"range": F.array_max(values) - F.array_min(values), "consensus": mean})
    return full.withColumn("sd", F.sqrt(spread / (len(columns) - 1)))


def t_two_sided(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's t; for the few rows of a report."""
    if n <= 2 or not math.isfinite(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    x = 1 - rho * rho  # = df / (df + t^2)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x)) / a
    value = 0.0
    for k in range(200, 0, -1):  # from the inside out
        even = k // 2
        term = even * (b - even) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + even) * (a + b + even) * x / ((a + k - 1) * (a + k))
        value = term / (1 + value)
    return front / (1 + value)


def mean_agreement(pairs: DataFrame) -> DataFrame:
    """The means over all pairs of raters."""
    return pairs.agg(F.avg("exact").alias("exact"), F.avg("within1").alias("within1"))
