"""Scores of ordinal predictions from confusion counts, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, truth, pred, n``; everything below starts from these few counts."""
    return rows.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def basic(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, mean absolute error, share within one class, and its complement."""
    total, gap = F.sum("n"), F.abs(F.col("truth") - F.col("pred"))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / total
    return counts.groupBy(*by).agg(total.alias("N"), share(gap == 0).alias("Accuracy"), (F.sum(gap * F.col("n")) / total).alias("MAE"), share(gap <= 1).alias("Within1"), (1 - share(gap <= 1)).alias("SevereErrorRate"))


def balanced(counts: DataFrame, by: list[str]) -> DataFrame:
    """Balanced accuracy (mean recall of the classes among true ones) and macro F1 (over classes true or predicted; 0 where undefined)."""
    each = counts.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t")))).alias("s"), "n", (F.col("truth") == F.col("pred")).alias("hit"))
    per = each.groupBy(*by, F.col("s.c").alias("c")).agg(*[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(k) for k, x in (("true_n", F.col("s.t") == 1), ("pred_n", F.col("s.t") == 0), ("hit_n", (F.col("s.t") == 1) & F.col("hit")))])
    return per.groupBy(*by).agg(F.avg(F.try_divide(F.col("hit_n"), F.col("true_n"))).alias("BalancedAccuracy"), F.avg(2 * F.col("hit_n") / (F.col("true_n") + F.col("pred_n"))).alias("MacroF1"))


def kappa(counts: DataFrame, by: list[str]) -> DataFrame:
    """Quadratic-weighted kappa; weights go by a label's rank among the labels that occur in the group."""
    labels = counts.select(*by, F.explode(F.array("truth", "pred")).alias("c")).distinct()
    ranked = labels.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("c")))
    at = lambda name: ranked.select(*by, F.col("c").alias(name), F.col("k").alias(f"{name}_k"))
    placed = counts.join(at("truth"), [*by, "truth"]).join(at("pred"), [*by, "pred"])
    n, t, p = F.col("n"), F.col("truth_k"), F.col("pred_k")
    # Sum over all cells of (i - j)^2 * row_i * col_j / N, opened out into moments.
    s = lambda e: F.sum(e * n)
    expected = s(t**2) + s(p**2) - 2 * s(t) * s(p) / F.sum(n)
    return placed.groupBy(*by).agg((1 - F.try_divide(s((t - p) ** 2), expected)).alias("QWK"))


def block(counts: DataFrame, by: list[str]) -> DataFrame:
    """The metric block of each group, from confusion counts (a group's may come in several parts)."""
    counts = counts.groupBy(*by, "truth", "pred").agg(F.sum("n").alias("n"))
    return basic(counts, by).join(balanced(counts, by), by).join(kappa(counts, by), by)


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """The metric block of each group."""
    return block(confusion(rows, by), by)


def fields_block(counts: DataFrame, by: list[str], field: str = "held_field") -> DataFrame:
    """Pooled accuracy with the mean, least, greatest and spread (population) of the fields' accuracies, from confusion counts of each field."""
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    per = counts.groupBy(*by, field).agg(F.sum("n").alias("n"), (hit / F.sum("n")).alias("a"))
    return per.groupBy(*by).agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("Accuracy"), F.avg("a").alias("FieldUnweightedAccuracy"), F.min("a").alias("WorstFieldAccuracy"), F.max("a").alias("BestFieldAccuracy"), F.stddev_pop("a").alias("FieldAccuracySD"))


def fields_summary(rows: DataFrame, by: list[str], field: str = "held_field") -> DataFrame:
    return fields_block(confusion(rows, [*by, field]), by, field)


def merged(label: Column) -> Column:
    """The label scheme in which the two lowest classes are one."""
    return F.greatest(label - 1, F.lit(0))
