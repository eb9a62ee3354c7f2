"""The monotone threshold classifier for any number of folds at once, in SQL terms.

A fold fits: impute by the median, turn the feature so that it rises with the
class, take each class's median, make the medians monotone by weighted
isotonic regression, and cut halfway between neighbours. There are few
classes, so everything after the class medians is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import selection


def rank_correlations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``by, N, rho``: Spearman's correlation, where equal values share the mean of their places; null for a constant column.

    Everything goes by counts of distinct pairs and values, never by whole groups of rows.
    """
    pairs = rows.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    rank = lambda c: selection.running(pairs.groupBy(*by, c).agg(F.sum("n").alias("n")), by, c, {"n": "before"}).select(*by, c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
    placed = pairs.join(rank("x"), [*by, "x"]).join(rank("y"), [*by, "y"])
    n, total = F.col("n"), F.sum("n")
    s = lambda e: F.sum(e * n)
    counts = pairs.groupBy(*by).agg(((F.sum("n") + 1) / 2).alias("m"))
    rx, ry = F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    out = placed.join(F.broadcast(counts), by).groupBy(*by).agg(total.alias("N"), s(rx * ry).alias("xy"), s(rx * rx).alias("xx"), s(ry * ry).alias("yy"))
    return out.select(*by, "N", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("rho"))


def finite(column: str):
    """The value, or null where it isn't a finite number."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def counted(rows: DataFrame, by: list[str], classes: list[int]) -> DataFrame:
    """``by, x, n``: how many rows of each class have a value (null: none that is finite)."""
    rows = rows.select(*by, finite("x").alias("x"), "y")
    return rows.groupBy(*by, "x").agg(F.array(*[F.count_if(F.col("y") == c) for c in classes]).alias("n"))


def rules(counts: DataFrame, by: list[str], classes: list[int]) -> DataFrame:
    """Per fold: ``median, orient, classes, cuts``, from counts by value.

    The values of a fold are placed once; medians, ranks and class medians all
    follow from how many rows of each class lie below a value. Rows without a
    value count at the median. The median of turned values is the turned
    median, so nothing is placed twice. A fold without any value raises.
    """
    k = len(classes)
    each = [F.get("n", c) for c in range(k)]
    wide = counts.select(*by, "x", *[v.alias(f"n{c}") for c, v in enumerate(each)], sum(each, F.lit(0)).alias("all"))
    wide = wide.where("all > 0")
    names = [f"n{c}" for c in range(k)] + ["all"]
    placed = selection.running(wide.where("x IS NOT NULL"), by, "x", {n: f"b_{n}" for n in names})
    # Whole folds: rows of each class, and those without a value.
    known = wide.groupBy(*by).agg(*[F.sum(n).alias(f"t_{n}") for n in names], *[F.sum(F.when(F.col("x").isNull(), F.col(n)).otherwise(0)).alias(f"o_{n}") for n in names])
    here = lambda i: F.max(F.when((F.col("b_all") <= i) & (i < F.col("b_all") + F.col("all")), F.col("x")))
    full = F.col("t_all") - F.col("o_all")
    low, high = F.floor((full - 1) / 2), F.ceil((full - 1) / 2)
    m = placed.join(F.broadcast(known), by).groupBy(*by).agg(((here(low) + here(high)) / 2).alias("m"))  # a row a fold
    known = known.join(m, by, "left").withColumn("m", F.when(F.col("m").isNull(), F.raise_error(F.lit("a feature has no value in the training rows"))).otherwise(F.col("m")))
    rows = placed.join(F.broadcast(known), by)  # a row a fold
    at, above = F.col("x") == F.col("m"), F.col("x") > F.col("m")
    # Mean places of a value and of a class, the rows without a value among them, less the mean of all places.
    middle = (F.col("t_all") + 1) / 2
    rx = F.col("b_all") + F.when(above, F.col("o_all")).otherwise(0) + (F.col("all") + F.when(at, F.col("o_all")).otherwise(0) + 1) / 2 - middle
    ry = [sum((F.col(f"t_n{i}") for i in range(c)), F.lit(0)) + (F.col(f"t_n{c}") + 1) / 2 - middle for c in range(k)]
    score = lambda prefix: sum((F.col(f"{prefix}n{c}") * ry[c] for c in range(k)), F.lit(0.0))
    spots = []
    for c in range(k):
        # The middle places of a class; a place that no other value has is at the median.
        first = F.col(f"b_n{c}") + F.when(above, F.col(f"o_n{c}")).otherwise(0)
        for name, place in (("lo", F.floor((F.col(f"t_n{c}") - 1) / 2)), ("hi", F.ceil((F.col(f"t_n{c}") - 1) / 2))):
            spots.append(F.max(F.when(~at & (first <= place) & (place < first + F.col(f"n{c}")), F.col("x"))).alias(f"{name}{c}"))
    below, same = F.sum(F.when(F.col("x") < F.col("m"), F.col("all"))), F.sum(F.when(at, F.col("all")))
    sums = rows.groupBy(*by).agg(F.sum(rx * score("")).alias("xy"), F.sum(F.col("all") * rx * rx).alias("xx"), F.coalesce(below, F.lit(0)).alias("below"), F.coalesce(same, F.lit(0)).alias("same"), *spots)
    told = known.join(sums, by, "left")
    rm = F.col("below") + (F.col("same") + F.col("o_all") + 1) / 2 - middle
    xy, xx = F.col("xy") + rm * score("o_"), F.col("xx") + F.col("o_all") * rm * rm
    yy = sum((F.col(f"t_n{c}") * ry[c] * ry[c] for c in range(k)), F.lit(0.0))
    orient = F.when(F.coalesce(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)), F.lit(-1.0)) >= 0, 1.0).otherwise(-1.0)
    told = told.withColumn("orient", orient)
    center = lambda c: (F.coalesce(f"lo{c}", "m") + F.coalesce(f"hi{c}", "m")) / 2 * F.col("orient")
    present = F.filter(F.array(*[F.struct(F.lit(v).alias("c"), center(c).alias("m"), F.col(f"t_n{c}").cast("double").alias("n")) for c, v in enumerate(classes)]), lambda s: s["n"] > 0)
    told = told.withColumn("s", present)
    # Weighted means of runs of classes i..j give the isotonic value: max over i <= c of min over j >= c.
    ends = F.sequence(F.lit(0), F.size("s") - 1)
    total = lambda i, j, f: F.aggregate(F.slice("s", i + 1, j - i + 1), F.lit(0.0), lambda a, e: a + f(e))
    mean = lambda i, j: total(i, j, lambda e: e["m"] * e["n"]) / total(i, j, lambda e: e["n"])
    value = lambda c: F.array_max(F.transform(F.filter(ends, lambda i: i <= c), lambda i: F.array_min(F.transform(F.filter(ends, lambda j: j >= c), lambda j: mean(i, j)))))
    told = told.withColumn("fitted", F.transform(ends, value))
    pairs = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda c: c < F.size("s") - 1)
    return told.select(*by, F.col("m").alias("median"), "orient", F.transform("s", lambda e: e["c"]).alias("classes"), F.transform(pairs, lambda c: (F.get("fitted", c) + F.get("fitted", c + 1)) / 2).alias("cuts"))


def classes_of(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("y").where("y IS NOT NULL").distinct().orderBy("y").collect()]


def fit(train: DataFrame, by: list[str], classes: list[int] | None = None) -> DataFrame:
    """Per fold: ``median, orient, classes, cuts``. ``train`` has ``by``, ``x`` (may be null or not finite) and ``y`` of a few classes."""
    classes = classes_of(train) if classes is None else classes
    return rules(counted(train, by, classes), by, classes)


def predict(test: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """``test`` (``by``, ``x``) with ``pred``."""
    x = F.coalesce(finite("x"), "median") * F.col("orient")
    at = F.size(F.filter("cuts", lambda t: t <= x))
    return test.join(F.broadcast(rules), by).withColumn("pred", F.get("classes", F.least(at, F.size("classes") - 1))).drop("median", "orient", "classes", "cuts")


def held_out(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """Leave-one-group-out predictions within each of ``by``; a fold is a group's value, rows train all the others.

    Groups are few (their list is laid beside each row), folds are fitted together.
    """
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    classes = classes_of(rows)
    fold = [*by, "held"]
    # Counts of each group once; a fold is the total less its own.
    n = lambda g, c: F.count_if((F.col(group) == g) & (F.col("y") == c))
    own = rows.select(*by, group, finite("x").alias("x"), "y").groupBy(*by, "x").agg(*[F.array(*[n(g, c) for c in classes]).alias(f"_{i}") for i, g in enumerate(groups)])
    total = [sum((F.get(f"_{i}", c) for i in range(len(groups))), F.lit(0)) for c in range(len(classes))]
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("held"), F.array(*[t - F.get(f"_{i}", c) for c, t in enumerate(total)]).alias("n")) for i, g in enumerate(groups)]))
    found = rules(own.select(*by, "x", each.alias("_f")).select(*by, "x", "_f.*"), fold, classes)
    return predict(rows.withColumn("held", F.col(group)), found, fold)
