"""Per-tree descriptors of point clouds.

``features`` is one chain of window functions: all windows are partitioned by
the tree's keys or by the keys and a cell, so the whole chain needs one
exchange, and columns that a query doesn't ask for are pruned with their
windows. A tree's points must fit one task there.

``spread_features`` follows the same chain for trees of any size: what a step
needs to know of a tree (percentiles by selection, counts, moments) is found
over many tasks, written as a row a tree, and joined to the points, which stay
where they are. ``all_features`` sends each tree the way that its number of
points asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline import settings as S
from treeline.operators import selection
from treeline.storage import written

#: Points of a tree up to which one task holds them.
LARGE = 5_000_000


def finite(*columns: str) -> Column:
    """All the columns are numbers: not null, not NaN, not infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def percentiles(column: Column | str, shares: tuple[float, ...]) -> Column:
    """Exact, linearly interpolated percentiles as an array; nulls are left out."""
    return F.percentile(column, F.array(*map(F.lit, shares)))


class InTask:
    """Figures of a tree beside its points, by windows over the tree."""

    def add(self, points: DataFrame, keys: list[str], shares: dict[str, tuple[Column, tuple[float, ...]]], others: dict[str, Column] | None = None) -> DataFrame:
        """``points`` with the percentiles of columns at shares (arrays) and other aggregates of their tree."""
        w = Window.partitionBy(*keys)
        return points.withColumns({n: percentiles(c, q).over(w) for n, (c, q) in shares.items()} | {n: f.over(w) for n, f in (others or {}).items()})


class OverTasks:
    """The same figures found over many tasks and joined to the points; a row a tree is written at each step."""

    def __init__(self, most: int | None = None):
        self.most = most  # points of the largest tree, if known

    def add(self, points: DataFrame, keys: list[str], shares: dict[str, tuple[Column, tuple[float, ...]]], others: dict[str, Column] | None = None) -> DataFrame:
        of = [f"_of{k}" for k in range(len(keys))]
        own = points.withColumns(dict(zip(of, map(F.col, keys), strict=True)))
        found = own.groupBy(*of).agg(F.count("*").alias("_rows"), *[f.alias(n) for n, f in (others or {}).items()])
        for q in {q for _, q in shares.values()}:
            more = selection.percentiles(own, of, {n: c for n, (c, at) in shares.items() if at == q}, list(q), most=self.most)
            found = same_trees(found, more, of, of).select(*[F.col(n) for n in dict.fromkeys([*found.columns, *more.columns])])
        found = written(found.drop("_rows"))
        return same_trees(points, found, keys, of)


def same_trees(left: DataFrame, right: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, a row a tree, whose keys (null or not) are in ``of``."""
    names = [f"_key{k}" for k in range(len(of))]
    right = right.withColumnsRenamed(dict(zip(of, names, strict=True)))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return left.join(right, same).drop(*names)


IN_TASK = InTask()


def trimmed(points: DataFrame, keys: list[str], how: InTask | OverTasks = IN_TASK) -> DataFrame:
    """Finite points between the height percentiles of their tree, with relative height ``h`` and depth ``d``."""
    out = how.add(points.where(finite("x", "y", "z")), keys, {"_z": (F.col("z"), S.Z_TRIM)}, {"_n": F.count("*")})
    out = out.withColumns({"zlo": F.get("_z", 0), "zhi": F.get("_z", 1)}).where((F.col("_n") >= S.MIN_POINTS) & (F.col("zhi") > F.col("zlo")) & F.col("z").between(F.col("zlo"), F.col("zhi")))
    return out.withColumn("h", (F.col("z") - F.col("zlo")) / (F.col("zhi") - F.col("zlo"))).withColumn("d", 1 - F.col("h")).drop("_z", "_n")


def framed(points: DataFrame, keys: list[str], how: InTask | OverTasks = IN_TASK) -> DataFrame:
    """Trimmed points in their tree's frame: ``u, v`` along the principal axes, ``rho, theta`` in the ellipse, ``crown_length, crown_width``."""
    out = how.add(trimmed(points, keys, how), keys, {"_mx": (F.col("x"), (0.5,)), "_my": (F.col("y"), (0.5,))})
    out = out.withColumns({"_cx": F.col("x") - F.get("_mx", 0), "_cy": F.col("y") - F.get("_my", 0)})
    out = out.withColumn("_r0", F.sqrt(F.col("_cx") ** 2 + F.col("_cy") ** 2))
    # A tree has MIN_POINTS points or more, so the reduced rules for fewer than 20 can't apply.
    out = how.add(out, keys, {"_far": (F.col("_r0"), (0.99,))}).withColumn("_near", F.col("_r0") <= F.get("_far", 0))
    cx, cy = F.when(F.col("_near"), F.col("_cx")), F.when(F.col("_near"), F.col("_cy"))
    out = how.add(out, keys, {}, {"_cxy": F.covar_samp(cx, cy), "_vx": F.var_samp(cx), "_vy": F.var_samp(cy)})
    out = out.withColumn("_angle", 0.5 * F.atan2(2 * F.col("_cxy"), F.col("_vx") - F.col("_vy")))
    cos, sin = F.cos("_angle"), F.sin("_angle")
    out = out.withColumns({"_u": F.col("_cx") * cos + F.col("_cy") * sin, "_v": F.col("_cy") * cos - F.col("_cx") * sin})
    out = how.add(out, keys, {"_qu": (F.col("_u"), S.XY_TRIM), "_qv": (F.col("_v"), S.XY_TRIM)})
    half = lambda q: F.greatest((F.get(q, 1) - F.get(q, 0)) / 2, F.lit(1e-6))
    moved = lambda c, q: F.col(c) - (F.get(q, 0) + F.get(q, 1)) / 2
    swap = half("_qv") > half("_qu")
    out = out.withColumns({"u": F.when(swap, moved("_v", "_qv")).otherwise(moved("_u", "_qu")), "v": F.when(swap, moved("_u", "_qu")).otherwise(moved("_v", "_qv")), "_a": F.greatest(half("_qu"), half("_qv")), "_b": F.least(half("_qu"), half("_qv"))})
    su, sv = F.col("u") / F.col("_a"), F.col("v") / F.col("_b")
    return out.withColumns({"rho": F.sqrt(su**2 + sv**2), "theta": F.pmod(F.atan2(sv, su), 2 * F.pi()), "crown_length": 2 * F.col("_a"), "crown_width": 2 * F.col("_b")})


def depth_bin(d: Column) -> Column:
    """Number from 0 on of the depth bin whose edges are multiples of ``BIN``; the last bin is closed."""
    near = F.floor(d * S.BINS)
    edge = lambda k: k.cast("double") * S.BIN
    exact = near + F.when(d >= edge(near + 1), 1).when(d < edge(near), -1).otherwise(0)
    return F.least(exact, F.lit(S.BINS - 1))


def placed(points: DataFrame, keys: list[str], how: InTask | OverTasks = IN_TASK) -> DataFrame:
    """Framed points with their grid and polar cells (null outside), and how many points of the tree are in either."""
    out = how.add(framed(points, keys, how), keys, {"_wu": (F.col("u"), S.XY_TRIM), "_wv": (F.col("v"), S.XY_TRIM)}, {"_n": F.count("*")})
    inside = F.col("u").between(F.get("_wu", 0), F.get("_wu", 1)) & F.col("v").between(F.get("_wv", 0), F.get("_wv", 1))
    inside &= (F.get("_wu", 1) > F.get("_wu", 0)) & (F.get("_wv", 1) > F.get("_wv", 0))
    cell = lambda c, q: F.least(F.greatest(F.floor((F.col(c) - F.get(q, 0)) / (F.get(q, 1) - F.get(q, 0) + S.EPS) * S.GRID), F.lit(0)), F.lit(S.GRID - 1))
    bounds = [F.sqrt(F.lit(i / S.RINGS)) for i in range(1, S.RINGS)]
    ring = sum(((F.col("rho") >= b).cast("int") for b in bounds), F.lit(0))
    out = out.withColumns({"_in": inside, "_disc": F.col("rho") <= 1})
    out = out.withColumns({
        "_grid": F.when(F.col("_in"), cell("u", "_wu") * S.GRID + cell("v", "_wv")),
        "_polar": F.when(F.col("_disc"), ring * S.SECTORS + F.least(F.floor(F.col("theta") / (2 * F.pi()) * S.SECTORS), F.lit(S.SECTORS - 1))),
    })
    return how.add(out, keys, {}, {"_ng": F.count_if("_in"), "_np": F.count_if("_disc")})


def celled(points: DataFrame, keys: list[str]) -> DataFrame:
    """Framed points with their grid and polar cells' figures; ``grid_first`` and ``polar_first`` mark one point of each valid cell."""
    out = placed(points, keys)
    g, p = Window.partitionBy(*keys, "_grid"), Window.partitionBy(*keys, "_polar")
    deep = F.avg((F.col("d") >= S.MIDPOINT).cast("double"))
    least = S.GRID_POINTS * S.GRID_CELLS
    out = out.withColumns({"_gc": F.count("*").over(g), "grid_share": deep.over(g), "_g1": F.row_number().over(g.orderBy("z"))})
    out = out.withColumns({"_pc": F.count("*").over(p), "polar_p90": F.percentile("d", F.lit(0.9)).over(p), "_p1": F.row_number().over(p.orderBy("z"))})
    return out.withColumns({
        "grid_first": F.col("_in") & (F.col("_g1") == 1) & (F.col("_gc") >= S.GRID_POINTS) & (F.col("_n") >= least) & (F.col("_ng") >= least),
        "polar_first": F.col("_disc") & (F.col("_p1") == 1) & (F.col("_pc") >= S.POLAR_POINTS) & (F.col("_np") >= S.POLAR_POINTS * S.POLAR_CELLS),
    })


def figures() -> list[Column]:
    """What is told of a tree from its framed points alone."""
    share = lambda c: F.avg(c.cast("double"))
    deep, core = F.col("d") >= S.MIDPOINT, F.sqrt(F.col("u") ** 2 + F.col("v") ** 2) <= S.CORE_FACTOR * (F.col("crown_length") + F.col("crown_width")) / 2
    bin_ = depth_bin(F.col("d"))
    return [
        F.count("*").alias("PointCount"),
        F.first(F.col("zhi") - F.col("zlo")).alias("TreeHeight"),
        F.count_if(core).alias("CorePointCount"),
        F.first("crown_length").alias("CrownLength"),
        F.first("crown_width").alias("CrownWidth"),
        ((share(F.col("h") <= 0.30) + 1e-6) / (share(F.col("h") >= 0.70) + 1e-6)).alias("VRI"),
        share(deep).alias("GlobalPF50"),
        F.when(F.count_if(core) >= S.CORE_POINTS, F.avg(F.when(core, deep.cast("double")))).alias("CorePF50"),
        *[share(bin_ == k).alias(f"p{k + 1}") for k in range(S.BINS)],
    ]


COLUMNS = ["PointCount", "TreeHeight", "CorePointCount", "CrownLength", "CrownWidth", "VRI", "GlobalPF50", "CorePF50", "TA50", "PGF50", "GridValidCells", "CPC90", *[f"p{k + 1}" for k in range(S.BINS)]]


def features(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row of descriptors per tree, in the order of the feature table."""
    valid, polar = F.count_if("grid_first"), F.count_if("polar_first")
    local = F.when(F.col("grid_first"), F.col("grid_share"))
    cells = [
        F.when(valid >= S.GRID_CELLS, F.avg(local)).alias("TA50"),
        F.when(valid >= S.GRID_CELLS, F.avg((local >= S.GRID_SHARE).cast("double"))).alias("PGF50"),
        valid.alias("GridValidCells"),
        F.when(polar >= S.POLAR_CELLS, F.median(F.when(F.col("polar_first"), F.col("polar_p90")))).alias("CPC90"),
    ]
    return celled(points, keys).groupBy(*keys).agg(*figures(), *cells).select(*keys, *COLUMNS)


def spread_features(points: DataFrame, keys: list[str]) -> DataFrame:
    """``features`` of trees of any size: no task holds a tree's points."""
    of = [f"_of{k}" for k in range(len(keys))]
    most = points.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    out = placed(points, keys, OverTasks(most)).withColumns(dict(zip(of, map(F.col, keys), strict=True)))
    base = out.groupBy(*of).agg(*figures(), F.first("_n").alias("_n"), F.first("_ng").alias("_ng"), F.first("_np").alias("_np"))
    least = S.GRID_POINTS * S.GRID_CELLS
    grid = out.where("_in").groupBy(*of, "_grid").agg(F.count("*").alias("_c"), F.avg((F.col("d") >= S.MIDPOINT).cast("double")).alias("_s")).where(F.col("_c") >= S.GRID_POINTS)
    grid = grid.groupBy(*of).agg(F.count("*").alias("_cells"), F.avg("_s").alias("_ta"), F.avg((F.col("_s") >= S.GRID_SHARE).cast("double")).alias("_pgf"))
    disc = out.where("_disc")
    full = disc.groupBy(*of, "_polar").agg(F.count("*").alias("_c")).where(F.col("_c") >= S.POLAR_POINTS)
    deepest = selection.percentiles(disc, [*of, "_polar"], {"_p": F.col("d")}, [0.9], most=most)
    polar = same_trees(full, deepest, [*of, "_polar"], [*of, "_polar"]).groupBy(*of).agg(F.count("*").alias("_rings"), F.median(F.get("_p", 0)).alias("_cpc"))  # some forty cells a tree
    for more in (grid, polar):
        names = [f"_key{k}" for k in range(len(of))]
        same = F.lit(True)
        for k, n in zip(of, names, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(n))
        base = base.join(more.withColumnsRenamed(dict(zip(of, names, strict=True))), same, "left").drop(*names)
    cells = F.when((F.col("_n") >= least) & (F.col("_ng") >= least), F.coalesce("_cells", F.lit(0))).otherwise(0)
    rings = F.when(F.col("_np") >= S.POLAR_POINTS * S.POLAR_CELLS, F.coalesce("_rings", F.lit(0))).otherwise(0)
    told = {"TA50": F.when(cells >= S.GRID_CELLS, F.col("_ta")), "PGF50": F.when(cells >= S.GRID_CELLS, F.col("_pgf")), "GridValidCells": cells, "CPC90": F.when(rings >= S.POLAR_CELLS, F.col("_cpc"))}
    return base.withColumns(told).withColumnsRenamed(dict(zip(of, keys, strict=True))).select(*keys, *COLUMNS)


def all_features(points: DataFrame, keys: list[str], large: int = LARGE) -> DataFrame:
    """``features`` of every tree: those of more than ``large`` points are spread over tasks, the others go to one each."""
    of = [f"_of{k}" for k in range(len(keys))]
    counts = points.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)]).agg(F.count("*").alias("_points"))
    big = written(counts.where(F.col("_points") > large).drop("_points"))
    if big.isEmpty():
        return features(points, keys)
    same = F.lit(True)
    for k, o in zip(keys, of, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(o))
    small = features(points.join(big, same, "left_anti"), keys)
    return small.unionByName(spread_features(points.join(big, same, "left_semi"), keys))
