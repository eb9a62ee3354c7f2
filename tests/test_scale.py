"""Selection, forests, group folds, digests and ranged reads against plain versions."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_units import ellipse, feature_table, write_las
from treeline import settings as S
from treeline.operators import checks, cloud, cnn, evaluate, forest, scores, selection, summaries, threshold
from treeline.plans import extract
from treeline.sources import las, names


@pytest.mark.parametrize("buckets", [3, 128])
def test_percentiles_equal_plain_ones(spark, buckets):
    rng = np.random.default_rng(2)
    rows = [(None if k % 3 == 0 else "b", float(v), None if k % 5 == 0 else float(w)) for k, (v, w) in enumerate(zip(rng.integers(0, 40, 700), rng.normal(size=700), strict=True))]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    table = pd.DataFrame(rows, columns=["g", "v", "w"])
    got = {r["g"]: r for r in selection.percentiles(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, shares, buckets).collect()}
    assert set(got) == {None, "b"}
    for g, r in got.items():
        own = table[table.g.isna() if g is None else table.g == g]
        assert r["v"] == pytest.approx(np.percentile(own.v, [100 * q for q in shares])) and r["w"] == pytest.approx(np.nanpercentile(own.w, [100 * q for q in shares]))
    one = selection.percentiles(df, [], {"v": F.col("v")}, [0.5], buckets).collect()
    assert len(one) == 1 and one[0]["v"] == [np.median(table.v)]
    assert selection.medians(df.where("false"), ["g"], {"v": F.col("v")}).collect() == []
    none = selection.medians(df.withColumn("n", F.lit(None).cast("double")), ["g"], {"n": F.col("n"), "v": F.col("v")}).collect()
    assert [r["n"] for r in none] == [None, None] and None not in [r["v"] for r in none]


def test_percentiles_order_only_the_buckets_asked_for(spark):
    """No task of the ordering has more than a bucket: most rows are left behind by the join with the buckets."""
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: r["v"] for r in selection.medians(df, ["g"], {"v": F.col("v")}).collect()}
    assert got == {0: 49_999.0, 1: 50_000.0}


def plain_tree(x, y, counts, weight, path, classes, test):
    """One exact tree grown node by node, with the same draws and feature orders; the leaf's shares for each test row."""
    held = np.bincount(y, counts, classes)
    shares = held * weight / max((held * weight).sum(), 1e-300)
    asked, n = max(1, int(math.sqrt(x.shape[1]))), len(y)
    if (held > 0).sum() < 2 or n < 4:
        return np.tile(shares, (len(test), 1))
    best, looked = None, 0
    for f in forest.feature_order(np.array([path], np.uint64), x.shape[1])[0]:
        if looked >= asked and best is not None:
            break
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        looked += 1
        for a, b in zip(values, values[1:], strict=False):
            left = x[:, f] <= a
            if 2 <= left.sum() <= n - 2:
                score = 0.0
                for side in (left, ~left):
                    w = np.bincount(y[side], counts[side], classes) * weight
                    score += (w**2).sum() / w.sum()
                if best is None or score > best[0] + 1e-12:
                    best = (score, f, float(forest.between(np.array([a]), np.array([b]))[0]))
    if best is None:
        return np.tile(shares, (len(test), 1))
    _, f, t = best
    out = np.empty((len(test), classes))
    for side, keep, asks in ((0, x[:, f] <= t, test[:, f] <= t), (1, x[:, f] > t, test[:, f] > t)):
        child = int(forest.child_paths(np.array([path], np.uint64), side)[0])
        out[asks] = plain_tree(x[keep], y[keep], counts[keep], weight, child, classes, test[asks])
    return out


def plain_forest(x, y, ids, test, seed, trees, classes):
    total = np.zeros((len(test), classes))
    drawn = forest.draws(ids, seed, np.arange(trees))
    for t, path in enumerate(forest.root_paths(seed, np.arange(trees)).tolist()):
        used = drawn[t] > 0
        weight = forest.balanced(np.bincount(y, drawn[t], classes).astype(float))
        total += plain_tree(x[used], y[used], drawn[t][used], weight, path, classes, test)
    return total / trees


def forest_tables(spark, seed=4, n=160, fits=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, n)
    x = np.column_stack([(y + rng.normal(0, 1, n)).round(1), rng.integers(0, 6, n).astype(float), np.full(n, 2.0), rng.normal(0, 1, n).round(1) - y])
    x[::11, 0] = np.nan
    train = [(f, int(k), [None if np.isnan(v) else float(v) for v in x[k]], int(y[k])) for f in range(fits) for k in range(n) if k % (3 + f)]
    test = [(f, [None if np.isnan(v) else float(v) for v in x[k]], k) for f in range(fits) for k in range(n) if not k % (3 + f)]
    return spark.createDataFrame(train, "fit int, id long, x array<double>, y int").repartition(5), spark.createDataFrame(test, "fit int, x array<double>, k int").repartition(3), train, test


@pytest.mark.parametrize("local", [32_768, 60, 25])
def test_forest_equals_plain_trees(spark, local):
    """Whole fits in a task, and fits whose upper nodes come from histograms, give the plain trees' predictions."""
    train, test, rows, asks = forest_tables(spark)
    got = forest.fit_predict(train, test, 4, trees=7, seed=5, local=local).collect()
    assert len(got) == len(asks)
    by = {(r["fit"], r["k"]): r["pred"] for r in got}
    for f in (0, 1):
        own = [r for r in rows if r[0] == f]
        x = np.array([[np.nan if v is None else v for v in r[2]] for r in own])
        middle = np.nanmedian(x, axis=0)
        asked = np.array([[np.nan if v is None else v for v in r[1]] for r in asks if r[0] == f])
        fill = lambda a: np.where(np.isnan(a), middle, a)  # noqa: E731, B023
        seed = int(forest._mix(np.array([5 * 1_000_003 + f], np.uint64))[0] >> np.uint64(33))
        want = plain_forest(fill(x), np.array([r[3] for r in own]), np.array([r[1] for r in own]), fill(asked), seed, 7, 4)
        for r, p in zip([r for r in asks if r[0] == f], want, strict=True):
            best = np.flatnonzero(p > p.max() - 1e-9)
            assert by[f, r[2]] in best


def test_forest_draws_rows_about_once_and_balances_each_sample():
    n = forest.draws(np.arange(20_000), 7, np.arange(3))
    assert n.mean(1) == pytest.approx([1, 1, 1], abs=0.03) and n.var(1) == pytest.approx([1, 1, 1], abs=0.05)
    assert forest.balanced(np.array([[8.0, 2.0, 0.0]])).tolist() == [[10 / 16, 10 / 4, 0.0]]


def test_forest_of_many_values_by_quantiles(spark):
    """With more values than bins the upper splits are near, not equal: the classes are told apart all the same."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 3000)
    x = y * 2 + rng.normal(0, 0.4, 3000)
    rows = spark.createDataFrame([(0, k, [float(a), float(k % 7)], int(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "fit int, id long, x array<double>, y int")
    got = forest.fit_predict(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0").drop("id"), 2, trees=10, local=400).toPandas()
    assert len(got) == 750 and (got.y == got.pred).mean() > 0.97


def test_forest_of_odd_tables(spark):
    train, test, *_ = forest_tables(spark, fits=1)
    assert forest.fit_predict(train, test.where("false"), 4, trees=3).collect() == []
    assert [r["pred"] for r in forest.fit_predict(train.where("false"), test, 4, trees=3).collect()] == [None] * test.count()
    one = forest.fit_predict(train.withColumn("y", F.lit(2)), test, 4, trees=3)
    assert {r["pred"] for r in one.collect()} == {2}
    assert {r["pred"] for r in forest.fit_predict(train, test.withColumn("fit", F.lit(9)), 4, trees=3).collect()} == {None}
    with pytest.raises(ValueError, match="no value"):
        forest.fit_predict(train.withColumn("x", F.transform("x", lambda v: F.lit(float("nan")))), test, 4, trees=3)


def test_forests_in_the_grid(spark, monkeypatch):
    monkeypatch.setattr(S, "TREES", 20)
    rows = feature_table(spark)
    lofo = evaluate.leave_one_field_out(rows, ["MidpointCompact_RF", "MidpointCompact_LR", "GlobalPF_Threshold", "MidpointExtended_LR"])
    assert lofo.count() == 96 * 2 * 4 and lofo.where("pred IS NULL").isEmpty()
    found = scores.scores(lofo, ["scheme", "method"]).toPandas().set_index(["scheme", "method"])
    assert found.loc["five_class", "MidpointCompact_RF"].Accuracy > 0.35
    gaps = evaluate.paired_bootstrap(lofo, resamples=200).collect()
    assert len(gaps) == 2 * 3 * 5 and {(r["a"], r["b"]) for r in gaps} == set(S.PAIRS)
    for r in gaps:
        a, b = (found.loc[r["scheme"], r[m]][r["metric"]] for m in "ab")
        assert r["A_minus_B"] == pytest.approx(a - b, abs=1e-9)
        assert r["CI95_low"] <= r["CI95_high"]


def test_altitudes_in_one_grid_equal_one_after_another(spark):
    rows = feature_table(spark).select("*", F.explode(F.array(F.lit(20), F.lit(60))).alias("altitude")).withColumn("CorePF50", F.col("CorePF50") + F.when(F.col("altitude") == 60, F.col("class") * 2).otherwise(0))
    got = {(r["altitude"], r["method"]): r for r in evaluate.altitudes(rows).collect()}
    assert len(got) == 4
    for a in (20, 60):
        own = rows.where((F.col("altitude") == a) & F.col("field").isin(1, 2, 3)).drop("altitude")
        for r in evaluate.summary(evaluate.leave_one_field_out(own, S.ALTITUDE_METHODS, ["five_class"]), ["method"]).collect():
            assert got[a, r["method"]]["Accuracy"] == pytest.approx(r["Accuracy"]) and got[a, r["method"]]["NCommonTrees"] == r["N"] == 72
    assert got[60, "MidpointCompact_LR"]["Accuracy"] > got[20, "MidpointCompact_LR"]["Accuracy"]


def plain_rule(x, y):
    x = np.array([np.nan if v is None else v for v in x], float)
    m = np.nanmedian(x)
    x = np.where(np.isfinite(x), x, m)
    a, b = pd.Series(x).rank(), pd.Series(y).rank()
    rho = np.corrcoef(a, b)[0, 1] if a.std() and b.std() else -1.0
    o = 1.0 if rho >= 0 else -1.0
    z, classes = o * x, sorted(set(y))
    c, n = [np.median(z[y == k]) for k in classes], [(y == k).sum() for k in classes]
    fitted = [max(min(np.average(c[i : j + 1], weights=n[i : j + 1]) for j in range(k, len(c))) for i in range(k + 1)) for k in range(len(c))]
    return m, o, classes, [(p + q) / 2 for p, q in zip(fitted, fitted[1:], strict=False)]


def test_rules_equal_plain_ones(spark):
    rng = random.Random(6)
    rows = []
    for f in range(40):
        n, sign = rng.randrange(6, 60), rng.choice([1, -1])
        for _ in range(n):
            y = rng.randrange(rng.choice([2, 5]))
            rows.append((f, None if rng.random() < 0.15 else round(sign * y * rng.random() + rng.choice([0, 0.5]), 1), y))
    got = {r["f"]: r for r in threshold.fit(spark.createDataFrame(rows, "f int, x double, y int").repartition(4), ["f"]).collect()}
    assert len(got) == 40
    for f, r in got.items():
        m, o, classes, cuts = plain_rule([v for k, v, _ in rows if k == f], np.array([y for k, _, y in rows if k == f]))
        assert (r["median"], r["orient"], r["classes"]) == (pytest.approx(m), o, classes) and r["cuts"] == pytest.approx(cuts)
    with pytest.raises(Exception, match="no value"):
        threshold.fit(spark.createDataFrame([(1, None, 0), (1, None, 1)], "f int, x double, y int"), ["f"]).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_group_folds_keep_groups_and_spread_classes(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([0, 0, 1, 2]), k) for g in range(300) for k in range(rng.choice([1, 1, 2, 3]))]
    f = checks.group_folds(spark.createDataFrame(rows, "g int, label int, k int").repartition(5), "g", "label", repeats=3).toPandas()
    assert len(f) == 900 and f.groupby(["repeat", "g"]).fold.nunique().eq(1).all() and set(f.fold) == {0, 1, 2, 3, 4}
    table = pd.DataFrame(rows, columns=["g", "label", "k"]).merge(f, on="g")
    share = table.groupby(["repeat", "fold", "label"]).size().unstack()
    largest = max(pd.DataFrame(rows, columns=["g", "label", "k"]).groupby(["g", "label"]).size())
    for c in share:
        assert (share[c] - share[c].mean()).abs().max() <= largest + 1
    assert f.pivot(index="g", columns="repeat", values="fold").nunique(axis=1).gt(1).mean() > 0.5
    single = spark.createDataFrame([(k, k % 3) for k in range(61)], "g int, label int")
    even = checks.group_folds(single, "g", "label", repeats=2).toPandas().merge(pd.DataFrame({"g": range(61), "label": [k % 3 for k in range(61)]}), on="g")
    sizes = even.groupby(["repeat", "fold", "label"]).size()
    assert sizes.max() - sizes.min() <= 1
    assert checks.group_folds(single.where("false"), "g", "label").collect() == []


def test_digest_of_many_blocks(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("t,"), F.col("id")).alias("TreeKey"), (F.col("id") % 5).cast("int").alias("Class"), *[(F.col("id") / (k + 3)).alias(f"p{k + 1}") for k in range(20)])
    table = rows.toPandas()
    table = table.iloc[sorted(range(len(table)), key=lambda k: table.TreeKey[k].encode())]
    text = ",".join(table.columns) + "\n" + "".join(f'"{r[0]}",{r[1]},' + ",".join(f"{v:.12g}" for v in r[2:]) + "\n" for r in table.itertuples(index=False))
    assert checks.fingerprint(rows.repartition(7)).first()["sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_density_of_groups_by_arrays(spark):
    rng = np.random.default_rng(12)
    rows = [("a", float(v)) for v in rng.normal(3, 1, 500)] + [("b", float(v)) for v in rng.normal(0, 2, 60)] + [("few", 1.0)] * 3 + [("flat", 2.0)] * 9 + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = summaries.kde(df, "v", 50, 0.2, ["g"]).toPandas()
    assert set(got.g) == {"a", "b"} and len(got) == 100
    for g in ("a", "b"):
        v = np.array([x for k, x in rows if k == g and x is not None])
        bw = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min(), v.max(), 50)
        want = np.exp(-0.5 * ((x - v[:, None]) / bw) ** 2).sum(0) / (bw * math.sqrt(2 * math.pi)) * 0.2
        own = got[got.g == g].sort_values("i")
        assert own.x.to_numpy() == pytest.approx(x) and own.density.to_numpy() == pytest.approx(want)
    assert len(summaries.kde(df, "v", 50).collect()) == 50


def test_clouds_without_height_or_density_are_named(spark):
    pts = [("few", 1.0, 1.0, float(k)) for k in range(9)] + [("flat", float(k), 1.0, 2.0) for k in range(20)] + [("low", float(k), float(k * k), k / 100) for k in range(20)] + [("ok", float(k), float(k % 3), float(k)) for k in range(20)] + [("none", None, None, float("nan"))]
    df = spark.createDataFrame(pts, "tree string, x double, y double, z double")
    found = {r["tree"]: r for r in summaries.measured_heights(df, ["tree"]).collect()}
    assert {k: (r["error"], r["status"]) for k, r in found.items() if k in ("low", "ok")} == {"low": (None, "BELOW_MIN_HEIGHT"), "ok": (None, "OK")}
    assert "9" in found["few"]["error"] and "range" in found["flat"]["error"] and "0" in found["none"]["error"]
    assert summaries.heights(df, ["tree"]).count() == 2
    errors = {r["tree"]: r["error"] for r in summaries.measured_densities(df, "tree").collect()}
    assert errors["ok"] is None and "hull" in errors["flat"] and "points" in errors["none"] and "hull" in errors["few"]
    assert summaries.density_report(df, "tree").count() == 2


def test_files_without_height_or_density_are_named(spark, tmp_path):
    write_las(tmp_path / "1_1_1_t_020_1.las", ellipse(600) + [10, 20, 0])
    write_las(tmp_path / "1_2_1_t_020_1.las", (ellipse(60) + [10, 20, 0])[:8])
    write_las(tmp_path / "1_3_1__020_1.las", ellipse(60) + [10, 20, 0])
    write_las(tmp_path / "1_4_1_t_020_1.laz", ellipse(60), compressed=True)
    raw = (tmp_path / "1_1_1_t_020_1.las").read_bytes()
    (tmp_path / "1_5_1_t_020_1.las").write_bytes(raw[: len(raw) // 2])
    good, errors = extract.tree_heights(spark, str(tmp_path))
    told = {r["path"].split("/")[-1][:3]: r["error"] for r in errors.collect()}
    assert [r["ID"] for r in good.collect()] == ["1"] and set(told) == {"1_2", "1_3", "1_4", "1_5"} and told["1_3"] == "bad name" and "LAZ" in told["1_4"] and "ends after" in told["1_5"]
    with pytest.raises(ValueError, match="without a height"):
        extract.heights(spark, str(tmp_path))
    good, errors = extract.densities(spark, str(tmp_path), chunk=100)
    told = {r["path"].split("/")[-1][:3]: r["error"] for r in errors.collect()}
    assert set(told) == {"1_4", "1_5"} and "ends after" in told["1_5"]
    assert good.count() == 3
    with pytest.raises(ValueError, match="without a density"):
        extract.density(spark, str(tmp_path))


def test_names_need_a_type_and_a_plain_field():
    for wrong in ("0_T_1__60_L1.las", "1_1_2.0_t_060_1.las"):
        with pytest.raises(ValueError):
            names.parse(wrong)
    assert names.parse("1_1_02_a_b_060_1.las")[2:4] == ("2", "a_b")


def test_headers_are_read_without_contents(spark, tmp_path, monkeypatch):
    """A flight of 3 GB is sparse on the disk: its header and one range are read, nothing else."""
    write_las(tmp_path / "big.las", ellipse(10) + [10, 20, 0])
    head = bytearray((tmp_path / "big.las").read_bytes()[:227])
    count = 150_000_000
    head[107:111] = count.to_bytes(4, "little")
    with open(tmp_path / "big.las", "r+b") as f:
        f.write(head)
        f.truncate(227 + 20 * count)
    known = las.headers(names.cloud_files(spark, str(tmp_path)))
    row = known.first()
    assert row["points"] == count and row["error"] is None
    las.register(spark)
    reader = las.LasReader({"path": str(tmp_path), "chunk": "10000000"})
    planned = reader.partitions()
    assert len(planned) == 15 and sum(n for p in planned for _, _, n in p.parts) == count
    part = next(reader.read(las.Ranges([(str(tmp_path / "big.las"), count - 5, 5)])))
    assert part.num_rows == 5


def test_filters_reach_the_reader(spark, tmp_path, monkeypatch):
    """Files whose bounds leave nothing aren't read, and only points that pass are decoded in full."""
    for k in range(4):
        points = [(10 + k * 100 + i, 20 + i, i / 10) for i in range(50)]
        write_las(tmp_path / f"{k}.las", points, bounds=True)
    las.register(spark)
    source = spark.read.format("las").load(str(tmp_path))
    got = source.where("x >= 310 AND z < 1.0").toPandas()
    assert len(got) == 10 and got.path.str.endswith("3.las").all()
    assert source.where("x > 1e6").count() == 0 and source.where("x IS NULL").count() == 0 and source.count() == 200
    reader = las.LasReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([las.GreaterThan(("x",), 215.0), las.LessThan(("path",), "a"), las.EqualTo(("x",), float("nan"))]))
    assert len(rest) == 2 and [path[-5] for p in reader.partitions() for path, _, _ in p.parts] == ["2", "3"]
    decoded = []
    plain = las.coordinates
    monkeypatch.setattr(las, "coordinates", lambda h, raw, dims="xyz": decoded.append(len(raw) // h.record * len(dims)) or plain(h, raw, dims))
    read = [batch.num_rows for p in reader.partitions() for batch in reader.read(p)]
    # Each of the two files decodes one coordinate of all points and three of those that pass; the other two none.
    assert read == [44, 50] and sum(decoded) == 2 * 50 + 3 * (44 + 50)


def test_trees_over_many_tasks_have_the_same_features(spark, monkeypatch):
    """Trees cut over 50 tasks: the chain over many tasks gives what windows give, guards and null keys too."""
    clouds = [("big", ellipse(4000)), ("narrow", ellipse(900, 5) * [0.2, 3, 1]), ("sparse", ellipse(119, 2)), ("few", ellipse(60, 4)[:49]), ("flat", ellipse(80) * [1, 1, 0]), (None, ellipse(700, 8))]
    rows = [(k, 1, float(x), float(y), float(z)) for k, pts in clouds for x, y, z in pts] + [("big", 1, None, 1.0, 2.0), ("big", 1, float("nan"), 1.0, 2.0)]
    points = spark.createDataFrame(rows, "tree string, part int, x double, y double, z double").repartition(50)
    want = cloud.features(points, ["tree", "part"]).toPandas().sort_values("tree").reset_index(drop=True)
    got = cloud.spread_features(points, ["tree", "part"])
    assert got.columns == list(want.columns)
    pd.testing.assert_frame_equal(got.toPandas().sort_values("tree").reset_index(drop=True), want, check_dtype=False, rtol=1e-9)
    assert len(want) == 4
    mixed = cloud.all_features(points, ["tree", "part"], large=800).toPandas().sort_values("tree").reset_index(drop=True)
    pd.testing.assert_frame_equal(mixed, want, check_dtype=False, rtol=1e-9)


def test_rows_of_a_key_are_never_parted(spark):
    """Two rows of each key, alike but for their class: a model that saw the one would know the other's features."""
    rows = feature_table(spark, 60).withColumn("key", F.concat(F.lit("t"), F.floor(F.col("key") / 2)))
    out = evaluate.repeated_folds(rows, ["GlobalPF_Threshold"], ["five_class"], repeats=2, count=3)
    assert out.count() == 120 and out.groupBy("repeat", "key").count().where("count <> 2").isEmpty()
    dealt = checks.group_folds(rows, "key", "class", repeats=2, count=3)
    assert dealt.count() == 60 and dealt.groupBy("repeat", "fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 2


def profiles(n, seed=5):
    """Rows of a network's training: some values are null, not finite or below 0, one column has no value at all."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        y = int(rng.integers(0, 4))
        x = [float(v) for v in rng.random(20) + np.where(np.arange(20) // 5 == y, 0.4, 0.0)]
        x[3], x[7] = [(None, math.nan, math.inf, -1.0, x[3])[k % 5] for _ in range(2)]
        x[11] = None
        rows.append((k // 2, int(rng.integers(0, 5)), y, x))
    return rows


def plain_network(rows, seed, epochs, ids, inner_too):
    """Full batches in one place: the weights after each epoch, and the inner rows' loss."""
    x = np.array([[np.nan if v is None else v for v in r[3]] for r in rows])
    y, learn = np.array([r[2] for r in rows]), np.array([inner_too or r[1] != 0 for r in rows])
    x[~np.isfinite(x)] = np.nan
    median = np.array([0.0 if np.isnan(c).all() else np.nanmedian(c) for c in x[learn].T])
    x = cnn.imputed(x, median)
    counts = np.bincount(y[learn], minlength=5)
    w = np.array([learn.sum() / ((counts > 0).sum() * c) if c else 0.0 for c in counts])
    v = cnn.vector(cnn.started(np.random.default_rng(seed))).astype(float)
    m1, m2, after, losses = 0.0, 0.0, [], []
    for t in range(1, epochs + 1):
        p = cnn.network(v.astype(np.float32))
        z, kept = cnn.forward(p, x[learn], cnn.dropped(ids[learn], seed, t))
        g = cnn.vector(cnn.backward(p, kept, cnn.loss_and_error(z, y[learn], w / w[y[learn]].sum())[1]))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v * (1 - cnn.RATE * cnn.DECAY) - cnn.RATE * m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        after.append(v)
        if not inner_too:
            z = cnn.forward(cnn.network(v.astype(np.float32)), x[~learn])[0]
            z = z - np.log(np.exp(z).sum(1, keepdims=True))
            losses.append(-(w[y[~learn]] * z[np.arange(len(z)), y[~learn]]).sum() / w[y[~learn]].sum())
    return after, losses


@pytest.mark.parametrize("parts", [1, 7])
def test_networks_equal_plain_ones_however_rows_are_laid(spark, parts):
    rows = {f: profiles(70 + 30 * f, f) for f in (0, 3)}
    df = spark.createDataFrame([(f, *r) for f, rs in rows.items() for r in rs], "fit int, key long, inner int, y int, x array<double>").withColumn("id", F.xxhash64("key"))
    found = cnn.trained(df.repartition(parts).select("fit", "id", "inner", "x", "y"), 12)
    assert set(found) == {0, 3}
    ids = {r["key"]: r["id"] for r in df.select("key", "id").distinct().collect()}
    for f, own in rows.items():
        at = np.array([ids[r[0]] for r in own])
        losses = plain_network(own, 17 + f, 12, at, False)[1]
        best, chosen = np.inf, 12
        for t, loss in enumerate(losses, 1):
            if loss < best - cnn.LEAST_GAIN:
                best, chosen = loss, t
            elif t - chosen >= cnn.PATIENCE:
                break
        model, epochs = found[f]
        assert epochs == max(cnn.LEAST_EPOCHS, chosen)
        after = plain_network(own, 31 + f, 12, at, True)[0]
        assert np.abs(model.weights - after[epochs - 1]).max() < 0.02 and np.abs(model.weights - after[epochs - 1]).mean() < 1e-4


def test_dropout_follows_the_row():
    ids = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 4000)
    a = cnn.dropped(ids, 31, 2)
    assert a.shape == (4000, 160) and abs((a == 0).mean() - cnn.DROPPED) < 0.005 and set(np.unique(a).tolist()) == {0.0, np.float32(1 / (1 - cnn.DROPPED))}
    assert np.abs((a == 0).mean(0) - cnn.DROPPED).max() < 0.05 and np.array_equal(cnn.dropped(ids[::-1], 31, 2), a[::-1])
    for other in (cnn.dropped(ids, 31, 3), cnn.dropped(ids, 32, 2)):
        assert abs(((a == 0) & (other == 0)).mean() - cnn.DROPPED**2) < 0.01


def test_networks_without_inner_rows_or_rows(spark):
    schema = "fit int, key long, role string, inner int, y int, x array<double>"
    rows = [(0, r[0], "train", 1, r[2], r[3]) for r in profiles(40)] + [(0, 100, "test", 0, 2, [None] * 20)]
    got = cnn.fit_predict(spark.createDataFrame(rows, schema)).collect()
    assert [(r["fit"], r["key"], r["y"], r["epoch"]) for r in got] == [(0, 100, 2, cnn.EPOCHS)] and got[0]["pred"] in range(5)
    assert cnn.fit_predict(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(Exception, match="no training rows"):
        cnn.fit_predict(spark.createDataFrame(rows[-1:], schema)).collect()


def test_las_files_written_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"0{20 + 20 * (k % 2)}/{'ab'[k % 2]}.las", float(v[0]), float(v[1]), float(v[2])) for k, v in enumerate(rng.normal(0, 50, (900, 3)))] + [("c/one.LAS", 5.0, -3.0, 1e5)]
    df = spark.createDataFrame(rows, "file string, x double, y double, z double").repartition(5)
    for root in (str(tmp_path / "plain"), f"file:{tmp_path}/address"):
        told = {r["file"]: r["points"] for r in las.write(df, root, 0.0001, 'UNIT["foot",0.3048]').collect()}
        assert told == {"020/a.las": 450, "040/b.las": 450, "c/one.LAS": 1} and len(las.files(root)) == 3
        assert not [p for p in tmp_path.rglob("*.part")]
        las.register(spark)
        got = spark.read.format("las").option("chunk", "100").load(root).toPandas()
        for file in told:
            own, mine = got[got.path.str.endswith(file)], np.array([r[1:] for r in rows if r[0] == file])
            steps = lambda v: sorted(map(tuple, np.rint(v * 10_000).astype(int).tolist()))
            assert steps(own[["x", "y", "z"]].to_numpy()) == steps(mine)
        h = las.header(las.files(root)[0])
        assert h.count == 450 and las.metres(h.wkt) == (0.3048, False) and h.low[0] == min(r[1] for r in rows if r[0] == "020/a.las")
    # Written again, a file is the same.
    before = (tmp_path / "plain/020/a.las").read_bytes()
    las.write(df.repartition(3), str(tmp_path / "plain"), 0.0001, 'UNIT["foot",0.3048]')
    assert (tmp_path / "plain/020/a.las").read_bytes() == before


def test_what_las_files_cannot_hold(spark, tmp_path):
    schema = "file string, x double, y double, z double"
    assert las.write(spark.createDataFrame([], schema), str(tmp_path)).collect() == [] and las.files(str(tmp_path)) == []
    for row, why in (((None, 1.0, 1.0, 1.0), "without a file"), (("a.las", None, 1.0, 1.0), "finite"), (("a.las", math.inf, 1.0, 1.0), "finite")):
        with pytest.raises(Exception, match=why):
            las.write(spark.createDataFrame([("a.las", 1.0, 1.0, 1.0), row], schema), str(tmp_path))
    with pytest.raises(Exception, match="fit a scale"):
        las.write(spark.createDataFrame([("a.las", 0.0, 1.0, 1.0), ("a.las", 1e9, 1.0, 1.0)], schema), str(tmp_path))
    assert las.files(str(tmp_path)) == []


def test_small_files_share_a_partition():
    parts = [("a", 0, 5), ("a", 5, 5), ("a", 10, 1), ("b", 0, 2), ("c", 0, 2), ("d", 0, 5)]
    got = las.gathered(parts, 5)
    assert [p for g in got for p in g.parts] == parts and [sum(p[2] for p in g.parts) for g in got] == [5, 5, 5, 5] and las.gathered([], 5) == []


def test_buckets_are_the_same_wherever_they_are_read(spark):
    """Approximate quantiles depend on the order of arrival, so no plan that counts buckets makes them anew."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009 / 8).alias("v"))
    shares = [0.0, 0.3, 0.5, 0.99]
    found = selection.percentiles(df, ["g"], {"v": F.col("v")}, shares, 16, whole=100)
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    values = {g: np.array([r["v"] for r in df.where(f"g = {g}").collect()]) for g in range(3)}
    for r in found.collect():
        assert np.allclose(r["v"], np.quantile(values[r["g"]], shares))
    whole = selection.percentiles(df, ["g"], {"v": F.col("v")}, shares, most=1000).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    cut, one = (selection.running(counts, ["g"], "v", {"n": "before"}, 16, whole) for whole in (10, 8192))
    assert "percentile_approx" not in cut._jdf.queryExecution().toString()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, one.collect()))


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from treeline.plans import standins

    mean = lambda values: spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).agg(standins.exact_mean(F.col("v"))).first()[0]
    assert mean([1e8, 0.1, -1e8, None]) == mean([-1e8, 1e8, None, 0.1]) == 0.1 / 3
    assert mean([None, None]) is None
    assert mean([float("inf"), 1.0]) == float("inf")


def test_rounding_is_that_of_the_sql(spark):
    """41/640 lies below its decimal form 0.0640625."""
    import duckdb

    from treeline.plans.queries import rounded

    values = [41 / 640, 1 / 128, 2.5e-6, -0.1234565, 1e15 / 3, 0.0, -1e-9, 1 / 3]
    found = rounded(spark.createDataFrame([(k, v) for k, v in enumerate([*values, None, float("nan")])], "k int, v double")).orderBy("k").collect()
    told = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 6) + 0.0").fetchall()[0][0] for v in values]
    assert [r["v"] for r in found[:-2]] == told and told[0] == 0.064062
    assert found[-2]["v"] is None and math.isnan(found[-1]["v"])


@pytest.mark.parametrize("n, first, count", [(1, 0, 1), (7_500, 0, 7_500), (450_000, 0, 450_000), (5_000_000, 4_500_000, 200_000), (3_000_000_000, 2_999_000_000, 1000)])
def test_hits_of_draws_equal_those_drawn_one_by_one(n, first, count):
    from treeline.plans.queries import _hits

    up, down, starts = n // 5, n // 7, np.arange(2996, 3000) * 40503 + 4 * 977 + 3 * 331 + 42
    draws = np.arange(first, first + count)
    at = [(s + draws * 9973) * 48271 % 2147483647 * 16807 % 2147483647 % n for s in starts.tolist()]
    assert _hits(n, up, down, first, count, starts).tolist() == [(a < up).sum() - ((a >= up) & (a < up + down)).sum() for a in at]


def test_files_found_by_tasks_are_those_that_spark_finds(spark, tmp_path):
    for name in ("020/a.las", "020/b c.LAZ", "020/deep/x=1/c.las", "_x=1/d.las", "_hidden/e.las", ".f.las", "020/notes.txt", "g.las"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"LASF" * len(name))
    (tmp_path / "empty").mkdir()
    same = lambda rows: sorted(map(tuple, rows.collect()))
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/g.las"):
        found = names.listed(spark, root)
        assert same(found) == same(names.cloud_files(spark, root)) and found.columns == ["path", "length"]
    # The driver has no list of the files that a density is asked of.
    assert "binaryFile" not in extract.densities(spark, str(tmp_path))[0]._jdf.queryExecution().toString()
