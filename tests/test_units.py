"""Hand-computed cases, ported behaviours, guards and the LAS source."""

import hashlib
import math
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeline import settings as S
from treeline.operators import agreement, checks, cloud, cnn, evaluate, linear, scores, summaries, threshold
from treeline.plans import extract
from treeline.sources import las, names, tables


def predicted(spark, truth, pred):
    return spark.createDataFrame([("g", t, p) for t, p in zip(truth, pred, strict=True)], "g string, truth int, pred int")


def test_kappa_weights_go_by_rank(spark):
    c = scores.confusion(predicted(spark, [0, 1, 4, 4], [0, 4, 4, 1]), ["g"])
    assert scores.kappa(c, ["g"]).first()["QWK"] == pytest.approx(0.636364, abs=1e-6)


def test_balanced_accuracy_and_macro_f1_label_sets(spark):
    r = scores.balanced(scores.confusion(predicted(spark, [0, 0, 1], [0, 2, 1]), ["g"]), ["g"]).first()
    assert r["BalancedAccuracy"] == pytest.approx(0.75) and r["MacroF1"] == pytest.approx(0.555556, abs=1e-6)


def test_scores_of_nothing(spark):
    assert scores.scores(predicted(spark, [], []), ["g"]).count() == 0


def test_isotonic_by_weighted_runs(spark):
    rows = [(v, y) for y, (m, n) in enumerate([(1, 10), (3, 5), (2, 15), (5, 1)]) for v in [float(m)] * n]
    rule = threshold.fit(spark.createDataFrame([("f", v, y) for v, y in rows], "f string, x double, y int"), ["f"]).first()
    assert rule["cuts"] == pytest.approx([1.625, 2.25, 3.625]) and rule["orient"] == 1.0


def test_depth_bins(spark):
    d = spark.createDataFrame([(0.15,), (0.05,), (1.0,), (0.0,)], "d double")
    assert [r[0] + 1 for r in d.select(cloud.depth_bin(F.col("d"))).collect()] == [3, 2, 20, 1]


def test_merged_labels(spark):
    d = spark.createDataFrame([(k,) for k in range(5)], "c int")
    assert [r[0] for r in d.select(scores.merged(F.col("c"))).collect()] == [0, 0, 1, 2, 3]


def test_hull_of_square():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]], float)
    assert summaries.polygon_area(summaries.hull(square)) == 1
    assert math.isnan(summaries.polygon_area(summaries.hull(np.array([[0.0, 0], [1, 1], [2, 2]])[:2])))


def test_constant_column_has_no_rank_correlation(spark):
    r = agreement.rank_correlation(spark.createDataFrame([("a", 1, k) for k in range(5)], "g string, x int, y int"), "x", "y", ["g"]).first()
    assert r["N"] == 5 and r["rho"] is None


def test_p_value_of_rank_correlation():
    assert agreement.t_two_sided(0.0, 10) == pytest.approx(1.0)
    # Student's t with 1 degree of freedom has a closed form.
    rho = 0.5
    t = rho * math.sqrt(1 / (1 - rho * rho))
    assert agreement.t_two_sided(rho, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-9)
    assert math.isnan(agreement.t_two_sided(0.3, 2))


def test_ratings_and_rank_correlations_by_hand(spark):
    # Row means 1, 2, 5 and column means 7/3, 3: MSR 26/3, MSC 2/3, MSE 2/3.
    r = spark.createDataFrame([(1, 1), (2, 2), (4, 6), (None, 3)], "a int, b int")
    i = agreement.icc(r, ["a", "b"]).first()
    assert i["n"] == 3 and i["icc_a1"] == pytest.approx(8 / (26 / 3 + 2 / 3)) and i["icc_ak"] == pytest.approx(8 / (26 / 3))
    # Ranks 1, 2.5, 2.5, 4 against 2, 1, 3, 4: products of deviations add up to 3, squares to 4.5 and 5.
    q = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 1.0), ("g", 2, 7.0), ("g", 9, 8.0), ("g", None, 1.0)], "f string, x int, y double")
    c = agreement.rank_correlation(q, "x", "y", ["f"]).first()
    assert c["N"] == 4 and c["rho"] == pytest.approx(3 / math.sqrt(4.5 * 5))
    # Two datasets with Fisher's z of 0 and 1 and weights 1 and 4: pooled 0.8, Q 0.8, no variance between them.
    pooled = agreement.random_effects(spark.createDataFrame([(4, 0.0), (7, math.tanh(1.0))], "N long, rho double")).first()
    assert pooled["k"] == 2 and pooled["Q"] == pytest.approx(0.8) and pooled["tau2"] == 0 and pooled["I2"] == 0
    assert pooled["rho"] == pytest.approx(math.tanh(0.8)) and pooled["ci_high"] == pytest.approx(math.tanh(0.8 + 1.959963984540054 / math.sqrt(5)))


def test_ranks_over_many_buckets(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 300, 4000), rng.normal(size=4000).round(2)
    got = threshold.rank_correlations(spark.createDataFrame([(int(k % 2), int(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "g int, x int, y double"), "x", "y", ["g"]).orderBy("g").collect()
    for g, r in enumerate(got):
        a, b = (pd.Series(v[g::2]).rank() for v in (x, y))
        assert r["N"] == 2000 and r["rho"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)


def test_p_values_as_a_column(spark):
    rows = agreement.with_p_values(spark.createDataFrame([("a", 10, 0.0), ("b", 2, 0.5), ("c", 9, None)], "g string, N long, rho double")).orderBy("g").collect()
    assert rows[0]["p_value"] == pytest.approx(1.0) and rows[1]["p_value"] is None and rows[2]["p_value"] is None


def trees(spark, *clouds):
    return spark.createDataFrame([(k, float(x), float(y), float(z)) for k, pts in clouds for x, y, z in pts], "tree string, x double, y double, z double")


def ellipse(n, seed=1):
    rng = np.random.default_rng(seed)
    r, t = np.sqrt(rng.random(n)), rng.random(n) * 2 * np.pi
    return np.column_stack([4 * r * np.cos(t), 2 * r * np.sin(t), rng.random(n) * 5])


def test_cloud_guards(spark):
    bad = np.vstack([ellipse(60)[:49], [[np.nan, 0, 0], [np.inf, 0, 0]]])
    out = {r["tree"]: r for r in cloud.features(trees(spark, ("big", ellipse(2000)), ("few", bad), ("sparse", ellipse(119, 2)), ("flat", ellipse(80) * [1, 1, 0])), ["tree"]).collect()}
    assert set(out) == {"big", "sparse"}
    big, sparse = out["big"], out["sparse"]
    assert 7 < big["CrownLength"] < 8.2 and 3.4 < big["CrownWidth"] < 4.1
    assert sparse["PGF50"] is None and sparse["GridValidCells"] == 0 and sparse["CPC90"] is None
    assert sum(big[f"p{k}"] for k in range(1, 21)) == pytest.approx(1)


def test_features_do_not_depend_on_partitions(spark):
    t = trees(spark, ("a", ellipse(500)), ("b", ellipse(700, 3)))
    one, four = (sorted(map(tuple, cloud.features(t.repartition(n), ["tree"]).select("tree", F.round("VRI", 9), F.round("CPC90", 9), "PointCount").collect())) for n in (1, 7))
    assert one == four


def test_features_take_one_exchange(spark):
    plan = cloud.features(trees(spark, ("a", ellipse(60))), ["tree"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_names():
    assert names.parse("3_0012_2_valencia_late_060_1.las") == (3, "0012", "2", "valencia_late", 60, "1")
    assert names.parse("0_1_field02_t_020_L1.LAZ") == (0, "1", "2", "t", 20, "L1")
    for wrong in ("1_2_3.las", "7_1_2_t_060_1.las", "1_1_9_t_060_1.las", "1_1_1_t_sixty_1.las"):
        with pytest.raises(ValueError):
            names.parse(wrong)


def test_names_as_columns(spark):
    d = spark.createDataFrame([("/a/3_0012_2_valencia_late_060_1.las",), ("/a/bad.las",)], "path string")
    rows = names.with_names(d).orderBy("path").collect()
    assert rows[0]["TreeKey"] == "2|0012|valencia_late" and rows[0]["error"] is None and rows[1]["error"]


def test_output_guard(tmp_path):
    assert names.output_dir(str(tmp_path), "results").name == "results"
    assert names.output_dir(str(tmp_path), "a/../b/c") == tmp_path.resolve() / "b" / "c"
    for wrong in ("../elsewhere", ".", "treeline/x", ".git", "/etc"):
        with pytest.raises(ValueError, match="subdirectory"):
            names.output_dir(str(tmp_path), wrong)


FEATURE = "Source string, File string, Class int, ID string, FieldID string, Type string, Altitude int, TreeKey string, x double"


def feature_rows(spark, *rows):
    return spark.createDataFrame([(s, "f", c, i, "1", "t", a, f"1|{i}|t", 0.5) for s, c, i, a in rows], FEATURE)


def test_validation_messages(spark):
    good = feature_rows(spark, ("L1", 1, "1", 60), ("L1", 1, "1", 80))
    assert checks.validate(good, ["x"]).count() == 2
    with pytest.raises(ValueError, match="Duplicate"):
        checks.validate(good.unionByName(good), ["x"])
    with pytest.raises(ValueError, match="conflicting labels"):
        checks.validate(feature_rows(spark, ("L1", 1, "1", 60), ("L1", 2, "1", 80)), ["x"])
    with pytest.raises(ValueError, match="class_domain"):
        checks.validate(feature_rows(spark, ("L1", 9, "1", 60)), ["x"])


def test_canonical_order_survives_shuffling(spark):
    rows = feature_rows(spark, *[("L1", 1, str(k), 60) for k in range(6)])
    manifest = rows.where("ID < '4'").withColumn("rank", -F.col("ID").cast("int"))
    assert [r["ID"] for r in checks.canonical(rows.repartition(4), manifest).collect()] == ["3", "2", "1", "0", "4", "5"]


def plain_regression(x, y, steps=200):
    """The same objective by damped Newton steps on dense matrices."""
    x = np.where(np.isfinite(x), x, np.nanmedian(x, axis=0))
    a = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    classes, place = np.unique(y, return_inverse=True)
    k, d, n = len(classes), a.shape[1], np.bincount(place)
    w, target = (len(y) / (k * n))[place], np.eye(k)[place]
    beta, penalty = np.zeros((d, k)), np.ones((d, k))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = np.exp(a @ beta - (a @ beta).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = a.T @ ((p - target) * w[:, None]) + penalty * beta
        hess = np.zeros((d * k, d * k))
        for r in range(len(a)):
            hess += w[r] * np.kron(np.outer(a[r], a[r]), np.diag(p[r]) - np.outer(p[r], p[r]))
        beta = beta - np.linalg.lstsq(hess + np.diag(penalty.ravel()), grad.ravel(), rcond=1e-12)[0].reshape(d, k)
        if np.abs(grad).max() < 1e-9:
            break
    return beta


def feature_table(spark, n=96, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = int(rng.integers(0, 5))
        v = [float(c + rng.normal()) if rng.random() > 0.05 else None for _ in range(5)]
        rows.append((k, k % 4 + 1, c, *v, *[float(abs(rng.normal()) + (j == c)) for j in range(20)]))
    names_ = ["VRI", "GlobalPF50", "CorePF50", "PGF50", "CPC90", *[f"p{k + 1}" for k in range(20)]]
    return spark.createDataFrame(rows, "key long, field int, class int, " + ", ".join(f"{c} double" for c in names_))


def test_regressions_together_equal_plain_ones(spark):
    rows = feature_table(spark)
    table = rows.toPandas()
    train = rows.where("field <> 1").select(F.lit(0).alias("fit"), F.array("CorePF50", "PGF50").alias("x"), F.col("class").alias("y"))
    train = train.unionByName(rows.where("field <> 2").select(F.lit(1).alias("fit"), F.array("VRI").alias("x"), F.greatest(F.col("class") - 1, F.lit(0)).alias("y")))
    models_ = linear.trained(train.repartition(5), 2)
    for f, (held, columns, y) in enumerate(((1, ["CorePF50", "PGF50"], table["class"]), (2, ["VRI"], np.maximum(table["class"] - 1, 0)))):
        own = table.field != held
        want = plain_regression(table.loc[own, columns].to_numpy(float), y[own].to_numpy())
        assert models_[f].beta - models_[f].beta.mean(1, keepdims=True) == pytest.approx(want - want.mean(1, keepdims=True), abs=1e-5)
    with pytest.raises(ValueError, match="no value"):
        linear.trained(train.withColumn("x", F.array(F.lit(None).cast("double"))), 1)


def test_grid_of_methods(spark):
    rows = feature_table(spark)
    methods = ["GlobalPF_Threshold", "MidpointCompact_LR"]
    lofo = evaluate.leave_one_field_out(rows, methods)
    assert lofo.count() == 96 * 4 and lofo.groupBy("scheme", "method", "key").count().where("count <> 1").isEmpty()
    cv = evaluate.repeated_folds(rows, methods, ["five_class"], repeats=2)
    assert cv.count() == 96 * 2 * 2
    both = evaluate.with_gap(evaluate.summary(lofo.where("scheme = 'five_class'"), ["scheme", "method"]), evaluate.repeat_means(cv, ["scheme", "method"]), ["scheme", "method"], methods).collect()
    assert [r["method"] for r in both] == methods and both[1]["Accuracy"] > 0.4 and both[0]["CV_minus_LOFO_Accuracy"] == pytest.approx(both[0]["CV_Accuracy"] - both[0]["Accuracy"])
    with pytest.raises(ValueError, match="without a result"):
        evaluate.with_gap(evaluate.summary(lofo, ["scheme", "method"]), evaluate.repeat_means(cv, ["scheme", "method"]), ["scheme", "method"], ["CorePF_LR"])
    with pytest.raises(ValueError, match="Unknown"):
        evaluate.leave_one_field_out(rows, ["None"])
    with pytest.raises(ValueError, match="scheme"):
        evaluate.leave_one_field_out(rows, methods, ["other"])


def test_transfer_between_sensors(spark):
    one = feature_table(spark).withColumn("source", F.lit("L1"))
    two = one.withColumns({c: F.col(c) + 3 for c in ("CorePF50", "PGF50")}).withColumn("source", F.lit("H300"))
    pairs = evaluate.paired(one.unionByName(two), ["CorePF50", "PGF50"])
    out = evaluate.transfer(pairs, ["MidpointCompact_LR"]).toPandas()
    by = {s: g.sort_values("key").pred.tolist() for s, g in out.groupby("strategy")}
    assert len(by) == 5 and by["L1_TO_H300_BIAS"] == by["L1_WITHIN"] == by["H300_WITHIN"] and by["L1_TO_H300_RAW"] != by["L1_WITHIN"]


def test_bootstrap_against_draws_of_rows(spark):
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 4, 300)
    a, b = (np.where(rng.random(300) < q, truth, rng.integers(0, 4, 300)) for q in (0.7, 0.4))
    rows = [("five_class", m, k, k % 3, int(truth[k]), int(p[k])) for m, p in (("A", a), ("B", b)) for k in range(300)]
    p = spark.createDataFrame(rows, "scheme string, method string, key int, held_field int, truth int, pred int")
    got = {r["metric"]: r for r in evaluate.paired_bootstrap(p, [("A", "B")]).collect()}
    assert set(got) == {"Accuracy", "BalancedAccuracy", "MacroF1", "QWK", "Within1"}
    strata = [np.flatnonzero((np.arange(300) % 3 == f) & (truth == c)) for f in range(3) for c in range(4)]
    draws = []
    for _ in range(1500):
        i = np.concatenate([rng.choice(s, len(s)) for s in strata])
        draws.append((a[i] == truth[i]).mean() - (b[i] == truth[i]).mean())
    r = got["Accuracy"]
    assert r["A_minus_B"] == pytest.approx((a == truth).mean() - (b == truth).mean())
    assert r["CI95_low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.02) and r["CI95_high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.02)
    point = scores.scores(p, ["method"]).toPandas().set_index("method")
    for m in ("BalancedAccuracy", "MacroF1", "QWK", "Within1"):
        assert got[m]["A_minus_B"] == pytest.approx(point.loc["A", m] - point.loc["B", m])


def test_network_gradients_are_right():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in cnn.started(rng).items()}
    x, y, w = rng.random((6, 20)), rng.integers(0, 5, 6), np.ones(5)
    z, kept = cnn.forward(p, x)
    grads = cnn.backward(p, kept, cnn.loss_and_error(z, y, w)[1])
    for k in p:
        at = tuple(int(rng.integers(0, n)) for n in p[k].shape)
        moved = {s: {**p, k: p[k].copy()} for s in (-1, 1)}
        for s in moved:
            moved[s][k][at] += s * 1e-5
        slope = (cnn.loss_and_error(cnn.forward(moved[1], x)[0], y, w)[0] - cnn.loss_and_error(cnn.forward(moved[-1], x)[0], y, w)[0]) / 2e-5
        assert grads[k][at] == pytest.approx(slope, abs=1e-4)


@pytest.mark.parametrize("kind", ["LR", "CNN"])
def test_profile_controls(spark, kind):
    rows = feature_table(spark, 160).withColumns({f"p{k + 1}": F.col(f"p{k + 1}") + F.when(F.col("class") == k // 4, 2.0).otherwise(0.0) for k in range(20)})
    lofo, cv = evaluate.profile_control(rows, kind, repeats=1, count=4)
    a, b = lofo.toPandas(), cv.toPandas()
    assert len(a) == len(b) == 160 and (a.truth == a.pred).mean() > 0.9 and (b.truth == b.pred).mean() > 0.9
    assert kind == "LR" or a.epoch.between(8, 70).all()


def test_folds_take_keys_of_any_size(spark):
    rows = spark.createDataFrame([(k * (1 << 55) + k, k % 3) for k in range(60)], "key long, label int")
    f = checks.folds(rows, "key", "label", repeats=2).toPandas()
    assert len(f) == 120 and f.groupby(["repeat", "label", "fold"]).size().eq(4).all()


def test_cohort_checks(spark):
    rows = feature_rows(spark, *[("L1", c, str(c), 60) for c in range(5)])
    assert checks.require_fields(rows, ("1",), "test").count() == 5
    with pytest.raises(ValueError, match="requires fields"):
        checks.require_fields(rows, S.FIELDS, "test")
    with pytest.raises(ValueError, match="all classes"):
        checks.require_fields(rows.where("Class < 4"), ("1",), "test")
    assert checks.same_cohort(rows, rows) and not checks.same_cohort(rows, rows.where("Class < 4"))
    checks.complete_pairs(rows, rows)
    with pytest.raises(ValueError, match="one cohort only"):
        checks.complete_pairs(rows, rows.where("Class < 4"))
    with pytest.raises(ValueError, match="not numbers"):
        checks.validate(rows.withColumn("x", F.lit("one")), ["x"])


def test_archived_controls_are_gated(spark):
    cohort = feature_table(spark, 8).select(F.col("key").cast("string").alias("TreeKey"), F.col("class").alias("Class"), *[f"p{k + 1}" for k in range(20)])
    p = cohort.orderBy("TreeKey").toPandas()
    text = "".join([",".join(p.columns) + "\n", *[",".join([r.TreeKey, str(r.Class), *[f"{getattr(r, f'p{k + 1}'):.12g}" for k in range(20)]]) + "\n" for r in p.itertuples()]])
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert checks.fingerprint(cohort).first()[0] == digest
    main, controls = spark.createDataFrame([("a", 0.5)], "Method string, Accuracy double"), spark.createDataFrame([("c", "Archived run")], "Method string, ResultSource string")
    assert checks.gated_controls(main, controls, cohort, digest).count() == 2
    with pytest.raises(ValueError, match="do not match"):
        checks.gated_controls(main, controls, cohort, "other")
    with pytest.raises(ValueError, match="ResultSource"):
        checks.gated_controls(main, main, cohort, digest)


def test_context_files(spark, tmp_path):
    wide = [["tree", "Rating 1", "rating2", "Grade", "n"], *[[f"t{k}", k % 5, (k + 1) % 5, "x" if k == 3 else k % 4, k] for k in range(12)]]
    tables.write_csv(spark.createDataFrame([tuple(map(str, r)) for r in wide[1:]], ", ".join(f"`{c}` string" for c in wide[0])), str(tmp_path / "r.csv"))
    cell = lambda v, at: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    rows = "".join(f"<row>{''.join(cell(v, f'{chr(65 + j)}{i + 1}') for j, v in enumerate(r))}</row>" for i, r in enumerate(wide))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Tree_Level" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    a, b = tables.read_table(spark, str(tmp_path / "r.csv")), tables.read_table(spark, str(tmp_path / "r.xlsx"), "Tree_Level")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert tables.rating_columns(a) == ["Rating 1", "rating2", "Grade"]
    assert tables.rating_columns(a.select("n", F.col("n").alias("m"), F.col("n").alias("k"))) == ["n", "m", "k"]
    with pytest.raises(ValueError, match="aren't there"):
        tables.rating_columns(a, ["no"])
    with pytest.raises(ValueError, match="name them"):
        tables.rating_columns(a.select("tree", "n"))
    assert tables.shared_domain(spark.createDataFrame([("xbtms1",), ("other",)], "d string"), "d").count() == 1
    tables.sensor_status(str(tmp_path / "s.json"), False, "no second sensor")
    assert not tables.sensor_done(str(tmp_path / "s.json")) and tables.provenance(spark, str(tmp_path / "s.json"))["status"] == "skipped"
    tables.run_record(str(tmp_path / "run.json"), "context", {}, tables.digests(spark, str(tmp_path), "*.csv"))
    assert tables.provenance(spark, str(tmp_path / "run.json"))["packages"]["pyspark"]


def data_folder(tmp_path, **changes):
    for a in S.ALTITUDES:
        folder = tmp_path / "seg" / (f"{a:03d}" if a != 40 else "40")
        folder.mkdir(parents=True, exist_ok=True)
        for c in range(5):
            write_las(folder / f"{c}_00{c}_field0{c % 4 + 1}_late_type_{a:03d}_1.las", np.abs(ellipse(700, c)) + [10, 20, 0])
    (tmp_path / "seg" / "A120").mkdir()
    write_las(tmp_path / "seg" / "A120" / "1_001_2_late_type_120_H300.LAS", np.abs(ellipse(600, 9)) + [10, 20, 0])
    return str(tmp_path / "seg")


def test_from_files_to_feature_rows(spark, tmp_path):
    root = data_folder(tmp_path)
    tasks, counts = names.discover(spark, root)
    assert tasks.count() == 31 and {(r["Source"], r["Altitude"]): r["NFiles"] for r in counts.collect()}["H300", 120] == 1
    rows = extract.extract(spark, root).toPandas()
    assert len(rows) == 31 and rows.TreeKey.nunique() == 5 and set(rows[rows.Source == "H300"].TreeKey) == {"2|001|late_type"}
    tables.write_csv(spark.createDataFrame(rows).drop("CrownLength", "CrownWidth").select(*[c.split()[0] for c in tables.FEATURE_SCHEMA.split(", ")]), str(tmp_path / "f.csv"))
    assert tables.read_features(spark, str(tmp_path / "f.csv")).where("FieldID = '2' AND ID = '001'").count() == 7
    assert extract.heights(spark, f"{root}/020").where("FieldName = 'DKSB' AND status = 'OK'").count() == 2
    density = extract.density(spark, f"{root}/020", "international_feet").toPandas()
    assert len(density) == 5 and (density.factor == 0.3048).all() and (density.hull_density > density.box_density).all()
    write_las(tmp_path / "seg" / "020" / "1_9_1_t_060_1.las", ellipse(60) + [10, 20, 0])
    write_las(tmp_path / "seg" / "020" / "1_8_1_t_020_1.las", (ellipse(60) + [10, 20, 0])[:40])
    write_las(tmp_path / "seg" / "020" / "1_7_1_t_020_2.laz", ellipse(60) + [10, 20, 0], compressed=True)
    write_las(tmp_path / "seg" / "020" / "1_6_1_t_020_1.laz", ellipse(60) + [10, 20, 0], compressed=True)
    errors = {r["path"].split("/")[-1]: r["error"] for r in extract.extracted(spark, root)[1].collect()}
    assert {k[:3] for k in errors} == {"1_9", "1_8", "1_7", "1_6"} and "altitude" in errors["1_9_1_t_060_1.las"] and "points" in errors["1_8_1_t_020_1.las"] and "sensor" in errors["1_7_1_t_020_2.laz"] and "LAZ" in errors["1_6_1_t_020_1.laz"]
    with pytest.raises(ValueError, match="without features"):
        extract.extract(spark, root)
    (tmp_path / "seg" / "20").mkdir()
    write_las(tmp_path / "seg" / "20" / "1_5_1_t_020_1.las", ellipse(60) + [10, 20, 0])
    with pytest.raises(ValueError, match="exactly one folder"):
        names.discover(spark, root)


def test_thresholds_impute_what_is_not_finite(spark):
    rows = [(float(y) + k / 100, y) for y in range(3) for k in range(9)]
    odd = [*rows, (float("nan"), 1), (float("inf"), 1), (None, 1)]
    a, b = (threshold.fit(spark.createDataFrame([("f", *r) for r in part], "f string, x double, y int"), ["f"]).first() for part in (odd, [*rows, (None, 1), (None, 1), (None, 1)]))
    assert a["median"] == b["median"] and a["cuts"] == b["cuts"]
    out = threshold.predict(spark.createDataFrame([("f", float("inf")), ("f", 2.0)], "f string, x double"), spark.createDataFrame([a]), ["f"]).collect()
    assert [r["pred"] for r in out] == [1, 2]


def test_panels_share_edges_and_limits(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(k % 4) + 1, float(h)) for k, h in enumerate(rng.uniform(0.6, 3, 200))], "field int, height double")
    lines, bins, curve = (d.toPandas() for d in summaries.panels(rows, "height", "field"))
    assert set(lines.panel) == {"all", "1", "2", "3", "4"} and lines.x_low.nunique() == 1 and bins.groupby("panel").n.sum()["all"] == 200
    assert curve.groupby("panel").size().eq(350).all() and (lines.y_high >= 1.1 * bins.groupby("panel").n.max().loc[lines.panel].to_numpy() - 1e-9).all()


def write_las(path, points, scale=0.01, compressed=False, bounds=False):
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    head[104] = 0x80 if compressed else 0
    struct.pack_into("<HI", head, 105, 20, len(points))
    struct.pack_into("<6d", head, 131, scale, scale, scale, 10.0, 20.0, 0.0)
    if bounds:
        struct.pack_into("<6d", head, 179, *[f(p[k] for p in points) for k in range(3) for f in (max, min)])
    body = b"".join(struct.pack("<iii8x", *(round(v) for v in ((x - 10) / scale, (y - 20) / scale, z / scale))) for x, y, z in points)
    path.write_bytes(bytes(head) + body)


def test_las_source(spark, tmp_path):
    pts = [(10 + k * 0.1, 20 + k * 0.2, k * 0.05) for k in range(100)]
    write_las(tmp_path / "a.las", pts)
    write_las(tmp_path / "b.LAS", pts[:7])
    las.register(spark)
    d = spark.read.format("las").option("chunk", "30").load(str(tmp_path))
    assert d.count() == 107
    r = d.agg(F.sum("x"), F.sum("z")).first()
    assert r[0] == pytest.approx(sum(p[0] for p in pts) + sum(p[0] for p in pts[:7])) and r[1] == pytest.approx(sum(p[2] for p in pts) + sum(p[2] for p in pts[:7]))
    only_z = spark.read.format("las").option("dims", "z").load(str(tmp_path / "a.las"))
    assert only_z.where("x IS NOT NULL").count() == 0 and only_z.where("z IS NOT NULL").count() == 100
    write_las(tmp_path / "c.laz", pts, compressed=True)
    with pytest.raises(ValueError, match="LAZ"):
        las.header(str(tmp_path / "c.laz"))
    assert las.metres('PROJCS["x",UNIT["degree",0.0174],UNIT["metre",1.0]]') == (1.0, False) and las.metres("") == (1.0, True)


def test_bin_edges():
    assert len(summaries.bin_edges(0.6, 0.61)) == 7
    e = summaries.bin_edges(0.52, 2.0)
    assert e[0] == pytest.approx(0.5) and e[-1] >= 2.0
