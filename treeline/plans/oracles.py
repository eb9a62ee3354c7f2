"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from treeline.plans.standins import SQL

R = "round({}, 6) + 0.0 AS {}".format
_FRAME = """
zq AS (SELECT tree, quantile_cont(z, 0.001) AS zlo, quantile_cont(z, 0.999) AS zhi, count(*) AS n FROM cloud GROUP BY tree),
t AS (SELECT c.tree, x, y, z, zlo, zhi, (z - zlo) / (zhi - zlo) AS h, 1 - (z - zlo) / (zhi - zlo) AS d FROM cloud c JOIN zq USING (tree) WHERE n >= 50 AND zhi > zlo AND z BETWEEN zlo AND zhi),
md AS (SELECT tree, median(x) AS mx, median(y) AS my FROM t GROUP BY tree),
c0 AS (SELECT t.*, x - mx AS cx, y - my AS cy, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r0 FROM t JOIN md USING (tree)),
cut AS (SELECT tree, quantile_cont(r0, 0.99) AS c99 FROM c0 GROUP BY tree),
ang AS (SELECT tree, 0.5 * atan2(2 * covar_samp(cx, cy), var_samp(cx) - var_samp(cy)) AS a FROM c0 JOIN cut USING (tree) WHERE r0 <= c99 GROUP BY tree),
uv0 AS (SELECT c0.*, cx * cos(a) + cy * sin(a) AS u0, cy * cos(a) - cx * sin(a) AS v0 FROM c0 JOIN ang USING (tree)),
q AS (SELECT tree, quantile_cont(u0, 0.01) AS ul, quantile_cont(u0, 0.99) AS uh, quantile_cont(v0, 0.01) AS vl, quantile_cont(v0, 0.99) AS vh FROM uv0 GROUP BY tree),
ax AS (SELECT *, greatest((uh - ul) / 2, 1e-6) AS hu, greatest((vh - vl) / 2, 1e-6) AS hv FROM q),
f AS (SELECT uv0.tree, z, zlo, zhi, h, d, CASE WHEN hv > hu THEN v0 - (vl + vh) / 2 ELSE u0 - (ul + uh) / 2 END AS u, CASE WHEN hv > hu THEN u0 - (ul + uh) / 2 ELSE v0 - (vl + vh) / 2 END AS v, greatest(hu, hv) AS a, least(hu, hv) AS b FROM uv0 JOIN ax USING (tree)),
fr AS (SELECT *, sqrt((u / a) ** 2 + (v / b) ** 2) AS rho, CASE WHEN atan2(v / b, u / a) < 0 THEN atan2(v / b, u / a) + 2 * pi() ELSE atan2(v / b, u / a) END AS theta, sqrt(u * u + v * v) <= 0.25 * (a + b) AS core FROM f),
base AS (SELECT tree, count(*) AS n, any_value(zhi - zlo) AS th, count(*) FILTER (core) AS nc, any_value(2 * a) AS cl, any_value(2 * b) AS cw, (avg((h <= 0.30)::INT) + 1e-6) / (avg((h >= 0.70)::INT) + 1e-6) AS vri, avg((d >= 0.5)::INT) AS gpf, avg((d >= 0.5)::INT) FILTER (core) AS cpf FROM fr GROUP BY tree),
win AS (SELECT tree, quantile_cont(u, 0.01) AS ul, quantile_cont(u, 0.99) AS uh, quantile_cont(v, 0.01) AS vl, quantile_cont(v, 0.99) AS vh, count(*) AS n FROM fr GROUP BY tree),
gp AS (SELECT tree, d, win.n AS n, least(greatest(floor((u - ul) / (uh - ul + 1e-8) * 5), 0), 4) AS iu, least(greatest(floor((v - vl) / (vh - vl + 1e-8) * 5), 0), 4) AS iv, count(*) OVER (PARTITION BY tree) AS ng FROM fr JOIN win USING (tree) WHERE uh > ul AND vh > vl AND u BETWEEN ul AND uh AND v BETWEEN vl AND vh),
gc AS (SELECT tree, iu, iv, avg((d >= 0.5)::INT) AS s FROM gp WHERE n >= 120 AND ng >= 120 GROUP BY tree, iu, iv HAVING count(*) >= 20),
gr AS (SELECT tree, count(*) AS k, avg(s) AS ta, avg((s >= 0.2)::INT) AS pgf FROM gc GROUP BY tree),
pp AS (SELECT tree, d, (rho >= sqrt(0.2))::INT + (rho >= sqrt(0.4))::INT + (rho >= sqrt(0.6))::INT + (rho >= sqrt(0.8))::INT AS ring, least(floor(theta / (2 * pi()) * 8), 7) AS sector, count(*) OVER (PARTITION BY tree) AS np FROM fr WHERE rho <= 1),
pc AS (SELECT tree, quantile_cont(d, 0.9) AS p90 FROM pp WHERE np >= 120 GROUP BY tree, ring, sector HAVING count(*) >= 15),
po AS (SELECT tree, count(*) AS k, median(p90) AS cpc FROM pc GROUP BY tree),
bins AS (SELECT tree, len(list_filter(range(0, 20), lambda i: i * 0.05::DOUBLE <= d)) AS bin, count(*) OVER (PARTITION BY tree) AS n FROM t)
"""
_P20 = ", ".join(f"round(sum((bin = {k})::INT) / any_value(n), 6) + 0.0 AS p{k}" for k in range(1, 21))
_CLOUD = f"WITH {SQL}, {_FRAME}"
_FEATURE_COLUMNS = {
    "PointCount": "base.n", "TreeHeight": R("th", "TreeHeight"), "CorePointCount": "nc", "CrownLength": R("cl", "CrownLength"), "CrownWidth": R("cw", "CrownWidth"), "VRI": R("vri", "VRI"), "GlobalPF50": R("gpf", "GlobalPF50"),
    "CorePF50": R("CASE WHEN nc >= 30 THEN cpf END", "CorePF50"), "TA50": R("CASE WHEN gr.k >= 6 THEN ta END", "TA50"), "PGF50": R("CASE WHEN gr.k >= 6 THEN pgf END", "PGF50"), "GridValidCells": "coalesce(gr.k, 0)", "CPC90": R("CASE WHEN po.k >= 8 THEN cpc END", "CPC90"),
}


def _picked(*names: str) -> str:
    columns = ", ".join(c if " AS " in (c := _FEATURE_COLUMNS[n]) else f"{c} AS {n}" for n in names)
    return f"{_CLOUD} SELECT base.tree, {columns} FROM base LEFT JOIN gr USING (tree) LEFT JOIN po USING (tree)"


_PROFILE = f"SELECT tree, {_P20} FROM bins GROUP BY tree"
_HEIGHTS = f"WITH {SQL}, hz AS (SELECT tree, z / 1000 - CASE WHEN tree % 7 = 0 THEN z / 1100 ELSE 0 END AS z FROM cloud), hh AS (SELECT tree, count(*) AS n_points, quantile_cont(z, 0.99) - quantile_cont(z, 0.01) AS height FROM hz GROUP BY tree HAVING count(*) >= 10), heights AS (SELECT *, CASE WHEN height >= 0.5 THEN 'OK' ELSE 'BELOW_MIN_HEIGHT' END AS status, (tree % 4 + 1)::INT AS field FROM hh)"
_BOXES = f"WITH {SQL}, boxes AS (SELECT tree, count(*) AS n_points, max(x) - min(x) AS width, max(y) - min(y) AS height, (max(x) - min(x)) * (max(y) - min(y)) AS box_area FROM cloud GROUP BY tree HAVING count(*) >= 3)"
_SCORES = """
counts AS (SELECT {by}, truth, pred, count(*) AS n FROM p GROUP BY ALL),
labels AS (SELECT DISTINCT {by}, c FROM (SELECT {by}, truth AS c FROM counts UNION ALL SELECT {by}, pred FROM counts)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c) AS k FROM labels),
rowsums AS (SELECT {by}, truth AS c, sum(n) AS n FROM counts GROUP BY ALL),
colsums AS (SELECT {by}, pred AS c, sum(n) AS n FROM counts GROUP BY ALL),
hits AS (SELECT {by}, truth AS c, sum(n) AS n FROM counts WHERE truth = pred GROUP BY ALL),
per AS (SELECT labels.*, coalesce(r.n, 0) AS r, coalesce(s.n, 0) AS s, coalesce(h.n, 0) AS h FROM labels LEFT JOIN rowsums r USING ({by}, c) LEFT JOIN colsums s USING ({by}, c) LEFT JOIN hits h USING ({by}, c)),
bal AS (SELECT {by}, avg(CASE WHEN r > 0 THEN h / r END) AS ba, avg(2 * h / (r + s)) AS f1 FROM per GROUP BY {by}),
bas AS (SELECT {by}, sum(n) AS total, sum(CASE WHEN truth = pred THEN n ELSE 0 END) / sum(n) AS acc, sum(abs(truth - pred) * n) / sum(n) AS mae, sum(CASE WHEN abs(truth - pred) <= 1 THEN n ELSE 0 END) / sum(n) AS w1 FROM counts GROUP BY {by}),
obs AS (SELECT {by}, sum((a.k - b.k) ** 2 * counts.n) AS o FROM counts JOIN ranks a USING ({by}) JOIN ranks b USING ({by}) WHERE a.c = truth AND b.c = pred GROUP BY {by}),
expd AS (SELECT {by}, sum((a.k - b.k) ** 2 * r.n * s.n) AS e FROM rowsums r JOIN colsums s USING ({by}) JOIN ranks a USING ({by}) JOIN ranks b USING ({by}) WHERE a.c = r.c AND b.c = s.c GROUP BY {by}),
kap AS (SELECT {by}, 1 - o * total / e AS qwk FROM obs JOIN expd USING ({by}) JOIN bas USING ({by}))
"""


def _scored(by: str, source: str, columns: str) -> str:
    return f"WITH {SQL}, p AS ({source}), {_SCORES.format(by=by)} SELECT {by}, {columns} FROM bas JOIN bal USING ({by}) JOIN kap USING ({by})"


_BASIC = f"total::BIGINT AS N, {R('acc', 'Accuracy')}, {R('mae', 'MAE')}, {R('w1', 'Within1')}, {R('1 - w1', 'SevereErrorRate')}"
_BALANCED = f"{R('ba', 'BalancedAccuracy')}, {R('f1', 'MacroF1')}"
_RANKS = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2)".format
_PAIRS = f"{SQL}, pairs AS (SELECT a.tree, a.field, a.class, a.x AS x_l1, b.x AS x_h300 FROM observations a JOIN observations b ON a.tree = b.tree AND a.source = 'L1' AND b.source = 'H300')"
_CORR = f"{SQL}, cr AS (SELECT field, {_RANKS(by='field', x='truth')} AS rx, {_RANKS(by='field', x='pred2')} AS ry FROM (SELECT *, pred + (key % 3) / 2 AS pred2 FROM predictions WHERE method = 'B')), rc AS (SELECT field, count(*) AS N, corr(rx, ry) AS rho FROM cr GROUP BY field)"
_RATED = f"{SQL}, rated AS (SELECT max(pred) FILTER (method = 'A') AS r1, max(pred) FILTER (method = 'B') AS r2, any_value(truth) AS r3, CASE WHEN key % 9 <> 0 THEN (key % 5)::INT END AS r4 FROM predictions GROUP BY key), complete AS (SELECT *, row_number() OVER () AS i FROM rated WHERE r4 IS NOT NULL), long AS (SELECT i, unnest([1, 2, 3, 4]) AS k, unnest([r1, r2, r3, r4])::DOUBLE AS v FROM complete)"
_HASH = "((({key} % 2147483647 * 2654435761 + ({repeat} * 1009 + 42) * 40503) % 4294967296) * 48271) % 2147483647".format


def _iso(folds: str, by: str) -> str:
    """Rules of the threshold classifier for rows ``tr(by, x, y)``."""
    return f"""{folds},
md AS (SELECT {by}, median(x) AS med FROM tr GROUP BY {by}),
fl AS (SELECT tr.*, coalesce(x, med) AS xx FROM tr JOIN md USING ({by})),
rk AS (SELECT {by}, {_RANKS(by=by, x='xx')} AS rx, {_RANKS(by=by, x='y')} AS ry FROM fl),
ori AS (SELECT {by}, CASE WHEN coalesce(CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, -1) >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS o FROM rk GROUP BY {by}),
ce AS (SELECT {by}, y, median(xx * o) AS m, count(*) AS n FROM fl JOIN ori USING ({by}) GROUP BY {by}, y),
rn AS (SELECT {by}, a.y AS i, b.y AS k, sum(c.m * c.n) / sum(c.n) AS mean FROM ce a JOIN ce b USING ({by}) JOIN ce c USING ({by}) WHERE a.y <= b.y AND c.y BETWEEN a.y AND b.y GROUP BY {by}, a.y, b.y),
ls AS (SELECT {by}, i, ce.y AS c, min(mean) AS mean FROM rn JOIN ce USING ({by}) WHERE ce.y BETWEEN i AND k GROUP BY {by}, i, ce.y),
ft AS (SELECT {by}, c, max(mean) AS center FROM ls GROUP BY {by}, c),
cu AS (SELECT {by}, c, (center + lead(center) OVER (PARTITION BY {by} ORDER BY c)) / 2 AS cut FROM ft),
rules AS (SELECT {by}, list(c ORDER BY c) AS classes, list(cut ORDER BY cut) FILTER (cut IS NOT NULL) AS cuts FROM cu GROUP BY {by})"""


def _lofo(rows: str, by: str, extra: str = "") -> str:
    folds = f"WITH {SQL}, ob AS ({rows}), hf AS (SELECT DISTINCT {extra}field AS held FROM ob), tr AS (SELECT {'ob.source, ' if extra else ''}held, x, y FROM ob JOIN hf ON {'ob.source = hf.source AND ' if extra else ''}ob.field <> held)"
    on = "ob.field = rules.held" + (" AND ob.source = rules.source" if extra else "")
    on_md = "md.held = rules.held" + (" AND md.source = rules.source" if extra else "")
    on_o = on_md.replace("md.", "ori.")
    return _iso(folds, by) + f", pr AS (SELECT {'ob.source, ' if extra else ''}tree, rules.held AS held_field, y AS truth, classes[least(len(list_filter(cuts, lambda t: t <= coalesce(x, med) * o)), len(classes) - 1) + 1] AS pred FROM ob JOIN rules ON {on} JOIN md ON {on_md} JOIN ori ON {on_o})"


_HULL = """, pts AS (SELECT DISTINCT tree, x, y FROM cloud), ext AS (SELECT tree, y, min(x) AS lo, max(x) AS hi FROM pts GROUP BY tree, y), cand AS (SELECT tree, lo AS x, y FROM ext UNION SELECT tree, hi, y FROM ext),
edges AS (SELECT a.tree, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bv FROM cand a JOIN cand b ON a.tree = b.tree AND (a.x <> b.x OR a.y <> b.y) JOIN cand c ON c.tree = a.tree GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= -1e-9)
SELECT tree, round(abs(sum(ax * bv - bx * ay)) / 2, 6) + 0.0 AS hull_area FROM edges GROUP BY tree"""

_EDGES = "lh AS (SELECT greatest(0.5, floor(min(v) / 0.15) * 0.15) AS lo, ceil(max(v) / 0.15) * 0.15 AS hi0 FROM ok), lo AS (SELECT lo, CASE WHEN hi0 <= lo THEN lo + 0.15 ELSE hi0 END AS hi FROM lh), n AS (SELECT lo, hi, ceil((hi + 0.15 * 1.001 - lo) / 0.15)::INT AS k FROM lo), e AS (SELECT CASE WHEN k >= 6 THEN list_transform(range(0, k), lambda i: lo + i * 0.15::DOUBLE) ELSE list_transform(range(0, 7), lambda i: lo + i * (hi - lo) / 6) END AS edges FROM n)"
_PANELS = f"{_HEIGHTS}, ok AS (SELECT round(height, 9) AS v, field FROM heights WHERE status = 'OK'), pn AS (SELECT 'all' AS panel, v FROM ok UNION ALL SELECT field::VARCHAR, v FROM ok), lim AS (SELECT greatest(0.45, min(v) - greatest(0.08, 0.03 * (max(v) - min(v)))) AS x_low, max(v) + greatest(0.08, 0.03 * (max(v) - min(v))) AS x_high FROM ok), {_EDGES}"
_DENSITY = f"WITH {SQL}, boxes AS (SELECT tree, count(*) AS n_points, (max(x) - min(x)) * {{f}} AS width, (max(y) - min(y)) * {{f}} AS height FROM cloud GROUP BY tree), hulls AS ({{hull}}), dens AS (SELECT tree, n_points, width, height, width * height AS box_area, n_points / (width * height) AS box_density, hull_area * {{f}} * {{f}} AS hull_area FROM boxes JOIN hulls USING (tree))"


def _hulls() -> str:
    """``tree, hull_area`` of a table ``cloud``, unrounded."""
    hull = _HULL.replace("round(abs(sum(ax * bv - bx * ay)) / 2, 6) + 0.0", "abs(sum(ax * bv - bx * ay)) / 2")
    ctes, last = hull.lstrip(", ").rsplit("\nSELECT", 1)
    return f"WITH {ctes} SELECT{last}"


def _density(f: float) -> str:
    return _DENSITY.format(f=f, hull=_hulls())


_METHOD_X = {"VRI_Threshold": "vri", "GlobalPF_Threshold": "gpf"}


def _method(scheme: str, method: str) -> str:
    """Threshold predictions of one method and scheme, from the descriptors themselves."""
    label = "tree % 5" if scheme == "five_class" else "greatest(tree % 5 - 1, 0)"
    rows = f"SELECT tree, (tree % 4 + 1)::INT AS field, ({label})::INT AS y, round({_METHOD_X[method]}, 9) AS x FROM base"
    return "(" + _lofo(rows, "held").replace(f"WITH {SQL}, ob", f"WITH base AS ({_CLOUD} SELECT * FROM base), ob") + f" SELECT '{scheme}' AS scheme, '{method}' AS method, * FROM pr)"


ORACLES = {
    "method_thresholds": " UNION ALL ".join("SELECT * FROM " + _method(s, m) for s in ("five_class", "merge01") for m in _METHOD_X),
    "height_panel_lines": f"{_PANELS} SELECT panel, count(*) AS n, {R('avg(v)', 'mean')}, {R('median(v)', 'median')}, {R('min(v)', 'min')}, {R('max(v)', 'max')}, {R('any_value(x_low)', 'x_low')}, {R('any_value(x_high)', 'x_high')} FROM pn, lim GROUP BY panel",
    "height_panel_bins": f"{_PANELS} SELECT panel, least(len(list_filter(edges, lambda t: t <= v)), len(edges) - 1)::INT AS bin, count(*) AS n FROM pn, e WHERE v BETWEEN edges[1] AND edges[-1] GROUP BY 1, 2",
    "height_panel_curves": f"{_PANELS}, s AS (SELECT panel, stddev_samp(v) * count(*) ** (-0.2) AS bw FROM pn GROUP BY panel HAVING count(*) >= 5 AND stddev_samp(v) > 1e-9), g AS (SELECT panel, bw, i::INT AS i, x_low + (x_high - x_low) * i / 349 AS x FROM s, lim, range(0, 350) r(i)), w AS (SELECT median(edges[k + 1] - edges[k]) AS width FROM e, range(1, (SELECT len(edges) FROM e)) q(k)) SELECT panel, i, {R('any_value(x)', 'x')}, round(sum(exp(-0.5 * ((x - v) / bw) ** 2) / (bw * sqrt(2 * pi()))) * any_value(width), 6) + 0.0 AS density FROM g JOIN pn USING (panel), w GROUP BY panel, i",
    "density_report": f"{_density(0.3048)} SELECT tree, n_points, {R('width', 'width')}, {R('height', 'height')}, {R('box_area', 'box_area')}, {R('box_density', 'box_density')}, {R('hull_area', 'hull_area')}, {R('hull_area / box_area', 'hull_to_box')}, {R('n_points / hull_area', 'hull_density')} FROM dens",
    "density_summary": f"{_density(1.0)} SELECT count(*) AS n_files, sum(n_points)::BIGINT AS points, {R('sum(hull_area)', 'hull_area')}, {R('avg(n_points / hull_area)', 'mean')}, {R('median(n_points / hull_area)', 'median')}, {R('min(n_points / hull_area)', 'min')}, {R('max(n_points / hull_area)', 'max')}, {R('stddev_samp(n_points / hull_area)', 'sd')}, {R('sum(n_points) / sum(hull_area)', 'pooled')} FROM dens",
    "profile_fingerprint": f"{_CLOUD}, sh AS (SELECT tree::VARCHAR AS k, concat_ws(',', tree::VARCHAR, (tree % 5)::VARCHAR, {", ".join(f"printf('%.12g', sum((bin = {k})::INT) / any_value(n))" for k in range(1, 21))}) AS line FROM bins GROUP BY tree) SELECT sha256('TreeKey,Class,{','.join(f'p{k}' for k in range(1, 21))}' || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10)) AS sha256 FROM sh",
    "rating_pair_means": f"WITH {_RATED}, p AS (SELECT avg((p.v = q.v)::INT) AS exact, avg((abs(p.v - q.v) <= 1)::INT) AS w1 FROM long p JOIN long q ON p.i = q.i AND p.k < q.k GROUP BY p.k, q.k) SELECT {R('avg(exact)', 'exact')}, {R('avg(w1)', 'within1')} FROM p",
    "feature_row": f"SELECT * FROM ({_picked(*_FEATURE_COLUMNS)}) JOIN ({_CLOUD} {_PROFILE}) USING (tree)",
    "z_trim_depth": f"{_CLOUD} SELECT tree, count(*) AS n, {R('any_value(zlo)', 'zlo')}, {R('any_value(zhi)', 'zhi')}, {R('avg(d)', 'mean_depth')} FROM t GROUP BY tree",
    "profile20": f"{_CLOUD} {_PROFILE}",
    "vri_global_pf": _picked("VRI", "GlobalPF50", "PointCount"),
    "robust_frame": _picked("CrownLength", "CrownWidth"),
    "core_pf": _picked("CorePF50", "CorePointCount"),
    "grid_prevalence": _picked("TA50", "PGF50", "GridValidCells"),
    "polar_tail": _picked("CPC90"),
    "height_status": f"{_HEIGHTS} SELECT tree, n_points, {R('height', 'height')}, status, field FROM heights",
    "height_summary": f"{_HEIGHTS} SELECT field, count(height) AS n, {R('avg(height)', 'mean')}, {R('stddev_samp(height)', 'sd')}, {R('quantile_cont(height, 0.25)', 'q1')}, {R('median(height)', 'median')}, {R('quantile_cont(height, 0.75)', 'q3')}, {R('min(height)', 'min')}, {R('max(height)', 'max')} FROM heights WHERE status = 'OK' GROUP BY GROUPING SETS ((), (field))",
    "height_histogram": f"{_HEIGHTS}, ok AS (SELECT round(height, 9) AS v FROM heights WHERE status = 'OK'), lh AS (SELECT greatest(0.5, floor(min(v) / 0.15) * 0.15) AS lo, ceil(max(v) / 0.15) * 0.15 AS hi0 FROM ok), lo AS (SELECT lo, CASE WHEN hi0 <= lo THEN lo + 0.15 ELSE hi0 END AS hi FROM lh), n AS (SELECT lo, hi, ceil((hi + 0.15 * 1.001 - lo) / 0.15)::INT AS k FROM lo), e AS (SELECT CASE WHEN k >= 6 THEN list_transform(range(0, k), lambda i: lo + i * 0.15::DOUBLE) ELSE list_transform(range(0, 7), lambda i: lo + i * (hi - lo) / 6) END AS edges FROM n) SELECT least(len(list_filter(edges, lambda t: t <= v)), len(edges) - 1)::INT AS bin, count(*) AS n FROM ok, e WHERE v BETWEEN edges[1] AND edges[-1] GROUP BY 1",
    "height_kde": f"{_HEIGHTS}, s AS (SELECT count(*) AS n, stddev_samp(height) AS sd, min(height) AS lo, max(height) AS hi FROM heights), g AS (SELECT i::INT AS i, lo + (hi - lo) * i / 349 AS x, sd * n ** (-0.2) AS bw FROM s, range(0, 350) r(i) WHERE n >= 5 AND sd > 1e-9) SELECT i, {R('x', 'x')}, round(sum(exp(-0.5 * ((x - height) / bw) ** 2) / (bw * sqrt(2 * pi()))) * 0.15, 6) + 0.0 AS density FROM g, heights GROUP BY i, x",
    "bbox_density": f"{_BOXES} SELECT tree, n_points, {R('width', 'width')}, {R('height', 'height')}, {R('box_area', 'box_area')}, {R('n_points / box_area', 'box_density')} FROM boxes WHERE box_area > 0",
    "pooled_density": f"{_BOXES} SELECT count(*) AS n_files, sum(n_points)::BIGINT AS points, {R('sum(n_points) / sum(box_area)', 'pooled')}, {R('avg(n_points / box_area)', 'mean_density')} FROM boxes WHERE box_area > 0",
    "hull_area": f"WITH {SQL}{_HULL}",
    "validate_flags": f"WITH {SQL}, r AS (SELECT source, CASE WHEN tree % 5 = 0 THEN 50 ELSE 60 END AS alt, class + CASE WHEN tree % 11 = 0 THEN 3 ELSE 0 END AS class, x FROM observations) SELECT unnest(['missing_identifier', 'source_domain', 'class_domain', 'field_domain', 'altitude_domain', 'infinite_feature', 'all_null_x', 'empty']) AS rule, unnest([0, 0, count(*) FILTER (class NOT IN (0, 1, 2, 3, 4)), 0, count(*) FILTER (alt NOT IN (20, 40, 60, 80, 100, 120)), 0, (count(x) = 0)::INT, (count(*) = 0)::INT]) AS bad FROM r",
    "duplicate_obs": "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "label_conflicts": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS labels FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "coverage_gaps": f"WITH {SQL}, a AS (SELECT DISTINCT field, pred FROM predictions WHERE method = 'A' AND truth = 0), b AS (SELECT DISTINCT field, pred FROM predictions WHERE method = 'B' AND truth = 1 AND pred <> 3) SELECT *, 'first' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'second' FROM (FROM b EXCEPT FROM a)",
    "canonical_order_rank": f"WITH {SQL}, r AS (SELECT tree, source, CASE WHEN tree % 3 <> 0 THEN tree * 2 + (source = 'L1')::INT END AS rank FROM observations) SELECT *, row_number() OVER (ORDER BY rank NULLS LAST, tree, source)::INT AS position FROM r",
    "label_merge": f"WITH {SQL} SELECT truth, CASE truth WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS merged, count(*) AS n FROM predictions GROUP BY ALL",
    "sensor_pairs": f"WITH {_PAIRS} SELECT tree, field, class, {R('x_l1', 'x_l1')}, {R('x_h300', 'x_h300')} FROM pairs",
    "sensor_agreement": f"WITH {_PAIRS}, ok AS (SELECT *, {_RANKS(by='field', x='x_l1')} AS rx, {_RANKS(by='field', x='x_h300')} AS ry, (x_l1 + x_h300) / 2 AS m FROM pairs WHERE x_l1 IS NOT NULL AND x_h300 IS NOT NULL), s AS (SELECT field, count(*) AS n, corr(rx, ry) AS rho, avg(x_h300 - x_l1) AS bias, avg(abs(x_h300 - x_l1)) AS mae, avg(m) AS g, avg(x_l1) AS c1, avg(x_h300) AS c2 FROM ok GROUP BY field), q AS (SELECT field, any_value(s.n) AS n, 2 * sum((m - g) ** 2) / (any_value(s.n) - 1) AS msr, any_value(s.n) * any_value((c1 - g) ** 2 + (c2 - g) ** 2) AS msc, sum((x_l1 - m - c1 + g) ** 2 + (x_h300 - m - c2 + g) ** 2) / (any_value(s.n) - 1) AS mse FROM ok JOIN s USING (field) GROUP BY field) SELECT field, n AS N, {R('rho', 'rho')}, round(CASE WHEN n >= 3 AND abs(msr + mse + 2 * (msc - mse) / n) > 1e-8 THEN (msr - mse) / (msr + mse + 2 * (msc - mse) / n) END, 6) + 0.0 AS icc_a1, {R('bias', 'bias')}, {R('mae', 'mae')} FROM q JOIN (SELECT field, rho, bias, mae FROM s) USING (field)",
    "sensor_bias_shift": f"WITH {_PAIRS}, sh AS (SELECT h.held, median(x_h300 - x_l1) AS shift FROM pairs JOIN (SELECT DISTINCT field AS held FROM pairs) h ON field <> held GROUP BY h.held) SELECT tree, held, {R('shift', 'shift')}, {R('x_h300 - shift', 'shifted')} FROM pairs JOIN sh ON field = held",
    "confusion": f"WITH {SQL} SELECT method, truth, pred, count(*) AS n FROM predictions GROUP BY ALL",
    "metrics_basic": _scored("method, field", "FROM predictions", _BASIC),
    "balanced_f1": _scored("method, field", "FROM predictions", _BALANCED),
    "qwk": _scored("method, field", "FROM predictions", R("qwk", "QWK")),
    "metric_block": _scored("method", "SELECT method, greatest(truth - 1, 0) AS truth, greatest(pred - 1, 0) AS pred FROM predictions", f"{_BASIC}, {_BALANCED}, {R('qwk', 'QWK')}"),
    "qwk_rank_weights": _scored("method", "FROM predictions WHERE truth <> 2 AND pred <> 2", R("qwk", "QWK")),
    "field_summary": f"WITH {SQL}, f AS (SELECT method, field, count(*) AS n, avg((truth = pred)::INT) AS a FROM predictions GROUP BY ALL) SELECT method, {R('sum(a * n) / sum(n)', 'Accuracy')}, {R('avg(a)', 'FieldUnweightedAccuracy')}, {R('min(a)', 'WorstFieldAccuracy')}, {R('max(a)', 'BestFieldAccuracy')}, {R('stddev_pop(a)', 'FieldAccuracySD')} FROM f GROUP BY method",
    "paired_methods": f"WITH {SQL} SELECT a.field, a.truth, a.pred AS a, b.pred AS b, count(*) AS n FROM predictions a JOIN predictions b ON a.key = b.key AND a.method = 'A' AND b.method = 'B' GROUP BY ALL",
    "bootstrap_native": f"WITH {SQL}, g AS (SELECT key, field, truth, max((pred = truth)::INT) FILTER (method = 'A') - max((pred = truth)::INT) FILTER (method = 'B') AS gap FROM predictions GROUP BY key, field, truth), k AS (SELECT field, truth, count(*) AS n, count(*) FILTER (gap = 1) AS up, count(*) FILTER (gap = -1) AS down FROM g GROUP BY ALL), d AS (SELECT b, ((((b * 40503 + i * 9973 + field * 977 + truth * 331 + 42) * 48271) % 2147483647 * 16807) % 2147483647) % n AS spot, up, down FROM k, range(0, 3000) r(b), range(0, (SELECT max(n) FROM k)) s(i) WHERE i < n), v AS (SELECT b, avg(CASE WHEN spot < up THEN 1 WHEN spot < up + down THEN -1 ELSE 0 END) AS v FROM d GROUP BY b) SELECT (SELECT round((sum(up) - sum(down)) / sum(n), 6) + 0.0 FROM k) AS a_minus_b, (SELECT sum(n)::BIGINT FROM k) AS n, {R('quantile_cont(v, 0.025)', 'ci_low')}, {R('quantile_cont(v, 0.975)', 'ci_high')} FROM v",
    "stratified_folds": f"WITH o AS (SELECT o_orderkey AS key, left(o_orderpriority, 1)::INT AS label, r.repeat::INT AS repeat FROM orders, range(0, 10) r(repeat)), f AS (SELECT *, ((row_number() OVER (PARTITION BY repeat, label ORDER BY {_HASH(key='key', repeat='repeat')}, key) - 1) % 5)::INT AS fold FROM o) SELECT repeat, label, fold, count(*) AS n, sum(key)::BIGINT AS key_sum FROM f GROUP BY ALL",
    "cv_summary": f"WITH o AS (SELECT o_orderkey AS key, left(o_orderpriority, 1)::INT - 1 AS label, (floor(o_totalprice / 20000)::BIGINT % 7)::INT AS g, r.repeat::INT AS repeat FROM orders, range(0, 10) r(repeat)), f AS (SELECT *, (row_number() OVER (PARTITION BY repeat, label ORDER BY {_HASH(key='key', repeat='repeat')}, key) - 1) % 5 AS fold FROM o), ff AS (SELECT DISTINCT repeat, fold AS held FROM f), tc AS (SELECT f.repeat, held, g, label, count(*) FILTER (fold <> held) AS n FROM f JOIN ff USING (repeat) GROUP BY ALL), best AS (SELECT repeat, held, g, arg_max(label, n * 100 - label) AS pred FROM tc GROUP BY ALL), a AS (SELECT f.repeat, avg((label = pred)::INT) AS a FROM f JOIN best ON best.repeat = f.repeat AND best.held = f.fold AND best.g = f.g GROUP BY f.repeat) SELECT {R('avg(a)', 'cv_accuracy')}, count(*) AS repeats FROM a",
    "cv_gap": f"WITH {SQL}, c AS (SELECT method, avg(a) AS cv FROM (SELECT method, key % 5 AS f, avg((truth = pred)::INT) AS a FROM predictions GROUP BY ALL) GROUP BY method), l AS (SELECT method, avg(a) AS lofo FROM (SELECT method, field, avg((truth = pred)::INT) AS a FROM predictions GROUP BY ALL) GROUP BY method) SELECT method, {R('cv', 'cv')}, {R('lofo', 'lofo')}, {R('cv - lofo', 'gap')} FROM c JOIN l USING (method)",
    "balanced_weights": f"WITH {SQL}, c AS (SELECT field, truth, count(*) AS n FROM predictions WHERE method = 'A' GROUP BY ALL) SELECT field, truth, n, round((SELECT sum(n) FROM c d WHERE d.field = c.field) / ((SELECT count(*) FROM c d WHERE d.field = c.field) * n), 6) + 0.0 AS weight FROM c",
    "threshold_fit": _iso(f"WITH {SQL}, tr AS (SELECT source, x, class AS y FROM observations)", "source") + f" SELECT source, {R('med', 'median')}, o AS orient, array_to_string(classes, ',') AS classes, unnest(range(0, len(cuts)))::INT AS k, round(unnest(cuts), 6) + 0.0 AS cut FROM rules JOIN md USING (source) JOIN ori USING (source)",
    "threshold_lofo": _lofo("SELECT tree, field, class AS y, x FROM observations WHERE source = 'L1'", "held") + " SELECT * FROM pr",
    "threshold_lofo_merge01": _lofo("SELECT tree, field, greatest(class - 1, 0) AS y, x FROM observations WHERE source = 'L1'", "held") + " SELECT * FROM pr",
    "threshold_altitude": _lofo("SELECT tree, field, class AS y, x, source FROM observations WHERE field <= 3", "source, held", "source, ") + f", fs AS (SELECT source, held_field, count(*) AS n, avg((truth = pred)::INT) AS a FROM pr GROUP BY ALL) SELECT source, {R('sum(a * n) / sum(n)', 'Accuracy')}, {R('avg(a)', 'FieldUnweightedAccuracy')}, {R('min(a)', 'WorstFieldAccuracy')}, {R('max(a)', 'BestFieldAccuracy')}, {R('stddev_pop(a)', 'FieldAccuracySD')} FROM fs GROUP BY source",
    "rating_summary": f"WITH {_RATED}, rm AS (SELECT i, avg(v) AS m, max(v) - min(v) AS range, stddev_samp(v) AS sd FROM long GROUP BY i), cm AS (SELECT k, avg(v) AS c FROM long GROUP BY k), gm AS (SELECT avg(v) AS g, count(DISTINCT i) AS n FROM long), s AS (SELECT any_value(n) AS n, sum((m - g) ** 2) / (any_value(n) - 1) AS msr, any_value(n) * sum((c - g) ** 2) / any_value(n) / 3 AS msc, sum((v - m - c + g) ** 2) / ((any_value(n) - 1) * 3) AS mse FROM long JOIN rm USING (i) JOIN cm USING (k), gm) SELECT n, round((msr - mse) / (msr + 3 * mse + 4 * (msc - mse) / n), 6) + 0.0 AS icc_a1, round((msr - mse) / (msr + (msc - mse) / n), 6) + 0.0 AS icc_ak, (SELECT round(avg((range = 0)::INT), 6) + 0.0 FROM rm) AS all_equal, (SELECT round(avg((range <= 1)::INT), 6) + 0.0 FROM rm) AS range_le1, (SELECT round(median(range), 6) + 0.0 FROM rm) AS median_range, (SELECT round(avg(sd), 6) + 0.0 FROM rm) AS mean_sd FROM s",
    "rating_distribution": f"WITH {_RATED} SELECT range::INT AS range, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS fraction FROM (SELECT i, max(v) - min(v) AS range FROM long GROUP BY i) GROUP BY range",
    "rating_pairs": f"WITH {_RATED} SELECT 'r' || p.k AS a, 'r' || q.k AS b, {R('avg((p.v = q.v)::INT)', 'exact')}, {R('avg((abs(p.v - q.v) <= 1)::INT)', 'within1')} FROM long p JOIN long q ON p.i = q.i AND p.k < q.k GROUP BY p.k, q.k",
    "rank_corr_by_group": f"WITH {_CORR} SELECT field, N, {R('rho', 'rho')} FROM rc",
    "fisher_ci": f"WITH {_CORR} SELECT field, N, {R('rho', 'rho')}, {R('tanh(atanh(rho) - 1.959963984540054 / sqrt(N - 3))', 'ci_low')}, {R('tanh(atanh(rho) + 1.959963984540054 / sqrt(N - 3))', 'ci_high')} FROM rc",
    "random_effects": f"WITH {_CORR}, z AS (SELECT atanh(rho) AS z, N - 3 AS w FROM rc WHERE N > 3), m AS (SELECT sum(w * z) / sum(w) AS zf, count(*) AS k, sum(w) - sum(w * w) / sum(w) AS c FROM z), q AS (SELECT sum(w * (z - zf) ** 2) AS Q, any_value(k) AS k, any_value(c) AS c FROM z, m), t AS (SELECT *, k - 1 AS df, greatest(0, (Q - (k - 1)) / c) AS tau2 FROM q), p AS (SELECT sum(z / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS zr, sqrt(1 / sum(1 / (1 / w + tau2))) AS se FROM z, t) SELECT k, {R('tanh(zr)', 'rho')}, {R('tanh(zr - 1.959963984540054 * se)', 'ci_low')}, {R('tanh(zr + 1.959963984540054 * se)', 'ci_high')}, {R('tau2', 'tau2')}, {R('Q', 'Q')}, df, round(greatest(0, (Q - df) / Q) * 100, 6) + 0.0 AS I2 FROM t, p",
    "level_distribution": f"WITH {SQL}, c AS (SELECT truth AS level, count(*) AS n FROM predictions WHERE method = 'A' AND truth IN (1, 3) GROUP BY 1) SELECT l.level::INT AS level, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) + 0.0 AS fraction, CASE WHEN l.level = 0 THEN 'dead trees, no samples expected' ELSE 'living trees' END AS meaning FROM range(0, 5) l(level) LEFT JOIN c ON c.level = l.level",
    "grade_errors": f"WITH {SQL} SELECT method, truth, pred - truth AS grade_difference, count(*) AS n FROM predictions WHERE pred <> truth GROUP BY ALL",
    "controls_union": f"WITH {SQL}, f AS (SELECT method, avg((truth = pred)::INT) AS acc, avg(abs(truth - pred)) AS mae FROM predictions GROUP BY 1) SELECT method, {R('acc', 'Accuracy')}, {R('mae', 'MAE')}, NULL AS ResultSource FROM f UNION ALL SELECT 'archived', round(acc, 6) + 0.0, NULL, 'archive' FROM f WHERE method = 'A'",
}
ORACLES["spread_feature_row"] = ORACLES["feature_row"]
