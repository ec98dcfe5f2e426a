"""Kernels and operators against plain versions and shapes of known measures."""

import math

import numpy as np
import pytest
from contourflow.functions import costs
from contourflow.kernels import runs, search, spline
from contourflow.kernels.labels import inscribed, union
from contourflow.operators import checks, graph, polyline, raster, sampling, smoothing, stats
from contourflow.operators import search as searches
from pyspark.sql import functions as F

CELLS = "terrain_id string, node long, i int, j int, z double, valid boolean"


def cells_of(spark, z, valid=None, name="t"):
    z = np.asarray(z, dtype=float)
    ok = np.ones(z.shape, dtype=bool) if valid is None else valid
    n = z.shape[1]
    return spark.createDataFrame([(name, i * n + j, i, j, float(z[i, j]), bool(ok[i, j])) for i in range(z.shape[0]) for j in range(n)], CELLS)


BANDS = np.repeat(np.array([[0, 0, 1, 1, 2, 2]]), 4, axis=0)


@pytest.mark.parametrize("seed", range(6))
def test_dijkstra_equals_relaxation_and_counts_its_work(seed):
    rng = np.random.default_rng(seed)
    n, m = 30, 120
    u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m).astype(float)
    g = search.Graph.of(u, v, w, np.arange(n))
    plain = np.full(n, np.inf)
    plain[0] = 0
    for _ in range(n):
        for a, b, c in zip(u, v, w, strict=True):
            plain[b] = min(plain[b], plain[a] + c)
    found = search.dijkstra(g, 0)
    assert np.array_equal(found.dist, plain)
    assert found.expanded == found.reached == np.isfinite(plain).sum() and found.pushed >= found.expanded
    for t in np.flatnonzero(np.isfinite(plain)):
        stop = search.dijkstra(g, 0, {int(t)})
        assert stop.dist[t] == plain[t] and stop.expanded <= found.expanded
        path = stop.path(int(t))
        assert path[0] == 0 and path[-1] == t
    assert search.dijkstra(g, 0, set()).expanded == 0


def test_hops_and_diameter():
    g = search.Graph.of(np.array([0, 1, 1, 2, 4]), np.array([1, 0, 2, 1, 4]), np.ones(5), np.arange(5))
    assert search.hops(g, 0).tolist() == [0, 1, 2, -1, -1]
    assert search.hop_diameter(g) == 2


@pytest.mark.parametrize("seed", range(5))
def test_union_equals_flooding(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    root = list(range(60))
    for _ in range(60):
        for a, b in zip(u, v, strict=True):
            root[a] = root[b] = min(root[a], root[b])
    assert union(60, u, v).tolist() == root


def test_spread_components_equal_the_kernel(spark):
    rng = np.random.default_rng(9)
    nodes = spark.createDataFrame([("t", k) for k in range(80)], "terrain_id string, node long")
    edges = spark.createDataFrame([("t", int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [("t", k, k + 1) for k in range(20)], "terrain_id string, u long, v long")
    by_kernel = {r["node"]: r["root"] for r in graph.components(nodes, edges).collect()}
    by_joins = {r["node"]: r["root"] for r in graph.components(nodes, edges, kernel_edges=0).collect()}
    assert by_kernel == by_joins and len(by_kernel) == 80


def test_areas_of_bands(spark):
    labelled = graph.cut_lineage(graph.height_areas(cells_of(spark, BANDS), 1))
    assert {r["area_id"] for r in labelled.collect()} == {0, 1, 2}
    d = graph.descriptors(labelled).first()
    assert (d["n_areas"], d["n_edges"], d["n_bands"], d["cyclomatic"], d["n_components"], d["degree_max"]) == (3, 2, 3, 0, 1, 2)
    assert d["gini"] == pytest.approx(0) and d["share_degree_1"] == pytest.approx(2 / 3)
    priced = {(r["a"], r["b"]): r for r in graph.border_prices(labelled, "height", 10.0).collect()}
    assert priced[(0, 1)]["dh"] == 1.0 and priced[(0, 1)]["length_m"] == pytest.approx(20.0)
    ok = np.ones(BANDS.shape, dtype=bool)
    ok[:, :2] = False
    assert graph.area_table(graph.height_areas(cells_of(spark, BANDS, ok), 1)).count() == 2
    with pytest.raises(ValueError):
        graph.buckets(cells_of(spark, BANDS), 0.5)


def test_relaxed_distances_equal_the_kernel(spark):
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells_of(spark, np.random.default_rng(2).integers(0, 9, (5, 6)))), "height"))
    starts = spark.createDataFrame([("t", 0), ("t", 7)], "terrain_id string, start long")
    both = [{(r["start"], r["node"]): r["cost"] for r in f(edges, starts).collect()} for f in (searches.distances, searches.relaxed_distances)]
    assert both[0] == both[1] and len(both[0]) == 60


def test_path_cost_is_the_searchs(spark):
    cells = cells_of(spark, np.add.outer(2 * np.arange(12), np.zeros(12)))
    pairs = spark.createDataFrame([("t", 0, 0, 143), ("t", 1, 5, 9999)], "terrain_id string, od_id long, start long, target long")
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells), "height_tiebreak"))
    found = {r["od_id"]: r for r in searches.searches(edges, pairs).collect()}
    again = {r["od_id"]: r for r in searches.recost(searches.paths(edges, pairs), edges).collect()}
    assert found[0]["cost"] == pytest.approx(again[0]["cost"]) and found[0]["climb_m"] == 22.0
    assert not found[1]["path_found"] and found[1]["cost"] is None


def test_costs_refuse_what_is_no_price(spark):
    for bad in ({"height": -1.0}, {}):
        with pytest.raises(costs.InvalidCostModel):
            costs.weighted_sum(**bad)
    with pytest.raises(costs.InvalidCostModel):
        costs.register("height", lambda dh, m: m)
    with pytest.raises(costs.InvalidCostModel):
        costs.probe(spark, lambda dh, m: dh)
    with pytest.raises(costs.InvalidCostModel):
        costs.get("nothing")
    for name in costs.available():
        costs.probe(spark, name)
    assert costs.grid_edge_cost("climb_gradient_cut", 7.0)[1] == 7.0 and costs.grid_edge_cost("climb")[0] is costs.get("height")
    for name in ("climb_gradient_penalty", "unknown"):
        with pytest.raises(costs.InvalidCostModel):
            costs.grid_edge_cost(name)


def points_of(spark, xyz, path=1):
    return spark.createDataFrame([(path, k, *map(float, p)) for k, p in enumerate(xyz)], "path_id long, seq int, x_m double, y_m double, z_m double")


@pytest.mark.parametrize("radius", [25.0, 95.0, 240.0, 650.0])
def test_circle_radius_and_length(spark, radius):
    t = np.linspace(0, 2 * np.pi, 4000)
    p = points_of(spark, np.stack([radius * np.cos(t), radius * np.sin(t), 0 * t], 1))
    m = polyline.measures(p).first()
    assert m["length_m"] == pytest.approx(2 * np.pi * radius, rel=1e-3) and math.isinf(m["sinuosity"])
    st = graph.cut_lineage(polyline.resample(p))
    r = [x["radius_m"] for x in polyline.curve_radii(st).collect()]
    assert min(r) > 0.97 * radius and max(r) < 1.03 * radius


def test_largest_s_solves_each_knot_set_a_few_times(monkeypatch):
    rng = np.random.default_rng(7)
    points, calls, plain = np.stack([10.0 * np.arange(60), rng.integers(0, 100, 60)], 1), [], spline.solved
    monkeypatch.setattr(spline, "solved", lambda a, b: calls.append(1) or plain(a, b))
    found = spline.largest_s(points, 2.5)
    assert found.tried > 5 and len(calls) < 3 * len(points)
    a, b = rng.random((150, 2)), rng.random((70, 2))
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert spline.hausdorff(a, b) == max(d.min(axis=1).max(), d.min(axis=0).max())
    knots, u = np.r_[np.zeros(4), 0.25, 0.5, 0.5, 0.8, np.ones(4)], np.linspace(0, 1, 41)
    values = spline.basis(knots, 3, u)
    assert np.allclose(values.sum(axis=1), 1.0) and (values >= 0).all() and np.allclose(values @ [knots[i + 1 : i + 4].mean() for i in range(8)], u)


def test_paths_are_smoothed_in_many_tasks(spark):
    points = spark.range(400).selectExpr("id div 4 AS path_id", "int(id % 4) AS seq", "double(id % 4 * 10) AS x_m", "double(id % 3) AS y_m", "0D AS z_m")
    found = smoothing.before_after(points, checks.road_classes(spark).filter("name = 'STAS863_V25'"))
    assert found.count() == 100 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_costs_by_slabs_are_the_searchs(spark):
    rng = np.random.default_rng(3)
    ok = rng.random((40, 4)) > 0.2
    ok[25] = False  # two halves without a way between them
    cells = cells_of(spark, rng.integers(0, 50, (40, 4)), ok).filter("valid")
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells), "height_tiebreak"))
    pairs = graph.cut_lineage(spark.range(120).selectExpr("'t' AS terrain_id", "id AS od_id", "id * 37 % 160 AS start", "id * 61 % 160 AS target"))
    found = {r["od_id"]: r for r in searches.costs(edges, pairs, cells, search_work=0, most_slabs=5).collect()}
    plain = {r["od_id"]: r for r in searches.searches(edges, pairs, cells).collect()}
    assert len(found) == 120 and sum(r["path_found"] for r in found.values()) not in (0, 120)
    for od, r in plain.items():
        assert found[od]["path_found"] == r["path_found"] and found[od]["n_edges"] == max(r["n_path_nodes"] - 1, 0)
        assert [found[od][c] for c in ("cost", "length_m", "climb_m")] == ([pytest.approx(r[c]) for c in ("cost", "length_m", "climb_m")] if r["path_found"] else [None] * 3)
    short = {r["od_id"]: r for r in searches.cost_measures(searches.costs(edges, pairs, None, 0, 5), pairs, cells, 1.0).collect()}
    for od, r in short.items():
        (i, j), (a, b) = divmod(od * 37 % 160, 4), divmod(od * 61 % 160, 4)
        assert r["sinuosity"] == (pytest.approx(found[od]["length_m"] / math.hypot(i - a, j - b)) if (i, j) != (a, b) else math.inf)
    assert {od for od, r in found.items() if r["n_edges"] > 0} <= short.keys()


def test_edges_are_copied_to_no_more_tasks_than_cores(spark):
    edges = spark.range(10).selectExpr("'t' AS terrain_id", "id AS u", "id + 1 AS v", "1D AS weight")
    pairs = spark.range(500).selectExpr("'t' AS terrain_id", "id AS od_id", "0L AS start", "1L AS target")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        copies, dealt = searches._dealt(edges, pairs, 1)
        assert copies.count() == 10 * spark.sparkContext.defaultParallelism and dealt.agg(F.max("part")).first()[0] < spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_cells_are_never_broadcast(spark):
    cells = spark.createDataFrame([("t", i * 3 + j, i, j, float(i + j), True) for i in range(3) for j in range(3)], "terrain_id string, node long, i int, j int, z double, valid boolean")
    edges = graph.masked(graph.grid_edges(cells), cells.filter("z > 0"))
    assert edges.count() == 34
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()


def test_only_a_straight_along_an_axis_is_surely_straight(spark):
    xy = {1: [(0, 0), (1, 3), (2, 6)], 2: [(0, 5), (1, 5), (2, 5)], 3: [(4, 4), (4, 4), (9, 1)], 4: [(0, 0), (1, 1), (2, 0)]}
    st = spark.createDataFrame([(p, k, float(x), float(y)) for p, points in xy.items() for k, (x, y) in enumerate(points)], "path_id long, k long, x_m double, y_m double")
    found = {r["path_id"]: (math.isinf(r["radius_m"]), r["on_axis"]) for r in polyline.curve_radii(st).collect()}
    assert found == {1: (True, False), 2: (True, True), 3: (True, True), 4: (False, False)}


def test_straight_slope_is_one_tangent(spark):
    s = np.linspace(0, 1000, 201)
    p = points_of(spark, np.stack([s, 0 * s, 0.04 * s], 1))
    st = graph.cut_lineage(polyline.station_gradient(polyline.classify(polyline.station_radii(polyline.resample(p)))))
    found = polyline.elements(st).collect()
    assert [(e["kind"], round(e["length_m"], 6)) for e in found] == [("tangent", 1000.0)]
    assert all(abs(r["gradient"] - 0.04) < 1e-9 for r in st.collect())
    weights = checks.station_weights(st).agg(F.sum("weight_m")).first()[0]
    assert weights == pytest.approx(1000.0)


def test_crest_and_sag_breaks(spark):
    s = np.linspace(0, 600, 121)
    crest = np.where(s < 300, 0.05 * s, 15 - 0.05 * (s - 300))
    for z, kind, delta in ((crest, "convex", -0.10), (-crest, "concave", 0.10)):
        line = polyline.grade_line(polyline.chainage(points_of(spark, np.stack([s, 0 * s, z], 1))), 300.0).filter("v_kind IS NOT NULL").collect()
        assert [r["v_kind"] for r in line] == [kind]
        assert line[0]["delta"] == pytest.approx(delta) and line[0]["r_v"] == pytest.approx(3000.0)


def test_tight_arc_fails_the_stricter_class(spark):
    t = np.linspace(0, np.pi, 400)
    out = {}
    for radius in (30.0, 400.0):
        p = points_of(spark, np.stack([radius * np.cos(t), radius * np.sin(t), 0 * t], 1))
        st = polyline.tangent_lengths(polyline.station_gradient(polyline.classify(polyline.station_radii(polyline.resample(p)))))
        st = checks.series(checks.station_weights(st.withColumns({"r_v": F.lit(None).cast("double"), "v_kind": F.lit(None).cast("string")})))
        for r in checks.check_stations(st, checks.road_classes(spark)).filter("name = 'R_H' AND road_class LIKE 'STAS%'").collect():
            out[(radius, r["road_class"])] = r["status"]
    assert out == {(30.0, "STAS863_V40"): "fail", (30.0, "STAS863_V25"): "pass", (400.0, "STAS863_V40"): "pass", (400.0, "STAS863_V25"): "pass"}


def test_limits_have_slack(spark):
    from contourflow.functions.values import at_least, at_most

    df = spark.range(1).select(at_most(F.lit(7.0 + 1e-10), F.lit(7.0)).alias("a"), at_most(F.lit(7.001), F.lit(7.0)).alias("b"), at_least(F.lit(60.0 - 1e-9), F.lit(60.0)).alias("c"))
    assert tuple(df.first()) == (True, False, True)


def test_describe_counts_what_is_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", x) for x in (10.0, 20.0, inf, 30.0, inf, nan, None)] + [("b", float(x)) for x in (1, 2, 3, 4, 5)], "g string, x double")
    d = {r["g"]: r for r in stats.describe(df, ["g"], "x").collect()}
    assert (d["a"]["n"], d["a"]["n_inf"], d["a"]["n_nan"], d["a"]["n_missing"], d["a"]["mean"]) == (3, 2, 1, 1, 20.0) and d["a"]["note"]
    assert d["b"]["sd"] == pytest.approx(1.5811, abs=1e-4) and d["b"]["note"] is None


def test_mixed_builds_are_refused(spark):
    with pytest.raises(Exception, match="more than one build"):
        stats.one_build(spark.createDataFrame([("a",), ("b",)], "build string"), ["build"]).collect()


def test_window_sizes_and_heights_are_guarded(spark):
    with pytest.raises(ValueError):
        raster.full_windows(cells_of(spark, BANDS), 3, 2)
    with pytest.raises(ValueError):
        raster.assert_plausible(cells_of(spark, BANDS), 1.0, 5.0)


def test_splines_pass_through_or_meet_s():
    rng = np.random.default_rng(0)
    t = np.linspace(0, 3 * np.pi, 40)
    p = np.stack([10 * t, 20 * np.sin(t)], 1) + rng.normal(0, 0.5, (40, 2))
    u = spline.parameter(p)
    assert np.abs(spline.fit(p, 0.0).at(u) - p).max() < 1e-9
    residuals = [spline.fit(p, s).residual for s in (1.0, 5.0, 20.0, 100.0)]
    assert residuals == sorted(residuals) and all(r <= s * 1.001 for r, s in zip(residuals, (1, 5, 20, 100), strict=True))
    found = spline.largest_s(p, 2.0)
    assert 0 < found.deviation <= 2.0 and not found.hit_cap
    assert spline.largest_s(p[:3], 2.0).degenerate


def test_short_runs_are_absorbed_in_order():
    label, s = np.array([0, 0, 0, 1, 0, 0, 1, 1, 1], dtype=bool), np.arange(9) * 10.0
    assert runs.absorb_short(label, s, 15.0).tolist() == [False] * 6 + [True] * 3
    assert runs.absorb_short(label, s, 0.0).tolist() == label.tolist()


def test_thinning_keeps_ends_and_drops_lines():
    line = np.stack([np.arange(10.0), np.zeros(10)], 1)
    assert runs.thin(line, 1.0).tolist() == [[0, 0], [9, 0]]
    rng = np.random.default_rng(4)
    p = np.cumsum(rng.normal(0, 1, (60, 2)), axis=0)
    kept = runs.thin(p, 2.0)
    assert (kept[0] == p[0]).all() and (kept[-1] == p[-1]).all() and 2 <= len(kept) < 60


def test_smoothing_reports_and_guard(spark):
    t = np.linspace(0, 3 * np.pi, 30)
    p = points_of(spark, np.stack([30 * t, 40 * np.sin(t), t], 1))
    classes = checks.road_classes(spark).filter("name = 'STAS863_V25'")
    found = smoothing.guarded(smoothing.before_after(p, classes, smoothing.ARMS), classes).collect()
    assert {r["arm"] for r in found} == set(smoothing.ARMS)
    assert all(r["deviation_m"] <= 2.5 * (1 + 1e-9) for r in found if r["arm"] in ("baseline", "smooth_z"))


def test_pairs_are_accounted_for_and_reproducible(spark):
    z = np.add.outer(np.arange(40), np.zeros(40))
    labelled = graph.cut_lineage(graph.height_areas(cells_of(spark, z), 3))
    edges = graph.area_edges(labelled)
    first, again = ([tuple(r) for r in sampling.sample_pairs(labelled, edges, 40, 40, 1007).orderBy("od_id").collect()] for _ in range(2))
    assert first == again
    a = sampling.acceptance(sampling.sample_pairs(labelled, edges, 40, 40, 1007)).first()
    assert a["accepted"] + a["rejected"] == a["drawn"] and a["accepted"] == 3


def test_points_within_spans_go(spark):
    points = spark.createDataFrame([(1, float(k)) for k in range(10)] + [(2, float(k)) for k in range(4)], "path_id long, s double")
    spans = spark.createDataFrame([(1, 2.0, 4.0), (1, 3.0, 5.0), (2, 0.0, 3.0)], "path_id long, s_start double, s_end double")
    got = smoothing.drop_in_spans(points, spans).collect()
    assert sorted(r["s"] for r in got if r["path_id"] == 1) == [0, 1, 6, 7, 8, 9] and sum(r["path_id"] == 2 for r in got) == 4


def test_inscribed_distance_is_the_brute_one():
    rng = np.random.default_rng(6)
    for _ in range(5):
        inside = np.pad(rng.random((9, 11)) < 0.8, 1)
        out = np.argwhere(~inside)
        brute = max(float(np.sqrt(((out - c) ** 2).sum(axis=1)).min()) for c in np.argwhere(inside))
        assert inscribed(inside) == pytest.approx(brute)


def test_selection_share_and_pairs(spark):
    labelled = graph.cut_lineage(graph.height_areas(cells_of(spark, BANDS), 1))
    edges = graph.cut_lineage(graph.area_edges(labelled))
    start = spark.createDataFrame([("t", 0)], "terrain_id string, area_id long")
    shares = [graph.space_share(labelled, graph.selection(start, labelled, edges, k)).first() for k in (0, 1, 2, None)]
    assert [(round(r["share"], 6), r["n_areas"]) for r in shares] == [(round(1 / 3, 6), 1), (round(2 / 3, 6), 2), (1.0, 3), (1.0, 3)]
    assert graph.hop_diameters(edges).first()["hop_diameter"] == 2
    assert {r["width_m"] for r in graph.widths(labelled, 10.0).collect()} == {20.0}
    cells = cells_of(spark, np.add.outer(np.arange(20) * 0.5, np.zeros(20)))
    pairs = spark.createDataFrame([("t", 0, 0, 399), ("t", 1, 0, 380), ("t", 2, 3, 360)], "terrain_id string, od_id long, start long, target long")
    priced = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells, 10.0), "length"))
    found = searches.feasible_pairs(pairs, priced, cells, 10.0, 5.0, 2)
    assert [r["od_id"] for r in found.orderBy("od_id").collect()] == [0, 1]
    steep = searches.certify(pairs, priced, cells, 10.0, 1.0).collect()
    assert {r["verdict"] for r in steep} == {"no_way"}
    chosen = searches.first_or_reference(pairs, sampling.reference_pair(cells, 20, 20)).first()
    assert (chosen["start"], chosen["target"], chosen["screened"]) == (0, 399, True)
    fixed = sampling.reference_pair(cells, 20, 20).first()
    assert (fixed["start"], fixed["target"], fixed["od_protocol"]) == (5 * 20 + 5, 14 * 20 + 14, False)


def test_windows_and_grids_of_a_raster(spark):
    valid = np.ones((12, 12), dtype=bool)
    valid[5, 5] = False
    cells = cells_of(spark, np.add.outer(np.arange(12.0), np.arange(12.0)), valid)
    windows = raster.full_windows(cells, 4)
    chosen = raster.choose_windows(windows, 3, 1)
    assert chosen == raster.choose_windows(windows, 3, 1) and len(chosen) == 3
    assert all(abs(a[0] - b[0]) >= 4 or abs(a[1] - b[1]) >= 4 for a in chosen for b in chosen if a != b)
    grid = raster.load_grid(cells, 2, 2, 8).collect()
    assert len(grid) == 64 and sum(r["was_void"] for r in grid) == 1 and next(r["z"] for r in grid if r["was_void"]) == 9.0
    with pytest.raises(ValueError):
        raster.load_grid(cells, 4, 4, 3)


def test_elements_have_budgets_of_their_own():
    t = np.linspace(0, np.pi, 30)
    p = np.concatenate([np.stack([np.linspace(-200, 0, 12), np.full(12, 50.0)], 1), np.stack([50 * np.sin(t[1:]), 50 * np.cos(t[1:])], 1)])
    p += np.random.default_rng(2).normal(0, 0.4, p.shape)
    found = spline.largest_s(p, 0.5, is_curve=lambda c: c[:, 0] > 0, tangent_budget=1.5)
    base = spline.sampled(spline.fit(p, 0.0), len(p))
    parts = spline.element_deviations(base, found.curve, base[:, 0] > 0)
    assert all(d <= (0.5 if bend else 1.5) for bend, d in parts) and found.s > 0


def test_border_arcs_equal_flooding(spark):
    z = np.array([[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 1, 0, 1, 1], [2, 2, 2, 2, 2]])
    labelled = graph.cut_lineage(graph.height_areas(cells_of(spark, z), 1, 4))
    area = {(r["i"], r["j"]): r["area_id"] for r in labelled.collect()}
    zones = {}
    for (i, j), a in area.items():
        for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            b = area.get((i + di, j + dj))
            if b is not None and b != a:
                zones.setdefault((min(a, b), max(a, b)), set()).add((i, j))
    expect = set()
    for (a, b), cells in zones.items():
        todo = set(cells)
        while todo:
            front = [todo.pop()]
            arc = set(front)
            while front:
                i, j = front.pop()
                near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & todo
                todo -= near
                arc |= near
                front += near
            expect |= {(a, b, i * 5 + j, min(x * 5 + y for x, y in arc)) for i, j in arc}
    assert {tuple(r) for r in graph.boundary_components(labelled, 4).select("a", "b", "node", "arc").collect()} == expect


def test_chains_of_short_lines_lose_their_inner_points():
    zigzag = np.array([[0, 0], [1, 0.2], [2, -0.1], [3, 0.1], [20, 0], [20, 30], [21, 30.5], [50, 30]], dtype=float)
    assert runs.thin(zigzag, 1.0).tolist() == [[0, 0], [20, 0], [20, 30], [50, 30]]
    assert runs.thin(zigzag, 0.01).tolist() == zigzag.tolist()


def test_screen_passes_the_straight_gradient_alone(spark):
    cells = cells_of(spark, np.add.outer(np.arange(12) * 0.8, np.zeros(12)))
    pairs = spark.createDataFrame([(0, 0, 132), (1, 0, 11), (2, 5, 5)], "od_id long, start long, target long")
    found = {r["od_id"]: r for r in checks.screen_grade(pairs, cells, 10.0, 5.0).collect()}
    assert not found[0]["passes"] and found[0]["gradient_percent"] == pytest.approx(8.0) and found[0]["development"] == pytest.approx(1.6)
    assert found[1]["passes"] and found[2]["passes"] is None


def test_protocol_charges_each_rejection_once(spark):
    z = np.add.outer(np.arange(60), np.zeros(30))
    cells = cells_of(spark, z)
    labelled = graph.cut_lineage(graph.height_areas(cells, 3))
    edges = graph.cut_lineage(graph.area_edges(labelled))
    drawn = sampling.draw(60, 30, 1007)
    assert drawn.min() == 5 and drawn.max() == 24
    area = {(r["i"], r["j"]): r["area_id"] for r in labelled.collect()}
    rows, rejected = [], dict.fromkeys(sampling.CRITERIA, 0)
    for a, b, c, d in drawn[:400].tolist():
        x, y = area[(a, b)], area[(c, d)]
        if np.hypot(a - c, b - d) < 0.3 * np.hypot(60, 30):
            rejected["too_short"] += 1
        elif x == y:
            rejected["same_height_area"] += 1
        elif abs(x - y) < 3:
            rejected["hops_below_min"] += 1
        elif x in {r[0] for r in rows}:
            rejected["duplicate_start_area"] += 1
        elif y in {r[1] for r in rows}:
            rejected["duplicate_target_area"] += 1
        else:
            rows.append((x, y))
    got = sampling.sample_pairs(labelled, edges, 60, 30, 1007, n_pairs=99, candidates=400, diagonal=0.3, strict=False).collect()
    counts = next(r for r in got if r["od_id"] is None)
    assert [(r["area_start"], r["area_target"]) for r in sorted((r for r in got if r["od_id"]), key=lambda r: r["od_id"])] == rows and len(rows) > 1
    assert {c: counts[f"rejected_{c}"] for c in sampling.CRITERIA} == rejected and counts["drawn"] == 400
    with pytest.raises(Exception, match="TooFewPairs"):
        sampling.sample_pairs(labelled, edges, 60, 30, 1007, n_pairs=99, candidates=400).collect()
    with pytest.raises(sampling.TooFewPairs):
        sampling.box(10, 40)


def test_query_pairs_are_half_a_side_apart():
    found = sampling.query_pairs(50, 40, 30, 3)
    assert found.shape == (50, 4) and (np.hypot(found[:, 0] - found[:, 2], found[:, 1] - found[:, 3]) >= 15).all() and (found == sampling.query_pairs(50, 40, 30, 3)).all()


def test_searches_count_lone_cells_and_refuse_negative_weights(spark):
    z = np.zeros((3, 5))
    ok = np.ones((3, 5), dtype=bool)
    ok[:, 3] = False
    ok[1:, 4] = False  # a lone cell in the corner
    cells = cells_of(spark, z, ok).filter("valid")
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells), "length"))
    pairs = spark.createDataFrame([("t", 0, 0, 12), ("t", 1, 4, 4), ("t", 2, 0, 4), ("t", 3, 3, 3)], "terrain_id string, od_id long, start long, target long")
    found = {r["od_id"]: r for r in searches.searches(edges, pairs, cells).collect()}
    assert [found[k]["path_found"] for k in range(4)] == [True, True, False, False] and {r["n_nodes"] for r in found.values()} == {10}
    assert found[1]["cost"] == 0.0 and found[1]["n_path_nodes"] == 1
    with pytest.raises(Exception, match="InvalidCostModel"):
        searches.searches(edges.withColumn("weight", -F.col("weight")), pairs).collect()


def test_certificates_name_their_witness(spark):
    cells = cells_of(spark, np.add.outer(np.arange(20) * 0.5, np.zeros(20)))
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells, 10.0), "length"))
    pairs = spark.createDataFrame([("t", 0, 0, 380)], "terrain_id string, od_id long, start long, target long")
    row = searches.certify(pairs, edges, cells, 10.0, 5.0).first()
    assert row["verdict"] == "feasible" and row["witness_i_max_percent"] == pytest.approx(5.0) and row["length_m"] == pytest.approx(190.0) and row["edges_kept"] == row["edges_total"]
    gone = searches.certify(pairs, edges, cells, 10.0, 1.0).first()
    assert gone["verdict"] == "no_way" and not gone["reachable"] and 0 < gone["edge_keep_share"] < 1


def test_searches_read_edges_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(11)
    cells = cells_of(spark, rng.integers(0, 50, (30, 6)), rng.random((30, 6)) > 0.1).filter("valid").unionByName(cells_of(spark, rng.integers(0, 9, (4, 4)), name="small"))
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells), "height_tiebreak"))
    one_way = edges.filter("terrain_id = 't' AND NOT (v = 179 AND u < v)").withColumn("v", F.when(F.col("v") == 7, 999).otherwise(F.col("v")))  # a node that no edge leaves
    pairs = graph.cut_lineage(spark.range(100).selectExpr("IF(id % 9 = 0, 'small', IF(id = 7, 'none', 't')) AS terrain_id", "id AS od_id", "id * 37 % 180 AS start", "IF(id % 7 = 0, 999, id * 61 % 180) AS target"))
    monkeypatch.setattr(searches, "_graph", None)  # no table of a terrain's edges
    monkeypatch.setattr(searches, "PAIRS_A_TASK", 8)
    monkeypatch.setattr(searches, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for own in (edges, one_way):
            found = {r["od_id"]: r for r in searches.searches(own, pairs).collect()}
            local = own.toPandas().sort_values(["terrain_id", "u", "k"], kind="stable")
            assert len(found) == 100 and any(r["path_found"] for r in found.values())
            for od, terrain, start, target in [(r["od_id"], r["terrain_id"], r["start"], r["target"]) for r in pairs.collect()]:
                e, r = local[local["terrain_id"] == terrain], found[od]
                g = search.Graph.of(e["u"].to_numpy(), e["v"].to_numpy(), e["weight"].to_numpy())
                a, b = g.at(start), g.at(target)
                plain = search.dijkstra(g, a, {b} if a >= 0 and b >= 0 else set())
                path = plain.path(b) if a >= 0 and b >= 0 else []
                assert [r[c] for c in ("terrain_id", "path_found", "n_path_nodes", "nodes_expanded", "nodes_pushed", "nodes_reached", "n_nodes", "n_edges")] == [terrain, bool(path), len(path), plain.expanded, plain.pushed, plain.reached, len(g.names), len(e)]
                steps = plain.edges(b) if path else []
                assert [r[c] for c in ("cost", "length_m", "climb_m")] == ([plain.dist[b], e["length_m"].to_numpy()[steps].sum(), e["dh"].abs().to_numpy()[steps].sum()] if path else [None] * 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_graphs_are_read_from_their_arrays(monkeypatch):
    u, v, w = np.array([0, 0, 1, 2]), np.array([1, 2, 3, 3]), np.array([1.0, 2.0, 5.0, 1.0])
    plain = search.dijkstra(search.Graph.of(u, v, w), 0, {3})
    monkeypatch.setattr(search, "LIST_EDGES", 0)
    g = search.Graph.of(u, v, w)
    found = search.dijkstra(g, 0, {3})
    assert all(isinstance(x, memoryview) for x in g.plain)
    assert (found.path(3), found.edges(3), found.expanded, found.pushed, found.reached) == (plain.path(3), plain.edges(3), plain.expanded, plain.pushed, plain.reached) and found.path(3) == [0, 2, 3]


def test_certificates_by_slabs_are_the_searchs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = cells_of(spark, rng.integers(0, 30, (40, 4)))
    edges = graph.cut_lineage(graph.with_cost(graph.grid_edges(cells), lambda dh, metres: metres + F.abs(dh) / 1024 + F.abs(F.hash("u", "v")) / 2.0**45))  # hardly two ways at one price
    pairs = graph.cut_lineage(spark.range(120).selectExpr("'t' AS terrain_id", "id AS od_id", "id * 37 % 160 AS start", "id * 61 % 160 AS target"))
    columns = ["verdict", "reachable", "edges_kept", "edges_total", "straight_m", "length_m", "development", "witness_i_max_percent"]
    plain = {r["od_id"]: r for r in searches.certify(pairs, edges, cells, 1.0, 700.0).collect()}
    monkeypatch.setattr(searches, "paths", None)  # no table of paths
    found = {r["od_id"]: r for r in searches.certify(pairs, edges, cells, 1.0, 700.0, radius=False, search_work=0).collect()}
    assert len(found) == 120 and len({r["verdict"] for r in found.values()}) > 1
    for od, r in plain.items():
        assert [found[od][c] for c in columns[:4]] == [r[c] for c in columns[:4]]
        assert [found[od][c] for c in columns[4:]] == [x if x is None else pytest.approx(x) for x in (r[c] for c in columns[4:])]
    assert found[0]["verdict"] == "feasible" and found[0]["development"] is None and found[0]["length_m"] == 0.0  # both ends are one cell


def test_selection_descriptors(spark):
    labelled = graph.cut_lineage(graph.height_areas(cells_of(spark, BANDS), 1))
    chain = spark.createDataFrame([("t", 0, 0, 0), ("t", 0, 1, 1)], "terrain_id string, od_id long, seq int, area_id long")
    row = graph.describe_selection(chain, chain.select("terrain_id", "od_id", "area_id"), labelled, 10.0).first()
    sizes = {r["area_id"]: r["area_size"] for r in graph.area_table(labelled).collect()}
    assert (row["hops"], row["n_areas"], row["n_cells"], row["narrowest_m"]) == (1, 2, sizes[0] + sizes[1], 20.0)
