"""Searches for windows, subgroups and pairs against plain versions, on planted tables and their negative controls."""

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fablens import fixtures
from fablens.plans import vectors
from fablens.operators import association, audit, bins, derive, interaction, model, ranking, resampling, screening, shapley, subgroups, windows

Y = "SortingYield"


def held(df):
    return df.withColumn("held", F.pmod(F.crc32(F.concat("LotName", F.lit("-"), F.col("WaferNum").cast("string"))), F.lit(3)) == 0)


@pytest.fixture(scope="module")
def wafers(spark):
    return held(spark.createDataFrame(fixtures.planted())).cache()


def plain_window(x, y, min_share):
    """The best interval of distinct values, by trying all."""
    y, best = y - y.mean(), None
    y = y - y.mean()
    values, n = np.unique(x), len(x)
    least = max(1, math.ceil(min_share * n))
    for i, lo in enumerate(values):
        for hi in values[i:]:
            inside = (x >= lo) & (x <= hi)
            m = inside.sum()
            if least <= m <= n - least:
                gain = round(y[inside].sum() ** 2 * n / m / (n - m) / (y**2).sum(), 9)
                if best is None or gain > best[0]:
                    best = (gain, lo, hi, m)
    return best


def test_windows_equal_a_plain_search(spark):
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"c": r.choice(["a", "b"], 400), "x": r.integers(0, 30, 400).astype(float), "z": np.round(r.normal(0, 1, 400), 1), "flat": 1.0})
    frame["y"] = np.where((frame.x > 8) & (frame.x < 15), 2.0, 0.0) + r.normal(0, 1, 400) + 1e7
    frame.loc[::50, "x"], frame.loc[1::50, "z"] = np.nan, np.inf
    got = windows.process_windows(spark.createDataFrame(frame), ["x", "z", "flat"], "y", "c", cells=200, min_share=0.02).collect()
    assert len(got) == 4
    for g in got:
        own = frame[frame.c == g.category].replace(np.inf, np.nan).dropna(subset=[g.param])
        gain, lo, hi, m = plain_window(own[g.param].to_numpy(), own.y.to_numpy(), 0.02)
        assert abs(g.gain - gain) < 1e-8, (g, gain, lo, hi, m)
        assert (g.lo, g.hi, g.n_in, g.n) == (lo, hi, m, len(own)) and abs(g.gain - gain) < 1e-8 and g.z is None and g.found is None
    assert {(g.lo, g.hi) for g in got if g.param == "x"} == {(9.0, 14.0)}


def test_windows_of_many_values(spark):
    """More distinct values than cells: the second search comes as close to the best as two searches of equal steps can."""
    r = np.random.default_rng(5)
    x = r.uniform(0, 100, 3000)
    frame = pd.DataFrame({"x": x, "y": np.where((x > 31.7) & (x < 58.2), 1.0, 0.0) + r.normal(0, 0.5, 3000)})
    g = windows.process_windows(spark.createDataFrame(frame), ["x"], "y", cells=64).first()
    exact = windows.process_windows(spark.createDataFrame(frame), ["x"], "y", cells=4000).first()
    assert abs(g.lo - 31.7) < 0.3 and abs(g.hi - 58.2) < 0.3 and exact.gain >= g.gain > 0.98 * exact.gain and g.side == "window"


def test_planted_windows_are_found(spark, wafers):
    cd = "GATE2_CD_Gate_Leg_Length"
    got = windows.process_windows(wafers, [cd, "NOISE_1", "NOISE_3"], Y, "Technology", "held").collect()
    found = {g.category: g for g in got if g.found}
    assert set(found) == set(fixtures.NOMINAL) and all(g.param == cd and g.side == "window" and g.mean_in > g.mean_out for g in found.values())
    for g in found.values():  # the middle lies within one of ten bins of the nominal length
        assert abs((g.lo + g.hi) / 2 - fixtures.NOMINAL[g.category]) < 0.006 and g.held_gain > 0.05
    drain = windows.process_windows(wafers, ["TOPSIN_ET_DC_PIV_Drain_Lag_1"], Y, held="held").first()
    assert drain.found and drain.side in ("low", "high")
    calm = held(spark.createDataFrame(fixtures.planted(effect=0.0)))
    assert not [g for g in windows.process_windows(calm, [cd, "NOISE_1", "NOISE_3"], Y, "Technology", "held").collect() if g.found]
    assert windows.process_windows(calm.filter("false"), [cd], Y, "Technology", "held").count() == 0


@pytest.mark.parametrize("offset", [0.0, 1e8, 1.7e9])
def test_a_target_may_lie_anywhere(spark, offset):
    r = np.random.default_rng(6)
    x = r.uniform(0, 10, 2000)
    noise = r.normal(0, 1, 2000)
    y = np.round(np.where(x > 5, 3.0, 0.0) + noise, 3)
    df = spark.createDataFrame(pd.DataFrame({"x": np.round(x, 1), "y": y + offset}))
    eta, split = association.eta_squared(df, ["x"], "y").first().eta2, association.threshold_split(df, ["x"], "y").first()
    want = np.corrcoef(np.round(x, 1) > 5, y)[0, 1] ** 2
    assert abs(eta - 0.69) < 0.02 and split.cut == 5.0 and abs(split.gain - want) < 1e-5 and abs(split.mean_high - split.mean_low - 3) < 0.2
    assert abs(split.mean_low - offset) < 0.2
    w = windows.process_windows(df, ["x"], "y").first()
    assert abs(w.gain - want) < 1e-5 and (w.side, w.lo, w.hi) in (("low", 0.0, 5.0), ("high", 5.1, 10.0))


def test_infinite_values_are_missing(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(10)] + [(float("inf"), 3.0), (float("-inf"), 4.0), (5.0, float("inf")), (float("nan"), 1.0)], "x double, y double")
    assert [(h.bin, h.lo, h.n) for h in bins.histogram(df, "x", 2).orderBy("bin").collect()] == [(0, 0.0, 5), (1, 4.5, 6)]
    line = association.pearson_summary(df, ["x"], "y").first()
    assert line.n == 10 and math.isclose(line.r, 1.0)
    assert math.isclose(association.eta_squared(df, ["x"], "y", 10).first().eta2, 1.0)


# the additive model


def plain_bins(x, k):
    """0..k-1, -1 for a missing value."""
    lo, hi = np.nanmin(x), np.nanmax(x)
    b = np.zeros(len(x)) if lo == hi else np.clip(np.floor((x - lo) / ((hi - lo) / k)), 0, k - 1)
    return np.where(np.isnan(x), -1, b).astype(int)


def plain_additive(frame, features, target, k):
    """Fitted values by cyclic steps over the features until nothing changes."""
    y = frame[target].to_numpy(float)
    left = y - y.mean()
    binned = [plain_bins(frame[c].to_numpy(float), k) for c in features]
    for _ in range(200):
        for b in binned:
            ok = b >= 0
            n = np.bincount(b[ok], minlength=k)
            left[ok] -= (np.bincount(b[ok], left[ok], minlength=k) / np.maximum(n, 1))[b[ok]]
    return y - left


def test_additive_model_equals_a_plain_fit(spark):
    frame = fixtures.planted()
    features = ["GATE2_CD_Gate_Leg_Length", "TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "NOISE_0", "FIC_ET_Gm_max"]
    df = spark.createDataFrame(frame[[*features, Y]]).cache()
    fitted = model.fit_additive(df, features, Y, focus=0.0, noise=0.0, least=1e-12)
    want = plain_additive(frame, features, Y, 16)
    rows = fitted.predict(df).withColumn("sum", sum((fitted.contribution(c) for c in features), F.lit(fitted.intercept))).toPandas()
    order = {v: i for i, v in enumerate(frame[Y])}
    want = want[[order[v] for v in rows[Y]]]
    assert np.abs(rows.prediction - want).max() < 1e-3 and np.abs(rows["sum"] - rows.prediction).max() < 1e-9
    one = model.fit_additive(df, features[1:3], Y)
    again = model.fit_additive(df.repartition(7), features[1:3], Y)
    assert np.allclose(one.shapes, again.shapes) and one.shape_table(spark).count() == 32
    flat = model.fit_additive(df.withColumn(Y, F.lit(3.0)), features, Y)
    assert flat.intercept == 3.0 and not np.any(flat.shapes)
    assert model.fit_additive(df.filter("false"), features, Y).intercept == 0.0


def test_additive_model_of_a_wide_table(spark, tmp_path):
    """1500 x 1430: a few thousand numbers a round come to the driver, and the planted features weigh most."""
    fixtures.planted(noise_columns=1415).to_parquet(tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    features = [c for c in df.columns if c.startswith(("NOISE", "TOPSIN", "GATE2", "SIN_", "OHMIC", "FIC"))]
    fitted = model.fit_additive(df, features, Y, k=8, rounds=6, focus=0.5)
    used = [i for i, t in enumerate(fitted.shapes) if any(t)]
    assert len(features) == 1424 and len(used) < 200
    weights = df.agg(*[F.avg(F.abs(fitted.contribution(features[i]))).alias(f"w{i}") for i in used]).first()
    top = sorted(used, key=lambda i: -weights[f"w{i}"])[:2]
    assert {"TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1"} == {features[i] for i in top}


# subgroups


def deviations(df):
    d = derive.with_deviation(derive.with_nominal(df, "Technology", fixtures.NOMINAL), "GATE2_CD_Gate_Leg_Length", F.col("nominal"), "cd_dev")
    return derive.with_deviation(d, "SIN_Thickness_SiN_Thickness", 0.150, "sin_dev")


EIGHT = ["cd_dev", "sin_dev", "OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "TOPSIN_ET_Load_Pull_P.A.E_Last", "NOISE_0", "NOISE_2"]


def plain_subgroups(frame, params, target, k, depth, min_n):
    """The best ranges of every set of parameters: {params: (quality, n, ranges as bins, mean)}."""
    y = frame[target].to_numpy()
    d = y - y.mean()
    binned = {p: plain_bins(frame[p].to_numpy(float), k) for p in params}
    spans = [(a, z) for a in range(k) for z in range(a, k) if z - a < k - 1]
    inside = {(p, s): (binned[p] >= s[0]) & (binned[p] <= s[1]) for p in params for s in spans}
    out = {}
    for size in range(1, depth + 1):
        for ps in combinations(params, size):
            for box in product(spans, repeat=size):
                rows = np.logical_and.reduce([inside[p, s] for p, s in zip(ps, box, strict=True)])
                n = int(rows.sum())
                if n >= min_n:
                    q = round(abs(d[rows].sum()) / math.sqrt(n), 6)
                    if ps not in out or (-q, n, box) < (-out[ps][0], out[ps][1], out[ps][2]):
                        out[ps] = (q, n, box, y[rows].mean())
    return out


@pytest.mark.parametrize(("depth", "k", "top"), [(2, 4, 100), (2, 5, 7), (3, 3, 12)])
def test_subgroups_equal_a_plain_search(spark, wafers, depth, k, top):
    d = deviations(wafers).cache()
    got = subgroups.subgroups(d, EIGHT, Y, k=k, depth=depth, top=top, min_n=25).orderBy("rank").collect()
    frame = d.select(*[F.col(f"`{c}`") for c in EIGHT], Y).toPandas()
    want = plain_subgroups(frame, EIGHT, Y, k, depth, 25)
    ranked = sorted(want.items(), key=lambda x: -x[1][0])[:top]
    assert len(got) == len(ranked) and [g["rank"] for g in got] == list(range(1, len(got) + 1))
    for g, (_, best) in zip(got, ranked, strict=True):
        assert abs(g.quality - best[0]) < 1e-5
    for g in got:
        q, n, box, mean = want[tuple(g.params)]
        lo, hi = frame[g.params].min(), frame[g.params].max()
        ends = [(lo[p] + (hi[p] - lo[p]) / k * a, lo[p] + (hi[p] - lo[p]) / k * (z + 1)) for p, (a, z) in zip(g.params, box, strict=True)]
        assert g.n == n and abs(g["mean"] - mean) < 1e-6 and np.allclose([(r.lo, r.hi) for r in g.ranges], ends)


def test_planted_combinations_are_found(spark, wafers):
    """What main effects leave shows the two planted combinations first, with their ranges; the negative control shows none."""
    d = deviations(wafers).cache()
    residual = model.fit_additive(d, EIGHT, Y).predict(d).withColumn("residual", F.col(Y) - F.col("prediction"))
    two = [g for g in subgroups.subgroups(residual, EIGHT, "residual", top=36).orderBy("rank").collect() if len(g.params) == 2][:2]
    assert {tuple(g.params) for g in two} == {("OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2"), ("cd_dev", "sin_dev")}
    rc = next(g for g in two if g.params[0].startswith("OHMIC"))
    assert all(r.hi > r.lo for r in rc.ranges) and abs(rc.excess) > 0.3
    assert subgroups.subgroups(d.withColumn(Y, F.lit(1.0)), EIGHT[:3], Y).count() == 0
    assert subgroups.subgroups(d.filter("false"), EIGHT[:3], Y).count() == 0


# pairs


def plain_cuts(frame, params, target, k, min_n):
    """{(x, y): (gain, cut_x, cut_y)} by trying every cut of every pair."""
    t = frame[target].to_numpy(float)
    t = t - t.mean()
    binned, out = {p: plain_bins(frame[p].to_numpy(float), k) for p in params}, {}
    for x, y in combinations(params, 2):
        ok = (binned[x] >= 0) & (binned[y] >= 0)
        a, b, d = binned[x][ok], binned[y][ok], t[ok]
        total = ((d - d.mean()) ** 2).sum()
        for i in range(k - 1):
            for j in range(k - 1):
                parts = [d[(a <= i) == u, ...][((b <= j) == v)[(a <= i) == u]] for u in (True, False) for v in (True, False)]
                if min(map(len, parts)) >= min_n:
                    gain = sum(p.sum() ** 2 / len(p) for p in parts) - d.sum() ** 2 / len(d)
                    ends = [np.nanmin(frame[c]) + (np.nanmax(frame[c]) - np.nanmin(frame[c])) / k * (v + 1) for c, v in ((x, i), (y, j))]
                    if (x, y) not in out or gain / total > out[x, y][0] + 1e-9:
                        out[x, y] = (gain / total, *ends)
    return out


def test_pair_cuts_equal_a_plain_search(spark, wafers):
    params = ["OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2", "NOISE_0", "NOISE_3", "TOPSIN_ET_DC_PIV_Drain_Lag_1"]
    got = {(r.x, r.y): r for r in interaction.pair_cuts(wafers, params, Y, k=6).collect()}
    want = plain_cuts(wafers.select(*params, Y).toPandas(), params, Y, 6, 5)
    assert got.keys() == want.keys() and sorted(r["rank"] for r in got.values()) == list(range(1, 11))
    for pair, (gain, cut_x, cut_y) in want.items():
        assert abs(got[pair].gain - gain) < 1e-7 and math.isclose(got[pair].cut_x, cut_x, abs_tol=1e-9) and math.isclose(got[pair].cut_y, cut_y, abs_tol=1e-9)
    assert interaction.pair_cuts(wafers.withColumn(Y, F.lit(2.0)), params, Y).count() == 0
    assert interaction.pair_cuts(wafers.filter("false"), params, Y).count() == 0


def test_planted_pairs_rank_first_of_a_thousand(spark, wafers):
    d = deviations(wafers)
    params = [*EIGHT[:6], *[f"NOISE_{i}" for i in range(40)]]
    top = interaction.interaction_pairs(d, params, Y).filter("rank <= 2 OR rank = 1035").collect()
    first = {(r.x, r.y): r for r in top if r["rank"] <= 2}
    assert len(top) == 3 and set(first) == {("OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2"), ("cd_dev", "sin_dev")}
    assert all(r.contrast < 0 for r in first.values())
    few = interaction.interaction_pairs(d, params, Y, among=6).count()
    assert few == 15


# attributions


def test_shapley_values_equal_enumeration(spark):
    r = np.random.default_rng(3)
    names = ["a", "b.c", "d e", "f", "g", "h"]
    frame = pd.DataFrame(np.round(r.normal(0, 1, (400, 6)), 2), columns=names)
    frame["y"] = 2 * frame["a"] + frame["a"] * frame["b.c"] + np.maximum(0, frame["d e"]) + r.normal(0, 0.1, 400)
    df = spark.createDataFrame(frame)
    fitted = model.fit_trees(df, names, "y")
    rows = shapley.tree_shapley(fitted, df, names).toPandas()
    phi = np.vstack(rows.attributions)
    assert len(rows) == 400 and np.abs(phi.sum(axis=1) + rows.expected - rows.prediction).max() < 1e-9
    found = shapley.leaves(fitted[1])

    def value(x, known):
        return sum(v * np.prod([float(above < x[f] <= upto) if f in known else share for f, above, upto, share in path]) for v, path in found)

    for i in (0, 17):
        x = rows[names].to_numpy()[i]
        sets = {s: value(x, s) for n in range(7) for s in combinations(range(6), n)}
        for f in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (sets[tuple(sorted((*s, f)))] - v) for s, v in sets.items() if f not in s)
            assert math.isclose(phi[i, f], want, abs_tol=1e-9)
    summary = {r.feature: r for r in shapley.attribution_summary(fitted, df, names).collect()}
    assert set(summary) == set(names) and summary["a"].mean_size == max(s.mean_size for s in summary.values()) and summary["h"].mean_size < 0.1
    assert shapley.tree_shapley(fitted, df.filter("false"), names).count() == 0
    # tasks add up their rows' values: no row a value is made, and none of an empty table
    summed = shapley.attribution_summary(fitted, df, names)
    assert "Generate" not in summed._jdf.queryExecution().executedPlan().toString()
    assert shapley.attribution_summary(fitted, df.filter("false"), names).count() == 0


def test_tabled_trees_equal_their_leaves():
    """A tree's table against its leaves, at and around its thresholds; lookups leave a step a feature, not one a leaf and pair."""
    inf = np.inf
    tree = [(2.0, [(3, -inf, 0.5, 0.4), (1, -inf, 2.0, 0.5)]), (-1.0, [(3, -inf, 0.5, 0.4), (1, 2.0, inf, 0.5)]), (3.0, [(3, 0.5, 0.75, 0.2)]), (5.0, [(3, 0.75, inf, 0.4)])]
    r = np.random.default_rng(2)
    rows = np.concatenate([r.normal(0, 2, (50, 5)), np.tile([[2.0], [0.5], [0.75]], (1, 5)), [[0, 2.0, 0, 0.5, 0]]])
    used, table = shapley.tabled(tree)
    assert [(f, step) for f, _, step in used] == [(1, 3), (3, 1)] and table.shape == (6, 2)
    got = np.zeros(rows.shape)
    cell = sum(step * np.searchsorted(cuts, rows[:, f]) for f, cuts, step in used)
    got[:, [1, 3]] = table[cell]
    assert np.allclose(got, shapley.contributions(tree, rows))
    assert shapley.tabled([(1.0, [])])[1].shape == (1, 0)


def test_trees_predict_unseen_rows(spark, wafers):
    """Held-out lots of the planted table; the negative control has nothing to predict."""
    features = [*EIGHT[:6], "NOISE_1", "NOISE_2"]
    for effect, good in ((1.0, True), (0.0, False)):
        d = model.with_split(deviations(spark.createDataFrame(fixtures.planted(effect=effect))), "LotName").cache()
        fitted = model.fit_trees(d.filter("NOT is_test"), features, Y)
        score = model.metrics(model.predict_trees(fitted, d.filter("is_test"), features), Y, "prediction").first()
        assert (score.r2 > 0.5) == good and (good or score.r2 < 0.1)


def test_permutation_importance_is_the_same_in_any_order(spark, monkeypatch):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"k": r.integers(0, 20, 300), "x": np.round(r.normal(0, 1, 300), 1), "z": np.round(r.normal(0, 1, 300), 1)})
    frame["y"] = 3 * frame.x + r.normal(0, 0.1, 300)
    df = spark.createDataFrame(pd.concat([frame, frame[:30]]))
    fitted = model.fit_additive(df, ["x", "z"], "y", k=8)
    for dealt in (1000, 60):
        monkeypatch.setattr(model, "DEALT", dealt)
        one, two = (sorted((v.feature, round(v.rise, 9)) for v in model.permutation_importance(fitted.predict, df.repartition(n), ["x", "z"], "y", "k").collect()) for n in (3, 17))
        assert one == two and dict(one)["x"] > 5 > 0.5 > dict(one)["z"]


def test_permutation_importance_deals_all_features_at_once(spark):
    df = spark.range(60).selectExpr("id AS k", "id % 7 AS x", "id % 5 AS z", "id % 3 AS v", "1.0D * (id % 7) AS y")
    found = model.permutation_importance(lambda d: d.withColumn("prediction", F.col("x") + 0 * (F.col("z") + F.col("v"))), df, ["x", "z", "v"], "y", "k")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # one a feature before
    rise = {r.feature: r.rise for r in found.collect()}
    assert rise["x"] > 1 and rise["z"] == rise["v"] == 0


# resampling


def test_poisson_weights(spark):
    w = spark.range(4000).select(F.col("id").cast("string").alias("k")).select(F.posexplode(resampling.poisson_weights(5, 1)("k")).alias("d", "w")).toPandas()
    shares = w.w.value_counts(normalize=True)
    assert abs(w.w.mean() - 1) < 0.03 and abs(w.w.var() - 1) < 0.06 and all(abs(shares[n] - math.exp(-1) / math.factorial(n)) < 0.015 for n in range(4))


def test_stable_parameters_are_selected(spark, wafers):
    d = derive.with_abs(derive.with_delta(deviations(wafers), "TOPSIN_ET_Gm_max", "FIC_ET_Gm_max", "Delta_Gm"), "GATE2_Ali_Litho_Gate_to_recess_alignment", "Abs_Alignment")
    d = d.withColumn("wafer", F.concat_ws("-", "LotName", "WaferNum"))
    planted = ["cd_dev", "TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "Abs_Alignment"]
    params = [*planted, *[f"NOISE_{i}" for i in range(20)]]
    select = lambda df, seed=0: {(r.param, r.measure): r for r in resampling.stability_selection(df, params, Y, "wafer", top=4, draws=40, seed=seed).collect()}
    got = select(d)
    assert len(got) == 2 * len(params)
    for (param, measure), r in got.items():
        assert r.frequency > 0.9 if param in planted else r.frequency < 0.2
        assert r.same_sign is None if measure == "eta2" else r.same_sign or param not in planted
    again, other = select(d.repartition(5)), select(d, 1)
    assert all(math.isclose(again[k].mean, got[k].mean, abs_tol=1e-12) and again[k].frequency == got[k].frequency for k in got)
    assert any(other[k].mean != got[k].mean for k in got)
    flat = resampling.stability_selection(d.withColumn(Y, F.lit(1.0)), params[:2], Y, "wafer", top=1, draws=3)
    assert flat.count() == 0 and resampling.stability_selection(d.filter("false"), params[:2], Y, "wafer", top=1, draws=3).count() == 0


def test_error_rate_over_all_parameters(spark, wafers):
    """200 negative controls of 12 related parameters each: a false finding in about one of twenty; planted ones are found."""
    r = np.random.default_rng(12)
    n, m = 50, 12
    frame = pd.DataFrame(r.normal(0, 1, (200 * n, m)), columns=[f"x{i}" for i in range(m)])
    frame["x1"] = frame.x0 + 0.3 * frame.x1
    frame["c"], frame["k"], frame["y"] = np.repeat(np.arange(200), n), np.arange(200 * n), r.exponential(1, 200 * n)
    calm = resampling.max_statistic_test(spark.createDataFrame(frame), [f"x{i}" for i in range(m)], "y", "k", draws=99, by="c").toPandas()
    assert len(calm) == 200 * m and (calm.p_adjusted >= calm.p_single).all()
    false = calm[calm.p_adjusted <= 0.05].category.nunique() / 200
    assert false <= 0.08 and abs((calm.p_single <= 0.05).mean() - 0.05) < 0.02
    d = wafers.withColumn("wafer", F.concat_ws("-", "LotName", "WaferNum"))
    params = ["TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", *[f"NOISE_{i}" for i in range(30)]]
    found = {x.param for x in resampling.max_statistic_test(d, params, Y, "wafer").filter("p_adjusted <= 0.05").collect()}
    assert set(params[:2]) <= found and len(found) <= 3
    one, two = (sorted(map(tuple, resampling.max_statistic_test(d.repartition(p), params[:4], Y, "wafer", draws=19).select("param", "p_adjusted").collect())) for p in (2, 9))
    assert one == two


def test_resampling_moves_sums_only(spark, wafers):
    """No row is shuffled with its draws, and tasks' weights are poisson_weights'."""
    d = wafers.withColumn("wafer", F.concat_ws("-", "LotName", "WaferNum"))
    for op in (lambda: resampling.stability_selection(d, ["NOISE_0", "NOISE_1"], Y, "wafer", top=1, draws=5), lambda: resampling.max_statistic_test(d, ["NOISE_0", "NOISE_1"], Y, "wafer", draws=9)):
        plan = op()._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "xxhash64" not in plan[: plan.index("MapInArrow")]
    u = spark.range(500).select(F.col("id").cast("string").alias("k")).select(resampling.hashes(20, 3)("k").alias("u"), resampling.poisson_weights(20, 3)("k").alias("w")).toPandas()
    assert (np.searchsorted(resampling.poisson_steps(), np.stack(u.u) & (1 << 40) - 1, "right") == np.stack(u.w)).all()


# leakage and three-way effects


def test_columns_that_leak_the_target_are_candidates(spark):
    """Six copies of the target under other names; none of the planted causes, and nothing is excluded."""
    r = np.random.default_rng(2)
    frame = fixtures.planted().drop(columns=["Actual Sorting Yield (%)"])
    y = frame[Y]
    leaks = {"other a.b": y + r.normal(0, 0.1, len(y)), "Loss %": 100 - y, "coarse": y.round(0), "bent": np.exp(y / 20), "grade": "g" + (y // 0.5).astype(int).astype(str), "late": y.where(r.random(len(y)) < 0.9)}
    df = spark.createDataFrame(frame.assign(**leaks))
    found = {x.column: x for x in screening.leakage_candidates(df, Y).collect()}
    assert set(found) == set(leaks) and found["grade"].rho is None and "values fix" in found["grade"].evidence and "ranks" in found["Loss %"].evidence
    assert screening.leakage_candidates(df.filter("false"), Y).count() == 0 and screening.leakage_candidates(df, Y, []).count() == 0


def test_three_way_effects(spark):
    r = np.random.default_rng(9)
    x = r.beta(2, 5, (6000, 3))
    b = [plain_bins(x[:, i], 3) for i in range(3)]
    two = 5.0 * b[0] + b[0] * b[1] - 2 * b[1] * b[2] + 1e3
    frame = pd.DataFrame(x, columns=["a", "b.c", "d"])
    frame["flat"], frame["deep"] = two, two + 4.0 * ((b[0] == 1) & (b[1] == 1) & (b[2] == 1))
    df = spark.createDataFrame(frame)
    triples = [("a", "b.c", "d"), ("d", "a", "b.c")]
    flat = interaction.three_way_effects(df, triples, "flat").collect()
    assert len(flat) > 40 and all(abs(c.excess) < 1e-6 for c in flat if not c.low_support) and all(c.excess is None for c in flat if c.low_support)
    deep = interaction.three_way_effects(df, triples[:1], "deep").toPandas()
    # the plain answer: the weighted residual of cell means on all two-way dummies
    d = deep[~deep.low_support]
    columns = [(d[p] == i) & (d[q] == j) for p, q in (("xbin", "ybin"), ("xbin", "zbin"), ("ybin", "zbin")) for i in range(3) for j in range(3)]
    design, w = np.array(columns, float).T, np.sqrt(d.n.to_numpy())
    fit = design @ np.linalg.lstsq(design * w[:, None], d.mean_y.to_numpy() * w, rcond=None)[0]
    assert np.abs(d.mean_y - fit - d.excess).max() < 1e-6 and d.excess.abs().max() > 0.3
    assert interaction.three_way_effects(df, [], "deep").count() == 0


def test_insights_name_ranges_and_combinations(spark, wafers):
    params = ["TOPSIN_ET_DC_PIV_Drain_Lag_1", "TOPSIN_ET_Load_Pull_P.A.E_Last", "NOISE_1"]
    found = association.discovery(wafers, params, Y)
    got = {x.param: x for x in ranking.insights(found, {params[0]: "TOPSIN"}, windows.process_windows(wafers, params, Y, held="held")).collect()}
    drain, pae, noise = (got[p] for p in params)
    assert drain.stage == "TOPSIN" and drain.best_lo is None and 5 < drain.best_hi < 10 and "best up to" in drain.text
    assert pae.best_lo is not None and pae.best_hi is None and "best from" in pae.text
    assert noise.best_lo is None and noise.best_hi is None and "best" not in noise.text
    both = ranking.combination_insights(subgroups.subgroups(deviations(wafers), EIGHT, Y, top=30), {"sin_dev": "SIN"}).collect()
    pair = next(x for x in both if x.params == ["cd_dev", "sin_dev"])
    assert pair.stages == [None, "SIN"] and pair.direction == "lower" and "cd_dev in [" in pair.text


def test_running_sums_in_ranges(spark, monkeypatch):
    """The same sums for any number of ranges, for far-out values, ties of keys and an empty table."""
    r = np.random.default_rng(7)
    x = np.unique(np.concatenate([r.normal(0, 1, 300), [1e9, -1e12]]))
    frame = pd.DataFrame({"c": np.repeat(["a", "b"], len(x)), "x": np.tile(x, 2), "n": r.integers(1, 9, 2 * len(x))})
    df = spark.createDataFrame(frame)
    for parts in (1, 7, 64):
        monkeypatch.setattr(bins, "PARTS", parts)
        got = bins.running_sums(df, ["c"], "x", {"upto": "n"}, {"all": "n"}).toPandas().sort_values(["c", "x"])
        assert (got.upto.to_numpy() == frame.groupby("c").n.cumsum().to_numpy()).all() and got["all"].nunique() <= 2
    assert bins.running_sums(df.filter("false"), ["c"], "x", {"upto": "n"}).count() == 0


def test_exact_quantiles(spark):
    r = np.random.default_rng(13)
    frame = pd.DataFrame({"c": r.choice(["a", "b", None], 500), "y": np.round(r.standard_cauchy(500), 1)})
    frame.loc[::40, "y"] = np.nan
    df = spark.createDataFrame(frame)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {x.c: x.q for x in bins.quantiles(df.filter("c IS NOT NULL AND NOT isnan(y)"), ["c"], "y", shares).collect()}
    for c in ("a", "b"):
        assert np.allclose(got[c], np.nanquantile(frame[frame.c == c].y, shares))
    medians = {x.category: x.median for x in bins.summary_by(df, "c", "y").collect()}
    assert set(medians) == {"a", "b", None} and all(math.isclose(v, np.nanmedian(frame[frame.c.isna() if c is None else frame.c == c].y)) for c, v in medians.items())
    stats = audit.target_stats(df, "y").first()
    assert (stats.n, stats.n_missing) == (frame.y.notna().sum(), frame.y.isna().sum()) and np.allclose([stats.q1, stats.median, stats.q3], np.nanquantile(frame.y, [0.25, 0.5, 0.75]))
    none = audit.target_stats(df.filter("false"), "y").first()
    assert none.n == 0 and none.median is None and bins.box_stats(df.filter("false"), "y").count() == 0


@pytest.mark.parametrize("op", ["eta_squared", "threshold_split", "binned", "distributions", "process_windows"])
def test_rows_are_not_shuffled_by_parameter(spark, wafers, op):
    """Tables of a row a parameter are broadcast: a join by so few keys has all rows of a parameter in one task."""
    args = {"distributions": ()}.get(op, (Y,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        module = bins if op in ("binned", "distributions") else windows if op == "process_windows" else association
        plan = getattr(module, op)(wafers, ["NOISE_0", "NOISE_1"], *args)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and (op == "process_windows" or "SortMergeJoin" not in plan)
    assert plan.count("SortMergeJoin") <= 2  # of windows' own rows


def test_the_mean_comes_with_the_edges(spark, monkeypatch):
    rows = spark.createDataFrame([(1.0, None, 2.0), (3.0, 5.0, 4.0), (None, None, 9.0), (2.0, 1.0, None)], "a double, b double, y double")
    edges = vectors.fit_edges(rows, ["a", "b"], 4, "y")
    assert edges.mean == 5.0 and (edges.lo, edges.hi) == ([1.0, 1.0], [3.0, 5.0])
    monkeypatch.setattr(type(rows), "agg", None)  # no other pass
    centred, mean = vectors.vector_form(rows, edges, "y")
    assert mean == 5.0 and sorted(r.y for r in centred.collect()) == [-3.0, -1.0, 4.0]
