"""Hand-computed frames, rediscovery of planted relations, a negative control and leakage."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fablens import fixtures
from fablens.operators import association, audit, bins, derive, interaction, model, ranking, screening
from fablens.plans.queries import ORACLE_SQL, QUERIES
from fablens.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wafers(spark):
    return spark.createDataFrame(fixtures.planted()).cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def norm(frame):
        return sorted(tuple("" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))

    assert norm(got) == norm(want)


def test_ties_nulls_constants(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0, 1.0), (2.0, 1.0, 5.0, 2.0), (2.0, None, 5.0, 2.0), (float("nan"), 3.0, 5.0, 4.0)], "`a.b` double, c double, k double, y double")
    got = rows(association.pearson_summary(df, ["a.b", "c", "k"], "y"), "param")
    assert got["a.b"].n == 3 and math.isclose(got["a.b"].r, 1.0) and got["k"].r is None and got["c"].n == 3
    rho = rows(association.spearman_summary(df, ["a.b", "k"], "y"), "param")
    assert math.isclose(rho["a.b"].rho, 1.0) and rho["k"].rho is None
    missing = rows(audit.missing_values(df), "column")
    assert (missing["a.b"].n_missing, missing["c"].n_missing, missing["y"].n_missing) == (1, 1, 0)
    assert [r["column"] for r in audit.constant_columns(df).collect()] == ["k"]
    flat = bins.histogram(df, "k", 4).collect()
    assert [(r.bin, r.n) for r in flat] == [(0, 4)]
    assert bins.histogram(df.filter("false"), "k").count() == 0
    assert audit.duplicate_rows(df.union(df.limit(1))).first().n_duplicates == 1
    assert audit.duplicate_rows(df.filter("false")).first().n_duplicates == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,)], "x double")
    assert [(r.bin, r.n) for r in bins.histogram(df, "x", 10).orderBy("bin").collect()] == [(0, 1), (1, 1), (9, 2)]


def test_planted_relations(wafers):
    target = "SortingYield"
    d = derive.with_deviation(derive.with_nominal(wafers, "Technology", fixtures.NOMINAL), "GATE2_CD_Gate_Leg_Length", F.col("nominal"), "cd_dev")
    d = derive.with_abs(derive.with_delta(d, "TOPSIN_ET_Gm_max", "FIC_ET_Gm_max", "Delta_Gm"), "GATE2_Ali_Litho_Gate_to_recess_alignment", "Abs_Alignment")
    r = rows(association.pearson_summary(d, ["cd_dev", "TOPSIN_ET_Load_Pull_P.A.E_Last", "Abs_Alignment", "Delta_Gm", "GATE2_Ali_Litho_Gate_to_recess_alignment"], target), "param")
    assert r["cd_dev"].r < -0.1 and r["TOPSIN_ET_Load_Pull_P.A.E_Last"].r > 0.1 and r["Abs_Alignment"].r < -0.1 and r["Delta_Gm"].r > 0.1
    assert abs(r["GATE2_Ali_Litho_Gate_to_recess_alignment"].r) < 0.1
    cut = association.threshold_split(wafers, ["TOPSIN_ET_DC_PIV_Drain_Lag_1"], target).first().cut
    assert 6 < cut < 10.5
    eta = association.eta_squared(wafers, ["GATE2_CD_Gate_Leg_Length"], target, by="Technology").collect()
    assert len(eta) == 3 and all(x.eta2 > 0.05 for x in eta)
    cells = interaction.interaction_strength(wafers, [("OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2"), ("NOISE_1", "NOISE_2")], target).collect()
    assert cells[0].strength > cells[1].strength
    found = association.discovery(wafers, ["TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "NOISE_1", "NOISE_2"], target)
    top = [x.param for x in found.orderBy(F.desc("strength")).limit(2).collect()]
    assert set(top) == {"TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1"}
    assert ranking.insights(found).count() == 4


def test_negative_control(spark):
    calm = spark.createDataFrame(fixtures.planted(effect=0.0))
    noise = [c for c in calm.columns if c.startswith("NOISE_") or c.startswith("TOPSIN")]
    assert all(abs(x.r) < 0.12 for x in association.pearson_summary(calm, noise, "SortingYield").collect())


def test_screening_and_leakage(wafers, tmp_path):
    roles = screening.Roles(target="SortingYield", leakage=tuple(fixtures.LEAKAGE), identifiers=("LotName", "WaferNum"), stages={"TOPSIN_ET_Gm_max": "TOPSIN"}, stage_order=("FIC", "TOPSIN"), predict_at="FIC")
    done = rows(screening.screen(wafers, roles), "column")
    want = {"Actual Sorting Yield (%)": "target_leakage", "LotName": "identifier", "Process": "constant", "Exception": "near_constant", "Technology": "categorical", "TOPSIN_ET_Gm_max": "downstream"}
    assert {c: done[c].reason for c in want} == want
    assert done["SortingYield"].role == "target" and done["NOISE_3"].role == "eligible"
    features = screening.eligible_columns(screening.screen(wafers, roles))
    assert not {"SortingYield", *fixtures.LEAKAGE} & set(features)
    tables.write_features(screening.screen(wafers, roles), str(tmp_path))
    assert tables.read_wafers(wafers.sparkSession, f"{tmp_path}/excluded_features.csv").count() == 7


def test_models(wafers):
    d = model.with_split(wafers, "LotName")
    assert d.groupBy("LotName").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count() == 0
    features = ["GATE2_CD_Gate_Leg_Length", "TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "NOISE_0"]
    fitted = model.fit_additive(d.filter("NOT is_test"), features, "SortingYield")
    score = model.metrics(fitted.predict(d.filter("is_test")), "SortingYield", "prediction").first()
    assert score.r2 > 0.2
    assert fitted.shape_table(wafers.sparkSession).count() == 4 * 16
    rise = rows(model.permutation_importance(fitted.predict, d, features, "SortingYield", "NOISE_1"), "feature")
    assert rise["TOPSIN_ET_DC_PIV_Drain_Lag_1"].rise > rise["NOISE_0"].rise
    held = rows(model.stability(wafers, ["TOPSIN_ET_Load_Pull_P.A.E_Last"], "SortingYield", "LotName"), "param")
    assert held["TOPSIN_ET_Load_Pull_P.A.E_Last"].same_sign


def test_csv_round_trip(wafers, tmp_path):
    tables.write_csv(wafers, str(tmp_path / "w.csv"))
    back = tables.read_wafers(wafers.sparkSession, str(tmp_path / "w.csv"), wafers.schema)
    assert back.count() == 1500 and rows(audit.missing_values(back, ["NOISE_0"]), "column")["NOISE_0"].n_missing == 150


def test_constant_target_and_clashing_names(spark):
    flat = spark.createDataFrame([(float(i), 0.1) for i in range(50)], "x double, y double")
    assert association.eta_squared(flat, ["x"], "y").first().eta2 is None
    assert association.threshold_split(flat, ["x"], "y").count() == 0
    odd = spark.createDataFrame([(float(i), 2.0 * i, "a" if i % 2 else "b", i % 3, i) for i in range(60)], "kept0 double, value double, param string, _n int, copies int")
    assert math.isclose(association.pearson_summary(odd, ["kept0"], "value").first().r, 1.0)
    assert {x.category for x in association.spearman_summary(odd, ["kept0", "_n"], "value", by="param").collect()} == {"a", "b"}
    assert bins.binned(odd, ["kept0"], "value", 4, by="param").count() == 8
    assert audit.duplicate_rows(odd.union(odd)).first().n_duplicates == 60


def test_groups_of_equal_amounts_are_ranked_by_name(spark):
    amounts = [0.1, 0.7, 5748.67, 1e-3, 33.33, 20000.01, 0.2, 1e7 / 3] * 25
    rows = [(f"g{g:02}", x) for g in range(40) for x in (amounts if g % 3 == 0 else amounts[::-1] if g % 3 == 1 else sorted(amounts))]
    df = spark.createDataFrame(rows, "g string, a double").coalesce(1)
    sums = {r.g: r.s for r in df.groupBy("g").agg(F.sum("a").alias("s")).collect()}
    assert len(set(sums.values())) > 1  # the order of a sum shows in its last digits
    found = [r.group for r in ranking.pareto(df, "g", "a").orderBy("rank").collect()]
    assert found == sorted(found)
