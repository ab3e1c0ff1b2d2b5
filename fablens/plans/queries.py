"""The registered queries of the analysis operators over the test tables, and the SQL that each must equal.

Units are line items with their part and order (``sources.tables.read_units``); the target is l_extendedprice, the category
p_type. They stand in for wafers, yield and technology and test arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, audit, bins, derive, interaction, model, ranking, resampling, screening, shapley, subgroups, windows
from ..sources.tables import read_units

Y, CAT = "l_extendedprice", "p_type"
PARAMS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
U = "u AS (SELECT l.*, p.*, o.* FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN orders o ON l_orderkey = o_orderkey)"
ROLES = screening.Roles(target=Y, leakage=("o_totalprice",), identifiers=("l_orderkey", "o_orderkey", "l_partkey", "p_partkey", "l_suppkey", "o_custkey", "p_name"), metadata=("l_shipdate", "o_orderdate"), stages={"l_returnflag": "return"}, stage_order=("order", "return"), predict_at="order")
UNIT_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_COLUMNS = UNIT_COLUMNS[:11]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def off_tie(digits: int) -> float:
    """A little more than nothing: means of few values often lie just between two roundings, where the engines' last digits
    would decide."""
    return float(f"3.7e-{digits + 4}")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last digits; 0.0 for -0.0."""
    return df.select(*[(F.round(F.col(c) + off_tie(own.get(c, digits)), own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + {off_tie(digits)}, {digits}) + 0.0"


def long_sql(params: list[str] = PARAMS, by: str | None = None, source: str = "u", y: str = Y) -> str:
    key = f"{by} AS category, " if by else ""  # by may begin with other columns
    return " UNION ALL ".join(f"SELECT {key}'{p}' AS param, CAST({p} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}" for p in params)


def bin_sql(x: str, lo: str, hi: str, k: int) -> str:
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({x} - {lo}) / (({hi} - {lo}) / {float(k)})), {k - 1}) END AS BIGINT)"


def corr_sql(x: str = "x", y: str = "y") -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def crc_sql(t: str) -> str:
    """crc32 of an ASCII string, a bit at a time."""
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length({t}) + 1), lambda place: ascii(substr({t}, place, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"


def line(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


# audit


@query("audit_dimensions", f"SELECT count(*) AS n_rows, CAST({len(LINE_COLUMNS)} AS BIGINT) AS n_cols FROM lineitem")
def _(spark, d):
    return audit.dimensions(line(spark, d))


@query("audit_target_exists", "SELECT true AS target, false AS other")
def _(spark, d):
    df = line(spark, d)
    return spark.range(1).select(F.lit(audit.target_exists(df, Y)).alias("target"), F.lit(audit.target_exists(df, "SortingYield")).alias("other"))


@query("audit_target_stats", f"SELECT count({Y}) AS n, count(*) - count({Y}) AS n_missing, {r(f'avg({Y})', 3)} AS mean, {r(f'stddev_samp({Y})', 3)} AS std, min({Y}) AS min, {r(f'quantile_cont({Y}, 0.25)', 3)} AS q1, {r(f'quantile_cont({Y}, 0.5)', 3)} AS median, {r(f'quantile_cont({Y}, 0.75)', 3)} AS q3, max({Y}) AS max FROM lineitem")
def _(spark, d):
    return rounded(audit.target_stats(line(spark, d), Y), 3)


def _per_column(select: str, columns: list[str] = LINE_COLUMNS, source: str = "lineitem") -> str:
    return " UNION ALL ".join(select.format(c=c, t=source) for c in columns)


SHARES = "SELECT '{c}' AS \"column\", coalesce(sum(n), 0) AS n, count(*) AS n_distinct, coalesce(max(n), 0) AS top_n FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"


@query("audit_missing", _per_column("SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*) AS share FROM {t}"))
def _(spark, d):
    return audit.missing_values(line(spark, d))


@query("audit_duplicates", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY " + ", ".join(LINE_COLUMNS) + ")")
def _(spark, d):
    return audit.duplicate_rows(line(spark, d))


@query("audit_constant", "SELECT 'one' AS \"column\", CAST(1 AS BIGINT) AS n_distinct WHERE (SELECT count(*) FROM lineitem) > 0")
def _(spark, d):
    return audit.constant_columns(line(spark, d).withColumn("one", F.lit("x")))


@query("audit_near_constant", f"WITH s AS ({_per_column(SHARES, ['l_returnflag', 'l_linestatus', 'l_tax'])}) SELECT \"column\", n_distinct, {r('top_n / n')} AS top_share FROM s WHERE top_n / n >= 0.3")
def _(spark, d):
    return rounded(audit.near_constant_columns(line(spark, d), ["l_returnflag", "l_linestatus", "l_tax"], 0.3))


@query("audit_kinds", "SELECT * FROM (VALUES ('numeric', CAST(8 AS BIGINT)), ('non_numeric', CAST(3 AS BIGINT))) AS t(kind, n)")
def _(spark, d):
    return audit.kind_counts(line(spark, d))


@query("audit_leakage", "SELECT 'l_tax' AS \"column\"")
def _(spark, d):
    return audit.leakage_columns(line(spark, d), ["l_tax", "LineYield"])


@query("audit_reference_parameters", "SELECT * FROM (VALUES ('l_quantity', true), ('OHMIC_ET_Rc_an_ct2', false)) AS t(name, present)")
def _(spark, d):
    return audit.columns_present(line(spark, d), ["l_quantity", "OHMIC_ET_Rc_an_ct2"])


@query("audit_id_candidates", f"WITH s AS ({_per_column(SHARES, ['o_orderkey', 'o_custkey', 'o_orderstatus'], 'orders')}) SELECT \"column\", {r('n_distinct / n')} AS uniqueness, \"column\" = 'o_custkey' AS listed FROM s WHERE \"column\" = 'o_custkey' OR n_distinct / n >= 0.95")
def _(spark, d):
    return rounded(audit.id_candidates(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], ["o_orderkey", "o_custkey", "o_orderstatus"]))


@query("audit_columns", f"WITH s AS ({_per_column(SHARES)}) SELECT \"column\", CASE WHEN \"column\" IN ('l_returnflag', 'l_linestatus', 'l_shipdate') THEN 'non_numeric' ELSE 'numeric' END AS kind, \"column\" = 'l_tax' AS leakage, \"column\" = 'l_orderkey' AS identifier, CAST((SELECT count(*) FROM lineitem) - n AS BIGINT) AS n_missing, {r('((SELECT count(*) FROM lineitem) - n) / (SELECT count(*) FROM lineitem)')} AS share, CAST(n AS BIGINT) AS n, n_distinct, CAST(top_n AS BIGINT) AS top_n, {r('top_n / n')} AS top_share, n_distinct <= 1 AS constant, top_n / n >= 0.99 AS near_constant FROM s")
def _(spark, d):
    return rounded(audit.column_audit(line(spark, d), ["l_tax"], ["l_orderkey"]))


# derived features

NOMINAL = {"ECONOMY": 10.0, "LARGE": 30.0, "MEDIUM": 30.0, "PROMO": 30.0, "SMALL": 20.0, "STANDARD": 20.0}


@query("derive_deviation", f"WITH {U}, n AS (SELECT *, CASE WHEN p_type LIKE 'E%' THEN 10.0 WHEN p_type LIKE 'S%' THEN 20.0 ELSE 30.0 END AS nominal FROM u) SELECT p_type, count(*) AS n, {r('avg(abs(p_size - nominal))')} AS mean_cd_dev, {r('avg(abs(l_discount - 0.05))')} AS mean_sin_dev FROM n GROUP BY p_type")
def _(spark, d):
    u = read_units(spark, d)
    x = derive.with_deviation(derive.with_nominal(u, CAT, NOMINAL), "p_size", F.col("nominal"), "cd_dev")
    x = derive.with_deviation(x, "l_discount", 0.05, "sin_dev")
    return rounded(x.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("cd_dev").alias("mean_cd_dev"), F.avg("sin_dev").alias("mean_sin_dev")))


@query("derive_abs", f"WITH {U} SELECT l_orderkey, l_partkey, l_linenumber, {r('l_tax - 0.04')} AS alignment, {r('abs(l_tax - 0.04)')} AS abs_alignment FROM u")
def _(spark, d):
    u = read_units(spark, d).withColumn("alignment", F.col("l_tax") - 0.04)
    return derive.with_abs(u, "alignment", "abs_alignment").select("l_orderkey", "l_partkey", F.col("l_linenumber"), (F.round("alignment", 6) + 0.0).alias("alignment"), (F.round("abs_alignment", 6) + 0.0).alias("abs_alignment"))


@query("derive_delta", f"WITH {U} SELECT l_orderkey, l_partkey, l_linenumber, {r('o_totalprice - p_retailprice', 3)} AS delta FROM u")
def _(spark, d):
    return derive.with_delta(read_units(spark, d), "o_totalprice", "p_retailprice", "delta").select("l_orderkey", "l_partkey", "l_linenumber", (F.round("delta", 3) + 0.0).alias("delta"))


# distributions, binned responses, heatmaps


def _hist(x: str, k: int, source: str) -> str:
    return f"SELECT bin, {r(f'lo + (hi - lo) / {k} * bin', 3)} AS lo, {r(f'lo + (hi - lo) / {k} * (bin + 1)', 3)} AS hi, n FROM (SELECT {bin_sql(x, 'lo', 'hi', k)} AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM {source}, (SELECT min({x}) AS lo, max({x}) AS hi FROM {source}) GROUP BY 1)"


@query("hist_target", _hist(Y, 10, "lineitem"))
def _(spark, d):
    return rounded(bins.histogram(line(spark, d), Y), 3)


@query("box_target", f"WITH q AS (SELECT quantile_cont({Y}, 0.25) AS q1, quantile_cont({Y}, 0.5) AS median, quantile_cont({Y}, 0.75) AS q3 FROM lineitem), x AS (SELECT *, {Y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem, q) SELECT {r('q1', 3)} AS q1, {r('median', 3)} AS median, {r('q3', 3)} AS q3, count(*) AS n, min({Y}) FILTER (ok) AS whisker_lo, max({Y}) FILTER (ok) AS whisker_hi, count(*) FILTER (NOT ok) AS n_outliers FROM x GROUP BY q1, median, q3")
def _(spark, d):
    return rounded(bins.box_stats(line(spark, d), Y), 3)


def _binned(k: int, by: str | None = None, params: list[str] = PARAMS, y: bool = True) -> str:
    key = "category, " if by else ""
    mean = f", {r('avg(y)', 3)} AS mean_y" if y else ""
    return f"WITH {U}, l AS ({long_sql(params, by)}), e AS (SELECT {key}param, min(x) AS lo, max(x) AS hi FROM l GROUP BY {key}param), b AS (SELECT l.*, lo, hi, {bin_sql('x', 'lo', 'hi', k)} AS bin FROM l JOIN e USING ({key}param)) SELECT {key}param, bin, {r(f'min(lo) + (max(hi) - min(lo)) / {k} * bin')} AS lo, {r(f'min(lo) + (max(hi) - min(lo)) / {k} * (bin + 1)')} AS hi, count(*) AS n{mean} FROM b GROUP BY {key}param, bin"


@query("feature_distributions", _binned(10, y=False))
def _(spark, d):
    return rounded(bins.distributions(read_units(spark, d), PARAMS))


@query("scatter_pairs", f"SELECT l_quantity AS x, {Y} AS y FROM lineitem")
def _(spark, d):
    return bins.scatter(line(spark, d), "l_quantity", Y)


@query("binned_equal_width", _binned(10))
def _(spark, d):
    return rounded(bins.binned(read_units(spark, d), PARAMS, Y), mean_y=3)


@query("binned_quantile", f"WITH p AS (SELECT l_quantity AS x, count(*) AS n, sum({Y}) AS s FROM lineitem GROUP BY 1), c AS (SELECT *, CAST(floor((sum(n) OVER (ORDER BY x) - n) * 10 / (SELECT sum(n) FROM p)) AS BIGINT) AS bin FROM p) SELECT bin, min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, {r('sum(s) / sum(n)', 3)} AS mean_y FROM c GROUP BY bin")
def _(spark, d):
    return rounded(bins.binned_quantile(line(spark, d), "l_quantity", Y), 3)


@query("tech_binned", _binned(10, CAT, ["p_size"]))
def _(spark, d):
    return rounded(bins.binned(read_units(spark, d), ["p_size"], Y, by=CAT), mean_y=3)


def _heat(x: str, y: str, by: str | None, k: int = 5) -> str:
    key, on = ("category, ", "JOIN e USING (category)") if by else ("", ", e")
    head = f"{by} AS category, " if by else ""
    return f"WITH {U}, l AS (SELECT {head}{x} AS x, {y} AS y, {Y} AS t FROM u), e AS (SELECT {key}min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM l {'GROUP BY category' if by else ''}), b AS (SELECT {key}{bin_sql('x', 'xl', 'xh', k)} AS xbin, {bin_sql('y', 'yl', 'yh', k)} AS ybin, t FROM l {on}) SELECT {key}xbin, ybin, count(*) AS n, {r('avg(t)', 3)} AS mean_y, count(*) < 5 AS low_support FROM b GROUP BY {key}xbin, ybin"


@query("heatmap_two_way", _heat("l_tax", "l_discount", None))
def _(spark, d):
    return rounded(bins.heatmap(read_units(spark, d), "l_tax", "l_discount", Y), 3)


@query("heatmap_tech_deviation", _heat("abs(p_size - 25)", "abs(l_discount - 0.05)", CAT))
def _(spark, d):
    u = derive.with_deviation(derive.with_deviation(read_units(spark, d), "p_size", 25.0, "d1"), "l_discount", 0.05, "d2")
    return rounded(bins.heatmap(u, "d1", "d2", Y, by=CAT), 3)


@query("tech_summary", f"WITH {U} SELECT {CAT} AS category, count({Y}) AS n, {r(f'avg({Y})', 3)} AS mean, {r(f'stddev_samp({Y})', 3)} AS std, min({Y}) AS min, {r(f'quantile_cont({Y}, 0.5)', 3)} AS median, max({Y}) AS max FROM u GROUP BY 1")
def _(spark, d):
    return rounded(bins.summary_by(read_units(spark, d), CAT, Y), 3)


# relations

RANKS = "rank() OVER (PARTITION BY param ORDER BY {v}) + (count(*) OVER (PARTITION BY param, {v}) - 1) / 2.0"


def _spearman(long: str, with_u: str = U + ", ") -> str:
    return f"WITH {with_u}l AS ({long}), k AS (SELECT param, {RANKS.format(v='x')} AS x, {RANKS.format(v='y')} AS y FROM l)"


@query("pearson_summary", f"WITH {U}, l AS ({long_sql()}) SELECT param, count(*) AS n, {r(corr_sql())} AS r FROM l GROUP BY param")
def _(spark, d):
    return rounded(association.pearson_summary(read_units(spark, d), PARAMS, Y))


@query("spearman_summary", f"{_spearman(long_sql())} SELECT param, count(*) AS n, {r(corr_sql())} AS rho FROM k GROUP BY param")
def _(spark, d):
    return rounded(association.spearman_summary(read_units(spark, d), PARAMS, Y))


@query("pearson_wide_matrix", f"WITH l AS (SELECT 'e' || i AS param, CAST(embedding[i] AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT param, count(*) AS n, {r(corr_sql())} AS r FROM l GROUP BY param")
def _(spark, d):
    wide = spark.read.parquet(f"{d}/embeddings.parquet").select("label", *[F.col("embedding")[i].alias(f"e{i + 1}") for i in range(64)])
    return rounded(association.pearson_summary(wide, [f"e{i + 1}" for i in range(64)], "label"))


@query("delta_binned", _binned(10, None, ["(o_totalprice - p_retailprice)"]).replace("'(o_totalprice - p_retailprice)'", "'delta'"))
def _(spark, d):
    u = derive.with_delta(read_units(spark, d), "o_totalprice", "p_retailprice", "delta")
    return rounded(bins.binned(u, ["delta"], Y), mean_y=3)


_SIGNED = f"SELECT 'signed' AS param, round(l_tax - 0.04, 6) AS x, {Y} AS y FROM u UNION ALL SELECT 'absolute', abs(round(l_tax - 0.04, 6)), {Y} FROM u"


@query("abs_vs_signed", f"{_spearman(_SIGNED)}, p AS (SELECT param, count(*) AS n, {r(corr_sql(), 4)} AS r FROM l GROUP BY param), q AS (SELECT param, {r(corr_sql(), 4)} AS rho FROM k GROUP BY param) SELECT param, n, r, rho FROM p JOIN q USING (param)")
def _(spark, d):
    u = read_units(spark, d).withColumn("alignment", F.round(F.col("l_tax") - 0.04, 6))
    return rounded(association.abs_and_signed(u, "alignment", Y), 4)


_DELTA = f"SELECT 'delta' AS param, o_totalprice - p_retailprice AS x, {Y} AS y FROM u"


def _delta(spark, d):
    return derive.with_delta(read_units(spark, d), "o_totalprice", "p_retailprice", "delta")


@query("delta_pearson", f"WITH {U}, l AS ({_DELTA}) SELECT param, count(*) AS n, {r(corr_sql())} AS r FROM l GROUP BY param")
def _(spark, d):
    return rounded(association.pearson_summary(_delta(spark, d), ["delta"], Y))


@query("delta_spearman", f"{_spearman(_DELTA)} SELECT param, count(*) AS n, {r(corr_sql())} AS rho FROM k GROUP BY param")
def _(spark, d):
    return rounded(association.spearman_summary(_delta(spark, d), ["delta"], Y))


@query("delta_scatter", f"WITH {U}, l AS ({_DELTA}) SELECT {r('x', 2)} AS x, y FROM l")
def _(spark, d):
    return rounded(bins.scatter(_delta(spark, d), "delta", Y), 2)


@query("monotonic", f"{_spearman(long_sql())}, a AS (SELECT param, {corr_sql()} AS r FROM l GROUP BY param), b AS (SELECT param, {corr_sql()} AS rho FROM k GROUP BY param) SELECT param, {r('r')} AS r, {r('rho')} AS rho, abs(rho) > abs(r) AS bent FROM a JOIN b USING (param)")
def _(spark, d):
    return rounded(association.monotonic(read_units(spark, d), PARAMS, Y))


@query("deviation_effect", f"{_spearman(f'SELECT {chr(39)}deviation{chr(39)} AS param, abs(p_size - 25.0) AS x, {Y} AS y FROM u')}, a AS (SELECT param, count(*) AS n, {corr_sql()} AS r FROM l GROUP BY param), b AS (SELECT param, {corr_sql()} AS rho FROM k GROUP BY param) SELECT param, n, {r('r')} AS r, {r('rho')} AS rho FROM a JOIN b USING (param)")
def _(spark, d):
    return rounded(association.deviation_effect(read_units(spark, d), "p_size", 25.0, Y))


@query("tech_pearson", f"WITH {U}, l AS ({long_sql(by=CAT)}) SELECT category, param, count(*) AS n, {r(corr_sql())} AS r FROM l GROUP BY category, param")
def _(spark, d):
    return rounded(association.pearson_summary(read_units(spark, d), PARAMS, Y, CAT))


@query("regression_line", f"WITH {U}, l AS ({long_sql()}) SELECT param, count(*) AS n, {r('regr_slope(y, x)', 4)} AS slope, {r('regr_intercept(y, x)', 4)} AS intercept, {r('regr_r2(y, x)')} AS r2 FROM l GROUP BY param")
def _(spark, d):
    return rounded(association.regression_lines(read_units(spark, d), PARAMS, Y), 4, r2=6)


_ETA = f"c AS (SELECT param, bin, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM (SELECT l.param, y, {bin_sql('x', 'lo', 'hi', 10)} AS bin FROM l JOIN (SELECT param, min(x) AS lo, max(x) AS hi FROM l GROUP BY param) e USING (param)) GROUP BY 1, 2)"


@query("eta_squared", f"WITH {U}, l AS ({long_sql()}), {_ETA} SELECT param, CAST(sum(n) AS BIGINT) AS n, {r('(sum(s * s / n) - sum(s) * sum(s) / sum(n)) / nullif(sum(ss) - sum(s) * sum(s) / sum(n), 0)')} AS eta2 FROM c GROUP BY param")
def _(spark, d):
    return rounded(association.eta_squared(read_units(spark, d), PARAMS, Y))


@query("threshold_split", f"WITH {U}, l AS ({long_sql()}), c AS (SELECT param, x, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM l GROUP BY 1, 2), w AS (SELECT param, x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s, sum(ss) OVER a AS ss FROM c WINDOW o AS (PARTITION BY param ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY param)), g AS (SELECT param, x, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / nullif(ss - s * s / n, 0), 9) AS gain, sl / nl AS lo, (s - sl) / (n - nl) AS hi FROM w WHERE nl < n) SELECT param, x AS cut, {r('gain')} AS gain, {r('lo', 3)} AS mean_low, {r('hi', 3)} AS mean_high FROM g QUALIFY row_number() OVER (PARTITION BY param ORDER BY gain DESC, x) = 1")
def _(spark, d):
    out = association.threshold_split(read_units(spark, d), PARAMS, Y)
    return rounded(out, 6, mean_low=3, mean_high=3)


WINDOW_PARAMS = ["l_quantity", "l_discount", "l_tax", "p_size"]


@query(
    "process_windows",
    f"""WITH {U}, l AS ({long_sql(WINDOW_PARAMS, "l_orderkey % 5 = 0 AS test, " + CAT)}), t AS (SELECT category, param, avg(y) AS m, min(x) AS xl, max(x) AS xh, var_pop(y) * count(*) AS total, count(*) AS rows FROM l WHERE NOT test GROUP BY 1, 2),
c AS (SELECT l.category, l.param, x, any_value(total) AS total, any_value(rows) AS rows, count(*) AS n, sum(y - m) AS s FROM l JOIN t USING (category, param) WHERE NOT test GROUP BY 1, 2, 3),
p AS (SELECT *, sum(n) OVER w AS nn, sum(s) OVER w AS ss FROM c WINDOW w AS (PARTITION BY category, param ORDER BY x)),
i AS (SELECT a.category, a.param, a.x AS lo, b.x AS hi, b.nn - a.nn + a.n AS inside, a.rows, a.total, b.ss - a.ss + a.s AS s FROM p a JOIN p b ON a.category = b.category AND a.param = b.param AND a.x <= b.x),
g AS (SELECT category, param, lo, hi, round(s * s * rows / inside / (rows - inside) / total, 9) AS gain FROM i WHERE least(inside, rows - inside) >= ceil({windows.MIN_SHARE} * rows) AND total > 0
      QUALIFY row_number() OVER (PARTITION BY category, param ORDER BY gain DESC, lo, hi) = 1),
e AS (SELECT l.category, l.param, lo, hi, gain, xl, xh, test, x BETWEEN lo AND hi AS inside, y, m FROM l JOIN g USING (category, param) JOIN t USING (category, param)),
a AS (SELECT category, param, any_value(lo) AS lo, any_value(hi) AS hi, any_value(gain) AS gain, any_value(xl) AS xl, any_value(xh) AS xh, any_value(m) AS m,
 {", ".join(f"{f} FILTER ({c}) AS {k}_{n}" for n, c in (("in", "inside AND NOT test"), ("out", "NOT inside AND NOT test"), ("tin", "inside AND test"), ("tout", "NOT inside AND test")) for k, f in (("n", "count(*)"), ("m", "avg(y)"), ("v", "var_pop(y)")))} FROM e GROUP BY 1, 2),
z AS (SELECT *, 1 - (n_tin * (v_tin + (m_tin - m_in) ** 2) + n_tout * (v_tout + (m_tout - m_out) ** 2)) / (n_tin * (v_tin + (m_tin - m) ** 2) + n_tout * (v_tout + (m_tout - m) ** 2)) AS held_gain, sign(m_in - m_out) * (m_tin - m_tout) / sqrt(v_tin / (n_tin - 1) + v_tout / (n_tout - 1)) AS z FROM a)
SELECT category, param, n_in + n_out AS n, lo, hi, n_in, {r("m_in", 3)} AS mean_in, {r("m_out", 3)} AS mean_out, {r("gain")} AS gain, CASE WHEN lo <= xl THEN 'low' WHEN hi >= xh THEN 'high' ELSE 'window' END AS side, n_tin + n_tout AS held_n, {r("held_gain")} AS held_gain, {r("z", 4)} AS z, z >= {windows.Z} AS found FROM z""",
)
def _(spark, d):
    u = read_units(spark, d).withColumn("held", F.col("l_orderkey") % 5 == 0)
    return rounded(windows.process_windows(u, WINDOW_PARAMS, Y, CAT, "held"), 6, mean_in=3, mean_out=3, z=4)


@query("interaction_excess", f"WITH {U}, e AS (SELECT min(l_tax) AS xl, max(l_tax) AS xh, min(l_discount) AS yl, max(l_discount) AS yh FROM u), c AS (SELECT {bin_sql('l_tax', 'xl', 'xh', 5)} AS xbin, {bin_sql('l_discount', 'yl', 'yh', 5)} AS ybin, count(*) AS n, sum({Y}) AS s FROM u, e GROUP BY 1, 2) SELECT xbin, ybin, n, {r('s / n', 3)} AS mean_y, {r('s / n - sum(s) OVER (PARTITION BY xbin) / sum(n) OVER (PARTITION BY xbin) - sum(s) OVER (PARTITION BY ybin) / sum(n) OVER (PARTITION BY ybin) + sum(s) OVER () / sum(n) OVER ()', 3)} AS excess, n < 5 AS low_support FROM c")
def _(spark, d):
    return rounded(interaction.interaction_excess(read_units(spark, d), "l_tax", "l_discount", Y), 3)


@query("interaction_strength", f"""WITH {U}, s AS (SELECT 'l_tax' AS x, 'l_discount' AS y, sum(n * e * e) / sum(n) AS strength, count(*) AS cells FROM (SELECT n, s / n - sum(s) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) - sum(s) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) + sum(s) OVER () / sum(n) OVER () AS e FROM (SELECT {bin_sql('l_tax', 'xl', 'xh', 5)} AS a, {bin_sql('l_discount', 'yl', 'yh', 5)} AS b, count(*) AS n, sum({Y}) AS s FROM u, (SELECT min(l_tax) AS xl, max(l_tax) AS xh, min(l_discount) AS yl, max(l_discount) AS yh FROM u) GROUP BY 1, 2)) WHERE n >= 5 UNION ALL SELECT 'l_quantity' AS x, 'p_size' AS y, sum(n * e * e) / sum(n) AS strength, count(*) AS cells FROM (SELECT n, s / n - sum(s) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) - sum(s) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) + sum(s) OVER () / sum(n) OVER () AS e FROM (SELECT {bin_sql('l_quantity', 'xl', 'xh', 5)} AS a, {bin_sql('p_size', 'yl', 'yh', 5)} AS b, count(*) AS n, sum({Y}) AS s FROM u, (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(p_size) AS yl, max(p_size) AS yh FROM u) GROUP BY 1, 2)) WHERE n >= 5) SELECT x, y, {r('strength', 2)} AS strength, cells FROM s""")
def _(spark, d):
    return rounded(interaction.interaction_strength(read_units(spark, d), [("l_tax", "l_discount"), ("l_quantity", "p_size")], Y), 2)


def _cells(params: list[str], k: int) -> str:
    """Rows' bins b (id, d: the centred target, p: the parameter's number, v: its bin), ranges r of bins, cells of pairs c2."""
    long = " UNION ALL ".join(f"SELECT id, d, {i} AS p, CAST({c} AS DOUBLE) AS x FROM i" for i, c in enumerate(params))
    return f"""WITH {U}, i AS (SELECT row_number() OVER () AS id, *, {Y} - avg({Y}) OVER () AS d FROM u), l AS ({long}), e AS (SELECT p, min(x) AS lo, max(x) AS hi FROM l GROUP BY p),
b AS (SELECT id, d, p, {bin_sql('x', 'lo', 'hi', k)} AS v FROM l JOIN e USING (p)), r AS (SELECT a, z FROM range({k}) t(a), range({k}) s(z) WHERE z >= a AND z - a < {k - 1}),
c2 AS (SELECT x.p AS p, x.v AS v, y.p AS q, y.v AS w, count(*) AS n, sum(x.d) AS s, sum(x.d * x.d) AS ss FROM b x JOIN b y ON x.id = y.id AND x.p < y.p GROUP BY 1, 2, 3, 4)"""


def _name(p: str, params: list[str]) -> str:
    return "CASE " + p + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(params)) + " END"


_END = "(SELECT lo + (hi - lo) / {k} * ({at}) FROM e WHERE e.p = f.{p})"


@query(
    "subgroups",
    f"""{_cells(WINDOW_PARAMS, 4)}, c1 AS (SELECT p, v, count(*) AS n, sum(d) AS s FROM b GROUP BY 1, 2),
s1 AS (SELECT p, a, z, sum(n) AS n, sum(s) AS s FROM c1 JOIN r ON v BETWEEN a AND z GROUP BY 1, 2, 3),
s2 AS (SELECT p, r.a, r.z, q, t.a AS a2, t.z AS z2, sum(n) AS n, sum(s) AS s FROM c2 JOIN r ON v BETWEEN r.a AND r.z JOIN r t ON w BETWEEN t.a AND t.z GROUP BY 1, 2, 3, 4, 5, 6),
o AS (SELECT p, a, z, NULL AS q, NULL AS a2, NULL AS z2, n, s FROM s1 UNION ALL SELECT * FROM s2),
k AS (SELECT *, round(abs(s) / sqrt(n), 9) AS quality FROM o WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY p, q ORDER BY quality DESC, n, a, z, a2, z2) = 1),
f AS (SELECT k.*, s / n - (SELECT s / n FROM s1 WHERE s1.p = k.p AND s1.a = k.a AND s1.z = k.z) - coalesce((SELECT s / n FROM s1 WHERE s1.p = k.q AND s1.a = k.a2 AND s1.z = k.z2), 0) AS excess, row_number() OVER (ORDER BY quality DESC, q NULLS FIRST, p) AS rank FROM k)
SELECT rank, {_name('p', WINDOW_PARAMS)} AS x, {r(_END.format(k=4, at='a', p='p'))} AS x_lo, {r(_END.format(k=4, at='z + 1', p='p'))} AS x_hi, {_name('q', WINDOW_PARAMS)} AS y, {r(_END.format(k=4, at='a2', p='q'))} AS y_lo, {r(_END.format(k=4, at='z2 + 1', p='q'))} AS y_hi,
 CAST(n AS BIGINT) AS n, {r(f's / n + (SELECT avg({Y}) FROM u)', 3)} AS mean, {r('quality', 3)} AS quality, {r('excess', 3)} AS excess FROM f WHERE rank <= 8""",
)
def _(spark, d):
    found = subgroups.subgroups(read_units(spark, d), WINDOW_PARAMS, Y, k=4, depth=2, top=8)
    ends = [F.get("ranges", F.lit(i))[f].alias(f"{x}{s}") for i, x in enumerate("xy") for f, s in (("param", ""), ("lo", "_lo"), ("hi", "_hi"))]
    return rounded(found.select("rank", *ends, "n", "mean", "quality", "excess"), 6, mean=3, quality=3, excess=3)


@query(
    "pair_cuts",
    f"""{_cells(PARAMS, 6)}, g AS (SELECT p, q, i, j, sum(n) AS nt, sum(s) AS st, sum(ss) AS ss, {", ".join(f"sum({c}) FILTER ({f}) AS {c}{m}" for m, f in enumerate(("v <= i AND w <= j", "v <= i AND w > j", "v > i AND w <= j", "v > i AND w > j")) for c in ("n", "s"))} FROM c2, range(5) t(i), range(5) s(j) GROUP BY 1, 2, 3, 4),
k AS (SELECT *, round((s0 * s0 / n0 + s1 * s1 / n1 + s2 * s2 / n2 + s3 * s3 / n3 - st * st / nt) / (ss - st * st / nt), 9) AS gain FROM g WHERE least(n0, n1, n2, n3) >= 5 QUALIFY row_number() OVER (PARTITION BY p, q ORDER BY gain DESC, i, j) = 1),
f AS (SELECT *, {_name('p', PARAMS)} AS x, {_name('q', PARAMS)} AS y FROM k)
SELECT x, y, {r(_END.format(k=6, at='i + 1', p='p'))} AS cut_x, {r(_END.format(k=6, at='j + 1', p='q'))} AS cut_y, CAST(nt AS BIGINT) AS n, {r('gain')} AS gain, {r('s0 / n0 - s1 / n1 - s2 / n2 + s3 / n3', 3)} AS contrast, row_number() OVER (ORDER BY gain DESC, x, y) AS rank FROM f""",
)
def _(spark, d):
    return rounded(interaction.pair_cuts(read_units(spark, d), PARAMS, Y, k=6), 6, contrast=3)


@query("interaction_pairs")
def _(spark, d):
    return interaction.interaction_pairs(read_units(spark, d), PARAMS, Y)


@query("tree_attributions")
def _(spark, d):
    u = read_units(spark, d)
    return shapley.attribution_summary(model.fit_trees(u, PARAMS, Y), u, PARAMS)


@query("three_way", f"WITH {U}, e AS (SELECT min(l_tax) AS al, max(l_tax) AS ah, min(l_discount) AS bl, max(l_discount) AS bh, min(l_quantity) AS cl, max(l_quantity) AS ch FROM u) SELECT {bin_sql('l_tax', 'al', 'ah', 3)} AS xbin, {bin_sql('l_discount', 'bl', 'bh', 3)} AS ybin, {bin_sql('l_quantity', 'cl', 'ch', 3)} AS zbin, count(*) AS n, {r(f'avg({Y})', 3)} AS mean_y, count(*) < 5 AS low_support FROM u, e GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(interaction.three_way(read_units(spark, d), "l_tax", "l_discount", "l_quantity", Y), 3)


@query(
    "discovery",
    f"""{_spearman(long_sql())}, {_ETA}, a AS (SELECT param, count(*) AS n, {corr_sql()} AS r FROM l GROUP BY 1), b AS (SELECT param, {corr_sql()} AS rho FROM k GROUP BY 1),
e AS (SELECT param, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / nullif(sum(ss) - sum(s) * sum(s) / sum(n), 0) AS eta2 FROM c GROUP BY 1),
v AS (SELECT param, x, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM l GROUP BY 1, 2), w AS (SELECT param, x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER p AS n, sum(s) OVER p AS s, sum(ss) OVER p AS ss FROM v WINDOW o AS (PARTITION BY param ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY param)),
t AS (SELECT param, x AS cut, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / nullif(ss - s * s / n, 0), 9) AS gain FROM w WHERE nl < n QUALIFY row_number() OVER (PARTITION BY param ORDER BY gain DESC, x) = 1)
SELECT param, n, {r('r')} AS r, {r('rho')} AS rho, {r('eta2')} AS eta2, cut, {r('gain')} AS gain, {r('greatest(r * r, rho * rho, eta2, gain)')} AS strength FROM a JOIN b USING (param) JOIN e USING (param) JOIN t USING (param)""",
)
def _(spark, d):
    return rounded(association.discovery(read_units(spark, d), PARAMS, Y))


@query("insight_records")
def _(spark, d):
    u = read_units(spark, d).withColumn("held", F.col("l_orderkey") % 5 == 0)
    return ranking.insights(association.discovery(u, PARAMS, Y), {"l_tax": "LINE"}, windows.process_windows(u, PARAMS, Y, held="held"))


@query("insight_combinations")
def _(spark, d):
    return ranking.combination_insights(subgroups.subgroups(read_units(spark, d), WINDOW_PARAMS, Y, k=4), {"l_tax": "LINE"})


@query("three_way_effects")
def _(spark, d):
    return interaction.three_way_effects(read_units(spark, d), [("l_tax", "l_discount", "l_quantity"), ("l_quantity", "p_size", "p_retailprice")], Y)


@query("stability_selection")
def _(spark, d):
    return resampling.stability_selection(read_units(spark, d), PARAMS, Y, "l_orderkey", top=2)


@query("max_statistic_test")
def _(spark, d):
    return resampling.max_statistic_test(read_units(spark, d), PARAMS, Y, "l_orderkey")


_LEAKS = {"coarse": f"round({Y} / 500)", "part": "p_retailprice", "quantity": "l_quantity", "grade": f"'g' || CAST(CAST(floor({Y} / 2000) AS BIGINT) AS VARCHAR)"}
_LEAK_NUMBERS = " UNION ALL ".join(f"SELECT '{c}' AS param, CAST({e} AS DOUBLE) AS x, {Y} AS y FROM u" for c, e in _LEAKS.items() if c != "grade")


@query(
    "leakage_candidates",
    f"""{_spearman(_LEAK_NUMBERS)}, t AS ({" UNION ALL ".join(f"SELECT '{c}' AS param, CAST({e} AS VARCHAR) AS v, {Y} - (SELECT avg({Y}) FROM u) AS y FROM u" for c, e in _LEAKS.items())}),
g AS (SELECT param, v, count(*) AS n, avg(y) AS m, var_pop(y) AS s FROM t GROUP BY 1, 2),
f AS (SELECT param, sum(n) AS n, CASE WHEN sum(n) >= 2 * count(*) THEN 1 - (sum(n * s) / (sum(n) - count(*))) / ((sum(n * s) + sum(n * m * m)) / (sum(n) - 1)) END AS fixed FROM g GROUP BY 1),
b AS (SELECT param, y, {bin_sql('x', 'lo', 'hi', 50)} AS bin FROM l JOIN (SELECT param, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1) USING (param)),
e AS (SELECT param, sum(n * (m - (SELECT avg({Y}) FROM u)) ** 2) / (SELECT var_pop({Y}) * count(*) FROM u) AS eta2 FROM (SELECT param, bin, count(*) AS n, avg(y) AS m FROM b GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT param, {corr_sql()} AS rho FROM k GROUP BY 1)
SELECT param AS "column", CAST(n AS BIGINT) AS n, {r('rho', 4)} AS rho, {r('eta2', 4)} AS eta2, {r('fixed', 4)} AS fixed, concat_ws('; ', CASE WHEN abs(rho) >= 0.98 THEN 'its ranks are nearly the target''s' END, CASE WHEN eta2 >= 0.95 THEN 'its bins part the target' END, CASE WHEN fixed >= 0.95 THEN 'its values fix the target' END) AS evidence
FROM f LEFT JOIN h USING (param) LEFT JOIN e USING (param) WHERE evidence <> ''""",
)
def _(spark, d):
    grade = F.concat(F.lit("g"), F.floor(F.col(Y) / 2000).cast("string"))
    u = read_units(spark, d).select(Y, F.round(F.col(Y) / 500).alias("coarse"), F.col("p_retailprice").alias("part"), F.col("l_quantity").alias("quantity"), grade.alias("grade"))
    return rounded(screening.leakage_candidates(u, Y), 4)


# screening

_REASON = "CASE " + " ".join(f"WHEN \"column\" IN ({', '.join(repr(c) for c in names)}) THEN '{reason}'" for reason, names in (("target_leakage", ["o_totalprice"]), ("identifier", ROLES.identifiers), ("metadata", ROLES.metadata), ("downstream", ["l_returnflag"]))) + " WHEN n_distinct <= 1 THEN 'constant' WHEN top_n / n >= 0.99 THEN 'near_constant' WHEN \"column\" IN ('l_linestatus', 'p_brand', 'p_type', 'o_orderstatus', 'o_orderpriority') THEN 'categorical' END"
_SCREEN = f"WITH {U}, s AS ({_per_column(SHARES, UNIT_COLUMNS, 'u')}), x AS (SELECT \"column\", {_REASON} AS reason FROM s WHERE \"column\" <> '{Y}')"


@query("screen_included", f"{_SCREEN} SELECT \"column\" FROM x WHERE reason IS NULL")
def _(spark, d):
    return screening.included(screening.screen(read_units(spark, d), ROLES))


@query("screen_excluded", f"{_SCREEN} SELECT \"column\", reason FROM x WHERE reason IS NOT NULL")
def _(spark, d):
    return screening.excluded(screening.screen(read_units(spark, d), ROLES))


# evaluation and models


@query("split_sizes", f"SELECT {crc_sql('k')} % 1000 < 200 AS is_test, count(*) AS n FROM (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem) GROUP BY 1")
def _(spark, d):
    return model.with_split(line(spark, d), "l_orderkey").groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("eval_metrics", f"WITH e AS (SELECT {Y} AS y, {Y} - (1000 * l_quantity + 3000) AS e FROM lineitem) SELECT count(*) AS n, {r('avg(abs(e))', 3)} AS mae, {r('sqrt(avg(e * e))', 3)} AS rmse, {r('1 - sum(e * e) / nullif(var_pop(y) * count(*), 0)')} AS r2 FROM e")
def _(spark, d):
    return rounded(model.metrics(line(spark, d).withColumn("p", 1000 * F.col("l_quantity") + 3000), Y, "p"), 3, r2=6)


@query("additive_shapes")
def _(spark, d):
    u = read_units(spark, d)
    return model.fit_additive(u, PARAMS, Y).shape_table(spark)


@query("additive_eval")
def _(spark, d):
    u = model.with_split(read_units(spark, d), "l_orderkey")
    return model.metrics(model.fit_additive(u.filter("NOT is_test"), PARAMS, Y).predict(u.filter("is_test")), Y, "prediction")


@query("boosted_trees_eval")
def _(spark, d):
    u = model.with_split(read_units(spark, d), "l_orderkey")
    fitted = model.fit_trees(u.filter("NOT is_test"), PARAMS, Y)
    return model.metrics(model.predict_trees(fitted, u.filter("is_test"), PARAMS), Y, "prediction")


@query("permutation_importance")
def _(spark, d):
    u = read_units(spark, d)
    fitted = model.fit_additive(u, PARAMS, Y)
    return model.permutation_importance(fitted.predict, u, PARAMS, Y, "l_orderkey")


@query("stability", f"""WITH {U}, f AS (SELECT o, {crc_sql('CAST(o AS VARCHAR)')} % 5 AS fold FROM (SELECT DISTINCT l_orderkey AS o FROM u)), l AS ({long_sql(by="(SELECT fold FROM f WHERE o = l_orderkey)")}),
p AS (SELECT category, param, {corr_sql()} AS r FROM l GROUP BY 1, 2) SELECT param, {r('avg(r)')} AS mean_r, {r('stddev_pop(r)')} AS std_r, abs(sum(sign(r))) = count(r) AS same_sign FROM p GROUP BY 1""")
def _(spark, d):
    return rounded(model.stability(read_units(spark, d), PARAMS, Y, "l_orderkey"))


@query("rediscovery", f"WITH {U}, l AS ({long_sql()}), f AS (SELECT param FROM (SELECT param, {corr_sql()} AS r FROM l GROUP BY 1) ORDER BY abs(r) DESC, param LIMIT 2), h AS (SELECT count(*) AS n FROM f WHERE param IN ('l_quantity', 'p_retailprice')) SELECT n / 2.0::DOUBLE AS recall, n / 2.0::DOUBLE AS precision FROM h")
def _(spark, d):
    found = ranking.parameter_table(association.pearson_summary(read_units(spark, d), PARAMS, Y), 2)
    return model.rediscovery(found, spark.createDataFrame([("l_quantity",), ("p_retailprice",)], "param string"))


# ranked tables


def _pareto(amount: str, group: str) -> str:
    return f"WITH g AS (SELECT CAST({group} AS VARCHAR) AS \"group\", sum({amount}) AS a FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY a DESC, \"group\") AS rank, 100 * a / nullif(sum(a) OVER (), 0) AS pct FROM g) SELECT \"group\", {r('a', 2)} AS amount, rank, {r('pct')} AS pct, {r('sum(pct) OVER (ORDER BY rank)')} AS cum_pct FROM k"


@query("pareto_golden", _pareto(f"CAST({Y} >= 40000 AS DOUBLE)", "l_suppkey"))
def _(spark, d):
    return rounded(ranking.golden_routes(line(spark, d), "l_suppkey", Y, 40000), 6, amount=2)


@query("pareto_worsening", _pareto(f"greatest(0.0, 40000.0 - {Y})", "l_suppkey"))
def _(spark, d):
    return rounded(ranking.worsening_routes(line(spark, d), "l_suppkey", Y, 40000), 6, amount=2)


@query("parameter_ranking", f"WITH {U}, l AS ({long_sql()}), p AS (SELECT param, {corr_sql()} AS r FROM l GROUP BY param) SELECT param, CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction, {r('r')} AS strength, row_number() OVER (ORDER BY abs(r) DESC, param) AS rank FROM p WHERE r IS NOT NULL")
def _(spark, d):
    return rounded(ranking.parameter_table(association.pearson_summary(read_units(spark, d), PARAMS, Y)))


@query("trend_points", f"WITH p AS (SELECT event_type AS category, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day) - 1 AS seq FROM p WHERE value IS NOT NULL) SELECT category, 'T' || (seq + 1) AS label, seq, {r('value')} AS value, {r('(100 - value) / 100')} AS height FROM n")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    return rounded(ranking.trend_points(ranking.trend_series(events, "event_type", "day", "value"), "values", 0.0, 100.0, "category"))


@query("headline", "SELECT l_returnflag AS category, max(k) % 100000 AS value FROM (SELECT l_returnflag, l_orderkey * 100000 + l_partkey AS k FROM lineitem) GROUP BY 1")
def _(spark, d):
    x = line(spark, d).withColumn("k", F.col("l_orderkey") * 100000 + F.col("l_partkey")).withColumn("v", F.col("k") % 100000)
    return ranking.headline(x, "v", "k", "l_returnflag")


@query("family_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return derive.project(derive.subset(line(spark, d), "l_returnflag", "R"), ["l_orderkey", "l_linenumber", "l_quantity"])
