"""Feature eligibility: every column gets one role, and every excluded one a stated reason."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_ref, numeric_columns, present
from .association import eta_squared, spearman_summary
from .audit import NEAR_CONSTANT, value_shares

#: The first that holds is the reason.
PRECEDENCE = ("target_leakage", "identifier", "metadata", "downstream", "constant", "near_constant", "categorical")


@dataclass(frozen=True)
class Roles:
    """Configured names. Downstream columns are those whose stage comes after ``predict_at`` in ``stage_order``; stages are
    given, never guessed from names."""

    target: str
    leakage: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    stages: dict[str, str] = field(default_factory=dict)
    stage_order: tuple[str, ...] = ()
    predict_at: str | None = None

    def downstream(self, column: str) -> bool:
        if self.predict_at is None or column not in self.stages:
            return False
        return self.stage_order.index(self.stages[column]) > self.stage_order.index(self.predict_at)


def screen(df: DataFrame, roles: Roles, share: float = NEAR_CONSTANT) -> DataFrame:
    """column, role (target, excluded, eligible), reason. Values are counted only in columns that no list decides."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    catalogue = [(c, c == roles.target, c in roles.leakage, c in roles.identifiers, c in roles.metadata, roles.downstream(c), not numeric) for c, numeric in kinds.items()]
    flags = df.sparkSession.createDataFrame(catalogue, "column string, target boolean, target_leakage boolean, identifier boolean, metadata boolean, downstream boolean, categorical boolean")
    undecided = [c for c, *listed, _ in catalogue if not any(listed)]
    counted = value_shares(df, undecided) if undecided else df.sparkSession.createDataFrame([], "column string, n_distinct long, top_share double")
    shares = counted.select("column", (F.col("n_distinct") <= 1).alias("constant"), F.coalesce(F.col("top_share") >= share, F.lit(False)).alias("near_constant"))
    both = flags.join(shares, "column", "left").fillna(False, ["constant"]).fillna(False, ["near_constant"])
    reason = F.lit(None).cast("string")
    for name in reversed(PRECEDENCE):
        reason = F.when(F.col(name), F.lit(name)).otherwise(reason)
    both = both.withColumn("reason", F.when(~F.col("target"), reason))
    return both.select("column", F.when(F.col("target"), "target").when(F.col("reason").isNotNull(), "excluded").otherwise("eligible").alias("role"), "reason")


def included(screened: DataFrame) -> DataFrame:
    return screened.filter("role = 'eligible'").select("column")


def excluded(screened: DataFrame) -> DataFrame:
    return screened.filter("role = 'excluded'").select("column", "reason")


def eligible_columns(screened: DataFrame) -> list[str]:
    """Names for a projection; as many as the table has columns at most."""
    return sorted(r["column"] for r in included(screened).collect())


def leakage_candidates(df: DataFrame, target: str, columns: list[str] | None = None, k: int = 50, near: float = 0.98, share: float = 0.95) -> DataFrame:
    """column, n, rho, eta2, fixed, evidence: columns whose data alone make them look like the target under another name.

    ``rho`` is the rank correlation and ``eta2`` the target's share between ``k`` bins, both for numbers; ``fixed`` is how much
    of the target's variance a column's single values fix (within-value variance against all, each by its degrees of freedom),
    for columns of any kind whose values have two rows each on average. A column is a candidate if |rho| >= ``near`` or either
    share is at least ``share``; evidence says by which. Candidates are for a person to judge and exclude nothing by themselves:
    a true cause may be as close.
    """
    y = present(col_ref(target))
    columns = [c for c in (columns if columns is not None else df.columns) if c != target]
    numbers = [c for c in numeric_columns(df) if c in columns]
    mean = df.agg(F.avg(y).alias("m")).first().m or 0.0
    safe = {f"c{i}": c for i, c in enumerate(columns)}
    kinds = dict(df.dtypes)
    text = lambda c: (present(col_ref(c)) if kinds[c] in ("double", "float") else col_ref(c)).cast("string")
    wide = df.select((y - F.lit(mean)).alias("_y"), *[text(c).alias(s) for s, c in safe.items()]).filter("_y IS NOT NULL")
    rows = wide.unpivot("_y", list(safe), "c", "value").filter("value IS NOT NULL") if columns else wide.select("_y", F.lit("").alias("c"), F.lit("").alias("value")).limit(0)
    values = rows.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    n, m = F.col("n"), F.col("m")
    each = values.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(n * F.col("v")).alias("within"), F.sum(n * m).alias("s"), F.sum(n * m * m).alias("between"))
    whole = F.col("within") + F.col("between") - F.col("s") * F.col("s") / n
    fixed = F.when((n >= 2 * F.col("g")) & (F.col("g") > 1) & (whole > 0), 1 - (F.col("within") / (n - F.col("g"))) / (whole / (n - 1)))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in safe.items() for x in pair]), F.col("c")) if columns else F.lit("")
    out = each.select(name.alias("column"), "n", fixed.alias("fixed"))
    rho = spearman_summary(df, numbers, target).select(F.col("param").alias("column"), "rho")
    eta = eta_squared(df, numbers, target, k).select(F.col("param").alias("column"), "eta2")
    out = out.join(rho, "column", "left").join(eta, "column", "left")
    signs = [(F.abs("rho") >= near, "its ranks are nearly the target's"), (F.col("eta2") >= share, "its bins part the target"), (F.col("fixed") >= share, "its values fix the target")]
    evidence = F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in signs])
    return out.select("column", "n", "rho", "eta2", "fixed", evidence.alias("evidence")).filter("evidence <> ''")
