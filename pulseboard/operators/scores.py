"""Sheet-side derived columns: scorecard lookups, pair scores, weighted totals,
letter bands and margin.

A scorecard cell scores the value of the *first* mapping row (sheet order)
with the same tab and value; the question is not compared; no hit scores 0.
The mapping is deduplicated per value (partial aggregate) and joined once per
scorecard column: the scored tab is never exploded or regrouped, and the
planner broadcasts the mapping or shuffles by its real size. Sums go through
``exact.row_sum``: all digits count, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.bands import band
from ..functions.exact import Sum, aggregate, row_sum
from ..sources.tabs import ROW, q, with_default
from ..targets import PIPELINE_SCORECARD, PROJECT_SCORECARD

PROJECT_LETTERS = (("A", 85.0, 100.0), ("B", 70.0, 84.99), ("C", 0.0, 69.99))
PIPELINE_LETTERS = (("A", 70.0, 100.0), ("B", 40.0, 69.99), ("C", 0.0, 39.99))


def _norm(c: Column, ignore_case: bool) -> Column:
    return F.lower(c) if ignore_case else c


def _with(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with the columns named, missing text where one is absent."""
    for c in cols:
        df = with_default(df, c)
    return df


def first_value_scores(mapping: DataFrame, tab: str, ignore_case: bool = False) -> DataFrame:
    """(lookup, score): first mapping row per value of one tab."""
    mapping = _with(mapping, "Tab", "Value")
    m = mapping.where(q("Tab") == tab).where(q("Value").isNotNull())
    return m.groupBy(_norm(q("Value"), ignore_case).alias("lookup")).agg(
        F.min_by(C.number_of(mapping, "Score"), F.col(ROW)).alias("score"))


def first_key_scores(mapping: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(lookup, score): first mapping row per composite key."""
    mapping = _with(mapping, "Key")
    m = mapping.where(q("Key").isNotNull())
    return m.groupBy(_norm(q("Key"), ignore_case).alias("lookup")).agg(
        F.min_by(C.number_of(mapping, "Score"), F.col(ROW)).alias("score"))


def pair_key(prefix: str, a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.lit(prefix), a, b)


def joined_score(df: DataFrame, table: DataFrame, cell: Column, out: str) -> DataFrame:
    """``df`` with the score of ``cell`` in ``table`` (lookup, score) as ``out``; 0 without a hit."""
    t = table.select(F.col("lookup").alias(f"__k_{out}"), F.col("score").alias(f"__s_{out}"))
    j = df.join(t, cell == F.col(f"__k_{out}"), "left")
    return j.withColumn(out, F.coalesce(F.col(f"__s_{out}"), F.lit(0.0))).drop(f"__k_{out}", f"__s_{out}")


def _scored(df: DataFrame, table: DataFrame, cols, ignore_case: bool = False):
    """``df`` with one score column per scorecard column, and their names."""
    names = []
    for i, c in enumerate(cols):
        names.append(f"__c{i}")
        df = joined_score(df, table, _norm(q(c), ignore_case), names[-1])
    return df, names


def scorecard(df: DataFrame, mapping: DataFrame, tab: str, cols, name_col: str, out: str = "score",
              ignore_case: bool = False) -> DataFrame:
    """Sum of first-hit scores over the scorecard ``cols`` of every row."""
    present = [c for c in cols if c in df.columns]
    lean = with_default(df, name_col).select(F.col(ROW), q(name_col), *[q(c) for c in present])
    j, names = _scored(lean, first_value_scores(mapping, tab, ignore_case), present, ignore_case)
    return j.select(F.col(ROW), q(name_col), row_sum(names).alias(out))


def project_health_lookup(projects: DataFrame, mapping: DataFrame, ignore_case: bool = False) -> DataFrame:
    return scorecard(projects, mapping, "Project Inventory", [c for c, _ in PROJECT_SCORECARD], "Project Name",
                     "project_health_score", ignore_case)


def pipeline_score_lookup(pipeline: DataFrame, mapping: DataFrame, ignore_case: bool = False) -> DataFrame:
    return scorecard(pipeline, mapping, "Pipeline", [c for c, _ in PIPELINE_SCORECARD], "Account",
                     "pipeline_score", ignore_case).drop(ROW)


def pair_scores(df: DataFrame, mapping: DataFrame, prefix: str, a: str, b: str, name_col: str,
                tab_label: str, ignore_case: bool = False) -> DataFrame:
    """Score of the (effort, tier) pair by composite key ``prefix|a|b``; no hit scores 0."""
    df = _with(df, name_col, a, b)
    k = pair_key(prefix, q(a), q(b))
    rows = df.select(F.lit(tab_label).alias("tab"), q(name_col).alias("name"), k.alias("pair_key"),
                     _norm(k, ignore_case).alias("lookup"))
    j = rows.join(first_key_scores(mapping, ignore_case), "lookup", "left")
    return j.select("tab", "name", "pair_key", F.coalesce(F.col("score"), F.lit(0.0)).alias("efficiency_score"))


def efficiency_scores(projects: DataFrame, pipeline: DataFrame, mapping: DataFrame) -> DataFrame:
    return pair_scores(projects, mapping, "Delivery", "Delivery Relational Effort", "Expansion Yield Tier",
                       "Project Name", "Project Inventory").unionByName(
        pair_scores(pipeline, mapping, "Sales", "Pre-Sales Effort Level", "Revenue Potential Tier",
                    "Account", "Pipeline"))


def weighted_totals(projects: DataFrame, mapping: DataFrame, main_w: float = 0.7, eff_w: float = 0.3) -> DataFrame:
    """Health score (scorecard), efficiency (pair key) and total = 0.7 main + 0.3 efficiency."""
    return _weighted(projects, mapping, "Project Inventory", [c for c, _ in PROJECT_SCORECARD], "Project Name",
                     ("Delivery", "Delivery Relational Effort", "Expansion Yield Tier"),
                     ("project_health_score", "delivery_efficiency_score", "total_project_score"), main_w, eff_w)


def weighted_deal_totals(pipeline: DataFrame, mapping: DataFrame, main_w: float = 0.7, eff_w: float = 0.3) -> DataFrame:
    """Pipeline score (scorecard), relational efficiency (pair key) and total deal score of every opportunity."""
    return _weighted(pipeline, mapping, "Pipeline", [c for c, _ in PIPELINE_SCORECARD], "Account",
                     ("Sales", "Pre-Sales Effort Level", "Revenue Potential Tier"),
                     ("pipeline_score", "relational_efficiency_score", "total_deal_score"), main_w, eff_w)


def _weighted(df: DataFrame, mapping: DataFrame, tab: str, cols, name_col: str, pair, out, main_w: float, eff_w: float) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    df = _with(df, name_col, *pair[1:])
    lean = df.select(F.col(ROW), q(name_col), *[q(c) for c in cols], pair_key(pair[0], q(pair[1]), q(pair[2])).alias("__pair"))
    j, names = _scored(lean, first_value_scores(mapping, tab), cols)
    j = joined_score(j, first_key_scores(mapping), F.col("__pair"), "__eff")
    main, eff = row_sum(names), row_sum(["__eff"])
    return j.select(F.col(ROW), q(name_col), main.alias(out[0]), eff.alias(out[1]), (main * main_w + eff * eff_w).alias(out[2]))


def letter_bands(projects: DataFrame, pipeline: DataFrame, project_letters=PROJECT_LETTERS,
                 pipeline_letters=PIPELINE_LETTERS) -> DataFrame:
    """Health Band / Score Band letters from the score columns (thresholds are arguments)."""
    projects, pipeline = _with(projects, "Project Name"), _with(pipeline, "Account")
    a = projects.select(F.lit("Project Inventory").alias("tab"), q("Project Name").alias("name"),
                        C.number_of(projects, "Project Health Score").alias("score"))
    b = pipeline.select(F.lit("Pipeline").alias("tab"), q("Account").alias("name"),
                        C.number_of(pipeline, "Pipeline Score").alias("score"))
    a = a.withColumn("letter_band", band(F.col("score"), project_letters))
    b = b.withColumn("letter_band", band(F.col("score"), pipeline_letters))
    return a.unionByName(b)


def margin(df: DataFrame, revenue: Column, cost: Column, by) -> DataFrame:
    """(revenue - cost) / revenue per group; null when revenue is 0."""
    g = aggregate(df, by, [Sum("revenue", revenue), Sum("cost", cost)])
    return g.withColumn("margin", F.when(F.col("revenue") != 0,
                                         (F.col("revenue") - F.col("cost")) / F.col("revenue")))
