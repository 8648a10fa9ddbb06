"""Snapshot, export, KPI scorecard / display rows and question routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..session import new_output_path
from ..sources.literal import literal_frame
from ..sources.tabs import ROW, project_existing, q, scan_tab
from ..targets import (DEFAULT_TARGETS, METRIC_CARDS, QUESTION_RULES, SNAPSHOT_DEFAULT_ROWS, SNAPSHOT_ROWS,
                       SNAPSHOT_TEXT_LIMIT, SNAPSHOT_TRUNCATION_MARK, Targets)

NA_CELL = "<NA>"


def row_text(df: DataFrame) -> Column:
    """One snapshot line per row: cells joined by `` | ``, a missing cell shown as ``<NA>``."""
    cols = [c for c in df.columns if c != ROW]
    return F.concat_ws(" | ", *[F.coalesce(q(c).cast("string"), F.lit(NA_CELL)) for c in cols])


def snapshot_cap(name: str, caps=SNAPSHOT_ROWS, default: int | None = SNAPSHOT_DEFAULT_ROWS) -> int | None:
    return dict(caps).get(name, default)


def stored_snapshot(name: str, order: int, columns, cap: int, stored) -> DataFrame:
    """``tab_snapshot`` of a tab whose number of rows and first rows are known (``sources.store.Ranges`` of a stored
    tab, ``sources.store.FirstRows`` of one mapped when read): only rows among the first are worked out in full."""
    spark, n = stored.spark, stored.total
    lines = [(0, f"Sheet: {name}"), (1, "Columns: " + ", ".join(columns))] if n else []
    if n > cap:
        lines.append((cap + 2, f"... (showing top {cap} of {n} rows)"))
    head = literal_frame(spark, lines, [("line_no", "bigint"), ("text", "string")])
    first = project_existing(stored.first(cap), [ROW, *columns]).orderBy(ROW).limit(cap)
    rows = first.select((F.row_number().over(Window.orderBy(ROW)) + 1).cast("bigint").alias("line_no"), row_text(first).alias("text"))  # over at most `cap` rows
    return head.unionByName(rows).select(F.lit(order).alias("tab_order"), F.lit(name).alias("tab"), "line_no", "text")


def tab_snapshot(name: str, order: int, df: DataFrame, cap: int | None) -> DataFrame:
    """Header lines, the first ``cap`` rows in sheet order (None: every row), and a mark when rows were left
    out: (tab_order, tab, line_no, text). An empty tab gives no lines.

    The first rows are found by ``_row`` alone (TakeOrderedAndProject over one column) and only they are read
    in full, by a join with those few. With no cap, line numbers come from a distributed sort, as runs within
    ranges of ``_row`` and offsets over the ranges.
    """
    cols = [c for c in df.columns if c != ROW]
    n = F.col("total")

    def line(cond, no, text):
        return F.when(cond, F.struct(no.cast("bigint").alias("line_no"), text.alias("text")))

    # one count per tab gives the two header lines and, when rows were left out, the mark
    total = df.agg(F.count(F.lit(1)).alias("total"))
    lines = [line(n > 0, F.lit(0), F.lit(f"Sheet: {name}")), line(n > 0, F.lit(1), F.lit("Columns: " + ", ".join(cols)))]
    if cap is not None:
        lines.append(line(n > cap, F.lit(cap + 2), F.format_string(f"... (showing top {cap} of %d rows)", n)))
    head = total.select(F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))
    if cap is None:
        parts = df.select(F.col(ROW), row_text(df).alias("text")).orderBy(ROW).select(ROW, "text", F.spark_partition_id().alias("part"))
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per sort range
        rows = parts.join(offsets, "part").select(
            (F.row_number().over(Window.partitionBy("part").orderBy(ROW)) + F.col("before") + 1).cast("bigint").alias("line_no"), "text")
    else:
        first = df.select(ROW).orderBy(ROW).limit(cap).select((F.row_number().over(Window.orderBy(ROW)) + 1).cast("bigint").alias("line_no"),
                                                              F.col(ROW).alias("__first"))  # over at most `cap` rows
        rows = df.join(first, F.col(ROW) == F.col("__first")).select("line_no", row_text(df).alias("text"))
    return head.unionByName(rows).select(F.lit(order).alias("tab_order"), F.lit(name).alias("tab"), "line_no", "text")


def context_snapshot(tabs, caps=SNAPSHOT_ROWS, default: int | None = SNAPSHOT_DEFAULT_ROWS) -> DataFrame:
    """``tabs`` = [(name, df)] or [(name, df, its first rows)] in load order; lines of every non-empty
    tab. ``caps``: first rows shown by tab, ``default`` for the others, None for whole tabs."""
    out = None
    for i, (name, df, *stored) in enumerate(tabs):
        cap = snapshot_cap(name, caps, default)
        if stored and stored[0] is not None and cap is not None:
            s = stored_snapshot(name, i, [c for c in df.columns if c != ROW], cap, stored[0])
        else:
            s = tab_snapshot(name, i, df, cap)
        out = s if out is None else out.unionByName(s)
    return out


def context_text(snapshot: DataFrame, limit: int = SNAPSHOT_TEXT_LIMIT, mark: str = SNAPSHOT_TRUNCATION_MARK, most: int = 10_000) -> DataFrame:
    """The snapshot as one text, cut at ``limit`` characters with a mark.

    For snapshots capped per tab (a few hundred lines): this one group is put together in one task, so a
    snapshot of more than ``most`` lines (whole tabs) raises; it belongs in files instead.
    """
    lines = F.array_sort(F.collect_list(F.struct("tab_order", "line_no", "text")))
    full = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    t = snapshot.limit(most + 1).agg(full.alias("text"), F.count(F.lit(1)).alias("lines"))
    t = t.select(F.when(F.col("lines") > most, F.raise_error(F.lit(f"a snapshot of more than {most} lines can't be one text")).cast("string")).otherwise(F.col("text")).alias("full"))
    n = F.length("full")
    return t.select(n.cast("bigint").alias("snapshot_chars"), (n > limit).alias("truncated"),
                    F.when(n > limit, F.concat(F.substring("full", 1, limit), F.lit(mark)))
                    .otherwise(F.col("full")).alias("context_text"))


def export_csv(df: DataFrame, path: str) -> str:
    """Whole tab as CSV with a header, in sheet order and without ``_row``; a quote within a cell is doubled."""
    out = df.orderBy(ROW).drop(ROW) if ROW in df.columns else df
    (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def export_slug(tab: str) -> str:
    return tab.lower().replace(" ", "_")


def export_roundtrip(spark: SparkSession, tab: str, df: DataFrame) -> DataFrame:
    """Write the tab under the shared folder and read it back as text."""
    path = export_csv(df, new_output_path(spark, export_slug(tab)))
    back = scan_tab(spark, path, "csv", multiline=True)  # free-text cells may hold line breaks
    return back


# -- KPI presentation -------------------------------------------------------

def scorecard_rows(t: Targets = DEFAULT_TARGETS):
    """(indicator, value column, target, percent column, verdict below target)."""
    return (
        ("revenue", "total_revenue", t.revenue, "revenue_vs_target_pct", "warning"),
        ("pipeline_coverage", "pipeline_coverage_ratio", t.coverage, "pipeline_coverage_vs_target_pct", "warning"),
        ("green_project_ratio", "green_project_ratio", t.green_ratio, "green_project_ratio_vs_target_pct", "danger"),
        ("customer_nps", "avg_customer_nps", t.nps, "customer_nps_vs_target_pct", "warning"),
        ("employee_pulse", "avg_employee_pulse_score", t.pulse, "employee_pulse_vs_target_pct", "warning"),
    )


def scorecard_verdicts(kpis: DataFrame, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """Long rows (indicator, value, target, pct_of_target, verdict) from the one-row KPI frame."""
    rows = [F.struct(F.lit(i).alias("indicator"), F.col(v).cast("double").alias("value"),
                     F.lit(float(tg)).alias("target"), F.col(p).alias("pct_of_target"),
                     F.when(F.col(p) >= 100, F.lit("good")).otherwise(F.lit(bad)).alias("verdict"))
            for i, v, tg, p, bad in scorecard_rows(t)]
    return kpis.select(F.inline(F.array(*rows)))


def target_text(t: Targets, name: str, form: str) -> str:
    value = getattr(t, name)
    return f"${value:,.0f}" if form == "cur" else f"{value * 100:.1f}%" if form == "pct100" else str(value)


def _part(p, t: Targets) -> Column:
    kind = p[0]
    if kind == "lit":
        return F.lit(p[1])
    if kind == "target":
        return F.lit(target_text(t, p[1], p[2]))
    c = F.col(p[1])
    if kind == "cur":
        return C.format_currency(c)
    if kind == "pct":
        return C.format_percentage(c)
    if kind == "pct100":
        return C.format_percentage(c * 100.0)
    if kind == "num":
        return C.format_num(c, p[2])
    return c.cast("string")


def kpi_display(kpis: DataFrame, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """(card_no, page, label, value_text, delta_text) for every metric card, in page order."""
    rows = [F.struct(F.lit(i).alias("card_no"), F.lit(page).alias("page"), F.lit(label).alias("label"),
                     F.concat(*[_part(p, t) for p in value]).alias("value_text"),
                     (F.concat(*[_part(p, t) for p in delta]) if delta else F.lit("")).alias("delta_text"))
            for i, (page, label, value, delta) in enumerate(METRIC_CARDS)]
    return kpis.select(F.inline(F.array(*rows)))


def route_questions(questions: DataFrame, kpis: DataFrame) -> DataFrame:
    """First matching keyword rule answers from the KPIs; no rule -> null (left to a model).

    ``kpis`` is a global aggregate (one row), broadcast to every question.
    """
    qn = F.lower(C.strip("question"))
    rule, answer = None, None
    texts = {
        "total_revenue": F.concat(F.lit("Total revenue is "), C.format_currency(F.col("total_revenue")), F.lit(".")),
        "red_project_count": F.concat(F.lit("There are "), C.format_num(F.col("red_projects_count"), 0),
                                      F.lit(" red projects.")),
    }
    for rid, phrase, any_of in QUESTION_RULES:
        cond = qn.contains(phrase)
        if any_of:
            alt = None
            for a in any_of:
                alt = qn.contains(a) if alt is None else (alt | qn.contains(a))
            cond = cond & alt
        rule = F.when(cond, F.lit(rid)) if rule is None else rule.when(cond, F.lit(rid))
        answer = F.when(cond, texts[rid]) if answer is None else answer.when(cond, texts[rid])
    j = questions.crossJoin(F.broadcast(kpis.select("total_revenue", "red_projects_count")))
    return j.select("question_id", "question", rule.alias("rule"), answer.alias("answer"))
