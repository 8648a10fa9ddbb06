"""Band distributions, histograms (equal widths or round edges) and impact by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.bands import NA, band
from ..functions.exact import FAR, Sum, aggregate
from ..functions.stats import count_if
from ..sources.tabs import ROW, q
from ..targets import PIPELINE_SCORE_BANDS, PROJECT_SCORE_BANDS
from .kpis import pipeline_frame, project_frame, risk_frame

PROJECT_SCORES = (("project_health_score", "Project Health Score", "__health"),
                  ("total_project_score", "Total Project Score", "__total"))
PIPELINE_SCORES = (("pipeline_score", "Pipeline Score", "__pscore"),
                   ("total_deal_score", "Total Deal Score", "__tscore"))


def _band_family(label: str, score: Column, bands, i0: int):
    """Counts per band (one pass) and the long rows built from them."""
    b = band(score, bands)
    names = [n for n, _, _ in bands] + [NA]
    aliases = [f"__{label}_{i}" for i in range(len(names))]
    aggs = [count_if(b == n).alias(a) for n, a in zip(names, aliases)]
    valid = None
    for a in aliases[:-1]:
        valid = F.col(a) if valid is None else valid + F.col(a)
    rows = []
    for i, (n, a) in enumerate(zip(names, aliases)):
        if n == NA:
            pct = F.lit(None).cast("double")
        else:
            pct = F.when(valid > 0, F.col(a) / valid * 100.0).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(label).alias("score_name"), F.lit(n).alias("band"), F.lit(i).alias("band_order"),
                             F.col(a).alias("band_count"), pct.alias("band_pct")))
    return aggs, rows


def band_distribution(df: DataFrame, scores, bands, by=()) -> DataFrame:
    """Long rows (score_name, band, band_order, band_count, band_pct) for each score.

    Percent is over banded rows only; every band is present even with 0 rows;
    ``N/A`` is counted but has no percent. All scores share one scan.
    """
    aggs, rows = [], []
    for label, raw, typed in scores:
        if raw not in df.columns:
            continue
        a, r = _band_family(label, F.col(typed), bands, len(rows))
        aggs += a
        rows += r
    g = df.groupBy(*[q(b) for b in by]) if by else df.groupBy()
    if not aggs:
        return g.agg(F.count(F.lit(1)).alias("__n")).where(F.lit(False)).select(
            *[q(b) for b in by], F.lit(None).cast("string").alias("score_name"))
    return g.agg(*aggs).select(*[q(b) for b in by], F.inline(F.array(*rows)))


def project_score_bands(projects: DataFrame, bands=PROJECT_SCORE_BANDS, by=()) -> DataFrame:
    return band_distribution(project_frame(projects), PROJECT_SCORES, bands, by)


def pipeline_score_bands(pipeline: DataFrame, bands=PIPELINE_SCORE_BANDS, by=()) -> DataFrame:
    return band_distribution(pipeline_frame(pipeline), PIPELINE_SCORES, bands, by)


def score_bands_rows(projects: DataFrame, bands=PROJECT_SCORE_BANDS) -> DataFrame:
    """Band label of every project for both of its scores (a narrow projection, no shuffle)."""
    pf = project_frame(projects)
    return pf.select(
        F.col(ROW), q("Project Name"),
        F.col("__health").alias("project_health_score"), band(F.col("__health"), bands).alias("health_band"),
        F.col("__total").alias("total_project_score"), band(F.col("__total"), bands).alias("total_band"),
    )


def _long(df: DataFrame, scores) -> tuple[DataFrame, DataFrame] | None:
    """(score_name, x) of every row and score, and (score_name, mn, mx) of the scores that have any cell."""
    present = [(label, raw, typed) for label, raw, typed in scores if raw in df.columns]
    if not present:
        return None
    pairs = F.array(*[F.struct(F.lit(label).alias("score_name"), F.col(typed).alias("x"), q(raw).isNotNull().alias("raw_present")) for label, raw, typed in present])
    long = df.select(F.inline(pairs))
    stats = long.groupBy("score_name").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), count_if(F.col("raw_present")).alias("n_raw"))
    return long, stats.where(F.col("n_raw") > 0)


def _edge(i: str) -> str:
    """Lower edge of bin number ``i`` at width m * 10^d, the double nearest to it."""
    return f"IF(d >= 0, {i} * m * pow(10D, d), {i} * m / pow(10D, -d))"


def _place(x: str) -> str:
    """Number of the bin that holds ``x``: the quotient, put right where its rounding crossed an edge."""
    i = f"floor(IF(d >= 0, {x} / (m * pow(10D, d)), {x} * pow(10D, -d) / m))"
    return f"({i} + CASE WHEN {_edge(f'({i} + 1)')} <= {x} THEN 1 WHEN {_edge(i)} > {x} THEN -1 ELSE 0 END)"


def round_histogram(df: DataFrame, scores, bins: int = 10) -> DataFrame:
    """Histogram with round edges: of the widths 1, 2 and 5 times a power of ten the smallest that covers min
    to max of the score with at most ``bins`` bins, whose edges are multiples of the width. A bin holds its
    lower edge; empty bins have no row. (score_name, bin, bin_low, bin_high, bin_count), bins numbered from 0."""
    if bins < 2:
        raise ValueError("round edges need at least two bins: values on both sides of an edge lie in two")
    parts = _long(df, scores)
    if parts is None:
        return df.sparkSession.createDataFrame([], "score_name string, bin int, bin_low double, bin_high double, bin_count bigint")
    long, stats = parts
    power = "IF(mx > mn, cast(floor(log10((mx - mn) / {0})) AS int), 0)".format(bins)
    widths = ", ".join(f"named_struct('m', {m}D, 'd', {power} + {k})" for k in (-1, 0, 1, 2) for m in (1, 2, 5))
    # a single value has a bin of width 1
    fits = stats.select("*", F.expr(f"inline(IF(mx > mn, array({widths}), array(named_struct('m', 1D, 'd', 0))))"))
    fits = fits.withColumns({"low": F.expr(_place("mn")), "high": F.expr(_place("mx"))}).where((F.col("high") - F.col("low") < bins))
    chosen = fits.groupBy("score_name").agg(F.min(F.struct("d", "m", "low")).alias("w")).select("score_name", "w.*")  # one row a score
    g = long.join(F.broadcast(chosen), "score_name").groupBy("score_name", "m", "d", "low", F.expr(_place("x")).alias("i")).agg(F.count(F.lit(1)).alias("bin_count"))
    return g.select("score_name", (F.col("i") - F.col("low")).cast("int").alias("bin"), F.expr(_edge("i")).alias("bin_low"), F.expr(_edge("(i + 1)")).alias("bin_high"), "bin_count")


def score_round_histogram(projects: DataFrame, pipeline: DataFrame, bins: int = 10) -> DataFrame:
    """The four score histograms with round edges."""
    return round_histogram(project_frame(projects), PROJECT_SCORES, bins).unionByName(round_histogram(pipeline_frame(pipeline), PIPELINE_SCORES, bins))


def histogram(df: DataFrame, scores, bins: int = 10) -> DataFrame:
    """Equal-width histogram with ``bins`` bins between min and max of each score.

    One row per score and value goes through a single aggregation; the
    min/max per score is a tiny aggregate (one row per score name, a fixed
    literal list) joined back by broadcast.
    """
    parts = _long(df, scores)
    if parts is None:
        return df.sparkSession.createDataFrame(
            [], "score_name string, bin int, bin_low double, bin_high double, bin_count bigint")
    long, stats = parts
    j = long.join(F.broadcast(stats), "score_name")
    x, mn, mx = F.col("x"), F.col("mn"), F.col("mx")
    b = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor((x - mn) / (mx - mn) * float(bins)), F.lit(bins - 1))).cast("int")
    g = j.groupBy("score_name", "mn", "mx", b.alias("bin")).agg(F.count(F.lit(1)).alias("bin_count"))
    width = (F.col("mx") - F.col("mn"))
    return g.select(
        "score_name", "bin",
        (F.col("mn") + width * F.col("bin") / float(bins)).alias("bin_low"),
        (F.col("mn") + width * (F.col("bin") + 1) / float(bins)).alias("bin_high"),
        "bin_count",
    )


def score_histogram(projects: DataFrame, pipeline: DataFrame, bins: int = 10) -> DataFrame:
    """The four score histograms (two over projects, two over pipeline)."""
    return histogram(project_frame(projects), PROJECT_SCORES, bins).unionByName(
        histogram(pipeline_frame(pipeline), PIPELINE_SCORES, bins))


def risk_by_severity(risks: DataFrame) -> DataFrame:
    """Total impact and count per severity label (``High``, ``Medium``, ..., ``Unknown``)."""
    rf = risk_frame(risks)
    sev = C.severity_label(q("Severity")) if "Severity" in rf.columns else F.lit("Unknown")
    rows = rf.select(sev.alias("severity"), "__impact", *[c for c in rf.columns if c == FAR])  # a tab mapped when read has no stored mark
    return aggregate(rows, ("severity",), [Sum("total_impact", F.col("__impact")), F.count(F.lit(1)).alias("risk_count")])
