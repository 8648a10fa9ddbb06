"""Tabs: declared all-text schemas, scans and the cleaning every tab gets.

A tab is a DataFrame of nullable STRING columns plus ``_row``, the sheet
order supplied by the source (BIGINT, or any orderable value such as a
struct of key columns). ``_row`` is never derived from partition layout.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROW = "_row"

# Column lists of each tab, in sheet order.
TAB_COLUMNS = {
    "Project Inventory": (
        "Project Name", "Client", "Project Start Date", "Project End Date", "Revenue", "Margin",
        "Status (R/Y/G)", "Key Issues", "Next Steps", "Executive Support Required", "eNPS",
        "Next Opp First Discussion Date", "Last Sponsor Checkin Date", "Sponsor Checkin Notes",
        "Timeline Health", "Budget and Scope", "Client Relationship Strength", "Feedback Recency",
        "Business Outcome Defined", "Team Resourcing", "Strategic Value to Client",
        "Issue Resolution Hygiene", "Expansion Discussion", "Exec Engagement",
        "Project Health Score", "Health Band", "Delivery Relational Effort", "Expansion Yield Tier",
        "Delivery Efficiency Score", "Total Project Score",
    ),
    "Project Risks": ("Project Name", "Risk Description", "Severity", "Impact ($)", "Mitigation Plan", "Owner"),
    "Pipeline": (
        "Account", "Opportunity Created Date", "Last Touchpoint Date", "Next Touchpoint Date",
        "Closed Won Date", "Support Focus Type", "Percieved Annual AMO", "Open Pipeline_Active Work",
        "Horizon", "Pursuit Tier", "Notes", "Help Needed", "Actions", "Internal Pursuit Team",
        "Key Client Contacts", "Win Themes", "Known Competitors", "Deal Registered YN",
        "MSA/ICA Status", "Roadmap Alignment", "Sponsor Type", "Business Case_ROI",
        "HCLS Expertise needed", "Executor Pool Size", "Snowflake Investment Level",
        "IBM Growth in Account", "Snowflake Growth in Account", "Pipeline Score", "Score Band",
        "Pre-Sales Effort Level", "Revenue Potential Tier", "Relational Efficiency Score",
        "Total Deal Score",
    ),
    "Team Utilization": (
        "Employee Name", "Role", "Project Assignments", "Utilization (%)", "Billable Rate ($/hr)",
        "Strategic Opportunity Cost ($/week)", "Latest Pulse Score",
    ),
    "Talent Gaps": ("Skill/Role Needed", "Gap Impact (High/Medium/Low)", "Urgency", "Target Hire Date", "Hiring Owner"),
    "Operational Gaps": ("Operational Issue", "Severity (High/Medium/Low)", "Frequency", "Recommended Process/Solution", "Owner"),
    "Executive Activity": ("Activity", "Type (Delivery/Sales/Ops)", "Time Spent Weekly (hrs)", "Strategic Cost ($)", "Delegate to?"),
    "Scenario Model Inputs": ("Assumption", "Value"),
    "Do Nothing Scenario": ("Category", "Calculation Details", "Annualized Impact ($)"),
    "Proposed Scenario": ("Category", "Calculation Details", "Annualized Impact ($)"),
    "Scenario Comparison": ("Scenario", "Total Annualized Impact ($)", "Net Incremental Value ($)"),
    "Sensitivity & Assumption Analysis": (
        "Assumption/Scenario Input", "Base Case", "Sensitivity Range",
        "Financial Impact (Low End)", "Financial Impact (High End)",
    ),
    "Project Observations": ("Date", "Project", "Observation"),
    "MappingTable": ("Tab", "Question", "Value", "Score", "Key"),
}

# Accepted spellings: documented name -> name the jobs use (per tab).
ALIASES = {
    "Project Risks": {"Severity (High/Medium/Low)": "Severity"},
    "Pipeline": {"Perceived Annual AMO": "Percieved Annual AMO", "Deal Registered": "Deal Registered YN"},
}


def tab_schema(tab: str, row_type=LongType()) -> StructType:
    fields = [StructField(c, StringType(), True) for c in TAB_COLUMNS[tab]]
    return StructType(fields + [StructField(ROW, row_type, False)])


def empty_tab(spark: SparkSession, tab: str) -> DataFrame:
    """A missing tab is an empty frame of the declared schema."""
    return spark.createDataFrame([], tab_schema(tab))


def scan_tab(spark: SparkSession, path: str, fmt: str = "parquet", tab: str | None = None,
             row_col: str = ROW, multiline: bool = False) -> DataFrame:
    """Read one tab. CSV is read with a header and no type inference.

    ``row_col`` names the source column that carries sheet order; it is
    renamed to ``_row``. CSV cells are read as text so a cell never changes
    type at load. ``multiline=True`` accepts quoted cells with line breaks,
    but then a file is no longer split across tasks - keep it for exports
    of free-text tabs, not for bulk files.
    """
    r = spark.read
    if fmt == "csv":
        # a quote within a quoted cell is doubled, as spreadsheets and data frames write it
        r = r.option("header", True).option("inferSchema", False).option("multiLine", multiline).option("quote", '"').option("escape", '"')
        r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        df = r.csv(path)
    else:
        df = r.format(fmt).load(path)
    if row_col != ROW and row_col in df.columns:
        df = df.withColumnRenamed(row_col, ROW)
    if ROW in df.columns and dict(df.dtypes)[ROW] == "string":
        df = df.withColumn(ROW, F.col(ROW).cast("bigint"))
    return df


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def apply_aliases(df: DataFrame, tab: str | None) -> DataFrame:
    for old, new in ALIASES.get(tab or "", {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def blank_to_null(df: DataFrame) -> DataFrame:
    """Exact ``''`` becomes null; a whitespace cell stays as it is."""
    cols = [
        F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) if t == "string" and c != ROW else F.col(f"`{c}`")
        for c, t in df.dtypes
    ]
    return df.select(*cols)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    data_cols = [c for c in df.columns if c != ROW]
    if not data_cols:
        return df
    return df.na.drop(how="all", subset=data_cols)


def clean_cells(df: DataFrame, tab: str | None = None) -> DataFrame:
    """``clean_tab`` of a tab that has no all-blank row."""
    return blank_to_null(apply_aliases(trim_headers(df), tab))


def clean_tab(df: DataFrame, tab: str | None = None) -> DataFrame:
    """Header trim, accepted spellings, ``''`` -> null, all-blank rows dropped.

    Rows are dropped before ``''`` becomes null, by one cell after another: the test of a row ends at its first
    filled cell, and a tab with a column that is always filled needs none, so that its scans read no more than
    what a query uses."""
    filled = [q(c) != "" if t == "string" else q(c).isNotNull() for c, t in df.dtypes if c.strip() != ROW]
    return clean_cells(df.where(_any(filled)) if filled else df, tab)


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a tree of little depth: wide tabs have many cells."""
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:]) if half else tests[0]


def with_default(df: DataFrame, col: str, value=None) -> DataFrame:
    """An absent column becomes a constant (None: missing text), so a job degrades instead of failing."""
    if col in df.columns:
        return df
    return df.withColumn(col, value if isinstance(value, Column) else F.lit(value) if value is not None else F.lit(None).cast("string"))


def project_existing(df: DataFrame, cols) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])


def q(c: str) -> Column:
    """Column by a sheet header (headers hold spaces, dots and slashes)."""
    return F.col(f"`{c}`")


def load_tab(spark: SparkSession, path: str, tab: str, fmt: str = "parquet", **kw) -> DataFrame:
    """Scan and clean one tab; where there is no such path, the tab is an empty frame of its schema.
    A file that is there but can't be read raises."""
    try:
        df = scan_tab(spark, path, fmt, tab, **kw)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_tab(spark, tab)
    return clean_tab(df, tab)


def load_workbook(spark: SparkSession, folder: str, fmt: str = "parquet", names=None, **kw) -> dict:
    """All tabs of a workbook folder (one file or folder per tab, named like the CSV export: lower case,
    ``_`` for spaces; ``.csv`` for CSV), as lazy DataFrames in load order."""
    from ..targets import TAB_NAMES

    ext = "" if fmt == "parquet" else f".{fmt}"
    return {n: load_tab(spark, f"{folder.rstrip('/')}/{n.lower().replace(' ', '_')}{ext}", n, fmt, **kw) for n in names or TAB_NAMES}
