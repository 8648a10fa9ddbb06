"""Targets, score bands and other fixed values.

Everything here is a literal that Catalyst folds into the expressions that
use it. Jobs take a ``Targets`` instance as an argument so a caller can run
the same bundle against other goals without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the business definitions they stand for)
# ---------------------------------------------------------------------------
# FY targets
REVENUE_TARGET = 15_000_000.0
REVENUE_STRETCH_GOAL = 20_000_000.0
GREEN_PROJECT_TARGET = 0.90
EMPLOYEE_PULSE_TARGET = 8.0
CUSTOMER_NPS_TARGET = 50.0
PIPELINE_COVERAGE_TARGET = 3.0
SPONSOR_CHECKIN_WINDOW_DAYS = 30
NEXT_DEAL_DISCUSSION_THRESHOLD_DAYS = 30

# Score bands: name -> (low, high), both ends inclusive, first match wins.
PROJECT_SCORE_BANDS = (
    ("Excellent", 85.0, 100.0),
    ("Strong", 70.0, 84.99),
    ("Weak", 0.0, 69.99),
)
PIPELINE_SCORE_BANDS = (
    ("Strong", 70.0, 100.0),
    ("Medium", 40.0, 69.99),
    ("Weak", 0.0, 39.99),
)

# Utilization thresholds (percent) of the team KPIs.
EXEC_OVER_UTILIZED = 70.0
DELIVERY_UNDER_UTILIZED = 70.0
DELIVERY_OVER_UTILIZED = 100.0

# Snapshot caps: rows kept per tab, and the text limit of a snapshot.
SNAPSHOT_ROWS = (("Project Inventory", 50), ("Pipeline", 50), ("Project Risks", 30))
SNAPSHOT_DEFAULT_ROWS = 15
SNAPSHOT_TEXT_LIMIT = 100_000
SNAPSHOT_TRUNCATION_MARK = "\n... (data truncated)"

# Tabs of one workbook load, in load order.
TAB_NAMES = (
    "Project Inventory", "Project Risks", "Pipeline", "Team Utilization",
    "Talent Gaps", "Operational Gaps", "Executive Activity",
    "Scenario Model Inputs", "Do Nothing Scenario", "Proposed Scenario",
    "Scenario Comparison", "MappingTable", "Project Observations",
)

# Scenario model: assumption labels in input order, with their defaults.
SCENARIO_LABELS = (
    "VP Hourly Selling Value",
    "VP Hours Weekly on Delivery",
    "Head of Delivery Hourly Strategic Delivery Value",
    "Head of Delivery Weekly Tactical Delivery Hours",
    "Avg. Project Size",
    "Sales Conversion Rate (%)",
    "Avg. Cost of Turnover per Senior Employee",
    "% Projects at Risk",
    "Revenue at Risk due to troubled projects",
    "Work Weeks in a year",
    "Cost of Chief of Staff Salary",
)
SCENARIO_DEFAULTS = {"Work Weeks in a year": 50.0, "Cost of Chief of Staff Salary": 100_000.0}

# Scenario result categories in display order.
SCENARIO_CATEGORIES = (
    "Lost Sales (VP involvement)",
    "Strategic Loss (Head of Delivery Role)",
    "Project Recovery Costs",
    "Employee Turnover Impact",
    "Regained VP Selling Time",
    "Strategic Delivery Capacity Recovered",
    "Project Health Improvement",
    "Improved Retention",
    "Cost of Chief of Staff Salary",
    "Total Negative Impact",
    "Total Positive Impact",
)

# Scorecard columns and their option lists, in sheet order.
PROJECT_SCORECARD = (
    ("Timeline Health", ("On Track", "Minor Delays", "Major Delays", "Off Track")),
    ("Budget and Scope", ("On Track", "Some Risk", "Over Budget/Scope Creep")),
    ("Client Relationship Strength", ("Strong Champion", "Supportive Team", "Neutral", "Challenging", "Deteriorating")),
    ("Feedback Recency", ("<2 weeks", "<1 month", "1-2 months", ">2 months", "Never")),
    ("Business Outcome Defined", ("Clearly Defined", "Partially Defined", "Vague", "None")),
    ("Team Resourcing", ("Yes", "Some Gaps", "Understaffed", "Misaligned", "No Core Team")),
    ("Strategic Value to Client", ("High", "Medium", "Low")),
    ("Issue Resolution Hygiene", ("Yes", "Partially", "No Process")),
    ("Expansion Discussion", ("Already in Motion", "Planned", "Mentioned", "No")),
    ("Exec Engagement", ("Yes (Executive Sponsor)", "Occasionally", "Rarely", "Not at All")),
)
PIPELINE_SCORECARD = (
    ("Roadmap Alignment", ("Yes", "Strongly Aligned", "Early Draft", "In Discussion", "No")),
    ("Sponsor Type", ("Executive Business Sponsor", "Director-level Business Sponsor", "IT Sponsor", "Influencer Only", "None")),
    ("Business Case_ROI", ("Quantified + Signed Off", "Quantified Only", "Draft in Progress", "Discussed Conceptually", "None")),
    ("HCLS Expertise needed", ("Mission Critical", "Strongly Beneficial", "Helpful", "Somewhat Useful", "Not Needed")),
    ("Executor Pool Size", ("5+ Qualified", "3-4 Qualified", "2 Qualified", "1 Qualified", "None")),
    ("Snowflake Investment Level", ("Strategic Platform", "Multi-Domain Strategic", "Key Use Case", "Trial Project", "Not at All")),
    ("IBM Growth in Account", ("Growing", "Slightly Growing", "Neutral", "Slightly Shrinking", "Shrinking")),
    ("Snowflake Growth in Account", ("Growing", "Slightly Growing", "Neutral", "Slightly Shrinking", "Shrinking")),
)
EFFORT_LEVELS = ("Low", "Medium", "High")

# Metric cards in page order: (page, label, value parts, delta parts). Parts: ("cur"|"pct"|"pct100"|"int", KPI),
# ("num", KPI, decimals), ("lit", text), ("target", Targets field, "cur"|"pct100"|"plain").
METRIC_CARDS = (
    ("home", "Total Revenue", (("cur", "total_revenue"),), (("pct", "revenue_vs_target_pct"), ("lit", " of target"))),
    ("home", "Pipeline Coverage", (("num", "pipeline_coverage_ratio", 1), ("lit", "x")),
     (("pct", "pipeline_coverage_vs_target_pct"), ("lit", " of target"))),
    ("home", "Green Project Ratio", (("pct100", "green_project_ratio"),),
     (("pct", "green_project_ratio_vs_target_pct"), ("lit", " of target"))),
    ("home", "Avg. Customer NPS", (("num", "avg_customer_nps", 1),), (("pct", "customer_nps_vs_target_pct"), ("lit", " of target"))),
    ("home", "FY Revenue", (("cur", "total_revenue"),), (("target", "revenue", "cur"), ("lit", " target"))),
    ("home", "Customer NPS (Avg)", (("num", "avg_customer_nps", 1),), (("target", "nps", "plain"), ("lit", " target"))),
    ("home", "Employee Pulse (Avg)", (("num", "avg_employee_pulse_score", 1),), (("target", "pulse", "plain"), ("lit", " target"))),
    ("home", "Active Pipeline Value", (("cur", "active_pipeline_value"),),
     (("num", "pipeline_coverage_ratio", 1), ("lit", "x coverage"))),
    ("home", "Avg. Deal Cycle", (("num", "avg_deal_cycle_time_days", 0), ("lit", " days")),
     (("lit", "Median: "), ("num", "median_deal_cycle_time_days", 0), ("lit", " days"))),
    ("home", "Green Project Ratio", (("pct100", "green_project_ratio"),), (("target", "green_ratio", "pct100"), ("lit", " target"))),
    ("home", "Recent Sponsor Check-ins",
     (("num", "recent_meaningful_checkins_count", 0), ("lit", " ("), ("pct", "recent_meaningful_checkins_pct"), ("lit", ")")),
     (("int", "overdue_sponsor_checkin_count"), ("lit", " overdue"))),
    ("home", "High Severity Risks", (("num", "high_severity_risk_count", 0),),
     (("cur", "high_severity_risk_impact"), ("lit", " impact"))),
    ("home", "Avg. Delivery Utilization", (("pct", "avg_delivery_utilization_pct"),),
     (("int", "under_utilized_delivery_count"), ("lit", " under-utilized"))),
    ("projects", "Total Projects", (("num", "total_projects", 0),), ()),
    ("projects", "Red Projects", (("num", "red_projects_count", 0),), (("cur", "red_project_revenue"), ("lit", " at risk"))),
    ("projects", "Avg. Health Score", (("num", "avg_project_health_score", 1),),
     (("lit", "Median: "), ("num", "median_project_health_score", 1))),
    ("projects", "Avg. Total Score", (("num", "avg_total_project_score", 1),),
     (("lit", "Median: "), ("num", "median_total_project_score", 1))),
    ("projects", "Recent Meaningful Check-ins (last 30 days)",
     (("num", "recent_meaningful_checkins_count", 0), ("lit", " ("), ("pct", "recent_meaningful_checkins_pct"), ("lit", ")")), ()),
    ("projects", "Projects Overdue for Sponsor Check-in", (("int", "overdue_sponsor_checkin_count"),), ()),
    ("pipeline", "Active Pipeline Value", (("cur", "active_pipeline_value"),), ()),
    ("pipeline", "Total Potential Value", (("cur", "total_potential_pipeline_value"),), ()),
    ("pipeline", "Pipeline Coverage Ratio", (("num", "pipeline_coverage_ratio", 1), ("lit", "x")), ()),
    ("pipeline", "Avg. Pipeline Score", (("num", "avg_pipeline_score", 1),), (("lit", "Median: "), ("num", "median_pipeline_score", 1))),
    ("pipeline", "Avg. Deal Cycle Time", (("num", "avg_deal_cycle_time_days", 0), ("lit", " days")), ()),
    ("pipeline", "Median Deal Cycle Time", (("num", "median_deal_cycle_time_days", 0), ("lit", " days")), ()),
    ("pipeline", "Avg. Next Deal Gap (after project end)", (("num", "avg_next_deal_gap_days", 0), ("lit", " days")), ()),
    ("pipeline", "Projects Overdue for Next Deal Discussion", (("int", "overdue_next_deal_discussion_count"),), ()),
    ("risks", "Total Risk Impact", (("cur", "total_risk_impact"),), ()),
    ("risks", "High Severity Risk Items", (("num", "high_severity_risk_count", 0),), ()),
    ("risks", "High Severity Risk Impact", (("cur", "high_severity_risk_impact"),),
     (("pct", "high_risk_impact_as_pct_of_total"), ("lit", " of total impact"))),
    ("team", "Avg. Executive Utilization", (("pct", "avg_exec_utilization_pct"),),
     (("int", "over_utilized_execs_count"), ("lit", " execs >70%"))),
    ("team", "Avg. Delivery Utilization", (("pct", "avg_delivery_utilization_pct"),),
     (("int", "under_utilized_delivery_count"), ("lit", " under (<70%), "), ("int", "over_utilized_delivery_count"), ("lit", " over (>100%)"))),
    ("team", "Average Employee Pulse Score", (("num", "avg_employee_pulse_score", 1),),
     (("pct", "employee_pulse_vs_target_pct"), ("lit", " of target"))),
    ("team", "Total Strategic Cost (from Exec Activity)", (("cur", "total_strategic_cost"),), ()),
    ("team", "Total Strategic Activities Logged", (("num", "total_strategic_activities_count", 0),), ()),
)

# Upcoming events: (kind, tab, name column, date column, text before the name, between, after the date).
UPCOMING_EVENTS = (
    ("project_end", "Project Inventory", "Project Name", "Project End Date", "- Project '", "' is scheduled to end on ", "."),
    ("deal_close", "Pipeline", "Account", "Closed Won Date", "- Deal for '", "' is scheduled to close (won) on ", "."),
    ("next_touchpoint", "Pipeline", "Account", "Next Touchpoint Date", "- Next touchpoint for '", "' is scheduled on ", "."),
)
NO_EVENTS_TEXT = "No key dates identified in the next 7 days."
# Marks after a text cut at the limit: for questions, for the digest.
SNAPSHOT_DIGEST_MARK = "\n... (data truncated for brevity)"

# Questions answered without a model: (rule id, phrase, any-of phrases).
QUESTION_RULES = (
    ("total_revenue", "total revenue", ()),
    ("red_project_count", "red project", ("count", "how many")),
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Targets:
    revenue: float = REVENUE_TARGET
    revenue_stretch: float = REVENUE_STRETCH_GOAL
    green_ratio: float = GREEN_PROJECT_TARGET
    pulse: float = EMPLOYEE_PULSE_TARGET
    nps: float = CUSTOMER_NPS_TARGET
    coverage: float = PIPELINE_COVERAGE_TARGET
    checkin_window_days: int = SPONSOR_CHECKIN_WINDOW_DAYS
    next_deal_threshold_days: int = NEXT_DEAL_DISCUSSION_THRESHOLD_DAYS
    project_bands: tuple = field(default=PROJECT_SCORE_BANDS)
    pipeline_bands: tuple = field(default=PIPELINE_SCORE_BANDS)


DEFAULT_TARGETS = Targets()
