"""Project-staff membership join.

The reference tests every staff list against every project (nested loops).
Here each staff row's comma list is exploded once into (project, staff)
links, links to projects that are not asked for are dropped by a semi join, the
rest are aggregated per project name and joined to the active projects. The
member text of one project is one output cell, so it is put together in one
task; ``staff_links`` gives the long form for teams of any size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.exact import FAR, Sum, aggregate
from ..sources.tabs import ROW, q
from .kpis import active_cond, project_frame, staff_frame

PROJECT_COLS = ("Project Name", "Client", "Status (R/Y/G)", "Team Resourcing", "Project End Date")


def staff_links(staff: DataFrame) -> DataFrame:
    """One row per (project name, staff row); a name repeated in one list counts once."""
    sf = staff_frame(staff)
    if "Project Assignments" not in sf.columns or "Employee Name" not in sf.columns:
        return sf.sparkSession.createDataFrame(
            [], f"project string, {ROW} bigint, name string, util double, pulse double, {FAR} boolean")
    links = sf.select(F.explode(C.split_list(q("Project Assignments"))).alias("project"),
                      F.col(ROW), q("Employee Name").alias("name"),
                      F.col("__util").alias("util"), F.col("__pulse").alias("pulse"), FAR)
    return links.where(F.col("project") != "")


def teams(staff: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Team per project name (of ``names``: column project; None: all): size, members in sheet order, exact
    sums of utilization and pulse."""
    links = staff_links(staff)
    if names is not None:
        links = links.join(names, "project", "left_semi")
    return aggregate(links, ("project",), [
        F.count(F.lit(1)).alias("team_size"), Sum("util_sum", F.col("util")), Sum("pulse_sum", F.col("pulse")),
        F.sort_array(F.collect_list(F.struct(F.col(ROW), F.col("name")))).alias("members"),
    ])


def staffing_health(projects: DataFrame, staff: DataFrame, as_of: dt.date,
                    client: str | None = None, resourcing: str | None = None) -> DataFrame:
    """Active projects with their team. ``client`` / ``resourcing`` filter (None = All);
    a missing resourcing cell is matched by ``N/A``."""
    if not all(c in projects.columns for c in PROJECT_COLS):
        return projects.sparkSession.createDataFrame([], "`Project Name` string")
    pf = project_frame(projects)
    active = pf.where(active_cond(as_of))
    if client is not None:
        active = active.where(q("Client") == client)
    if resourcing is not None:
        active = active.where(F.coalesce(q("Team Resourcing"), F.lit("N/A")) == resourcing)
    t = teams(staff, active.select(q("Project Name").alias("project")).distinct())
    j = active.join(t, active["`Project Name`"] == t["project"], "left")
    size = F.coalesce(F.col("team_size"), F.lit(0).cast("bigint"))
    members = F.array_join(F.transform(F.col("members"), lambda m: m["name"]), ", ")
    return j.select(
        q("Project Name"), q("Client"), q("Status (R/Y/G)"), q("Team Resourcing"),
        size.alias("Assigned Team Size"),
        F.when(size > 0, members).otherwise(F.lit("N/A")).alias("Assigned Team Members"),
        F.when(size > 0, F.col("util_sum") / size).otherwise(F.lit(0.0)).alias("Avg. Team Utilization %"),
        F.when(size > 0, F.col("pulse_sum") / size).otherwise(F.lit(0.0)).alias("Avg. Team Pulse Score"),
        C.date_text(F.col("__end")).alias("Project End Date"),
    )
