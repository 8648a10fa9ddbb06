"""pulseboard: delivery-portfolio analytics as Spark DataFrame jobs.

Layout
------
sources/    tab schemas, scans, cleaning, driver-table mapping, sinks
functions/  Column-level cleaning, formatting, bands, exact aggregates
operators/  the jobs: KPIs, distributions, lists, staffing, scores,
            scenarios, updates, reports
plans/      registered queries (Spark) and their oracle SQL
streaming/  periodic re-run of the KPI bundle on arriving tab snapshots
"""

__all__ = ["targets", "session"]
