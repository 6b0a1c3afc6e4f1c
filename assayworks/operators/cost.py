"""What assurance costs: seconds per scenario and probe category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The scenarios, the category of a row without one, and the categories in
# the order of the report.
SCENARIOS = ["CC", "PC", "EC", "IC", "NC"]
NO_CATEGORY = "Pipeline"
CATEGORIES = [
    "Pipeline", "General purpose probe", "Pipeline probe", "Service probe", "Task probe",
]


def scenario_cost(timings: DataFrame, scenarios: Sequence[str] = SCENARIOS,
                  categories: Sequence[str] = CATEGORIES, category: str = "probe_type",
                  seconds: str = "seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Seconds per scenario (rows) and probe category (columns).

    A row counts in a scenario when its flag of that name is true; rows without category
    count as ``Pipeline``. ``keys`` keeps several pipelines apart.
    """
    labelled = timings.fillna(NO_CATEGORY, [category])
    # One aggregate per (scenario, category): a single shuffle of one row per key and task,
    # before the scenarios are turned into rows.
    cells = [
        F.coalesce(
            F.sum(F.when(F.col(category) == cat, F.col(flag).cast("double") * F.col(seconds))),
            F.lit(0.0),
        ).alias(f"{flag}|{cat}")
        for flag in scenarios for cat in categories
    ]
    totals = labelled.groupBy(*keys).agg(*cells)
    rows = F.explode(F.array(*[
        F.struct(F.lit(flag).alias("scenario"),
                 *[F.col(f"`{flag}|{cat}`").alias(cat) for cat in categories])
        for flag in scenarios
    ]))
    return totals.select(*keys, rows.alias("row")).select(*keys, "row.*")
