"""Session factory: adaptive execution on, UTC, Arrow for the few Python functions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one.  On a cluster leave ``master`` to spark-submit; sizes of partitions are left to
    adaptive execution, which merges small and splits skewed ones."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    Where the package is installed on the workers, or sent with the job, this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
