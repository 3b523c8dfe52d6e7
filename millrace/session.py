"""Session settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.legacy.javaCharsets": "true",  # EUC_JP of COPY
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session for one machine: tests, the bench and interactive use."""
    b = SparkSession.builder.master(master).appName("millrace").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)
