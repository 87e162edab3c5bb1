"""A session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    """Adaptive plans and UTC; ``partitions`` only for small local runs, clusters set their own."""
    b = SparkSession.builder.master(master).appName("graphloom")
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (conf | more).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
