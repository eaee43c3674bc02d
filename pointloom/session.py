"""The session that tests and local runs use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("pointloom")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus if isinstance(cpus, int) else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
