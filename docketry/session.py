"""The session that tests, the benchmark and ad-hoc use share."""

import os

from pyspark.sql import SparkSession


def session(app: str = "docketry", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the settings come from spark-submit and this only fixes the time zone."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if "PYSPARK_GATEWAY_PORT" not in os.environ and SparkSession.getActiveSession() is None:  # not under spark-submit
        local = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
        builder = builder.master(f"local[{cpus}]").config(map=local)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
