"""A session with the settings that the engine's plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local by default; on a cluster, spark-submit's master and settings take precedence over these."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
