"""A session with the settings that the library is tested with; any other session works as well."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
