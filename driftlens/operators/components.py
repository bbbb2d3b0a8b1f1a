"""Connected components without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.sources.tables import cut


def connected(ties: DataFrame) -> DataFrame:
    """ties (item, tie): items with a common tie are connected. Returns item, component (its smallest item).

    Every round sends each item's label to its ties and back, and lets labels jump to their own labels, so the number of rounds
    grows with the logarithm of a component's length.
    """
    ties = cut(ties.select("item", "tie").distinct())
    labels = cut(ties.select("item").distinct().withColumn("component", F.col("item")))
    while True:
        low = ties.join(labels, "item").groupBy("tie").agg(F.min("component").alias("low"))
        near = ties.join(low, "tie").groupBy("item").agg(F.min("low").alias("near"))
        jump = labels.select(F.col("item").alias("near"), F.col("component").alias("lower"))
        moved = cut(labels.join(near, "item").join(jump, "near").select("item", F.least("near", "lower", "component").alias("new"), "component"))
        if moved.where("new <> component").limit(1).count() == 0:
            return moved.select("item", "component")
        labels = moved.select("item", F.col("new").alias("component"))
