"""Connected components of links between long ids, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that ``links`` (a, b) reach from each id they name.

    In every round an id takes the smallest label among itself and its neighbours, then
    the label of that label; the second step halves long chains, so the number of rounds
    grows with the logarithm of their length. A hub's neighbours are reduced to one
    minimum before the shuffle.
    """
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                        .union(links.select("b", "a")).distinct())
    labels = written(both.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = (both.join(labels, F.col("v") == F.col("id")).groupBy("u")
                .agg(F.min("component").alias("near")))
        hooked = written(labels.join(near, F.col("id") == F.col("u")).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("now")))
        jump = hooked.select(F.col("id").alias("at"), F.col("now").alias("next"))
        new = written(hooked.join(jump, F.col("now") == F.col("at")).select(
            "id", "was", F.least("now", "next").alias("component")))
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels
