"""Connected components by the least label around, with labels of labels; loops on small tables that two executors hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.session import hold

#: Labels are made by so many tasks, or by one for each LINKS links.
TASKS, LINKS = 8, 20_000


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for links (a, b): label is the least node that can be reached. Only nodes with links are named.

    Each round takes the least label of the neighbours, then the label of that label, so the number of rounds grows with the logarithm
    of a component's width. A hub's links are reduced before they are shuffled by it.
    """
    both = hold(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    parts = max(TASKS, math.ceil(both.count() / LINKS))
    labels = hold(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")).coalesce(parts))
    before = None
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        of_label = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = hold(step.join(of_label, "label", "left").select("node", F.coalesce("up", "label").alias("label")).coalesce(parts))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == before:
            return labels
        before = now
