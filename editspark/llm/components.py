"""Connected components of a graph of links, by DataFrame joins: the least id reachable from each linked id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_joined, scratch, written

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links(a, b)``; both columns long. The table is written.

    Each round every id takes the least label among its own, its neighbours' and its label's label, so labels spread along
    links and jump along chains of labels at once. Minima are aggregated before they are shuffled, and the joins on a neighbour and on a label, of which one may
    be a hub's or a large component's, are ``hot_joined``. Ends when a round changes nothing.
    """
    with scratch(links.sparkSession) as kept:
        both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
        labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
        for _ in range(MOST_ROUNDS):
            near = hot_joined(both, labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
            jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
            new = hot_joined(labels.join(near, "id"), jump, "component", "left")
            new = written(new.select("id", F.least("component", "near", "jump").alias("component"), F.col("component").alias("old")), "labels")
            if new.filter("component <> old").isEmpty():
                return kept(new.select("id", "component"), "components")
            labels = new.select("id", "component")
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
