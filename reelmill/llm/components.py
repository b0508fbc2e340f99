"""Connected components of a table of links, by the smallest id that is reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.store import forget, stored


def components(links: DataFrame) -> DataFrame:
    """Rows (``id``, ``component``) for every id of ``links`` (columns ``a``, ``b``); the component is its least id.

    In each round an id takes the least label among its own and its neighbours', then the label of that label; rounds go on until
    nothing changes. Every round is written to the shared folder. Ids with very many links are only on the wide side of joins that
    adaptive execution splits, and least labels are combined before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("l").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "l", F.least("l", "n").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("l").alias("j"))
        step = stored(step.join(jump, "m", "left").select("id", "l", F.least("m", F.coalesce("j", "m")).alias("m")), "labels")
        changed = step.where("m < l").limit(1).count()
        forget(labels)
        labels = step.select("id", F.col("m").alias("l"))
        if not changed:
            forget(both)
            return labels.select("id", F.col("l").alias("component"))


def roots(parents: DataFrame) -> DataFrame:
    """Rows (``id``, ``component``): where the way from each id of ``parents`` (``a``, each once, to a smaller ``b``) ends.

    Each round an id looks twice as far.
    """
    now = stored(parents.select(F.col("a").alias("id"), F.col("b").alias("to")), "parents")
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = stored(now.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "parents")
        forget(now)
        now = step
        if not step.where("moved").limit(1).count():
            return now.select("id", F.col("to").alias("component"))
