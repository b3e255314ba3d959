"""Connected components of links between ids, as DataFrames: lowest neighbour label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import dropped, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, c) for each id in links (a, b): c is the least id that is connected with v. A round's labels are written to the shared folder."""
    spark = links.sparkSession
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"), F.lit(True).alias("changed")), "labels")
    for _ in range(most_rounds):
        if labels.filter("changed").limit(1).count() == 0:
            break
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lowered = labels.join(near, labels["v"] == near["a"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumps = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = written(lowered.join(jumps, "c").select("v", F.least("c", "up").alias("c"), (F.least("c", "up") != F.col("old")).alias("changed")), "labels")
        dropped(spark, *{f.rpartition("/")[0] for f in labels.inputFiles()[:1]})
        labels = new
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    return labels.select("v", "c")
