"""Connected components of an edge table, by the least label of the neighbourhood with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of an edge (a, b); comp is the least id of the component. Each round is a written table."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jumped = least.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left")
        new = written(jumped.select("id", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")
