"""Helpers shared by the training-data operators: shared storage, connected components, column hygiene."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir. Where that is unset, a local master (tests) takes a
    local folder, and a cluster raises an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "candlewright-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1000
PLAN = "spark.sql.maxPlanStringLength"
PLAN_LETTERS = 20_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_ROWS rows, and descriptions of its plans, which the driver keeps for
    every query that has run, to PLAN_LETTERS letters: a plan may hold a model's weights."""
    spark.conf.set(PLAN, str(PLAN_LETTERS))
    if int(spark.conf.get(BATCH)) > ARROW_ROWS:
        spark.conf.set(BATCH, str(ARROW_ROWS))


class Stash:
    """Named intermediate tables in the shared folder. Each table is written once and read back, which cuts
    lineage and survives the loss of any executor. Arrow batches are held to ARROW_ROWS rows in its session, so that a
    Python worker holds that many whole texts at once and not ten times as many."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []

    def put(self, df: DataFrame, name: str, arrow_rows: int = ARROW_ROWS, **options: str) -> DataFrame:
        """Write a table and return a frame that reads it; the schema is kept, so empty tables read back too.
        arrow_rows: rows of an Arrow batch while it is written, where rows are large."""
        path = f"{self.root}/{name}-{len(self.tables)}"
        self.tables.append(path)
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(arrow_rows))
        try:
            df.write.options(**({"compression": "zstd"} | options)).mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of frames that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                if path.startswith(self.root) or self.root.split(":")[-1].lstrip("/") in path:
                    p = jvm.org.apache.hadoop.fs.Path(path)
                    p.getFileSystem(conf).delete(p, True)


def connected_components(edges: DataFrame, stash: Stash, rounds: int = 200) -> DataFrame:
    """Smallest id reachable from each id.

    edges: a long, b long. Returns id, component for every id that has an edge. Each round sends the smallest label of
    an id's neighbours to the id and to the id that its own label names, so whole regions are hooked at once, and then
    jumps to that label's own label. Rounds go on until no label moves; if that takes more than `rounds`, an error is
    raised and no labels are returned. Labels stay in tables; the driver only sees whether any label moved.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stash.put(both, "cc-edges")
    labels = stash.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "cc-labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = F.struct("id", F.least("component", "near").alias("next"), "component")
        root = F.struct(F.col("component").alias("id"), F.col("near").alias("next"), F.lit(None).cast("long").alias("component"))
        sent = labels.join(seen, "id").select(F.explode(F.when(F.col("near") < F.col("component"), F.array(own, root)).otherwise(F.array(own))).alias("s")).select("s.*")
        hooked = sent.groupBy("id").agg(F.min("next").alias("next"), F.max("component").alias("component"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("above"))
        jumped = hooked.join(up, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("component"), (F.least("next", F.coalesce("above", "next")) != F.col("component")).alias("moved"))
        after = stash.put(jumped, "cc-labels")
        stash.drop(labels)
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"connected components still move after {rounds} rounds")
    stash.drop(both)
    return labels


def n_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
