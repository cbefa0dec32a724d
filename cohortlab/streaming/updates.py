"""Arriving measurements: the weights of the cases they touch, from maintained sums.

What is kept, all of it in buckets of cases and versioned by batch:

``trajectories``  the prior particles, written once
``observed``      sum and number of the measurements of a batch by case and day
``parts``         log-likelihood by case, day and particle, for the days that a batch has changed

A batch reads the buckets of its cases only: it adds its measurements to those of the same days, replaces the parts of these
days, adds up the newest parts of its cases, and normalises these cases. Its folders carry its id, so a batch that is run again
after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.operators.posterior import log_likelihood, part_of, weights, with_observed
from cohortlab.operators.scale import attach
from cohortlab.session import materialize

BUCKETS = 64


def touched_weights(measurements: DataFrame, trajectories: DataFrame, touched: DataFrame, noise: float) -> DataFrame:
    """Weights of the touched cases from all their measurements, in one go: what ``run`` maintains.

    Tables hold ``case_id, day, volume_ml`` and ``case_id, particle_id, day, predicted``.
    """
    observed = measurements.join(touched, "case_id", "left_semi").groupBy("case_id", "day").agg(
        F.avg("volume_ml").alias("observed"))
    met = with_observed(trajectories, observed, ["case_id", "day"])
    return weights(log_likelihood(met, ["case_id"], ["particle_id"], F.lit(noise)), ["case_id"])


def bucket(case: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(case), F.lit(buckets)).cast("int")


class Store:
    """The kept tables below one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def begin(self, trajectories: DataFrame) -> None:
        """Write the trajectories unless they are there; a write that did not finish is done again."""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/trajectories/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            rows = trajectories.select("case_id", "particle_id", "day", "predicted", bucket(F.col("case_id"), self.buckets).alias("bucket"))
            rows.repartition("bucket", "case_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/trajectories")

    def read(self, name: str, buckets: list[int], upto: int | None = None) -> DataFrame:
        """Rows of the given buckets alone; other folders are not opened."""
        rows = self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("bucket").isin(buckets))
        return rows if upto is None else rows.filter(F.col("batch_id") <= upto)

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def update(self, batch: DataFrame, batch_id: int, noise: float) -> DataFrame:
        """Take a batch in; the new weights of its cases."""
        here = batch.groupBy("case_id", "day").agg(F.sum("volume_ml").alias("total"), F.count("volume_ml").alias("n"))
        self.write(here.withColumn("bucket", bucket(F.col("case_id"), self.buckets)), "observed", batch_id)
        mine = self.spark.read.parquet(f"{self.path}/observed/batch_id={batch_id}")
        buckets = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most as many as there are buckets
        days = mine.select("case_id", "day").distinct()
        observed = self.read("observed", buckets, batch_id).join(days, ["case_id", "day"], "left_semi").groupBy("case_id", "day").agg(
            (F.sum("total") / F.sum("n")).alias("observed"))
        met = with_observed(self.read("trajectories", buckets), observed, ["case_id", "day"])
        self.write(met.select("bucket", "case_id", "day", "particle_id", part_of(F.lit(noise)).alias("part")), "parts", batch_id)
        parts = self.read("parts", buckets, batch_id).join(days.select("case_id").distinct(), "case_id", "left_semi")
        newest = parts.groupBy("case_id", "day").agg(F.max("batch_id").alias("newest"), F.count("*").alias("n"))
        parts = attach(parts, newest, ["case_id", "day"]).filter(F.col("batch_id") == F.col("newest"))
        return weights(parts.groupBy("case_id", "particle_id").agg(F.sum("part").alias("loglik"), F.count("*").alias("n_obs")), ["case_id"])


def run(spark: SparkSession, arriving: DataFrame, trajectories: DataFrame, store: str, out: str, checkpoint: str,
        noise: float = 0.12, buckets: int = BUCKETS) -> None:
    """Drain a stream of ``case_id, day, volume_ml`` into updated weights.

    ``trajectories`` are taken over into the store by the first call; measurements without a case, day or volume are left out.
    """
    Store(spark, store, buckets).begin(trajectories)

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.filter(F.col("case_id").isNotNull() & F.col("day").isNotNull() & F.col("volume_ml").isNotNull()))
        if not rows.isEmpty():
            Store(batch.sparkSession, store, buckets).update(rows, batch_id, noise).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def latest(updates: DataFrame) -> DataFrame:
    """The newest weights of each case (``updates`` carries ``batch_id``)."""
    newest = updates.groupBy("case_id").agg(F.max("batch_id").alias("newest"), F.count("*").alias("n"))
    return attach(updates, newest, ["case_id"]).filter(F.col("batch_id") == F.col("newest")).drop("newest")
