"""Messages delivered more than once: an idempotent upsert into hash-bucketed sorted storage.

``UpsertStore`` keeps one table, partitioned by run, hash-bucketed by identifier and sorted within each
bucket.  Writing a run first collapses equal identifiers inside it (a partial aggregate, so a hot
identifier never travels whole), then replaces that run's partition: repeating a run changes nothing.
Compaction reads every bucket's sorted runs together; the bucketing is the aggregate's distribution,
so there is no exchange, and the sort-based aggregate over equal neighbours leaves one row each.

Defined results
---------------
* rows whose identifier or owner is null, empty or a placeholder are no message and never surplus
* equal ranks: the smallest ``row_id`` stays
* repeated rows: one stays
* an empty table: nothing is surplus
* further columns of the inputs are ignored, whatever their names
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.shared import drop_path, materialize, readable_instant, scratch_path, shuffle_width, with_references

FAR = 9223372036854775807


class UpsertStore:
    """One row per identifier: the row with the smallest ``(rank, row_id)``.

    ``df`` given to :meth:`upsert` has ``run INT``, ``id STRING``, ``rank BIGINT``, ``row_id BIGINT``.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or shuffle_width(spark)
        self.name = f"upsert_{uuid.uuid4().hex[:12]}"
        self.path = scratch_path(spark, self.name)
        self._create(self.name, self.path)

    def _create(self, name: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {name} (id STRING, rank BIGINT, row_id BIGINT, run INT) USING parquet "
            f"PARTITIONED BY (run) CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def upsert(self, df: DataFrame) -> UpsertStore:
        """Write runs. A run that is there already is replaced, so a repeated delivery is harmless."""
        one = df.groupBy("run", "id").agg(F.min(F.struct("rank", "row_id")).alias("m"))
        rows = one.select("id", F.col("m.rank").alias("rank"), F.col("m.row_id").alias("row_id"), F.col("run").cast("int").alias("run"))
        self._write(rows.repartition(self.buckets, "id").sortWithinPartitions("run", "id"), self.name)
        return self

    def _write(self, rows: DataFrame, name: str) -> None:
        """Replace the runs that ``rows`` holds and no others."""
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(name)
        finally:
            self.spark.conf.set(key, before)

    def kept(self) -> DataFrame:
        """One row per identifier over all runs; merges each bucket's runs without an exchange."""
        m = self.spark.table(self.name).groupBy("id").agg(F.min(F.struct("rank", "row_id")).alias("m"))
        return m.select("id", F.col("m.rank").alias("rank"), F.col("m.row_id").alias("row_id"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        drop_path(self.spark, self.path)

    def compact(self) -> UpsertStore:
        """Replace all runs by run 0, in a new generation that becomes current once it is complete."""
        old_name, old_path = self.name, self.path
        name = f"upsert_{uuid.uuid4().hex[:12]}"
        path = scratch_path(self.spark, name)
        self._create(name, path)
        self._write(self.kept().withColumn("run", F.lit(0)), name)
        self.name, self.path = name, path
        self.spark.sql(f"DROP TABLE {old_name}")
        drop_path(self.spark, old_path)
        return self


def message_ranks(msgid_line: DataFrame, delivery_start: DataFrame, batches_per_run: int) -> DataFrame:
    """``run, id, rank, row_id`` of every row that names a message.

    ``rank`` is the earliest readable time of its session, or far in the future.  Sessions are reduced to
    one row each before the join; rows without a session don't take part in it.
    """
    times = (
        with_references(delivery_start.select("session", readable_instant(F.col("ts")).alias("t")), {"s": "session"})
        .filter(F.col("s").isNotNull() & F.col("t").isNotNull())
        .groupBy("s")
        .agg(F.min("t").alias("t"))
    )
    lines = (
        with_references(msgid_line.select("row_id", "u", "batch_id", "session", "msgid"), {"s": "session"}, {"k": "msgid"})
        .filter(F.col("u").isNotNull() & F.col("k").isNotNull() & F.col("row_id").isNotNull())
        .select(
            F.col("row_id").cast("bigint").alias("row_id"), "u", "k", "s",
            F.coalesce(F.floor(F.col("batch_id") / batches_per_run), F.lit(-1)).cast("int").alias("run"),
        )
    )
    ident = F.concat(F.col("u"), F.lit("\x00"), F.col("k")).alias("id")
    timed = lines.filter(F.col("s").isNotNull()).join(times, "s", "left")
    bare = lines.filter(F.col("s").isNull()).withColumn("t", F.lit(None).cast("bigint"))
    return timed.unionByName(bare).select("run", ident, F.coalesce("t", F.lit(FAR)).alias("rank"), "row_id")


def surplus(msgid_line: DataFrame, delivery_start: DataFrame, batches_per_run: int = 90) -> DataFrame:
    """``row_id`` of every row of ``msgid_line`` that repeats a message."""
    spark = msgid_line.sparkSession
    store = UpsertStore(spark).upsert(message_ranks(msgid_line, delivery_start, batches_per_run)).compact()
    kept = materialize(spark.table(store.name).select("row_id"), "kept")
    store.drop()
    named = with_references(msgid_line.select("row_id", "u", "msgid"), msgids={"k": "msgid"})
    named = named.filter(F.col("u").isNotNull() & F.col("k").isNotNull() & F.col("row_id").isNotNull())
    named = named.select(F.col("row_id").cast("bigint").alias("row_id"))
    return named.join(kept, "row_id", "left_anti")


def kept_after_repeats(msgid_line: DataFrame, delivery_start: DataFrame, batches_per_run: int = 90) -> DataFrame:
    """``row_id`` of the row kept of each message where the batches come in two deliveries that overlap, and the first
    is delivered again after the compaction: what is kept is the same."""
    spark = msgid_line.sparkSession
    ranks = materialize(message_ranks(msgid_line, delivery_start, batches_per_run), "ranks")
    # run 0 is the compacted one, and an identifier's earlier rows are in it
    ranks = ranks.withColumn("run", F.col("run") + 2)
    middle = ranks.agg(F.percentile_approx("run", 0.5)).first()[0]
    store = UpsertStore(spark)
    if middle is not None:
        early, late = ranks.filter(F.col("run") <= middle), ranks.filter(F.col("run") >= middle)
        store.upsert(early).compact().upsert(late).upsert(late).upsert(early).compact()
    kept = materialize(store.kept().select("row_id"), "kept")
    store.drop()
    return kept


def surplus_report(msgid_line: DataFrame, delivery_start: DataFrame) -> DataFrame:
    """Surplus rows by batch."""
    extra = surplus(msgid_line, delivery_start)
    return msgid_line.select("row_id", "batch_id").join(extra, "row_id", "left_semi").groupBy("batch_id").agg(F.count(F.lit(1)).alias("surplus"))
