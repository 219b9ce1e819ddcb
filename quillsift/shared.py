"""Helpers every operator may use: table access, the shared folder, identifiers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Identifiers longer than this many bytes are represented by their SHA-256, so that sort keys stay narrow.
KEY_BYTES = 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data directory; the schema comes from the footer, nothing is inferred."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it nothing runs there.  In a local session (tests) a
    temporary folder of this machine is chosen once and kept in the session's settings.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        path = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs only its unfinished tasks, since the files outlive it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Blanks and the angle brackets, as one set of characters to trim.
_ENDS = " \t\n\r\x0b\x0c\xa0\u2007\u202f\u3000<>"


def with_references(df: DataFrame, sessions: dict[str, str] | None = None, msgids: dict[str, str] | None = None) -> DataFrame:
    """Add the comparable forms of references: ``sessions`` and ``msgids`` map new columns to source columns.

    Both lose the blanks and angle brackets at their ends.  Sessions keep their case; of a msgid only the part
    after the last ``@`` loses it.  Null and empty values, and ``noid`` as a msgid, become NULL.  Each step is a
    projection of its own, so that nothing is computed twice for a row.
    """
    sessions, msgids = sessions or {}, msgids or {}
    df = df.withColumns({f"__{o}": F.btrim(F.col(c), F.lit(_ENDS)) for o, c in (sessions | msgids).items()})
    at = {f"__{o}_host": F.substring_index(f"__{o}", "@", -1) for o in msgids}
    df = df.withColumns(at) if at else df
    out = {o: F.when(F.col(f"__{o}") != "", F.col(f"__{o}")) for o in sessions}
    for o in msgids:
        t, host = F.col(f"__{o}"), F.col(f"__{o}_host")
        cut = F.char_length(t) - F.char_length(host)
        whole = F.when(cut > 0, F.concat(F.substring(t, F.lit(1), cut), F.lower(host))).otherwise(t)
        out[o] = F.when((t != "") & (t != "noid"), whole)
    return df.withColumns(out).drop(*(f"__{o}" for o in sessions | msgids), *at)


def narrow_key(c: Column) -> Column:
    """``c`` itself, or a digest of it where it is too long to serve as a sort key."""
    return F.when(F.octet_length(c) <= KEY_BYTES, c).otherwise(F.concat(F.lit("\x01sha256:"), F.sha2(c, 256)))


def readable_instant(c: Column) -> Column:
    """Microseconds since 1970 UTC of a log timestamp kept as text; NULL where it can't be read.

    Read are ISO forms with ``T`` or a blank, a stop or comma before the fraction, any of ``Z``,
    ``+hh:mm``, ``+hhmm`` or no zone (UTC), and seconds since 1970 with a fraction.
    """
    t = F.trim(c)
    iso = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[Tt ]", "$1T"), ",", "."), r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2"
    )
    iso = F.regexp_replace(iso, r"\s*[zZ]$", "Z")
    is_iso = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([zZ]|[+-]\d{2}:?\d{2})?$")
    is_epoch = t.rlike(r"^\d{1,12}([.,]\d{1,9})?$")
    whole = F.regexp_extract(t, r"^(\d+)", 1)
    frac = F.rpad(F.substring(F.regexp_extract(t, r"[.,](\d+)$", 1), 1, 6), 6, "0")
    return F.when(is_iso, F.unix_micros(F.try_to_timestamp(iso))).when(
        is_epoch, F.expr("0L") + whole.cast("bigint") * F.lit(1_000_000).cast("bigint") + frac.cast("bigint")
    )


def group_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``__i`` (from 0) and ``__n``: a row's place in its group by unique ``order``, and the group's rows.

    No group goes to one task: rows are range-partitioned by group and order, counted within each range, and the
    counts of the ranges before are added.  The ranges are written first, so that both steps see the same ones.
    """
    spark = df.sparkSession
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(shuffle_width(spark), *by).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    own = Window.partitionBy("__p", *keys)
    counts = ranged.groupBy("__p", *keys).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # a row for each range and group
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("__n", F.sum("__c").over(whole)).drop("__c")
    counts = counts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(["__p", *keys])), "__before", "__n")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(["__p", *keys])]
    placed = ranged.withColumn("__r", F.row_number().over(own.orderBy(*(F.col(c) for c in order)))).join(counts, same)
    return placed.withColumn("__i", F.col("__before") + F.col("__r") - 1).drop("__p", "__r", "__before", *(f"__k{i}" for i in range(len(keys) + 1)))


def spread_hint(df: DataFrame) -> DataFrame:
    """Spread the rows before a heavy step where the source has too few files to keep all cores busy.

    A source of many files is left alone: its splits are spread already, and nothing is shuffled.
    """
    width = shuffle_width(df.sparkSession)
    return df if len(df.inputFiles()) >= width else df.repartition(width)
