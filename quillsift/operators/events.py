"""Sieve log lines into events, deliveries stitched with their message ids, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The markers that tell the three kinds of line.
TRAIN, DELIVERY, MSGID, STORED = "sieve: DEBUG: TRAIN: ", "sieve: DEBUG: DELIVERY: ", "sieve: msgid=", ": stored mail into mailbox '"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events of ``file, line_no, line``: ``kind`` (T, D or M), ``t, u, sess, v, verdict, score, folder, msgid``.

    The cheap test for the marker comes first, so that most lines never meet a pattern.
    """
    line = F.rtrim(F.regexp_replace(F.col("line"), "\r+$", ""))
    d = lines.filter(F.col("line").contains(" sieve: ")).select("file", "line_no", line.alias("line"))
    l_ = F.col("line")
    kind = F.when(l_.contains(TRAIN), "T").when(l_.contains(DELIVERY), "D").when(l_.contains(MSGID) & l_.contains(STORED), "M")
    d = d.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    mark = F.when(F.col("kind") == "T", TRAIN).when(F.col("kind") == "D", DELIVERY).otherwise(MSGID)
    at = F.instr(l_, mark)
    d = d.withColumns({"head": F.substring(l_, F.lit(1), at - 1), "tail": F.substring(l_, at + F.length(mark), F.length(l_))})
    tail, k = F.col("tail"), F.col("kind")
    result = r"^(.*?) -> (.*?) \(([^ ]*) (.*)\)"
    out = d.select(
        "file",
        "line_no",
        "kind",
        F.substring_index(l_, " ", 1).alias("t"),
        F.regexp_extract("head", r"<([^<>]*)>[^<>]*$", 1).alias("sess"),
        F.when(k == "T", F.regexp_extract(tail, r"^(.*?) -> ", 1)).when(k == "D", F.regexp_extract(tail, result, 1)).alias("u"),
        F.when(k == "T", F.regexp_extract(tail, r" -> (.*)$", 1)).alias("v"),
        F.when(k == "D", F.regexp_extract(tail, result, 3)).alias("verdict"),
        F.when(k == "D", F.regexp_extract(tail, result, 4)).alias("score"),
        F.when(k == "D", F.regexp_extract(tail, result, 2)).alias("folder"),
        F.when(k == "M", F.regexp_extract(tail, r"^([^:]*):", 1)).alias("msgid"),
    )
    good = (
        ((k == "T") & F.col("v").isin("good", "spam") & (F.col("u") != ""))
        | ((k == "D") & (F.col("u") != "") & (F.col("score") != ""))
        | ((k == "M") & (F.col("msgid") != ""))
    )
    return out.filter(good & (F.col("sess") != ""))


def stitch(events: DataFrame, *extra: str) -> DataFrame:
    """Deliveries with the message id of the next msgid line of their session, or without where none follows.

    A delivery followed by another of the same session is lost; a msgid line without delivery is ignored.
    A window over (file, session) is all it needs: what follows decides.
    """
    w = Window.partitionBy("file", "sess").orderBy("line_no")
    e = events.filter(F.col("kind").isin("D", "M"))
    e = e.withColumn("nk", F.lead("kind").over(w)).withColumn("nm", F.lead("msgid").over(w))
    kept = e.filter((F.col("kind") == "D") & (F.col("nk").isNull() | (F.col("nk") == "M")))
    return kept.select("file", "line_no", "sess", "t", "u", "verdict", "score", "folder", F.when(F.col("nk") == "M", F.col("nm")).alias("msgid"), *extra)


def train_summary(events: DataFrame) -> DataFrame:
    """Training events per owner."""
    return events.filter("kind = 'T'").groupBy("u").agg(F.count_if(F.col("v") == "good").alias("good"), F.count_if(F.col("v") != "good").alias("spam"))


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    """Deliveries per owner; any verdict but GOOD counts as spam."""
    return deliveries.groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "GOOD").alias("good"), F.count_if(F.coalesce(F.col("verdict"), F.lit("")) != "GOOD").alias("spam")
    )


def top_users(deliveries: DataFrame, n: int = 15) -> DataFrame:
    """The owners with most deliveries."""
    return delivery_summary(deliveries).orderBy(F.desc("n"), F.asc("u")).limit(n)


def day(t: Column) -> Column:
    """The date in front of a textual timestamp; NULL for shorter texts."""
    return F.when(F.octet_length(t) >= 10, F.substring(t, 1, 10))


def by_date(df: DataFrame, t: str = "t") -> DataFrame:
    return df.withColumn("d", day(F.col(t))).filter(F.col("d").isNotNull()).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def harvest_totals(deliveries: DataFrame) -> DataFrame:
    """One row: deliveries with and without message id, owners, dates."""
    return deliveries.agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count("msgid").alias("with_msgid"),
        F.count_if(F.col("msgid").isNull()).alias("orphans"),
        F.countDistinct("u").alias("users"),
        F.countDistinct(day(F.col("t"))).alias("dates"),
    )


def is_junk(folder: Column) -> Column:
    return F.lower(folder) == ".junk"


def label(verdict: Column, folder: Column) -> Column:
    """What a verdict turned out to be, by where the message is now."""
    junk = is_junk(folder)
    return (
        F.when((verdict == "SPAM") & junk, "tp").when((verdict == "SPAM") & ~junk, "fp")
        .when((verdict == "GOOD") & junk, "fn").when((verdict == "GOOD") & ~junk, "tn").otherwise("unknown")
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high_spam").when(score <= 0.2, "high_ham").otherwise("uncertain")


def is_algo_error(score: Column, folder: Column) -> Column:
    return ((score >= 0.8) & ~is_junk(folder)) | ((score <= 0.2) & is_junk(folder))


def correlate(files: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Stored files with the verdict of their delivery: ``file_id, u, msgid, label, confidence, algo_error, ...``.

    ``files``: ``u, file_id, folder, msgid``; ``deliveries``: ``u, msgid, verdict, score, folder, seq``.  Of
    several deliveries of a message the last one counts; unreadable scores count as 0.5; trash is left out.
    """
    last = (
        deliveries.filter("msgid is not null and verdict is not null and folder is not null")
        .groupBy("u", "msgid")
        .agg(F.max_by(F.struct("verdict", "score", F.col("folder").alias("delivery_folder")), "seq").alias("d"))
    )
    kept = files.filter((F.lower("folder") != ".trash") & F.col("msgid").isNotNull())
    j = kept.join(last, ["u", "msgid"])
    score = F.coalesce(F.expr("try_cast(d.score AS DOUBLE)"), F.lit(0.5))
    j = j.withColumn("s", score)
    return j.select(
        "file_id", "u", "msgid",
        label(F.col("d.verdict"), F.col("folder")).alias("label"),
        confidence(F.col("s")).alias("confidence"),
        is_algo_error(F.col("s"), F.col("folder")).alias("algo_error"),
        F.col("s").alias("score"),
        F.col("d.verdict").alias("delivery_verdict"),
        F.col("d.delivery_folder").alias("delivery_folder"),
        F.col("folder").alias("current_folder"),
    )


def unmatched(files: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: files, those without message id, those whose message no delivery names."""
    known = deliveries.filter("msgid is not null and verdict is not null and folder is not null").select("u", "msgid", F.lit(1).alias("known")).distinct()
    kept = files.filter(F.lower("folder") != ".trash")
    # files without a message id don't take part in the join, so their number can't skew it
    j = kept.filter("msgid is not null").join(known, ["u", "msgid"], "left")
    counted = j.agg(F.count(F.lit(1)).alias("with_msgid"), F.count_if(F.col("known").isNull()).alias("not_in_log"))
    return kept.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("msgid").isNull()).alias("no_msgid")).crossJoin(counted)
