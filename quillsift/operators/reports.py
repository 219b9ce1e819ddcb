"""Shadow comparison, nightly statistics and the digest over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.operators.evaluate import bucket, nearest_rank

MATURE, CANDIDATE_FN, TOP = 5000, 5, 20


def parse_verdict(packed):
    """``verdict`` and ``score`` of a text like ``SPAM 0.12``; NULL where it is none."""
    v = F.regexp_extract(packed, r"^(SPAM|GOOD) ", 1)
    s = F.expr(f"try_cast(substring_index({packed}, ' ', -1) AS DOUBLE)")
    return F.when(v != "", v), F.when(v != "", s)


def shadow_per_user(records: DataFrame) -> DataFrame:
    """Divergence of two scorings of the same messages (``u, p_verdict, p_score, c_verdict, c_score``), by owner."""
    p, c = F.col("p_verdict") == "SPAM", F.col("c_verdict") == "SPAM"
    stats = records.groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p == c).alias("agree"), F.count_if(p != c).alias("disagree"),
        F.count_if(p).alias("primary_spam"), F.count_if(c).alias("cand_spam"),
        F.count_if(~p & c).alias("stricter"), F.count_if(p & ~c).alias("laxer"),
    )
    ranks = nearest_rank(records.withColumn("delta", F.col("c_score") - F.col("p_score")), "delta", [0.5, 0.99], "u")
    deltas = ranks.groupBy("u").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("delta_p50"), F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("delta_p99"))
    return stats.join(deltas, "u", "left")


def most_divergent(per_user: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` owners with most disagreement, then most messages, then by name, with their ``rank``."""
    top = per_user.orderBy(F.desc("disagree"), F.desc("n"), F.asc("u")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("disagree"), F.desc("n"), F.asc("u"))))


def shown_errors(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` wrongly judged rows, by message, as a report shows them."""
    return df.filter(F.col("is_spam") != F.col("pred_spam")).orderBy("msg_id").limit(n)


def shadow_totals(records: DataFrame) -> DataFrame:
    p, c = F.col("p_verdict") == "SPAM", F.col("c_verdict") == "SPAM"
    return records.agg(
        F.count(F.lit(1)).alias("total_n"), F.count_if(p == c).alias("agree"), F.count_if(p != c).alias("disagree"),
        F.count_if(~p & c).alias("stricter"), F.count_if(p & ~c).alias("laxer"),
        F.round(F.try_divide(F.count_if(p == c), F.count(F.lit(1))), 6).alias("agree_rate"), F.countDistinct("u").alias("users"),
    )


def nightly(seen: DataFrame) -> DataFrame:
    """Per owner and day (``u, d, junk, verdict, score``): the ten cells of inbox and junk scores, and the corrections."""
    b = bucket(F.col("score"))
    cells = lambda junk: F.array(*(F.count_if((F.col("junk") == junk) & (b == i)) for i in range(10)))
    return seen.filter("score is not null and not isnan(score)").groupBy("u", "d").agg(
        cells(False).alias("in"), cells(True).alias("jk"),
        F.count_if(F.col("junk") & (F.col("verdict") == "GOOD")).alias("fn"), F.count_if(~F.col("junk") & (F.col("verdict") == "SPAM")).alias("fp"),
    )


def latest(df: DataFrame, order: list, *keys: str) -> DataFrame:
    """The last row of each group. One aggregate, combined on the map side, no sort."""
    cols = [c for c in df.columns if c not in keys]
    m = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("m"))
    return m.select(*keys, *(F.col(f"m.{c}").alias(c) for c in cols))


def once_per_day(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows whose day is not stored yet."""
    return new.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def cluster_totals(users: DataFrame) -> DataFrame:
    """Totals over the owners' latest records (``u, good, spam, fn, fp``)."""
    mature = (F.col("good") >= MATURE) & (F.col("spam") >= MATURE)
    return users.agg(
        F.count(F.lit(1)).alias("users"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"),
        F.sum("good").alias("good"), F.sum("spam").alias("spam"), F.count_if(mature).alias("mature"),
    )


def top_missed(users: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` owners with most missed spam, those with none left out afterwards."""
    return users.orderBy(F.desc("fn"), F.asc("u")).limit(n).filter("fn > 0")


def with_false_positives(users: DataFrame) -> DataFrame:
    return users.filter("fp > 0")


def threshold_candidates(users: DataFrame) -> DataFrame:
    return users.filter((F.col("good") >= MATURE) & (F.col("spam") >= MATURE) & (F.col("fn") >= CANDIDATE_FN))


def allowed(df: DataFrame, allow: DataFrame, column: str = "u") -> DataFrame:
    """Rows of the owners on the list; a single ``*`` on it allows all."""
    star = allow.filter(F.col("entry") == "*").limit(1).select(F.lit(True).alias("__all"))
    named = df.join(allow.select(F.lower("entry").alias("__e")).distinct(), F.lower(F.col(column)) == F.col("__e"), "left_semi")
    everything = df.join(F.broadcast(star)).drop("__all")  # one row, or none
    rest = named.join(F.broadcast(star), how="left").filter("__all is null").drop("__all")
    return everything.unionByName(rest)


def retained_errors(df: DataFrame, n: int = 1000, *keys: str) -> DataFrame:
    """Wrongly judged rows, the first ``n`` of each group."""
    w = Window.partitionBy(*keys).orderBy("msg_id")
    return df.filter(F.col("is_spam") != F.col("pred_spam")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
