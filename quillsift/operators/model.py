"""The token model: counts per owner and token, and totals per owner.

``tokens``: ``u, token, good, spam, last_seen``; ``totals``: ``u, total_good, total_spam``.  Totals are a table
of their own: repeated training and cleaning change token counts but never totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS_DDL = "u string, token string, good bigint, spam bigint, last_seen timestamp"
TOTALS_DDL = "u string, total_good bigint, total_spam bigint"


def from_tables(tokens: DataFrame, model_totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of the stored tables: rows of one owner and word are one entry, missing counts are 0."""
    t = (
        tokens.groupBy("u", F.col("word").alias("token"))
        .agg(F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("spam", F.lit(0))).alias("spam"), F.max("last_seen").alias("last_seen"))
    )
    return t, model_totals.select("u", "total_good", "total_spam")


def train_tokens(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts from ``u, msg_id, token`` and ``msg_id, is_spam, at``. Combined on the map side."""
    return (
        tokens.join(labels, "msg_id")
        .groupBy("u", "token")
        .agg(
            F.sum(F.when(F.col("is_spam"), 0).otherwise(1)).alias("good"),
            F.sum(F.when(F.col("is_spam"), 1).otherwise(0)).alias("spam"),
            F.max("at").alias("last_seen"),
        )
    )


def train_totals(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals from ``u, msg_id``: messages count, even those without tokens."""
    return (
        messages.select("u", "msg_id").join(labels, "msg_id").groupBy("u")
        .agg(F.count_if(~F.col("is_spam")).alias("total_good"), F.count_if(F.col("is_spam")).alias("total_spam"))
    )


def merge_tokens(*models: DataFrame) -> DataFrame:
    """Token counts of several models together (also: an import into a model)."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.groupBy("u", "token").agg(F.sum("good").alias("good"), F.sum("spam").alias("spam"), F.max("last_seen").alias("last_seen"))


def merge_totals(*totals: DataFrame) -> DataFrame:
    out = totals[0]
    for t in totals[1:]:
        out = out.unionByName(t)
    return out.groupBy("u").agg(F.sum("total_good").alias("total_good"), F.sum("total_spam").alias("total_spam"))


def cleanup(tokens: DataFrame, min_count: int = 1, days: int = 0, now=None) -> DataFrame:
    """Without tokens counted ``min_count`` times or fewer, nor those not seen for ``days`` (0: no limit). A narrow filter."""
    drop = (F.col("good") + F.col("spam")) <= min_count
    if days > 0:
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        drop = drop | F.coalesce(F.unix_seconds("last_seen") < F.unix_seconds(at) - days * 86400, F.lit(False))
    return tokens.filter(~drop)


def counts(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals and number of tokens of each owner."""
    n = tokens.groupBy("u").agg(F.count(F.lit(1)).alias("tokens"))
    return totals.join(n, "u", "full_outer").select(
        "u", F.coalesce("total_good", F.lit(0)).alias("total_good"), F.coalesce("total_spam", F.lit(0)).alias("total_spam"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )


TOTAL_WORD = "__total__"


def export_lines(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """``u, seq, line``: the lines ``good,spam,0,"word"`` of each owner's model, the total first, then by word.

    Words holding a quote or a control character are left out, as is ``last_seen``.
    """
    head = totals.select("u", F.lit("").alias("word"), F.format_string('%d,%d,0,"' + TOTAL_WORD + '"', "total_good", "total_spam").alias("line"))
    rest = tokens.filter(~F.col("token").rlike(r'["\p{Cntrl}]')).select("u", F.col("token").alias("word"), F.format_string('%d,%d,0,"%s"', "good", "spam", "token").alias("line"))
    return head.unionByName(rest)


def import_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens and totals from ``u, line`` (a narrow parse; a word may hold commas). Unreadable lines are skipped.

    Only the first three commas split; blanks around the counts and one quote at either end of the word go.
    """
    got = lines.select("u", F.regexp_replace("line", r"\r?\n?\z", "").alias("line"))
    p = got.filter(F.col("line").rlike("^[^,]*,[^,]*,[^,]*,")).select(
        "u",
        F.expr("try_cast(trim(regexp_extract(line, '^([^,]*),', 1)) AS BIGINT)").alias("good"),
        F.expr("try_cast(trim(regexp_extract(line, '^[^,]*,([^,]*),', 1)) AS BIGINT)").alias("spam"),
        F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract("line", r"(?s)^[^,]*,[^,]*,[^,]*,(.*)\z", 1)), '^"', ""), r'"\z', "").alias("token"),
    )
    p = p.filter("good >= 0 and spam >= 0 and token <> ''")

    def total(c: str):
        # counts may be as large as a bigint holds; their sum stays there
        return F.least(F.sum(F.col(c).cast("decimal(19,0)")), F.lit(9223372036854775807).cast("decimal(38,0)")).cast("bigint")

    named = p.filter(F.col("token") != TOTAL_WORD).groupBy("u", "token").agg(total("good").alias("good"), total("spam").alias("spam"))
    totals = p.filter(F.col("token") == TOTAL_WORD).groupBy("u").agg(total("good").alias("total_good"), total("spam").alias("total_spam"))
    return named.withColumn("last_seen", F.current_timestamp()), totals
