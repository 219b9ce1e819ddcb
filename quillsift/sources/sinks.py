"""Reports as lines, appended once per day, and functions for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.text import SECOND_LEVEL
from quillsift.operators import score as S
from quillsift.operators.reports import once_per_day
from quillsift.sources.files import exists


def report_json(report: DataFrame) -> DataFrame:
    """Each row of a report as one JSON line with its keys sorted."""
    return report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("line"))


def correlated_json(correlated: DataFrame) -> DataFrame:
    """Correlated messages as JSON lines."""
    cols = ["u", "msgid", "delivery_verdict", "score", "delivery_folder", "current_folder", "label", "confidence", "algo_error"]
    return correlated.select(F.to_json(F.struct(F.lit("correlated").alias("type"), *cols)).alias("line"))


def eval_report(scored: DataFrame, folders: bool = False, fp_weight: float = 1.0) -> DataFrame:
    """One JSON line with sorted keys: counts and rates of ``is_spam, pred_spam, score``, percentiles of both kinds' scores
    and, if asked for, the counts of each ``folder``. Folders are as many as a report can show."""
    from quillsift.operators import evaluate as EV

    total = EV.rates(EV.confusion(scored), fp_weight)
    ranks = EV.nearest_rank(scored, "score", [0.01, 0.05, 0.5, 0.95, 0.99], "is_spam")
    name = F.concat(F.when(F.col("is_spam"), "spam").otherwise("ham"), F.lit("_p"), (F.col("p") * 100).cast("int").cast("string"))
    points = ranks.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), "value")))).alias("percentiles"))
    out = total.crossJoin(points)  # one row each
    if folders:
        each = EV.confusion(scored, "folder").agg(F.array_sort(F.collect_list(F.struct("folder", "fp", "fn", "tp", "tn"))).alias("folders"))
        out = out.crossJoin(each)  # one row each
    return report_json(out)


def tune_report(gated: DataFrame) -> DataFrame:
    """A JSON line with sorted keys for each tuned owner: parameters, held-out counts, and whether they are written."""
    return report_json(gated)


def append_once(new: DataFrame, path: str, *keys: str) -> int:
    """Append rows as JSON unless their keys (owner and day) are stored already; returns the rows appended."""
    spark = new.sparkSession
    if exists(spark, path):
        new = once_per_day(new, spark.read.schema(new.schema).json(path), *keys)
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def shadow_lines(pairs: DataFrame) -> DataFrame:
    """Two scorings of a message (``t, v, cmd, user, msgid, p_verdict, p_score, c_verdict, c_score``) as JSON lines."""
    primary, cand = (S.verdict_line(F.col(f"{x}_verdict"), F.col(f"{x}_score")).alias(n) for x, n in (("p", "primary"), ("c", "cand")))
    return pairs.select(F.to_json(F.struct("t", "v", "cmd", "user", "msgid", primary, cand)).alias("line"))


def explain_lines(explained: DataFrame) -> DataFrame:
    """The tokens of ``explain_nested`` as lines with a bar, in order of their weight."""
    x = explained.select("u", "msg_id", F.inline("top_tokens"))
    line = F.format_string("%-40s %6d %6d %.4f %s", "word", "good", "spam", "f", S.direction_bar(F.col("f")))
    return x.select("u", "msg_id", "rn", line.alias("line"))


_LABELS = "filter(split(host, '[.]'), x -> x <> '')"
_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_USABLE = f"size({_LABELS}) >= 2 AND NOT host RLIKE '^({_OCTET}[.]){{3}}{_OCTET}$' AND NOT contains(host, ':')"
_SECOND = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
_SUFFIX = f"(CASE WHEN size({_LABELS}) >= 3 AND octet_length(element_at({_LABELS}, -1)) = 2 AND element_at({_LABELS}, -2) IN ({_SECOND}) THEN 2 ELSE 1 END)"
# The scoring formulas for SQL users; the same as the Column builders.
SQL_FUNCTIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION token_prob(good BIGINT, spam BIGINT, total_good BIGINT, total_spam BIGINT) RETURNS DOUBLE RETURN
       CASE WHEN good IS NULL OR spam IS NULL THEN 0.5D ELSE (0.5D + (good + spam) * coalesce(try_divide(spam / greatest(total_spam, 1), spam / greatest(total_spam, 1) + good / greatest(total_good, 1)), 0.5D)) / (1 + good + spam) END""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION host_brand(host STRING) RETURNS STRING RETURN
       CASE WHEN {_USABLE} THEN element_at({_LABELS}, -1 - {_SUFFIX}) END""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION effective_tld(host STRING) RETURNS STRING RETURN
       CASE WHEN {_USABLE} THEN array_join(slice({_LABELS}, -{_SUFFIX}, {_SUFFIX}), '.') END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION normalize_url(url STRING) RETURNS STRING RETURN
       CASE WHEN octet_length(regexp_replace(lower(url), '(?s)[?#].*$', '')) <= 40 THEN regexp_replace(lower(url), '(?s)[?#].*$', '')
         ELSE regexp_replace(make_valid_utf8(CAST(substring(encode(regexp_replace(lower(url), '(?s)[?#].*$', ''), 'UTF-8'), 1, 40) AS STRING)), '\ufffd$', '') END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION chi2_survival(x DOUBLE, degrees INT) RETURNS DOUBLE RETURN
       CASE WHEN x <= 0 THEN 1D WHEN degrees < 2 THEN 0D ELSE least(1D, aggregate(sequence(1, greatest(degrees div 2 - 1, 1)),
         named_struct('t', exp(-x / 2), 's', exp(-x / 2)), (a, i) -> named_struct('t', CASE WHEN i < degrees div 2 THEN a.t * x / 2 / i ELSE a.t END,
           's', CASE WHEN i < degrees div 2 THEN a.s + a.t * x / 2 / i ELSE a.s END), a -> a.s)) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION tokenize_text(body STRING) RETURNS ARRAY<STRING> RETURN
       array_sort(array_distinct(filter(transform(split(body, '[^\\\\p{IsAlphabetic}\\\\p{N}._@-]+'), w -> lower(trim(BOTH '._-' FROM w))), w -> octet_length(w) BETWEEN 3 AND 40)))""",
]


def register_functions(spark: SparkSession) -> None:
    """``token_prob``, ``chi2_survival``, ``host_brand``, ``effective_tld``, ``normalize_url`` and ``tokenize_text`` for SQL,
    expanded into the plan like any expression."""
    for f in SQL_FUNCTIONS:
        spark.sql(f)
