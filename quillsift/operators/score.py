"""Scoring: tokens left-joined with the model, the interesting ones chosen, their probabilities combined.

Unknown tokens stay in (they take places and dilute the result), so the join is a left one.  The window and
the aggregate have the same distribution, the message, so there is one exchange for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.params import ScoreParams

LEAST = 1e-200
GEOMETRIC_LEAST = 1e-6


def token_prob(good: Column, spam: Column, total_good: Column, total_spam: Column, p: ScoreParams | dict) -> Column:
    """The probability that a token tells spam. NULL counts: an unknown token.

    With strength 0 a known token of no count has no probability; it takes that of a new word.
    """
    v = _values(p)
    g, s = F.greatest(total_good.cast("double"), F.lit(1.0)), F.greatest(total_spam.cast("double"), F.lit(1.0))
    n = (good + spam).cast("double")
    pw, qw = spam / s, v["good_bias"] * (good / g)
    raw = F.when(pw + qw > 0, pw / F.nullif(pw + qw, F.lit(0.0))).otherwise(0.5)
    f = (v["strength"] * v["unknown_prob"] + n * raw) / F.nullif(v["strength"] + n, F.lit(0.0))
    return F.when(good.isNull() | spam.isNull() | (n < v["min_word_count"]), v["new_word_score"]).otherwise(F.coalesce(f, v["new_word_score"]))


def _values(p: ScoreParams | dict) -> dict[str, Column]:
    if isinstance(p, dict):
        return p
    names = ("strength", "unknown_prob", "good_bias", "new_word_score")
    return {n: F.lit(float(getattr(p, n))) for n in names} | {n: F.lit(getattr(p, n)) for n in ("min_word_count", "max_interesting", "min_array_size")} | {"min_distance": F.lit(p.min_distance)}


def chi2_survival(x: Column, half: Column) -> Column:
    """The upper tail of chi-squared with ``2 * half`` degrees of freedom."""
    m = x / 2.0
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(half - 1, F.lit(1))),
        F.struct(F.exp(-m).alias("t"), F.exp(-m).alias("s")),
        lambda a, i: F.struct(
            F.when(i < half, a["t"] * m / i).otherwise(a["t"]).alias("t"), F.when(i < half, a["s"] + a["t"] * m / i).otherwise(a["s"]).alias("s")
        ),
    )["s"]
    return F.when(x <= 0, 1.0).when(half < 1, 0.0).otherwise(F.least(total, F.lit(1.0)))


def with_probabilities(tokens: DataFrame, model: DataFrame, totals: DataFrame, p: ScoreParams) -> DataFrame:
    """``u, msg_id, token, good, spam, total_good, total_spam, f, dist`` of all tokens, known or not.

    Which side is broadcast, if any, is left to the sizes the planner sees.
    """
    j = tokens.join(model.select("u", "token", "good", "spam"), ["u", "token"], "left").join(totals.select("u", "total_good", "total_spam"), "u", "left")
    z = F.lit(0)
    f = token_prob(F.col("good"), F.col("spam"), F.coalesce("total_good", z), F.coalesce("total_spam", z), p)
    return j.withColumn("f", f).withColumn("dist", F.abs(F.col("f") - 0.5))


def select_interesting(scored: DataFrame, p: ScoreParams, keys: tuple[str, ...] = ("u", "msg_id")) -> DataFrame:
    """The ``max_interesting`` tokens farthest from 0.5, ties by token; of those under ``min_distance`` no more
    than fill up ``min_array_size``. Adds their rank ``rn``."""
    w = Window.partitionBy(*keys).orderBy(F.col("dist").desc(), F.col("token").asc())
    top = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= p.max_interesting)
    if p.min_distance > 0:
        top = top.filter((F.col("dist") >= p.min_distance) | (F.col("rn") <= p.min_array_size))
    return top


def combine(kept: DataFrame, p: ScoreParams, keys: tuple[str, ...] = ("u", "msg_id")) -> DataFrame:
    """One row per message: ``n, h_spam, h_ham, p_spam, p_ham, base`` (the score before any rail)."""
    f = F.col("f")
    if p.combine_mode == "geometric":
        c = F.least(F.greatest(f, F.lit(GEOMETRIC_LEAST)), F.lit(1 - GEOMETRIC_LEAST))
        a = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg(F.ln(c))).alias("p_spam"), F.exp(F.avg(F.ln(1 - c))).alias("p_ham"))
        base = F.col("p_spam") / (F.col("p_spam") + F.col("p_ham"))
        return a.withColumns({"h_spam": F.lit(0.0), "h_ham": F.lit(0.0), "base": base})
    a = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        (-2 * F.sum(F.ln(F.greatest(1 - f, F.lit(LEAST))))).alias("h_spam"),
        (-2 * F.sum(F.ln(F.greatest(f, F.lit(LEAST))))).alias("h_ham"),
    )
    a = a.withColumns({"p_spam": 1 - chi2_survival(F.col("h_spam"), F.col("n")), "p_ham": 1 - chi2_survival(F.col("h_ham"), F.col("n"))})
    base = F.least(F.greatest((1 + F.col("p_spam") - F.col("p_ham")) / 2, F.lit(0.0)), F.lit(1.0))
    return a.withColumn("base", base)


def rail_hits(scored: DataFrame, p: ScoreParams, keys: tuple[str, ...] = ("u", "msg_id")) -> DataFrame:
    """Messages from a suffix that only spam came from: ``tld_token, tld_spam, co_flag, strong``."""
    t = F.col("token")
    flag = (t == "x:confusable") | (t == "x:mixedscript") | t.startswith("x:brandmiss:")
    rows = scored.filter(flag | t.startswith("x:tld:"))
    co = F.min(F.when(flag, t)).over(Window.partitionBy(*keys))
    strong = F.col("spam") >= max(p.rail_strong_spam, p.rail_min_spam)
    hit = t.startswith("x:tld:") & (F.col("good") == 0) & (F.col("spam") >= p.rail_min_spam)
    if p.rail_require_coflag:
        hit = hit & (strong | F.col("co_flag").isNotNull())
    found = rows.withColumn("co_flag", co).filter(hit)
    first = F.min_by(F.struct(t.alias("tld_token"), F.col("spam").alias("tld_spam"), F.coalesce("co_flag", F.lit("(none)")).alias("co_flag"), strong.alias("strong")), t)
    return found.groupBy(*keys).agg(first.alias("rail"))


def classify(messages: DataFrame, tokens: DataFrame, model: DataFrame, totals: DataFrame, p: ScoreParams | None = None, rail: bool = True) -> DataFrame:
    """``u, msg_id, verdict, score`` of every message (``u, msg_id``), also of those without tokens.

    Sums over shuffled rows differ in their last digits, so the threshold is compared after rounding to 9 places.
    An owner without any training scores 0.5 GOOD, before any rail.
    """
    p = p or ScoreParams()
    scored = with_probabilities(tokens, model, totals, p)
    base = combine(select_interesting(scored, p), p)
    out = messages.select("u", "msg_id").join(base.select("u", "msg_id", "base"), ["u", "msg_id"], "left")
    out = out.join(totals.select("u", (F.greatest("total_good", "total_spam") >= 1).alias("trained")), "u", "left")
    score = F.coalesce("base", F.lit(0.5))
    if p.rail and rail:
        out = out.join(rail_hits(scored, p), ["u", "msg_id"], "left")
        score = F.when(F.col("rail").isNotNull(), F.greatest(score, F.lit(p.rail_floor))).otherwise(score)
    score = F.when(F.coalesce("trained", F.lit(False)), score).otherwise(0.5)
    spam = F.coalesce("trained", F.lit(False)) & (F.col("base").isNotNull() | (F.col("rail").isNotNull() if p.rail and rail else F.lit(False)))
    out = out.withColumn("score", score)
    return out.select("u", "msg_id", F.when(spam & (F.round("score", 9) >= p.threshold), "SPAM").otherwise("GOOD").alias("verdict"), "score")


def explain(tokens: DataFrame, model: DataFrame, totals: DataFrame, p: ScoreParams | None = None) -> DataFrame:
    """The chosen tokens of every message that the model knows: ``token, good, spam, f, rn``."""
    p = p or ScoreParams()
    kept = select_interesting(with_probabilities(tokens, model, totals, p), p)
    known = F.col("good").isNotNull() & (F.col("good") + F.col("spam") >= p.min_word_count)
    return kept.filter(known).select("u", "msg_id", "token", "good", "spam", "f", "rn")


def explain_nested(tokens: DataFrame, model: DataFrame, totals: DataFrame, p: ScoreParams | None = None, shown: int = 40) -> DataFrame:
    """One row per message with ``top_tokens``, the most telling first (at most ``shown``, a report's length)."""
    e = explain(tokens, model, totals, p)
    entry = F.struct("rn", F.col("token").alias("word"), "good", "spam", "f")
    return e.groupBy("u", "msg_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, shown).alias("top_tokens"))


def verdict_line(verdict: Column, score: Column) -> Column:
    """``SPAM 0.123456``."""
    return F.format_string("%s %.6f", verdict, score)


def fail_open(verdict: Column, score: Column) -> tuple[Column, Column]:
    """GOOD 0.5 where there is no readable score."""
    bad = score.isNull() | F.isnan(score)
    return F.when(bad, "GOOD").otherwise(verdict), F.when(bad, 0.5).otherwise(score)


def direction_bar(f: Column) -> Column:
    """Eleven cells with a mark at the probability: ``>`` towards spam, ``<`` towards ham."""
    at = F.least(F.greatest(F.round(f * 10), F.lit(0)), F.lit(10)).cast("int")
    mark = F.when(f >= 0.5, ">").otherwise("<")
    empty = F.when(at == 5, "...........").otherwise(".....|.....")
    return F.overlay(empty, mark, at + 1, 1)
