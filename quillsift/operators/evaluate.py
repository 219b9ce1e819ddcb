"""Confusion counts, error rates, nearest-rank percentiles, histograms, splits and the parameter search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.operators.score import LEAST, chi2_survival, token_prob
from quillsift.params import ScoreParams, write_params
from quillsift.shared import group_index, materialize


def confusion(scored: DataFrame, *keys: str) -> DataFrame:
    """``fp, fn, tp, tn`` of ``is_spam, pred_spam``, over all rows or by ``keys``."""
    t, p = F.col("is_spam"), F.col("pred_spam")
    return scored.groupBy(*keys).agg(
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn")
    )


def rates(c: DataFrame, fp_weight: float = 1.0) -> DataFrame:
    """Error rates: of ham, of spam, total, balanced (empty classes count as one) and weighted."""
    ham, spam = F.col("fp") + F.col("tn"), F.col("fn") + F.col("tp")
    fp, fn = F.col("fp") / F.greatest(ham, F.lit(1)), F.col("fn") / F.greatest(spam, F.lit(1))
    return c.withColumns(
        {
            "fp_rate": F.try_divide(F.col("fp"), ham),
            "fn_rate": F.try_divide(F.col("fn"), spam),
            "error_rate": F.try_divide(F.col("fp") + F.col("fn"), ham + spam),
            "balanced_error": (fp + fn) / 2,
            "weighted_error": (fp_weight * fp + fn) / (fp_weight + 1),
        }
    )


def nearest_rank(df: DataFrame, value: str, points: list[float], *keys: str) -> DataFrame:
    """``p``, ``value`` of each group at the place ``round((n - 1) * p)`` of the sorted values.

    Equal values are counted together first, on the map side, so a group is no larger than its distinct values
    (scores of six places: a million at most), however many rows it has.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("__c"))
    g = g.withColumn("__hi", F.sum("__c").over(w.orderBy("value"))).withColumn("__n", F.sum("__c").over(w))
    want = F.explode(F.array(*(F.lit(float(p)) for p in points)))
    hit = g.select(*keys, "value", "__c", "__hi", "__n", want.alias("p")).withColumn("__at", F.round((F.col("__n") - 1) * F.col("p")))
    return hit.filter((F.col("__at") < F.col("__hi")) & (F.col("__at") >= F.col("__hi") - F.col("__c"))).select(*keys, "p", "value")


def bucket(score: Column, cells: int = 10) -> Column:
    """The cell of a score: cut towards 0, at least 0, at most the last."""
    return F.least(F.greatest(F.floor(score * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def histogram(df: DataFrame, score: str, *keys: str, cells: int = 10) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, bucket(F.col(score), cells).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(df: DataFrame, label: str, order: str, holdout: float, *keys: str) -> DataFrame:
    """Add ``is_test``: every so manieth row of each class, in a fixed order; a class of one stays in training."""
    if holdout <= 0:
        return df.withColumn("is_test", F.lit(False))
    d = group_index(df, [*keys, label], [order])
    test = F.least(F.greatest(F.round(F.col("__n") * holdout), F.lit(1)), F.col("__n") - 1)
    step = F.floor(F.col("__n") / F.greatest(test, F.lit(1)))
    is_test = (test > 0) & (F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < test)
    return d.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("__i", "__n")


def limit_per(df: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__i") <= n).drop("__i")


# The knobs of the search in their order, and the values tried.
GRIDS = {
    "threshold": [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85],
    "good_bias": [1.0, 1.5, 2.0, 2.5, 3.0],
    "strength": [0.3, 0.5, 1.0, 1.5, 2.0],
    "unknown_prob": [0.40, 0.45, 0.50, 0.55],
    "max_interesting": [27, 50, 100, 150, 200],
    "min_word_count": [0, 2, 5],
}
ROUNDS = 3
KNOBS = list(GRIDS)


def samples(tokens: DataFrame, labels: DataFrame, model: DataFrame) -> DataFrame:
    """``u, msg_id, is_spam, token, good, spam`` of the labelled messages: looked up once, used by every evaluation."""
    t = tokens.join(labels.select("msg_id", "is_spam"), "msg_id")
    return t.join(model.select("u", "token", "good", "spam"), ["u", "token"], "left")


def _score_candidates(data: DataFrame, candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """Confusion counts of every ``u, cand`` row of parameters, all candidates in one pass.

    ``threshold`` and ``max_interesting`` take part only after the probabilities and the ranks.
    """
    j = data.join(totals, "u", "left").join(candidates, "u")
    v = {k: F.col(k) for k in ("strength", "unknown_prob", "good_bias", "min_word_count")} | {"new_word_score": F.lit(0.5)}
    f = token_prob(F.col("good"), F.col("spam"), F.coalesce("total_good", F.lit(0)), F.coalesce("total_spam", F.lit(0)), v)
    keys = ("u", "cand", "msg_id")
    w = Window.partitionBy(*keys).orderBy(F.col("dist").desc(), F.col("token"))
    kept = j.withColumn("f", f).withColumn("dist", F.abs(F.col("f") - 0.5)).withColumn("rn", F.row_number().over(w)).filter("rn <= max_interesting")
    g = kept.groupBy(*keys, "is_spam", "threshold").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        (-2 * F.sum(F.ln(F.greatest(1 - F.col("f"), F.lit(LEAST))))).alias("hs"),
        (-2 * F.sum(F.ln(F.greatest(F.col("f"), F.lit(LEAST))))).alias("hh"),
    )
    score = F.least(F.greatest((1 - chi2_survival(F.col("hs"), F.col("n")) + chi2_survival(F.col("hh"), F.col("n"))) / 2, F.lit(0.0)), F.lit(1.0))
    return confusion(g.select("u", "cand", "is_spam", (F.round(score, 12) >= F.col("threshold")).alias("pred_spam")), "u", "cand")


def tune(data: DataFrame, totals: DataFrame, fp_weight: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """The best parameters of each owner by coordinate descent, all owners in the same jobs.

    One job per knob and round. An owner's parameters change only for a strictly smaller weighted error; of equal
    candidates the first one tried stays. Further rounds try only the owners whom the round before improved.
    """
    base = ScoreParams()
    start = totals.select("u", *(F.lit(getattr(base, k)).alias(k) for k in KNOBS))
    kept = rates(_score_candidates(data, start.withColumn("cand", F.lit(0)), totals), fp_weight)
    state = materialize(start.join(kept.select("u", F.col("weighted_error").alias("best"), "fp", "fn", "tp", "tn"), "u"), "tune")
    moved = None
    for _ in range(rounds):
        begin = state.select("u", F.col("best").alias("__begin"))
        for knob, values in GRIDS.items():
            kind = dict(start.dtypes)[knob]
            tried = F.posexplode(F.array(*(F.lit(v).cast(kind) for v in values))).alias("cand", "__v")
            trying = state if moved is None else state.join(moved, "u", "left_semi")
            cands = trying.drop("best", "fp", "fn", "tp", "tn").select("*", tried).withColumn(knob, F.col("__v")).drop("__v")
            got = rates(_score_candidates(data, cands, totals), fp_weight).withColumn("err", F.round("weighted_error", 12))
            first = got.groupBy("u").agg(F.min(F.struct("err", "cand", "fp", "fn", "tp", "tn")).alias("m"))
            new = state.join(first, "u", "left")
            better = F.col("m.err").isNotNull() & (F.col("m.err") < F.round("best", 12))
            value = F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("m.cand") + 1)
            cols = {knob: F.when(better, value).otherwise(F.col(knob)), "best": F.when(better, F.col("m.err")).otherwise(F.col("best"))}
            cols |= {c: F.when(better, F.col(f"m.{c}")).otherwise(F.col(c)) for c in ("fp", "fn", "tp", "tn")}
            state = materialize(new.withColumns(cols).drop("m"), "tune")
        moved = materialize(state.join(begin, "u").filter("best < __begin").select("u"), "moved")
        if moved.isEmpty():
            break
    return state


def held_out(data: DataFrame, params: DataFrame, totals: DataFrame) -> DataFrame:
    """``u, fp, fn, tp, tn`` of every owner's row of ``params``; owners without messages have none wrong or right."""
    got = _score_candidates(data, params.select("u", *KNOBS, F.lit(0).alias("cand")), totals).drop("cand")
    return params.select("u").join(got, "u", "left").fillna(0, ["fp", "fn", "tp", "tn"])


#: Share held out by the query; threshold that owners run with until parameters are written.
HOLDOUT, RUNNING_THRESHOLD = 0.2, 0.6


def tune_gated(data: DataFrame, split: DataFrame, totals: DataFrame, fp_weight: float = 1.0, min_spam: int = 50) -> DataFrame:
    """The parameters found on each owner's training part, with their counts on the held-out part (``test_``) and
    whether they may replace the running ones. ``split`` has ``msg_id, is_test``."""
    parts = materialize(data.join(split.select("msg_id", "is_test"), "msg_id"), "parts")
    best = tune(parts.filter("not is_test").drop("is_test"), totals, fp_weight)
    test = parts.filter("is_test").drop("is_test")
    base = ScoreParams(threshold=RUNNING_THRESHOLD)
    tuned = held_out(test, best, totals)
    gate = write_gate(held_out(test, best.select("u", *(F.lit(getattr(base, k)).alias(k) for k in KNOBS)), totals), tuned, min_spam, fp_weight)
    return best.join(tuned.withColumnsRenamed({c: f"test_{c}" for c in ("fp", "fn", "tp", "tn")}), "u").join(gate, "u")


#: Messages of each kind from which an owner is tuned.
LEAST_HAM, LEAST_SPAM = 100, 50


def tunable(totals: DataFrame, least_ham: int = LEAST_HAM, least_spam: int = LEAST_SPAM) -> DataFrame:
    """Add ``skipped``: whether an owner has too few messages of a kind to be tuned."""
    return totals.withColumn("skipped", (F.coalesce("total_good", F.lit(0)) < least_ham) | (F.coalesce("total_spam", F.lit(0)) < least_spam))


def tune_summary(gated: DataFrame, totals: DataFrame) -> DataFrame:
    """Owners by what came of tuning them: ``written``, ``refused`` (by its reason), ``skipped`` or ``failed`` (no result)."""
    j = tunable(totals).select("u", "skipped").join(gated.select("u", "write", "refused"), "u", "left")
    outcome = F.when(F.col("skipped"), "skipped").when(F.col("write"), "written").when(F.col("write").isNull(), "failed").otherwise(F.concat(F.lit("refused: "), F.col("refused")))
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("owners"))


def tuned_params(gated: DataFrame, running: dict[str, str]) -> dict[str, str]:
    """New parameter files of the owners whose tuned values may be written: their managed keys set in place in the
    ``running`` files. As many rows as there are files given come to the driver."""
    rows = gated.filter("write").filter(F.col("u").isin(list(running))).select("u", *KNOBS).collect()
    return {r.u: write_params(running[r.u], ScoreParams(**{k: r[k] for k in KNOBS})) for r in rows}


def write_gate(baseline: DataFrame, tuned: DataFrame, min_spam: int = 50, fp_weight: float = 1.0) -> DataFrame:
    """Whether tuned parameters may replace an owner's, from confusion counts on the held-out part, and why not.

    Refused, in this order: too little spam to judge by, more false positives, no gain.
    """
    b, t = rates(baseline, fp_weight).alias("b"), rates(tuned, fp_weight).alias("t")
    j = b.join(t, "u")
    spam = F.col("t.fn") + F.col("t.tp")
    reason = (
        F.when(spam < min_spam, "spam").when(F.col("t.fp") > F.col("b.fp"), "fp").when(F.col("t.weighted_error") >= F.col("b.weighted_error"), "no gain")
    )
    return j.select("u", reason.isNull().alias("write"), reason.alias("refused"))
