"""Learning while scoring: every message is scored by the model as it is, and may train it afterwards.

The order within an owner matters, so an owner's messages form one sequence; owners are independent.  The exact
replay keeps an owner's model in a Python worker and streams the owner's messages in order.  For long streams
there is a form by micro-batches, in which a batch is scored by the model of the batch before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.operators import model as M
from quillsift.operators import score as S
from quillsift.params import GATE, ScoreParams
from quillsift.shared import shuffle_width


class OnlineModel:
    """One owner's model in memory, scored and trained message by message."""

    def __init__(self, params: ScoreParams, counts: dict[str, list[int]] | None = None, good: int = 0, spam: int = 0):
        self.p, self.counts, self.good, self.spam = params, counts or {}, good, spam

    def probability(self, token: str) -> float:
        p, c = self.p, self.counts.get(token)
        if c is None or sum(c) < p.min_word_count:
            return p.new_word_score
        pw, qw = c[1] / max(self.spam, 1), p.good_bias * c[0] / max(self.good, 1)
        raw = pw / (pw + qw) if pw + qw > 0 else 0.5
        n = c[0] + c[1]
        return (p.strength * p.unknown_prob + n * raw) / (p.strength + n) if p.strength + n > 0 else p.new_word_score

    def score(self, tokens: list[str]) -> float:
        """The score of a message's distinct tokens."""
        p = self.p
        if self.good < 1 and self.spam < 1:
            return 0.5
        ranked = sorted(((abs(f - 0.5), t, f) for t in tokens for f in [self.probability(t)]), key=lambda x: (-x[0], x[1].encode()))
        kept = [f for i, (d, _, f) in enumerate(ranked[: p.max_interesting]) if p.min_distance <= 0 or d >= p.min_distance or i < p.min_array_size]
        if not kept:
            return 0.5
        if p.combine_mode == "geometric":
            c = [min(max(f, S.GEOMETRIC_LEAST), 1 - S.GEOMETRIC_LEAST) for f in kept]
            a, b = math.exp(sum(map(math.log, c)) / len(c)), math.exp(sum(math.log(1 - f) for f in c) / len(c))
            return a / (a + b)
        hs = -2 * sum(math.log(max(1 - f, S.LEAST)) for f in kept)
        hh = -2 * sum(math.log(max(f, S.LEAST)) for f in kept)
        return min(max((1 + (1 - _tail(hs, len(kept))) - (1 - _tail(hh, len(kept)))) / 2, 0.0), 1.0)

    def train(self, tokens: list[str], is_spam: bool, total: bool = True) -> None:
        for t in tokens:
            self.counts.setdefault(t, [0, 0])[is_spam] += 1
        if total:
            self.good, self.spam = self.good + (not is_spam), self.spam + is_spam

    def receive(self, tokens: list[str], gate: float = GATE) -> tuple[str, float, bool]:
        """Score, then train on the own verdict where it is sure enough."""
        s = self.score(tokens)
        verdict = "SPAM" if s >= self.p.threshold else "GOOD"
        trained = not (gate <= 0 or gate < s < 1 - gate)
        if trained:
            self.train(tokens, verdict == "SPAM")
        return verdict, s, trained

    def learn(self, tokens: list[str], is_spam: bool) -> int:
        """Train with a label, repeating the tokens (not the totals) until the score is sure. Returns the rounds."""
        self.train(tokens, is_spam)
        n = 1
        while n < self.p.train_max_reps:
            s = self.score(tokens)
            if s >= 0.9 if is_spam else s <= 0.1:
                break
            self.train(tokens, is_spam, total=False)
            n += 1
        return n


def _tail(x: float, half: int) -> float:
    if x <= 0:
        return 1.0
    m = x / 2
    t = s = math.exp(-m)
    for i in range(1, half):
        t *= m / i
        s += t
    return min(s, 1.0)


def replay(messages: DataFrame, params: ScoreParams | None = None, gate: float = GATE) -> DataFrame:
    """``u, msg_id, verdict, score, trained`` of ``u, msg_id, at, tokens, is_spam``, each owner in order of time.

    Labelled messages (``is_spam`` not null) train as labelled; the others are received.  Owners are sorted and
    streamed, never gathered: a worker holds one owner's model and one batch of messages.
    """
    p = params or ScoreParams()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, m = None, None
        for pdf in batches:
            rows = []
            for u, msg, tokens, label in zip(pdf["u"], pdf["msg_id"], pdf["tokens"], pdf["is_spam"]):
                if m is None or u != owner:
                    owner, m = u, OnlineModel(p)
                tokens = list(tokens) if tokens is not None else []
                if label is None or label != label:
                    rows.append((u, msg, *m.receive(tokens, gate)))
                else:
                    s = m.score(tokens)
                    m.learn(tokens, bool(label))
                    rows.append((u, msg, "SPAM" if s >= p.threshold else "GOOD", s, True))
            yield pd.DataFrame(rows, columns=["u", "msg_id", "verdict", "score", "trained"])

    src = messages.select("u", "msg_id", "at", "tokens", "is_spam").repartition(shuffle_width(messages.sparkSession), "u").sortWithinPartitions("u", "at", "msg_id")
    return src.mapInPandas(run, "u string, msg_id bigint, verdict string, score double, trained boolean")


def receive_batches(store, params: ScoreParams | None = None, gate: float = GATE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: scores a micro-batch (``u, msg_id, token, at``) by the stored model, appends the
    verdicts beside it and saves the model trained on those that are sure. A repeated batch overwrites itself."""
    p = params or ScoreParams()

    def handle(batch: DataFrame, batch_id: int) -> None:
        tokens, totals = store.open()
        messages = batch.select("u", "msg_id").distinct()
        out = f"{store.path}/verdicts/batch={batch_id}"
        S.classify(messages, batch.select("u", "msg_id", "token"), tokens, totals, p).write.mode("overwrite").parquet(out)
        scored = batch.sparkSession.read.parquet(out)
        sure = scored.filter((F.col("score") <= gate) | (F.col("score") >= 1 - gate)) if gate > 0 else scored.limit(0)
        labels = sure.select("msg_id", (F.col("verdict") == "SPAM").alias("is_spam"), F.current_timestamp().alias("at"))
        new_tokens = M.train_tokens(batch.select("u", "msg_id", "token"), labels)
        new_totals = M.train_totals(messages, labels)
        store.save(M.merge_tokens(tokens, new_tokens), M.merge_totals(totals, new_totals))

    return handle
