"""The command surface as one object: score, receive, explain, train, counts, cleanup, export, import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import model as M
from quillsift.operators import score as S
from quillsift.operators.tokenize import message_tokens
from quillsift.params import ScoreParams, TokenizerConfig
from quillsift.shared import materialize
from quillsift.sources.files import ModelStore
from quillsift.sources.mime import parse_messages


class Classifier:
    """A stored model of any number of owners and what can be done with it.

    Messages are DataFrames with ``u``, ``msg_id`` and either ``content`` (raw) or ``tokens``.
    """

    def __init__(self, spark: SparkSession, path: str, params: ScoreParams | None = None, config: TokenizerConfig | None = None):
        self.spark, self.params, self.config = spark, params or ScoreParams(), config or TokenizerConfig()
        self.store = ModelStore(spark, path)

    def tokenize(self, messages: DataFrame) -> DataFrame:
        """``u, msg_id, token``."""
        if "tokens" not in messages.columns:
            messages = message_tokens(parse_messages(messages, keep=("u", "msg_id")), self.config)
        return messages.select("u", "msg_id", F.explode("tokens").alias("token"))

    def score(self, messages: DataFrame) -> DataFrame:
        """``u, msg_id, verdict, score, line``, without touching the model; GOOD 0.5 where anything is missing."""
        out = S.classify(messages, self.tokenize(messages), *self.store.open(), self.params)
        verdict, score = S.fail_open(F.col("verdict"), F.col("score"))
        return out.select("u", "msg_id", verdict.alias("verdict"), score.alias("score"), S.verdict_line(verdict, score).alias("line"))

    def explain(self, messages: DataFrame) -> DataFrame:
        return S.explain_nested(self.tokenize(messages), *self.store.open_existing(), self.params)

    def train(self, messages: DataFrame, is_spam: bool) -> int:
        """Train all messages as one kind. Returns the new version.

        With ``train_max_reps`` above 1, the tokens (not the totals) of the messages whose score is not sure yet are
        trained again, all of them at once, up to so many times.
        """
        tokens, totals = self.store.open()
        ids = messages.select("u", "msg_id").distinct()
        labels = ids.select("msg_id", F.lit(is_spam).alias("is_spam"), F.current_timestamp().alias("at"))
        t = materialize(self.tokenize(messages), "training")
        version = self.store.save(M.merge_tokens(tokens, M.train_tokens(t, labels)), M.merge_totals(totals, M.train_totals(ids, labels)))
        for _ in range(self.params.train_max_reps - 1):
            tokens, totals = self.store.open()
            s = F.col("score")
            unsure = materialize(S.classify(ids, t, tokens, totals, self.params).filter(s < 0.9 if is_spam else s > 0.1).select("u", "msg_id"), "unsure")
            if unsure.isEmpty():
                break
            again = t.join(unsure, ["u", "msg_id"], "left_semi")
            version = self.store.save(M.merge_tokens(tokens, M.train_tokens(again, labels)), totals)
        return version

    def spam(self, messages: DataFrame) -> int:
        return self.train(messages, True)

    def good(self, messages: DataFrame) -> int:
        return self.train(messages, False)

    def receive(self, messages: DataFrame, gate: float, batch_id: int = 0) -> DataFrame:
        """Score, then train on the sure ones."""
        from quillsift.streaming.learn import receive_batches

        t = self.tokenize(messages)
        receive_batches(self.store, self.params, gate)(messages.select("u", "msg_id").join(t, ["u", "msg_id"], "left"), batch_id)
        return self.spark.read.parquet(f"{self.store.path}/verdicts/batch={batch_id}")

    def counts(self) -> DataFrame:
        return M.counts(*self.store.open())

    def cleanup(self, min_count: int = 1, days: int = 0) -> int:
        tokens, totals = self.store.open()
        return self.store.save(M.cleanup(tokens, min_count, days), totals)

    def export(self) -> DataFrame:
        """``u, line``, the total first, then by word."""
        return M.export_lines(*self.store.open()).orderBy("u", "word").select("u", "line")

    def import_(self, lines: DataFrame) -> int:
        """Add the counts of exported lines (``u, line``)."""
        tokens, totals = self.store.open()
        new_tokens, new_totals = M.import_lines(lines)
        return self.store.save(M.merge_tokens(tokens, new_tokens), M.merge_totals(totals, new_totals))
