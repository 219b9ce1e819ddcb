"""Filling containers of a fixed number of tokens with texts that belong together.

Lexical retrieval packing.  Texts are measured and described in tokens of a public tokenizer; document
frequencies are counted over all documents (as many counters as the tokenizer has tokens).  Documents are
sharded by a hash of their id; neighbours in other shards are not found (the README has the share).  Each
shard has a BM25 inverted index over its texts: for the largest unused text as the seed, all its terms ask
the index, which returns the unused neighbours by score, which greedily fill the seed's container; what
space is left takes the largest texts that still fit.  Containers that a shard cannot fill are opened again
and packed with those of other shards, in a second and a third round over ever fewer texts.

A text is split only if it alone exceeds the capacity: into full containers and a rest, which is packed like
any other text.

Defined results
---------------
* null and empty texts have no tokens and need no container; blank texts have tokens and are packed
* repeats of a document are packed each; ties go to the smaller document id and piece
* empty tables give nothing; capacities of null or below 1 are left out; further columns are ignored
* special tokens of the tokenizer occurring in a text are ordinary text
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.texts import spread
from quillsift.shared import materialize

#: Documents of a shard on average; below this fill a container is opened again; a term has a row of weights if more
#: than one in so many texts has it.
SHARD_DOCS, FULL, COMMON = 3_000, 0.985, 16
K1, B = 1.2, 0.75
#: Kinds of containers at most: they come to the driver.
MAX_KINDS = 1_000

_ENCODERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder(path: str):
    """The tokenizer of a file of ranks, kept in each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of all documents with at least one token, stored in the shared folder."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            pdf = pdf[pdf["text"].notna() & (pdf["text"] != "")]
            ids = [np.array(enc.encode_ordinary(t), np.int32) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "ids": ids})

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = spread(src.filter("doc_id is not null"))
    return materialize(src.mapInPandas(encode, "doc_id bigint, ids array<int>"), "tokenized")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by token, documents, and their mean length, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(0, np.int64), 0, 0
        for pdf in batches:
            for ids in pdf["ids"]:
                own = np.unique(ids)
                if own[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(own[-1] + 1 - len(df), np.int64)])
                df[own] += 1
                n, total = n + 1, total + len(ids)
        has = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(has, [-1, -2]), "df": np.append(df[has], [n, total])})

    # one row for each token of the vocabulary
    rows = dict(tokens.mapInPandas(count, "term int, df bigint").groupBy("term").agg(F.sum("df").cast("bigint")).collect())
    n, total = rows.pop(-1, 0), rows.pop(-2, 0)
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    for t, c in rows.items():
        df[t] = c
    return df, n, total / max(n, 1)


def _describe(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms and their BM25 weights, the most telling ones first."""
    terms, tf = np.unique(ids, return_counts=True)
    weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
    order = np.argsort(-weight, kind="stable")
    return terms[order].astype(np.int32), weight[order].astype(np.float32)


def fill(sizes: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Pack texts (in order of preference at equal sizes); returns the texts of each container."""
    n = len(sizes)
    if not n:
        return []
    # the inverted index: postings by term, and rows of weights for the terms that many texts have
    ends = np.cumsum([0, *map(len, terms)])
    at = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    vocabulary, code = np.unique(np.concatenate(terms), return_inverse=True)
    order = np.argsort(code, kind="stable")
    weight, at = np.concatenate(weights)[order], at[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(vocabulary)))])
    held = np.diff(first)
    common = np.flatnonzero(held * COMMON > n)
    row = np.full(len(vocabulary), -1)
    row[common] = np.arange(len(common))
    dense = np.zeros((len(common), n), np.float32)
    for r, (lo, hi) in enumerate(zip(first[common].tolist(), first[common + 1].tolist())):
        dense[r, at[lo:hi]] = weight[lo:hi]

    def scores(seed: int) -> np.ndarray:
        """BM25 of all texts for all terms of the seed."""
        asking = code[ends[seed] : ends[seed + 1]]
        total = dense[row[asking[row[asking] >= 0]]].sum(axis=0)
        rare = asking[(row[asking] < 0) & (held[asking] > 1)]
        if len(rare):
            parts = [slice(lo, hi) for lo, hi in zip(first[rare].tolist(), first[rare + 1].tolist())]
            total += np.bincount(np.concatenate([at[x] for x in parts]), np.concatenate([weight[x] for x in parts]), n)
        return total

    unused = np.ones(n, bool)
    by_size = np.lexsort((np.arange(n), sizes))
    sorted_sizes = sizes[by_size]
    below = np.arange(-1, n)  # below[k + 1]: the last unused place at or under k

    def last_unused(k: int) -> int:
        root = k
        while root >= 0 and not unused[by_size[root]]:
            root = below[root]
        while k >= 0 and k != root:
            below[k], k = root, below[k]
        return root

    below = np.arange(-1, n - 1)
    out = []
    for place in range(n - 1, -1, -1):
        seed = by_size[place]
        if not unused[seed]:
            continue
        unused[seed] = False
        box, left = [int(seed)], capacity - int(sizes[seed])
        if left >= sorted_sizes[0]:
            score = scores(seed)
            near = np.flatnonzero((score > 0) & unused & (sizes <= left))
            for k in near[np.argsort(-score[near], kind="stable")].tolist():
                if sizes[k] <= left:
                    unused[k] = False
                    box.append(k)
                    left -= int(sizes[k])
                    if left < sorted_sizes[0]:
                        break
            # the rest of the space: the largest that fit
            while left >= sorted_sizes[0]:
                k = last_unused(int(np.searchsorted(sorted_sizes, left, side="right")) - 1)
                if k < 0:
                    break
                unused[by_size[k]] = False
                box.append(int(by_size[k]))
                left -= int(sorted_sizes[k])
        out.append(box)
    return out


ITEM = "kind string, capacity int, doc_id bigint, piece int, first_token bigint, n_tokens int"
PACKED = f"{ITEM}, container string, place int, filled int, terms array<int>, weights array<float>"
_COLUMNS = [c.split()[0] for c in PACKED.split(", ")]


def _rows(items: list[tuple], terms, weights, capacity: int, name: str) -> list[tuple]:
    """Rows of packed items; those of containers not full keep their description for the next round."""
    sizes = np.array([i[5] for i in items], np.int64)
    rows = []
    for c, box in enumerate(fill(sizes, terms, weights, capacity)):
        filled = int(sizes[box].sum())
        again = filled < FULL * capacity
        for place, k in enumerate(box):
            rows.append((*items[k], f"{name}-{c}", place, filled, terms[k] if again else None, weights[k] if again else None))
    return rows


def pack(documents: DataFrame, kinds: DataFrame, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``kind, container, place, doc_id, piece, first_token, n_tokens, filled, capacity`` of every text or piece."""
    spark = documents.sparkSession
    found = kinds.filter("kind is not null and capacity >= 1").select("kind", F.col("capacity").cast("int")).distinct().limit(MAX_KINDS + 1).collect()
    if len(found) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    wanted = sorted((r[0], r[1]) for r in found)
    tokens = tokenized(documents, tokenizer or default_tokenizer())
    df, n, mean = statistics(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((wanted, idf, max(mean, 1.0)))

    def first_round(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds_, idf_, mean_ = shared.value
        pdf = pdf.sort_values("doc_id", kind="stable")
        shard = int(pdf["shard"].iloc[0])
        rows: list[tuple] = []
        whole = None
        for kind, capacity in kinds_:
            items, terms, weights = [], [], []
            if whole is None:
                whole = [_describe(ids, idf_, mean_) for ids in pdf["ids"]]
            for doc, ids, (t, w) in zip(pdf["doc_id"], pdf["ids"], whole):
                size = len(ids)
                full = size // capacity if size > capacity else 0
                for p in range(full):
                    rows.append((kind, capacity, doc, p, p * capacity, capacity, f"{kind}-d{doc}-{p}", 0, capacity, None, None))
                rest = size - full * capacity
                if rest:
                    if full:
                        t, w = _describe(ids[full * capacity :], idf_, mean_)
                    items.append((kind, capacity, doc, full, full * capacity, rest))
                    terms.append(t)
                    weights.append(w)
            rows += _rows(items, terms, weights, capacity, f"{kind}-a{shard}")
        return pd.DataFrame(rows, columns=_COLUMNS)

    def next_round(mark: str):
        def pack_again(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
            kind, capacity, shard = pdf["kind"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
            items = list(pdf[_COLUMNS[:6]].itertuples(index=False, name=None))
            rows = _rows(items, [np.asarray(t, np.int32) for t in pdf["terms"]], [np.asarray(w, np.float32) for w in pdf["weights"]], capacity, f"{kind}-{mark}{shard}")
            return pd.DataFrame(rows, columns=_COLUMNS)

        return pack_again

    shards = max(1, -(-n // shard_docs))
    cut = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    packed = materialize(cut.groupBy("shard").applyInPandas(first_round, PACKED), "packed-a")
    done = packed.filter("terms is null")
    for mark, ratio in (("b", 16), ("c", 256)):
        if shards <= ratio // 16:
            break
        # what is open is a small share of each shard, so a group of many shards is as large as one was
        again = packed.filter("terms is not null").withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(max(1, shards // ratio))).cast("int"))
        packed = materialize(again.groupBy("kind", "shard").applyInPandas(next_round(mark), PACKED), f"packed-{mark}")
        done = done.unionByName(packed.filter("terms is null"))
    return done.unionByName(packed.filter("terms is not null")).drop("terms", "weights")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and fill of each kind."""
    return packed.groupBy("kind").agg(
        F.countDistinct("container").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.round(F.sum("n_tokens") / (F.countDistinct("container") * F.max("capacity")), 6).alias("fill"),
    )
