"""Evaluation texts inside training documents, found through a distributed positional inverted index.

The index has a posting list of token positions, sorted, for every term of every shard; a shard holds up to
``SHARD_TOKENS`` tokens of whole documents.  Positions run through the shard, with a gap between documents, so an
offset-adjusted list is a subtraction.  Postings are partitioned by a hash of their term and sorted by term: a
test set reads only the partitions of its own terms.  ``PositionalIndex.build`` stores an index under a path once,
``PositionalIndex(spark, path)`` opens it for any test set.

A test item is cut into all its windows of ``words`` terms.  The rarest term of each window (counted over the
whole corpus) leads: a shard is asked for an item only if it holds one of the item's leading terms.  There the
leading term's list, less its place in the item, gives the diagonals on which the window may lie; they are
intersected with the offset-adjusted lists of the terms that a window's neighbours share, rarest first, and what
is left is compared with all terms of the item.  Items travel as a joined table, to the shards they ask; nothing of
a test set is collected or broadcast, and a shard that very many items ask is cut into pieces.

Items in scripts without blanks are matched by characters (letters and digits) instead of words.

Defined results
---------------
* null, empty and blank texts have no terms; neither do items shorter than a window match anything
* repeats of a document are found each; a repeated item id is matched as one item with several texts
* case, width, composition, punctuation, blanks, line breaks, quote marks at line starts and characters
  without width make no difference; empty tables give nothing; further columns are ignored
* a very long document is a shard of its own
* ``near``: of equally rare terms of a window the first in the order of the alphabet leads
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.texts import plain, spread
from quillsift.shared import drop_path, materialize, scratch_path, shuffle_width

WORDS, CHARACTERS = 12, 20
#: Terms of a shard before the next document begins another one; positions left free between documents.
SHARD_TOKENS, GAP = 1_500_000, 64
#: Partitions of an index by term; shares into which the postings of a term are cut when they are written.
BUCKETS, SHARES = 16, 16
#: Items that one task looks up in a shard at most.
ITEMS_OF_PIECE = 2_000
BLANKLESS = ("zh", "ja")

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_IDEOGRAPH = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")

POSTINGS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("positions", pa.list_(pa.int32()))])
POSTINGS_DDL = "shard bigint, term string, positions array<int>"


def words(text: str) -> list[str]:
    """The words of a text, as they are compared."""
    return _WORD.findall(plain(text))


def characters(text: str) -> list[str]:
    """The letters and digits of a text, as they are compared, each marked as a character."""
    return ["\x01" + c for w in _WORD.findall(plain(text)) for c in w]


def _shard(batches: Iterator[pa.RecordBatch], all_characters: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    terms: dict[str, int] = {}
    ids: list[np.ndarray] = []
    starts: list[int] = []
    docs: list[int] = []
    at = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal shard, terms, ids, starts, docs, at
        if not docs:
            return
        # the document table of the shard, under the empty term: first positions and both halves of the ids
        doc = np.array(docs, np.int64)
        table = np.concatenate([np.array(starts, np.int64), doc >> 32, doc & 0xFFFFFFFF]).astype(np.uint32).view(np.int32)
        all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        where = np.concatenate([np.arange(s, s + len(x), dtype=np.int32) for s, x in zip(starts, ids)]) if ids else np.zeros(0, np.int32)
        order = np.argsort(all_ids, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(all_ids, minlength=len(terms)))]).astype(np.int32)
        offsets = np.concatenate([[0], cuts + len(table)]).astype(np.int32)
        values = np.concatenate([table, where[order]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms) + 1, shard, np.int64)),
                pa.array(["", *terms], pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ],
            schema=POSTINGS,
        )
        shard, terms, ids, starts, docs, at = shard + 1, {}, [], [], [], 0

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text or doc_id is None:
                continue
            found = words(text)
            streams = [found] if found else []
            if found and (all_characters or _IDEOGRAPH.search(text)):
                streams.append(["\x01" + c for w in found for c in w])
            for stream in streams:
                ids.append(np.fromiter((terms.setdefault(t, len(terms)) for t in stream), np.int32, len(stream)))
                starts.append(at)
                docs.append(doc_id)
                at += len(stream) + GAP
            if at > SHARD_TOKENS:
                yield from emit()
    yield from emit()


class PositionalIndex:
    """A stored index: ``bucket, shard, term, positions`` below a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    @staticmethod
    def build(documents: DataFrame, path: str | None = None, all_characters: bool = False, buckets: int = BUCKETS) -> PositionalIndex:
        """Index all documents (``doc_id, text``) under a path, or under a fresh one.

        Documents without ideographs or kana have character postings only if ``all_characters``.
        """
        spark = documents.sparkSession
        path = path or scratch_path(spark, "positional-index")
        src = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
        postings = src.mapInArrow(lambda b: _shard(b, all_characters), POSTINGS_DDL).withColumn("bucket", _bucket("term", buckets))
        # a common term's lists go to as many tasks as it has shares
        postings = postings.repartition(shuffle_width(spark), "bucket", F.pmod(F.xxhash64("shard"), F.lit(SHARES)))
        postings.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(path)
        return PositionalIndex(spark, path, buckets)

    def postings(self, terms: DataFrame) -> DataFrame:
        """``shard, term, positions`` of the terms of a table (``term``), from their partitions alone."""
        wanted = terms.select("term").distinct().withColumn("bucket", _bucket("term", self.buckets))
        here = [r[0] for r in wanted.select("bucket").distinct().collect()]  # as many rows as there are partitions at most
        stored = self.spark.read.schema(f"{POSTINGS_DDL}, bucket int").parquet(self.path)
        if len(here) < self.buckets:
            stored = stored.filter(F.col("bucket").isin(here))
        return stored.join(wanted, ["bucket", "term"], "left_semi").select("shard", "term", "positions")

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def _bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text, lang in zip(pdf["item_id"], pdf["text"], pdf["lang"]):
            blankless = (lang or "").strip().lower()[:2] in BLANKLESS
            terms, width = (characters(text), CHARACTERS) if blankless else (words(text), WORDS)
            if len(terms) >= width:
                rows.append((item, terms, width))
        yield pd.DataFrame(rows, columns=["item_id", "terms", "width"])


def cut_items(items: DataFrame) -> DataFrame:
    """``item_id, terms, width`` of the items that have a window, stored in the shared folder."""
    src = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    src = src.filter("item_id is not null and text is not null")
    return materialize(src.mapInPandas(_cut_items, "item_id bigint, terms array<string>, width int"), "items")


def needs_all_characters(items: DataFrame) -> bool:
    """Whether an item has a window of characters without any ideograph or kana: that could be in any document."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = False
        for pdf in batches:
            for terms, width in zip(pdf["terms"], pdf["width"]):
                if width == CHARACTERS and not found:
                    own = np.cumsum([0, *(bool(_IDEOGRAPH.search(c)) for c in terms)])
                    found = bool((own[width:] == own[:-width]).any())
        yield pd.DataFrame({"found": [found]})

    return items.mapInPandas(look, "found boolean").filter("found").limit(1).count() > 0


def _leaders(terms: list[str], rarity: np.ndarray, width: int) -> np.ndarray:
    """For every window of an item, the place of its rarest term; -1 where the corpus lacks one of its terms."""
    n = len(terms) - width + 1
    absent = np.concatenate([[0], np.cumsum(rarity == 0)])
    order = np.empty(len(terms), np.int64)
    order[np.lexsort((np.arange(len(terms)), terms, rarity))] = np.arange(len(terms))
    lead = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1) + np.arange(n)
    return np.where(absent[width:] == absent[:-width], lead, -1)


def _lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, item, width, places in zip(pdf["key"], pdf["item_id"], pdf["width"], pdf["places"]):
            places = sorted((r["i"], r["term"], r["n"]) for r in places)
            terms, rarity = [p[1] for p in places], np.array([p[2] for p in places], np.int64)
            leaders = _leaders(terms, rarity, width)
            leading = sorted({terms[k] for k in leaders if k >= 0})
            if leading:
                rows.append((key, item, width, terms, rarity, leading))
        yield pd.DataFrame(rows, columns=["key", "item_id", "width", "terms", "rarity", "leading"])


def _open(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """A shard's first positions and ids of documents, and the posting lists of its test terms."""
    lists = {t: p for t, p in zip(pdf["term"], pdf["positions"])}
    table = np.asarray(lists.pop("", np.zeros(0, np.int32)), np.int32).view(np.uint32).astype(np.int64)
    n = len(table) // 3
    docs = (table[n : 2 * n].astype(np.uint32).view(np.int32).astype(np.int64) << 32) | table[2 * n :]
    return table[:n], docs, {t: np.asarray(p, np.int64) for t, p in lists.items()}


def _has(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _diagonals(terms: list[str], rarity: np.ndarray, width: int, lists: dict[str, np.ndarray]) -> np.ndarray:
    """Where an item may begin in a shard so that one of its windows is there: offset-adjusted lists, rarest first."""
    lead = _leaders(terms, np.array([r if t in lists else 0 for t, r in zip(terms, rarity)]), width)
    found = []
    i, n, half = 0, len(lead), width // 2
    while i < n:
        k = lead[i]
        if k < 0:
            i += 1
            continue
        j = i
        while j + 1 < n and lead[j + 1] == k and j + 1 - i < half:
            j += 1
        left = lists[terms[k]] - k
        # these places are in all of the windows i..j
        shared = [x for x in range(j, i + width) if x != k]
        for x in sorted(shared, key=lambda x: rarity[x]):
            left = left[_has(lists[terms[x]], left + x)]
            if not len(left):
                break
        if len(left):
            found.append(left)
        i = j + 1
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _lookup(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    """The matches of one shard: runs of consecutive terms of an item in a document."""
    starts, docs, lists = _open(pdf)
    out = []
    for item, width, terms, rarity in zip(asked["item_id"], asked["width"], asked["terms"], asked["rarity"]):
        terms = list(terms)
        at = _diagonals(terms, np.asarray(rarity), width, lists)
        if not len(at):
            continue
        nothing = np.zeros(len(at), bool)
        hit = np.stack([_has(lists[t], at + j) if t in lists else nothing for j, t in enumerate(terms)])
        # runs down each diagonal
        edge = np.diff(np.pad(hit.astype(np.int8), ((1, 1), (0, 0))), axis=0)
        d0, first = np.nonzero(edge.T == 1)
        _, past = np.nonzero(edge.T == -1)
        length = past - first
        long = length >= width
        where = at[d0[long]] + first[long]
        which = np.searchsorted(starts, where, side="right") - 1
        out.append(pd.DataFrame({"item_id": item, "doc_id": docs[which], "length": length[long]}))
    if not out:
        return pd.DataFrame({"item_id": [], "doc_id": [], "runs": [], "longest": []}).astype("int64")
    runs = pd.concat(out)
    return runs.groupby(["item_id", "doc_id"], as_index=False).agg(runs=("length", "size"), longest=("length", "max"))


def _near(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    """Proximity matches of one shard: all terms of a window, in any order, within its width of the leading one."""
    starts, docs, lists = _open(pdf)
    out = []
    for item, width, terms, rarity in zip(asked["item_id"], asked["width"], asked["terms"], asked["rarity"]):
        terms, rarity = list(terms), np.asarray(rarity)
        lead = _leaders(terms, np.array([r if t in lists else 0 for t, r in zip(terms, rarity)]), width)
        close: dict[tuple[str, str], np.ndarray] = {}  # which places of a leading term have another one near
        for i in np.flatnonzero(lead >= 0).tolist():
            head = terms[lead[i]]
            at = lists[head]
            left = np.ones(len(at), bool)
            for t in sorted(set(terms[i : i + width]) - {head}, key=lambda t: len(lists[t])):
                ok = close.get((head, t))
                if ok is None:
                    other = lists[t]
                    k = np.searchsorted(other, at)
                    after, before = other[np.minimum(k, len(other) - 1)], other[np.maximum(k - 1, 0)]
                    ok = close[head, t] = np.minimum(np.abs(after - at), np.abs(before - at)) <= width
                left = left & ok
                if not left.any():
                    break
            if left.any():
                which = np.unique(np.searchsorted(starts, at[left], side="right") - 1)
                out.append(pd.DataFrame({"item_id": item, "doc_id": docs[which], "window": i}))
    if not out:
        return pd.DataFrame({"item_id": [], "doc_id": [], "windows": []}).astype("int64")
    return pd.concat(out).groupby(["item_id", "doc_id"], as_index=False).size().rename(columns={"size": "windows"})


def search(index: PositionalIndex, items: DataFrame, look, ddl: str) -> DataFrame:
    """Look items (of :func:`cut_items`) up in every shard that has one of their leading terms."""
    spark = index.spark
    keyed = items.withColumn("key", F.xxhash64("item_id", F.array_join("terms", " "))).dropDuplicates(["key", "item_id"])
    places = keyed.select("key", "item_id", "width", F.posexplode("terms").alias("i", "term"))
    # the lists of all test terms, and the table of documents, which is under the empty term
    terms = places.select("term").unionByName(spark.range(1).select(F.lit("").alias("term"))).distinct()
    lists = materialize(index.postings(terms), "postings")
    counts = lists.groupBy("term").agg(F.sum(F.size("positions")).cast("bigint").alias("n"))
    rare = places.join(counts, "term", "left").groupBy("key", "item_id", "width")
    rare = rare.agg(F.collect_list(F.struct("i", "term", F.coalesce("n", F.lit(0)).alias("n"))).alias("places"))
    asked = materialize(
        rare.mapInPandas(_lead, "key bigint, item_id bigint, width int, terms array<string>, rarity array<bigint>, leading array<string>"), "asked"
    )
    asks = asked.select("key", "item_id", F.explode("leading").alias("term")).join(lists.select("term", "shard"), "term").select("key", "item_id", "shard").distinct()
    # a shard that many items ask is looked up in pieces
    pieces = asks.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ITEMS_OF_PIECE).cast("int").alias("pieces"))
    own = asks.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("key", "item_id"), F.col("pieces")).cast("int"))
    own = own.join(asked, ["key", "item_id"]).select("shard", "piece", "item_id", "width", "terms", "rarity")
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("there_piece")
    there = lists.join(pieces, "shard").select(F.col("shard").alias("there_shard"), each, "term", "positions")
    return own.groupBy("shard", "piece").cogroup(there.groupBy("there_shard", "there_piece")).applyInPandas(look, ddl)


def _leaks(index: PositionalIndex, items: DataFrame) -> DataFrame:
    per_shard = search(index, items, _lookup, "item_id bigint, doc_id bigint, runs bigint, longest bigint")
    # a document's words and characters are in one shard, so each pair comes once for each stream
    return per_shard.groupBy("item_id", "doc_id").agg(F.sum("runs").alias("runs"), F.max("longest").alias("longest"))


def _nearby(index: PositionalIndex, items: DataFrame) -> DataFrame:
    per_shard = search(index, items, _near, "item_id bigint, doc_id bigint, windows bigint")
    return per_shard.groupBy("item_id", "doc_id").agg(F.sum("windows").alias("windows"))


def _once(documents: DataFrame, items: DataFrame, ask) -> DataFrame:
    """Build an index, ask it, and drop it once the answer is written."""
    wanted = cut_items(items)
    index = PositionalIndex.build(documents, all_characters=needs_all_characters(wanted))
    try:
        return materialize(ask(index, wanted), "leaks")
    finally:
        index.drop()


def leaks(documents: DataFrame | PositionalIndex, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, runs, longest``: every document, of a table or a stored index, with passages of an item.

    ``longest`` counts consecutive words, or characters for items in scripts without blanks.
    """
    if isinstance(documents, PositionalIndex):
        return _leaks(documents, cut_items(items))
    return _once(documents, items, _leaks)


def near(documents: DataFrame | PositionalIndex, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, windows``: proximity matches, by how many of the item's windows, of all there are, have all their
    terms close together in a document, in whatever order."""
    if isinstance(documents, PositionalIndex):
        return _nearby(documents, cut_items(items))
    return _once(documents, items, _nearby)
