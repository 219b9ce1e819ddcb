"""References to records that do not exist, are gone or come later.

Parents are range-partitioned by key and time and kept as blocks of sorted arrays.  A directory of the
blocks' first keys, whose length is bounded by ``MAX_BLOCKS`` whatever the number of parents, routes every
reference to the one block that can answer it.  References meet their block in batches and are resolved
by binary search over the whole batch at once; a hot block's references are cut into pieces of a fixed
size, each of which gets its own copy of the block.

A parent is an interval ``[t, e)`` in which it is present; within a key each entry also carries the
latest ``e`` so far, so one probe tells: no entry of the key - ``missing``; an entry, but none by then -
``late``; some by then, one of them still present - no case; else ``deleted``.  An entry of a key at the
start of a block carries the latest ``e`` of the blocks before it.

Defined results
---------------
* null and empty references, and ``noid`` as a msgid, refer to nothing and are never reported
* a reference without ``loaded_at`` counts as read after everything
* parents without ``seen_at``/``loaded_at`` exist, but from no time on: they can only make a case ``late``
* repeated rows are judged each for itself; an empty parent table makes every reference ``missing``
* further columns of the inputs are ignored, whatever their names
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.shared import materialize, narrow_key, shuffle_width, with_references

#: Entries of a block at least, blocks of the directory at most, references of a piece at most.
BLOCK_ROWS, MAX_BLOCKS, PIECE_ROWS = 20_000, 20_000, 50_000
FOREVER = 9_000_000_000_000_000_000
NEVER = FOREVER - 1
#: Offset that makes every time a non-negative number of 19 digits.
SHIFT = 4_600_000_000_000_000_000

BLOCK_DDL = "part int, seq int, keys array<binary>, t array<bigint>, e array<bigint>"


def _probe_key(key, t):
    """Key and time as one string that sorts like the pair."""
    return F.encode(F.concat(key, F.lit("\x00"), F.lpad(F.least(t, F.lit(4_400_000_000_000_000_000)).__add__(F.lit(SHIFT)).cast("string"), 19, "0")), "UTF-8")


def _blocks(rows_per_block: int):
    def build(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []
        n = 0

        def emit(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal seq
            ck = pdf["ck"].to_numpy(object)
            key = np.array([c[:-20] for c in ck], object)
            e = pdf["e"].to_numpy(np.int64)
            new = np.ones(len(e), bool)
            new[1:] = key[1:] != key[:-1]
            # running maximum within each key: shift each key's values above those of the keys before it
            group = np.cumsum(new) - 1
            order = np.unique(e)
            level = np.searchsorted(order, e) + group * len(order)
            run = order[np.maximum.accumulate(level) - group * len(order)]
            out = pd.DataFrame({"part": [part], "seq": [seq], "keys": [list(ck)], "t": [pdf["t"].to_numpy(np.int64)], "e": [run]})
            seq += 1
            return out

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            while n >= rows_per_block:
                all_rows = pd.concat(held, ignore_index=True)
                yield emit(all_rows.iloc[:rows_per_block])
                rest = all_rows.iloc[rows_per_block:]
                held, n = [rest], len(rest)
        if n:
            yield emit(pd.concat(held, ignore_index=True))

    return build


class ParentRanges:
    """Parents as sorted arrays per range. ``parents``: ``key STRING, t BIGINT, e BIGINT``, one row per (key, t)."""

    def __init__(self, parents: DataFrame):
        spark = parents.sparkSession
        entries = materialize(parents.select(_probe_key(F.col("key"), F.col("t")).alias("ck"), "t", "e"), "parents")
        per_block = max(BLOCK_ROWS, -(-entries.count() // MAX_BLOCKS))
        ranges = entries.repartitionByRange(shuffle_width(spark), "ck").sortWithinPartitions("ck")
        self.blocks = materialize(ranges.mapInPandas(_blocks(per_block), BLOCK_DDL), "parent-ranges")
        # at most MAX_BLOCKS rows and one for each range: the first and last entry of each block
        head = self.blocks.select(
            "part", "seq", F.col("keys")[0].alias("lo"), F.element_at("keys", -1).alias("hi"), F.element_at("e", -1).alias("hi_e")
        ).toPandas()
        head = head.sort_values(["part", "seq"], ignore_index=True)
        self.lo = [bytes(x) for x in head["lo"]]
        #: latest end so far of a key that goes on from the block before
        self.carry = []
        key, e = None, -FOREVER
        for lo, hi, hi_e in zip(head["lo"], head["hi"], head["hi_e"]):
            lo, hi = bytes(lo), bytes(hi)
            self.carry.append(e if lo[:-20] == key else -FOREVER)
            same = lo[:-20] == hi[:-20] == key
            key, e = hi[:-20], max(hi_e, e) if same else hi_e
        self.n = len(self.lo)
        self.directory = spark.createDataFrame(
            [
                (int(p), int(s), i, c, (self.lo[i + 1][:-20] if i + 1 < self.n else b""))
                for i, (p, s, c) in enumerate(zip(head["part"], head["seq"], self.carry))
            ],
            "part int, seq int, block int, carry bigint, next_key binary",
        )
        self.spark = spark

    def probe(self, refs: DataFrame) -> DataFrame:
        """``refs``: ``src_table, src_field, row_id, key, t``. Returns those that are no case left out, with ``reason``."""
        if not self.n:
            return refs.select("src_table", "src_field", "row_id", F.lit("missing").alias("reason"))
        bounds = self.spark.sparkContext.broadcast(np.array(self.lo, dtype=object))

        @F.pandas_udf("int")
        def route(ck: pd.Series) -> pd.Series:
            # the block whose first entry is the last one not above the reference
            at = np.searchsorted(bounds.value, ck.to_numpy(object), side="right") - 1
            return pd.Series(np.maximum(at, 0).astype(np.int32))

        routed = refs.select("src_table", "src_field", "row_id", _probe_key(F.col("key"), F.col("t")).alias("ck")).withColumn("block", route("ck"))
        routed = materialize(routed, "references")
        pieces = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces"))
        # one row per block: bounded like the directory
        pieces = F.broadcast(materialize(pieces, "pieces"))
        cut = routed.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("row_id", "src_field"), F.col("pieces")).cast("int")).drop("pieces")
        arrays = (
            self.blocks.join(F.broadcast(self.directory), ["part", "seq"])
            .join(pieces, "block")
            .select("block", "carry", "next_key", "keys", "e", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        )
        return (
            cut.groupBy("block", "piece")
            .cogroup(arrays.groupBy("block", "piece"))
            .applyInPandas(_resolve, "src_table string, src_field string, row_id bigint, reason string")
        )


def _resolve(refs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    if not len(refs) or not len(block):
        return pd.DataFrame(columns=["src_table", "src_field", "row_id", "reason"], dtype=object)
    keys, ends = block["keys"].iloc[0], block["e"].iloc[0]
    carry, next_key = block["carry"].iloc[0], bytes(block["next_key"].iloc[0])
    width = max(max(map(len, keys)), int(refs["ck"].str.len().max()))
    have = np.array([bytes(k) for k in keys], dtype=f"S{width}")
    want = refs["ck"].to_numpy(object)
    pos = np.searchsorted(have, want.astype(f"S{width}"), side="right") - 1
    key_of = np.array([bytes(k)[:-20] for k in keys], object)
    wanted = np.array([bytes(k)[:-20] for k in want], object)
    when = np.array([int(bytes(k)[-19:]) for k in want], np.int64) - SHIFT
    prev = np.maximum(pos, 0)
    started = (pos >= 0) & (key_of[prev] == wanted)
    first_key = key_of[0]
    end = np.asarray(ends, np.int64)[prev]
    end = np.where(wanted == first_key, np.maximum(end, carry), end)
    after = np.minimum(pos + 1, len(keys) - 1)
    later = np.where(pos + 1 < len(keys), key_of[after] == wanted, wanted == next_key)
    reason = np.where(started, np.where(end > when, "", "deleted"), np.where(later, "late", "missing"))
    keep = reason != ""
    out = {c: refs[c].to_numpy(object)[keep] for c in ("src_table", "src_field", "row_id")}
    return pd.DataFrame(out | {"reason": reason[keep].astype(object)})


def _micros(c):
    return F.unix_micros(F.col(c))


def orphans(delivery_start: DataFrame, msgid_line: DataFrame, mailbox_file: DataFrame) -> DataFrame:
    """``src_table, src_field, row_id, reason`` of every reference that its target can't answer."""
    def keyed(df: DataFrame, keep: dict, sessions: dict, msgids: dict) -> DataFrame:
        df = with_references(df.select(*(c.alias(k) for k, c in keep.items()), *{*sessions.values(), *msgids.values()}), sessions, msgids)
        return df.withColumns({k: narrow_key(F.col(k)) for k in (*sessions, *msgids)})

    row = {"row_id": F.col("row_id").cast("bigint"), "t": _micros("loaded_at")}
    both = keyed(msgid_line, row, {"s": "session"}, {"m": "msgid"})
    ses = {
        "delivery_start": keyed(delivery_start, row, {"k": "session"}, {}),
        "msgid_line": both.select("row_id", F.col("s").alias("k"), "t"),
    }
    mid = both.select("row_id", F.col("m").alias("k"), "t")
    files = keyed(mailbox_file, {"t": _micros("seen_at"), "e": _micros("deleted_at")}, {}, {"k": "msgid"})

    def tagged(tag):
        return F.concat(F.lit(tag), F.col("k"))

    never, forever = F.lit(NEVER), F.lit(FOREVER)
    parents = None
    # a session's first row is all that counts: one entry per key, combined before the shuffle
    for tag, df in (("m", ses["msgid_line"]), ("d", ses["delivery_start"])):
        p = df.filter("k is not null").groupBy(tagged(tag).alias("key")).agg(F.min(F.coalesce("t", never)).alias("t")).withColumn("e", forever)
        parents = p if parents is None else parents.unionByName(p)
    f = (
        files.filter("k is not null")
        .groupBy(tagged("f").alias("key"), F.coalesce("t", never).alias("t"))
        .agg(F.max(F.coalesce("e", forever)).alias("e"))
    )
    parents = parents.unionByName(f)

    def refs(df, tag, name, field):
        return df.filter("k is not null").select(
            F.lit(name).alias("src_table"), F.lit(field).alias("src_field"), "row_id", tagged(tag).alias("key"),
            F.coalesce("t", F.lit(4_300_000_000_000_000_000)).alias("t"),
        )

    asked = (
        refs(ses["delivery_start"], "m", "delivery_start", "session")
        .unionByName(refs(ses["msgid_line"], "d", "msgid_line", "session"))
        .unionByName(refs(mid, "f", "msgid_line", "msgid"))
    )
    return ParentRanges(parents).probe(asked)


def orphan_report(delivery_start: DataFrame, msgid_line: DataFrame, mailbox_file: DataFrame) -> DataFrame:
    """Misses by table, field, batch and reason."""
    miss = orphans(delivery_start, msgid_line, mailbox_file)
    batch = (
        delivery_start.select(F.lit("delivery_start").alias("src_table"), F.col("row_id").cast("bigint").alias("row_id"), "batch_id")
        .unionByName(msgid_line.select(F.lit("msgid_line").alias("src_table"), F.col("row_id").cast("bigint").alias("row_id"), "batch_id"))
    )
    return (
        miss.join(batch, ["src_table", "row_id"], "left")
        .groupBy("src_table", "src_field", "batch_id", "reason")
        .agg(F.count(F.lit(1)).alias("misses"))
    )
