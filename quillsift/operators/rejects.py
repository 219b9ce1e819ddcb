"""Lines of exported models into rows, and into rejects with their reason.

Structural indexing: the lines of an Arrow batch are one byte buffer.  numpy masks find the quotes,
the prefix parity of the quotes tells which commas delimit, and counts per line and per field decide
between a loaded row and a reason.  No line is walked byte by byte in Python, and nothing is shuffled.

Defined results
---------------
* null, empty and blank lines (also a lone carriage return): neither row nor reject
* repeated lines: judged each for itself
* an empty table: no rows
* a very long line: its bytes are part of the batch like any other's
* further columns of the input are ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA, BLANK, TAB, CR = 34, 44, 32, 9, 13
INT64_MAX = 9223372036854775807
FIELDS = 4

OUT = pa.schema(
    [
        ("csv_id", pa.int64()),
        ("file", pa.string()),
        ("line_no", pa.int64()),
        ("reason", pa.string()),
        ("word", pa.string()),
        ("good", pa.int64()),
        ("spam", pa.int64()),
    ]
)
OUT_DDL = "csv_id bigint, file string, line_no bigint, reason string, word string, good bigint, spam bigint"


def _joined(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all lines, and each line's start and end within them (null: an empty line)."""
    raw = raw.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    return buf, off[:-1].copy(), off[1:].copy()


def _trim(solid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move bounds inwards over blanks: ``solid`` holds the positions of all bytes that aren't blank."""
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = j > i
    if not len(solid):
        return start, start
    a = np.where(some, solid[np.minimum(i, len(solid) - 1)], start)
    b = np.where(some, solid[np.maximum(j - 1, 0)] + 1, start)
    return a, b


def index_lines(raw: pa.Array) -> dict:
    """Judge all lines of a batch. Returns ``kind`` (-1 nothing, 0 row, 1 quoting, 2 columns, 3 value) and,
    by line, the values of valid rows."""
    n = len(raw)
    buf, start, end = _joined(raw)
    # one final carriage return belongs to the line end
    last = np.maximum(end - 1, 0)
    if len(buf):
        end = np.where((end > start) & (buf[np.minimum(last, len(buf) - 1)] == CR), end - 1, end)
    solid = np.flatnonzero((buf != BLANK) & (buf != TAB))
    a, b = _trim(solid, start, end)
    present = b > a
    kind = np.full(n, -1, np.int8)
    kind[present] = 0

    quote = buf == QUOTE
    quotes = np.flatnonzero(quote)
    before = np.zeros(len(buf) + 1, np.int64)  # quotes in front of each byte
    np.cumsum(quote, out=before[1:])
    line_of = np.repeat(np.arange(n), np.diff(np.append(start, len(buf))))
    odd_end = ((before[end] - before[start]) & 1) == 1  # an open quoted field

    commas = np.flatnonzero(buf == COMMA)
    if len(commas):
        commas = commas[commas < end[line_of[commas]]]
        commas = commas[((before[commas] - before[start[line_of[commas]]]) & 1) == 0]  # even parity: they delimit
    delims = np.bincount(line_of[commas], minlength=n) if n else np.zeros(0, np.int64)

    # all fields of all lines, in order
    first = np.concatenate([[0], np.cumsum(delims + 1)])[:-1]  # each line's first field
    total = int((delims + 1).sum())
    f_start, f_end = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[first], is_last[first + delims] = True, True
    f_start[is_first], f_start[~is_first] = start, commas + 1
    f_end[is_last], f_end[~is_last] = end, commas
    f_line = np.repeat(np.arange(n), delims + 1)
    fa, fb = _trim(solid, f_start, f_end)
    q0, q1 = np.searchsorted(quotes, f_start), np.searchsorted(quotes, f_end)
    nq = q1 - q0
    has = nq > 0
    starts = np.zeros(total, bool)
    ends = np.zeros(total, bool)
    if len(buf):
        starts[has] = quote[fa[has]]
        ends[has] = quote[fb[has] - 1]
    bad = has & (~starts | ~ends | (nq & 1 == 1))
    # inside a quoted field every quote stands beside its double: the 2nd with the 3rd, the 4th with the 5th
    if len(quotes):
        f_of_q = np.searchsorted(f_start, quotes, side="right") - 1
        within = quotes < f_end[f_of_q]
        rank = np.arange(len(quotes)) - q0[f_of_q]
        lead = within & (rank & 1 == 1) & (rank < nq[f_of_q] - 1)
        nxt = np.append(quotes[1:], -1)
        alone = lead & (nxt != quotes + 1)
        bad[f_of_q[alone]] = True
    bad_line = np.zeros(n, bool)
    bad_line[f_line[bad]] = True
    bad_line |= odd_end
    kind[present & bad_line] = 1
    kind[(kind == 0) & (delims != FIELDS - 1)] = 2

    ok = np.flatnonzero(kind == 0)
    quoted = has
    va, vb = fa + quoted, fb - quoted  # without the enclosing quotes
    data = buf.tobytes()
    good, spam, words = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
    digit = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
    fields = first[ok]
    digits = [(vb[fields + k] > va[fields + k]) & (digit[vb[fields + k]] - digit[va[fields + k]] == vb[fields + k] - va[fields + k]) for k in (0, 1)]
    control = np.concatenate([[0], np.cumsum((buf < 32) | (buf == 127))])
    w = fields + 3
    plain = (vb[w] > va[w]) & (control[vb[w]] == control[va[w]])
    for i, f, numeric, fine in zip(ok.tolist(), fields.tolist(), (digits[0] & digits[1]).tolist(), plain.tolist()):
        if not (numeric and fine):
            kind[i] = 3
            continue
        g = data[va[f] : vb[f]].lstrip(b"0") or b"0"
        s = data[va[f + 1] : vb[f + 1]].lstrip(b"0") or b"0"
        word = data[va[f + 3] : vb[f + 3]].decode("utf-8", "replace")
        if len(g) > 19 or len(s) > 19 or (x := int(g)) > INT64_MAX or (y := int(s)) > INT64_MAX:
            kind[i] = 3
            continue
        if not word.isascii() and ("�" in word or any("\x80" <= c <= "\x9f" for c in word)):
            kind[i] = 3
            continue
        good[i], spam[i], words[i] = x, y, word.replace('""', '"') if quoted[f + 3] else word
    return {"kind": kind, "good": good, "spam": spam, "word": words}


REASONS = [None, "quoting", "columns", "value"]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = index_lines(batch.column("raw"))
        keep = np.flatnonzero(r["kind"] >= 0)
        if not len(keep):
            continue
        take = pa.array(keep)
        valid = r["kind"][keep] == 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("csv_id").take(take),
                batch.column("file").take(take).cast(pa.string()),
                batch.column("line_no").take(take),
                pa.array([REASONS[k] for k in r["kind"][keep].tolist()], pa.string()),
                pa.array([r["word"][i] for i in keep.tolist()], pa.string()),
                pa.array(r["good"][keep], pa.int64(), mask=~valid),
                pa.array(r["spam"][keep], pa.int64(), mask=~valid),
            ],
            schema=OUT,
        )


def judge_lines(lines: DataFrame) -> DataFrame:
    """One row for each line that is not blank: ``reason`` NULL with word, good and spam, or the reason.

    Input columns: ``csv_id``, ``file``, ``line_no``, ``raw``.  A narrow transformation.
    """
    want = lines.select(
        F.col("csv_id").cast("bigint"), F.col("file").cast("string"), F.col("line_no").cast("bigint"), F.col("raw").cast("string")
    )
    return want.mapInArrow(_judge, OUT_DDL)


def rejected(lines: DataFrame) -> DataFrame:
    """``csv_id, reason`` of every line that fails."""
    return judge_lines(lines).filter(F.col("reason").isNotNull()).select("csv_id", "reason")


def loaded(lines: DataFrame) -> DataFrame:
    """The valid rows."""
    return judge_lines(lines).filter(F.col("reason").isNull()).drop("reason")


def reject_report(lines: DataFrame) -> DataFrame:
    """Lines and rejects by file and reason."""
    return (
        judge_lines(lines)
        .groupBy("file", F.coalesce("reason", F.lit("loaded")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
