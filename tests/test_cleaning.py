"""The general cleaning operators on small inputs: nulls, ties, repeats, empty tables, further columns, long values."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.functions.earley import Grammar
from quillsift.operators import logparse, orphans, rejects, upsert
from quillsift.operators.rejects import REASONS, index_lines


def judge(line):
    """A line read byte by byte: None, a row or a reason."""
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip(" \t"):
        return None
    fields, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in " \t":
            i += 1
        if i < n and line[i] == '"':
            i += 1
            out = ""
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            while i < n and line[i] in " \t":
                i += 1
            if i < n and line[i] != ",":
                return "quoting"
            fields.append(out)
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j].rstrip(" \t"))
            i = j
        if i >= n:
            break
        i += 1
    if len(fields) != 4:
        return "columns"
    g, s, _, w = fields
    ok = all(x and x.isascii() and x.isdigit() and int(x) < 2**63 for x in (g, s)) and w and not any(ord(c) < 32 or 127 <= ord(c) < 160 or c == "�" for c in w)
    return (w, int(g), int(s)) if ok else "value"


def test_index_examples():
    lines = ['1,2,0,"w"', ' 1 , 2,, "w ""x""" \r', "1,2,0,w", '1,2,0,"w', '1,2,0,"w"x', '1,2,0,w"', "1,2,0", "1,2,0,w,", '1,2,0,"a,b"', "-1,2,0,w", '1,2,0,""', "9223372036854775808,1,0,w", "0009223372036854775807,1,0,w", "\r", "", "  ", None, '1,2,0,"a\tb"', "1,2,0,�", '"1","2","","w"', '1,2,0,""""', '1,2,0,"""', "１,2,0,w", "x" * 100_000]
    r = index_lines(pa.array(lines))
    for i, line in enumerate(lines):
        want = judge(line or "")
        got = None if r["kind"][i] < 0 else REASONS[r["kind"][i]] or (r["word"][i], r["good"][i], r["spam"][i])
        assert got == want, (line, got, want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",1a \t\ré', max_size=14), min_size=1, max_size=8))
def test_index_random(lines):
    r = index_lines(pa.array(lines, pa.string()))
    for i, line in enumerate(lines):
        got = None if r["kind"][i] < 0 else REASONS[r["kind"][i]] or (r["word"][i], r["good"][i], r["spam"][i])
        assert got == judge(line), line


def test_rejects_frame(spark):
    df = spark.createDataFrame([(1, "f", 1, '1,2,0,"w"', "x"), (2, None, None, "bad", "y"), (2, None, None, "bad", "y"), (None, "f", 2, None, "z")], "csv_id bigint, file string, line_no bigint, raw string, reason string")
    assert sorted(map(tuple, rejects.rejected(df).collect())) == [(2, "columns"), (2, "columns")]
    assert [r.word for r in rejects.loaded(df).collect()] == ["w"]
    assert rejects.judge_lines(df.limit(0)).count() == 0


ML = "row_id bigint, u string, session string, msgid string, batch_id int, loaded_at timestamp, id string"
DS = "row_id bigint, ts string, u string, verdict string, score string, folder string, session string, batch_id int, loaded_at timestamp, rank string"
MF = "file_id bigint, u string, folder string, path string, msgid string, seen_at timestamp, deleted_at timestamp"
T0 = datetime(2026, 2, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def tables(spark, seed, n=300):
    r = random.Random(seed)
    ses = [f"s{i}" for i in range(n // 3)] + ["hot"] * (n // 3)
    dress = lambda x: r.choice(["%s", " <%s> ", "%s\t", "<%s"]) % x if x is not None else None
    hours = lambda: r.choice([None, *range(40)])
    mids = [f"m{i}@Host.Example" for i in range(n // 6)] + ["hot@h"] * (n // 8) + ["noid", "", "<>", None, "plain"]
    case = lambda m: m if m is None or "@" not in m or r.random() < 0.5 else m.split("@")[0] + "@" + m.split("@")[1].lower()
    stamps = ["2026-02-01T05:00:00Z", "2026-02-01 06:00:00,5 +0100", "1769904000.25", "-", None, "0000-00-00T00:00:00"]
    ml = [(i, r.choice(["a", "b", None]), dress(r.choice([*ses, "", None])), dress(case(r.choice(mids))), r.choice([None, 1, 95, 200]), at(hours()), "x") for i in range(n)]
    ds = [(i, r.choice(stamps), "a", "GOOD", "0.1", "f", dress(r.choice([*ses, "lost", None])), 1, at(hours()), "x") for i in range(n)]
    mf = [(i, "a", "f", "p", dress(case(r.choice(mids))), at(r.choice(range(40))), at(r.choice([None, *range(40)]))) for i in range(n)]
    return ml, ds, mf


def key(x, mid=False):
    x = (x or "").strip(" \t\r\n<>")
    if mid and "@" in x:
        a, _, b = x.rpartition("@")
        x = a + "@" + b.lower()
    return None if not x or (mid and x == "noid") else x


def test_orphans(spark):
    for seed in (1, 2):
        ml, ds, mf = tables(spark, seed)
        want = set()
        for name, rows, col, others, oc in (("delivery_start", ds, 6, ml, 2), ("msgid_line", ml, 2, ds, 6)):
            for row in rows:
                if (k := key(row[col])) is None:
                    continue
                seen = [o[8] if others is ds else o[5] for o in others if key(o[oc]) == k]
                mine = row[8] if rows is ds else row[5]
                if not seen:
                    want.add((name, "session", row[0], "missing"))
                elif not any(s is not None and (mine is None or s <= mine) for s in seen):
                    want.add((name, "session", row[0], "late"))
        for row in ml:
            if (k := key(row[3], True)) is None:
                continue
            files = [(f[5], f[6]) for f in mf if key(f[4], True) == k]
            now = row[5] or datetime(2100, 1, 1)
            if not files:
                want.add(("msgid_line", "msgid", row[0], "missing"))
            elif not any(a <= now and (b is None or b > now) for a, b in files):
                want.add(("msgid_line", "msgid", row[0], "deleted" if any(a <= now for a, _ in files) else "late"))
        small = (orphans.BLOCK_ROWS, orphans.PIECE_ROWS)
        orphans.BLOCK_ROWS, orphans.PIECE_ROWS = 7, 5  # so that hot keys go over several blocks and pieces
        try:
            got = orphans.orphans(spark.createDataFrame(ds, DS), spark.createDataFrame(ml, ML), spark.createDataFrame(mf, MF)).collect()
        finally:
            orphans.BLOCK_ROWS, orphans.PIECE_ROWS = small
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    e = spark.createDataFrame([], MF), spark.createDataFrame([], ML), spark.createDataFrame([], DS)
    assert orphans.orphans(e[2], e[1], e[0]).count() == 0
    long = spark.createDataFrame([(1, "a", "s" * 100_000, None, 1, at(1), "x")], ML)
    assert [tuple(r) for r in orphans.orphans(e[2], long, e[0]).collect()] == [("msgid_line", "session", 1, "missing")]


def test_upsert(spark):
    ml, ds, _ = tables(spark, 3)
    times = {"2026-02-01T05:00:00Z": 1769922000.0, "2026-02-01 06:00:00,5 +0100": 1769922000.5, "1769904000.25": 1769904000.25}
    first: dict = {}
    for d in ds:
        if key(d[6]) and d[1] in times:
            first[key(d[6])] = min(times[d[1]], first.get(key(d[6]), 1e18))
    groups: dict = {}
    for m in ml:
        if m[1] and key(m[3], True):
            groups.setdefault((m[1], key(m[3], True)), []).append((first.get(key(m[2]), 1e18), m[0]))
    want = {i for g in groups.values() for _, i in sorted(g)[1:]}
    M, D = spark.createDataFrame(ml, ML), spark.createDataFrame(ds, DS)
    got = [r[0] for r in upsert.surplus(M, D).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert upsert.surplus(M.limit(0), D.limit(0)).count() == 0


def test_upsert_is_idempotent(spark):
    df = spark.createDataFrame([(1, "k", 5, 1), (1, "k", 3, 2), (2, "k", 3, 1), (2, "j", 1, 9)], "run int, id string, rank bigint, row_id bigint")
    s = upsert.UpsertStore(spark, 3).upsert(df).upsert(df.filter("run = 1"))
    want = {("k", 3, 1), ("j", 1, 9)}
    assert {tuple(r) for r in s.kept().collect()} == want
    plan = s.kept()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the buckets are the distribution
    s.compact()
    assert {tuple(r) for r in s.kept().collect()} == want
    assert {tuple(r) for r in s.upsert(df.filter("run = 2")).kept().collect()} == want


def test_earley_prefers_weight():
    g = Grammar("S -> A | B ; -1\nA -> X A | X\nB -> X B ; 5\nB -> X", "S")
    assert g.parse(("X", "X"))[1][1][0] == "B" and g.parse(("X",))[1][1][0] == "A"
    assert g.parse(("Y",)) is None and g.parse(()) is None


LOG = [
    "2026-03-24T02:00:49.937139+02:00 mx dovecot: lmtp(a@b.example)<1><S+/>: sieve: DEBUG: DELIVERY: a@b.example ->",
    "\tIn -> Out (SPAM .5)\r",
    "-- mark --",
    "Mar 24 00:02:53 mx dovecot[7]: lmtp(a@b.example)<7><S>: Debug: sieve: DELIVERY: a@b.example -> Clients (old) (good 1e-3)",
    'time=1774310541.649688 level=debug comp=sieve sess=1/y msg="DELIVERY: a@b.example -> Kids \\"A\\" (SPAM 0.545070)"',
    "2026-03-24 00:04:47,554 DEBUG [lmtp-8] sieve.delivery: session x",
    "    folder: 受信箱",
    "    user: a@b.example",
    "    verdict: Spam 9.908660e-01",
    "{",
    '  "msg": "sieve: DELIVERY: a@b.example -> \\u53d7 (GOOD 0.25)",',
    '  "time": "2026-03-24T00:12:07.000Z"',
    "}",
    '<16>2026-03-24T02:27:28+02:00 mx p 1 DELIVERY [sess="0"] a@b.example -> Junk (GOOD .331105)',
    '[24/Mar/2026:02:37:38 +0200] DEBUG lmtp/sieve - DELIVERY user=a@b.example folder="Kids \\"A\\"" verdict=GOOD score=0.454994',
    "2026-03-24T02:24:19+02:00 mx dovecot: lmtp(a@b.example)<9><A>: Error: sieve: script failed, context follows",
    "\t| Mar 24 00:39:51 mx dovecot[4]: lmtp(a@b.example)<4><r>: Debug: sieve: DELIVERY: a@b.example -> In (SPAM 0.7)",
    "2026-03-24T02:24:19+02:00 mx dovecot: lmtp(a@b.example)<9><A>: sieve: DEBUG: DELIVERY: a@b.example -> Junk ()",
    None,
    "2026-03-24 00:00:00,000 DEBUG [lmtp-4] sieve.delivery: session R",
    "    folder: Junk",
]
WANT = {
    1: (1774310449937139, "SPAM", 500000, "In -> Out"),
    4: (1774310573000000, "GOOD", 1000, "Clients (old)"),
    5: (1774310541649688, "SPAM", 545070, 'Kids "A"'),
    6: (1774310687554000, "SPAM", 990866, "受信箱"),
    10: (1774311127000000, "GOOD", 250000, "受"),
    14: (1774312048000000, "GOOD", 331105, "Junk"),
    15: (1774312658000000, "GOOD", 454994, 'Kids "A"'),
}


def test_log_layouts(spark):
    rows = [("log/mail-2026-03-24.log", i, x, "extra") for i, x in enumerate(LOG, 1)]
    df = spark.createDataFrame(rows + rows[3:5], "file string, line_no bigint, line string, block string")
    for size in (2_000, 2):
        old, logparse.BLOCK_LINES = logparse.BLOCK_LINES, size
        try:
            assert {r.line_no: tuple(r)[2:] for r in logparse.deliveries(df).collect()} == WANT
            assert logparse.parse_log(df).agg(F.sum("lines")).first()[0] == len(LOG)
        finally:
            logparse.BLOCK_LINES = old
    assert logparse.parse_log(df.limit(0)).count() == 0


def test_log_spans(spark, tmp_path):
    """Lines that are no field stay in the message, and every unparsed span can be read back from the lines."""
    from quillsift.plans import cleaning

    log = [LOG[15], "Traceback:", "  at x.y(z)", "", "    at q", "\t| tail\r", LOG[3], "odd line", "no header at all"]
    df = spark.createDataFrame([("m-2026-03-24.log", i, x) for i, x in enumerate(log, 1)], "file string, line_no bigint, line string")
    for size in (2_000, 2):
        old, logparse.BLOCK_LINES = logparse.BLOCK_LINES, size
        try:
            got = {r.line_no: r for r in logparse.parse_log(df).collect()}
        finally:
            logparse.BLOCK_LINES = old
        assert sorted(got) == [1, 7]
        assert got[1].message.endswith("script failed, context follows\n" + "\n".join(x.rstrip("\r") for x in log[1:6])) and not got[1].message.startswith("2026")
        assert got[7].message == "\n".join([log[6].split(">: ", 1)[1], *log[7:9]]) and got[7].verdict == "GOOD"
        assert (got[7].component, got[7].level) == ("dovecot/lmtp", "debug")
        texts = {k: [log[s.line_no - 1][s.start : s.end] for s in r.spans] for k, r in got.items()}
        assert texts[7] == log[7:9] and texts[1][1:] == ["Traceback:", "  at x.y(z)", "    at q", "\t| tail"] and texts[1][0].endswith("context follows")
        assert all(r.unparsed == sum(map(len, texts[k])) for k, r in got.items())
    df.write.parquet(f"{tmp_path}/mail_log.parquet")
    rows = cleaning.p3_entries_by_level(spark, str(tmp_path)).collect()
    assert {(r.level, r.component) for r in rows} == {(r.level, r.component) for r in got.values()} and sum(r.unparsed for r in rows) == sum(r.unparsed for r in got.values())
    assert cleaning.p3_unparsed(spark, str(tmp_path)).count() == 7


def test_log_long_entry():
    text = LOG[3].replace("Clients (old)", "x (" * 3000)
    assert logparse.parse_entry(text, "mail-2026-03-24")["score_e6"] == 1000
    assert logparse.parse_entry("", None)["verdict"] is None
