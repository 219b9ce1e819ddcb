"""Log lines of several programs into timestamp, level, component, message and delivery fields.

A lexer turns an entry into terminals; a weighted context-free grammar describes headers, fields and
continuations; an Earley parser keeps the highest-scoring parse; what only the catch-all rules cover is
reported as unparsed.  A parse depends on the sequence of terminals alone, so parses are kept by sequence
in each Python worker: the parser runs once for each shape of entry, not once for each entry.

Entries over several lines are put together without gathering a file: lines are cut into blocks of
``line_no``; the lines at the head of a block that continue an entry of an earlier block are given to that
block, by a list of such heads whose length is bounded by ``MAX_BLOCKS``.  Within a block the lines are
sorted and streamed.

Defined results
---------------
* null lines are empty lines; empty lines continue an entry
* a carriage return at a line's end belongs to the line end
* a line number occurring again within a file is read once
* lines in front of a file's first header make an entry without timestamp
* an empty table has no entries; further columns are ignored, whatever their names
* ``level`` is what the entry states, in small letters and one spelling; NULL where it states none
* ``component`` is the program, and its part behind a slash, without host and process number; NULL where none is named
* ``message`` has the entry from behind its header (stamp, host, component and, in front of them, level) to its end, with
  all its lines; of entries that quote or escape their message, the message itself
* ``spans`` has the line, start and end (exclusive) of all that only the catch-all rules cover, lines that are no field
  among it; ``unparsed`` counts its characters, without line breaks
* of a very long entry every line is read; ``deliveries`` does not keep lines that are no field
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions.earley import Grammar
from quillsift.shared import shuffle_width

BLOCK_LINES, MAX_BLOCKS = 2_000, 50_000

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_ISO = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_BLK = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?[+-]\d\d:?\d\d)?"
_SYS = _MONTH + r" [ \d]\d \d\d:\d\d:\d\d"
_CLF = r"\[\d\d/" + _MONTH + r"/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}\]"
_STR = r'"(?:[^"\\]|\\.)*"'
#: How a line that begins an entry begins (the same pattern for Java and Python).
HEADER = rf"^(?:{_ISO}|{_BLK}|{_SYS}|\[\d\d/{_MONTH}/\d{{4}}:|time=\d|<\d{{1,3}}>\d{{4}}-|\{{)"

TERMINALS = [
    ("SKIP", r'[ \t]+|\n[ \t]*(?=["}])'),
    ("NLUSER", r"\n[ \t]+user:"),
    ("NLVERD", r"\n[ \t]+verdict:"),
    ("NLFOLDER", r"\n[ \t]+folder:"),
    ("CONT", r"\n(?=[^ \t\n]|\n|$)[^\n]*|\n[ \t]*(?=\n|$)|\n[ \t]+(?:\||at )[^\n]*"),
    ("FOLD", r"\n[ \t]+"),
    ("PRI", r"<\d{1,3}>(?=\d{4}-)"),
    ("TSISO", _ISO + r"(?=\s|$)"),
    ("TSBLK", _BLK + r"(?=\s|$)"),
    ("TSSYS", _SYS + r"(?=\s|$)"),
    ("TSCLF", _CLF),
    ("TSKV", r"time=\d+(?:[.,]\d+)?(?=\s|$)"),
    ("MSGQ", r'msg="'),
    ("KLVL", r"level=\w+(?=\s)"),
    ("KCOMP", r"comp=[\w./-]+(?=\s)"),
    ("SESSB", r"\[sess=" + _STR + r"\]"),
    ("JTIME", r'"time"\s*:\s*"' + _ISO + '"'),
    ("JLVL", r'"lvl"\s*:\s*' + _STR),
    ("JUNIT", r'"unit"\s*:\s*' + _STR),
    ("JMSG", r'"msg"\s*:\s*"'),
    ("JPAIR", r'"\w+"\s*:\s*(?:' + _STR + r"|[\w.+-]+)"),
    ("LB", r"\{"),
    ("RB", r"\}"),
    ("COMMA", r","),
    ("CTX", r"[\w-]+\([^()\s]*\)<\d+><[^<>\s]*>:"),
    ("SIEVE", r"sieve:(?=\s|$)"),
    ("DELIV", r"DELIVERY:?(?=\s|$)"),
    ("LEVEL", r"(?:DEBUG|Debug|debug|INFO|Info|info|WARN|WARNING|Warning|ERROR|Error|error)(?=[:\s]|$):?"),
    ("KUSER", r"user=(?=\S)"),
    ("KVERD", r"verdict=(?=\S)"),
    ("KSCORE", r"score=(?=\S)"),
    ("KFOLDER", r"folder=" + _STR),
    ("ADDR", r'[^\s@<>"(),]+@[^\s@<>"(),]+'),
    ("ARROW", r"->(?=\s|$)"),
    ("VERD", r"(?i:spam|good)(?=[\s)]|$)"),
    ("NUM", r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?=[\s)\"]|$)"),
    ("LP", r"\("),
    ("RP", r"\)"),
    ("DQ", r'"'),
    ("TEXT", r'(?:\\.|[^\s()"{},])+|.'),
]
#: What follows a stamp, by its layout: host, program and the part of it that speaks; or level, thread and program.
_UNIT = r"(?P<UNIT>[\w./-]+)"
HEADS = {
    "TSISO": re.compile(rf"[ \t]+(?P<HOST>[\w.-]+)[ \t]+{_UNIT}(?:\[\d+\])?(?::(?=\s)(?:[ \t]+(?!sieve:|DELIVERY:|(?:DEBUG|INFO|WARN|WARNING|ERROR):)(?P<SUB>[\w-]+):(?=\s))?|(?=[ \t]\d+[ \t]))", re.I),
    "TSBLK": re.compile(rf"[ \t]+(?P<LEVEL>[A-Za-z]+)[ \t]+(?P<THREAD>\[[^\]\s]*\])[ \t]+{_UNIT}:(?=\s)"),
    "TSCLF": re.compile(rf"[ \t]+(?P<LEVEL>[A-Za-z]+)[ \t]+{_UNIT}[ \t]+(?P<DASH>-)(?=\s)"),
}
HEADS["TSSYS"] = HEADS["TSISO"]
#: Spellings of levels.
LEVELS = {"dbg": "debug", "warning": "warn", "err": "error"}
LEXER = re.compile("|".join(f"(?P<{n}>{p})" for n, p in TERMINALS))

_ANY = " | ".join(n for n, _ in TERMINALS if n not in ("SKIP", "CONT", "NLUSER", "NLVERD", "NLFOLDER"))
GRAMMAR = Grammar(
    f"""
    Entry -> Body
    Entry -> Body Tail
    Tail -> CONT | Tail CONT ; -0.5
    Body -> Framed | Json | Block | Pairs
    Body -> Stamp Words ; -50
    Body -> Stamp Source Words ; -49
    Body -> Stamp Source LEVEL Words ; -48
    Body -> Stamp Heading Words ; -49
    Body -> Words ; -100
    Stamp -> TSISO | TSBLK | TSSYS | TSCLF | TSKV | PRI TSISO
    Source -> HOST UNIT CTX | HOST UNIT | HOST UNIT SUB
    Heading -> LEVEL THREAD UNIT | LEVEL UNIT DASH
    # headers
    Framed -> TSISO Source SIEVE LEVEL Delivery
    Framed -> TSSYS Source LEVEL SIEVE Delivery
    Framed -> TSISO Source LEVEL SIEVE Delivery
    Framed -> TSSYS Source SIEVE LEVEL Delivery
    Framed -> PRI TSISO Source NUM DELIV SESSB Target
    Framed -> TSKV Attrs MSGQ Delivery DQ
    Attrs -> Attr | Attrs Attr
    Attr -> KLVL | KCOMP | TEXT
    Json -> LB Items RB
    Items -> Item | Items COMMA Item
    Item -> JTIME | JLVL | JUNIT | JPAIR | Message
    Message -> JMSG Delivery DQ | JMSG SIEVE Delivery DQ
    Block -> TSBLK Heading TEXT Lines | TSBLK Heading Lines
    Lines -> Line | Lines Line
    Line -> NLUSER Owner | NLVERD Verdict Score | NLFOLDER Folder
    Pairs -> TSCLF Heading DELIV PairList
    PairList -> Pair | PairList Pair
    Pair -> KUSER Owner | KVERD Verdict | KSCORE Score | Quoted
    # fields
    Delivery -> DELIV Target
    Target -> Owner ARROW Folder Result
    Target -> Owner ARROW FOLD Folder Result
    Owner -> ADDR
    Result -> LP Verdict Score RP
    Verdict -> VERD
    Score -> NUM
    Quoted -> KFOLDER
    Folder -> FTok ; -0.1
    Folder -> Folder FTok ; -0.1
    FTok -> TEXT | NUM | DQ | LP | RP | ARROW | ADDR | VERD | LEVEL | SIEVE | DELIV | COMMA | LB | RB | KUSER | KVERD | KSCORE | KFOLDER | MSGQ | CTX | PRI | KLVL | KCOMP
    # anything
    Words -> Word | Words Word ; -1
    Word -> {_ANY} | NLUSER | NLVERD | NLFOLDER
    """,
    "Entry",
)
#: Continuation lines that can be a field; all others are unparsed.
_FIELD_LINE = re.compile(r'[ \t]+(?:user:|verdict:|folder:)|[ \t]*["}]|[ \t]+(?!\||at )\S')


def _lex(text: str) -> tuple[tuple[str, ...], list[tuple[int, int]]]:
    names, spans = [], []
    at = 0
    # the stamp, and what follows it
    while len(names) < 2 and (m := LEXER.match(text, at)) and m.lastgroup in ("PRI", *HEADS):
        at = m.end()
        names.append(m.lastgroup)
        spans.append(m.span())
        if m.lastgroup in HEADS:
            if h := HEADS[m.lastgroup].match(text, at):
                for span, g in sorted((h.span(g), g) for g in h.groupdict() if h[g] is not None):
                    names.append(g)
                    spans.append(span)
                at = h.end()
            break
    for m in LEXER.finditer(text, at):
        name = m.lastgroup
        if name == "SKIP":
            continue
        if name in ("TEXT", "CONT") and names and names[-1] == name:
            spans[-1] = (spans[-1][0], m.end())
            continue
        names.append(name)
        spans.append(m.span())
    return tuple(names), spans


def _micros(stamp: str, year: int | None) -> int | None:
    """Microseconds since 1970 UTC of a timestamp in any of the layouts."""
    try:
        if stamp.startswith("time="):
            whole, _, frac = stamp[5:].replace(",", ".").partition(".")
            return int(whole) * 1_000_000 + int(frac[:6].ljust(6, "0"))
        if stamp[0] == "[":
            t, zone = stamp[1:-1].rsplit(" ", 1)
            day, month, rest = t.split("/")
            y, h, mi, s = rest.split(":")
            when, frac = datetime(int(y), MONTHS.index(month) + 1, int(day), int(h), int(mi), int(s)), ""
        elif stamp[0].isalpha():
            if year is None:
                return None
            h, mi, s = stamp[7:].split(":")
            when, frac, zone = datetime(year, MONTHS.index(stamp[:3]) + 1, int(stamp[4:6]), int(h), int(mi), int(s)), "", ""
        else:
            m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?(Z|[+-]\d\d:?\d\d)?", stamp)
            when, frac, zone = datetime(*(int(x) for x in m.groups()[:6])), m.group(7) or "", m.group(8) or ""
    except (ValueError, AttributeError):
        return None
    us = (when.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    us += int(frac[:6].ljust(6, "0")) if frac else 0
    if zone and zone != "Z":
        z = zone.replace(":", "")
        us -= (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[3:5])) * 60_000_000
    return us


_ESCAPE = re.compile(r"\\(.)", re.S)
_MESSAGE = r'[{,]\s*"msg"\s*:\s*(' + _STR + ")"
_YEAR = re.compile(r"(?<!\d)((?:19|20)\d\d)-\d\d-\d\d")
_SEEN: dict[tuple[str, ...], tuple | None] = {}


def parse_entry(text: str, file: str | None) -> dict:
    """The fields of one entry, from its highest-scoring parse."""
    names, spans = _lex(text)
    if names not in _SEEN:
        if len(_SEEN) > 20_000:
            _SEEN.clear()
        _SEEN[names] = GRAMMAR.parse(names) if names else None
    parse = _SEEN[names]
    out = dict.fromkeys(("ts_us", "level", "component", "owner", "verdict", "score_e6", "folder"))
    out["begin"], out["said"] = 0, None
    # what no rule covers but the catch-all ones, as bounds in the text
    out["spans"] = [] if parse or not text else [(0, len(text))]
    raw: dict[str, list[str]] = {}
    kind, units, stated = "Words", [], range(0)
    for name, i, j in parse[1] if parse else ():
        if name in ("Framed", "Json", "Block", "Pairs"):
            kind = name
        if name in ("Source", "Heading"):
            units = [(n, text[spans[k][0] : spans[k][1]]) for k, n in enumerate(names[i:j], i) if n in ("UNIT", "SUB", "CTX")]
            stated = range(i, j) if name == "Heading" else range(j, j + 1 + (names[j : j + 1] == ("SIEVE",)))
            j += names[0] == "PRI" and names[j : j + 1] == ("NUM",)  # the number of the process
            out["begin"] = spans[j][0] if j < len(spans) else len(text)
        elif name == "Attrs":
            out["begin"] = spans[j][0]
        if name in ("Owner", "Verdict", "Score", "Folder", "Quoted"):
            if name == "Folder" and raw.get("Folder") and i < raw["_end"]:
                continue  # the shorter prefixes of a folder
            raw.setdefault(name, []).append(text[spans[i][0] : spans[j - 1][1]])
            if name == "Folder":
                raw["_end"] = j
        elif name in ("Words", "Tail") and not raw.get(f"_{name}"):
            raw[f"_{name}"] = [text[spans[i][0] : spans[j - 1][1]]]
            out["spans"].append((spans[i][0], spans[j - 1][1]))
            if name == "Words" and not out["begin"] and i:
                out["begin"] = spans[i][0]
    year = _YEAR.findall(file or "")
    for k, (n, s) in enumerate(zip(names, spans)):
        t = text[s[0] : s[1]]
        if n in ("TSISO", "TSBLK", "TSSYS", "TSCLF", "TSKV", "JTIME"):
            if out["ts_us"] is None and (n == "JTIME") == (text[:1] == "{"):
                out["ts_us"] = _micros(t if n != "JTIME" else json.loads(t.split(":", 1)[1]), int(year[-1]) if year else None)
        elif (n == "LEVEL" and k in stated or n in ("KLVL", "JLVL")) and out["level"] is None:
            level = t.rstrip(":") if n == "LEVEL" else t.partition("=")[2] if n == "KLVL" else json.loads(t.split(":", 1)[1], strict=False)
            out["level"] = LEVELS.get(level.lower(), level.lower())
        elif n == "JUNIT":
            units = [("UNIT", json.loads(t.split(":", 1)[1], strict=False))]
        elif n == "KCOMP" and not units:
            units = [("UNIT", t[len("comp=") :])]
        elif n == "MSGQ" and text.startswith("time="):
            end = text.rfind('"')
            out["said"] = _ESCAPE.sub(r"\1", text[s[1] : end]) if end >= s[1] else None
    if text[:1] == "{":
        if m := re.search(_MESSAGE, text):
            try:
                out["said"] = json.loads(m[1], strict=False)
            except ValueError:
                pass
    out["component"] = "/".join(u.split("(")[0] for _, u in units) or None
    if kind != "Words":
        folders = raw.get("Folder", []) + raw.get("Quoted", [])
        if all(len(raw.get(k, ())) == 1 for k in ("Owner", "Verdict", "Score")) and len(folders) == 1:
            folder = folders[0]
            if raw.get("Quoted"):
                folder = _ESCAPE.sub(r"\1", folder[len('folder="') : -1])
            elif kind == "Json":
                try:
                    folder = json.loads(f'"{folder}"', strict=False)
                except ValueError:
                    folder = None
            elif text.startswith("time="):
                folder = _ESCAPE.sub(r"\1", folder)
            out |= {"owner": raw["Owner"][0], "verdict": raw["Verdict"][0].upper(), "folder": folder}
            out["score_e6"] = round(float(raw["Score"][0]) * 1_000_000)
    return out


ENTRY_DDL = (
    "file string, line_no bigint, lines bigint, ts_us bigint, level string, component string, message string, "
    "owner string, verdict string, score_e6 bigint, folder string, unparsed bigint, "
    "spans array<struct<line_no: bigint, start: int, end: int>>"
)
COLUMNS = [c.split()[0] for c in ENTRY_DDL.partition(", spans")[0].split(", ")] + ["spans"]
_HEAD = re.compile(HEADER)


def _detail(r: dict, lines: list[tuple[int, str, bool]]) -> None:
    """Replace bounds in the parsed text by the lines they are on; add the lines left out of it and the message.

    ``lines`` are the entry's numbers, lines, and whether they are in the parsed text.
    """
    spans, parsed, begin, at, message = [], sorted(r.pop("spans")), r.pop("begin"), 0, r.pop("said")
    for k, (no, line, kept) in enumerate(lines):
        pieces = [(0, len(line))]
        if kept:
            pieces = [(max(a - at, 0), min(b - at, len(line))) for a, b in parsed]
            if message is None and begin <= at + len(line):
                message = "\n".join([line[max(begin - at, 0) :], *(x for _, x, _ in lines[k + 1 :])])
            at += len(line) + 1
        spans += [{"line_no": no, "start": a, "end": b} for a, b in pieces if a < b]
    r |= {"message": message, "spans": spans, "unparsed": sum(x["end"] - x["start"] for x in spans)}


def _entries(batches: Iterator[pd.DataFrame], detail: bool) -> Iterator[pd.DataFrame]:
    at: tuple | None = None  # file and first line
    text: list[tuple[int, str, bool]] = []
    count, last = 0, None
    rows: list[dict] = []

    def flush() -> None:
        if at is not None:
            r = parse_entry("\n".join(line for _, line, kept in text if kept), at[0])
            if detail:
                _detail(r, text)
            else:
                r |= {"message": None, "spans": None, "unparsed": None}
            rows.append({"file": at[0], "line_no": at[1], "lines": count} | r)

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS)

    for pdf in batches:
        for file, block, no, line in zip(pdf["file"], pdf["block"], pdf["line_no"], pdf["line"]):
            if last == (file, no):
                continue
            line = (line or "").rstrip("\r")
            new = at is None or last[0] != file or _HEAD.match(line) is not None
            last = (file, no)
            if new:
                flush()
                at, text, count = (file, no), [(no, line, True)], 1
                continue
            count += 1
            kept = _FIELD_LINE.match(line) is not None
            if kept or detail:
                text.append((no, line, kept))
        if rows:
            yield frame()
            rows = []
    flush()
    if rows:
        yield frame()


def parse_log(lines: DataFrame, detail: bool = True) -> DataFrame:
    """One row per entry of ``file, line_no, line``; without ``detail`` message, spans and unparsed are NULL."""
    spark = lines.sparkSession
    src = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"))
    size = max(BLOCK_LINES, -(-src.count() // MAX_BLOCKS))
    cut = src.withColumn("block", F.floor(F.col("line_no") / size))
    # where each block's first entry begins; blocks without any belong to the last block that has one
    firsts = cut.groupBy("file", "block").agg(
        F.min(F.when(F.regexp_replace(F.col("line"), "\r+$", "").rlike(HEADER), F.col("line_no"))).alias("first"), F.min("line_no").alias("low")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        firsts.withColumn("owner", F.last(F.when(F.col("first").isNotNull(), F.col("block")), ignorenulls=True).over(before))
        .filter("owner is not null and (first is null or first > low)")
        .select(F.col("file").alias("f"), F.col("block").alias("b"), "first", "owner")
    )
    # at most one row for each block of a file but its first: MAX_BLOCKS rows whatever the input
    cut = cut.join(F.broadcast(heads), F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")), "left")
    owned = F.when(F.col("owner").isNotNull() & (F.col("first").isNull() | (F.col("line_no") < F.col("first"))), F.col("owner")).otherwise(F.col("block"))
    parts = (
        cut.select("file", owned.alias("block"), "line_no", "line")
        .repartition(shuffle_width(spark), "file", "block")
        .sortWithinPartitions("file", "block", "line_no")
    )
    return parts.mapInPandas(lambda batches: _entries(batches, detail), ENTRY_DDL)


def deliveries(lines: DataFrame) -> DataFrame:
    """``file, line_no, ts_us, verdict, score_e6, folder`` of every complete delivery entry."""
    return parse_log(lines, detail=False).filter("verdict is not null").select("file", "line_no", "ts_us", "verdict", "score_e6", "folder")
