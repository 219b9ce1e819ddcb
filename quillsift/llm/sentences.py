"""Sentence units of texts in any language, by a hidden-event n-gram model over words.

Between two tokens of a text there is a hidden event: a boundary, or none.  The model has

* the chance of a boundary after a token, given that token and the event before it: words in front of a stop by
  themselves, backed off to their class (how often they stand without a stop, their length and letters), all
  other tokens by their kind;
* what begins a sentence: the next token after a boundary, by word, backed off to its shape;
* what goes on: the next token after no boundary, given the token before, backed off in the same way.

Nothing is listed: that a word is an abbreviation is learned from how seldom it stands without its stop and from
what follows it.  Training needs no labels.  One pass over the texts writes, for every block, where a boundary
is possible and the runs of neighbouring possible boundaries; equal runs are counted together over all
documents, every gap of every run among them; expectation maximisation runs the forward-backward algorithm over
each different run, as a job over that table.  The texts aren't read again: the posteriors of each run decide the
written blocks.

A boundary is possible after stops and after closed passages that hold one; in Thai at blanks; and in a block of
many words without any stop in front of every word with a capital letter.  A quoted or bracketed passage is one
token.

Defined results
---------------
* null, empty and blank texts have no units
* a block without a stop is one unit unless its words tell otherwise; repeats of a document are cut each
* positions count code points from 0, the end exclusive; no unit begins or ends with a blank
* quote marks at line starts belong to a unit only if they lie inside it
* an unclosed quote or bracket encloses nothing; an empty table has no units; further columns are ignored
* of a very long text every block is cut; blocks are independent
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.texts import spread
from quillsift.shared import materialize

#: The size of the model: words it knows by themselves in front of a stop, and behind a boundary. Rarer ones go by class.
LEFT_WORDS, NEXT_WORDS = 100_000, 2_000
ROUNDS = 3
#: Words of a block without stops from which capital letters may tell where sentences begin.
UNSTOPPED = 14

_STOP = ".!?…。！？｡．‼⁇⁈⁉؟۔।॥"
_OPEN, _CLOSE = "([{（［【〔«‹「『《〈“„‚", ")]}）］】〕»›」』》〉”"
_PAIRS = dict(zip("([{（［【〔«‹「『《〈", ")]}）］】〕»›」』》〉")) | {"“": "”", "„": "“"}
_QUOTES = set('«‹「『《〈“„"')
_MARK = re.compile(f"[{re.escape(_STOP)}]+|[{re.escape(_OPEN + _CLOSE)}\"]")
_URL = regex.compile(
    r"""https?://[^\s<>"”»]*[^\s<>"”».,;:!?)…]|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+
    |(?<![\p{Latin}\d])[a-z0-9-]{2,}(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![\p{Latin}])""",
    regex.X,
)
_DOMAIN = re.compile(r"\.[a-z]{2}")
_MAY_BE_URL = re.compile(r"[a-z0-9-]\.[a-z]{2}|@|://")
_INITIALS = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}\p{M}*\.){2,}")
_LETTERS = r"(?:(?![\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}‌‍⁠​﻿\xad])+"
_RUNS = r"[\p{Thai}]+|[\p{Han}\p{Hiragana}\p{Katakana}ー々]+"
_WORD = regex.compile(rf"{_RUNS}|{_LETTERS}(?:['’]{_LETTERS})*")
_LEFT = regex.compile(rf"(?r)(?:{_RUNS}|(?:{_LETTERS}['’])*{_LETTERS}|\p{{N}}+(?:[.,:/‌‍⁠​﻿\xad]+\p{{N}}+)*)")
#: Marks that surely don't belong to a word beside them.
_AFTER_WORD, _BEFORE_WORD = frozenset(" \n\t,.;:!?)"), frozenset(" \n\t(\"“«")
#: What is between tokens: blanks, and quote marks at line starts.
_BETWEEN = re.compile(r"(?m)(?:^[ \t]*(?:>[ \t]?)+|\s)*")
_END = regex.compile(r"(?m)(?:\s|^[ \t]*(?:>[ \t]?)+(?=\s|\Z))+\Z")
_BLANK = re.compile(r"\s")
_BLANKS = regex.compile(r"[^\S\r\n]+")
_CAPITAL = regex.compile(r"(?<=\s)\p{Lu}")
_SOLID = regex.compile(r"[\p{L}\p{N}\p{M}" + regex.escape(_OPEN) + '"]')
_CLIPPED = re.compile(r"^[^\W\d_aeiouyäöüáéíóúàèùâêîôû]+$|^.{0,3}[^\W\d_aeiouyäöüáéíóúàèùâêîôû]{2,}$|^.{0,6}[^\W\d_aeiouyäöüáéíóúàèùâêîôû]{3,}$", re.I)
_NO_WIDTH = str.maketrans("", "", "‌‍⁠​﻿\xad")
#: A carriage return and a line feed are one line end.
_BLANK_LINES = regex.compile(r"(?:\r\n|\n|\r(?!\n))(?:[^\S\r\n]*(?:\r\n|\n|\r(?!\n)))+")
_THAI, _CJK = re.compile("[\u0e01-\u0e3a\u0e40-\u0e5b]"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")

#: Between the gaps of a run, and between a gap's left and next token and their parts.
GAP, SIDE, PART = "\x1e", "\x1f", "\x1d"


def _script(c: str) -> str:
    if c < "ɐ":
        return "low" if c.islower() else "Up"
    if _THAI.match(c):
        return "th"
    if _CJK.match(c):
        return "cjk"
    if c.isupper():
        return "Up"
    return "low" if c.islower() else "unc"


def _stop_class(s: str) -> str:
    if "…" in s or s.startswith(".."):
        return "~"
    if "!" in s or "?" in s:
        return "!"
    return "." if s[0] == "." else "。"


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the blocks, which empty or blank lines divide."""
    at = 0
    for m in _BLANK_LINES.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _matched(text: str, marks: list[tuple[int, int]]) -> dict[int, int]:
    """Opening marks with the closing ones that belong to them, by their places in ``marks``."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, (a, _) in enumerate(marks):
        c = text[a]
        if c in _STOP:
            continue
        if c in '"“' or c in _CLOSE:
            want = c
            k = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == '"' and want == '"') or _PAIRS.get(stack[k][0]) == want), None)
            if k is not None:
                found[stack[k][1]] = i
                del stack[k:]
                continue
            if c in _CLOSE:
                continue
        stack.append((c, i))
    return found


def _next(text: str, at: int) -> tuple[str, str]:
    """What the model may know of the token that begins at a position: its word, and its shape."""
    c = text[at]
    if c.isnumeric():
        return "", "num"
    if "A" <= c < "ɐ" and c.isalpha():
        k, n = at + 1, len(text)
        while k < n and (x := text[k]) < "ɐ" and x.isalpha():
            k += 1
        if k < n and text[k] in _AFTER_WORD and k > at + 1:
            return text[at:k], "low" if c.islower() else "Up"
    m = _WORD.match(text, at)
    if m is None:
        return "", "open" if c in _OPEN or c == '"' else "inv" if c in "¿¡" else "pun"
    w, shape = m[0], _script(c)
    if len(w) == 1 and text[at + 1 : at + 2] == "." and shape != "unc":
        return "", shape  # an initial
    if shape == "cjk":
        w = w[:2]
    elif shape == "th":
        w = w[:4]
    return _known(w), shape


def _before(text: str, lo: int, end: int) -> str | None:
    """The word or number that ends at a position."""
    k = end
    while k > lo and (x := text[k - 1]) < "ɐ" and x.isalpha():
        k -= 1
    if k < end and (k == lo or text[k - 1] in _BEFORE_WORD):
        return text[k:end]
    m = _LEFT.match(text, lo, end)
    return m[0] if m else None


def _known(word: str) -> str:
    """A word in one width, without characters that have none."""
    return word if word.isascii() else unicodedata.normalize("NFKC", word.translate(_NO_WIDTH))


def _urls(text: str) -> list[tuple[int, int]]:
    """Bounds of the addresses in a text; looked for only where blanks enclose what may be one."""
    found: list[tuple[int, int]] = []
    past = 0
    for m in _MAY_BE_URL.finditer(text):
        a = m.start()
        if a < past:
            continue
        while a > past and not text[a - 1].isspace():
            a -= 1
        end = _BLANK.search(text, m.end())
        past = end.start() if end else len(text)
        found += [u.span() for u in _URL.finditer(text, a, past)]
    return found


def scan(text: str) -> tuple[int, int, list[int], list[int], list[str], list[bool]] | None:
    """A block's first and last position, the ends and next beginnings of its possible boundaries, their runs, and
    which of the pieces between them hold more than marks.

    A run is one text: ``^`` if its first token begins the block, and for each gap the token before and the next one.
    """
    lo = _BETWEEN.match(text).end()
    hi = len(text.rstrip())
    if hi and text[hi - 1] == ">" and (tail := _END.search(text)):
        hi = tail.start()
    if lo >= hi:
        return None
    marks = [m.span() for m in _MARK.finditer(text, lo, hi)]
    urls: list[tuple[int, int]] = []
    if marks and ("@" in text or "://" in text or _DOMAIN.search(text)):
        urls = _urls(text)
        if urls:
            marks = [(a, b) for a, b in marks if not any(s <= a < e for s, e in urls)]
    match = _matched(text, marks) if marks else {}
    # candidates: (start of the token before, its end with stop and closing marks, what it is)
    found: list[tuple[int, int, str]] = []
    closed: list[tuple[int, int]] = []
    stops = 0
    i, n, past = 0, len(marks), lo
    pair = initials = (-1, -1)
    while i < n:
        a, b = marks[i]
        if a < past:
            i += 1
            continue
        c = text[a]
        if c in _STOP:
            if c == "." and b == a + 1 and a > lo and b < hi:
                if text[a - 1].isnumeric() and text[b].isnumeric():
                    i += 1
                    continue
                if text[a - 1].isalpha() and text[b].isalpha() and (d := _INITIALS.match(text, a - 1)):
                    initials = d.span()
                    past, i = d.end(), i + 1
                    while i < n and marks[i][0] < past:
                        i += 1
                    k = _BETWEEN.match(text, past).end()
                    if i < n and marks[i][0] == k and text[k] in _STOP:
                        stop, end, i = _stop_class(text[k : marks[i][1]]), marks[i][1], i + 1
                    else:
                        stop, end = ".", past
                    left, start = f"d{PART}{d[0][:-1]}", initials[0]
                    stops += 1
                    found.append((start, *_closing(marks, match, i, end, f"{stop}{PART}{left}")))
                    i, past = _past(marks, i, found[-1][1])
                    continue
            stops += 1
            stop = _stop_class(text[a:b])
            j = a
            while j > lo and text[j - 1].isspace():
                j -= 1
            if j <= lo or text[j - 1] in _STOP and not any(e == j for _, e in urls):
                left, start = "∅", a
            elif j == pair[1]:
                left, start = "PAIR", pair[0]
            elif url := next((s for s, e in urls if e == j), None):
                left, start = "OTH", url
            elif word := _before(text, lo, j):
                start = j - len(word)
                left = ("NUM" if len(word.translate(_NO_WIDTH)) < 3 else "NUM3") if text[j - 1].isnumeric() else _word_left(word, stop)
            else:
                left, start = "OTH", j - 1
            found.append((start, *_closing(marks, match, i + 1, b, f"{stop}{PART}{left}")))
            i, past = _past(marks, i + 1, found[-1][1])
            continue
        if i in match:
            j = match[i]
            pair = (a, marks[j][1])
            closed.append(pair)
            inner = j - 1
            if inner > i and text[marks[inner][0]] in _CLOSE:
                inner -= 1
            ends = inner > i and text[marks[inner][0]] in _STOP and _only_closing(text, marks[inner][1], marks[j][0])
            i, past = j + 1, pair[1]
            k = _BETWEEN.match(text, past).end()
            if i < n and marks[i][0] == k and text[k] in _STOP:
                continue  # its stop goes with it
            if ends:
                stops += 1
                found.append((pair[0], *_closing(marks, match, i, past, "Q" if c in _QUOTES else "B")))
                i, past = _past(marks, i, found[-1][1])
            continue
        i += 1
    if _THAI.search(text, lo, hi):
        ends_at = {e for _, e, _ in found}
        for m in _BLANKS.finditer(text, lo, hi):
            a, b = m.span()
            if a <= lo or b >= hi or a in ends_at or any(s < a < e for s, e in closed) or text[b] in _STOP:
                continue
            x, y = text[a - 1], text[b]
            if (_THAI.match(x) or _THAI.match(y)) and not x.isnumeric() and not y.isnumeric():
                w = _LEFT.match(text, lo, a)
                found.append((w.start() if w else a - 1, a, f"_{PART}th"))
        found.sort(key=lambda f: f[1])
    elif not stops and text.count(" ", lo, hi) >= UNSTOPPED - 1:
        for m in _CAPITAL.finditer(text, lo, hi):
            end = m.start()
            while text[end - 1].isspace():
                end -= 1
            if end > lo and not any(s < end < e for s, e in closed):
                w = _LEFT.match(text, lo, end)
                found.append((w.start() if w else end - 1, end, f"-{PART}{'word' if w else 'OTH'}"))
    ends, nexts, runs, solid = [], [], [], []
    run: list[str] = []
    at = lo
    for start, end, left in found:
        k = _BETWEEN.match(text, end).end()
        if k >= hi or end < at:
            continue
        word, shape = _next(text, k)
        if k == end:
            if shape == "pun":
                continue
            left = "t" + left
        gap = f"{left}{SIDE}{word}{PART}{shape}"
        if run and start == nexts[-1]:
            run.append(gap)
        else:
            if run:
                runs.append(GAP.join(run))
            run = [("^" if start == lo else "") + gap]
        solid.append(_SOLID.search(text, at, end) is not None)
        ends.append(end)
        nexts.append(k)
        at = k
    if run:
        runs.append(GAP.join(run))
    solid.append(_SOLID.search(text, at, hi) is not None)
    return lo, hi, ends, nexts, runs, solid


def _word_left(word: str, stop: str) -> str:
    """A word in front of a stop: by itself in front of a full stop, by its script elsewhere."""
    shape = _script(word[-1] if len(word) > 1 else word)
    if shape in ("cjk", "th"):
        return shape
    return f"w{PART}{_known(word)}" if stop == "." else "word" if shape in ("low", "Up") else shape


def _only_closing(text: str, a: int, b: int) -> bool:
    return all(c in _CLOSE or c.isspace() for c in text[a:b])


def _closing(marks: list, match: dict, i: int, end: int, left: str) -> tuple[int, str]:
    """The end behind closing marks that directly follow without their opening ones."""
    if i < len(marks) and marks[i][0] == end:
        opened = set(match.values())
        while i < len(marks) and marks[i][0] == end and marks[i][1] == end + 1 and i not in opened and i not in match:
            end, i = marks[i][1], i + 1
    return end, left


def _past(marks: list, i: int, end: int) -> tuple[int, int]:
    while i < len(marks) and marks[i][0] < end:
        i += 1
    return i, end


BLOCK_DDL = "doc_id bigint, lo int, hi int, ends array<int>, nexts array<int>, runs array<string>, solid array<boolean>, word string"
_COLUMNS = [c.split()[0] for c in BLOCK_DDL.split(", ")]


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each block; and for each word behind a blank (``word``, with its shape in ``runs`` and whether it has no
    stop in ``solid``) how often it stands there, in ``doc_id``. Words that begin a block aren't counted."""
    free: Counter = Counter()

    def words() -> pd.DataFrame:
        counts: Counter = Counter()
        for w, n in free.items():
            word, shape = _next(w, 0)
            counts[word if len(word) <= 24 else "", shape, not _MARK.search(w)] += n
        free.clear()
        return pd.DataFrame([(n, None, None, None, None, [shape], [alone], w) for (w, shape, alone), n in counts.items()], columns=_COLUMNS)

    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            if not text:
                continue
            free.update(text.split())
            for a, b in blocks(text):
                block = text[a:b]
                got = scan(block)
                if got:
                    lo, hi, ends, nexts, runs, solid = got
                    free[block[lo:hi].split(None, 1)[0]] -= 1  # nothing is before it that it could go on from
                    rows.append((doc, a + lo, a + hi, [a + e for e in ends], [a + k for k in nexts], runs, solid, None))
        yield pd.DataFrame(rows, columns=_COLUMNS)
        if len(free) > 200_000:
            yield words()
    yield words()


# --- the model

#: What is known beforehand of kinds of tokens: the chance of a boundary behind one; and where one begins a unit.
PRIOR = {"NUM": 0.8, "NUM3": 0.95, "∅": 0.5, "OTH": 0.97, "PAIR": 0.97, "d": 0.2, "initial": 0.05, "never<4": 0.15, "never<7": 0.3, "never": 0.7, "seldom": 0.5, "often": 0.97, "rare": 0.9, "clipped": 0.05}
PRIOR_START = {"NUM": 0.001, "NUM3": 0.05, "d": 0.005, "initial": 0.005, "never<4": 0.001, "never<7": 0.005, "never": 0.05, "seldom": 0.05, "often": 0.5, "clipped": 0.001}
#: Shapes that are to be expected behind an abbreviation the model has not seen.
BEHIND_CLIPPED = {"Up": 0.5, "num": 0.3, "low": 0.2}
#: Weights of what is known beforehand, of a class for its words, of what is common for the shapes behind a class, and
#: of a word's share everywhere in what it is inside sentences.
WEIGHT, OF_CLASS, OF_SHAPE, OF_SHARE = 200.0, 8.0, 20.0, 100.0
#: Occurrences from which a word in front of a stop is judged by itself at first, and those a next word needs to be known.
JUDGED, KNOWN = 5, 3
SHAPES = ("low", "Up", "num", "open", "pun", "cjk", "th", "unc", "inv")
GROUPS = ("any", "cased", "cjk", "th", "unc")


def _word_class(word: str, free: int, stopped: int) -> str:
    """A word's class, by how often it stands without a stop (``free``) and with one."""
    if len(word) == 1 and _script(word) != "unc":
        return "initial"
    share = free / (free + stopped)
    if share == 0:
        return "never<4" if len(word) < 5 else "never<7" if len(word) < 8 else "never"
    return "seldom" if share < 0.25 else "often"


class Model:
    """Boundary and token probabilities; its size is bounded by ``LEFT_WORDS`` and ``NEXT_WORDS``."""

    def __init__(self, left_words: dict[str, str], next_words: dict[str, str]):
        """Classes of the known words in front of a stop, and shapes of the known next words."""
        self.classes, self.shapes = left_words, next_words | {s: s for s in SHAPES}
        self.chance: dict[tuple[str, str], float] = {}
        self.begin: dict[str, dict[str, float]] = {}
        self.begins_with: dict[str, dict[str, float]] = {}
        self.within: dict[str, float] = {}
        self.ending: set[str] = set()
        self.shape_after: dict[str, dict[str, float]] = {}
        self._read: dict[str, tuple] = {}
        self._decided: dict[str, tuple[bool, ...]] = {}

    # a gap as the model sees it: (key, class, group, next, shape)
    def gap(self, text: str) -> tuple[str, str, str, str, str]:
        got = self._read.get(text)
        if got is None:
            left, _, right = text.partition(SIDE)
            word, _, shape = right.partition(PART)
            stop, _, token = left.partition(PART)
            kind, _, name = token.partition(PART)
            if kind == "w":
                cls = self.classes.get(name)
                key = f"{stop}{name}" if cls else None
                script = _script(name[0])
                if cls is None:
                    # a word the model has not seen goes as an abbreviation only if it is cut off behind consonants
                    cls = "initial" if len(name) == 1 and script != "unc" else "clipped" if _CLIPPED.search(name) else "rare"
                group = "unc" if script == "unc" else "cased"
            elif kind == "d":
                cls, key, group = "d", f"{stop}{name}." if name in self.classes else None, "cased"
            else:
                cls, key = kind, None
                group = kind if kind in ("cjk", "th", "unc") else "cased" if kind == "word" else "any"
            cls = stop + cls
            got = (key or cls, cls, group, word if word in self.shapes else shape, shape)
            if len(self._read) > 500_000:
                self._read.clear()
            self._read[text] = got
        return got

    @staticmethod
    def prior(before: str, cls: str) -> float:
        tight = cls[0] == "t"
        c = cls[1:] if tight else cls
        if c in ("Q", "B"):
            return {"Q": 0.03, "B": 0.95}[c] if before == "^" else {"Q": 0.93, "B": 0.03}[c]
        stop, kind = c[0], c[1:]
        if stop == ".":
            p = PRIOR_START[kind] if before == "^" and kind in PRIOR_START else PRIOR.get(kind, 0.97)
            return p * 0.5 if tight else p
        if stop == "-":
            return 0.08
        if stop == "~" and before == "^" and kind == "∅":
            return 0.02
        return {"!": 0.95, "~": 0.7 if kind in ("word", "NUM", "NUM3", "OTH") else 0.97, "。": 0.99, "_": 0.99}[stop]

    def weights(self, before: str, gap: tuple) -> tuple[float, float]:
        """Of a boundary, and of none, with the next token.

        What begins a sentence is the same behind all words; what goes on differs in its shape only."""
        key, cls, group, nxt, shape = gap
        p = self.chance.get((before, key))
        if p is None:
            p = self.chance.get((before, cls))
            if p is None:
                p = self.prior(before, cls)
        if before == "^" and cls[-1] in "QB":
            # behind a passage that opens a unit both a sentence and the rest of one begin like sentences
            after = self.shape_after.get(before + cls) or self.shape_after[""]
            begins = self.begins_with[group]
            return p * begins[shape], (1 - p) * after[shape]
        after = (self.shape_after.get(key) if key != cls else None) or self.shape_after.get(before + cls) or self.shape_after[""]
        return p * self.begin[group].get(nxt, 1e-9), (1 - p) * after[shape] * self.within.get(nxt, 1e-9)

    def posteriors(self, run: str) -> list[tuple[str, tuple, float]]:
        """For every gap and event before it: the chances of a boundary and of none, by forward-backward.

        Returns ``(before, gap, boundary, none)`` rows whose chances add up to 1 for each gap.
        """
        first = run[0] == "^"
        gaps = [self.gap(g) for g in (run[1:] if first else run).split(GAP)]
        if len(gaps) == 1:
            b = "^" if first else ""
            y, n = self.weights(b, gaps[0])
            s = y + n
            return [[(b, gaps[0], y / s, n / s)]]
        table = [{b: self.weights(b, g) for b in ("^", "")} for g in gaps]
        # a boundary before makes the next token begin a unit
        forward, p = [], ((1.0, 0.0) if first else (0.0, 1.0))
        for w in table:
            forward.append(p)
            q = (p[0] * w["^"][0] + p[1] * w[""][0], p[0] * w["^"][1] + p[1] * w[""][1])
            s = q[0] + q[1] or 1.0
            p = (q[0] / s, q[1] / s)
        out, back = [], (1.0, 1.0)
        for i in range(len(gaps) - 1, -1, -1):
            w, f = table[i], forward[i]
            cells = [(f[k] * w[b][0] * back[0], f[k] * w[b][1] * back[1]) for k, b in enumerate(("^", ""))]
            s = sum(map(sum, cells)) or 1.0
            out.append([(b, gaps[i], y / s, n / s) for b, (y, n) in zip(("^", ""), cells)])
            back = tuple(w[b][0] * back[0] + w[b][1] * back[1] for b in ("^", ""))
            s = back[0] + back[1] or 1.0
            back = (back[0] / s, back[1] / s)
        return out[::-1]

    def decide(self, run: str) -> tuple[bool, ...]:
        """Which gaps of a run are boundaries."""
        got = self._decided.get(run)
        if got is None:
            got = tuple(sum(y for _, _, y, _ in g) >= 0.5 for g in self.posteriors(run))
            if len(self._decided) > 200_000:
                self._decided.clear()
            self._decided[run] = got
        return got

    def fit(self, expected: dict[tuple[str, str, str], float], first: bool = False, judge: bool = False) -> None:
        """The probabilities from expected counts: ``(table, a, b) -> n`` of :func:`_expect`.

        The ``first`` time the words behind all but sure boundaries tell what begins a sentence, and what stands
        between blanks inside sentences what goes on; both stay.  To ``judge``, each word in front of a stop is
        compared over all its occurrences: with a sentence ending behind every one, and behind none.  Behind those that
        end sentences, what goes on keeps the shapes it has inside sentences.
        """
        tables: dict[str, dict[str, Counter]] = {}
        for (what, a, b), n in expected.items():
            tables.setdefault(what, {}).setdefault(a, Counter())[b] += n
        if first:
            begin, inside = tables.get("b", {}), tables.get("f", {}).get("inside", Counter())
            seen = Counter(inside)
            for f in begin.values():
                seen.update(f)
            unknown = [x for x in self.shapes if x not in SHAPES and seen[x] < KNOWN]
            for x in unknown:
                shape = self.shapes.pop(x)
                for f in (inside, *begin.values()):
                    f[shape] += f.pop(x, 0)
            self._read.clear()
            by = self._by_shape(inside)
            total = sum(by.values())
            self.shape_after[""] = {s: n / total for s, n in by.items()}
            self.shape_after[".clipped"] = self.shape_after["^.clipped"] = {s: BEHIND_CLIPPED.get(s, 1e-4) for s in SHAPES}
            # a word's share among those of its shape, wherever it stands
            everywhere = Counter({x: 1.0 if x in SHAPES else 0.1 for x in self.shapes})
            for f in (inside, begin.get("any", Counter())):
                everywhere.update(f)
            shapes = self._by_shape(everywhere)
            share = {x: everywhere[x] / shapes[s] for x, s in self.shapes.items()}
            self.within = {x: (inside[x] + OF_SHARE * share[x]) / (by[s] + OF_SHARE) for x, s in self.shapes.items()}
            for g in GROUPS:
                f = begin.get(g, Counter())
                f = f if sum(f.values()) >= 50 else begin.get("any", Counter())
                by = self._by_shape(f)
                total = sum(by.values())
                self.begins_with[g] = {s: n / total for s, n in by.items()}
                self.begin[g] = {x: (by[s] / total) * (f[x] + OF_SHAPE * share[x]) / (by[s] + OF_SHAPE) for x, s in self.shapes.items()}
        yes, no = tables.get("y", {}), tables.get("n", {})
        for k in {*yes, *no}:
            if SIDE not in k:
                for b in ("^", ""):
                    y, n = yes.get(k, Counter())[b], no.get(k, Counter())[b]
                    # that a token alone is a sentence is as rare as known beforehand
                    kept = b == "^" and (k[-1] in "QB" or k[0] == "." and k[1:] in PRIOR_START)
                    self.chance[b, k] = self.prior(b, k) if kept else (y + WEIGHT * self.prior(b, k)) / (y + n + WEIGHT)
        for cls, f in tables.get("s", {}).items():
            if SIDE not in cls:
                total = sum(f.values())
                self.shape_after[cls] = {s: (f[s] + OF_SHAPE * self.shape_after[""][s]) / (total + OF_SHAPE) for s in SHAPES}
        for k, f in tables.get("s", {}).items():
            key, _, cls = k.partition(SIDE)
            if cls and key not in self.ending:
                total, common = sum(f.values()), self.shape_after[""]
                self.shape_after[key] = {s: (f[s] + OF_CLASS * common[s]) / (total + OF_CLASS) for s in SHAPES}
        for k in {*yes, *no}:
            key, _, cls = k.partition(SIDE)
            if cls:
                y, n = yes.get(k, Counter())[""], no.get(k, Counter())[""]
                self.chance["", key] = (y + OF_CLASS * self.chance["", cls]) / (y + n + OF_CLASS)
                self.chance["^", key] = min(self.chance["^", cls], self.chance["", key])
        if judge:
            for k, f in tables.get("S", {}).items():
                key, _, cls = k.partition(SIDE)
                n = sum(f.values())
                if n >= JUDGED:
                    ends = tables["L"][k][""] - sum(v * math.log(v / n) for v in f.values() if v > 0)
                    if ends > 0:
                        self.ending.add(key)
                        self.chance["", key], self.shape_after[key] = max(0.6, self.prior("", cls)), self.shape_after[""]
                    else:
                        self.chance["", key] = 0.15
                        self.shape_after[key] = {s: (f[s] + OF_CLASS * self.shape_after[""][s]) / (n + OF_CLASS) for s in SHAPES}
        self._decided.clear()

    def _by_shape(self, counts: Counter) -> Counter:
        by: Counter = Counter(dict.fromkeys(SHAPES, 1.0))
        for x, n in counts.items():
            by[self.shapes[x]] += n
        return by

    def units(self, text: str) -> list[tuple[int, int]]:
        """The bounds of the sentence units of a text."""
        out = []
        for a, b in blocks(text):
            got = scan(text[a:b])
            if got:
                lo, hi, ends, nexts, runs, solid = got
                out += [(a + x, a + y) for x, y in self.cut(lo, hi, ends, nexts, runs, solid)]
        return out

    def cut(self, lo: int, hi: int, ends, nexts, runs, solid) -> list[tuple[int, int]]:
        """The units of a scanned block. A unit of marks alone goes with the one before it."""
        if not len(ends):
            return [(lo, hi)]
        out: list[tuple[int, int]] = []
        at, held, k = lo, False, 0
        for run in runs:
            for is_end in self.decide(run):
                held = held or bool(solid[k])
                if is_end:
                    if out and not held:
                        out[-1] = (out[-1][0], ends[k])
                    else:
                        out.append((at, ends[k]))
                    at, held = nexts[k], False
                k += 1
        if out and not (held or solid[-1]):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((at, hi))
        return out


def _expect(model: Model, rows: Iterator[tuple[str, int]], first: bool, judge: bool) -> Counter:
    """Expected counts over runs and how often each occurs; the ``first`` time from what is known beforehand alone."""
    got: Counter = Counter()
    for run, n in rows:
        if first:
            starts = run[0] == "^"
            parts = [model.gap(g) for g in (run[1:] if starts else run).split(GAP)]
            for i, (_, cls, group, nxt, shape) in enumerate(parts):
                # all but sure boundaries tell what begins a sentence; small letters and marks don't
                if model.prior("^" if starts and not i else "", cls) > 0.94 and shape not in ("low", "pun"):
                    got["b", group, nxt] += n
                    if group != "any":
                        got["b", "any", nxt] += n
            continue
        for cells in model.posteriors(run):
            for b, (key, cls, group, nxt, shape), y, no in cells:
                got["y", cls, b] += y * n
                got["n", cls, b] += no * n
                got["s", b + cls, shape] += no * n
                if key != cls:
                    k = key + SIDE + cls
                    got["y", k, b] += y * n
                    got["n", k, b] += no * n
                    got["s", k, shape] += no * n
                    if judge and not b:
                        share = (y + no) * n
                        got["S", k, shape] += share
                        got["L", k, ""] += share * (math.log(model.begin[group].get(nxt, 1e-9)) - math.log(model.within.get(nxt, 1e-9)))
    return got


def train(scanned: DataFrame) -> Model:
    """Fit the model to the scanned blocks: vocabularies, then rounds of expectation and maximisation."""
    spark = scanned.sparkSession
    runs = scanned.filter("word is null").select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    runs = materialize(runs, "runs")
    gaps = runs.select(F.explode(F.split(F.regexp_replace("run", r"^\^", ""), GAP)).alias("g"), "n")
    left, right = F.split("g", SIDE)[0], F.split("g", SIDE)[1]
    sides = gaps.select(F.split(left, PART).alias("l"), F.split(right, PART).alias("r"), "n")
    named = sides.filter("size(l) = 3 and l[0] in ('.', 't.')")
    stopped = named.groupBy(F.col("l")[2].alias("word")).agg(F.sum("n").alias("stopped"), F.max(F.col("l")[1]).alias("kind"))
    free = scanned.filter("word is not null").groupBy("word", F.col("runs")[0].alias("shape"), F.col("solid")[0].alias("alone")).agg(F.sum("doc_id").alias("free"))
    alone = free.filter("alone").groupBy("word").agg(F.sum("free").alias("free"))
    stopped = stopped.join(alone, "word", "left").select("word", "kind", "stopped", F.coalesce("free", F.lit(0)).alias("free"))
    known = stopped.orderBy(F.desc("stopped"), "word").limit(LEFT_WORDS).collect()  # the size of the model, not of the data
    left_words = {r.word: "d" if r.kind == "d" else _word_class(r.word, r.free, r.stopped) for r in known}
    begins = sides.groupBy(F.col("r")[0].alias("word"), F.col("r")[1].alias("shape")).agg(F.sum("n").alias("n"))
    top = begins.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.max("shape").alias("shape")).orderBy(F.desc("n"), "word")
    next_words = {r.word: r.shape for r in top.limit(NEXT_WORDS).collect()}
    # what goes on without a stop: all that stands between blanks less what is behind a possible boundary
    names = F.broadcast(spark.createDataFrame([(w, 1) for w in sorted(next_words)], "word string, known int"))

    def by_name(df: DataFrame, n: str) -> dict[str, int]:
        named = df.join(names, "word", "left").groupBy(F.when(F.col("known") == 1, F.col("word")).otherwise(F.col("shape")).alias("x"))
        return dict(named.agg(F.sum(n)).collect())

    behind = by_name(begins, "n")
    inside = {("f", "inside", x): float(max(n - behind.get(x, 0), 0)) for x, n in by_name(free, "free").items()}
    model = Model(left_words, next_words)
    for k in range(ROUNDS + 2):
        first, judge = k == 0, k == 1
        given = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], given=given, first=first, judge=judge) -> Iterator[pd.DataFrame]:
            got = _expect(given.value, ((r, n) for pdf in batches for r, n in zip(pdf["run"], pdf["n"])), first, judge)
            yield pd.DataFrame([(*k, v) for k, v in got.items()], columns=["what", "a", "b", "n"])

        # sums over different tasks differ in their last digits; rounded, they don't
        sums = runs.mapInPandas(expect, "what string, a string, b string, n double").groupBy("what", "a", "b").agg(F.round(F.sum("n"), 6).alias("n"))
        expected = {(r[0], r[1], r[2]): r[3] for r in sums.collect()} | (inside if first else {})  # bounded by the model
        model.fit(dict(sorted(expected.items())), first, judge)
    return model


def scanned(documents: DataFrame) -> DataFrame:
    """The blocks of all documents, written to the shared folder, and the words between blanks."""
    src = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null"))
    return materialize(src.mapInPandas(_scanned, BLOCK_DDL), "blocks")


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence unit."""
    blocks_ = scanned(documents)
    model = documents.sparkSession.sparkContext.broadcast(train(blocks_))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            cols = (pdf[c].tolist() for c in ("doc_id", "lo", "hi", "ends", "nexts", "runs", "solid"))
            rows = [(doc, *u) for doc, *block in zip(*cols) for u in m.cut(*block)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"])

    src = blocks_.filter("word is null").select("doc_id", "lo", "hi", "ends", "nexts", "runs", "solid")
    return src.mapInPandas(cut, "doc_id bigint, start_pos bigint, end_pos bigint")
