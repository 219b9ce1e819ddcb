import unicodedata

from quillsift.llm import lookalike as L

TOKENS = "token_id bigint, u string, word string, good bigint, spam bigint, last_seen timestamp, canonical string"
WORDS = [
    ("a", "b:paypal"), ("a", "b:pаypаl"), ("a", "b:ｐａｙｐａｌ"), ("a", "b:pay​pal"), ("a", "b:𝗽𝗮𝘆𝗽𝗮𝗹"), ("a", "b: paypal "), ("a", "b:paypal"),
    ("b", "b:pаypal"), ("a", "b:cafe"), ("a", "b:café"), ("a", "b:café"), ("a", "b:сafé"), ("a", "b:o0"), ("a", "b:oo"), ("a", "b:i1"), ("a", "b:ii"),
    ("a", "b:x-y"), ("a", "b:x‑y"), ("a", "b:x_y"), ("a", "b:x y"), ("a", "b:x y"), ("a", "b:office"), ("a", "b:oﬃce"), ("a", "h:subject:paypal"),
    (None, "b:paypal"), ("a", None), ("a", ""), ("a", "​"), ("a", "b:PAYPAL"), ("a", "b:" + "z" * 50_000), ("a", "b:" + "z" * 50_000 + "­"),
]


def frame(spark, words=WORDS):
    return spark.createDataFrame([(i, u, w, 1, None, None, "x") for i, (u, w) in enumerate(words)], TOKENS)


def brute(words):
    source, target, several = L.tables()
    table = {ord(a): target[i] if i < len(target) else None for i, a in enumerate(source)}

    def look(w):
        w = "".join(several.get(c, c) for c in w).translate(table)
        w = unicodedata.normalize("NFC", w)
        body = w.lstrip(" ")
        for p in ("b:", "u:", "h:subject:"):
            if body.startswith(p):
                return p + body[len(p) :].strip(" ")
        return w.strip(" ")

    rows = [(i, u, w) for i, (u, w) in enumerate(words) if u is not None and w is not None]
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and look(a[2]) == look(b[2])}


def test_pairs(spark):
    got = [tuple(r) for r in L.same_look(frame(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(WORDS)
    assert {(0, 1), (0, 4), (9, 10), (9, 11), (16, 17), (19, 20), (21, 22), (29, 30)} <= set(got)
    assert not {(8, 9), (12, 13), (14, 15), (16, 18), (0, 28), (0, 6)} & set(got)
    assert L.same_look(frame(spark).limit(0)).count() == 0


def test_merged(spark):
    m = {(r.u, r.word): r for r in L.merged(frame(spark)).collect()}
    assert m["a", "b:paypal"].forms == 6 and m["a", "b:paypal"].good == 7
    assert sum(r.good for r in m.values()) == sum(u is not None and w is not None for u, w in WORDS)


def test_tables():
    source, target, _ = L.tables()
    assert len(set(source)) == len(source) and len(target) < len(source)
    assert len(L.DRAWN) == len(L.PLAIN)


def test_line_ends_are_blanks(spark):
    """A word that ends in one line terminator looks like the word without it."""
    words = [("a", "b:paypal"), *(("a", "b:paypal" + end) for end in ("\n", "\r", "\r\n", "\x85", "\u2028", "\u2029")), ("a", "b:other\n")]
    got = {tuple(r) for r in L.same_look(frame(spark, words)).collect()}
    assert got == brute(words) == {(a, b) for a in range(7) for b in range(a + 1, 7)}
    m = {r.word: r.forms for r in L.merged(frame(spark, words)).collect()}
    assert m == {"b:paypal": 7, "b:other\n": 1}


def test_order_of_marks(spark):
    """Combining marks in any order, apart or composed with their letter, are one look where they are canonically equal."""
    words = [("a", "b:" + w) for w in ("q\u0323\u0307", "q\u0307\u0323", "\u1ea1\u0307", "\u0227\u0323", "a\u0323\u0307", "q\u0301\u0307", "q\u0307\u0301", "xq\u0323y\u0307", "xq\u0307y\u0323")]
    got = {tuple(r) for r in L.same_look(frame(spark, words)).collect()}
    assert got == brute(words) == {(0, 1), (2, 3), (2, 4), (3, 4)}


def test_classes(spark):
    rows = L.class_rows(frame(spark)).collect()
    paypal = [r for r in rows if r.u == "a" and r.canonical == "b:paypal"]
    assert len(paypal) == 6 and all(r.forms == 6 for r in paypal) and sum(r.rows for r in paypal) == 7
    assert L.class_rows(frame(spark).limit(0)).count() == 0
