from collections import Counter

from quillsift.llm import leakage

from .brute import leaks as brute

ITEM = " ".join(f"word{i}" for i in range(30))
CJK = "".join(chr(0x4E00 + i * 7) for i in range(40))
ITEMS = [(1, ITEM, "en", "s"), (2, CJK, "zh", "s"), (3, "too short", "en", "s"), (4, None, "en", "s"), (5, "", None, "s"), (6, "a b c d e f g h i j k l m", None, "s"), (7, "abcdefghijklmnopqrstuvwxyz 日", "ja", "s")]
W = ITEM.split()
DOCS = [
    (1, "x " + " ".join(W[3:15]) + " y"),
    (2, "x " + " ".join(W[3:14]) + " y"),
    (3, "> " + ", ".join(W[0:6]).upper() + "\n> " + " ".join(W[6:14])),
    (4, " ".join(W[5:11] + ["gap"] + W[11:20])),
    (5, "。".join([CJK[0:10], CJK[10:21]])),
    (6, CJK[0:19] + "x"),
    (7, "ｗord3 wo​rd4 " + " ".join(W[5:15])),
    (8, " ".join(reversed(W))),
    (9, None), (10, ""), (11, "  \n"), (12, "x " + " ".join(W[3:15]) + " y"),
    (13, ("filler " * 40_000) + " ".join(W) + (" filler" * 40_000)),
    (14, "a's b-c d e f g h i j k l m"), (15, "a b c d e f g h i j k l m " * 50), (16, "xx abcdefghijklm nopqrstuvwxyz"),
]


def frames(spark):
    d = spark.createDataFrame([(i, t, 5, "z") for i, t in DOCS], "doc_id bigint, text string, item_id int, shard string")
    return d, spark.createDataFrame(ITEMS, "item_id bigint, text string, lang string, suite string")


def test_leaks(spark):
    d, i = frames(spark)
    want = brute([(a, b) for a, b in DOCS], [x[:3] for x in ITEMS])
    for tokens in (leakage.SHARD_TOKENS, 40):
        old, leakage.SHARD_TOKENS = leakage.SHARD_TOKENS, tokens
        try:
            got = leakage.leaks(d, i).collect()
        finally:
            leakage.SHARD_TOKENS = old
        assert {(r.item_id, r.doc_id) for r in got} == want and len(got) == len(want)
    by = {(r.item_id, r.doc_id): r.longest for r in got}
    assert by[1, 1] == 12 and by[1, 13] == 30 and by[2, 5] == 21 and (7, 16) in by and (1, 2) not in by and (1, 8) not in by


def test_empty(spark):
    d, i = frames(spark)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_near(spark):
    d, i = frames(spark)
    got = {(r.item_id, r.doc_id): r.windows for r in leakage.near(d, i).collect()}
    items = {x[0]: x for x in ITEMS}
    want: dict = {}
    count = Counter(x for _, t in DOCS for cut in (leakage.words, leakage.characters) for x in cut(t or ""))
    for item, text, lang, _ in items.values():
        cut, w = (leakage.characters, 20) if lang in ("zh", "ja") else (leakage.words, 12)
        terms = cut(text or "")
        for k in range(len(terms) - w + 1):
            window = set(terms[k : k + w])
            for doc, t in DOCS:
                have = cut(t or "")
                where = {x: [p for p, y in enumerate(have) if y == x] for x in window}
                rare = min(window, key=lambda x: (count[x], x))
                if doc != 13 and any(all(any(abs(p - q) <= w for q in where[x]) for x in window) for p in where[rare]):
                    want[item, doc] = want.get((item, doc), 0) + 1
    assert {k: v for k, v in got.items() if k[1] != 13} == want and got[1, 8] == 19 and got[1, 13] == 19


def test_near_every_window(spark):
    """Passages that cover none of the windows side by side are found, in and out of order."""
    d, i = frames(spark)
    odd = spark.createDataFrame([(20, "x " + " ".join(reversed(W[5:17])) + " y")], "doc_id bigint, text string")
    d = d.select("doc_id", "text").unionByName(odd)
    got = {(r.item_id, r.doc_id): r.windows for r in leakage.near(d, i).collect()}
    assert got[1, 1] == got[1, 12] == got[1, 20] == 1 and got[1, 8] == got[1, 13] == 19 and (1, 2) not in got
    exact = {(r.item_id, r.doc_id) for r in leakage.leaks(d, i).collect()}
    assert exact <= set(got)


def test_stored_index(spark, tmp_path):
    """One index serves several test sets, in pieces or whole, and reads only the partitions of their terms."""
    d, i = frames(spark)
    index = leakage.PositionalIndex.build(d, f"file://{tmp_path}/index", all_characters=True)
    want = brute([(a, b) for a, b in DOCS], [x[:3] for x in ITEMS])
    for pieces in (leakage.ITEMS_OF_PIECE, 1):
        old, leakage.ITEMS_OF_PIECE = leakage.ITEMS_OF_PIECE, pieces
        try:
            assert {(r.item_id, r.doc_id) for r in leakage.leaks(index, i).collect()} == want
        finally:
            leakage.ITEMS_OF_PIECE = old
    one = i.filter("item_id = 2")
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(index, one).collect()} == {p for p in want if p[0] == 2}
    few = index.postings(spark.createDataFrame([("word3",)], "term string"))
    assert {r.term for r in few.select("term").collect()} == {"word3"}
    assert "bucket" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    index.drop()
