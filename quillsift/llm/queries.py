"""Queries of this package, and their SQL."""

from __future__ import annotations

from quillsift.llm import leakage, lookalike, packing, sentences
from quillsift.shared import table


def p1_found(spark, d):
    return lookalike.same_look(table(spark, d, "tokens"))


def p1_merged(spark, d):
    return lookalike.merged(table(spark, d, "tokens"))


def p1_classes(spark, d):
    return lookalike.class_rows(table(spark, d, "tokens"))


def p6_packed(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_kind"))


def p6_fill(spark, d):
    return packing.fill_report(packing.pack(table(spark, d, "documents"), table(spark, d, "container_kind")))


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("item_id", "doc_id")


def p7_leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_near(spark, d):
    return leakage.near(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_merged": p1_merged,
    "p1_classes": p1_classes,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_near": p7_near,
    "p8_found": p8_found,
}


def _p1_looks() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    source, target, several = lookalike.tables()
    word = "word"
    for c in "ﬀﬁﬂﬃﬄﬅﬆĲĳǇǈǉǊǋǌǱǲǳǄǅǆ":
        if c in several:
            word = f"replace({word}, '{c}', '{several[c]}')"
    mapped = f"translate({word}, {q(source)}, {q(target)})"
    return f"""
WITH m AS (SELECT token_id, u, word, good, spam, last_seen, nfc_normalize({mapped}) AS k FROM tokens WHERE u IS NOT NULL AND word IS NOT NULL),
p AS (SELECT *, regexp_extract(k, '^ *((?:b|u|h:[^: ]+):)', 1) AS pre, regexp_replace(k, '^ *(?:b|u|h:[^: ]+):', '') AS rest FROM m),
l AS (SELECT token_id, u, word, good, spam, last_seen, pre || trim(rest, ' ') AS k FROM p)
"""


# Texts without quote marks at line starts and characters without width, in one width, composition and case, then their
# words, and characters where a text has ideographs or kana. Full-width forms are written out from their code points.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_P7 = r"""
WITH src AS (SELECT 'd' AS k, doc_id AS id, text, NULL AS lang FROM documents WHERE text <> '' AND doc_id IS NOT NULL
  UNION ALL SELECT 'i', item_id, text, lower(trim(lang)) FROM eval_item WHERE text <> '' AND item_id IS NOT NULL),
pl AS (SELECT k, id, lang, lower(nfc_normalize(translate(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[\p{Cf}\x{fe00}-\x{fe0f}]+', '', 'g'), '(?m)^[ \t]*(>[ \t]*)+', '', 'g'), '{WIDE}', '{NARROW}'))) AS t FROM src),
ws AS (SELECT k, id, lang, regexp_extract_all(t, '[\p{L}\p{N}\p{M}]+') AS w FROM pl),
st AS (SELECT k, id, 12 AS n, w AS terms FROM ws WHERE k = 'd' OR coalesce(left(lang, 2), '') NOT IN ('zh', 'ja')
  UNION ALL SELECT k, id, 20, string_split(array_to_string(w, ''), '') FROM ws WHERE k = 'd' AND regexp_matches(array_to_string(w, ''), '[\p{Han}\p{Hiragana}\p{Katakana}]') OR left(lang, 2) IN ('zh', 'ja')),
tm AS (SELECT k, id, n, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM st),
-- only documents' windows all of whose terms some item has can match
kn AS (SELECT *, k = 'i' OR term IN (SELECT term FROM tm WHERE k = 'i') AS known FROM tm),
sm AS (SELECT k, id, n, i, term, sum(CAST(known AS INT)) OVER w12 AS h12, sum(CAST(known AS INT)) OVER w20 AS h20 FROM kn
  WINDOW w12 AS (PARTITION BY k, id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), w20 AS (PARTITION BY k, id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
wn AS (SELECT k, id, n, i FROM sm WHERE CASE WHEN n = 12 THEN h12 = 12 ELSE h20 = 20 END),
win AS (SELECT wn.k, wn.id, wn.n, wn.i, array_to_string(list_slice(terms, wn.i, wn.i + wn.n - 1), chr(10)) AS g FROM wn JOIN st ON st.k = wn.k AND st.id = wn.id AND st.n = wn.n),
hit AS (SELECT a.id AS item_id, b.id AS doc_id, a.n, b.i - a.i AS diagonal, a.i FROM win a JOIN win b ON a.k = 'i' AND b.k = 'd' AND a.n = b.n AND a.g = b.g),
run AS (SELECT item_id, doc_id, n, diagonal, i - row_number() OVER (PARTITION BY item_id, doc_id, n, diagonal ORDER BY i) AS r FROM hit),
runs AS (SELECT item_id, doc_id, count(*) + n - 1 AS length FROM run GROUP BY item_id, doc_id, n, diagonal, r)
""".replace("{WIDE}", _WIDE.replace("'", "''")).replace("{NARROW}", _NARROW.replace("'", "''"))


def _sql() -> dict[str, str]:
    looks = _p1_looks()
    return {
        "p7_found": _P7 + "SELECT DISTINCT item_id, doc_id FROM runs",
        "p7_leaks": _P7 + "SELECT item_id, doc_id, count(*) AS runs, max(length) AS longest FROM runs GROUP BY item_id, doc_id",
        "p1_found": looks + "SELECT a.token_id AS token_id_a, b.token_id AS token_id_b FROM l a JOIN l b ON a.u = b.u AND a.k = b.k AND a.token_id < b.token_id AND a.word <> b.word",
        "p1_merged": looks + """SELECT u, (min({'odd': CAST(regexp_matches(word, '[^!-~]') AS INT), 'word': word})).word AS word, count(DISTINCT word) AS forms,
            CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(spam, 0)) AS BIGINT) AS spam, max(last_seen) AS last_seen FROM l GROUP BY u, k""",
        "p1_classes": looks + """, c AS (SELECT u, k, (min({'odd': CAST(regexp_matches(word, '[^!-~]') AS INT), 'word': word})).word AS canonical, count(DISTINCT word) AS forms FROM l GROUP BY u, k HAVING count(DISTINCT word) > 1)
            SELECT l.u, canonical, word, count(*) AS rows, forms FROM l JOIN c ON l.u = c.u AND l.k = c.k GROUP BY ALL""",
    }


SQL = _sql()
