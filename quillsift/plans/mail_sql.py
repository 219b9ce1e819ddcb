"""The mail queries once more, as SQL for another engine over the same tables."""

from __future__ import annotations

import regex

from quillsift.functions.text import _BRAND_FORMS, FOLD_FROM, FOLD_TO, SECOND_LEVEL
from quillsift.operators.evaluate import GRIDS


def _letters() -> str:
    """Alphabetic marks that are no letters, as ranges of a character class (the other engine lacks the property)."""
    is_mark = regex.compile(r"[\p{Alphabetic}--\p{L}--\p{Nl}]", regex.V1)
    codes = [c for c in range(0x300, 0x20000) if not 0xD800 <= c <= 0xDFFF and is_mark.match(chr(c))]
    out, start = [], None
    for a, b in zip(codes, [*codes[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            out.append(rf"\x{{{start:x}}}-\x{{{a:x}}}")
            start = None
    return "".join(out)


LETTER = r"\p{L}\p{N}" + _letters()
Q = lambda s: "'" + s.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '[^{LETTER}._@-]+'), lambda x: lower(trim(x, '._-'))), lambda x: strlen(x) BETWEEN 3 AND 40)"


def cut_url(u: str) -> str:
    v = rf"regexp_replace(lower({u}), '[?#].*$', '', 's')"
    return f"CASE WHEN strlen({v}) <= 40 THEN {v} ELSE left({v}, list_max(list_filter(range(1, 41), lambda n: strlen(left({v}, n)) <= 40))) END"


URL = r"""'https?://[^\s"''<>)\]|]+'"""
FIRST = r"regexp_extract(text, '^\s*([^\r\n]*)', 1)"

DOCS = "WITH d AS (SELECT doc_id, u, text FROM documents WHERE text IS NOT NULL)"
BODY = f"""{DOCS}, b AS (SELECT doc_id, u, list_distinct(list_concat(
  list_transform(list_filter(list_transform(regexp_extract_all(text, {URL}), lambda x: {cut_url("x")}), lambda x: strlen(x) BETWEEN 3 AND 40), lambda x: 'u:' || x),
  list_transform({words("text")}, lambda x: 'b:' || x))) AS tokens FROM d),
s AS (SELECT doc_id, u, {words(FIRST)} AS ws FROM d),
tok AS (SELECT DISTINCT u, msg_id, token FROM (
  SELECT u, doc_id AS msg_id, unnest(tokens) AS token FROM b
  UNION ALL SELECT u, doc_id, 'h:subject:' || unnest(ws) FROM s
  UNION ALL SELECT u, doc_id, 'h:subject:' || unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) FROM s))"""
LABELS = """lab AS (SELECT doc_id AS msg_id, max({'at': labelled_at, 'l': lower(label)}).l = 'spam' AS is_spam FROM message_label WHERE lower(label) IN ('good', 'spam') GROUP BY doc_id)"""
MODEL = f"""{BODY}, {LABELS},
msg AS (SELECT u, doc_id AS msg_id FROM documents WHERE text IS NOT NULL),
model AS (SELECT u, token, count(*) FILTER (NOT is_spam) AS good, count(*) FILTER (is_spam) AS spam FROM tok JOIN lab USING (msg_id) GROUP BY u, token),
totals AS (SELECT u, count(*) FILTER (NOT is_spam) AS total_good, count(*) FILTER (is_spam) AS total_spam FROM msg JOIN lab USING (msg_id) GROUP BY u)"""
STORED = """WITH model AS (SELECT u, word AS token, CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(spam, 0)) AS BIGINT) AS spam, max(last_seen) AS last_seen FROM tokens GROUP BY u, word),
totals AS (SELECT u, total_good, total_spam FROM model_totals)"""


def prob(strength=1.0, x=0.5, bias=1.0, gate=0, new=0.5) -> str:
    g, s = "greatest(CAST(coalesce(total_good, 0) AS DOUBLE), 1.0)", "greatest(CAST(coalesce(total_spam, 0) AS DOUBLE), 1.0)"
    pw, qw = f"(spam / {s})", f"({bias} * (good / {g}))"
    return f"CASE WHEN good IS NULL OR good + spam < {gate} THEN {new} ELSE ({strength} * {x} + (good + spam) * (CASE WHEN {pw} + {qw} > 0 THEN {pw} / ({pw} + {qw}) ELSE 0.5 END)) / ({strength} + good + spam) END"


def kept(k=150, dist=0.0, least=0, tok="tok", x="", **p) -> str:
    cut = f"AND (dist >= {dist} OR rn <= {least})" if dist > 0 else ""
    if "unknown" in p:
        p["x"] = p.pop("unknown")
    return f"""pr{x} AS (SELECT t.u, t.msg_id, t.token, m.good, m.spam, {prob(**p)} AS f FROM {tok} t LEFT JOIN model m ON t.u = m.u AND t.token = m.token LEFT JOIN totals z ON t.u = z.u),
rk{x} AS (SELECT *, abs(f - 0.5) AS dist, row_number() OVER (PARTITION BY u, msg_id ORDER BY abs(f - 0.5) DESC, token) AS rn FROM pr{x}),
kept{x} AS (SELECT * FROM rk{x} WHERE rn <= {k} {cut})"""


def tail(h: str) -> str:
    return f"CASE WHEN {h} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, n), lambda i: exp(-{h} / 2 + CASE WHEN i = 0 THEN 0 ELSE i * ln({h} / 2) - lgamma(i + 1) END)))) END"


def fisher(x: str = "") -> str:
    return f"""h{x} AS (SELECT u, msg_id, count(*) AS n, -2 * sum(ln(greatest(1 - f, 1e-200))) AS hs, -2 * sum(ln(greatest(f, 1e-200))) AS hh FROM kept{x} GROUP BY u, msg_id),
b{x}0 AS (SELECT u, msg_id, least(greatest((1 + (1 - {tail("hs")}) - (1 - {tail("hh")})) / 2, 0.0), 1.0) AS base FROM h{x})"""


def geometric(x: str = "") -> str:
    f = "least(greatest(f, 1e-6), 1 - 1e-6)"
    return f"""h{x} AS (SELECT u, msg_id, exp(avg(ln({f}))) AS s, exp(avg(ln(1 - {f}))) AS g FROM kept{x} GROUP BY u, msg_id),
b{x}0 AS (SELECT u, msg_id, s / (s + g) AS base FROM h{x})"""


def verdicts(threshold=0.5, combiner=fisher, name="sc", x="", **k) -> str:
    return f"""{kept(x=x, **k)}, {combiner(x)},
{name} AS (SELECT msg_id, u, CASE WHEN trained AND base IS NOT NULL AND round(s, 9) >= {threshold} THEN 'SPAM' ELSE 'GOOD' END AS verdict, round(s, 6) AS score FROM (
  SELECT msg.msg_id, msg.u, base, coalesce(greatest(total_good, total_spam) >= 1, false) AS trained, CASE WHEN coalesce(greatest(total_good, total_spam) >= 1, false) THEN coalesce(base, 0.5) ELSE 0.5 END AS s
  FROM msg LEFT JOIN b{x}0 b ON msg.u = b.u AND msg.msg_id = b.msg_id LEFT JOIN totals ON msg.u = totals.u))"""


SCORED = f"{MODEL}, {verdicts()}"
JUDGED = f"{SCORED}, jd AS (SELECT msg_id, u, score, is_spam, verdict = 'SPAM' AS pred_spam FROM sc JOIN lab USING (msg_id))"
CONF = "count(*) FILTER (NOT is_spam AND pred_spam) AS fp, count(*) FILTER (is_spam AND NOT pred_spam) AS fn, count(*) FILTER (is_spam AND pred_spam) AS tp, count(*) FILTER (NOT is_spam AND NOT pred_spam) AS tn"


def rates(src: str, keys: str = "", w: float = 1.0) -> str:
    return f"""SELECT {keys} fp, fn, tp, tn, round(fp / nullif(fp + tn, 0), 6) AS fp_rate, round(fn / nullif(fn + tp, 0), 6) AS fn_rate, round((fp + fn) / nullif(fp + fn + tp + tn, 0), 6) AS error_rate,
  round((fp / greatest(fp + tn, 1) + fn / greatest(fn + tp, 1)) / 2, 6) AS balanced_error, round(({w} * (fp / greatest(fp + tn, 1)) + fn / greatest(fn + tp, 1)) / ({w} + 1), 6) AS weighted_error FROM ({src})"""


IP = r"regexp_full_match(host, '((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)') OR host LIKE '%:%'"
_SLD = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
HOST_PARTS = f"""hp AS (SELECT *, len(l) AS n, CASE WHEN len(l) >= 3 AND strlen(l[-1]) = 2 AND l[-2] IN ({_SLD}) THEN 2 ELSE 1 END AS k, len(l) >= 2 AND NOT ({IP}) AS ok
  FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM hosts))"""
HOSTS = r"WITH hosts AS (SELECT DISTINCT regexp_extract(word, '@([^@\s]+)$', 1) AS host FROM tokens WHERE regexp_matches(word, '@([^@\s]+)$')), " + HOST_PARTS
REG = "CASE WHEN ok THEN array_to_string(l[n - k:], '.') END"
BRAND = "CASE WHEN ok THEN l[n - k] END"
TLD = "CASE WHEN ok THEN array_to_string(l[n - k + 1:], '.') END"

EVENTS = r"""WITH l AS (SELECT file, line_no, rtrim(regexp_replace(line, '\r+$', '')) AS line FROM mail_log WHERE line LIKE '% sieve: %'),
k AS (SELECT *, CASE WHEN contains(line, 'sieve: DEBUG: TRAIN: ') THEN 'T' WHEN contains(line, 'sieve: DEBUG: DELIVERY: ') THEN 'D'
  WHEN contains(line, 'sieve: msgid=') AND contains(line, ': stored mail into mailbox ''') THEN 'M' END AS kind FROM l),
m AS (SELECT *, CASE kind WHEN 'T' THEN 'sieve: DEBUG: TRAIN: ' WHEN 'D' THEN 'sieve: DEBUG: DELIVERY: ' ELSE 'sieve: msgid=' END AS mark FROM k WHERE kind IS NOT NULL),
p AS (SELECT *, left(line, strpos(line, mark) - 1) AS head, substr(line, strpos(line, mark) + length(mark)) AS tail FROM m),
ev0 AS (SELECT file, line_no, kind, split_part(line, ' ', 1) AS t, regexp_extract(head, '<([^<>]*)>[^<>]*$', 1) AS sess,
  CASE kind WHEN 'T' THEN regexp_extract(tail, '^(.*?) -> ', 1) WHEN 'D' THEN regexp_extract(tail, '^(.*?) -> (.*?) \(([^ ]*) (.*)\)', 1) END AS u,
  CASE WHEN kind = 'T' THEN regexp_extract(tail, ' -> (.*)$', 1) END AS v,
  CASE WHEN kind = 'D' THEN regexp_extract(tail, '^(.*?) -> (.*?) \(([^ ]*) (.*)\)', 3) END AS verdict,
  CASE WHEN kind = 'D' THEN regexp_extract(tail, '^(.*?) -> (.*?) \(([^ ]*) (.*)\)', 4) END AS score,
  CASE WHEN kind = 'D' THEN regexp_extract(tail, '^(.*?) -> (.*?) \(([^ ]*) (.*)\)', 2) END AS folder,
  CASE WHEN kind = 'M' THEN regexp_extract(tail, '^([^:]*):', 1) END AS msgid FROM p),
ev AS (SELECT * FROM ev0 WHERE sess <> '' AND (kind = 'T' AND v IN ('good', 'spam') AND u <> '' OR kind = 'D' AND u <> '' AND score <> '' OR kind = 'M' AND msgid <> ''))
"""

PAIRS = """WITH ev AS (
  SELECT u AS file, (CAST(batch_id AS BIGINT) * 2) * 1000000000 + row_id AS line_no, 'D' AS kind, s AS sess, ts AS t, u, verdict, score, folder, NULL AS msgid FROM (SELECT *, {trim} AS s FROM delivery_start) WHERE s IS NOT NULL AND u IS NOT NULL
  UNION ALL SELECT u, (CAST(batch_id AS BIGINT) * 2 + 1) * 1000000000 + row_id, 'M', s, NULL, u, NULL, NULL, NULL, msgid FROM (SELECT *, {trim} AS s FROM msgid_line) WHERE s IS NOT NULL AND u IS NOT NULL),
st0 AS (SELECT *, lead(kind) OVER w AS nk, lead(msgid) OVER w AS nm FROM ev WINDOW w AS (PARTITION BY file, sess ORDER BY line_no)),
st AS (SELECT file, line_no, sess, t, u, verdict, score, folder, CASE WHEN nk = 'M' THEN nm END AS msgid FROM st0 WHERE kind = 'D' AND (nk IS NULL OR nk = 'M'))
"""

_TRIM = "nullif(regexp_replace({}, '^[\\s <>]+|[\\s <>]+$', '', 'g'), '')"


PAIRS = PAIRS.format(trim=_TRIM.format("session"))


def _mid(c: str) -> str:
    m = f"nullif({_TRIM.format(c)}, 'noid')"
    return f"CASE WHEN {m} LIKE '%@%' THEN regexp_replace({m}, '@[^@]*$', '') || lower(regexp_extract({m}, '@[^@]*$')) ELSE {m} END"


DELIV = f"""WITH ds AS (SELECT {_TRIM.format("session")} AS s, row_id, upper(verdict) AS verdict, score, folder FROM delivery_start),
one AS (SELECT s, max(row_id) AS seq, arg_max({{'verdict': verdict, 'score': score, 'folder': folder}}, row_id) AS d FROM ds WHERE s IS NOT NULL GROUP BY s),
ml AS (SELECT u, {_TRIM.format("session")} AS s, {_mid("msgid")} AS msgid FROM msgid_line),
dl AS (SELECT u, msgid, d.verdict AS verdict, d.score AS score, d.folder AS folder, seq FROM ml JOIN one USING (s) WHERE msgid IS NOT NULL),
fl AS (SELECT file_id, u, folder, {_mid("msgid")} AS msgid FROM mailbox_file WHERE lower(folder) <> '.trash'),
last AS (SELECT u, msgid, arg_max({{'verdict': verdict, 'score': score, 'folder': folder}}, seq) AS d FROM dl WHERE verdict IS NOT NULL AND folder IS NOT NULL GROUP BY u, msgid),
co0 AS (SELECT file_id, fl.u, fl.msgid, fl.folder, d, coalesce(TRY_CAST(d.score AS DOUBLE), 0.5) AS s, lower(fl.folder) = '.junk' AS junk FROM fl JOIN last ON fl.u = last.u AND fl.msgid = last.msgid),
co AS (SELECT file_id, u, msgid, CASE WHEN d.verdict = 'SPAM' AND junk THEN 'tp' WHEN d.verdict = 'SPAM' THEN 'fp' WHEN d.verdict = 'GOOD' AND junk THEN 'fn' WHEN d.verdict = 'GOOD' THEN 'tn' ELSE 'unknown' END AS label,
  CASE WHEN s >= 0.8 THEN 'high_spam' WHEN s <= 0.2 THEN 'high_ham' ELSE 'uncertain' END AS confidence, (s >= 0.8 AND NOT junk) OR (s <= 0.2 AND junk) AS algo_error, s AS score,
  d.verdict AS delivery_verdict, d.folder AS delivery_folder, folder AS current_folder FROM co0)
"""

_CELL = "CASE WHEN isnan(score) THEN NULL ELSE least(greatest(CAST(floor(score * 10) AS INT), 0), 9) END"
_CELLS = lambda junk: " || ',' || ".join(f"CAST(count(*) FILTER (junk = {junk} AND cell = {i}) AS VARCHAR)" for i in range(10))
NIGHTLY = f"""WITH s0 AS (SELECT u, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS d, upper(verdict) AS verdict, TRY_CAST(score AS DOUBLE) AS score, folder LIKE 'Junk%' AS junk FROM delivery_start),
s AS (SELECT *, {_CELL} AS cell FROM s0 WHERE u IS NOT NULL AND d IS NOT NULL AND junk IS NOT NULL AND NOT isnan(score)),
n AS (SELECT u, d, {_CELLS("false")} AS in_cells, {_CELLS("true")} AS jk_cells, count(*) FILTER (junk AND verdict = 'GOOD') AS fn, count(*) FILTER (NOT junk AND verdict = 'SPAM') AS fp FROM s GROUP BY u, d),
la AS (SELECT u, max(d) AS d, arg_max(fn, d) AS fn, arg_max(fp, d) AS fp FROM n GROUP BY u),
us AS (SELECT la.*, total_good AS good, total_spam AS spam FROM la JOIN model_totals USING (u))"""

CANON = lambda x: f"regexp_replace(translate(lower({x}), 'il1|053', 'llllose'), '[^a-z0-9]', '', 'g')"
_BRANDS = ", ".join(f"'{b}'" for b in _BRAND_FORMS)
_GRID = [(i * 10 + j, s, x) for i, s in enumerate(GRIDS["strength"]) for j, x in enumerate(GRIDS["unknown_prob"])]
_THRESHOLDS = ", ".join(map(str, GRIDS["threshold"]))
IMPORT = r"""SELECT {u} AS u, CASE WHEN regexp_full_match(trim(regexp_extract(l, '^([^,]*),', 1)), '[+]?[0-9]+') THEN TRY_CAST(trim(regexp_extract(l, '^([^,]*),', 1)) AS BIGINT) END AS good,
  CASE WHEN regexp_full_match(trim(regexp_extract(l, '^[^,]*,([^,]*),', 1)), '[+]?[0-9]+') THEN TRY_CAST(trim(regexp_extract(l, '^[^,]*,([^,]*),', 1)) AS BIGINT) END AS spam,
  regexp_replace(regexp_replace(trim(regexp_extract(l, '^[^,]*,[^,]*,[^,]*,(.*)$', 1, 's')), '^"', ''), '"$', '') AS token
  FROM (SELECT *, regexp_replace({l}, '\r?\n?$', '') AS l FROM {src}) WHERE l IS NOT NULL AND regexp_matches(l, '^[^,]*,[^,]*,[^,]*,')"""
MERGED = "SELECT u, token, CAST(least(sum(good), 9223372036854775807) AS BIGINT) AS good, CAST(least(sum(spam), 9223372036854775807) AS BIGINT) AS spam FROM i WHERE good >= 0 AND spam >= 0 AND token NOT IN ('', '__total__') GROUP BY u, token"
EXPORT = f"""{STORED}, x AS (SELECT u, total_good || ',' || total_spam || ',0,"__total__"' AS line FROM totals
  UNION ALL SELECT u, good || ',' || spam || ',0,"' || token || '"' FROM model WHERE NOT regexp_matches(token, '["\\x00-\\x1f\\x7f]'))"""

RAIL = f"""WITH ml AS (SELECT row_id AS msg_id, u, {_TRIM.format("session")} AS s, {_mid("msgid")} AS k FROM msgid_line),
v AS (SELECT {_TRIM.format("session")} AS s, max(CAST(upper(verdict) = 'SPAM' AS INT)) AS spam FROM delivery_start WHERE verdict IS NOT NULL GROUP BY 1),
hosts AS (SELECT u, msg_id, spam, regexp_extract(k, '([^@]*)$', 1) AS host FROM ml JOIN v USING (s) WHERE s IS NOT NULL AND k IS NOT NULL AND u IS NOT NULL), {HOST_PARTS},
msg AS (SELECT u, msg_id, spam = 1 AS is_spam, {TLD} AS tld, host FROM hp),
tok AS (SELECT DISTINCT u, msg_id, token FROM (SELECT u, msg_id, 'x:tld:' || tld AS token FROM msg WHERE tld IS NOT NULL UNION ALL SELECT u, msg_id, 'h:from:' || host FROM msg)),
model AS (SELECT tok.u, token, count(*) FILTER (NOT is_spam) AS good, count(*) FILTER (is_spam) AS spam FROM tok JOIN msg USING (msg_id) GROUP BY tok.u, token),
totals AS (SELECT u, count(*) FILTER (NOT is_spam) AS total_good, count(*) FILTER (is_spam) AS total_spam FROM msg GROUP BY u),
{kept()}, {fisher()},
rail AS (SELECT DISTINCT u, msg_id FROM pr WHERE token LIKE 'x:tld:%' AND good = 0 AND spam >= 5)
SELECT msg.u, msg.msg_id, CASE WHEN round(CASE WHEN rail.u IS NOT NULL THEN greatest(base, 0.95) ELSE base END, 9) >= 0.5 THEN 'SPAM' ELSE 'GOOD' END AS verdict,
  round(CASE WHEN rail.u IS NOT NULL THEN greatest(base, 0.95) ELSE base END, 6) AS score
FROM msg JOIN b0 b ON msg.u = b.u AND msg.msg_id = b.msg_id LEFT JOIN rail ON msg.u = rail.u AND msg.msg_id = rail.msg_id"""

SHADOW = f"""{MODEL}, {verdicts(name="sa")}, {verdicts(name="sb", x="2", threshold=0.6, k=27, strength=0.5)},
sh AS (SELECT sa.msg_id, sa.u, sa.verdict = 'SPAM' AS p, sb.verdict = 'SPAM' AS c, sb.score - sa.score AS delta FROM sa JOIN sb ON sa.msg_id = sb.msg_id AND sa.u = sb.u)"""

CORRECTED = """us AS (SELECT u, fn, fp, total_good AS good, total_spam AS spam FROM (SELECT u, count(*) FILTER (label = 'fn') AS fn, count(*) FILTER (label = 'fp') AS fp FROM co GROUP BY u) JOIN model_totals USING (u))"""
# what the parser finds in the made-up headers, and the body tokens of the text
MIME = rf"""{BODY}, hosts AS (SELECT doc_id, lower(coalesce(u, 'none@x.example')) AS a, string_split(lower(coalesce(u, 'none@x.example')), '@')[2] AS host FROM d), {HOST_PARTS},
x AS (SELECT doc_id, unnest(tokens) AS token FROM b UNION ALL SELECT doc_id, unnest(['h:received:a.example', 'h:received:mx.b.example']) FROM d
  UNION ALL SELECT doc_id, unnest([CASE WHEN strlen(a) BETWEEN 3 AND 40 THEN 'h:from:' || a END, CASE WHEN strlen(host) BETWEEN 3 AND 40 THEN 'h:from:' || host END,
  CASE WHEN ({REG}) <> host AND strlen({REG}) BETWEEN 3 AND 40 THEN 'h:from:' || ({REG}) END, CASE WHEN strlen({BRAND}) BETWEEN 2 AND 40 THEN 'h:from:' || ({BRAND}) END]) FROM hp)
SELECT DISTINCT doc_id, token FROM x WHERE token IS NOT NULL"""
HTML = rf"""{DOCS}, h AS (SELECT doc_id, ' ' || regexp_replace(text, '[<>&]', ' ', 'g') || ' go ' AS t FROM d)
SELECT doc_id, unnest(list_distinct(list_append(list_transform({words("t")}, lambda x: 'b:' || x), 'u:https://a.example/p'))) AS token FROM h"""

SQL = {
    "tokenize_body": f"{BODY} SELECT doc_id, unnest(tokens) AS token FROM b",
    "subject_unigrams": f"{BODY} SELECT doc_id, unnest(list_distinct(ws)) AS word FROM s",
    "subject_bigrams": f"{BODY} SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]))) AS bigram FROM s",
    "token_doc_freq": f"{BODY} SELECT token, count(*) AS docs FROM tok GROUP BY token",
    "url_normalize": f"{DOCS}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, {URL})) AS url FROM d) SELECT doc_id, url, {cut_url('url')} AS normal FROM x",
    "host_decompose": f"{HOSTS} SELECT host, {REG} AS registrable, {BRAND} AS brand FROM hp",
    "effective_tld": f"{HOSTS} SELECT host, {TLD} AS tld FROM hp",
    "email_address_tokens": rf"""{DOCS}, a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z0-9]')) AS address FROM d),
hosts AS (SELECT address, lower(address) AS a, string_split(lower(address), '@')[2] AS host FROM a), {HOST_PARTS},
x AS (SELECT address, unnest([CASE WHEN strlen(a) BETWEEN 3 AND 40 THEN 'h:from:' || a END, CASE WHEN strlen(host) BETWEEN 3 AND 40 THEN 'h:from:' || host END,
  CASE WHEN ({REG}) <> host AND strlen({REG}) BETWEEN 3 AND 40 THEN 'h:from:' || ({REG}) END, CASE WHEN strlen({BRAND}) BETWEEN 2 AND 40 THEN 'h:from:' || ({BRAND}) END, 'x:tld:' || ({TLD})]) AS token FROM hp)
SELECT address, token FROM x WHERE token IS NOT NULL""",
    "homoglyph_fold": f"WITH f AS (SELECT token_id, lower(word) AS w, translate(lower(word), {Q(FOLD_FROM)}, {Q(FOLD_TO)}) AS s FROM tokens) SELECT token_id, s AS skeleton FROM f WHERE s <> w AND strlen(s) = length(s)",
    "mixed_script_flag": r"SELECT token_id, word FROM tokens WHERE regexp_matches(regexp_replace(word, '^(b|u|h:[a-z]+):', ''), '[A-Za-z]') AND regexp_matches(regexp_replace(word, '^(b|u|h:[a-z]+):', ''), '[\x{0400}-\x{04FF}\x{0370}-\x{03FF}\x{0530}-\x{058F}]')",
    "brand_mismatch": f"""WITH n AS (SELECT token_id, string_split(lower(u), '@')[2] AS host, substr(word, 12) AS name FROM tokens WHERE word LIKE 'h:fromname:%'),
hosts AS (SELECT * FROM n), {HOST_PARTS},
c AS (SELECT token_id, {CANON(f"({BRAND})")} AS own, list_filter(list_transform(list_filter(string_split_regex(translate(name, {Q(FOLD_FROM)}, {Q(FOLD_TO)}), '[^{LETTER}]+'), lambda x: x <> ''), lambda x: {CANON("x")}), lambda x: x IN ({_BRANDS}))[1] AS claimed FROM hp)
SELECT token_id, own, CASE WHEN claimed IS NOT NULL AND NOT coalesce(contains(own, claimed), false) THEN 'x:brandmiss:' || claimed END AS token FROM c""",
    "auth_tokens": """SELECT row_id, unnest(list_filter(['x:auth:spf_' || CASE WHEN verdict = 'GOOD' THEN 'pass' ELSE 'fail' END, CASE WHEN coalesce(verdict, '') <> '' THEN 'x:auth:dkim_' || lower(verdict) END, 'x:auth:dmarc_none', 'x:spf:' || lower(verdict)], lambda x: x IS NOT NULL)) AS token FROM delivery_start""",
    "train_model": f"{MODEL} SELECT u, token, good, spam FROM model",
    "model_totals": f"{MODEL} SELECT u, total_good, total_spam FROM totals",
    "model_counts_by_user": f"{STORED}, n AS (SELECT u, count(*) AS tokens FROM model GROUP BY u) SELECT coalesce(totals.u, n.u) AS u, coalesce(total_good, 0) AS total_good, coalesce(total_spam, 0) AS total_spam, coalesce(tokens, 0) AS tokens FROM totals FULL JOIN n ON totals.u = n.u",
    "model_merge": f"{MODEL}, a AS (SELECT u, word AS token, coalesce(good, 0) AS good, coalesce(spam, 0) AS spam FROM tokens UNION ALL SELECT u, token, good, spam FROM model) SELECT u, token, CAST(sum(good) AS BIGINT) AS good, CAST(sum(spam) AS BIGINT) AS spam FROM a GROUP BY u, token",
    "model_cleanup": f"{STORED} SELECT u, token, good, spam FROM model WHERE NOT (good + spam <= 1 OR coalesce(epoch(last_seen) < epoch(TIMESTAMPTZ '2026-05-01 00:00:00+00') - 30 * 86400, false))",
    "model_export": f"{EXPORT} SELECT u, line FROM x",
    "model_import": f"WITH i AS ({IMPORT.format(u='file', l='raw', src='token_csv')}) {MERGED}",
    "model_import_roundtrip": f"{EXPORT}, i AS ({IMPORT.format(u='u', l='line', src='x')}) {MERGED}",
    "token_prob": f"{STORED} SELECT model.u, token, round({prob()}, 6) AS f FROM model LEFT JOIN totals ON model.u = totals.u",
    "top_interesting": f"{MODEL}, {kept(k=15)} SELECT msg_id, CAST(rn AS INT) AS rn, token, round(f, 6) AS f FROM kept",
    "min_distance_select": f"{MODEL}, {kept(k=50, dist=0.2, least=3)} SELECT msg_id, count(*) AS kept FROM kept GROUP BY msg_id",
    "score_fisher": f"{SCORED} SELECT * FROM sc",
    "score_geometric": f"{MODEL}, {verdicts(combiner=geometric)} SELECT * FROM sc",
    "score_good_bias": f"{MODEL}, {verdicts(k=50, bias=2.0, strength=0.5, unknown=0.45)} SELECT * FROM sc",
    "score_gated": f"{MODEL}, {verdicts(k=27, gate=2, new=0.4)} SELECT * FROM sc",
    "explain_top_tokens": f"{MODEL}, {kept()} SELECT msg_id, CAST(rn AS INT) AS rn, token, good, spam, round(f, 6) AS f FROM kept WHERE good IS NOT NULL AND rn <= 40",
    "confusion_matrix": f"{JUDGED} {rates(f'SELECT {CONF} FROM jd', w=10.0)}",
    "folder_eval": f"{JUDGED} SELECT folder, {CONF} FROM jd JOIN documents ON msg_id = doc_id GROUP BY folder",
    "score_percentiles": f"{JUDGED}, r AS (SELECT is_spam, score, row_number() OVER (PARTITION BY is_spam ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY is_spam) AS n FROM jd) SELECT is_spam, CAST(p AS DOUBLE) AS p, score AS value FROM r, unnest([0.01, 0.05, 0.5, 0.95, 0.99]) q(p) WHERE i = round((n - 1) * p)",
    "score_histogram": f"SELECT verdict, {_CELL} AS cell, count(*) AS n FROM (SELECT verdict, TRY_CAST(score AS DOUBLE) AS score FROM delivery_start) WHERE NOT isnan(score) GROUP BY ALL",
    "stratified_split": f"WITH {LABELS}, i AS (SELECT msg_id, is_spam, row_number() OVER (PARTITION BY is_spam ORDER BY msg_id) - 1 AS i, count(*) OVER (PARTITION BY is_spam) AS n FROM lab), t AS (SELECT *, least(greatest(round(n * 0.3), 1), n - 1) AS t FROM i) SELECT msg_id, is_spam, coalesce(t > 0 AND i % floor(n / greatest(t, 1)) = 0 AND floor(i / floor(n / greatest(t, 1))) < t, false) AS is_test FROM t",
    "threshold_sweep": f"{JUDGED}, g AS (SELECT threshold, is_spam, score >= threshold AS pred_spam FROM jd, (SELECT CAST(unnest([{_THRESHOLDS}]) AS DOUBLE) AS threshold)) {rates(f'SELECT threshold, {CONF} FROM g GROUP BY threshold', 'threshold,')}",
    "shadow_compare": f"""{SHADOW}, r AS (SELECT u, delta, row_number() OVER (PARTITION BY u ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY u) AS n FROM sh)
SELECT a.*, p50 AS delta_p50, p99 AS delta_p99 FROM (SELECT u, count(*) AS n, count(*) FILTER (p = c) AS agree, count(*) FILTER (p <> c) AS disagree, count(*) FILTER (p) AS primary_spam, count(*) FILTER (c) AS cand_spam, count(*) FILTER (NOT p AND c) AS stricter, count(*) FILTER (p AND NOT c) AS laxer FROM sh GROUP BY u) a
JOIN (SELECT u, round(max(delta) FILTER (i = round((n - 1) * 0.5)), 6) AS p50, round(max(delta) FILTER (i = round((n - 1) * 0.99)), 6) AS p99 FROM r GROUP BY u) b USING (u)""",
    "shadow_totals": f"{SHADOW} SELECT count(*) AS total_n, count(*) FILTER (p = c) AS agree, count(*) FILTER (p <> c) AS disagree, count(*) FILTER (NOT p AND c) AS stricter, count(*) FILTER (p AND NOT c) AS laxer, round(count(*) FILTER (p = c) / nullif(count(*), 0), 6) AS agree_rate, count(DISTINCT u) AS users FROM sh",
    "fail_open": "WITH s AS (SELECT row_id, upper(verdict) AS verdict, TRY_CAST(score AS DOUBLE) AS score FROM delivery_start), o AS (SELECT row_id, CASE WHEN score IS NULL OR isnan(score) THEN 'GOOD' ELSE verdict END AS v, CASE WHEN score IS NULL OR isnan(score) THEN 0.5 ELSE score END AS s FROM s) SELECT row_id, v, CAST(s AS DOUBLE) AS s, coalesce(v, 'null') || ' ' || printf('%.6f', CAST(s AS DOUBLE)) AS line FROM o",
    "rail_score": RAIL,
    "params_grid": f"{MODEL}, sm AS (SELECT * FROM tok JOIN lab USING (msg_id)), " + """
gr AS (SELECT unnest([""" + ", ".join(f"{{'cand': {c}, 's': {s}, 'x': {x}}}" for c, s, x in _GRID) + f"""], recursive := true)),
pr AS (SELECT cand, t.u, t.msg_id, is_spam, t.token, {prob(strength="s", x="x")} AS f FROM sm t LEFT JOIN model m ON t.u = m.u AND t.token = m.token JOIN totals z ON t.u = z.u, gr),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand, u, msg_id ORDER BY abs(f - 0.5) DESC, token) AS rn FROM pr) WHERE rn <= 150),
hh AS (SELECT cand, u, msg_id, any_value(is_spam) AS is_spam, count(*) AS n, -2 * sum(ln(greatest(1 - f, 1e-200))) AS hs, -2 * sum(ln(greatest(f, 1e-200))) AS hh FROM kept GROUP BY cand, u, msg_id),
jd AS (SELECT cand, is_spam, round(least(greatest((1 + (1 - {tail("hs")}) - (1 - {tail("hh")})) / 2, 0.0), 1.0), 12) >= 0.5 AS pred_spam FROM hh)
SELECT CAST(cand AS INT) AS cand, {CONF} FROM jd GROUP BY cand""",
    "log_parse": f"{EVENTS} SELECT * FROM ev",
    "session_stitch": f"{PAIRS} SELECT * FROM st",
    "session_orphans": f"{PAIRS} SELECT file, line_no, sess, u FROM st WHERE msgid IS NULL",
    "train_events_by_user": f"{EVENTS} SELECT u, count(*) FILTER (v = 'good') AS good, count(*) FILTER (v <> 'good') AS spam FROM ev WHERE kind = 'T' GROUP BY u",
    "events_by_date": "SELECT left(ts, 10) AS d, count(*) AS n FROM delivery_start WHERE strlen(ts) >= 10 GROUP BY 1",
    "top_users": "SELECT u, count(*) AS n, count(*) FILTER (verdict = 'GOOD') AS good, count(*) FILTER (coalesce(verdict, '') <> 'GOOD') AS spam FROM delivery_start WHERE u IS NOT NULL GROUP BY u ORDER BY n DESC, u LIMIT 15",
    "harvest_totals": f"{PAIRS} SELECT count(*) AS deliveries, count(msgid) AS with_msgid, count(*) FILTER (msgid IS NULL) AS orphans, count(DISTINCT u) AS users, count(DISTINCT CASE WHEN strlen(t) >= 10 THEN left(t, 10) END) AS dates FROM st",
    "correlate_labels": f"{DELIV} SELECT * FROM co",
    "correlate_bands": f"{DELIV} SELECT label, confidence, count(*) AS n, count(*) FILTER (algo_error) AS algo_errors FROM co GROUP BY ALL",
    "correlate_unmatched": f"{DELIV} SELECT count(*) AS files, count(*) FILTER (msgid IS NULL) AS no_msgid, count(msgid) AS with_msgid, count(*) FILTER (msgid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM last WHERE last.u = fl.u AND last.msgid = fl.msgid)) AS not_in_log FROM fl",
    "nightly_stats": f"{NIGHTLY} SELECT * FROM n",
    "latest_per_user": f"{NIGHTLY} SELECT * FROM la",
    "cluster_digest": f"{NIGHTLY} SELECT count(*) AS users, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(good) AS BIGINT) AS good, CAST(sum(spam) AS BIGINT) AS spam, count(*) FILTER (good >= 5000 AND spam >= 5000) AS mature FROM us",
    "digest_top_missed": f"{DELIV}, {CORRECTED} SELECT * FROM (SELECT * FROM us ORDER BY fn DESC, u LIMIT 20) WHERE fn > 0",
    "digest_candidates": f"{DELIV}, {CORRECTED} SELECT * FROM us WHERE good >= 5000 AND spam >= 5000 AND fn >= 5",
    "digest_false_positives": f"{DELIV}, {CORRECTED} SELECT * FROM us WHERE fp > 0",
    "allowlist_all": "SELECT row_id, u FROM delivery_start",
    "tune_skipped": "SELECT u, coalesce(total_good, 0) < 100 OR coalesce(total_spam, 0) < 50 AS skipped FROM model_totals",
    "mime_tokens": MIME,
    "html_to_tokens": HTML,
    "shadow_ordered": f"{SHADOW}, g AS (SELECT u, count(*) AS n, count(*) FILTER (p <> c) AS disagree FROM sh GROUP BY u) SELECT CAST(row_number() OVER (ORDER BY disagree DESC, n DESC, u) AS INT) AS rank, u, n, disagree FROM g ORDER BY disagree DESC, n DESC, u LIMIT 20",
    "allowlist_semi": "SELECT row_id, u FROM delivery_start WHERE lower(u) IN (SELECT lower(upper(u)) FROM model_totals WHERE total_good > total_spam)",
    "limit_per_folder": "SELECT u, folder, path FROM (SELECT *, row_number() OVER (PARTITION BY u, folder ORDER BY path) AS i FROM mailbox_file) WHERE i <= 5",
    "stream_session_stitch": f"{PAIRS} SELECT * FROM st WHERE msgid IS NOT NULL",
    "stream_daily_counts": "SELECT CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS d, verdict, count(*) AS n FROM delivery_start WHERE verdict IS NOT NULL GROUP BY ALL",
}
