"""Queries of the general cleaning operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import logparse
from quillsift.operators import orphans as orphans_op
from quillsift.operators import rejects as rejects_op
from quillsift.operators import upsert as upsert_op
from quillsift.shared import table


def p2_found(spark, d):
    return orphans_op.orphans(table(spark, d, "delivery_start"), table(spark, d, "msgid_line"), table(spark, d, "mailbox_file"))


def p2_orphans_by_batch(spark, d):
    return orphans_op.orphan_report(table(spark, d, "delivery_start"), table(spark, d, "msgid_line"), table(spark, d, "mailbox_file"))


def p3_found(spark, d):
    return logparse.deliveries(table(spark, d, "mail_log"))


def p3_entries_by_level(spark, d):
    """Entries, lines and unparsed characters of every file by level and component."""
    e = logparse.parse_log(table(spark, d, "mail_log"))
    return e.groupBy("file", "level", "component").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("lines").alias("lines"), F.count("verdict").alias("deliveries"), F.sum("unparsed").alias("unparsed")
    )


def p3_entries(spark, d):
    """Every entry: its lines, level, component and whole message."""
    return logparse.parse_log(table(spark, d, "mail_log")).select("file", "line_no", "lines", "ts_us", "level", "component", "message")


def p3_unparsed(spark, d):
    """What no rule but the catch-all ones covers: the entry's first line, and the line and bounds of each span."""
    e = logparse.parse_log(table(spark, d, "mail_log"))
    return e.select("file", "line_no", F.explode("spans").alias("s")).select("file", "line_no", F.col("s.line_no").alias("span_line"), "s.start", "s.end")


def p4_found(spark, d):
    return upsert_op.surplus(table(spark, d, "msgid_line"), table(spark, d, "delivery_start"))


def p4_surplus_by_batch(spark, d):
    return upsert_op.surplus_report(table(spark, d, "msgid_line"), table(spark, d, "delivery_start"))


def p4_kept(spark, d):
    return upsert_op.kept_after_repeats(table(spark, d, "msgid_line"), table(spark, d, "delivery_start"))


def p5_found(spark, d):
    return rejects_op.rejected(table(spark, d, "token_csv"))


def p5_loaded(spark, d):
    return rejects_op.loaded(table(spark, d, "token_csv"))


def p5_outcomes(spark, d):
    return rejects_op.reject_report(table(spark, d, "token_csv"))


QUERIES = {
    "p2_found": p2_found,
    "p2_orphans_by_batch": p2_orphans_by_batch,
    "p3_found": p3_found,
    "p3_entries_by_level": p3_entries_by_level,
    "p3_entries": p3_entries,
    "p3_unparsed": p3_unparsed,
    "p4_found": p4_found,
    "p4_surplus_by_batch": p4_surplus_by_batch,
    "p4_kept": p4_kept,
    "p5_found": p5_found,
    "p5_loaded": p5_loaded,
    "p5_outcomes": p5_outcomes,
}

_KEYS = r"""
WITH ds AS (SELECT row_id, u, batch_id, ts, loaded_at, nullif(regexp_replace(session, '^[\s <>]+|[\s <>]+$', '', 'g'), '') AS s FROM delivery_start),
     ml0 AS (SELECT row_id, u, batch_id, loaded_at, nullif(regexp_replace(session, '^[\s <>]+|[\s <>]+$', '', 'g'), '') AS s,
                   nullif(nullif(regexp_replace(msgid, '^[\s <>]+|[\s <>]+$', '', 'g'), ''), 'noid') AS m FROM msgid_line),
     ml AS (SELECT row_id, u, batch_id, loaded_at, s, CASE WHEN m LIKE '%@%' THEN regexp_replace(m, '@[^@]*$', '') || lower(regexp_extract(m, '@[^@]*$')) ELSE m END AS m FROM ml0),
     mf0 AS (SELECT seen_at, deleted_at, nullif(nullif(regexp_replace(msgid, '^[\s <>]+|[\s <>]+$', '', 'g'), ''), 'noid') AS m FROM mailbox_file),
     mf AS (SELECT seen_at, deleted_at, CASE WHEN m LIKE '%@%' THEN regexp_replace(m, '@[^@]*$', '') || lower(regexp_extract(m, '@[^@]*$')) ELSE m END AS m FROM mf0)
"""

_P2 = (
    _KEYS
    + """,
miss AS (
  SELECT 'delivery_start' AS src_table, 'session' AS src_field, r.row_id, r.batch_id, CASE WHEN p.t IS NULL THEN 'missing' WHEN p.t > r.loaded_at THEN 'late' END AS reason
  FROM ds r LEFT JOIN (SELECT s, min(loaded_at) AS t FROM ml WHERE s IS NOT NULL GROUP BY s) p ON r.s = p.s WHERE r.s IS NOT NULL
  UNION ALL
  SELECT 'msgid_line', 'session', r.row_id, r.batch_id, CASE WHEN p.t IS NULL THEN 'missing' WHEN p.t > r.loaded_at THEN 'late' END
  FROM ml r LEFT JOIN (SELECT s, min(loaded_at) AS t FROM ds WHERE s IS NOT NULL GROUP BY s) p ON r.s = p.s WHERE r.s IS NOT NULL
  UNION ALL
  SELECT 'msgid_line', 'msgid', r.row_id, any_value(r.batch_id),
    CASE WHEN count(f.m) = 0 THEN 'missing'
         WHEN bool_or(f.seen_at <= r.loaded_at AND (f.deleted_at IS NULL OR f.deleted_at > r.loaded_at)) THEN NULL
         WHEN bool_or(f.seen_at <= r.loaded_at) THEN 'deleted' ELSE 'late' END
  FROM ml r LEFT JOIN mf f ON r.m = f.m WHERE r.m IS NOT NULL GROUP BY r.row_id)
"""
)

_P4 = (
    _KEYS
    + r""",
st AS (SELECT s, min(t) AS t FROM (
   SELECT s, CASE WHEN regexp_full_match(ts, '\d+\.\d+') THEN CAST(split_part(ts, '.', 1) AS BIGINT) * 1000000 + CAST(split_part(ts, '.', 2) AS BIGINT)
     ELSE epoch_us(TRY_CAST(regexp_replace(replace(replace(ts, ',', '.'), ' +', '+'), ' ?([+-]\d\d):?(\d\d)$', '\1:\2') AS TIMESTAMPTZ)) END AS t
   FROM ds WHERE s IS NOT NULL) GROUP BY s),
ranked AS (SELECT ml.row_id, ml.batch_id, row_number() OVER (PARTITION BY ml.u, ml.m ORDER BY st.t NULLS LAST, ml.row_id) AS rn
   FROM ml LEFT JOIN st ON ml.s = st.s WHERE ml.u IS NOT NULL AND ml.m IS NOT NULL)
"""
)

_P5 = r"""
WITH t AS (SELECT csv_id, file, line_no, regexp_replace(raw, '\r$', '') AS r FROM token_csv WHERE raw IS NOT NULL),
n AS (SELECT * FROM t WHERE NOT regexp_full_match(r, '[ \t]*')),
-- a well-formed field is quoted, or has no quote at all
j AS (SELECT *, regexp_full_match(r, '(?s)[ \t]*("([^"]|"")*"[ \t]*|[^",]*)(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*') AS fine,
   len(regexp_extract_all(r, '(?s),|"(?:[^"]|"")*"')) - len(regexp_extract_all(r, '(?s)"(?:[^"]|"")*"')) + 1 AS fields FROM n),
v AS (SELECT *, regexp_extract(r, '(?s)^[ \t]*("(?:[^"]|"")*"|[^",]*?)[ \t]*,[ \t]*("(?:[^"]|"")*"|[^",]*?)[ \t]*,[ \t]*("(?:[^"]|"")*"|[^",]*?)[ \t]*,[ \t]*("(?:[^"]|"")*"|[^",]*?)[ \t]*$', ['a', 'b', 'c', 'd']) AS f FROM j),
w AS (SELECT csv_id, file, line_no, fine, fields, regexp_replace(f.a, '^"(.*)"$', '\1', 's') AS g, regexp_replace(f.b, '^"(.*)"$', '\1', 's') AS s,
   CASE WHEN f.d LIKE '"%' THEN replace(f.d[2:-2], '""', '"') ELSE f.d END AS word FROM v),
judged AS (SELECT csv_id, file, line_no, word,
   CASE WHEN regexp_full_match(g, '[0-9]+') THEN TRY_CAST(g AS BIGINT) END AS good, CASE WHEN regexp_full_match(s, '[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS spam,
   CASE WHEN NOT fine THEN 'quoting' WHEN fields <> 4 THEN 'columns'
     WHEN NOT regexp_full_match(g, '[0-9]+') OR TRY_CAST(g AS BIGINT) IS NULL OR NOT regexp_full_match(s, '[0-9]+') OR TRY_CAST(s AS BIGINT) IS NULL
       OR word = '' OR regexp_matches(word, '[\x{00}-\x{1f}\x{7f}-\x{9f}\x{fffd}]') THEN 'value' END AS reason FROM w)
"""

# entries by a running count of header lines; one pattern for each layout, folder greedy up to the last result
_P3 = r"""
WITH l AS (SELECT file, line_no, rtrim(coalesce(line, ''), chr(13)) AS line FROM mail_log),
h AS (SELECT *, regexp_matches(line, '^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:|\[\d\d/|time=\d|<\d+>\d{4}-|\{)') AS head FROM l),
g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY file ORDER BY line_no) AS n FROM h),
-- noise behind an entry is no part of it
e AS (SELECT file, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS t FROM g
      WHERE head OR regexp_matches(line, '^\s+\S') AND NOT regexp_matches(line, '^\s+(\||at )') OR line = '}' GROUP BY file, n HAVING bool_or(head)),
x AS (SELECT file, line_no, t, regexp_extract(file, '(\d{4})-\d\d-\d\d', 1) AS y, CASE
   WHEN t LIKE '{%' THEN 'json' WHEN t LIKE 'time=%' THEN 'kv' WHEN t LIKE '<%' THEN 'pri' WHEN t LIKE '[%' THEN 'clf'
   WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d ') THEN 'block' WHEN regexp_matches(t, '^\d') THEN 'iso' ELSE 'sys' END AS k FROM e),
f AS (SELECT *, CASE k WHEN 'block' THEN '' WHEN 'clf' THEN ''
   WHEN 'json' THEN CASE WHEN json_valid(t) THEN regexp_extract(json_extract_string(t, '$.msg'), '^(?:sieve: )?(DELIVERY: .*)$', 1) ELSE '' END
   WHEN 'kv' THEN regexp_replace(regexp_extract(t, '^time=[\d.]+ .*?msg="(DELIVERY: .*)"$', 1), '\\(.)', '\1', 'g')
   WHEN 'pri' THEN regexp_extract(t, '^<\d+>\S+ \S+ \S+ \d+ (DELIVERY) \[sess="[^"]*"\] ', 1) || ': ' || regexp_extract(t, '^<\d+>\S+ \S+ \S+ \d+ DELIVERY \[sess="[^"]*"\] (.*)$', 1)
   ELSE regexp_extract(t, '(?s)^.*?\)<\d+><[^>]*>: (?:sieve: DEBUG: |Debug: sieve: )(DELIVERY: .*)$', 1) END AS d FROM x),
r AS (SELECT *, CASE k WHEN 'block' THEN regexp_extract(t, '\n\s+folder: *([^\n]*[^\n ])', 1) WHEN 'clf' THEN regexp_replace(regexp_extract(t, ' folder="((?:[^"\\]|\\.)*)"', 1), '\\(.)', '\1', 'g')
     ELSE regexp_extract(d, '(?s)^DELIVERY: [^\s@]+@\S+ ->\s+(\S.*?) *\((?i:spam|good) +[\d.eE+-]+\)$', 1) END AS folder,
   CASE k WHEN 'block' THEN regexp_extract(t, '\n\s+verdict: *((?i:spam|good)) +[\d.eE+-]+(\n|$)', 1) WHEN 'clf' THEN regexp_extract(t, ' verdict=((?i:spam|good))( |$)', 1)
     ELSE regexp_extract(d, '\(((?i:spam|good)) +[\d.eE+-]+\)$', 1) END AS verdict,
   CASE k WHEN 'block' THEN regexp_extract(t, '\n\s+verdict: *(?i:spam|good) +([\d.eE+-]+)(\n|$)', 1) WHEN 'clf' THEN regexp_extract(t, ' score=([\d.eE+-]+)( |$)', 1)
     ELSE regexp_extract(d, '\((?i:spam|good) +([\d.eE+-]+)\)$', 1) END AS score,
   CASE k WHEN 'block' THEN regexp_matches(t, '\n\s+user: *\S+@') WHEN 'clf' THEN regexp_matches(t, ' DELIVERY .*user=\S+@') ELSE true END AS owner,
   CASE k WHEN 'json' THEN json_extract_string(t, '$.time') WHEN 'pri' THEN regexp_extract(t, '^<\d+>(\S+)', 1)
     WHEN 'block' THEN replace(regexp_extract(t, '^(\S+ \S+)', 1), ',', '.') || '+00:00' ELSE regexp_extract(t, '^(\S+)', 1) END AS ts FROM f)
SELECT file, line_no, CASE k WHEN 'kv' THEN CAST(round(CAST(regexp_extract(ts, '=(.*)', 1) AS DECIMAL(20, 6)) * 1000000) AS BIGINT)
    WHEN 'clf' THEN epoch_us(strptime(regexp_extract(t, '^\[([^\]]*)\]', 1), '%d/%b/%Y:%H:%M:%S %z'))
    WHEN 'sys' THEN epoch_us(strptime(y || ' ' || replace(left(t, 15), '  ', ' 0'), '%Y %b %d %H:%M:%S')) ELSE epoch_us(CAST(ts AS TIMESTAMPTZ)) END AS ts_us,
  upper(verdict) AS verdict, CAST(round(CAST(score AS DOUBLE) * 1000000) AS BIGINT) AS score_e6, folder
FROM r WHERE owner AND folder <> '' AND verdict <> '' AND TRY_CAST(score AS DOUBLE) IS NOT NULL
"""

# every entry, by its header's layout
_P3_ENTRIES = r"""
WITH l AS (SELECT file, line_no, any_value(rtrim(coalesce(line, ''), chr(13))) AS line FROM mail_log GROUP BY file, line_no),
h AS (SELECT *, regexp_matches(line, '^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:|\[\d\d/|time=\d|<\d+>\d{4}-|\{)') AS head FROM l),
g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY file ORDER BY line_no) AS n FROM h),
e AS (SELECT file, min(line_no) AS line_no, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS t,
   string_agg(line, chr(10) ORDER BY line_no) FILTER (head OR regexp_matches(line, '^\s+\S') AND NOT regexp_matches(line, '^\s+(\||at )')) AS f FROM g GROUP BY file, n),
x AS (SELECT *, regexp_extract(file, '(\d{4})-\d\d-\d\d', 1) AS y, CASE
   WHEN t LIKE '{%' THEN 'json' WHEN t LIKE 'time=%' THEN 'kv' WHEN t LIKE '<%' THEN 'pri' WHEN t LIKE '[%' THEN 'clf'
   WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d ') THEN 'block' WHEN regexp_matches(t, '^\d{4}-') THEN 'iso' WHEN regexp_matches(t, '^[A-Z][a-z][a-z] [ \d]\d ') THEN 'sys' ELSE 'none' END AS k FROM e),
p AS (SELECT *, CASE k WHEN 'iso' THEN regexp_extract(t, '^\S+', 0) WHEN 'sys' THEN left(t, 15) WHEN 'pri' THEN regexp_extract(t, '^\S+', 0)
   WHEN 'block' THEN regexp_extract(t, '^\S+ \S+', 0) WHEN 'clf' THEN regexp_extract(t, '^\[[^\]]*\]', 0) ELSE '' END AS stamp FROM x),
q AS (SELECT *, CASE k WHEN 'json' THEN regexp_extract(t, '"unit"\s*:\s*"([^"]*)"', 1) WHEN 'kv' THEN regexp_extract(t, ' comp=(\S+)', 1)
   WHEN 'block' THEN regexp_extract(t, '^\S+ \S+ +\w+ +\[[^\]]*\] +([\w.-]+):', 1) WHEN 'clf' THEN regexp_extract(t, '^\[[^\]]*\] +\w+ +(\S+) - ', 1)
   WHEN 'none' THEN '' ELSE regexp_extract(substr(t, length(stamp) + 1), '^ +[\w.-]+ +([\w./-]+)', 1) END AS unit,
   CASE k WHEN 'json' THEN regexp_extract(t, '"lvl"\s*:\s*"([^"]*)"', 1) WHEN 'kv' THEN regexp_extract(t, ' level=(\w+)', 1)
   WHEN 'block' THEN regexp_extract(t, '^\S+ \S+ +(\w+) ', 1) WHEN 'clf' THEN regexp_extract(t, '^\[[^\]]*\] +(\w+) ', 1) ELSE '' END AS lv,
   CASE k WHEN 'block' THEN regexp_replace(t, '^\S+ \S+ +\w+ +\[[^\]]*\] +[\w.-]+: *', '') WHEN 'clf' THEN regexp_replace(t, '^\[[^\]]*\] +\w+ +\S+ - *', '')
   WHEN 'pri' THEN regexp_replace(substr(t, length(stamp) + 1), '^ +\S+ +\S+ +(\d+ +)?', '')
   ELSE regexp_replace(substr(t, length(stamp) + 1), '^ +[\w.-]+ +[\w./-]+(\[\d+\])?: *', '') END AS rest FROM p),
r AS (SELECT *, CASE WHEN k IN ('iso', 'sys') THEN regexp_extract(rest, '^([\w-]+)\([^()\s]*\)<\d+><[^<>\s]*>:', 1) ELSE '' END AS ctx,
   CASE WHEN k IN ('iso', 'sys') AND NOT regexp_matches(rest, '(?i)^(sieve|delivery|debug|info|warn|warning|error):') THEN regexp_extract(rest, '^([\w-]+):\s', 1) ELSE '' END AS sub FROM q),
m AS (SELECT *, CASE WHEN ctx <> '' THEN regexp_replace(rest, '^[\w-]+\([^()\s]*\)<\d+><[^<>\s]*>: *', '') WHEN sub <> '' THEN regexp_replace(rest, '^[\w-]+: *', '') ELSE rest END AS body FROM r),
w AS (SELECT *, CASE WHEN k IN ('iso', 'sys') THEN lower(regexp_extract(body, '^(?:sieve: +)?(DEBUG|Debug|debug|INFO|Info|info|WARN|WARNING|Warning|ERROR|Error|error)(?::|\s|$)', 1)) ELSE lower(lv) END AS lev FROM m)
SELECT file, line_no, lines, CASE k WHEN 'kv' THEN CAST(round(CAST(regexp_extract(t, '^time=([\d.]+)', 1) AS DECIMAL(20, 6)) * 1000000) AS BIGINT)
    WHEN 'clf' THEN epoch_us(strptime(stamp, '[%d/%b/%Y:%H:%M:%S %z]')) WHEN 'sys' THEN epoch_us(strptime(y || ' ' || replace(stamp, '  ', ' 0'), '%Y %b %d %H:%M:%S'))
    WHEN 'json' THEN epoch_us(TRY_CAST(nullif(regexp_extract(t, '"time"\s*:\s*"([^"]*)"', 1), '') AS TIMESTAMPTZ))
    WHEN 'block' THEN epoch_us(CAST(replace(stamp, ',', '.') || '+00:00' AS TIMESTAMPTZ)) WHEN 'none' THEN NULL ELSE epoch_us(CAST(regexp_replace(stamp, '^<\d+>', '') AS TIMESTAMPTZ)) END AS ts_us,
  nullif(CASE lev WHEN 'dbg' THEN 'debug' WHEN 'warning' THEN 'warn' WHEN 'err' THEN 'error' ELSE lev END, '') AS level,
  nullif(unit || CASE WHEN ctx <> '' THEN '/' || ctx WHEN sub <> '' THEN '/' || sub ELSE '' END, '') AS component,
  CASE k WHEN 'json' THEN coalesce(CASE WHEN regexp_matches(f, '[{,]\s*"msg"\s*:\s*"(?:[^"\\]|\\.)*"') THEN json_extract_string(CAST(regexp_extract(f, '[{,]\s*"msg"\s*:\s*("(?:[^"\\]|\\.)*")', 1) AS JSON), '$') END, t)
    WHEN 'kv' THEN CASE WHEN regexp_matches(f, '^time=.*? msg="(DELIVERY: .*)"$') THEN regexp_replace(regexp_extract(f, '^time=.*? msg="(.*)"$', 1), '\\(.)', '\1', 'g') ELSE t END ELSE body END AS message
FROM w
"""

SQL = {
    "p3_found": _P3,
    "p3_entries": f"SELECT file, line_no, lines, ts_us, level, component, message FROM ({_P3_ENTRIES})",

    "p2_found": _P2 + "SELECT src_table, src_field, row_id, reason FROM miss WHERE reason IS NOT NULL",
    "p2_orphans_by_batch": _P2 + "SELECT src_table, src_field, batch_id, reason, count(*) AS misses FROM miss WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT row_id FROM ranked WHERE rn > 1",
    "p4_kept": _P4 + "SELECT row_id FROM ranked WHERE rn = 1",
    "p4_surplus_by_batch": _P4 + "SELECT batch_id, count(*) AS surplus FROM ranked WHERE rn > 1 GROUP BY batch_id",
    "p5_found": _P5 + "SELECT csv_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_loaded": _P5 + "SELECT csv_id, file, line_no, word, good, spam FROM judged WHERE reason IS NULL",
    "p5_outcomes": _P5 + "SELECT file, coalesce(reason, 'loaded') AS outcome, count(*) AS lines FROM judged GROUP BY ALL",
}
