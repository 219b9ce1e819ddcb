"""Visually identical words with different characters, brought to one form.

A word's look is its characters after a translation table: no-width characters go, blanks and hyphens
become one, letters and digits become the plain ones they are drawn as.  Looks are grouped in SQL under
the accent-sensitive Unicode collation, which takes composed and combining accents as equal; each class's
canonical member is the least of its plainest words, and is joined back to the rows.

Two different words of printable ASCII without blanks never look the same, so such words count only where a
word with other characters has their look: all others are left out by a semi join before anything is sorted
under the collation.

The table is a literal of one ``translate``; the few characters that stand for several letters (ligatures) take a second
path that only words containing one enter. Words whose combining marks may be out of order are composed in Arrow batches.

Defined results
---------------
* rows without owner or word belong to no class and keep their word
* identical strings are no pair; rows repeated with another form pair with each of its rows
* words that are empty once trimmed (a prefix alone) form a class of their own prefix
* combining marks count in their canonical order, composed or not
* empty tables give nothing; further columns are carried along under their own names
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts and styles drawn like the plain letter in the same place below.
DRAWN = (
    "аеѕіјорсухһԁԛԝѵӏү" + "АВЕЅІЈКМНОРСТУХԚԜѴӀҮ" + "αινορυϲϳ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ" + "հոսօցզյՕՏՍ" + "ɑɡɩ" + "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘꞯʀꜱᴛᴜᴠᴡʏᴢ"
)
PLAIN = (
    "aesijopcyxhdqwvly" + "ABESIJKMHOPCTYXQWVIY" + "aivopucj" + "ABEZHIKMNOPTYXCJ" + "hnuogqjOSU" + "agi" + "abcdefghijklmnopqrstuvwyz"
)
# The hyphens, and characters without width beside those of category Cf.
HYPHENS = "‐‑﹣－"
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


@lru_cache(1)
def tables() -> tuple[str, str, dict[str, str]]:
    """``from`` and ``to`` of the translation (characters beyond ``to`` are dropped), and the characters
    that stand for several."""
    drawn = dict(zip(DRAWN, PLAIN, strict=True))
    one, gone, several = {}, [], {}
    for code in (*range(0x20000), *range(0xE0000, 0xE0200)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Cf" or kind == "Cc" and not c.isspace() or c in NO_WIDTH or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            gone.append(c)
        elif c in HYPHENS:
            one[c] = "-"
        elif c != " " and (c.isspace() or kind == "Zs"):
            one[c] = " "
        elif code > 127 and not 0xAC00 <= code <= 0xD7A3:
            parts = unicodedata.normalize("NFKD", c)
            look = unicodedata.normalize("NFC", "".join(drawn.get(x, x) for x in parts))
            if look == c or not (parts[0].isalnum() or 0xFF00 <= code <= 0xFF65):
                continue
            if len(look) == 1:
                one[c] = look
            elif look != unicodedata.normalize("NFC", c):
                several[c] = look
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _map(d: dict[str, str]):
    return F.map_from_arrays(F.split(F.lit("\x1f".join(d)), "\x1f"), F.split(F.lit("\x1f".join(d.values())), "\x1f"))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def ordered(c):
    """A text with its combining marks in canonical order. Only texts with two marks in a row, or one behind other than
    ASCII, can be out of order; the collation takes care of all others."""
    return F.coalesce(_composed(F.when(c.rlike(r"\p{M}\p{M}|[^\x00-\x7F]\p{M}"), c)), c)


def with_look(df: DataFrame) -> DataFrame:
    """Add ``__look``: what ``word`` looks like, before the collation takes care of accents.

    Each step is a projection of its own, so that nothing is computed twice for a row.
    """
    source, target, several = tables()
    word = F.col("word")
    letters = _map(several)
    has = F.translate(word, "".join(several), "") != word
    wide = F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    df = df.withColumn("__mapped", F.translate(F.when(has, wide).otherwise(word), source, target))
    df = df.withColumn("__mapped", ordered(F.col("__mapped")))
    df = df.withColumn("__prefix", F.regexp_extract("__mapped", "^ *((?:b|u|h:[^: ]+):)", 1))
    # blanks at the ends of the part behind the prefix
    rest = F.when(F.col("__prefix") != "", F.regexp_replace("__mapped", "^ *(?:b|u|h:[^: ]+):", "")).otherwise(F.col("__mapped"))
    return df.withColumn("__look", F.concat("__prefix", F.trim(rest))).drop("__mapped", "__prefix")


def looked(tokens: DataFrame) -> DataFrame:
    """The rows that may have a double, with their look under the collation as ``__key``."""
    spark = tokens.sparkSession
    named = tokens.filter(F.col("u").isNotNull() & F.col("word").isNotNull())
    plain = F.col("word").rlike(r"^[!-~]+\z")
    odd = with_look(named.filter(~plain))
    wanted = odd.select("u", F.col("__look").alias("word")).distinct()
    doubles = named.filter(plain).join(wanted, ["u", "word"], "left_semi").withColumn("__look", F.col("word"))
    return spark.sql("SELECT *, __look COLLATE UNICODE AS __key FROM {r}", r=odd.unionByName(doubles)).drop("__look")


def classes(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their look under the collation, and the classes that have more than one form."""
    spark = tokens.sparkSession
    rows = looked(tokens)
    # partial aggregation first: copies of a word are combined before they travel
    found = spark.sql(
        """SELECT u, __key, min(struct(word RLIKE '[^!-~]' AS odd, word AS word)).word AS canonical
           FROM {r} GROUP BY u, __key HAVING min(word) <> max(word)""",
        r=rows.select("u", "word", "__key"),
    )
    return rows, found


def joined_back(tokens: DataFrame) -> DataFrame:
    """Every row of a class of several forms with its ``canonical`` member."""
    rows, found = classes(tokens)
    return tokens.sparkSession.sql("SELECT r.*, c.canonical FROM {r} r JOIN {c} c ON r.u = c.u AND r.__key = c.__key", r=rows, c=found).drop("__key")


def same_look(tokens: DataFrame) -> DataFrame:
    """``token_id_a, token_id_b`` of any two rows of one owner whose words differ and look the same."""
    members = joined_back(tokens.select(F.col("token_id").cast("bigint").alias("token_id"), "u", "word"))
    a = members.select(F.col("token_id").alias("token_id_a"), "u", "canonical", F.col("word").alias("wa"))
    b = members.select(F.col("token_id").alias("token_id_b"), "u", "canonical", F.col("word").alias("wb"))
    pairs = a.join(b, ["u", "canonical"]).filter("token_id_a < token_id_b AND wa <> wb")
    return pairs.select("token_id_a", "token_id_b")


def class_rows(tokens: DataFrame) -> DataFrame:
    """``u, canonical, word, rows, forms``: every form of a class of several, with its rows and the class's forms.

    A row per form, not per pair: of a class that half of an owner's rows belong to, no more than its forms come out."""
    spark = tokens.sparkSession
    forms = joined_back(tokens.select("u", "word")).groupBy("u", "canonical", "word").agg(F.count(F.lit(1)).alias("rows"))
    sizes = spark.sql("SELECT u AS cu, canonical AS cc, count(*) AS forms FROM {f} GROUP BY u, canonical", f=forms)
    return forms.join(sizes, (F.col("u") == F.col("cu")) & (F.col("canonical") == F.col("cc"))).select("u", "canonical", "word", "rows", "forms")


def merged(tokens: DataFrame) -> DataFrame:
    """One row per owner and visible word: the canonical word, its forms and the counts together."""
    spark = tokens.sparkSession
    named = tokens.select("u", "word", "good", "spam", "last_seen").filter(F.col("u").isNotNull() & F.col("word").isNotNull())
    plain = F.col("word").rlike(r"^[!-~]+\z")
    known = named.filter(plain).withColumn("__look", F.col("word")).unionByName(with_look(named.filter(~plain)))
    rows = spark.sql("SELECT *, __look COLLATE UNICODE AS __key FROM {r}", r=known)
    return spark.sql(
        """SELECT u, min(struct(word RLIKE '[^!-~]' AS odd, word AS word)).word AS word, count(DISTINCT word) AS forms,
                  sum(coalesce(good, 0)) AS good, sum(coalesce(spam, 0)) AS spam, max(last_seen) AS last_seen
           FROM {r} GROUP BY u, __key""",
        r=rows,
    )
