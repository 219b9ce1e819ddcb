"""Messages into sets of prefixed tokens.

Input is a message per row, with the structured columns of :mod:`quillsift.sources.mime`, or simply texts
(subject: the first line with anything on it).  A token counts once for a message, whatever its frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.params import TokenizerConfig


def _none() -> Column:
    return F.array().cast("array<string>")


def _each(items: Column, build) -> Column:
    """The tokens of all items, in order."""
    return F.flatten(F.transform(F.coalesce(items, _none()), build))


def message_tokens(df: DataFrame, config: TokenizerConfig | None = None) -> DataFrame:
    """Add ``tokens`` to structured messages: distinct, in byte order.

    Columns used: ``subject``, ``from_``, ``reply_to``, ``sender``, ``to``, ``cc`` (arrays of name and address),
    ``received`` (array of hosts from and by), ``auth_results``, ``received_spf``, ``text_bodies``, ``html_bodies``.
    Body tokens are taken while the message has fewer than ``max_raw_tokens`` raw tokens, those of its headers among
    them; header tokens always count whole.
    """
    c = config or TokenizerConfig()
    low, high = c.min_len, c.max_len
    ws = F.filter(T.words(F.col("subject")), lambda w: T.valid(w, low, high))
    parts = [
        T.word_tokens(ws, "h:subject:", c.homoglyph_fold, low, high),
        F.transform(T.bigrams(ws), lambda b: F.concat(F.lit("h:subject:"), b)),
    ]

    def addresses(column: str, prefix: str) -> Column:
        def one(a: Column) -> Column:
            tokens = T.address_tokens(prefix, a["address"], low, high, c.tld_feature)
            if c.brand_mismatch and prefix == "h:from:":
                tokens = F.concat(tokens, F.coalesce(T.name_tokens(a["name"], a["address"], c.homoglyph_fold, low, high), _none()))
            return F.when(a["address"].isNotNull(), tokens).otherwise(_none())

        return F.flatten(F.transform(F.coalesce(F.col(column), F.array().cast("array<struct<name:string,address:string>>")), one))

    parts += [addresses("from_", "h:from:"), addresses("reply_to", "h:replyto:"), addresses("sender", "h:sender:")]
    if c.expanded_headers:
        parts += [addresses("to", "h:to:"), addresses("cc", "h:cc:")]
    hops = F.coalesce(F.col("received"), F.array().cast("array<struct<from_host:string,by_host:string>>"))

    def hop(h: Column, prefix: Column) -> Column:
        hosts = F.transform(F.array_compact(F.array(h["from_host"], h["by_host"])), F.lower)
        return F.transform(F.filter(hosts, lambda x: T.valid(x, low, high)), lambda x: F.concat(prefix, x))

    if c.expanded_headers:
        parts.append(F.flatten(F.transform(hops, lambda h, i: hop(h, F.when(i == 0, F.lit("h:hrecv:")).otherwise(F.lit("h:hrecvx:"))))))
    else:
        parts.append(F.flatten(F.transform(F.slice(hops, 1, 1), lambda h: hop(h, F.lit("h:received:")))))
    if c.auth_tokens:
        parts.append(_each(F.col("auth_results"), T.auth_tokens))
        parts.append(F.array_compact(F.transform(F.coalesce(F.col("received_spf"), _none()), T.spf_token)))

    def body(text: Column, urls: Column) -> Column:
        kept = F.filter(urls, lambda u: T.valid(u, low, high))
        found = F.filter(T.words(text), lambda w: T.valid(w, low, high))
        return F.concat(F.transform(kept, lambda u: F.concat(F.lit("u:"), u)), T.word_tokens(found, "b:", c.homoglyph_fold, low, high))

    head = F.concat(*parts)
    texts = _each(F.col("text_bodies"), lambda t: body(t, T.urls_of_text(t, high)))
    htmls = _each(F.col("html_bodies"), lambda h: body(T.strip_html(h), T.urls_of_html(h, high)))
    bodies = F.concat(texts, htmls)
    if c.max_raw_tokens is not None:
        bodies = F.slice(bodies, F.lit(1), F.greatest(F.lit(c.max_raw_tokens) - F.size(head), F.lit(0)))
    return df.withColumn("tokens", F.array_sort(F.array_distinct(F.concat(head, bodies))))


def first_line(text: Column) -> Column:
    """The first line that is not blank."""
    return F.regexp_extract(text, r"^\s*([^\r\n]*)", 1)


def body_tokens(text: Column, config: TokenizerConfig | None = None) -> Column:
    """Distinct body tokens of a plain text, in byte order."""
    c = config or TokenizerConfig()
    urls = F.transform(F.filter(T.urls_of_text(text, c.max_len), lambda u: T.valid(u, c.min_len, c.max_len)), lambda u: F.concat(F.lit("u:"), u))
    ws = T.word_tokens(T.valid_words(text, c.min_len, c.max_len), "b:", c.homoglyph_fold, c.min_len, c.max_len)
    raw = F.concat(urls, ws)
    raw = raw if c.max_raw_tokens is None else F.slice(raw, 1, c.max_raw_tokens)
    return F.array_sort(F.array_distinct(raw))


def subject_tokens(text: Column, config: TokenizerConfig | None = None) -> Column:
    """Subject words and their bigrams, of the first line of a text."""
    c = config or TokenizerConfig()
    ws = T.valid_words(first_line(text), c.min_len, c.max_len)
    both = F.concat(T.word_tokens(ws, "h:subject:", c.homoglyph_fold), F.transform(T.bigrams(ws), lambda b: F.concat(F.lit("h:subject:"), b)))
    return F.array_sort(F.array_distinct(both))


def text_tokens(documents: DataFrame, config: TokenizerConfig | None = None) -> DataFrame:
    """``u, msg_id, token`` of plain texts (``u, doc_id, text``), one row per distinct token of a message.

    Duplicates are dropped inside the row, before anything is exploded or shuffled.
    """
    text = F.col("text")
    tokens = F.array_sort(F.array_distinct(F.concat(subject_tokens(text, config), body_tokens(text, config))))
    return documents.filter(text.isNotNull()).select("u", F.col("doc_id").alias("msg_id"), F.explode(tokens).alias("token"))
