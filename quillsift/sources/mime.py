"""Raw RFC 5322 messages into structured rows, by Python's standard parser in Arrow batches.

Text parts are taken as text and HTML parts as HTML, once each; attachments are left out.  A message that can't
be parsed becomes one text body, decoded with replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import getaddresses

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a message that are read.
MAX_BYTES = 64 * 1024 * 1024
_ADDR = "array<struct<name:string,address:string>>"
MESSAGE_DDL = (
    f"subject string, from_ {_ADDR}, reply_to {_ADDR}, sender {_ADDR}, to {_ADDR}, cc {_ADDR}, "
    "received array<struct<from_host:string,by_host:string>>, auth_results array<string>, received_spf array<string>, "
    "text_bodies array<string>, html_bodies array<string>, msgid string"
)
FIELDS = [f.strip().split()[0] for f in regex.split(r",(?![^<]*>)", MESSAGE_DDL)]
_HOP = regex.compile(r"\b(from|by)\s+\[?([A-Za-z0-9.:_-]+)\]?")


def _addresses(m, name: str) -> list[dict]:
    return [{"name": n or None, "address": a} for n, a in getaddresses([str(v) for v in m.get_all(name, [])]) if a]


def parse_message(raw: bytes) -> dict:
    """The fields of one message."""
    out: dict = dict.fromkeys(FIELDS)
    try:
        m = message_from_bytes(raw[:MAX_BYTES], policy=policy.default.clone(utf8=True))
        if not m.keys():
            raise ValueError
        out["subject"] = str(m["subject"]) if m["subject"] is not None else None
        for field, name in (("from_", "from"), ("reply_to", "reply-to"), ("sender", "sender"), ("to", "to"), ("cc", "cc")):
            out[field] = _addresses(m, name)
        hops = []
        for v in m.get_all("received", []):
            found = {}
            for k, h in _HOP.findall(str(v)):
                found.setdefault(k, h.lower())
            hops.append({"from_host": found.get("from"), "by_host": found.get("by")})
        out["received"] = hops
        out["auth_results"] = [str(v) for n in ("authentication-results", "arc-authentication-results") for v in m.get_all(n, [])]
        out["received_spf"] = [str(v) for v in m.get_all("received-spf", [])]
        out["msgid"] = str(m["message-id"]).strip() if m["message-id"] is not None else None
        texts, htmls = [], []
        for part in m.walk():
            if part.is_multipart() or part.get_content_disposition() == "attachment":
                continue
            kind = part.get_content_type()
            if kind in ("text/plain", "text/html"):
                try:
                    body = part.get_content()
                except (LookupError, ValueError):
                    body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
                (texts if kind == "text/plain" else htmls).append(body)
        out["text_bodies"], out["html_bodies"] = texts, htmls
    except Exception:  # noqa: BLE001 - whatever is wrong with a message, its text is used
        out = dict.fromkeys(FIELDS) | {"text_bodies": [bytes(raw[:MAX_BYTES]).decode("utf-8", "replace")]}
    return out


def parse_messages(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Structured messages of raw ones, with the columns of ``keep``."""
    kept = [f for f in df.schema.fields if f.name in keep]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame([parse_message(c or b"") for c in pdf["__content"]], columns=FIELDS)
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), rows], axis=1)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MESSAGE_DDL])
    return df.select(*keep, F.col(content).alias("__content")).mapInPandas(parse, ddl)
