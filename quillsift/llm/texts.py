"""What the text operators share: comparable text and an even spread of documents."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame

from quillsift.shared import shuffle_width

_NO_WIDTH = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️]+")
_QUOTE_MARKS = regex.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")


def plain(text: str) -> str:
    """A text without quote marks at line starts and characters without width, in one width, composition and case."""
    text = text.replace("\r", "\n")
    if text.isascii():
        return (_QUOTE_MARKS.sub("", text) if ">" in text else text).lower()
    text = _NO_WIDTH.sub("", text)
    text = unicodedata.normalize("NFKC", _QUOTE_MARKS.sub("", text))
    return unicodedata.normalize("NFC", text.casefold())


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows where the source has too few files to keep all cores busy; many files are left alone."""
    width = shuffle_width(df.sparkSession)
    return df if len(df.inputFiles()) >= width else df.repartition(width)
