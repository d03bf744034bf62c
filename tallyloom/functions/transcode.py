"""Lossy charset round trip, for showing text as a legacy system would."""
from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, functions as F


_SINGLE_BYTE = {"ascii": 0x7F, "iso8859-1": 0xFF}  # charsets whose characters are the first code points


def transcode_lossy(col: Column, encoding: str) -> Column:
    """Encode with replacement and decode again: unmappable characters become ``?``.

    ASCII and Latin-1 hold the first code points, so there a pattern does it. The JVM encoder raises on unmappable
    text and knows fewer of the legacy charsets: those go through an Arrow-batched UDF over whole values.
    """
    name = codecs.lookup(encoding).name  # an unknown charset fails here, not in a task
    if name in _SINGLE_BYTE:
        return F.regexp_replace(col, f"[^\\x00-\\x{_SINGLE_BYTE[name]:02x}]", "?")

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.encode(encoding, "replace").decode(encoding),
                     na_action="ignore")

    return convert(col)
