"""Percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(text: Column | str) -> Column:
    """Percent-encode UTF-8 text; letters, digits, ``_ . - ~ /`` stay. Starts from Spark's form encoding."""
    out = F.url_encode(_col(text))
    for coded, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(wanted))
    return out


def unquote(text: Column | str) -> Column:
    """Percent-decode; ``+`` stays, and a ``%`` without two hex digits stays as it is."""
    plus_kept = F.replace(_col(text), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(plus_kept, "%(?![0-9A-Fa-f]{2})", "%25"))
