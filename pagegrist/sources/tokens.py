"""Addresses inside aggregator tokens: base64url payloads of length-delimited fields."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import urls as U

# Hosts and path marks of encoded links; bounds of a token.
HOSTS = ("news.google.com", "www.news.google.com")
MARKS = ("articles", "read")
MAX_TOKEN, MAX_DEPTH = 64_000, 4

_NUMBER = re.compile(rb"[\x80-\xff]{0,9}[\x00-\x7f]")
_PLAIN_ADDRESS = re.compile(rb"https?://[!-~]+")
_ADDRESS = re.compile(r"[\s\x00]*(https?://(?:[^/?#@]*@)?([^/?#:\s]+).*?)[\s\x00-\x03]*", re.I | re.S)


def is_encoded(u: Column) -> Column:
    parts = F.filter(F.split(U.path(u), "/"), lambda p: p != "")
    mark = F.lower(F.try_element_at(parts, F.lit(-2)))
    return F.regexp_replace(U.hostname(u), r"\.+$", "").isin(*HOSTS) & F.coalesce(mark.isin(*MARKS), F.lit(False))


def token(u: Column) -> Column:
    """The token of an encoded link; empty of others."""
    parts = F.filter(F.split(U.path(u), "/"), lambda p: p != "")
    return F.when(is_encoded(u), F.trim(F.try_url_decode(F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("+"), F.lit("%2B"))))).otherwise("")


def payloads(data: bytes) -> Iterator[bytes]:
    """The length-delimited fields of a message, each followed by those inside it; a span ends where the wire format breaks.

    Work is a stack of spans (from, to, nesting) that are still to be read.
    """
    work = [(0, len(data), 0)]
    while work:
        at, end, nesting = work.pop()
        key = _NUMBER.match(data, at, end)
        if not key:
            continue
        number = sum((b & 0x7F) << 7 * k for k, b in enumerate(key.group()))
        at, kind = key.end(), number & 7
        size = {1: 8, 5: 4}.get(kind)
        if number < 8 or kind in (3, 4, 6, 7):
            continue
        if size is None:
            value = _NUMBER.match(data, at, end)
            if not value:
                continue
            at = value.end()
            size = sum((b & 0x7F) << 7 * k for k, b in enumerate(value.group())) if kind == 2 else 0
        if at + size > end:
            continue
        work.append((at + size, end, nesting))
        if kind == 2:
            yield data[at : at + size]
            if size and nesting < MAX_DEPTH:
                work.append((at, at + size, nesting + 1))


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def addresses(encoded: str | None) -> list[str]:
    """The publishers' addresses that a token carries: those of its fields in order, then those that stand in it openly."""
    value = (encoded or "").strip()
    if not value or len(value) > MAX_TOKEN:
        return []
    try:
        data = base64.urlsafe_b64decode(value.encode("ascii") + b"=" * (-len(value) % 4))
    except (binascii.Error, UnicodeEncodeError):
        return []
    found = (_ADDRESS.fullmatch(_text(raw)) for raw in (*payloads(data), *_PLAIN_ADDRESS.findall(data)))
    return [m[1] for m in found if m and m[2].lower().rstrip(".") not in HOSTS]


@F.pandas_udf(ArrayType(StringType()))
def _addresses(encoded: pd.Series) -> pd.Series:
    return encoded.map(addresses)


def decoded(df: DataFrame, link: str, name: str) -> DataFrame:
    """Adds the publisher's address of an encoded link, one that isn't AMP before others; other links as they are.

    Only tokens go through Python, in Arrow batches.
    """
    u = F.col(link)
    found = F.when(is_encoded(u), _addresses(token(u)))
    out = df.withColumn("_found", found)
    own = F.filter("_found", lambda x: ~U.looks_amp(x))
    return out.withColumn(name, F.coalesce(F.get(own, F.lit(0)), F.get("_found", F.lit(0)), u)).drop("_found")
