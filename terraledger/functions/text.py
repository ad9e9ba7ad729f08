"""Text functions: comparison forms, canonical JSON, redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .overlap import decomposed

# Query parameters whose values are secrets.
SECRET_PARAMETERS = ("token", "key", "api_key", "access_token", "client_secret", "password", "auth", "signature", "sig")


def normalized(text: Column, ascii_only: bool = False) -> Column:
    """Lower case, decomposed, every run of other than a-z and 0-9 one space, trimmed; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(low if ascii_only else decomposed(low), "[^a-z0-9]+", " "))


def words(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; null if a side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def plain(json_text: Column) -> Column:
    """The text of a JSON value: a string's content, anything else as written."""
    return F.get(F.from_json(F.concat(F.lit("["), json_text, F.lit("]")), "array<string>"), 0)


def quoted(text: Column) -> Column:
    """A string as a JSON value."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1))


def value_type(json_text: Column) -> Column:
    """string, number, boolean, array, object or null."""
    c = F.substring(F.ltrim(json_text), 1, 1)
    return F.when(c == '"', "string").when(c == "[", "array").when(c == "{", "object").when(c == "n", "null").when(c.isin("t", "f"), "boolean").otherwise("number")


def _secrets(stop: str) -> str:
    """The secret parameters of a URL, their values up to one of the characters in stop."""
    return rf"(?i)([?&](?:{'|'.join(SECRET_PARAMETERS)})=)[^{stop}]*"


#: What is taken out of messages, as (pattern, what stays before, what stands for it), in the syntax that Python and Java share.
_IN_MESSAGES = ((r"(?i)\bBearer\s+[-\w.~+/=]+", 0, "Bearer REDACTED"), (r"(?i)(https?://)[^/@\s]+@", 1, ""), (_secrets(r"&\s"), 1, "REDACTED"))


def redact_url(url: Column) -> Column:
    """Without user and password, secret parameters replaced."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(u, _secrets("&#"), "$1REDACTED")


def _cut(longest: int) -> int:
    return max(80, longest)


def safe_message(text: Column, longest: int = 500) -> Column:
    """An error message without secrets, cut to length."""
    out = F.coalesce(text, F.lit(""))
    for pattern, group, instead in _IN_MESSAGES:
        out = F.regexp_replace(out, pattern, (f"${group}" if group else "") + instead)
    return F.substring(out, 1, _cut(longest))


def safe_text(text: str, longest: int = 500) -> str:
    """safe_message() of a text on the driver."""
    for pattern, group, instead in _IN_MESSAGES:
        text = re.sub(pattern, lambda m, g=group, i=instead: (m.group(g) if g else "") + i, text)
    return text[: _cut(longest)]


def _numbers(v):
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return int(v)
    if isinstance(v, list):
        return [_numbers(x) for x in v]
    if isinstance(v, dict):
        return {k: _numbers(x) for k, x in v.items()}
    return v


def canonical(value) -> str:
    """Compact JSON with sorted keys; whole numbers without a fraction."""
    return json.dumps(_numbers(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(json_text: Column) -> Column:
    """canonical() of JSON texts. Scalars pass by natively: only numbers with a fraction, arrays and objects need the Arrow function."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else canonical(json.loads(t)))

    scalar = json_text.rlike(r'^("[^"\\]*"|-?\d{1,15}|true|false|null)$')
    return F.when(scalar, json_text).otherwise(f(F.when(~scalar, json_text)))


def sha(*cols: Column) -> Column:
    """SHA-256 of the JSON array of the columns, so that no two lists of values share a text."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])), 256)
