"""Text functions: matching, names, headers, terminal codes, JSON checks."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Characters that compatibility normalisation leaves alone and whose case folding is lower case, but for the sharp s.
PLAIN = r"^[\x00-\x1B\x20-\x7F¡-§©«-®°±¶·»¿À-ÿ]*$"
EDGE_SPACE = " \t\n\r\x0b\x0c"


def normalize_value(value: str) -> str:
    """Compatibility form, outer white space off, case folded, U+0020 removed; other inner white space stays."""
    return unicodedata.normalize("NFKC", value).strip().casefold().replace(" ", "")


@F.pandas_udf(StringType())
def _normalize_any(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normalize_value(v))


def normalize(text: Column) -> Column:
    """normalize_value() of a column: natively for plain texts, and only the others go through Python."""
    plain = text.rlike(PLAIN)
    native = F.replace(F.replace(F.lower(F.btrim(text, F.lit(EDGE_SPACE))), F.lit("ß"), F.lit("ss")), F.lit(" "), F.lit(""))
    return F.when(plain, native).otherwise(_normalize_any(F.when(~plain, text)))


def is_match(text: Column, search: str) -> Column:
    """Whether the normalised search text occurs in the normalised text; an empty side never matches, a blank search
    matches every text that isn't empty. Null text doesn't match."""
    if search == "":
        return F.lit(False)
    return F.coalesce((text != "") & F.contains(normalize(text), F.lit(normalize_value(search))), F.lit(False))


def file_name(value: Column) -> Column:
    return F.element_at(F.split(value, "/"), -1)


def base_name(value: Column) -> Column:
    """Last path segment, trimmed, without its last extension."""
    return F.regexp_replace(F.btrim(file_name(value), F.lit(EDGE_SPACE)), r"\.[^/.]+$", "")


def extension(value: Column) -> Column:
    """What follows the last dot of the whole value, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(value, r"\.([^.]*)$", 1))


def strip_terminal_codes(text: Column) -> Column:
    """Without escape sequences: ESC, any of [ 0-9 ; and a letter."""
    return F.regexp_replace(text, "\x1b[\\[0-9;]*[a-zA-Z]", "")


def client_ip(forwarded: Column, ip: Column) -> Column:
    """First comma piece of the forwarded header as it stands, else the request's address, else empty."""
    return F.coalesce(F.nullif(F.get(F.split(forwarded, ","), F.lit(0)), F.lit("")), ip, F.lit(""))


def limiter_key(address: Column) -> Column:
    """What follows the last colon."""
    return F.element_at(F.split(address, ":"), -1)


def bearer_token(header: Column) -> Column:
    return F.when(F.startswith(header, F.lit("Bearer ")), F.substring(header, 8, 1 << 30)).otherwise("")


def strip_first(text: Column, part: str) -> Column:
    """Without the first occurrence of part."""
    at = F.instr(text, part)
    return F.when((at > 0) & F.lit(part != ""), F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(part), F.length(text)))).otherwise(text)


def host_and_port(url: Column) -> Column:
    return F.split(F.replace(url, F.lit("http://"), F.lit("")), ":")


def squeeze(text: Column) -> Column:
    """A parameter with runs of white space as one space and none outside."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def decode_uri(text: Column) -> Column:
    """Percent decoding that keeps plus signs."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _refuse(name: str):
    raise ValueError(name)


def is_json_value(value: str | None) -> bool:
    try:
        json.loads(value, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return False
    return True


@F.pandas_udf(BooleanType())
def is_json(values: pd.Series) -> pd.Series:
    """Whether a text is JSON: scalars are, repeated keys are, NaN and trailing commas are not. Null is not."""
    return values.map(is_json_value).astype(bool)


def unwrapped_base64(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def labelled_score(label: Column, score: Column) -> Column:
    return F.format_string("%s %.2f", label, score)
