"""Strict decoding of one JSON request record per line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 code points with the Unicode White_Space property (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Spark reads JSON more loosely than the JSON grammar unless told otherwise, and refuses strings
# over 20 million characters.
STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxStringLen": str(2**31 - 1),
}

TEXT_FIELDS = ("timestamp", "method", "path", "query", "body", "body_encoding", "content_type")

_RAW_RECORD = (
    "array<struct<"
    + ",".join(f"{name}:variant" for name in TEXT_FIELDS)
    + ",headers:map<string,variant>,status:variant>>"
)


# A member of that name or an escaped one; VARIANT keeps no sign of zero.
_MINUS_ZERO_STATUS = r'"(?:status|[^"]*\\u00[^"]*)"\s*:\s*-0\s*[,}]'


def trim_white_space(text: Column) -> Column:
    """Trim Unicode white space; text that is already ``{...}`` skips the search."""
    bare = text.startswith("{") & text.endswith("}")
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def guarded_parse(text: Column) -> Column:
    """Parse ``text`` between array brackets, before an object holding its hash.

    Spark's JSON parser stops after the first value and ignores what follows. Only
    text that is one complete value leaves that object as second and last element;
    see :func:`is_whole`.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(',{"method":"'), _text_hash(text), F.lit('"}]'))
    return F.from_json(wrapped, _RAW_RECORD, STRICT_JSON)


def is_whole(items: Column, text: Column) -> Column:
    """The text of :func:`guarded_parse` was one JSON object and nothing else."""
    guard = F.get(items, F.lit(1))["method"].try_cast("string")
    one_object = (F.size(items) == 2) & F.get(items, F.lit(0)).isNotNull()
    return F.coalesce(one_object & (guard == _text_hash(text)), F.lit(False))


def _text_hash(text: Column) -> Column:
    return F.hex(F.xxhash64(text))


def _variant_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text_or_null(value: Column) -> Column:
    return F.coalesce(_variant_type(value).isin("STRING", "VOID"), F.lit(True))


def is_text(value: Column) -> Column:
    return F.coalesce(_variant_type(value) == "STRING", F.lit(False))


def text_value(value: Column) -> Column:
    return value.try_cast("string")


def is_status_or_null(value: Column, text: Column) -> Column:
    """Integer literal in 0..65535; quoted, fractional or out-of-range values and -0 fail."""
    kind = _variant_type(value)
    number = value.try_cast("bigint")
    minus_zero = (number == 0) & text.rlike(_MINUS_ZERO_STATUS)
    in_range = F.when(kind == "BIGINT", number.between(0, 65535) & ~minus_zero).otherwise(kind == "VOID")
    return F.coalesce(in_range, F.lit(True))


def status_value(value: Column) -> Column:
    return value.try_cast("int")


def headers_well_formed(raw_headers: Column, text: Column) -> Column:
    """False when the line has a ``headers`` member that is not an object.

    ``from_json`` turns such a member into null, as it does an absent one; only
    lines that came out null and may hold the name, as it is or escaped, are looked
    at again.
    """
    may_name = F.contains(text, F.lit('"headers"')) | F.contains(text, F.lit("\\u"))
    shown = F.get_json_object(text, "$.headers")
    return raw_headers.isNotNull() | ~may_name | shown.isNull()


def utc_timestamp(name: str) -> Column:
    """The time of a text, in UTC where it names no zone, whatever the session's zone; else null.

    A time without a date is none: Spark would take it for one of today.
    """
    text = F.when(F.col(name).rlike(r"^\s*[+-]?\d{4}"), F.col(name))
    forms = (F.concat(text, F.lit("Z")), F.concat(text, F.lit("T00:00:00Z")), text)
    return F.coalesce(*(F.try_to_timestamp(form) for form in forms))
