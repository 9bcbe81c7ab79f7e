"""Request bodies: JSON redaction and strict base64.

JSON bodies take one of two exact routes. Nearly all are rewritten inside the
JVM: Spark's VARIANT prints them compact with sorted keys, and in that form a
private key with a scalar value can be found and replaced by one regex. Bodies
that need a walk over the tree (a private key holding a list or object, repeated
keys, numbers VARIANT prints differently) go through an Arrow UDF, to which all
other rows send only a null.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Collection
from json.decoder import scanstring

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.words import REDACTED, any_case

# Send the UDF's helpers along with it: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Object keys whose value is redacted, the content type that marks
# JSON and the encoding that marks base64.
PRIVATE_KEYS = (
    "password",
    "token",
    "authorization",
    "email",
    "phone",
    "ssn",
    "secret",
    "session",
    "cookie",
    "api_key",
)
JSON_TYPE = "application/json"
BASE64 = "base64"

# Standard alphabet, padding required, unused bits zero.
_BASE64_TEXT = (
    r"^(?:[A-Za-z0-9+/]{4})*+"
    r"(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\z"
)

# JSON whose compact text VARIANT and a float-based printer may render differently: -0, exponents,
# zero fractions, integers that may exceed 64 bits, tiny or very long numbers; control and surrogate
# escapes; keys with characters beyond U+FFFF, which VARIANT sorts by UTF-16 units.
_ODD_NUMBER = (
    r"[:\[,\s]-?+(?=\d)"
    r"(?:(?<=-)0(?![.\d])|\d{20}|\d++(?:\.\d++)?[eE]|\d++\.0++(?!\d)|0\.00000|(?=\d++\.)[\d.]{17})"
)
_HIGH_KEY = r'[\x{10000}-\x{10FFFF}][^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:'
_ODD_ESCAPE = r"\\u(?:00[01]|[dD][89a-fA-F])"

_LONE_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SCALAR = r'[^"\[\]{},]++'


def is_json_type(content_type: Column) -> Column:
    """The content type names JSON; the test is case-sensitive."""
    return F.coalesce(F.contains(content_type, F.lit(JSON_TYPE)), F.lit(False))


def is_base64(body_encoding: Column) -> Column:
    return F.coalesce(body_encoding == BASE64, F.lit(False))


def valid_base64(body: Column) -> Column:
    return body.rlike(_BASE64_TEXT)


def decode_base64(body: Column) -> Column:
    """Bytes of strictly valid base64, else null."""
    return F.when(valid_base64(body), F.unbase64(body))


def guarded_json(text: Column) -> Column:
    """Parse ``text`` in an array before its own hash, so that trailing junk shows."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), _text_hash(text), F.lit('"]')))


def canonical_json(parsed: Column, text: Column) -> Column:
    """Compact JSON with sorted keys; null when not one JSON value or a key repeats.

    ``parsed`` is :func:`guarded_json` of ``text``, best held in a column: it is
    used three times here.
    """
    whole = F.variant_get(parsed, "$[2]", "variant").isNull() & (
        F.try_variant_get(parsed, "$[1]", "string") == _text_hash(text)
    )
    return F.when(whole, F.to_json(F.variant_get(parsed, "$[0]", "variant")))


def _text_hash(text: Column) -> Column:
    return F.hex(F.xxhash64(text))


def prints_alike(text: Column) -> Column:
    """VARIANT prints these numbers, escapes and keys as they must come out."""
    spaced = F.concat(F.lit(" "), text)
    # What looks like such a number may stand in a string; only then strings are taken out.
    odd_number = spaced.rlike(_ODD_NUMBER) & F.regexp_replace(spaced, _STRING, '""').rlike(_ODD_NUMBER)
    odd_escape = F.contains(text, F.lit("\\u")) & text.rlike(_ODD_ESCAPE)
    return ~(odd_number | odd_escape | text.rlike(_HIGH_KEY))


def needs_tree(canonical: Column, passthrough: Collection[str] = ()) -> Column:
    """A list or object sits under a private key, or under a key passed through."""
    found = F.lit(False)
    private = _private_keys(passthrough)
    if private:
        found = found | canonical.rlike(rf'(?i){_key(private)}[\[{{]')
    if passthrough:
        exempt = "|".join(re.escape(json.dumps(k, ensure_ascii=False)[1:-1]) for k in sorted(passthrough))
        found = found | F.lower(canonical).rlike(rf'"(?:{exempt})":[\[{{]')
    return found


def redact_scalars(canonical: Column, passthrough: Collection[str] = ()) -> Column:
    """Replace scalar values of private keys in canonical JSON.

    In canonical form a quote after ``{`` or ``,`` that is followed by a word, a
    quote and a colon can only open a key: quotes inside strings are escaped.
    """
    private = _private_keys(passthrough)
    if not private:
        return canonical
    pattern = rf"(?i)({_key(private)})(?:{_STRING}|{_SCALAR})"
    return F.regexp_replace(canonical, pattern, f'$1"{REDACTED}"')


def redact_bodies(
    df: DataFrame,
    passthrough: Collection[str] = (),
    body: str = "body",
    content_type: str = "content_type",
) -> DataFrame:
    """Add ``body_redacted`` and ``body_unparsed`` to ``df``.

    Bodies of another content type stay as they are. So do JSON bodies that do not
    parse; these are flagged, because private values in them stay readable.
    """
    text = F.col(body)
    is_json = is_json_type(F.col(content_type)) & text.isNotNull()
    printable = F.when(is_json & prints_alike(text), text)
    canonical = F.col("_canonical")
    flat = F.when(~needs_tree(canonical, passthrough), redact_scalars(canonical, passthrough))
    walk = tree_redactor(passthrough)
    # Rows cross to Python whole, so each carries its body once: in _done or in _left.
    return (
        df.withColumn("_json", printable)
        .withColumn("_parsed", guarded_json(F.col("_json")))
        .withColumn("_canonical", canonical_json(F.col("_parsed"), F.col("_json")))
        .withColumn("_done", F.when(is_json, flat).otherwise(text))
        .withColumn("_left", F.when(is_json & F.col("_done").isNull(), text))
        .withColumn("_tree", walk(F.col("_left")))
        .withColumn("body_redacted", F.coalesce("_done", "_tree", "_left"))
        .withColumn("body_unparsed", F.col("_left").isNotNull() & F.col("_tree").isNull())
        .drop("_json", "_parsed", "_canonical", "_done", "_left", "_tree")
    )


def tree_redactor(passthrough: Collection[str] = ()):
    """Arrow UDF that parses, redacts and prints JSON texts; null for bad JSON."""
    exempt = frozenset(passthrough)
    private = frozenset(PRIVATE_KEYS)

    @F.arrow_udf("string")
    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([_redact_text(t, private, exempt) for t in texts.to_pylist()], pa.string())

    return walk


def _key(names: list[str]) -> str:
    """Regex for one of ``names`` as a key; starts with a fixed character to scan fast."""
    return rf'"(?<=[{{,]")(?:{any_case(names)})":'


def _private_keys(passthrough: Collection[str]) -> list[str]:
    return [k for k in PRIVATE_KEYS if k not in passthrough]


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([\[{\]},:])|(")|(-?(?:0|[1-9][0-9]*)((?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?))|(true|false|null))'
)
_END = re.compile(r"[ \t\n\r]*\Z")


class _Level:
    """An open list or object: printed members, and which keys are private or exempt in it."""

    __slots__ = ("is_object", "members", "key", "private", "hidden")

    def __init__(self, is_object: bool, private: frozenset[str], hidden: bool):
        self.is_object, self.private, self.hidden = is_object, private, hidden
        self.members = {} if is_object else []
        self.key = None


def _redact_text(text: str | None, private: frozenset[str], exempt: frozenset[str]) -> str | None:
    """Compact text with sorted keys and private values replaced; null for bad JSON.

    Open lists and objects are on a stack of their own, so nesting has no limit. No key is
    private below an exempt one; nothing is printed below a private one.
    """
    if text is None:
        return None
    try:
        return _joined(_walked(text, private, exempt))
    except ValueError:
        return None


def _walked(text: str, private: frozenset[str], exempt: frozenset[str]) -> list | str:
    surrogates = _LONE_SURROGATE.search(text) is not None

    def string(start: int) -> tuple[str, int]:
        value, end = scanstring(text, start, True)
        if surrogates:
            value.encode("utf-8")
        return value, end

    levels: list[_Level] = []
    top = _Level(False, private, False)
    here, at, may_end, wants_comma = top, 0, False, False
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError("not JSON")
        at = token.end()
        sign = token[1]
        if sign in ("]", "}") and (may_end or wants_comma) and levels and here.is_object == (sign == "}"):
            closed, here = here, levels.pop()
            _add(here, _printed(closed), private=here.private, exempt=exempt)
        elif wants_comma:
            if sign != ",":
                raise ValueError("a comma is missing")
            wants_comma = may_end = False
            continue
        else:
            if here.is_object:
                if token[2] is None:
                    raise ValueError("a key is missing")
                here.key, at = string(at)
                colon = _TOKEN.match(text, at)
                if colon is None or colon[1] != ":":
                    raise ValueError("a colon is missing")
                token = _TOKEN.match(text, colon.end())
                if token is None:
                    raise ValueError("a value is missing")
                at, sign = token.end(), token[1]
            if sign in ("[", "{"):
                name = here.key.lower() if here.is_object else None
                inner = frozenset() if name in exempt else here.private
                hidden = here.hidden or (name not in exempt and name in here.private)
                levels.append(here)
                here, may_end = _Level(sign == "{", inner, hidden), True
                continue
            if sign is not None:
                raise ValueError("a value is missing")
            if token[2]:
                value, at = string(at)
                printed = json.dumps(value, ensure_ascii=False)
            elif token[5]:
                printed = token[5]
            else:
                number = _finite(token[3]) if token[4] else _number(token[3])
                printed = _float_text(number) if isinstance(number, float) else str(number)
            _add(here, printed, private=here.private, exempt=exempt)
        wants_comma, may_end = True, False
        if not levels:
            if here is not top or _END.match(text, at) is None:
                raise ValueError("something follows")
            return top.members[0]


def _add(level: _Level, printed: list | str, private: frozenset[str], exempt: frozenset[str]) -> None:
    if not level.is_object:
        level.members.append("" if level.hidden else printed)
        return
    name = level.key.lower()
    hide = name in private and name not in exempt
    level.members[level.key] = f'"{REDACTED}"' if hide else "" if level.hidden else printed


def _printed(level: _Level) -> list:
    """Nested lists of text, so that deep levels are not copied again and again."""
    if level.hidden:
        return []
    if not level.is_object:
        return ["[", [x for m in level.members for x in (",", m)][1:], "]"]
    pairs = [x for k in sorted(level.members) for x in (",", json.dumps(k, ensure_ascii=False), ":", level.members[k])]
    return ["{", pairs[1:], "}"]


def _joined(parts: list | str) -> str:
    found, waiting = [], [parts]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            found.append(part)
        else:
            waiting.extend(reversed(part))
    return "".join(found)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def _number(digits: str) -> int | float:
    """Integers of 64 bits stay integers; larger ones and -0 are floats."""
    if len(digits) < 19 and digits != "-0":
        return int(digits)
    if len(digits) > 20:
        return _finite(digits)
    value = int(digits)
    return value if -(2**63) <= value < 2**64 and digits != "-0" else _finite(digits)


def _float_text(value: float) -> str:
    """Shortest decimal text: plain from 1e-5 up to 1e16, else with an exponent."""
    text = repr(value)
    if "e" not in text:
        return text
    mantissa, exponent = text.split("e")
    if int(exponent) == -5:
        sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        return f"{sign}0.0000{digits.replace('.', '')}"
    return f"{mantissa}e{int(exponent)}"
