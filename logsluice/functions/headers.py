"""Header maps: normalising on read, dropping private and hop-by-hop names."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names removed as private, names the HTTP client sets itself,
# and what HTTP allows in a name and in a value.
PRIVATE_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization")
CLIENT_HEADERS = ("host", "content-length", "connection", "transfer-encoding", "keep-alive")
TOKEN = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+\z"
FIELD_VALUE = r"^[\x20-\x7E\t]*\z"

_EMPTY = "map<string,array<string>>"


def normalise_headers(raw: Column) -> Column:
    """``map<string,variant>`` to lower-cased names and lists of strings, in order.

    When names collide after lower-casing the last value wins and keeps the place
    of the first. Done on arrays, so it does not depend on the session's policy
    for repeated map keys.
    """
    names = F.transform(F.map_keys(raw), F.lower)
    values = F.transform(F.map_values(raw), _header_values)
    collides = F.size(F.array_distinct(names)) < F.size(raw)
    return F.when(collides, _last_wins(names, values)).otherwise(F.map_from_arrays(names, values))


def _last_wins(names: Column, values: Column) -> Column:
    newest_first = F.reverse(names)
    distinct = F.array_distinct(names)
    last = F.transform(
        distinct,
        lambda name: F.element_at(
            values, (F.size(names) - F.array_position(newest_first, name) + 1).cast("int")
        ),
    )
    return F.map_from_arrays(distinct, last)


def _header_values(value: Column) -> Column:
    """One JSON header value: a string, the strings of a list, or its JSON text."""
    kind = F.schema_of_variant(value)
    members = F.filter(value.try_cast("array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    # VARIANT forgets that a number like 1.0 was written with a fraction; its type does not.
    whole_fraction = kind.rlike(r"^DECIMAL\((?:\d|1[0-8]),0\)\z")
    return (
        F.when(kind == "STRING", F.array(value.try_cast("string")))
        .when(kind.startswith("ARRAY"), F.transform(members, lambda v: v.try_cast("string")))
        .when(whole_fraction, F.array(F.concat(F.to_json(value), F.lit(".0"))))
        .otherwise(F.array(F.to_json(value)))
    )


def remove_private_headers(headers: Column, passthrough: Collection[str] = ()) -> Column:
    """Drop private names, except those passed through; order is kept."""
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(_private(passthrough)))


def clean_headers(headers: Column, passthrough: Collection[str] = ()) -> Column:
    """Headers to send: no private names, none the client sets itself, no invalid ones.

    Passing a name through does not exempt it from the client's own list. Invalid
    values are dropped, as are headers left without a value; null becomes empty.
    """
    dropped = [*CLIENT_HEADERS, *_private(passthrough)]
    present = F.coalesce(headers, F.create_map().cast(_EMPTY))
    named = F.map_filter(
        present, lambda name, _: ~F.lower(name).isin(dropped) & name.rlike(TOKEN)
    )
    valued = F.transform_values(named, lambda _, vs: F.filter(vs, lambda v: v.rlike(FIELD_VALUE)))
    return F.map_filter(valued, lambda _, vs: F.size(vs) > 0)


def _private(passthrough: Collection[str]) -> list[str]:
    return [h for h in PRIVATE_HEADERS if h not in passthrough]
