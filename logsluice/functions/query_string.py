"""Query strings and request URLs."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsluice.functions.words import REDACTED, any_case

# Parameter names whose value is redacted.
PRIVATE_PARAMETERS = ("email", "phone", "token", "session", "ssn", "password", "auth", "key")


def redact_query(query: Column, passthrough: Collection[str] = ()) -> Column:
    """Replace the value of private parameters, keeping everything else as written.

    Parameters are separated by ``&``, end their name at the first ``=`` and may
    follow one leading ``?``. One regex pass, so it stays in generated code.
    """
    names = [p for p in PRIVATE_PARAMETERS if p not in passthrough]
    if not names:
        return query
    pattern = rf"(?i)(^\??|&)({any_case(names)})(?:=[^&]*+)?(?=&|\z)"
    return F.regexp_replace(query, pattern, f"$1$2={REDACTED}")


def request_url(base_url: str, path: Column, query: Column) -> Column:
    """``base_url``, path and query joined; a missing ``?`` is added, slashes are not."""
    suffix = (
        F.when(F.coalesce(query, F.lit("")) == "", F.lit(""))
        .when(query.startswith("?"), query)
        .otherwise(F.concat(F.lit("?"), query))
    )
    return F.concat(F.lit(base_url), path, suffix)
