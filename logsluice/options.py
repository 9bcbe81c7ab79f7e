"""Validated job options."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

MAX_STATUS = 65535


@dataclass(frozen=True)
class JobOptions:
    """What to read, which records to keep and how to rewrite them.

    Build it with :meth:`create`, which validates and normalises its arguments.
    ``extra_filters`` are further boolean Columns over the decoded record and
    ``extra_sanitizers`` are DataFrame steps applied to the sanitized requests.
    """

    base_url: str
    source_uri: str | None = None
    region: str | None = None
    methods: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    statuses: tuple[int, ...] = ()
    max_records: int | None = None
    passthrough: frozenset[str] = frozenset()
    extra_filters: tuple[Column, ...] = field(default=(), compare=False)
    extra_sanitizers: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=(), compare=False)

    @classmethod
    def create(
        cls,
        base_url: str,
        *,
        input_path: str | None = None,
        s3_bucket: str | None = None,
        s3_key: str | None = None,
        region: str | None = None,
        methods: Sequence[str] = (),
        path_prefixes: Sequence[str] = (),
        statuses: Sequence[int] = (),
        max_records: int | None = None,
        passthrough_keys: str | None = None,
        extra_filters: Sequence[Column] = (),
        extra_sanitizers: Sequence[Callable[[DataFrame], DataFrame]] = (),
    ) -> JobOptions:
        if not base_url:
            raise ValueError("base_url cannot be empty")
        if max_records is not None and max_records < 0:
            raise ValueError("max_records cannot be negative")
        for status in statuses:
            if not 0 <= status <= MAX_STATUS:
                raise ValueError(f"status {status} is outside 0..{MAX_STATUS}")
        return cls(
            base_url=base_url.rstrip("/"),
            source_uri=_source_uri(input_path, s3_bucket, s3_key),
            region=region,
            methods=tuple(m.upper() for m in methods),
            path_prefixes=tuple(path_prefixes),
            statuses=tuple(statuses),
            max_records=max_records,
            passthrough=parse_passthrough(passthrough_keys),
            extra_filters=tuple(extra_filters),
            extra_sanitizers=tuple(extra_sanitizers),
        )

    @property
    def has_filters(self) -> bool:
        return bool(self.methods or self.path_prefixes or self.statuses or self.extra_filters)

    def require_source(self) -> str:
        if self.source_uri is None:
            raise ValueError("give either input_path or both s3_bucket and s3_key")
        return self.source_uri


def parse_passthrough(keys: str | None) -> frozenset[str]:
    """Comma-separated key names, lower-cased; these are exempt from sanitizing."""
    return frozenset(k.strip().lower() for k in (keys or "").split(",") if k)


def _source_uri(path: str | None, bucket: str | None, key: str | None) -> str | None:
    if path is not None and bucket is None and key is None:
        return path
    if path is None and bucket is not None and key is not None:
        return f"s3a://{bucket}/{key}"
    if path is None and bucket is None and key is None:
        return None
    raise ValueError("input_path excludes s3_bucket and s3_key, which must be given together")
