"""Matching fixed words without regard to case."""

from __future__ import annotations

import re
from collections.abc import Iterable

REDACTED = "[REDACTED]"

_KELVIN = "\u212a"


def any_case(words: Iterable[str]) -> str:
    """Alternation that, under ``(?i)``, matches what lower-cases to one of ``words``.

    Java's ``(?i)`` folds ASCII only. The one other character that lower-cases to
    an ASCII letter is the Kelvin sign, which becomes ``k``.
    """
    return "|".join(re.escape(word).replace("k", f"[k{_KELVIN}]") for word in words)
