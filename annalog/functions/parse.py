"""Arguments from text: tags, instants, ids and limits."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime, timedelta

#: Named spans of time before now.
PRESETS = {"5m": timedelta(minutes=5), "15m": timedelta(minutes=15), "1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(hours=24)}
_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


DEFAULT_LIMIT = 100


def tag(text: str, trim: bool = True) -> tuple[str, str]:
    """``key=value``, split at the first ``=``; the key is not blank, and trimmed unless told otherwise."""
    key, sign, value = text.partition("=")
    if not sign or not key.strip():
        raise ValueError(f"not key=value: {text!r}")
    return key.strip() if trim else key, value


def tags(texts: list[str], trim: bool = True) -> dict[str, str]:
    """Tags by key; of a repeated key the last one counts."""
    return dict(tag(t, trim) for t in texts)


def instant(text: str, now: datetime | None = None) -> datetime:
    """So many minutes, hours or days ago (``15m``, ``6h``, ``2d``), or ISO-8601: with a zone, or in UTC."""
    if m := re.fullmatch(r"(\d+)([mhd])", text.strip()):
        return (now or datetime.now(UTC)) - timedelta(**{_UNITS[m[2]]: int(m[1])})
    try:
        at = datetime.fromisoformat(text.strip())
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    except ValueError:
        raise ValueError(f"neither a span of time nor ISO-8601: {text!r}") from None


def fact_id(text: str) -> str:
    """A UUID in its usual form."""
    try:
        return str(uuid.UUID(text))
    except (ValueError, AttributeError, TypeError):
        raise ValueError(f"not a fact id: {text!r}") from None


def lenient_limit(value: int | None) -> int | None:
    """A bound from a query string: absent, zero and negative mean all."""
    return value if value is not None and value > 0 else None


def command_limit(value: int | None) -> int:
    """A bound from a command line: DEFAULT_LIMIT where absent, else positive."""
    if value is not None and value <= 0:
        raise ValueError(f"a limit must be positive: {value!r}")
    return DEFAULT_LIMIT if value is None else value


def seconds_and_nanos(at: datetime) -> tuple[int, int]:
    """An instant as whole seconds of the epoch and nanoseconds."""
    whole = at if at.tzinfo else at.replace(tzinfo=UTC)
    micros = (whole - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return micros // 1_000_000, micros % 1_000_000 * 1000


def from_seconds_and_nanos(seconds: int, nanos: int) -> datetime:
    """The instant, to the microsecond."""
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds, microseconds=nanos // 1000)
