"""Value types, requests and outcomes of the store.

Anticipated outcomes are values: frozen dataclasses, never exceptions. A value that
can't exist (a blank type, an empty query, a limit of zero) is a ``ValueError``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import Enum

#: Fixed value: what a store's name may be.
STORE_NAME = re.compile(r"[A-Za-z](?:[A-Za-z0-9_-]{0,253}[A-Za-z0-9])?")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def store_name(name: str) -> str:
    """``name`` if it can name a store: 1 to 255 characters, a letter first, alphanumeric last."""
    _require(isinstance(name, str) and bool(STORE_NAME.fullmatch(name)), f"not a store name: {name!r}")
    return name


def limit(value: int | None) -> int | None:
    """``value`` if it can bound a read: positive, or None for all."""
    _require(value is None or (not isinstance(value, bool) and value > 0), f"a limit must be positive: {value!r}")
    return value


class Direction(Enum):
    """Order of a read: FORWARD is oldest first."""

    FORWARD = "forward"
    BACKWARD = "backward"

    @classmethod
    def parse(cls, text: str | None) -> Direction:
        """By name in any case; None is FORWARD."""
        if text is None:
            return cls.FORWARD
        try:
            return cls(text.strip().lower())
        except ValueError:
            raise ValueError(f"not a direction: {text!r}") from None


def utc(at: datetime | None) -> datetime | None:
    """An instant as facts keep it: UTC without a zone. One without a zone is taken as UTC."""
    return at.astimezone(UTC).replace(tzinfo=None) if at is not None and at.tzinfo else at


@dataclass(frozen=True)
class TimeRange:
    """Half-open: start is inside, end is not. A bound left out is open. Bounds may have zones, or none."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", utc(self.start))
        object.__setattr__(self, "end", utc(self.end))
        _require(self.start is None or self.end is None or self.start < self.end, "a time range must start before it ends")


@dataclass(frozen=True)
class Payload:
    """Opaque bytes with an optional format and an optional schema reference."""

    data: bytes = b""
    format: str | None = None
    schema_ref: str | None = None

    def __post_init__(self) -> None:
        _require(self.format is None or bool(self.format.strip()), "a payload format can't be blank")
        _require(self.schema_ref is None or bool(self.schema_ref.strip()), "a payload schema can't be blank")


def _text_map(values: Mapping[str, str], what: str) -> dict[str, str]:
    for k, v in values.items():
        _require(isinstance(k, str) and bool(k.strip()), f"a {what} key can't be blank")
        _require(isinstance(v, str), f"a {what} value must be text: {v!r}")
    return dict(values)


@dataclass(frozen=True)
class FactInput:
    """A fact as its producer states it; id, time and position are the store's to give."""

    type: str
    subject: str
    payload: Payload = field(default_factory=Payload)
    metadata: Mapping[str, str] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(bool(self.type.strip()), "a fact's type can't be blank")
        _require(bool(self.subject.strip()) and self.subject == self.subject.strip(), "a subject can't be blank or have space around it")
        object.__setattr__(self, "tags", _text_map(self.tags, "tag"))
        object.__setattr__(self, "metadata", {str(k): str(v) for k, v in self.metadata.items()})


# --- tag queries ---------------------------------------------------------------


@dataclass(frozen=True)
class TypesAndTags:
    """Facts of one of ``types`` that carry all of ``tags``; neither may be empty."""

    types: frozenset[str]
    tags: Mapping[str, str]

    def __init__(self, types: Sequence[str] | frozenset[str], tags: Mapping[str, str]) -> None:
        _require(bool(types) and bool(tags), "types and tags can't be empty")
        _require(all(t.strip() for t in types), "a type can't be blank")
        object.__setattr__(self, "types", frozenset(types))
        object.__setattr__(self, "tags", _text_map(tags, "tag"))


@dataclass(frozen=True)
class TagsOnly:
    """Facts that carry all of ``tags``, which can't be empty."""

    tags: Mapping[str, str]

    def __init__(self, tags: Mapping[str, str]) -> None:
        _require(bool(tags), "tags can't be empty")
        object.__setattr__(self, "tags", _text_map(tags, "tag"))


@dataclass(frozen=True)
class TagQuery:
    """Facts that match any item; a fact that matches several is found once."""

    items: tuple[TypesAndTags | TagsOnly, ...]

    def __init__(self, *items: TypesAndTags | TagsOnly) -> None:
        _require(bool(items), "a tag query needs an item")
        object.__setattr__(self, "items", tuple(items))


# --- where a stream starts ---------------------------------------------------------


@dataclass(frozen=True)
class Beginning:
    pass


@dataclass(frozen=True)
class End:
    """Only what comes next; on an empty store the same as Beginning."""


@dataclass(frozen=True)
class After:
    fact_id: str


# --- conditions of an append --------------------------------------------------------


@dataclass(frozen=True)
class NoCondition:
    pass


@dataclass(frozen=True)
class ExpectedLastFact:
    """The subject's last fact has this id; None: the subject has no fact."""

    subject: str
    fact_id: str | None = None


@dataclass(frozen=True)
class NoMatch:
    """No fact matches the query, or none after a cursor. An unknown cursor is a violation."""

    query: TagQuery
    after: str | None = None


@dataclass(frozen=True)
class AllOf:
    conditions: tuple[Condition, ...]

    def __init__(self, *conditions: Condition) -> None:
        _require(bool(conditions), "a conjunction needs a condition")
        object.__setattr__(self, "conditions", tuple(conditions))


Condition = NoCondition | ExpectedLastFact | NoMatch | AllOf


@dataclass(frozen=True)
class AppendRequest:
    """Facts to append as one, under a condition. A repeated key is applied once."""

    facts: tuple[FactInput, ...]
    condition: Condition = NoCondition()
    key: str = field(default_factory=lambda: str(uuid.uuid4()))

    def __post_init__(self) -> None:
        object.__setattr__(self, "facts", tuple(self.facts))
        object.__setattr__(self, "key", str(uuid.UUID(str(self.key))))


# --- outcomes ----------------------------------------------------------------------


@dataclass(frozen=True)
class StoreNotFound:
    name: str


@dataclass(frozen=True)
class Appended:
    """Ids in the order of the request, and the instant that all the facts share."""

    fact_ids: tuple[str, ...]
    appended_at: datetime


@dataclass(frozen=True)
class AlreadyApplied:
    pass


@dataclass(frozen=True)
class ConditionViolated:
    pass


@dataclass(frozen=True)
class Found:
    """What was found: a DataFrame of facts, or a store's description."""

    value: object


@dataclass(frozen=True)
class NotFound:
    pass


@dataclass(frozen=True)
class Exists:
    pass


@dataclass(frozen=True)
class DoesNotExist:
    pass


@dataclass(frozen=True)
class FactIdNotFound:
    fact_id: str


@dataclass(frozen=True)
class StoreInfo:
    store_id: str
    name: str
    created_at: datetime


@dataclass(frozen=True)
class StoreCreated:
    store: StoreInfo


@dataclass(frozen=True)
class StoreNameTaken:
    name: str


@dataclass(frozen=True)
class StoreRemoved:
    name: str
