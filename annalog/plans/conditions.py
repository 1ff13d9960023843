"""Conditions of an append, held against a snapshot of facts.

The tree is walked on the driver. A leaf looks at the recent facts in memory first, and
asks Spark only about the others: the last fact of one subject, the position of an id, or
whether any fact matches. ``Scan`` answers from a facts frame; a compacted log answers
from its side tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.plans.tag_query import compile_query
from annalog.values import AllOf, Condition, ExpectedLastFact, NoCondition, NoMatch, TagQuery, TagsOnly


def last_fact(facts: DataFrame, subject: str) -> str | None:
    """The id of a subject's last fact."""
    return facts.where(F.col("subject") == subject).agg(F.max_by("fact_id", "position")).first()[0]


def position_of(facts: DataFrame, fact_id: str) -> int | None:
    row = facts.where(F.col("fact_id") == fact_id).select("position").first()
    return row[0] if row else None


def conflicting(facts: DataFrame, query: TagQuery, after: int | None = None) -> DataFrame:
    """The facts that match, after a position if one is given."""
    return (facts if after is None else facts.where(F.col("position") > after)).where(compile_query(query))


class Scan:
    """What conditions ask of a facts frame."""

    def __init__(self, facts: DataFrame) -> None:
        self.facts = facts

    def last_fact(self, subject: str) -> str | None:
        return last_fact(self.facts, subject)

    def position_of(self, fact_id: str) -> int | None:
        return position_of(self.facts, fact_id)

    def matches_after(self, query: TagQuery, after: int | None) -> bool:
        return not conflicting(self.facts, query, after).isEmpty()


def matches(query: TagQuery, kind: str, tags: dict[str, str]) -> bool:
    """Whether a fact of this type with these tags matches; what ``compile_query`` says in Spark."""
    return any(all(tags.get(k) == v for k, v in i.tags.items()) and (isinstance(i, TagsOnly) or kind in i.types) for i in query.items)


def holds(condition: Condition, base, tail: Sequence = ()) -> bool:
    """Whether ``condition`` holds of ``base`` (as ``Scan``; None: there is none) and then ``tail``, oldest first."""
    match condition:
        case NoCondition():
            return True
        case ExpectedLastFact(subject, fact_id):
            recent = next((f.fact_id for f in reversed(tail) if f.subject == subject), None)
            return (recent or (base.last_fact(subject) if base is not None else None)) == fact_id
        case NoMatch(query, after):
            cursor = next((f.position for f in tail if f.fact_id == after), None) if after is not None else None
            if any((cursor is None or f.position > cursor) and matches(query, f.type, f.tags) for f in tail):
                return False
            if after is not None and cursor is not None:
                return True  # all of base is before the cursor
            if base is None:
                return after is None
            if after is not None and (cursor := base.position_of(after)) is None:
                return False
            return not base.matches_after(query, cursor)
        case AllOf(conditions):
            return all(holds(c, base, tail) for c in conditions)
    raise TypeError(f"not a condition: {condition!r}")
