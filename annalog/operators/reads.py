"""Reads of a facts frame. Each is a plan; nothing runs here.

A facts frame has fact_id, type, subject, appended_at, tags and position, at least.
Direction comes before the limit: backward with a limit is the last ones, newest first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.functions.columns import has_tags, within
from annalog.plans.tag_query import compile_query
from annalog.values import Direction, TagQuery, TimeRange
from annalog.values import limit as valid_limit


#: Rows of a range, where Spark's own number of partitions would leave more to a task.
TASK_FACTS = 250_000


def spread(facts: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``facts``, ``rows`` of them, in ranges of some columns: as many as Spark makes, which may put small ones together, or one for ``TASK_FACTS``."""
    ranges = -(-rows // TASK_FACTS)
    few = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.repartitionByRange(ranges, *columns) if ranges > few else facts.repartitionByRange(*columns)


def _ordered(facts: DataFrame, keys: list[str], direction: Direction, limit: int | None) -> DataFrame:
    ordered = facts.orderBy(*[F.col(k).asc() if direction is Direction.FORWARD else F.col(k).desc() for k in keys])
    return ordered if valid_limit(limit) is None else ordered.limit(limit)


def in_log_order(facts: DataFrame, limit: int | None = None, direction: Direction = Direction.FORWARD) -> DataFrame:
    return _ordered(facts, ["position"], direction, limit)


def all_in_log_order(facts: DataFrame, rows: int) -> DataFrame:
    """As ``in_log_order``, of ``rows`` facts: the sort takes its ranges from ``spread``."""
    return in_log_order(spread(facts, rows, "position"))


def by_id(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.where(F.col("fact_id") == fact_id).limit(1)


def exists_by_id(facts: DataFrame, fact_id: str) -> DataFrame:
    """One row, one column: found."""
    return facts.where(F.col("fact_id") == fact_id).agg((F.count("*") > 0).alias("found"))


def by_subject(facts: DataFrame, subject: str, limit: int | None = None, direction: Direction = Direction.FORWARD) -> DataFrame:
    return _ordered(facts.where(F.col("subject") == subject), ["position"], direction, limit)


def in_time_range(facts: DataFrame, span: TimeRange, limit: int | None = None, direction: Direction = Direction.FORWARD) -> DataFrame:
    """Chronological: by time, then position."""
    return _ordered(facts.where(within(span.start, span.end)), ["appended_at", "position"], direction, limit)


def by_tags(facts: DataFrame, tags: Mapping[str, str], limit: int | None = None, direction: Direction = Direction.FORWARD) -> DataFrame:
    """Facts that carry all of ``tags``, which can't be empty."""
    if not tags:
        raise ValueError("tags can't be empty")
    return _ordered(facts.where(has_tags(tags)), ["position"], direction, limit)


def by_tag_query(facts: DataFrame, query: TagQuery) -> DataFrame:
    return _ordered(facts.where(compile_query(query)), ["position"], Direction.FORWARD, None)


def between(facts: DataFrame, after: int | None, head: int | None) -> DataFrame:
    """Facts after a position, which is left out, up to another, which isn't."""
    if after is not None:
        facts = facts.where(F.col("position") > after)
    if head is not None:
        facts = facts.where(F.col("position") <= head)
    return facts


def last_per_subject(facts: DataFrame) -> DataFrame:
    """(subject, fact_id, position) of each subject's last fact."""
    return facts.groupBy("subject").agg(F.max_by("fact_id", "position").alias("fact_id"), F.max("position").alias("position"))


def head(facts: DataFrame) -> DataFrame:
    """One row, one column: the last position."""
    return facts.agg(F.max("position").alias("head"))
