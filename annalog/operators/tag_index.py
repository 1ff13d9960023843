"""The tag index: a row for each (fact, tag), in the order of tags.

A file of it answers a tag's look-up by skipping row groups, which a map column can't:
a predicate on ``tags[k]`` reaches Parquet only as "tags is not null".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.functions.columns import any_of
from annalog.operators.reads import spread
from annalog.values import TagQuery, TypesAndTags


def entries(facts: DataFrame) -> DataFrame:
    """(tag_key, tag_value, type, position)."""
    return facts.select(F.explode("tags").alias("tag_key", "tag_value"), "type", "position").where("tag_value is not null")


def write(facts: DataFrame, path: str) -> None:
    """The index as Parquet in ranges of (key, value, position); a common tag may fill several files."""
    rows, columns = entries(facts), ("tag_key", "tag_value", "position")
    spread(rows, rows.count(), *columns).sortWithinPartitions(*columns).write.parquet(path)


def _wanted(tags: Mapping[str, str]):
    return any_of([(F.col("tag_key") == k) & (F.col("tag_value") == v) for k, v in sorted(tags.items())])


def positions(index: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Positions of facts that carry all of ``tags``: lists of positions, intersected."""
    hits = index.where(_wanted(tags))
    if len(tags) == 1:
        return hits.select("position")
    return hits.groupBy("position").agg(F.count("*").alias("n")).where(F.col("n") == len(tags)).select("position")


def query_positions(index: DataFrame, query: TagQuery) -> DataFrame:
    """Positions of facts that match any item, each once."""
    parts = []
    for item in query.items:
        part = index.where(F.col("type").isin(*sorted(item.types))) if isinstance(item, TypesAndTags) else index
        parts.append(positions(part, item.tags))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def lookup(facts: DataFrame, found: DataFrame) -> DataFrame:
    """The facts at ``found`` positions, in log order."""
    return facts.join(found, "position", "left_semi").orderBy("position")
