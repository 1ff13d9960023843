"""A tag query as a Column."""

from __future__ import annotations

from pyspark.sql import Column

from annalog.functions.columns import any_of, has_tags, of_types
from annalog.values import TagQuery, TagsOnly, TypesAndTags


def item(query_item: TypesAndTags | TagsOnly) -> Column:
    tags = has_tags(query_item.tags)
    return of_types(query_item.types) & tags if isinstance(query_item, TypesAndTags) else tags


def compile_query(query: TagQuery) -> Column:
    """Items are joined by OR, so each fact is found at most once."""
    return any_of([item(i) for i in query.items])
