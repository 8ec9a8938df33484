"""Prompt contexts: entities, related records and metadata rendered as Markdown or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section(title: str, lines: Column) -> Column:
    """A heading and its lines, or null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(lines, "\n")))


def fields(columns: list[str]) -> Column:
    """"- name: value" lines of the columns that aren't null."""
    return F.filter(F.array(*[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in columns]), lambda x: x.isNotNull())


def markdown(*sections: Column) -> Column:
    return F.concat_ws("\n\n", *sections)


def batch_markdown(items: DataFrame, context: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """(by..., context): the items' contexts in order, separated by rules."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), context.alias("c"))))
    return items.groupBy(*(by or [])).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "\n\n---\n\n").alias("context"))


def batch_json(items: DataFrame, columns: list[str], order: str, by: list[str] | None = None) -> DataFrame:
    """(by..., context): a JSON array of the items in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("i"))))
    return items.groupBy(*(by or [])).agg(F.to_json(F.transform(parts, lambda p: p["i"])).alias("context"))
