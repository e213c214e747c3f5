"""Columns of open payloads: JSON text whose shape differs from row to row, kept as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(text: Column) -> Column:
    """The variant of a JSON text; NULL if it is none."""
    return F.try_parse_json(text)


def first_of(value: Column, kind: str, *paths: str) -> Column:
    """The first of these paths that leads to something of this type; a text that reads like it counts."""
    return F.coalesce(*[F.try_variant_get(value, path, kind) for path in paths])


def shape(value: Column) -> Column:
    """The schema of one payload, as text."""
    return F.schema_of_variant(value)


def common_shape(value: Column) -> Column:
    """Aggregate: the schema that all payloads of a group fit; VARIANT where they disagree."""
    return F.schema_of_variant_agg(value)
