"""Responses: JSON objects that hold their rows under the plural of a resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of result lists, in the order in which the first present one wins.
RESULT_KEYS = ("activities", "molecules", "targets", "assays", "compounds")


def result_key(json: Column, keys: tuple[str, ...] = RESULT_KEYS) -> Column:
    """The first of the keys that the object has, even with an empty list; null if none."""
    have = F.json_object_keys(json)
    return F.coalesce(*[F.when(F.array_contains(have, k), F.lit(k)) for k in keys])


def records(responses: DataFrame, json: str, element: str, keys: tuple[str, ...] = RESULT_KEYS) -> DataFrame:
    """responses' rows of the recognised list, one each: result_key and the element's fields (a DDL of them)."""
    parsed = F.from_json(F.col(json), ", ".join(f"{k} array<struct<{element}>>" for k in keys))
    listed = F.coalesce(*[F.when(F.col("result_key") == k, parsed[k]) for k in keys])
    return responses.withColumn("result_key", result_key(F.col(json), keys)).select("result_key", F.explode(listed).alias("r")).select("result_key", "r.*")
