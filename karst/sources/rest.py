"""A web resource as a Spark data source: pages of JSON rows, filters sent along."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from karst.operators.fetch import Result
from karst.plans.compiler import DEFAULT_RESOURCE
from karst.sources.envelope import RESULT_KEYS

TIMEOUT_S = 30
#: Spark's pushed filters and the lookups that ask for the same.
SENT_AS = {EqualTo: "exact", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte", In: "in", StringContains: "contains", StringStartsWith: "startswith", StringEndsWith: "endswith", IsNull: "isnull", IsNotNull: "isnull"}


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PlainReader(DataSourceReader):
    """Options: url (of the resource), params (JSON object), page_size, key (of the list; else the first known one)."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.url = schema, options["url"]
        self.params = json.loads(options.get("params", "{}"))
        self.size, self.key = int(options.get("page_size", "1000")), options.get("key")

    def get(self, **more: object) -> dict:
        with urlopen(f"{self.url}?{urlencode(self.params | more, doseq=True)}", timeout=TIMEOUT_S) as response:
            return json.load(response)

    def rows_of(self, found: dict) -> list[dict]:
        for key in [self.key] if self.key else [*RESULT_KEYS, *(k for k, v in found.items() if isinstance(v, list))]:
            if key in found:
                return found[key]
        return []

    def partitions(self) -> list[InputPartition]:
        """One task a page, if the service tells its total; else one task follows the pages."""
        total = (self.get(limit=1, offset=0).get("page_meta") or {}).get("total_count")
        return [Page(0, -1)] if total is None else [Page(at, self.size) for at in range(0, int(total), self.size)]

    def read(self, partition: Page) -> Iterator[Row]:
        at = partition.offset
        while True:
            rows = self.rows_of(self.get(limit=self.size, offset=at))
            for r in rows:
                yield Row(*[r.get(f.name) for f in self.schema])
            at += len(rows)
            if partition.limit >= 0 or len(rows) < self.size:
                return


class PushingReader(PlainReader):
    """Sends what the service understands; Spark still applies every filter itself, so sending can only save."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            lookup = SENT_AS.get(type(f))
            if lookup:
                name = "__".join(f.attribute)
                value = {"isnull": str(isinstance(f, IsNull)).lower()}.get(lookup, getattr(f, "value", None))
                self.params[name if lookup == "exact" else f"{name}__{lookup}"] = ",".join(map(str, value)) if isinstance(value, tuple) else value
            yield f


class RestDataSource(DataSource):
    """spark.read.format("karst_rest").schema(...).options(url=..., ...).load(); pushdown=true needs the setting
    spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "karst_rest"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else PlainReader
        return kind(schema, dict(self.options))


def execute_query(spark: SparkSession, base_url: str, plan: dict, schema: T.StructType, page_size: int = 1000) -> Result:
    """A plan sent to a service: resource (activity unless named) in the address, the rest as parameters. A failed
    request is an error value. The plan isn't changed."""
    if not isinstance(plan, dict) or "error" in plan:
        return Result(error=str(plan["error"]) if isinstance(plan, dict) else "a plan is an object")
    params = {k: v for k, v in plan.items() if k != "resource"}
    options = {"url": f"{base_url}/{plan.get('resource', DEFAULT_RESOURCE)}.json", "params": json.dumps(params), "page_size": str(page_size)}
    try:
        PlainReader(schema, options).get(limit=1, offset=0)
    except (URLError, OSError, ValueError) as e:
        return Result(error=str(e))
    spark.dataSource.register(RestDataSource)
    found: DataFrame = spark.read.format("karst_rest").schema(schema).options(**options).load()
    return Result(found)
