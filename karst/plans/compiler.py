"""Query plans (flat dictionaries of lookups) to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions import chem
from karst.functions.lookups import CHEMICAL, LOOKUPS, LookupError_
from karst.plans.catalog import Catalog

DEFAULT_RESOURCE = "activity"
#: Keys of a plan that aren't filters.
CONTROLS = ("resource", "only", "order_by", "limit", "offset")


class PlanError(ValueError):
    """A plan that can't be run, and why."""


def split_key(key: str, schema: T.StructType, aliases: Mapping[str, str]) -> tuple[list[str], str]:
    """`a__b__lookup` to (['a', 'b'], 'lookup'). A last part that is a field of its parent is a field, even if a
    lookup has its name; without a lookup it is exact."""
    parts = key.split("__")
    parts[0] = aliases.get(parts[0], parts[0])
    path: list[str] = []
    level: T.DataType = schema
    for i, part in enumerate(parts):
        while isinstance(level, T.ArrayType):
            level = level.elementType
        if isinstance(level, T.StructType) and part in level.names:
            path.append(part)
            level = level[part].dataType
        elif path and i == len(parts) - 1 and (part in LOOKUPS or part == CHEMICAL):
            return path, part
        else:
            raise PlanError(f"unknown field or lookup {part!r} in {key!r}")
    return path, "exact"


def condition(df: DataFrame, filters: Mapping[str, Any], aliases: Mapping[str, str] | None = None, toolkit: chem.ChemToolkit | None = None) -> Column:
    """All filters of one call, joined by AND. Conditions on one to-many field hold for the same element; those of
    separate calls may hold for different elements. connectivity needs a chemistry toolkit."""
    singles: list[Column] = []
    of_array: dict[tuple[str, ...], list[tuple[list[str], T.DataType, str, Any]]] = {}
    for key, value in filters.items():
        path, lookup = split_key(key, df.schema, aliases or {})
        if lookup == CHEMICAL:
            singles.append(_connected(df, path, value, toolkit))
            continue
        level: T.DataType = df.schema
        array: tuple[str, ...] = ()
        for i, part in enumerate(path):
            level = level[part].dataType
            if isinstance(level, T.ArrayType) and not array and not (lookup == "isnull" and i == len(path) - 1):
                array = tuple(path[: i + 1])
                level = level.elementType
            elif isinstance(level, T.ArrayType) and i < len(path) - 1:
                raise PlanError(f"{key!r} passes two to-many fields")
        try:
            if array:
                of_array.setdefault(array, []).append((path[len(array) :], level, lookup, value))
            else:
                singles.append(LOOKUPS[lookup](F.col(".".join(f"`{p}`" for p in path)), value, level))
        except LookupError_ as e:
            raise PlanError(f"{key!r}: {e}") from e
    for array, tests in of_array.items():
        try:
            singles.append(F.exists(F.col(".".join(f"`{p}`" for p in array)), _of_element(tests)))
        except LookupError_ as e:
            raise PlanError(f"{'__'.join(array)!r}: {e}") from e
    return reduce(lambda a, b: a & b, singles) if singles else F.lit(True)


def _connected(df: DataFrame, path: list[str], value: Any, toolkit: chem.ChemToolkit | None) -> Column:
    """Structures with the connectivity key of the given one; null structures have none."""
    if toolkit is None:
        raise PlanError("connectivity needs a chemistry toolkit; see karst.functions.chem")
    level: T.DataType = df.schema
    for part in path:
        level = level[part].dataType if isinstance(level, T.StructType) else level
    if not isinstance(level, T.StringType) or not isinstance(value, str):
        raise PlanError("connectivity compares structures, which are text")
    return chem.apply(toolkit, "connectivity_key", F.col(".".join(f"`{p}`" for p in path))) == F.lit(toolkit.connectivity_key(value))


def _of_element(tests: list[tuple[list[str], T.DataType, str, Any]]) -> Callable[[Column], Column]:
    """All tests on one element of an array."""

    def holds(x: Column) -> Column:
        return reduce(lambda a, b: a & b, (LOOKUPS[lookup](reduce(lambda c, p: c[p], rest, x), value, kind) for rest, kind, lookup, value in tests))

    return holds


def roots(fields: str | list[str] | tuple[str, ...], df: DataFrame, aliases: Mapping[str, str] | None = None) -> list[str]:
    """Fields to show: nested ones stand for their root, each once, in the order given."""
    named = [fields] if isinstance(fields, str) else list(fields)
    out = list(dict.fromkeys((aliases or {}).get(f.split("__")[0], f.split("__")[0]) for f in named))
    unknown = [f for f in out if f not in df.columns]
    if unknown or not out:
        raise PlanError(f"unknown fields {unknown}" if unknown else "no fields")
    return out


def ordering(fields: tuple[str, ...] | list[str], df: DataFrame, key: tuple[str, ...], aliases: Mapping[str, str] | None = None) -> list[Column]:
    """Sort columns: nulls last, `-field` descending, and the entity's key to break ties."""
    out = []
    for f in fields:
        path, lookup = split_key(f.removeprefix("-"), df.schema, aliases or {})
        if lookup != "exact":
            raise PlanError(f"{f!r} is no field")
        c = F.col(".".join(f"`{p}`" for p in path))
        out.append(c.desc_nulls_last() if f.startswith("-") else c.asc_nulls_last())
    return out + [F.col(k).asc_nulls_last() for k in key if k in df.columns and k not in fields]


def compile_plan(catalog: Catalog, plan: Any) -> DataFrame:
    """A plan's rows. The plan is checked first and never changed."""
    from karst.operators.queryset import QuerySet

    if not isinstance(plan, Mapping):
        raise PlanError("a plan is an object")
    if "error" in plan:
        raise PlanError(str(plan["error"]))
    resource = plan.get("resource", DEFAULT_RESOURCE)
    if resource not in catalog:
        raise PlanError(f"unknown resource {resource!r}")
    found = QuerySet(catalog, resource).filter(**{k: v for k, v in plan.items() if k not in CONTROLS})
    if plan.get("order_by"):
        by = plan["order_by"]
        found = found.order_by(*([by] if isinstance(by, str) else by))
    if plan.get("only"):
        found = found.only(plan["only"])
    try:
        limit, offset = (None if plan.get(k) is None else int(plan[k]) for k in ("limit", "offset"))
    except (TypeError, ValueError) as e:
        raise PlanError("limit and offset are whole numbers") from e
    return found.page(limit, offset or 0) if limit is not None or offset else found.df
