"""Activities by target name: pick a target, filter, drop incomplete rows, keep the first row of each key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.operators.queryset import QuerySet
from karst.plans.catalog import Catalog


@dataclass(frozen=True)
class Result:
    """Rows, or why there are none."""

    df: DataFrame | None = None
    error: str | None = None


@dataclass(frozen=True)
class Roles:
    """Names of what a fetch needs, so that it runs over any catalog."""

    target: str = "target"
    target_id: str = "target_chembl_id"
    target_name: str = "pref_name"
    activity: str = "activity"
    activity_target: str = "target_chembl_id"
    key: str = "canonical_smiles"
    needed: Sequence[str] = ("canonical_smiles", "standard_value")
    columns: Sequence[str] = ("molecule_chembl_id", "canonical_smiles", "standard_type", "standard_units", "standard_value")
    kind: Mapping[str, Any] = field(default_factory=lambda: {"standard_type": "IC50"})


DOMAIN = Roles()


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.na.drop(how="any", subset=list(columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the first by `order`, then by all other columns that can be sorted."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    rest = [c for c, t in df.dtypes if c in rest and not t.startswith(("map", "variant"))]
    by = [F.col(c).asc_nulls_last() for c in [*order, *rest]] or [F.lit(1)]
    return df.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("rn_ = 1").drop("rn_")


def _named(catalog: Catalog, roles: Roles, name: str) -> QuerySet:
    return QuerySet(catalog, roles.target).filter(**{f"{roles.target_name}__icontains": name})


def activities_of(catalog: Catalog, target_id: Any, filters: Mapping[str, Any], roles: Roles = DOMAIN) -> DataFrame:
    """The clean-up on activities of one target. Its id is a literal, so the scan is filtered by it."""
    # the looked-up id wins over one that the filters name
    found = QuerySet(catalog, roles.activity).filter(**(dict(filters) | {roles.activity_target: target_id})).df
    return keep_first(drop_missing(found, roles.needed), [roles.key], catalog[roles.activity].key)


def get_molecules_activity(catalog: Catalog, target_protein: str, select: int = 0, roles: Roles = DOMAIN) -> Result:
    """Activities of the select-th target whose name holds the text (from the end if negative)."""
    targets = _named(catalog, roles, target_protein)
    row = targets.nth(select)
    if row is None:
        n = targets.count()
        return Result(error=f"Invalid selection index {select}. Only {n} targets found." if n else f"No targets found for {target_protein}")
    if QuerySet(catalog, roles.activity).filter(**dict(roles.kind), **{roles.activity_target: row[roles.target_id]}).is_empty():
        return Result(error=f"No IC50 data found for {target_protein}")
    return Result(activities_of(catalog, row[roles.target_id], roles.kind, roles).select(*roles.columns))


def get_molecules_activity_with_filters(catalog: Catalog, filter_dict: Mapping[str, Any], target_only: bool = False, roles: Roles = DOMAIN) -> Result:
    """Activities of the first target named in target_pref_name that pass the other filters, all columns; or all
    targets of that name. The dictionary isn't changed."""
    try:
        filters = dict(filter_dict)
        name = filters.pop("target_pref_name", None)
        if not name:
            return Result(error="Missing required filter key: 'target_pref_name'")
        targets = _named(catalog, roles, name)
        row = targets.first()
        if row is None:
            return Result(error=f"No targets found for '{name}'")
        if target_only:
            return Result(targets.df)
        filters[roles.activity_target] = row[roles.target_id]
        if QuerySet(catalog, roles.activity).filter(**filters).is_empty():
            return Result(error=f"No activity data found for '{name}' with given filters")
        return Result(activities_of(catalog, row[roles.target_id], filters, roles))
    except Exception as e:  # the contract: whatever happens is told, not raised
        return Result(error=f"Exception occurred while querying ChEMBL: {e}")
