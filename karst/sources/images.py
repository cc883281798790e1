"""Images of structures, by the structure's id."""

from __future__ import annotations

from karst.operators.fetch import Result
from karst.operators.queryset import QuerySet
from karst.plans.catalog import Catalog


def image(catalog: Catalog, molecule_id: str, kind: str = "svg") -> bytes | None:
    """The stored image of a structure in a format, or None. The id and the format reach the scan."""
    row = QuerySet(catalog, "image").filter(chembl_id=molecule_id, format=kind).only("content").first()
    return bytes(row["content"]) if row and row["content"] is not None else None


def image_or_error(catalog: Catalog, molecule_id: str, kind: str = "svg") -> Result:
    """Its row, or an error value."""
    found = QuerySet(catalog, "image").filter(chembl_id=molecule_id, format=kind)
    return Result(error=f"No {kind} image of {molecule_id}") if found.is_empty() else Result(found.df)
