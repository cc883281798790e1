"""Chemistry: an interface for a toolkit, and the little that text alone can tell."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ToolkitMissing(RuntimeError):
    """No chemistry toolkit is installed or given."""


class ChemToolkit(Protocol):
    """What a toolkit must offer: one structure in, text (or a list for fingerprint) out. Must be picklable."""

    def smiles2ctab(self, smiles: str) -> str: ...
    def mcs(self, sdf: str) -> str: ...
    def descriptors(self, ctab: str) -> str: ...
    def structural_alerts(self, ctab: str) -> str: ...
    def standardize(self, ctab: str) -> str: ...
    def get_parent(self, ctab: str) -> str: ...
    def connectivity_key(self, smiles: str) -> str: ...
    def fingerprint(self, smiles: str) -> list[int]: ...


SCALAR = ("smiles2ctab", "descriptors", "structural_alerts", "standardize", "get_parent", "connectivity_key", "fingerprint")


def apply(toolkit: ChemToolkit | None, function: str, column: Column) -> Column:
    """A scalar toolkit function over a column, in Arrow batches; null in, null out."""
    if toolkit is None:
        raise ToolkitMissing(f"{function} needs a chemistry toolkit; none is installed. Pass an object with the methods of ChemToolkit.")
    if function not in SCALAR:
        raise ValueError(f"no scalar function {function!r}")
    call = getattr(toolkit, function)

    def typed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else call(v))

    return F.pandas_udf(typed, T.ArrayType(T.IntegerType()) if function == "fingerprint" else T.StringType())(column)


def mcs(toolkit: ChemToolkit | None, df: DataFrame, group: str, ctab: str, order: str) -> DataFrame:
    """(group, mcs): the common substructure of each group's structures, joined to one SDF in order."""
    if toolkit is None:
        raise ToolkitMissing("mcs needs a chemistry toolkit; none is installed.")
    sdf = df.groupBy(group).agg(concat_ordered(order, ctab, "").alias("sdf"))
    call = toolkit.mcs
    def run(values: pd.Series) -> pd.Series:
        return values.map(call)

    return sdf.select(group, F.pandas_udf(run, T.StringType())("sdf").alias("mcs"))


def concat_ordered(order: str, text: str, between: str) -> Column:
    """Aggregate: the group's texts in order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), between)


#: One heavy atom of a SMILES string: a bracket atom other than hydrogen, or an atom of the organic subset.
HEAVY_ATOM = r"\[[0-9]*(?:[A-GI-Z][a-z]?|H[efgos]|[a-z]{1,2})[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]"


def heavy_atoms(smiles: Column) -> Column:
    """Approximate: atoms are counted in the text, without checking that it is a molecule."""
    return F.size(F.regexp_extract_all(smiles, F.lit(HEAVY_ATOM), F.lit(0)))


def largest_fragment(smiles: Column) -> Column:
    """Approximate parent: the fragment with most characters, the first of equals. No salt list, no neutralisation."""
    parts = F.split(smiles, r"\.")
    return F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two sets of fingerprint bits; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def first_of_json(text: Column, element: str) -> Column:
    """The first element of a JSON list that a tool returned, by the element's DDL; null if there is none or the text
    is no such list."""
    return F.get(F.from_json(text, f"array<{element}>"), F.lit(0))
