"""Lazy, chainable queries over an entity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from karst.operators.retrieval import set_similarity
from karst.plans.catalog import Catalog
from karst.plans.compiler import PlanError, condition, ordering, roots, split_key


class QuerySet:
    """Each step gives a new query; nothing runs before rows or counts are asked for."""

    def __init__(self, catalog: Catalog, name: str, df: DataFrame | None = None, sort: tuple = (), fields: tuple = ()):
        if name not in catalog:
            raise PlanError(f"unknown resource {name!r}")
        self._catalog, self._entity = catalog, catalog[name]
        self._df = self._entity.read(catalog.spark) if df is None else df
        self._sort, self._fields = sort, fields

    def _next(self, **changes: Any) -> QuerySet:
        now = {"df": self._df, "sort": self._sort, "fields": self._fields} | changes
        return QuerySet(self._catalog, self._entity.name, **now)

    def filter(self, **filters: Any) -> QuerySet:
        """Rows for which all lookups hold. A DataFrame or QuerySet of one column as the value of `in` is a semi
        join: its values never come to the driver."""
        if self._entity.fingerprint and "similarity" in filters:
            return self._similar(**filters)
        plain = {k: v for k, v in filters.items() if not isinstance(v, (DataFrame, QuerySet))}
        df = self._df.where(condition(self._df, plain, self._entity.aliases, self._catalog.toolkit)) if plain else self._df
        for k, v in filters.items():
            if k not in plain:
                path, lookup = split_key(k, df.schema, self._entity.aliases)
                other = v.df if isinstance(v, QuerySet) else v
                if lookup != "in" or len(other.columns) != 1:
                    raise PlanError(f"{k!r}: only `in` takes a table, of one column")
                keys = other.select(F.col(other.columns[0]).alias("key_"))
                df = df.join(keys, F.col(".".join(f"`{p}`" for p in path)) == F.col("key_"), "left_semi")
        return self._next(df=df)

    def _similar(self, similarity: float, smiles: str | None = None, **more: Any) -> QuerySet:
        """Rows at least `similarity` hundredths like a structure, given as text or by the id of a row, most alike
        first; similarity in hundredths is added. Other filters hold for the rows found."""
        key, bits = self._entity.key[0], self._entity.fingerprint
        named = next((more.pop(k) for k in (*self._entity.aliases, key) if k in more), None)
        if (smiles is None) == (named is None):
            raise PlanError("similarity needs a structure or an id")
        try:
            percent = int(similarity)
        except (TypeError, ValueError) as e:
            raise PlanError("similarity is a whole number of hundredths") from e
        if smiles is not None:
            if self._catalog.toolkit is None:
                raise PlanError("similarity to a structure needs a chemistry toolkit; see karst.functions.chem")
            asked = self._catalog.toolkit.fingerprint(smiles)
        else:
            row = self._entity.read(self._catalog.spark).where(F.col(key) == F.lit(named)).select(bits).first()
            asked = row[0] if row and row[0] is not None else []
        found = set_similarity(self._df, asked, percent, bits).withColumn("similarity", F.col("similarity") * 100).drop(bits)
        return self._next(df=found, sort=("-similarity",)).filter(**more) if more else self._next(df=found, sort=("-similarity",))

    def only(self, fields: str | list[str] | tuple[str, ...]) -> QuerySet:
        return self._next(fields=tuple(roots(fields, self._df, self._entity.aliases)))

    def order_by(self, *fields: str) -> QuerySet:
        ordering(fields, self._df, (), self._entity.aliases)
        return self._next(sort=fields)

    @property
    def df(self) -> DataFrame:
        """The rows; sorted only if order_by was called."""
        return self._shown(self._sorted() if self._sort else self._df)

    def _sorted(self) -> DataFrame:
        return self._df.orderBy(*ordering(self._sort, self._df, self._entity.key, self._entity.aliases))

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.select(*self._fields) if self._fields else df

    def page(self, limit: int | None, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit of the declared order (the entity's key, if none was asked for)."""
        rows = self._sorted()
        rows = rows.offset(offset) if offset else rows
        return self._shown(rows if limit is None else rows.limit(limit))

    def head(self, n: int = 5) -> DataFrame:
        return self.page(n)

    def nth(self, n: int) -> Row | None:
        """The n-th row in order, from the end if negative; None beyond either end."""
        if n < 0:
            n += self.count()
            if n < 0:
                return None
        return next(iter(self.page(1, n).collect()), None)

    def first(self) -> Row | None:
        return self.nth(0)

    def __getitem__(self, n: int) -> Row:
        row = self.nth(n)
        if row is None:
            raise IndexError(n)
        return row

    def get(self, key: Any) -> Row | None:
        """The row whose first key field has this value."""
        return self.filter(**{self._entity.key[0]: key}).first()

    def count(self) -> int:
        return self._df.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self._df.isEmpty()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def values(self, field: str) -> DataFrame:
        """One field of all rows, still distributed."""
        path, _ = split_key(field, self._df.schema, self._entity.aliases)
        return self._df.select(F.col(".".join(f"`{p}`" for p in path)).alias(path[-1]))


class Client:
    """catalog entries as attributes: client.molecule.filter(...)"""

    def __init__(self, catalog: Catalog):
        self._catalog = catalog

    def __getattr__(self, name: str) -> QuerySet:
        if name.startswith("_"):
            raise AttributeError(name)
        return QuerySet(self._catalog, name)

    def __dir__(self) -> list[str]:
        return self._catalog.names()
