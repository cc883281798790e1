"""Field lookups: a column and a value to a condition.

All are built-in expressions. exact, contains, startswith, endswith, in, the comparisons and range reach the parquet
scan as pushed filters; the case-blind ones don't, because the column is lowered first.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LookupError_(ValueError):
    """A value that a lookup can't take."""


def _one(value: Any, kind: T.DataType) -> Column:
    """A literal of the column's type; text that isn't such a value is an error, not a null."""
    if value is None:
        raise LookupError_("null is no value for this lookup; use isnull")
    try:
        if isinstance(kind, T.BooleanType):
            value = truth(value)
        elif isinstance(kind, T.IntegralType):
            value = int(value)
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            value = float(value)
        elif isinstance(kind, T.StringType):
            value = value if isinstance(value, str) else str(value)
    except (TypeError, ValueError) as e:
        raise LookupError_(f"{value!r} is no {kind.simpleString()}") from e
    return F.lit(value).cast(kind)


def truth(value: Any) -> bool:
    """True or False from a boolean, 0, 1 or their names."""
    found = {True: True, False: False, "true": True, "false": False, "1": True, "0": False}.get(value.lower() if isinstance(value, str) else value)
    if found is None:
        raise LookupError_(f"{value!r} is neither true nor false")
    return found


def _many(value: Any, kind: T.DataType) -> list[Column]:
    if isinstance(value, (str, bytes)) or not hasattr(value, "__iter__"):
        raise LookupError_(f"a list of values is needed, not {value!r}")
    return [_one(v, kind) for v in value if v is not None]


def _text(value: Any) -> str:
    if not isinstance(value, (str, int, float)) or isinstance(value, bool):
        raise LookupError_(f"{value!r} is no text")
    return str(value)


def _pattern(v: str) -> str:
    """The pattern, if Java takes it: a bad one is told before anything runs."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(v)
        except IllegalArgumentException as e:
            raise LookupError_(f"{v!r} is no pattern: {e}") from e
    return v


def _exact(c: Column, v: Any, k: T.DataType) -> Column:
    return c.isNull() if v is None else c == _one(v, k)


def _in(c: Column, v: Any, k: T.DataType) -> Column:
    values = _many(v, k)
    return c.isin(*values) if values else F.lit(False)


def _range(c: Column, v: Any, k: T.DataType) -> Column:
    ends = _many(v, k)
    if len(ends) != 2:
        raise LookupError_("range takes two values")
    return c.between(*ends)


def _isnull(c: Column, v: Any, k: T.DataType) -> Column:
    return c.isNull() if truth(v) else c.isNotNull()


def _lowered(test: Callable[[Column, Column], Column]) -> Callable:
    return lambda c, v, k: test(F.lower(c.cast("string")), F.lower(F.lit(_text(v))))


def _plain(test: Callable[[Column, str], Column]) -> Callable:
    return lambda c, v, k: test(c.cast("string") if not isinstance(k, T.StringType) else c, _text(v))


#: name -> (column, value, the column's type) -> condition
LOOKUPS: dict[str, Callable[[Column, Any, T.DataType], Column]] = {
    "exact": _exact,
    "iexact": _lowered(lambda c, v: c == v),
    "contains": _plain(lambda c, v: c.contains(v)),
    "icontains": _lowered(lambda c, v: c.contains(v)),
    "in": _in,
    "gt": lambda c, v, k: c > _one(v, k),
    "gte": lambda c, v, k: c >= _one(v, k),
    "lt": lambda c, v, k: c < _one(v, k),
    "lte": lambda c, v, k: c <= _one(v, k),
    "startswith": _plain(lambda c, v: c.startswith(v)),
    "istartswith": _lowered(lambda c, v: c.startswith(v)),
    "endswith": _plain(lambda c, v: c.endswith(v)),
    "iendswith": _lowered(lambda c, v: c.endswith(v)),
    "range": _range,
    "isnull": _isnull,
    "regex": _plain(lambda c, v: c.rlike(_pattern(v))),
    "iregex": _plain(lambda c, v: c.rlike(f"(?i){_pattern(v)}")),
}
#: Needs a chemistry toolkit: compares the connectivity keys of two structures.
CHEMICAL = "connectivity"
