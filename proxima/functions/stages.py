"""Intermediate values as columns of successive projections.

A column expression is a tree: a value used in ten places is planned and
evaluated ten times, and nesting multiplies that. ``let`` gives a value a name.
Inside ``staged`` the name is a column of its own, so Spark lays the values out in
as few projections as their dependencies need and compiles each into one stage of
generated code. Elsewhere ``let`` is a one-element transform, which evaluates
once as well but is interpreted, row by row; that form fits anywhere a column does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

_serial = count()
#: Named values of the ``staged`` call under way; None outside.
_open: dict[str, tuple[int, Column]] | None = None


class Rec(dict):
    """Several columns under one name: ``rec["ix"]`` like a struct's field."""

    #: The struct whose fields these are, where they come from one.
    source: Column | None = None

    @classmethod
    def of(cls, struct: Column, names) -> Rec:
        out = cls({k: struct[k] for k in names})
        out.source = struct
        return out

    def column(self) -> Column:
        return F.struct(*(v.alias(k) for k, v in self.items())) if self.source is None else self.source


def rec(**fields: Column) -> Rec:
    return Rec(fields)


def pack(value) -> Column:
    """A plain column: records become structs."""
    return value.column() if isinstance(value, Rec) else value


def _name(value: Column) -> Column:
    """A column of its own, in the first projection after those of the values it uses."""
    name = f"__v{next(_serial)}"
    _open[name] = 1 + _level(value), value.alias(name)
    return F.col(name)


def _level(value: Column) -> int:
    return max((_open[n][0] for n in set(re.findall(r"__v\d+", str(value))) if n in _open), default=0)


def let(value, body):
    """Evaluate ``value`` (a column or a record) once and hand it to ``body``."""
    if _open is not None:
        return body(Rec({k: _name(v) for k, v in value.items()}) if isinstance(value, Rec) else _name(value))
    names: list[str] = []

    def inner(x):
        out = body(Rec.of(x, value) if isinstance(value, Rec) else x)
        names.extend(out if isinstance(out, Rec) else ())
        return pack(out)

    result = F.get(F.transform(F.array(pack(value)), inner), F.lit(0))
    return Rec.of(result, names) if names else result


def bound(fn):
    """Evaluate the column arguments of ``fn`` once each."""

    @wraps(fn)
    def call(*args):
        at = [i for i, a in enumerate(args) if isinstance(a, (Column, Rec))]
        flat = Rec()
        for i in at:
            whole = not isinstance(args[i], Rec) or (_open is None and args[i].source is not None)
            flat |= {f"a{i}": pack(args[i])} if whole else {f"a{i}{k}": v for k, v in args[i].items()}

        def body(s):
            def back(i, a):
                if i not in at:
                    return a
                if f"a{i}" in flat:
                    return Rec.of(s[f"a{i}"], a) if isinstance(a, Rec) else s[f"a{i}"]
                return Rec({k: s[f"a{i}{k}"] for k in a})

            return fn(*(back(i, a) for i, a in enumerate(args)))

        return let(Rec(flat), body)

    return call


@contextmanager
def _scope(new):
    global _open
    old, _open = _open, new
    try:
        yield new
    finally:
        _open = old


def unstaged(fn):
    """``fn`` for use inside a higher-order function, where nothing can be a column of its own."""

    @wraps(fn)
    def inner(*xs):
        with _scope(None):
            return pack(fn(*xs))

    return inner


def each(array: Column, fn) -> Column:
    return F.transform(array, unstaged(fn))


def staged(df: DataFrame, **columns: Callable[[], Column]) -> DataFrame:
    """``df`` with columns added, each built by a function of no arguments.

    A function that makes a record gives a column for each field, ``name_field``.

    >>> staged(pixels, ring=lambda: sky.nest2ring(F.col("pix"), 8))
    """
    with _scope({}) as values:
        built: dict[str, Column] = {}
        for name, make in columns.items():
            value = make()
            built |= {f"{name}_{k}": v for k, v in value.items()} if isinstance(value, Rec) else {name: value}
    out = df
    for level in sorted({at for at, _ in values.values()}):
        out = out.select("*", *(v for at, v in values.values() if at == level))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in built), *(c.alias(k) for k, c in built.items()))


def present(df: DataFrame, name: str) -> DataFrame:
    """The rows where a staged column is not NULL.

    A filter would be pushed below the projections, with the whole tree of the
    column's values in its condition; a generator stays where it is.
    """
    return df.withColumn(name, F.explode(F.when(F.col(name).isNotNull(), F.array(name))))


def spread(array: Column) -> Column:
    """``explode`` of a staged array; of a bare column Spark would infer a filter, and push it down likewise."""
    return F.explode(F.flatten(F.array(array)))
