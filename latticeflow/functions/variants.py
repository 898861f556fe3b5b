"""Values of JSON documents as variants: by path, by kind, as numbers and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA = "^[0-9a-f]{64}$"


class Value:
    """A value that rules ask of a document; what they make of it is worked out once, too."""

    def __init__(self, asked: Values, name: str) -> None:
        self.asked, self.name, self.column = asked, name, F.col(name)

    def once(self, what: str, make: Callable[[Column], Column]) -> Column:
        return self.asked.made(f"{self.name}_{what}", lambda: make(self.column))


class Values:
    """The values that rules ask of a document, by path, and what they make of them: noted, so that each is made once.

    The ends of paths come out of one cast; what holds other values asked for is got by its path.
    """

    def __init__(self, column: str) -> None:
        self.column = column
        self._asked: dict[tuple[str, ...], Value] = {}
        self._firsts: dict[str, Column] = {}
        self._made: dict[str, Column] = {}

    def at(self, *path: str) -> Value:
        return self._asked.setdefault(path, Value(self, f"_at_{len(self._asked)}"))

    def first(self, *values: Value) -> Value:
        """The first value that is given."""
        name = "_or".join(x.name for x in values)
        self._firsts[name] = F.coalesce(*[F.when(given(x.column), x.column) for x in values])
        return Value(self, name)

    def made(self, name: str, make: Callable[[], Column]) -> Column:
        if name not in self._made:
            self._made[name] = make()
        return F.col(name)

    def taken(self, df: DataFrame) -> DataFrame:
        """``df`` without the document, with what was asked of it."""
        holders = {p[:k] for p in self._asked for k in range(1, len(p))}
        tree: dict = {}
        for path in self._asked.keys() - holders:
            branch = tree
            for name in path[:-1]:
                branch = branch.setdefault(name, {})
            branch[path[-1]] = None
        kind = lambda t: "variant" if t is None else f"struct<{', '.join(f'`{n}`: {kind(t[n])}' for n in sorted(t))}>"
        end = lambda p: F.col(".".join(["_ends", *[f"`{n}`" for n in p]]))
        kept = [c for c in df.columns if c != self.column]
        df = df.withColumn("_ends", F.try_variant_get(self.column, "$", kind(tree)))
        found = {x.name: at(F.col(self.column), *p) if p in holders else end(p) for p, x in self._asked.items()}
        # an object's values came out of the cast: only what is none is looked at again
        for p in holders & self._asked.keys():
            name = self._asked[p].name
            found[f"{name}_object"] = end(p).isNotNull()
            found[f"{name}_given"] = F.when(end(p).isNotNull(), True).otherwise(given(at(F.col(self.column), *p)))
        df = df.select(*kept, *[c.alias(name) for name, c in found.items()])
        df = df.withColumns(self._firsts) if self._firsts else df
        return df.withColumns({name: c for name, c in self._made.items() if name not in found})


def _of(x: Column | Value, what: str, make: Callable[[Column], Column]) -> Column:
    return x.once(what, make) if isinstance(x, Value) else make(x)


def at(v: Column, *path: str) -> Column:
    """The value at a path, as a variant: null where there is none, a variant null for JSON's null."""
    return F.try_variant_get(v, ".".join(["$", *path]), "variant")


def given(x: Column | Value) -> Column:
    return _of(x, "given", lambda c: c.isNotNull() & ~F.is_variant_null(c))


#: Casts that only a value of the kind passes, and that look at none of the values within.
_CONTAINERS = {"OBJECT": "struct<`_`:boolean>", "ARRAY": "array<struct<`_`:boolean>>"}


def is_kind(x: Column | Value, kind: str) -> Column:
    """Whether a value is of a kind; ``schema_of_variant`` would spell out all that an object or array holds."""
    if kind in _CONTAINERS:
        return _of(x, kind.lower(), lambda c: F.try_variant_get(c, "$", _CONTAINERS[kind]).isNotNull())
    return _of(x, kind.lower(), lambda c: F.coalesce(F.schema_of_variant(c).startswith(kind), F.lit(False)))


def _text(x: Column) -> Column:
    return F.when(is_kind(x, "STRING"), F.try_variant_get(x, "$", "string"))


def text(x: Column | Value) -> Column:
    """A JSON string's text; null for other kinds."""
    return _of(x, "text", _text)


def _long(x: Column) -> Column:
    """A value of that very type: taken as it is, where other casts are made anew for each value."""
    return F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "long"))


def shown(x: Column | Value) -> Column:
    """A value of any kind as text."""
    told = lambda c: F.when(is_kind(c, "BOOLEAN"), F.try_variant_get(c, "$", "boolean").cast("string")).otherwise(F.try_variant_get(c, "$", "string"))
    return _of(x, "shown", lambda c: F.coalesce(_long(c).cast("string"), told(c)))


def whole(x: Column) -> Column:
    """A whole number of any sign; null for fractions and other kinds."""
    return F.coalesce(_long(x).cast("decimal(38,0)"), F.when(F.schema_of_variant(x).isin("DECIMAL(19,0)", "DECIMAL(20,0)"), F.try_variant_get(x, "$", "decimal(38,0)")))


def whole_shown(x: Value, read: Callable[[Column], Column]) -> Column:
    """A value's text read as a long."""
    return x.once("whole", lambda c: F.coalesce(_long(c), read(shown(c))))


def _count(x: Column) -> Column:
    n = whole(x)
    return F.when(n >= 0, n)


def count(x: Column | Value) -> Column:
    """A whole number from 0, or null."""
    return _of(x, "count", _count)


def number(x: Column) -> Column:
    """A number as a double; null for other kinds."""
    told = F.schema_of_variant(x)
    return F.when(told.startswith("BIGINT") | told.startswith("DECIMAL") | told.startswith("DOUBLE") | told.startswith("FLOAT"), F.try_variant_get(x, "$", "double"))


def true(x: Column | Value) -> Column:
    return _of(x, "true", lambda c: F.coalesce(is_kind(c, "BOOLEAN") & F.try_variant_get(c, "$", "boolean"), F.lit(False)))


def false(x: Column | Value) -> Column:
    return _of(x, "false", lambda c: F.coalesce(is_kind(c, "BOOLEAN") & ~F.try_variant_get(c, "$", "boolean"), F.lit(False)))


def fields(x: Column | Value) -> Column:
    """An object's values by name; null for other kinds."""
    return _of(x, "fields", lambda c: F.try_variant_get(c, "$", "map<string,variant>"))


def items(x: Column | Value) -> Column:
    """An array's values; null for other kinds."""
    return _of(x, "items", lambda c: F.try_variant_get(c, "$", "array<variant>"))


def kind(x: Column) -> Column:
    """object, array, string, boolean, whole, number (with a fraction or an exponent) or null."""
    return (
        F.when(is_kind(x, "OBJECT"), "object").when(is_kind(x, "ARRAY"), "array").when(is_kind(x, "STRING"), "string").when(is_kind(x, "BOOLEAN"), "boolean")
        .when(whole(x).isNotNull(), "whole").when(number(x).isNotNull(), "number").when(F.is_variant_null(x), "null")
    )
