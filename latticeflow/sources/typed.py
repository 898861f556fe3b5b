"""Typed JSON documents (S9): a declared schema becomes columns, which yield a typed row and every fault by path.

A schema is a tree of ``Record``, ``Items``, ``Named`` and leaves.  ``faults`` tells of each place of a document what
is wrong there; ``typed`` gives the values as a struct.  Both are expressions over variants: one narrow pass, no
Python worker, and documents of several kinds are read in one go.

Defined answers: a null document is ``missing``; a text that is no JSON, or names a field of one object twice, is
``not JSON``; JSON's null has the wrong kind everywhere; fields that a schema doesn't name are ignored unless its
record is ``closed``; of an object, array or value of the wrong kind nothing within is looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import variants as V
from latticeflow.operators.sampling import CLASSES

FAULTS = "array<struct<path:string,fault:string>>"


@dataclass(frozen=True)
class Whole:
    """A whole number, a long in the typed row."""

    least: int = 0
    most: int = 2**63 - 1
    required: bool = True


@dataclass(frozen=True)
class Number:
    required: bool = True


@dataclass(frozen=True)
class Text:
    among: tuple[str, ...] = ()
    pattern: str = ""
    required: bool = True


@dataclass(frozen=True)
class Flag:
    required: bool = True


@dataclass(frozen=True)
class Any:
    """A value of any kind, text of its JSON in the typed row."""

    required: bool = True


@dataclass(frozen=True)
class Rule:
    """What several values of a record must fulfil together: ``test`` of its typed struct; no answer is no fault."""

    path: str
    fault: str
    test: Callable[[Column], Column]


@dataclass(frozen=True)
class Record:
    fields: dict[str, Node]
    rules: tuple[Rule, ...] = ()
    closed: bool = False
    required: bool = True


@dataclass(frozen=True)
class Items:
    """An array of values of one shape."""

    of: Node
    least: int = 0
    most: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Named:
    """An object of values of one shape, by name; ``keys``: the names it may have, all of them if ``complete``."""

    of: Node
    keys: tuple[str, ...] = ()
    complete: bool = False
    required: bool = True


Node = Whole | Number | Text | Flag | Any | Record | Items | Named


def _list(xs: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _leaf(node: Node, x: Column) -> Column:
    """What is wrong with a value that is given, or null."""
    if isinstance(node, Whole):
        n = V.whole(x)
        return F.when(n.isNull(), "not a whole number").when(n < node.least, f"below {node.least}").when(n > node.most, f"above {node.most}")
    if isinstance(node, Number):
        return F.when(V.number(x).isNull(), "not a number")
    if isinstance(node, Flag):
        return F.when(~V.is_kind(x, "BOOLEAN"), "not true or false")
    if isinstance(node, Any):
        return F.lit(None)
    if isinstance(node, Text):
        s = V.text(x)
        fault = F.when(s.isNull(), "not a text")
        if node.among:
            fault = fault.when(~s.isin(*node.among), "unknown word")
        return fault.when(~s.rlike(node.pattern), "wrong form") if node.pattern else fault
    if isinstance(node, Items):
        n = F.size(V.items(x))
        fault = F.when(V.items(x).isNull(), "not an array").when(n < node.least, f"fewer than {node.least}")
        return fault if node.most is None else fault.when(n > node.most, f"more than {node.most}")
    return F.when(~V.is_kind(x, "OBJECT"), "not an object")


def _told(path: Column, fault: Column) -> Column:
    return F.array(F.struct(path.alias("path"), fault.cast("string").alias("fault")))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once; without this, a value deep in a document would be repeated over and over."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _all(node: Node, x: Column, path: Column) -> Column:
    """An entry per place that was looked at, its fault null where it is fine."""
    if isinstance(node, Record | Items | Named):
        return _bound(x, lambda y: _looked_at(node, y, path))
    return _looked_at(node, x, path)


def _looked_at(node: Node, x: Column, path: Column) -> Column:
    none = F.array().cast(FAULTS)
    here = _told(path, F.when(x.isNull(), "missing" if node.required else None).otherwise(_leaf(node, x)))
    below = lambda name: F.concat(path, F.lit("."), name)
    parts = []
    if isinstance(node, Record):
        parts = [_all(n, V.at(x, name), below(F.lit(name))) for name, n in node.fields.items()]
        if node.rules:
            rules = lambda row: F.array(*[F.struct(below(F.lit(r.path)).alias("path"), F.when(~r.test(row), r.fault).alias("fault")) for r in node.rules])
            parts.append(_bound(value(node, x), rules))
        if node.closed:
            unknown = F.array_except(F.map_keys(V.fields(x)), _list(tuple(node.fields)))
            parts.append(F.transform(unknown, lambda k: F.struct(below(k).alias("path"), F.lit("unknown field").alias("fault"))))
    elif isinstance(node, Items):
        parts = [F.flatten(F.transform(V.items(x), lambda y, i: _all(node.of, y, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))]
    elif isinstance(node, Named):
        entries = F.map_entries(V.fields(x))
        parts = [F.flatten(F.transform(entries, lambda e: _all(node.of, e["value"], below(e["key"]))))]
        if node.keys:
            unknown = F.array_except(F.map_keys(V.fields(x)), _list(node.keys))
            parts.append(F.transform(unknown, lambda k: F.struct(below(k).alias("path"), F.lit("unknown field").alias("fault"))))
        if node.complete:
            gone = F.array_except(_list(node.keys), F.map_keys(V.fields(x)))
            parts.append(F.transform(gone, lambda k: F.struct(below(k).alias("path"), F.lit("missing").alias("fault"))))
    if not parts:
        return here
    kind = V.is_kind(x, "ARRAY" if isinstance(node, Items) else "OBJECT")
    return F.concat(here, F.when(kind, F.concat(*[F.coalesce(p, none) for p in parts])).otherwise(none))


def value(node: Node, x: Column) -> Column:
    """The typed value; null where it is missing or of another kind."""
    if isinstance(node, Whole):
        return V.whole(x).try_cast("long")
    if isinstance(node, Number):
        return V.number(x)
    if isinstance(node, Flag):
        return F.when(V.is_kind(x, "BOOLEAN"), F.try_variant_get(x, "$", "boolean"))
    if isinstance(node, Text):
        return V.text(x)
    if isinstance(node, Any):
        return F.to_json(x)
    if isinstance(node, Items):
        return F.transform(V.items(x), lambda y: value(node.of, y))
    if isinstance(node, Named):
        return F.transform_values(V.fields(x), lambda _, y: value(node.of, y))
    made = lambda y: F.when(V.is_kind(y, "OBJECT"), F.struct(*[value(n, V.at(y, name)).alias(name) for name, n in node.fields.items()]))
    return _bound(x, made)


def faults(node: Node, document: Column, parsed: Column) -> Column:
    """Array of (path, fault), sorted; ``parsed`` is the text ``document`` as a variant."""
    whole = F.when(document.isNull(), _told(F.lit("$"), F.lit("missing"))).when(parsed.isNull(), _told(F.lit("$"), F.lit("not JSON")))
    return F.array_sort(F.filter(whole.otherwise(_all(node, parsed, F.lit("$"))), lambda f: f["fault"].isNotNull()))


def typed(docs: DataFrame, schema: Node, column: str = "document") -> DataFrame:
    """The rows with ``row``, the typed document (null if anything is wrong), and ``faults``."""
    parsed = docs.withColumn("_parsed", F.try_parse_json(column))
    told = parsed.withColumn("faults", faults(schema, F.col(column), F.col("_parsed")))
    return told.withColumn("row", F.when(F.size("faults") == 0, value(schema, F.col("_parsed")))).drop("_parsed")


def checked(docs: DataFrame, kind: str = "kind", column: str = "document", schemas: dict[str, Node] | None = None) -> DataFrame:
    """The rows with ``faults``, each document by the schema of its kind; an unknown kind is a fault of its own."""
    schemas = SCHEMAS if schemas is None else schemas
    parsed = docs.withColumn("_parsed", F.try_parse_json(column))
    # the last case goes innermost
    told = reduce(lambda rest, s: F.when(F.col(kind) == s[0], faults(s[1], F.col(column), F.col("_parsed"))).otherwise(rest), schemas.items(), _told(F.lit("$"), F.lit("unknown kind")))
    return parsed.withColumn("faults", told).drop("_parsed")


# fixed values: fields, words and ranges of the formats
_RADIUS = Whole(0, 2**32)
_WIDTH = Rule("width", "not the difference of the radii", lambda r: r["width"] == r["r_outer"] - r["r_inner"])
_ORDER = Rule("r_outer", "not above r_inner", lambda r: r["r_outer"] > r["r_inner"])
_RUN = {"k_sq": Whole(0, 2**32 - 1), "r_inner": _RADIUS, "r_outer": _RADIUS}
_REGION = Text(("full-octant",))
_BYTE = Whole(0, 255)


def _once(name: str, of: str) -> Callable[[Column], Column]:
    return lambda r: F.size(F.array_distinct(F.transform(r[name], lambda e: e[of]))) == F.size(r[name])


def _whole_set(name: str, of: str, words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda r: F.size(F.array_except(_list(words), F.transform(r[name], lambda e: e[of]))) == 0


MANIFEST = Record(
    {
        "schema_version": Whole(1, 2), "claim_id": Text(), **_RUN, "width": Whole(), "region": _REGION,
        "row_class": Text(required=False), "sample_count": Whole(required=False), "target_tile_samples": Whole(required=False),
        "selection": Items(Record({"class": Text(CLASSES), "target_count": Whole(), "population_exhausted": Flag(required=False), "exhausted": Flag(required=False)})),
        "population_exhaustion": Named(Any(), CLASSES, required=False),
        "class_counts": Named(Whole(), CLASSES, complete=True, required=False),
    },
    (_WIDTH, _ORDER, Rule("selection", "a class twice", _once("selection", "class")), Rule("selection", "a class is missing", _whole_set("selection", "class", CLASSES))),
)
SAMPLE = Record(
    {
        "schema_version": Whole(1, 2), **_RUN, "width": Whole(), "region": _REGION, "claim_id": Text(required=False), "sample_class": Text(CLASSES),
        "tile": Record({"i": Whole(0, 2**31 - 1), "j": Whole(0, 2**31 - 1), "a_lo": Whole(), "b_lo": Whole()}),
        "tileop": Record({"n": Items(_BYTE, 4), "face_groups": Items(_BYTE), "inner_flags": Items(_BYTE, 16), "outer_flags": Items(_BYTE, 16), "tile_flags": _BYTE}),
    },
    (_WIDTH, _ORDER),
)
CERTIFICATE = Record(
    {
        "schema_version": Whole(1, 1), "claim_id": Text(), **_RUN, "region": _REGION, "source": Text(required=False),
        "path": Items(Record({"a": Whole(-(2**63)), "b": Whole(-(2**63))}, closed=True), 2),
    },
    (_ORDER,), closed=True,
)
PROFILE = Record(
    {
        "radii": Record({**_RUN}, (_ORDER,)), "verdict": Text(("SPANNING", "MOAT")), "tiles": Record({"active": Whole(), "produced": Whole(), "ingested": Whole(required=False)}),
        "bz": Record({"checked": Flag(), "clean": Flag(), "override_used": Flag(), "bad_norm_count": Whole()}, required=False),
        "timings_seconds": Named(Number(), required=False), "overflow_counters": Any(required=False),
        "hashes": Named(Text(pattern=V.SHA), ("grid", "constants", "mr_witness"), required=False),
    }
)
BUNDLE = Record(
    {
        "schema_version": Whole(1), "profile": Any(), "overflow_counters": Any(required=False), "bz": Any(required=False),
        "row": Record({"claim_id": Text(), **_RUN, "width": Whole(), "region": _REGION, "verdict": Text(("SPANNING", "MOAT")), "verdict_mode": Text(("ANY-SPAN", "ANY-SHELL-MOAT")), "claim_proof_required": Flag(required=False)}, (_WIDTH, _ORDER)),
    }
)
SCHEMAS = {"manifest": MANIFEST, "sample": SAMPLE, "certificate": CERTIFICATE, "profile": PROFILE, "bundle": BUNDLE}
