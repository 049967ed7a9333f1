"""Column definitions: contract, registry, dependency order, and their evaluation as layered projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

SCOPES = ("event", "session_event", "session")


@dataclass(frozen=True)
class ColumnDef:
    """One output column. build() gives its expression; breaks: a null result marks the row as broken."""

    name: str
    type: str
    build: Callable[[], Column]
    interface: str = ""
    scope: str = "event"
    depends_on: tuple[str, ...] = ()
    breaks: bool = False
    doc: str = ""
    metadata: dict = field(default_factory=dict)


class Registry:
    """An ordered union of definitions; checked once: names are unique, dependencies exist, no cycles."""

    def __init__(self, *groups: list[ColumnDef], given: tuple[str, ...] = ()):
        self.given = set(given)
        self.columns: dict[str, ColumnDef] = {}
        for c in (c for g in groups for c in g):
            if c.name in self.columns:
                raise ValueError(f"column {c.name} is defined twice")
            if c.scope not in SCOPES:
                raise ValueError(f"column {c.name}: no scope {c.scope}")
            if c.name in c.depends_on:
                raise ValueError(f"column {c.name} depends on itself")
            self.columns[c.name] = c
        for c in self.columns.values():
            for d in c.depends_on:
                if d not in self.columns and d not in self.given:
                    raise ValueError(f"column {c.name} depends on {d}, which nothing defines")
        self.layers(None)

    def layers(self, scope: str | None = "event") -> list[list[ColumnDef]]:
        """Definitions of a scope in layers; within a layer by name. A layer needs only those before it."""
        own = {n: c for n, c in self.columns.items() if scope is None or c.scope == scope}
        sorter = TopologicalSorter({n: [d for d in c.depends_on if d in own] for n, c in own.items()})
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"columns depend on each other: {' -> '.join(e.args[1])}") from e
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out.append([own[n] for n in ready])
            sorter.done(*ready)
        return out

    def project(self, df: DataFrame, scope: str = "event", only: set[str] | None = None, over: WindowSpec | None = None) -> DataFrame:
        """Append a scope's columns, one projection a layer. over: the window of a session, for aggregates of session scope."""
        for layer in self.layers(scope):
            chosen = [c for c in layer if only is None or c.name in only]
            made = {c.name: (c.build() if over is None else c.build().over(over)).cast(c.type) for c in chosen}
            if made:
                df = df.withColumns(made)
        return df

    def schema(self, prefix: str = "") -> StructType:
        """Event fields, then session-scoped event fields, then session fields with the prefix."""
        from pyspark.sql.types import _parse_datatype_string

        return StructType([
            StructField((prefix if c.scope == "session" else "") + c.name, _parse_datatype_string(c.type), not c.breaks, {"description": c.doc, **c.metadata})
            for scope in SCOPES for c in self.columns.values() if c.scope == scope
        ])

    def docs(self) -> list[dict]:
        return [{"name": c.name, "interface": c.interface, "scope": c.scope, "type": c.type, "doc": c.doc, "depends_on": list(c.depends_on)} for c in self.columns.values()]


@dataclass(frozen=True)
class TypeMismatch:
    name: str
    expected: str
    found: str


def same_type(a: DataType, b: DataType, relaxed: bool = False) -> bool:
    """Recursive comparison. relaxed: int equals bigint and float equals double, as some warehouses have it."""
    if relaxed and {a.typeName(), b.typeName()} in ({"integer", "long"}, {"float", "double"}):
        return True
    if a.typeName() != b.typeName():
        return False
    if a.typeName() == "array":
        return same_type(a.elementType, b.elementType, relaxed)
    if isinstance(a, StructType):
        return [f.name for f in a] == [f.name for f in b] and all(same_type(x.dataType, y.dataType, relaxed) for x, y in zip(a, b))
    return a == b


def missing_columns(expected: StructType, found: StructType, relaxed: bool = False) -> tuple[list[StructField], list[TypeMismatch]]:
    """Fields that a table lacks, and those that it has with another type."""
    have = {f.name: f for f in found}
    missing = [f for f in expected if f.name not in have]
    wrong = [TypeMismatch(f.name, f.dataType.simpleString(), have[f.name].dataType.simpleString()) for f in expected if f.name in have and not same_type(f.dataType, have[f.name].dataType, relaxed)]
    return missing, wrong


def session_column(name: str, kind: str, build: Callable[[], Column], *deps: str, doc: str = "") -> ColumnDef:
    """A column of session scope: build gives an aggregate over the session's events in their order."""
    return ColumnDef(name, kind, build, f"sessions/{name}", "session", deps, doc=doc)


def last_of_session(name: str, kind: str, value: Callable[[], Column], *deps: str) -> ColumnDef:
    """The last non-null value in the session: custom columns of session scope, and parameters taken from the last event that has one."""
    return session_column(name, kind, lambda: F.last(value(), ignorenulls=True), *deps)


def custom_columns(config: list[dict], build: Callable[..., ColumnDef]) -> list[ColumnDef]:
    """Declared columns: each entry has name, scope (event or session) and the arguments of `build`; names must differ."""
    out = []
    for entry in config:
        entry = dict(entry)
        name, scope = entry.pop("name"), entry.pop("scope", "event")
        if scope not in ("event", "session"):
            raise ValueError(f"column {name}: no scope {scope}")
        if name in {c.name for c in out}:
            raise ValueError(f"column {name} is declared twice")
        own = build(name, **entry)
        out.append(own if scope == "event" else last_of_session(name, own.type, own.build, *own.depends_on))
    return out


def in_one_layout(*frames: DataFrame) -> DataFrame:
    """Rows of several layouts in one, columns matched by name, nulls where a layout lacks one. A column of two types is an error."""
    for one in frames[1:]:
        if wrong := missing_columns(frames[0].schema, one.schema)[1]:
            raise ValueError("; ".join(f"{w.name} is {w.expected} and {w.found}" for w in wrong))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
