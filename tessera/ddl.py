"""Changes of a table's columns and constraints, each validated before anything is published."""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from . import types as t
from .constraints import check_rows, check_unique, checks, validate_check
from .dml import _numbered
from .errors import ColumnAlreadyExists, MetadataError, evaluating
from .expr import Lit, columns_in, renamed
from .functions.values import cast_expr
from .plans.bind import literal, quoted
from .sources.catalog import Auto, Catalog, Column, Database, Table, TableKey
from .sources.store import Store


@dataclass(frozen=True)
class Constraint:
    """kind: not_null, unique, primary_key, default, check or auto; value: a Lit, an expression or an Auto where the kind has one."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class Position:
    """first, or after a column; neither: at the end."""

    first: bool = False
    after: str | None = None


def create(store: Store, catalog: Catalog, database: Database, name: str, columns: list[Column], keys: list[TableKey] = ()) -> Table:
    table = Table(catalog.new_id(), name, [], deepcopy(list(keys)))
    for c in deepcopy(columns):
        c.id, table.next_column = table.next_column, table.next_column + 1
        table.columns.append(c)
    table.validate()
    for e in checks(table):
        validate_check(store.read(table), e)
    database.add(table)
    catalog.commit()
    return table


def _commit(catalog: Catalog, database: Database, table: Table) -> None:
    table.validate()
    database.tables[table.name.lower()] = table
    catalog.commit()


def add_columns(store: Store, catalog: Catalog, database: Database, name: str, columns: list[tuple[Column, Position]]) -> None:
    """A batch, all or none. Rows that are there get the DEFAULT, or numbers where the column is AUTO, else null."""
    old = database.table(name)
    table, added = deepcopy(old), []
    for c, at in columns:
        c = deepcopy(c)
        if table.has(c.name):
            raise ColumnAlreadyExists(c.name)
        c.id, table.next_column = table.next_column, table.next_column + 1
        i = 0 if at.first else table.columns.index(table.column(at.after)) + 1 if at.after else len(table.columns)
        table.columns.insert(i, c)
        added.append(c)
    table.validate()
    df = store.read(old)
    for c in added:
        df = df.withColumn(c.name, (literal(c.default) if c.default else F.lit(None)).cast(t.to_spark(c.type)))
        df = df.withMetadata(c.name, {t.METADATA: t.to_json(c.type)})
        if c.auto and old.segments:
            df, used = _numbered(df, c.name, c.auto.start, c.auto.step)
            table.counters[str(c.id)] = c.auto.start + used * c.auto.step
    if old.segments:
        check_rows(df, table)
        check_unique(df, None, table, {c.name.lower() for c in added})
        store.replace(database, table, df)
    else:
        for e in checks(table):
            validate_check(df, e)
    _commit(catalog, database, table)


def rename_column(catalog: Catalog, database: Database, name: str, old: str, new: str) -> None:
    """Metadata only; CHECKs follow."""
    table = deepcopy(database.table(name))
    column = table.column(old)
    if table.has(new) and new.lower() != old.lower():
        raise ColumnAlreadyExists(new)
    for c in table.columns:
        c.checks = [renamed(e, column.name, new) for e in c.checks]
    for k in table.keys:
        k.check = renamed(k.check, column.name, new) if k.check else None
        k.columns = [new if n.lower() == column.name.lower() else n for n in k.columns]
    column.name = new
    _commit(catalog, database, table)


def drop_column(catalog: Catalog, database: Database, name: str, column: str) -> None:
    """Metadata only: scans no longer read it."""
    table = deepcopy(database.table(name))
    gone = table.column(column)
    others = [e for c in table.columns if c is not gone for e in c.checks] + [k.check for k in table.keys if k.check]
    if any(gone.name.lower() in columns_in(e) for e in others) or any(gone.name.lower() in map(str.lower, k.columns) for k in table.keys):
        raise MetadataError(f"a constraint needs column {column}")
    table.columns.remove(gone)
    _commit(catalog, database, table)


def modify_type(store: Store, catalog: Catalog, database: Database, name: str, column: str, kind: t.DataType) -> None:
    """Rows that are there are cast, or the change fails."""
    old = database.table(name)
    table = deepcopy(old)
    c = table.column(column)
    source, c.type = c.type, kind
    c.default = None if c.default and c.default.value is None else c.default
    table.validate()
    if old.segments and source != kind:
        df = store.read(old)
        df = df.withColumn(c.name, _cast(quoted(c.name), source, kind)).withMetadata(c.name, {t.METADATA: t.to_json(kind)})
        check_rows(df, table)
        check_unique(df, None, table, {c.name.lower()})
        with evaluating():
            store.replace(database, table, df)
    _commit(catalog, database, table)


def _cast(x, source: t.DataType, kind: t.DataType):
    if source.kind == kind.kind and source.kind not in ("Enum", "Custom"):
        return x
    plain = t.TEXT if source.textual else source
    return x if plain is t.TEXT and kind is t.TEXT else cast_expr(x, plain, kind)


def add_constraint(store: Store, catalog: Catalog, database: Database, name: str, column: str, constraint: Constraint) -> None:
    table = deepcopy(database.table(name))
    c = table.column(column)
    if constraint.kind in ("not_null", "unique", "primary_key"):
        setattr(c, constraint.kind, True)
    elif constraint.kind == "default":
        if c.default is not None:
            raise MetadataError(f"column {column} has a DEFAULT already")
        c.default = _lit(constraint.value, c)
    elif constraint.kind == "auto":
        c.auto = constraint.value or Auto()
    elif constraint.kind == "check":
        if constraint.value not in c.checks:
            c.checks.append(constraint.value)
    else:
        raise MetadataError(f"unknown constraint {constraint.kind}")
    table.validate()
    df = store.read(table)
    check_rows(df, table)
    if constraint.kind in ("unique", "primary_key"):
        check_unique(df, None, table, {c.name.lower()})
    _commit(catalog, database, table)


def _lit(value: object, c: Column) -> Lit:
    out = value if isinstance(value, Lit) else Lit(value, c.type)
    t.check(out.value, c.type, c.name)
    return replace(out, type=c.type)


def drop_constraint(catalog: Catalog, database: Database, name: str, column: str, constraint: Constraint) -> None:
    """One that isn't there is no error."""
    table = deepcopy(database.table(name))
    c = table.column(column)
    if constraint.kind in ("not_null", "unique", "primary_key"):
        setattr(c, constraint.kind, False)
    elif constraint.kind == "default" and (constraint.value is None or c.default == _lit(constraint.value, c)):
        c.default = None
    elif constraint.kind == "auto":
        c.auto = None
    elif constraint.kind == "check":
        c.checks = [e for e in c.checks if e != constraint.value]
    _commit(catalog, database, table)


def set_default(catalog: Catalog, database: Database, name: str, column: str, value: object) -> None:
    """None removes the DEFAULT."""
    table = deepcopy(database.table(name))
    c = table.column(column)
    c.default = None if value is None else _lit(value, c)
    _commit(catalog, database, table)


__all__ = ["Constraint", "Position", "add_columns", "add_constraint", "create", "drop_column", "drop_constraint", "modify_type", "rename_column", "set_default"]
