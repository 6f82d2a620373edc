"""INSERT, UPDATE and DELETE: checked as queries, published as a new snapshot, or not at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import types as t
from .constraints import check_rows, check_unique
from .errors import ColumnAlreadyExists, ExecutionError, TypeMismatch, evaluating
from .expr import Expr
from .operators.relational import RID, scope_of
from .plans.bind import bind, literal, predicate, quoted
from .sources.catalog import Catalog, Database, Table
from .sources.store import Store


def insert(store: Store, catalog: Catalog, database: Database, table: Table, rows: Sequence[Sequence[object]]) -> int:
    """Short rows are padded with null, null takes the AUTO value or the DEFAULT; the number of rows."""
    if not rows:
        return 0
    counters, full = dict(table.counters), []
    for row in rows:
        if len(row) > len(table.columns):
            raise ExecutionError(f"{len(row)} values for {len(table.columns)} columns")
        values = list(row) + [None] * (len(table.columns) - len(row))
        for i, c in enumerate(table.columns):
            if values[i] is None and c.auto:
                values[i] = counters.setdefault(str(c.id), c.auto.start)
                counters[str(c.id)] += c.auto.step
            elif values[i] is None and c.default:
                values[i] = c.default.value
            t.check(values[i], c.type, c.name)
            values[i] = bytes(values[i]) if isinstance(values[i], bytearray) else values[i]
        full.append((*values, (table.next_insert, len(full))))
    df = store.spark.createDataFrame(full, store.schema(table), verifySchema=False)
    _check(store, table, df)
    with evaluating():
        segment = store.write(database, table, df)
    _publish(catalog, table, segment, counters)
    return len(full)


def insert_frame(store: Store, catalog: Catalog, database: Database, table: Table, df: DataFrame) -> int:
    """As insert, of a DataFrame with columns by name; columns that it lacks are null. Runs as a whole on the executors.

    The rows are written once, checked as they were written, and that segment becomes part of the table; only AUTO numbers make a second one."""
    scope = scope_of(df)
    for name, kind, _ in scope.fields:
        want = table.column(name).type
        if kind.kind != want.kind and not (want.textual and kind.kind == "Text") and kind is not t.NULL:
            raise TypeMismatch(f"{want} in column {name}", kind)
    have = {name.lower(): name for name, *_ in scope.fields}
    cols = {c.name: (quoted(have[c.name.lower()]) if c.name.lower() in have else F.lit(None)).cast(t.to_spark(c.type)) for c in table.columns}
    full = df.select(*(F.coalesce(x, literal(c.default)).alias(n) if (c := table.column(n)).default else x.alias(n) for n, x in cols.items()), F.struct(F.lit(table.next_insert).cast("long").alias("seq"), F.monotonically_increasing_id().alias("row")).alias(RID))
    with evaluating():
        segment = store.write(database, table, full)
        full, counters, numbered = store.read(table, [segment]), dict(table.counters), False
        for c in (c for c in table.columns if c.auto):
            more, used = _numbered(full, c.name, counters.get(str(c.id), c.auto.start), c.auto.step)
            counters[str(c.id)] = counters.get(str(c.id), c.auto.start) + used * c.auto.step
            full, numbered = (more, True) if used else (full, numbered)
        if numbered:
            segment = store.write(database, table, full)
            full = store.read(table, [segment])
        n = full.count()
    if n:
        _check(store, table, full)
        _publish(catalog, table, segment, counters)
    return n


def _numbered(df: DataFrame, name: str, start: int, step: int) -> tuple[DataFrame, int]:
    """Nulls of a column numbered in RID order, without all rows in one task: RIDs of one writing task share all but the lower bits."""
    block = F.struct(F.col(f"{RID}.seq"), F.shiftright(F.col(f"{RID}.row"), 33)).alias("block")
    empty = df.filter(quoted(name).isNull()).select(RID, block)
    sizes = empty.groupBy("block").count()
    before = sizes.select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("before"))  # a row for each writing task
    place = empty.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy(RID))).join(before, "block").select(F.col(RID).alias("at"), (F.col("before") + F.col("n") - 1).alias("n"))
    used = empty.count()
    out = df.join(place, df[RID] == place["at"], "left")
    return out.select(*((F.coalesce(quoted(c), F.col("n") * step + start).alias(c) if c == name else quoted(c)) for c in df.columns)), used


def _check(store: Store, table: Table, df: DataFrame) -> None:
    check_rows(df, table)
    check_unique(df, store.read(table) if table.segments else None, table)


def _publish(catalog: Catalog, table: Table, segment: str, counters: dict[str, int]) -> None:
    table.segments, table.counters, table.next_insert = [*table.segments, segment], counters, table.next_insert + 1
    catalog.commit()


def update(store: Store, catalog: Catalog, database: Database, table: Table, assignments: Mapping[str, Expr], where: Expr | None) -> int:
    """All expressions see the old row; only rows that change are checked and counted."""
    if not assignments:
        return 0
    df = store.read(table)
    scope = scope_of(df)
    new, seen = {}, set()
    for name, e in assignments.items():
        c, x = table.column(name), bind(e, scope)
        if c.name.lower() in seen:
            raise ColumnAlreadyExists(name)
        seen.add(c.name.lower())
        if x.type is not t.NULL and (x.type.kind, x.type.name) != (c.type.kind, c.type.name):
            raise TypeMismatch(f"{c.type} in column {name}", x.type)
        new[c.name] = x.column.cast(t.to_spark(c.type))
    hit = F.coalesce(predicate(where, scope), F.lit(False)) if where is not None else F.lit(True)
    values = [F.when(hit, new[c.name]).otherwise(quoted(c.name)) if c.name in new else quoted(c.name) for c in table.columns]
    changed = _any(~quoted(n).eqNullSafe(new[n]) & hit for n in new)
    cols = [v.alias(c.name, metadata={t.METADATA: t.to_json(c.type)}) for v, c in zip(values, table.columns)]
    with evaluating():
        n = df.filter(changed).count()
    if not n:
        return 0
    check_rows(df.filter(changed).select(*cols, RID), table)
    check_unique(df.select(*cols, RID), None, table, seen)
    with evaluating():
        segments = store.touched(table, df.filter(changed))
        store.replace(database, table, store.read(table, segments).select(*cols, RID), segments)
    catalog.commit()
    return n


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def delete(store: Store, catalog: Catalog, database: Database, table: Table, where: Expr | None) -> int:
    df = store.read(table)
    hit = F.coalesce(predicate(where, scope_of(df)), F.lit(False)) if where is not None else F.lit(True)
    with evaluating():
        n = df.filter(hit).count()
        if not n:
            return 0
        if where is None:
            table.segments = []
        else:
            segments = store.touched(table, df.filter(hit))
            store.replace(database, table, store.read(table, segments).filter(~hit), segments)
    catalog.commit()
    return n
