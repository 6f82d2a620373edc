"""The registered queries of the relational engine, and the same in SQL.

The given tables hold no nulls; where a query needs some, WITH_NULLS derives them, in both forms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commands as c
from . import types as t
from .ddl import Constraint, Position
from .engine import Engine, configure
from .errors import EngineError
from .expr import Expr, col, col_at, lit
from .plans.compile import compile
from .sources.catalog import Auto, Column, TableKey
from .statement import Statement, agg_max, agg_min, agg_sum, asc, avg, count, desc

Query = Callable[[SparkSession, str], DataFrame]
#: table: (column, condition under which it is null)
WITH_NULLS = {
    "lineitem": ("l_tax", "l_linenumber % 3 = 0"),
    "part": ("p_size", "p_partkey % 3 = 0"),
    "orders": ("o_orderpriority", "o_orderkey % 4 = 0"),
}


def source(spark: SparkSession, sf_dir: str, table: str, nulls: bool = False) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    if nulls:
        name, when = WITH_NULLS[table]
        df = df.withColumn(name, F.when(F.expr(when), None).otherwise(F.col(name)))
    return df


def view(table: str, nulls: bool = False) -> str:
    if not nulls:
        return table
    name, when = WITH_NULLS[table]
    return f"(SELECT * REPLACE (CASE WHEN {when} THEN NULL ELSE {name} END AS {name}) FROM {table})"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of floats depend on the order of addition; the last digits go, on both sides."""
    return df.select(*(F.round(n, digits[n]).alias(n) if n in digits else F.col(n) for n in df.columns))


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, table: str, stmt: Statement, sql: str, nulls: bool = False, digits: dict[str, int] | None = None, like_mode: str = "text") -> None:
    """sql: with {t} for the table."""
    QUERIES[name] = lambda spark, sf_dir: rounded(compile(stmt, source(spark, sf_dir, table, nulls), like_mode), **(digits or {}))
    ORACLE_SQL[name] = sql.format(t=view(table, nulls))


def filtered(name: str, table: str, where: Expr, columns: str, condition: str, nulls: bool = False, like_mode: str = "text") -> None:
    names = [x.strip() for x in columns.split(",")]
    add(name, table, Statement(where=where, projection=tuple(map(col, names))), f"SELECT {columns} FROM {{t}} WHERE {condition}", nulls, like_mode=like_mode)


def projected(name: str, table: str, key: str, e: Expr, sql: str, nulls: bool = False, digits: int | None = None) -> None:
    """The key and one computed column, col_1."""
    value = f"round({sql}, {digits})" if digits else sql
    add(name, table, Statement(projection=(col(key), e)), f"SELECT {key}, {value} AS col_1 FROM {{t}}", nulls, {"col_1": digits} if digits else None)


add("scan_all", "nation", Statement(), "SELECT * FROM {t}")
for _op, _sign, _e in (("eq", "=", col("o_custkey").eq(7)), ("ne", "<>", col("o_custkey").ne(7)), ("lt", "<", col("o_custkey").lt(70)), ("le", "<=", col("o_custkey").le(70)), ("gt", ">", col("o_custkey").gt(70)), ("ge", ">=", col("o_custkey").ge(70))):
    filtered(f"filter_{_op}", "orders", _e, "o_orderkey, o_custkey, o_totalprice", f"o_custkey {_sign} {7 if _op in ('eq', 'ne') else 70}")
filtered("filter_and_or_not", "lineitem", col("l_quantity").gt(10).and_(col("l_returnflag").eq("A")).or_(col("l_discount").ge(0.05).not_()), "l_orderkey, l_partkey, l_quantity, l_discount", "(l_quantity > 10 AND l_returnflag = 'A') OR NOT (l_discount >= 0.05)")
filtered("filter_is_null", "lineitem", col("l_tax").is_null(), "l_orderkey, l_linenumber, l_quantity", "l_tax IS NULL", nulls=True)
filtered("filter_is_not_null", "lineitem", col("l_tax").is_not_null(), "l_orderkey, l_linenumber, l_tax", "l_tax IS NOT NULL", nulls=True)
filtered("filter_in", "part", col("p_size").in_(1, 5, 9), "p_partkey, p_size", "p_size IN (1, 5, 9)")
projected("in_with_null", "part", "p_partkey", col("p_size").in_(1, 5, None), "p_size IN (1, 5, NULL)", nulls=True)
projected("not_in_null", "part", "p_partkey", col("p_size").in_(1, None).not_(), "NOT (p_size IN (1, NULL))", nulls=True)
projected("in_empty", "part", "p_partkey", col("p_size").in_(), "CASE WHEN p_size IS NULL THEN NULL ELSE FALSE END", nulls=True)
projected("in_expressions", "part", "p_partkey", col("p_size").in_(col("p_partkey"), col("p_partkey").sub(1), 7), "p_size IN (p_partkey, p_partkey - 1, 7)", nulls=True)
filtered("filter_like_pct", "part", col("p_name").like("%e%"), "p_partkey, p_name", "p_name LIKE '%e%'")
filtered("filter_like_prefix", "part", col("p_type").like("S%"), "p_partkey, p_type", "p_type LIKE 'S%'")
filtered("filter_like_underscore", "part", col("p_brand").like("Brand#_2"), "p_partkey, p_brand", "p_brand LIKE 'Brand#_2'")
filtered("filter_like_column_pattern", "part", col("p_name").like(col("p_name")), "p_partkey, p_name", "p_name LIKE p_name")
filtered("like_line_mode", "documents", col("text").like("%e%o%"), "doc_id, n_chars", "regexp_full_match(text, '.*e.*o.*')", like_mode="line")
projected("mixed_rank_compare", "part", "p_partkey", col("p_size").lt("0"), "CASE WHEN p_size IS NULL THEN NULL ELSE TRUE END", nulls=True)
projected("mixed_rank_equal", "part", "p_partkey", col("p_name").eq(lit("x", t.enum("e", "x"))), "FALSE")
filtered("int_float_compare", "part", col("p_size").gt(7.5), "p_partkey, p_size", "p_size > 7.5")
projected("arith_add", "part", "p_partkey", col("p_size").add(col("p_partkey")), "p_size + p_partkey", nulls=True)
projected("arith_sub", "part", "p_partkey", col("p_size").sub(100), "(p_size - 100)::BIGINT")
projected("arith_mul", "part", "p_partkey", col("p_retailprice").mul(col("p_size")), "p_retailprice * p_size", digits=4)
projected("div_float", "part", "p_partkey", col("p_retailprice").div(7), "p_retailprice / 7", digits=6)
projected("div_int", "part", "p_partkey", col("p_size").sub(25).div(7), "((p_size - 25) // 7)::BIGINT")
add("project_columns", "orders", Statement(projection=(col("o_orderkey"), col("o_orderstatus"))), "SELECT o_orderkey, o_orderstatus FROM {t}")
add("project_computed", "orders", Statement(projection=(col("o_orderkey").add(1), col("o_custkey"), col("o_orderstatus").eq("F"))), "SELECT o_orderkey + 1 AS col_0, o_custkey, o_orderstatus = 'F' AS col_2 FROM {t}")
add("project_literal", "nation", Statement(projection=(lit(5), lit("x"), lit(True), lit(2.5), col("n_name"))), "SELECT 5::BIGINT AS col_0, 'x' AS col_1, TRUE AS col_2, 2.5::DOUBLE AS col_3, n_name FROM {t}")
add("project_index", "orders", Statement(projection=(col_at(1), col_at(0))), "SELECT o_custkey AS col_0, o_orderkey AS col_1 FROM {t}")
for _fn, _agg, _sql, _digits in (
    ("count_star", count(), "count(*)", None),
    ("count_col", count("l_tax"), "count(l_tax)", None),
    ("sum", agg_sum("l_quantity"), "round(sum(l_quantity), 2)", 2),
    ("sum_int", agg_sum("l_linenumber"), "sum(l_linenumber)::BIGINT", None),
    ("avg", avg("l_tax"), "round(avg(l_tax), 6)", 6),
    ("avg_int", avg("l_linenumber"), "round(avg(l_linenumber), 6)", 6),
    ("min", agg_min("l_tax"), "min(l_tax)", None),
    ("max", agg_max("l_extendedprice"), "max(l_extendedprice)", None),
):
    _out = f"{_agg.fn}_0"
    add(f"agg_{_fn}", "lineitem", Statement(aggregates=(_agg,)), f"SELECT {_sql} AS {_out} FROM {{t}}", True, {_out: _digits} if _digits else None)
add("agg_empty_input", "lineitem", Statement(where=col("l_quantity").lt(0), aggregates=(count(), agg_sum("l_quantity"))), "SELECT count(*) AS count_0, sum(l_quantity) AS sum_1 FROM {t} WHERE l_quantity < 0")
add("group_one", "lineitem", Statement(group_by=("l_returnflag",), aggregates=(count(), agg_sum("l_quantity"))), "SELECT l_returnflag, count(*) AS count_0, round(sum(l_quantity), 2) AS sum_1 FROM {t} GROUP BY 1", digits={"sum_1": 2})
add("group_many", "lineitem", Statement(group_by=("l_returnflag", "l_linestatus", "l_linenumber"), aggregates=(count(), agg_max("l_tax"))), "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS count_0, max(l_tax) AS max_1 FROM {t} GROUP BY 1, 2, 3", True)
add("group_null_key", "orders", Statement(group_by=("o_orderpriority",), aggregates=(count(), count("o_orderpriority"))), "SELECT o_orderpriority, count(*) AS count_0, count(o_orderpriority) AS count_1 FROM {t} GROUP BY 1", True)
add("group_distinct", "orders", Statement(group_by=("o_orderstatus", "o_orderpriority")), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {t}", True)
_FIVE = "count(*) AS count_0, round(sum(l_quantity), 2) AS sum_1, round(avg(l_extendedprice), 6) AS avg_2, min(l_discount) AS min_3, max(l_tax) AS max_4"
add(
    "group_all_five",
    "lineitem",
    Statement(where=col("l_quantity").gt(10), group_by=("l_returnflag", "l_linestatus"), aggregates=(count(), agg_sum("l_quantity"), avg("l_extendedprice"), agg_min("l_discount"), agg_max("l_tax")), order_by=(asc("l_returnflag"), asc("l_linestatus"))),
    f"SELECT l_returnflag, l_linestatus, {_FIVE} FROM {{t}} WHERE l_quantity > 10 GROUP BY 1, 2 ORDER BY 1, 2",
    digits={"sum_1": 2, "avg_2": 6},
)
add("agg_minmax_text", "orders", Statement(group_by=("o_orderstatus",), aggregates=(agg_min("o_orderpriority"), agg_max("o_orderpriority"))), "SELECT o_orderstatus, min(o_orderpriority) AS min_0, max(o_orderpriority) AS max_1 FROM {t} GROUP BY 1")
add("agg_minmax_date", "orders", Statement(aggregates=(agg_min("o_orderdate"), agg_max("o_orderdate"))), "SELECT min(o_orderdate) AS min_0, max(o_orderdate) AS max_1 FROM {t}")
add("agg_then_project", "lineitem", Statement(group_by=("l_linenumber",), aggregates=(count(),), projection=(col("count_0").mul(2), col("l_linenumber"))), "SELECT count(*) * 2 AS col_0, l_linenumber FROM {t} GROUP BY l_linenumber")
add("agg_then_sort", "lineitem", Statement(group_by=("l_partkey",), aggregates=(count(),), order_by=(desc("count_0"), asc("l_partkey")), limit=10), "SELECT l_partkey, count(*) AS count_0 FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("sort_multi", "orders", Statement(order_by=(desc("o_orderstatus"), asc("o_orderkey")), projection=(col("o_orderstatus"), col("o_orderkey")), limit=50), "SELECT o_orderstatus, o_orderkey FROM {t} ORDER BY o_orderstatus DESC, o_orderkey LIMIT 50")
add("sort_nulls_asc", "orders", Statement(order_by=(asc("o_orderpriority"), asc("o_orderkey")), projection=(col("o_orderkey"), col("o_orderpriority")), limit=40), "SELECT o_orderkey, o_orderpriority FROM {t} ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey LIMIT 40", True)
add("sort_nulls_desc", "orders", Statement(order_by=(desc("o_orderpriority"), asc("o_orderkey")), projection=(col("o_orderkey"), col("o_orderpriority")), limit=40), "SELECT o_orderkey, o_orderpriority FROM {t} ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 40", True)
add("sort_hidden_col", "orders", Statement(order_by=(asc("o_custkey"), desc("o_orderkey")), projection=(col("o_totalprice"),), limit=30), "SELECT o_totalprice FROM {t} ORDER BY o_custkey, o_orderkey DESC LIMIT 30")
add("sort_expression", "part", Statement(order_by=(desc(col("p_size").mul(-1).add(col("p_partkey"))), asc("p_partkey")), projection=(col("p_partkey"),), limit=30), "SELECT p_partkey FROM {t} ORDER BY p_size * -1 + p_partkey DESC, p_partkey LIMIT 30")
_KEY = (asc("o_orderkey"),)
add("limit", "orders", Statement(order_by=_KEY, limit=7), "SELECT * FROM {t} ORDER BY o_orderkey LIMIT 7")
add("offset", "orders", Statement(order_by=_KEY, offset=9, projection=(col("o_orderkey"),)), "SELECT o_orderkey FROM {t} ORDER BY o_orderkey OFFSET 9")
add("limit_offset", "orders", Statement(order_by=_KEY, limit=15, offset=5, projection=(col("o_orderkey"), col("o_totalprice"))), "SELECT o_orderkey, o_totalprice FROM {t} ORDER BY o_orderkey LIMIT 15 OFFSET 5")
add("limit_zero", "orders", Statement(limit=0), "SELECT * FROM {t} LIMIT 0")
add("topk", "orders", Statement(order_by=(desc("o_totalprice"), asc("o_orderkey")), limit=10), "SELECT * FROM {t} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add(
    "where_group_sort_project_limit",
    "lineitem",
    Statement(where=col("l_quantity").ge(5).and_(col("l_returnflag").ne("N")), group_by=("l_suppkey",), aggregates=(count(), agg_sum("l_extendedprice")), order_by=(desc("count_0"), asc("l_suppkey")), projection=(col("l_suppkey"), col("sum_1"), col("count_0").add(1)), offset=2, limit=20),
    "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS sum_1, count(*) + 1 AS col_2 FROM {t} WHERE l_quantity >= 5 AND l_returnflag <> 'N' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20 OFFSET 2",
    digits={"sum_1": 2},
)


def _like_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = configure(spark).createDataFrame([(1, "a%b"), (2, "a\\b"), (3, "a\\%"), (4, "axb")], "id long, s string")
    return compile(Statement(projection=(col("id"), col("s").like("a\\%"))), df)


QUERIES["like_backslash_literal"] = _like_backslash
ORACLE_SQL["like_backslash_literal"] = r"SELECT id, s LIKE 'a\%' AS col_1 FROM (VALUES (1::BIGINT, 'a%b'), (2, 'a\b'), (3, 'a\%'), (4, 'axb')) v(id, s)"


def stored_table(spark: SparkSession, sf_dir: str, table: str, columns: list[Column]) -> Engine:
    """A new engine in the session's shared folder, with a copy of one of the given tables in it. Without such a folder, in the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if shared.startswith(("file:", "/")) and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    engine = Engine(spark, f"{shared.rstrip('/')}/tessera-store-{uuid.uuid4().hex}")
    engine.execute(c.CreateDatabase("shop"), c.UseDatabase("shop"), c.CreateTable(table, columns))
    engine.execute(c.Insert(table, source(spark, sf_dir, table)))
    return engine


def nation(spark: SparkSession, sf_dir: str) -> Engine:
    return stored_table(spark, sf_dir, "nation", [Column("n_nationkey", t.INT, primary_key=True), Column("n_name", t.TEXT, not_null=True), Column("n_regionkey", t.INT)])


def stored(name: str, sql: str, *batch: c.Command, rejected: Sequence[c.Command] = (), show: c.Command | None = None, table: str = "nation") -> None:
    """What is in `nation` (or the table named, or what a command shows) after a batch of commands and some that must fail."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = nation(spark, sf_dir)
        engine.execute(*batch)
        for bad in rejected:
            try:
                engine.execute(bad)
            except EngineError:
                continue
            raise AssertionError(f"{bad} must fail")
        return engine.execute(show).df if show else engine.select(table)

    QUERIES[name], ORACLE_SQL[name] = run, sql


stored("dml_insert", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', NULL), (101, 'LEMURIA', 3)", c.Insert("nation", [(100, "ATLANTIS"), (101, "LEMURIA", 3)]))
stored("dml_update", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, (CASE WHEN n_regionkey = 1 THEN n_nationkey + n_regionkey ELSE n_regionkey END)::BIGINT AS n_regionkey FROM nation", c.Update("nation", {"n_regionkey": col("n_nationkey").add(col("n_regionkey")), "n_name": lit("X")}, col("n_regionkey").eq(1)))
stored("dml_delete", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE NOT (n_regionkey = 2 OR n_name LIKE '%A')", c.Delete("nation", col("n_regionkey").eq(2).or_(col("n_name").like("%A"))))
stored("ddl_add_column_first", "SELECT NULL::VARCHAR AS code, n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", c.AddColumns("nation", [(Column("code", t.TEXT), Position(first=True))]))
stored("ddl_default_backfill", "SELECT n_nationkey::BIGINT AS n_nationkey, 7::BIGINT AS level, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", c.AddColumns("nation", [(Column("level", t.INT, not_null=True, default=lit(7)), Position(after="n_nationkey"))]))
stored("ddl_auto_backfill", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, (10 + 5 * (row_number() OVER (ORDER BY n_nationkey) - 1))::BIGINT AS no FROM nation", c.AddColumns("nation", [Column("no", t.INT, auto=Auto(10, 5))]))
stored("ddl_rename", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS title, n_regionkey::BIGINT AS n_regionkey FROM nation", c.RenameColumn("nation", "n_name", "title"))
stored("ddl_drop", "SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation", c.DropColumn("nation", "n_name"))
stored("ddl_modify_type", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation", c.ModifyType("nation", "n_regionkey", t.TEXT))
stored("ddl_constraint_then_insert", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL VALUES (200, 'MU', 4)", c.AddConstraint("nation", "n_regionkey", Constraint("check", col("n_regionkey").lt(5))), c.SetDefault("nation", "n_regionkey", 4), c.Insert("nation", [(200, "MU")]))
QUERIES["show_tables"] = lambda spark, sf_dir: nation(spark, sf_dir).execute(c.ShowTables()).df
ORACLE_SQL["show_tables"] = "SELECT 'nation' AS table_name"
QUERIES["describe_table"] = lambda spark, sf_dir: nation(spark, sf_dir).execute(c.DescribeTable("nation")).df
ORACLE_SQL["describe_table"] = """SELECT * FROM (VALUES ('n_nationkey', 'Int', 'NO', 'PRI', 'NULL', ''), ('n_name', 'Text', 'NO', '', 'NULL', ''), ('n_regionkey', 'Int', 'YES', '', 'NULL', '')) v("Field", "Type", "Null", "Key", "Default", "Extra")"""

_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
_NAMES = "SELECT table_name FROM (VALUES {}) v(table_name)"


def shown(name: str, names: str, show: c.Command, *batch: c.Command, rejected: Sequence[c.Command] = ()) -> None:
    stored(name, _NAMES.format(", ".join(f"('{n}')" for n in names.split())), *batch, rejected=rejected, show=show)


shown("user_create", "Ann bob root", c.ShowUsers(), c.CreateUser("Ann", "a"), c.CreateUser("bob", "b"), rejected=[c.CreateUser("ANN", "x")])
shown("user_rename", "Eve root", c.ShowUsers(), c.CreateUser("Ann", "a"), c.RenameUser("ann", "Eve"), rejected=[c.RenameUser("root", "x"), c.RenameUser("ann", "y")])
shown("user_drop", "Ann root", c.ShowUsers(), c.CreateUser("Ann", "a"), c.CreateUser("bob", "b"), c.DropUser("BOB"), rejected=[c.DropUser("bob"), c.DropUser("root")])
shown("user_login", "hers", c.ShowDatabases(), c.CreateUser("Ann", "a"), c.UserLogin("ann", "a"), c.CreateDatabase("hers"), rejected=[c.UserLogin("root2", ""), c.UserLogin("Ann", "b"), c.CreateUser("x", "y"), c.UseDatabase("shop")])
shown("user_change_password", "shop", c.ShowDatabases(), c.ChangePassword("any", "new"), c.UserLogin("root", "new"), rejected=[c.UserLogin("root", "any"), c.ChangePassword("any", "x")])
shown("database_show", "other shop", c.ShowDatabases(), c.CreateDatabase("other"), rejected=[c.CreateDatabase("OTHER")])
shown("database_rename", "store", c.ShowDatabases(), c.RenameDatabase("shop", "store"), rejected=[c.RenameDatabase("shop", "x")])
stored("database_rename_keeps_rows", _NATION, c.RenameDatabase("shop", "store"), c.UseDatabase("STORE"))
shown("database_drop", "other", c.ShowDatabases(), c.CreateDatabase("other"), c.DropDatabase("shop"), rejected=[c.DropDatabase("shop"), c.ShowTables()])
_ONE = [Column("id", t.INT)]
shown("table_rename", "b country", c.ShowTables(), c.CreateTable("b", _ONE), c.RenameTable("nation", "country"), rejected=[c.RenameTable("b", "COUNTRY"), c.CreateTable("none", []), c.CreateTable("twice", [Column("n", t.TEXT), Column("N", t.TEXT)])])
stored("table_rename_keeps_rows", _NATION, c.RenameTable("nation", "country"), table="country")
shown("table_drop", "b", c.ShowTables(), c.CreateTable("b", _ONE), c.DropTable("nation"), rejected=[c.DropTable("nation"), c.Select("nation")])
_LOW = Constraint("check", col("n_regionkey").lt(5))
stored("ddl_drop_constraint", _NATION + " UNION ALL VALUES (100, NULL, 9)", c.AddConstraint("nation", "n_regionkey", _LOW), c.DropConstraint("nation", "n_regionkey", _LOW), c.DropConstraint("nation", "n_name", Constraint("not_null")), c.Insert("nation", [(100, None, 9)]))
stored("ddl_set_default", _NATION + " UNION ALL VALUES (100, 'none', 3), (101, 'x', 3)", c.SetDefault("nation", "n_name", "none"), c.SetDefault("nation", "n_regionkey", 3), c.Insert("nation", [(100,), (101, "x")]))
stored("ddl_unset_default", _NATION + " UNION ALL VALUES (100, 'x', NULL)", c.SetDefault("nation", "n_regionkey", 3), c.SetDefault("nation", "n_regionkey"), c.Insert("nation", [(100, "x")]))
stored("ddl_rejected", _NATION, rejected=[c.AddConstraint("nation", "n_regionkey", Constraint("unique")), c.AddConstraint("nation", "n_regionkey", Constraint("check", col("n_regionkey").lt(2))), c.ModifyType("nation", "n_name", t.INT), c.SetDefault("nation", "n_regionkey", "x"), c.AddColumns("nation", [Column("n", t.INT, not_null=True)]), c.AddColumns("nation", [Column("n_name", t.TEXT)]), c.RenameColumn("nation", "n_name", "n_regionkey"), c.DropColumn("nation", "no name")])
stored("dml_rejected", _NATION, c.AddConstraint("nation", "n_regionkey", _LOW), rejected=[c.Insert("nation", [(100, "new"), (7, "taken")]), c.Insert("nation", [(100, "a"), (100, "b")]), c.Insert("nation", [(100, None)]), c.Insert("nation", [(None, "x")]), c.Insert("nation", [(100, "x", 5)]), c.Insert("nation", [("100", "x")]), c.Insert("nation", [(100, "x", 1, 1)]), c.Update("nation", {"n_nationkey": lit(1)}), c.Update("nation", {"n_name": lit(None)}), c.Update("nation", {"n_regionkey": lit(7)}), c.Update("nation", {"n_regionkey": lit(1).div(0)})])
stored("dml_update_key_shift", "SELECT (n_nationkey + 1)::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation", c.Update("nation", {"n_nationkey": col("n_nationkey").add(1)}))
stored("dml_check_null_passes", _NATION + " UNION ALL VALUES (100, 'x', NULL)", c.AddConstraint("nation", "n_regionkey", _LOW), c.Insert("nation", [(100, "x")]))
stored("dml_delete_all_insert", "SELECT * FROM (VALUES (1::BIGINT, 'x', NULL::BIGINT)) v(n_nationkey, n_name, n_regionkey)", c.Delete("nation"), c.Insert("nation", [(1, "x")]))
_PAIR = [Column("a", t.INT, not_null=True), Column("b", t.TEXT)]
stored("table_keys", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (1, 'y'), (2, 'x'), (2, NULL), (2, NULL)) v(a, b)", c.CreateTable("pair", _PAIR, [TableKey("unique", ["a", "b"]), TableKey("check", check=col("a").lt(9))]), c.Insert("pair", [(1, "x"), (1, "y"), (2, "x"), (2, None), (2, None)]), rejected=[c.Insert("pair", [(1, "y")]), c.Insert("pair", [(9, "z")]), c.Update("pair", {"b": lit("x")}), c.CreateTable("bad", _PAIR, [TableKey("unique", ["zz"])])], table="pair")


def _insert_frame_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = nation(spark, sf_dir)
    engine.execute(c.CreateTable("supplier", [Column("no", t.INT, primary_key=True, auto=Auto(100, 10)), Column("s_suppkey", t.INT), Column("s_name", t.TEXT), Column("kind", t.TEXT, default=lit("new"))]))
    engine.execute(c.Insert("supplier", source(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey")), c.Insert("supplier", [(None, -1, "last")]))
    return engine.select("supplier")


QUERIES["dml_insert_frame_auto"] = _insert_frame_auto
ORACLE_SQL["dml_insert_frame_auto"] = "SELECT (100 + 10 * (row_number() OVER (ORDER BY o, s_suppkey) - 1))::BIGINT AS no, s_suppkey, s_name, 'new' AS kind FROM (SELECT 0 AS o, s_suppkey, s_name FROM supplier UNION ALL SELECT 1, -1, 'last')"


def _reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, defaults and constraints as another engine on the same root finds them."""
    first = nation(spark, sf_dir)
    first.execute(c.AddColumns("nation", [Column("no", t.INT, unique=True, auto=Auto(1, 2)), Column("note", t.TEXT, default=lit("-"))]))
    again = Engine(spark, first.catalog.root)
    again.execute(c.UseDatabase("shop"), c.Insert("nation", [(100, "x", 1)]))
    first.execute(c.Insert("nation", [(101, "y", 1)]))
    return again.select("nation")


QUERIES["reload"] = _reload
ORACLE_SQL["reload"] = "SELECT *, (2 * row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS no, '-' AS note FROM (SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL VALUES (100, 'x', 1), (101, 'y', 1))"
