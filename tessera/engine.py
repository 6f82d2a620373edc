"""The engine: users, databases and tables over a session and a root folder on any store that Spark can write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import commands as c
from . import ddl, dml
from .errors import ConflictError, DatabaseAlreadyExists, EngineError, ExecutionError, MetadataError, NoActiveDatabase, TableAlreadyExists
from .plans.compile import compile
from .sources.catalog import ROOT, Catalog, Database, User, hashed
from .sources.files import Files
from .sources.store import Store, describe

SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true"}
#: Times that a command is run anew because another engine has committed meanwhile.
ATTEMPTS = 20


def configure(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of this one and those that the engine's semantics need; the caller's stays as it is."""
    own = spark.newSession()
    for k, v in ({k: v for k, v in spark.conf.getAll.items() if spark.conf.isModifiable(k)} | SETTINGS).items():
        own.conf.set(k, v)
    return own


@dataclass
class Result:
    """kind: ok, inserted, updated, deleted (count), or rows (df, lazy)."""

    kind: str = "ok"
    count: int = 0
    df: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.files = Files(self.spark)
        self.catalog = Catalog(self.files, root)
        self.store = Store(self.spark, self.catalog)
        self.user_name, self.database_name = ROOT, None

    @property
    def user(self) -> User:
        return self.catalog.user(self.user_name)

    @property
    def database(self) -> Database:
        """The active one; an administrator's may be another user's."""
        if self.database_name is None:
            raise NoActiveDatabase
        return self._find(self.database_name)[1]

    def _find(self, name: str) -> tuple[User, Database]:
        users = [self.user, *(u for u in self.catalog.users.values() if self.user.admin and u is not self.user)]
        for u in users:
            if name.lower() in u.databases:
                return u, u.databases[name.lower()]
        return self.user, self.user.database(name)

    def execute(self, *batch: c.Command) -> Result:
        """The last result; the first error ends the batch, what came before it stays done."""
        return (self.execute_all(*batch) or [Result()])[-1]

    def execute_all(self, *batch: c.Command) -> list[Result]:
        return [self._run(command) for command in batch]

    def _run(self, command: c.Command) -> Result:
        """Sees what others have committed; is run anew if someone commits before it does."""
        run = getattr(self, f"_{type(command).__name__}", None)
        if run is None:
            raise ExecutionError(f"unknown command {command!r}")
        for left in reversed(range(ATTEMPTS)):
            self.catalog.refresh()
            try:
                return run(command) or Result()
            except ConflictError:
                self.catalog.load()
                if not left:
                    raise
            except Exception:
                self.catalog.load()  # the state of the last commit
                raise
            finally:
                self.store.settle()

    def vacuum(self, min_age_s: float = 7 * 86400) -> int:
        """Deletes what no table is made of any more; results of selects older than that may still read it. The number of folders."""
        self.catalog.refresh()
        return self.store.vacuum(min_age_s)

    def select(self, table: str, statement: c.Statement | None = None, like_mode: str = "text") -> DataFrame:
        return self.execute(c.Select(table, statement or c.Statement(), like_mode)).df

    def _names(self, names: list[str]) -> Result:
        return Result("rows", df=self.spark.createDataFrame([(n,) for n in sorted(names)], "table_name string"))

    def _needs_admin(self) -> None:
        if not self.user.admin:
            raise ExecutionError("only an administrator may do this")

    # users

    def _UserLogin(self, x: c.UserLogin) -> None:
        self.user_name, self.database_name = self.catalog.login(x.name, x.password).name, None

    def _CreateUser(self, x: c.CreateUser) -> None:
        self._needs_admin()
        self.catalog.add_user(x.name, x.password)
        self.catalog.commit()

    def _RenameUser(self, x: c.RenameUser) -> None:
        own = x.name.lower() == self.user_name.lower()
        if not own:
            self._needs_admin()
        self.catalog.rename_user(x.name, x.new_name)
        self.catalog.commit()
        if own:
            self.user_name = x.new_name

    def _DropUser(self, x: c.DropUser) -> None:
        if self.user_name != ROOT:
            raise ExecutionError("only root drops users")
        user = self.catalog.user(x.name)
        if user.name == ROOT:
            raise MetadataError("root is not dropped")
        del self.catalog.users[x.name.lower()]
        self.catalog.commit()
        self._forget()
        for d in user.databases.values():
            self.store.drop(d)

    def _forget(self) -> None:
        """The active database is none if it is gone."""
        if self.database_name is not None:
            try:
                self._find(self.database_name)
            except EngineError:
                self.database_name = None

    def _ChangePassword(self, x: c.ChangePassword) -> None:
        user = self.catalog.login(self.user_name, x.old)
        user.password = hashed(x.new)
        self.catalog.commit()

    def _ShowUsers(self, x: c.ShowUsers) -> Result:
        return self._names([u.name for u in self.catalog.users.values()])

    # databases

    def _CreateDatabase(self, x: c.CreateDatabase) -> None:
        self.catalog.add_database(self.user, x.name)
        self.catalog.commit()

    def _RenameDatabase(self, x: c.RenameDatabase) -> None:
        user, database = self._find(x.name)
        if x.new_name.lower() in user.databases and x.new_name.lower() != x.name.lower():
            raise DatabaseAlreadyExists(x.new_name)
        user.databases[x.new_name.lower()] = user.databases.pop(x.name.lower())
        database.name = x.new_name
        self.catalog.commit()
        if self.database_name and self.database_name.lower() == x.name.lower():
            self.database_name = x.new_name

    def _DropDatabase(self, x: c.DropDatabase) -> None:
        user, database = self._find(x.name)
        del user.databases[x.name.lower()]
        self.catalog.commit()
        if self.database_name and self.database_name.lower() == x.name.lower():
            self.database_name = None
        self.store.drop(database)

    def _UseDatabase(self, x: c.UseDatabase) -> None:
        self.database_name = self._find(x.name)[1].name

    def _ShowDatabases(self, x: c.ShowDatabases) -> Result:
        return self._names([d.name for d in self.user.databases.values()])

    # tables

    def _CreateTable(self, x: c.CreateTable) -> None:
        ddl.create(self.store, self.catalog, self.database, x.name, list(x.columns), list(x.keys))

    def _RenameTable(self, x: c.RenameTable) -> None:
        database = self.database
        table = database.table(x.name)
        if x.new_name.lower() in database.tables and x.new_name.lower() != x.name.lower():
            raise TableAlreadyExists(x.new_name)
        database.tables[x.new_name.lower()] = database.tables.pop(x.name.lower())
        table.name = x.new_name
        self.catalog.commit()

    def _DropTable(self, x: c.DropTable) -> None:
        database = self.database
        table = database.table(x.name)
        del database.tables[x.name.lower()]
        self.catalog.commit()
        self.store.drop(database, table)

    def _DescribeTable(self, x: c.DescribeTable) -> Result:
        rows = describe(self.database.table(x.name).columns)
        return Result("rows", df=self.spark.createDataFrame(rows, "Field string, Type string, `Null` string, Key string, `Default` string, Extra string"))

    def _ShowTables(self, x: c.ShowTables) -> Result:
        return self._names([t.name for t in self.database.tables.values()])

    def _AddColumns(self, x: c.AddColumns) -> None:
        placed = [p if isinstance(p, tuple) else (p, ddl.Position()) for p in x.columns]
        ddl.add_columns(self.store, self.catalog, self.database, x.table, placed)

    def _RenameColumn(self, x: c.RenameColumn) -> None:
        ddl.rename_column(self.catalog, self.database, x.table, x.column, x.new_name)

    def _DropColumn(self, x: c.DropColumn) -> None:
        ddl.drop_column(self.catalog, self.database, x.table, x.column)

    def _ModifyType(self, x: c.ModifyType) -> None:
        ddl.modify_type(self.store, self.catalog, self.database, x.table, x.column, x.type)

    def _AddConstraint(self, x: c.AddConstraint) -> None:
        ddl.add_constraint(self.store, self.catalog, self.database, x.table, x.column, x.constraint)

    def _DropConstraint(self, x: c.DropConstraint) -> None:
        ddl.drop_constraint(self.catalog, self.database, x.table, x.column, x.constraint)

    def _SetDefault(self, x: c.SetDefault) -> None:
        ddl.set_default(self.catalog, self.database, x.table, x.column, x.value)

    # rows

    def _Insert(self, x: c.Insert) -> Result:
        database = self.database
        run = dml.insert_frame if isinstance(x.rows, DataFrame) else dml.insert
        return Result("inserted", run(self.store, self.catalog, database, database.table(x.table), x.rows))

    def _Update(self, x: c.Update) -> Result:
        database = self.database
        return Result("updated", dml.update(self.store, self.catalog, database, database.table(x.table), x.assignments, x.where))

    def _Delete(self, x: c.Delete) -> Result:
        database = self.database
        return Result("deleted", dml.delete(self.store, self.catalog, database, database.table(x.table), x.where))

    def _Select(self, x: c.Select) -> Result:
        return Result("rows", df=compile(x.statement, self.store.read(self.database.table(x.table)), x.like_mode))


__all__ = ["Engine", "Result", "configure"]
