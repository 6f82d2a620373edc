"""The commands that an Engine executes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .ddl import Constraint, Position
from .expr import Expr
from .sources.catalog import Column, TableKey
from .statement import Statement
from .types import DataType


class Command:
    pass


@dataclass
class UserLogin(Command):
    name: str
    password: str


@dataclass
class CreateUser(Command):
    name: str
    password: str


@dataclass
class RenameUser(Command):
    name: str
    new_name: str


@dataclass
class DropUser(Command):
    name: str


@dataclass
class ChangePassword(Command):
    old: str
    new: str


@dataclass
class ShowUsers(Command):
    pass


@dataclass
class CreateDatabase(Command):
    name: str


@dataclass
class RenameDatabase(Command):
    name: str
    new_name: str


@dataclass
class DropDatabase(Command):
    name: str


@dataclass
class UseDatabase(Command):
    name: str


@dataclass
class ShowDatabases(Command):
    pass


@dataclass
class CreateTable(Command):
    """keys: constraints of several columns."""

    name: str
    columns: Sequence[Column]
    keys: Sequence[TableKey] = ()


@dataclass
class RenameTable(Command):
    name: str
    new_name: str


@dataclass
class DropTable(Command):
    name: str


@dataclass
class DescribeTable(Command):
    name: str


@dataclass
class ShowTables(Command):
    pass


@dataclass
class AddColumns(Command):
    """columns: each a Column, or (Column, Position)."""

    table: str
    columns: Sequence[Column | tuple[Column, Position]]


@dataclass
class RenameColumn(Command):
    table: str
    column: str
    new_name: str


@dataclass
class DropColumn(Command):
    table: str
    column: str


@dataclass
class ModifyType(Command):
    table: str
    column: str
    type: DataType


@dataclass
class AddConstraint(Command):
    table: str
    column: str
    constraint: Constraint


@dataclass
class DropConstraint(Command):
    table: str
    column: str
    constraint: Constraint


@dataclass
class SetDefault(Command):
    table: str
    column: str
    value: object = None


@dataclass
class Insert(Command):
    """rows: sequences of Python values, or a DataFrame with columns by name."""

    table: str
    rows: Sequence[Sequence[object]] | DataFrame


@dataclass
class Update(Command):
    table: str
    assignments: Mapping[str, Expr]
    where: Expr | None = None


@dataclass
class Delete(Command):
    table: str
    where: Expr | None = None


@dataclass
class Select(Command):
    table: str
    statement: Statement = field(default_factory=Statement)
    like_mode: str = "text"
