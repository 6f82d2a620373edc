"""Users, databases and tables in one JSON file for each version; creating the next version is what makes a change happen.

A commit is a compare-and-set: it fails with ConflictError, and changes nothing, if any other engine has committed since this one read the
catalog. The last KEPT versions stay.

Folders are named by ids, which are never used again, so renaming moves no data. Names are unique whatever their case. Passwords are kept
as salted scrypt hashes.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from contextlib import suppress
from dataclasses import asdict, dataclass, field

from .. import types as t
from ..errors import (
    ColumnAlreadyExists,
    ColumnNotFound,
    ConflictError,
    DatabaseAlreadyExists,
    DatabaseNotFound,
    MetadataError,
    TableAlreadyExists,
    TableNotFound,
    UserAlreadyExists,
    UserNotFound,
    UserPasswordInvalid,
)
from ..expr import Binary, Col, ColIdx, Expr, InList, IsNotNull, IsNull, Lit, Not
from ..types import DataType
from .files import Files

ROOT = "root"
KEPT = 100
PERMISSIONS = ("read", "write", "admin", "manage_databases")


@dataclass(frozen=True)
class Auto:
    start: int = 1
    step: int = 1


@dataclass
class Column:
    """default: a Lit; checks: expressions over the table's columns."""

    name: str
    type: DataType
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    default: Lit | None = None
    checks: list[Expr] = field(default_factory=list)
    auto: Auto | None = None
    id: int = 0

    @property
    def nullable(self) -> bool:
        return not (self.not_null or self.primary_key)

    @property
    def keyed(self) -> bool:
        return self.unique or self.primary_key

    @property
    def physical(self) -> str:
        return f"c{self.id}"

    def validate(self) -> None:
        if self.auto and self.default:
            raise MetadataError(f"column {self.name}: AUTO and DEFAULT exclude each other")
        if self.auto and self.type is not t.INT and self.type.kind != "Int":
            raise MetadataError(f"column {self.name}: only Int can be AUTO")
        if self.auto and not self.auto.step:
            raise MetadataError(f"column {self.name}: a step of zero")
        if self.type.kind == "Enum":
            t.enum(self.type.name, *self.type.variants)
        if self.default:
            t.check(self.default.value, self.type, self.name)


@dataclass
class TableKey:
    """A constraint of the table: kind is primary_key, unique, foreign_key (kept, not enforced) or check."""

    kind: str
    columns: list[str] = field(default_factory=list)
    check: Expr | None = None
    references: str = ""


@dataclass
class Table:
    id: int
    name: str
    columns: list[Column]
    keys: list[TableKey] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)  # folders of the present snapshot
    counters: dict[str, int] = field(default_factory=dict)  # by column id
    next_column: int = 1
    next_insert: int = 0

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise ColumnNotFound(name)

    def has(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    def validate(self) -> None:
        if not self.columns:
            raise MetadataError(f"table {self.name} has no columns")
        seen: set[str] = set()
        for c in self.columns:
            if c.name.lower() in seen:
                raise ColumnAlreadyExists(c.name)
            seen.add(c.name.lower())
            c.validate()
        for k in self.keys:
            if k.kind not in ("primary_key", "unique", "foreign_key", "check"):
                raise MetadataError(f"unknown table constraint {k.kind}")
            if (k.check is None) == (k.kind == "check") or not k.columns and k.kind != "check":
                raise MetadataError(f"a table constraint {k.kind} needs {'an expression' if k.kind == 'check' else 'columns'}")
            for name in k.columns:
                self.column(name)


@dataclass
class Database:
    id: int
    name: str
    tables: dict[str, Table] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise TableNotFound(name)
        return self.tables[name.lower()]

    def add(self, table: Table) -> None:
        if table.name.lower() in self.tables:
            raise TableAlreadyExists(table.name)
        self.tables[table.name.lower()] = table


@dataclass
class User:
    id: int
    name: str
    password: str | None  # None: any, until it is changed
    permissions: list[str]
    databases: dict[str, Database] = field(default_factory=dict)

    @property
    def admin(self) -> bool:
        return "admin" in self.permissions

    def database(self, name: str) -> Database:
        if name.lower() not in self.databases:
            raise DatabaseNotFound(name)
        return self.databases[name.lower()]

    def accepts(self, password: str) -> bool:
        if self.password is None:
            return True
        salt, digest = self.password.split(":")
        return hmac.compare_digest(_scrypt(password, bytes.fromhex(salt)), bytes.fromhex(digest))


def _scrypt(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 12, r=8, p=1)


def hashed(password: str) -> str:
    salt = os.urandom(16)
    return f"{salt.hex()}:{_scrypt(password, salt).hex()}"


def _literal(e: Lit) -> dict:
    v = e.value
    if v is not None and e.type.kind == "Bytes":
        v = bytes(v).hex()
    elif v is not None and e.type.kind in ("Timestamp", "Date", "Time"):
        v = v.isoformat()
    elif isinstance(v, float):
        v = repr(v)
    return {"lit": v, "type": t.to_json(e.type)}


def _value(d: dict) -> Lit:
    import datetime as dt

    kind, v = t.from_json(d["type"]), d["lit"]
    readers = {"Bytes": bytes.fromhex, "Timestamp": dt.datetime.fromisoformat, "Date": dt.date.fromisoformat, "Time": dt.time.fromisoformat, "Float": float}
    return Lit(readers.get(kind.kind, lambda x: x)(v) if v is not None else None, kind)


def dump(e: Expr) -> dict:
    if isinstance(e, Lit):
        return _literal(e)
    if isinstance(e, Col):
        return {"col": e.name}
    if isinstance(e, ColIdx):
        return {"at": e.index}
    if isinstance(e, Binary):
        return {"op": e.op, "args": [dump(e.left), dump(e.right)]}
    if isinstance(e, InList):
        return {"op": "IN", "args": [dump(e.child), *map(dump, e.items)]}
    return {"op": type(e).__name__, "args": [dump(e.child)]}


def load(d: dict) -> Expr:
    if "lit" in d:
        return _value(d)
    if "col" in d:
        return Col(d["col"])
    if "at" in d:
        return ColIdx(d["at"])
    args = [load(a) for a in d["args"]]
    if d["op"] == "IN":
        return InList(args[0], tuple(args[1:]))
    one = {"Not": Not, "IsNull": IsNull, "IsNotNull": IsNotNull}.get(d["op"])
    return one(*args) if one else Binary(d["op"], *args)


def _column(d: dict) -> Column:
    own = d | {"type": t.from_json(d["type"]), "default": load(d["default"]) if d["default"] else None, "checks": [load(c) for c in d["checks"]], "auto": Auto(**d["auto"]) if d["auto"] else None}
    return Column(**own)


def _table(d: dict) -> Table:
    keys = [TableKey(**k | {"check": load(k["check"]) if k["check"] else None}) for k in d["keys"]]
    return Table(**d | {"columns": [_column(c) for c in d["columns"]], "keys": keys})


class Catalog:
    def __init__(self, files: Files, root: str):
        self.files, self.root, self.version = files, root.rstrip("/"), 0
        self.users: dict[str, User] = {}
        self.next_id = 1
        if not self.latest():
            self.users[ROOT] = User(self.new_id(), ROOT, None, list(PERMISSIONS))
            with suppress(ConflictError):
                self.commit()
        self.load()

    @property
    def path(self) -> str:
        return self._at(self.version)

    def _at(self, version: int) -> str:
        return f"{self.root}/catalog/{version:012}.json"

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        names = [name.removesuffix(".json") for name, _ in self.files.children(f"{self.root}/catalog")]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def refresh(self) -> None:
        """Reads what others have committed."""
        if self.latest() != self.version:
            self.load()

    def load(self) -> None:
        self.version = self.latest()
        d = json.loads(self.files.read(self.path))
        self.next_id = d["next_id"]
        self.users = {}
        for u in d["users"]:
            databases = {b["name"].lower(): Database(b["id"], b["name"], {x["name"].lower(): _table(x) for x in b["tables"]}) for b in u["databases"]}
            self.users[u["name"].lower()] = User(u["id"], u["name"], u["password"], u["permissions"], databases)

    def commit(self) -> None:
        def column(c: Column) -> dict:
            return vars(c) | {"type": t.to_json(c.type), "default": dump(c.default) if c.default else None, "checks": [dump(x) for x in c.checks], "auto": asdict(c.auto) if c.auto else None}

        def table(x: Table) -> dict:
            return vars(x) | {"columns": [column(c) for c in x.columns], "keys": [vars(k) | {"check": dump(k.check) if k.check else None} for k in x.keys]}

        users = [vars(u) | {"databases": [{"id": b.id, "name": b.name, "tables": [table(x) for x in b.tables.values()]} for b in u.databases.values()]} for u in self.users.values()]
        text = json.dumps({"next_id": self.next_id, "users": users}, indent=1)
        if self.latest() != self.version or not self.files.create(self._at(self.version + 1), text):
            raise ConflictError(f"{self.root}: version {self.version + 1} is there already")
        self.version += 1
        if self.version > KEPT:
            self.files.delete(self._at(self.version - KEPT))

    def segments(self) -> set[str]:
        """All folders that tables are made of."""
        return {s for u in self.users.values() for d in u.databases.values() for x in d.tables.values() for s in x.segments}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def folder(self, database: Database, table: Table | None = None) -> str:
        return f"{self.root}/d{database.id}" + (f"/t{table.id}" if table else "")

    def user(self, name: str) -> User:
        if name.lower() not in self.users:
            raise UserNotFound(name)
        return self.users[name.lower()]

    def add_user(self, name: str, password: str) -> None:
        if name.lower() in self.users:
            raise UserAlreadyExists(name)
        self.users[name.lower()] = User(self.new_id(), name, hashed(password), ["read", "write"])

    def rename_user(self, old: str, new: str) -> None:
        user = self.user(old)
        if user.name == ROOT or new.lower() == ROOT:
            raise MetadataError("root is not renamed")
        if new.lower() in self.users and new.lower() != old.lower():
            raise UserAlreadyExists(new)
        self.users[new.lower()] = self.users.pop(old.lower())
        user.name = new

    def login(self, name: str, password: str) -> User:
        user = self.user(name)
        if not user.accepts(password):
            raise UserPasswordInvalid(name)
        return user

    def add_database(self, user: User, name: str) -> Database:
        if name.lower() in user.databases:
            raise DatabaseAlreadyExists(name)
        user.databases[name.lower()] = Database(self.new_id(), name)
        return user.databases[name.lower()]
