"""One exception for each kind of failure; all are EngineError."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    pass


class TypeMismatch(EngineError):
    def __init__(self, expected: object, found: object):
        super().__init__(f"type mismatch: expected {expected}, found {found}")


class InvalidExpression(EngineError):
    pass


class EvaluationError(EngineError):
    pass


class ExecutionError(EngineError):
    pass


class ConversionError(EngineError):
    def __init__(self, expected: object, found: object):
        super().__init__(f"cannot convert: expected {expected}, found {found}")


class _Named(EngineError):
    said = "{}"

    def __init__(self, name: str):
        super().__init__(self.said.format(name))
        self.name = name


class ColumnNotFound(_Named):
    said = "column {} does not exist"


class ColumnAlreadyExists(_Named):
    said = "column {} exists already"


class TableNotFound(_Named):
    said = "table {} does not exist"


class TableAlreadyExists(_Named):
    said = "table {} exists already"


class UserNotFound(_Named):
    said = "user {} does not exist"


class UserAlreadyExists(_Named):
    said = "user {} exists already"


class UserPasswordInvalid(_Named):
    said = "wrong password for user {}"


class DatabaseNotFound(_Named):
    said = "database {} does not exist"


class DatabaseAlreadyExists(_Named):
    said = "database {} exists already"


class NoActiveDatabase(EngineError):
    def __init__(self) -> None:
        super().__init__("no database is active")


class MetadataError(EngineError):
    pass


class StorageError(EngineError):
    pass


class ConflictError(StorageError):
    """Another engine has committed since the catalog was read; nothing of this change has happened."""


@contextmanager
def evaluating() -> Iterator[None]:
    """Spark raises evaluation errors when an action runs; here they become EvaluationError."""
    from pyspark.errors import ArithmeticException, NumberFormatException, PySparkException

    try:
        yield
    except (ArithmeticException, NumberFormatException) as e:
        raise EvaluationError(e.getCondition() or str(e)) from e
    except PySparkException as e:
        raise ExecutionError(str(e)[:500]) from e
