"""Row-wise recording of sparse cells with commit and revert."""

from __future__ import annotations

from datetime import datetime

from tickweave.functions.types import FIELD_TYPES, VALUE_COLUMNS
from tickweave.operators.model import TALL_SCHEMA

_PYTHON_TYPES = {bool: None, int: "long", float: "double", str: "string"}


class Recorder:
    """Collects rows on the driver and commits them at once; leaving the context without commit discards them.

    >>> with store.recorder("ABC") as r:
    ...     r.add_row(datetime(2024, 1, 2, 8)).record("bid", 12.2).record("size", 100, "int")
    ...     r.commit()
    """

    def __init__(self, store, symbol: str):
        self.store, self.symbol = store, symbol
        self.clear()

    def clear(self) -> None:
        self._rows: list[tuple] = []
        self._types: dict[str, str] = {}
        self._at: datetime | None = None

    revert = clear

    def add_row(self, at: datetime) -> Recorder:
        """Begin a row; its time may equal the last one's but not go back."""
        if self._at is not None and at < self._at:
            raise ValueError(f"{at} is before {self._at}")
        self._at = at
        return self

    def record(self, column: str, value, kind: str | None = None) -> Recorder:
        """A cell of the current row; a second value of a column at one time overwrites the first on read."""
        if not column:
            raise ValueError("a column needs a name")
        if self._at is None:
            raise ValueError("add_row comes first")
        kind = kind or _PYTHON_TYPES.get(type(value))
        if kind not in FIELD_TYPES:
            raise TypeError(f"{value!r} cannot be recorded")
        if self._types.setdefault(column, kind) != kind:
            raise TypeError(f"{column} holds {self._types[column]}, not {kind}")
        cells = [value if f"v_{kind}" == name else None for name in VALUE_COLUMNS]
        self._rows.append((self.symbol, column, self._at, len(self._rows), *cells))
        return self

    def commit(self) -> None:
        if self._rows:
            self.store.append(self.store.spark.createDataFrame(self._rows, TALL_SCHEMA))
        self.clear()

    def __enter__(self) -> Recorder:
        return self

    def __exit__(self, *_) -> None:
        self.revert()
