"""All named queries and their SQL."""

from __future__ import annotations

from . import learning, profiling, storage, tensors
from .base import Query

BOOKS = (profiling.BOOK, tensors.BOOK, learning.BOOK, storage.BOOK)


def queries() -> dict[str, Query]:
    return {name: query for book in BOOKS for name, (query, _) in book.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, (_, sql) in book.items() if sql is not None}
