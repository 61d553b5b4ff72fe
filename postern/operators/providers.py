"""Extension points: what another query provider offers to stand in for Query."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from postern.operators.query import Page, ValueCounts


@runtime_checkable
class IdentifierProvider(Protocol):
    """Complete answers."""

    def ids(self) -> list[Any]: ...

    def ids_df(self) -> DataFrame: ...


@runtime_checkable
class PageProvider(Protocol):
    """Answers by page."""

    def page(self, size: int | None = None, token: str | None = None) -> Page: ...


@runtime_checkable
class FacetProvider(Protocol):
    """The three facets."""

    def distinct_page(self, name: str, size: int | None = None, token: str | None = None) -> Page: ...

    def value_counts(self, name: str, top: int | None = None) -> ValueCounts: ...

    def approximate_counts(self, name: str, top: int, owner: Column) -> ValueCounts: ...

    def min_max(self, name: str) -> tuple[Any, Any] | None: ...
