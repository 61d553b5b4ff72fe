"""Namespaces: isolated sets of states with one set of options, keys and layout."""

from __future__ import annotations

import os
from collections.abc import Callable
from copy import copy

from pyspark.sql import DataFrame, SparkSession

from postern.errors import InvalidArgumentError, SchemaError
from postern.limits import QueryOptions
from postern.operators.layout import Layout
from postern.operators.observe import Metrics
from postern.operators.query import Query
from postern.operators.tokens import KeyRing, TokenCodec
from postern.sources.schema import StateSchema
from postern.sources.table import Table

INTEGRATED, INDEX_ONLY = "integrated", "index-only"


class Namespace:
    """States are registered with a schema, and are either tables below base_path or bound to data.

    Queries and writes run only on states that are registered, and whose stored schema is the
    registered one and active.
    """

    def __init__(self, spark: SparkSession, name: str, base_path: str | None = None, mode: str = INTEGRATED, options: QueryOptions | None = None, keys: KeyRing | None = None, layout: Layout | None = None) -> None:
        if not name or "/" in name:
            raise InvalidArgumentError("a namespace has a name without slashes")
        if mode not in (INTEGRATED, INDEX_ONLY):
            raise InvalidArgumentError(f"mode is {INTEGRATED} or {INDEX_ONLY}")
        self.spark, self.name, self.base_path, self.mode = spark, name, base_path, mode
        self.options, self.layout, self.metrics = options or QueryOptions(), layout or Layout.seed(16), Metrics()
        # A key of this process: its tokens do not outlive it, unless a ring is given.
        self._ring = keys or KeyRing({"local": os.urandom(32)}, "local")
        self._schemas: dict[str, tuple[StateSchema, int]] = {}
        self._data: dict[str, Callable[[], DataFrame]] = {}
        self._tables: dict[str, Table] = {}
        self._pins: dict[str, DataFrame] = {}

    @property
    def tokens(self) -> TokenCodec:
        return TokenCodec(self.spark, self._ring, self.options.token_bytes)

    @property
    def epoch(self) -> int:
        return self.layout.epoch

    # --- registration --------------------------------------------------------------------------

    def register(self, schema: StateSchema, version: int = 1) -> StateSchema:
        known = self._schemas.get(schema.state)
        if known and (known[0].fingerprint, known[1]) != (schema.fingerprint, version):
            raise SchemaError(f"{schema.state} is registered with another schema")
        self._schemas[schema.state] = (schema, version)
        return schema

    def bind(self, schema: StateSchema, data: DataFrame | Callable[[], DataFrame]) -> StateSchema:
        """Registers a state over data that others manage, say files read by Spark."""
        self.register(schema)
        self._data[schema.state] = data if callable(data) else lambda: data
        return schema

    def read_state(self, schema: StateSchema, path: str, fmt: str = "parquet", **options: str) -> StateSchema:
        """Binds a state to files in any format that Spark reads."""
        return self.bind(schema, lambda: self.spark.read.format(fmt).options(**options).schema(schema.struct).load(path))

    def schema(self, state: str) -> StateSchema:
        if state not in self._schemas:
            raise SchemaError(f"{state} is not registered in {self.name}")
        return self._schemas[state][0]

    def version(self, state: str) -> int:
        self.schema(state)
        return self._schemas[state][1]

    def table(self, state: str) -> Table:
        """The state's own table; its schema need not be active."""
        schema = self.schema(state)
        if state in self._data:
            raise SchemaError(f"{state} is bound to data that others manage")
        if self.base_path is None:
            raise InvalidArgumentError(f"namespace {self.name} has no base path")
        if state not in self._tables:
            self._tables[state] = Table(self.spark, f"{self.base_path}/{self.name}/{state}", schema, self.mode == INDEX_ONLY)
        return self._tables[state]

    def active_schema(self, state: str) -> StateSchema:
        """The schema, if queries and writes may use it now."""
        schema = self.schema(state)
        if state not in self._data:
            m = self.table(state).manifest()
            if m.version and (m.schema != schema.fingerprint.hex() or m.status != "active"):
                raise SchemaError(f"the index schema of {state} is not active")
        return schema

    def writer(self, state: str) -> Table:
        """The state's table, for writes; refused unless its schema is active."""
        self.active_schema(state)
        return self.table(state)

    # --- data ----------------------------------------------------------------------------------

    def managed(self, state: str) -> bool:
        """Whether writes went through extraction, so that no NaN and no nulls in collections are stored."""
        return state not in self._data

    def data(self, state: str) -> DataFrame:
        if state in self._pins:
            return self._pins[state]
        return self._data[state]() if state in self._data else self.table(state).current()

    def pinned(self, state: str) -> Namespace:
        """A namespace that reads the version of the state that is current now, whatever is written meanwhile."""
        out = copy(self)
        data = self.data(state)
        out._pins = self._pins | {state: data}
        return out

    def query(self, state: str) -> Query:
        self.schema(state)
        return Query(self, state)
