"""Queries over one state: identifiers in full or by page, and facets.

Each terminal has a DataFrame form (`*_df`), which is lazy and unbounded, and an object form, which
collects a bounded answer or refuses.  Identifiers are distinct and sorted by key; facet values are
in the order of their type.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import cached_property
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import ArgumentRangeError, InvalidArgumentError, QueryLimitError, UnsupportedQueryError
from postern.limits import FACET_TEXT_BYTES
from postern.operators.tokens import Binding
from postern.plans import literals, nodes
from postern.plans.compile import apply
from postern.plans.fingerprint import fingerprint
from postern.plans.predicate import Predicate, index_of, translate
from postern.sources.schema import RANGE, Index, StateSchema

if TYPE_CHECKING:
    from postern.sources.namespace import Namespace


@dataclass(frozen=True)
class Page:
    """items in order, and the token that continues after them, or None at the end."""

    items: list[Any]
    token: str | None


@dataclass(frozen=True)
class ValueCounts:
    """counts: (value, records) by count descending, then value; no omitted value exceeds maximum_omitted."""

    counts: list[tuple[Any, int]]
    is_exact: bool
    maximum_omitted: int


@dataclass(frozen=True)
class Query:
    """An immutable builder; where() adds to it, terminals run it."""

    namespace: Namespace
    state: str
    predicates: tuple[Predicate, ...] = ()

    def where(self, *predicates: Predicate) -> Query:
        return replace(self, predicates=(*self.predicates, *predicates))

    def where_in(self, name: str, values: Iterable[Any]) -> Query:
        from postern.plans.predicate import P

        return self.where(P(name).isin(values))

    # What the engine does not do, as it would be spelt.
    def _refuse(self, *_: Any, **__: Any) -> Any:
        raise UnsupportedQueryError("queries select records by indexes; they do not project, order, skip, group or join")

    select = order_by = skip = take = group_by = join = distinct = reverse = union = _refuse

    def __iter__(self) -> Iterator[Any]:
        raise UnsupportedQueryError("call a terminal; queries are not enumerated")

    @cached_property
    def schema(self) -> StateSchema:
        return self.namespace.active_schema(self.state)

    @cached_property
    def plan(self) -> nodes.Plan:
        return translate(self.schema, self.predicates)

    def _rows(self) -> DataFrame:
        return apply(self.namespace.data(self.state), self.plan, self.namespace.managed(self.state))

    def _filtered(self) -> DataFrame:
        if not self.predicates:
            raise UnsupportedQueryError("identifiers need at least one filter; scan_df() reads a whole state")
        return self._rows()

    # --- identifiers ---------------------------------------------------------------------------

    def scan_df(self) -> DataFrame:
        """All rows of the plan with all columns; an extension, also without filters."""
        return self._rows()

    def _keys(self, rows: DataFrame) -> DataFrame:
        """Distinct keys; those of a table of the namespace are distinct as they are stored."""
        keys = rows.select(*self.schema.key)
        return keys if self.namespace.managed(self.state) else keys.distinct()

    def ids_df(self) -> DataFrame:
        """All keys in order.  One exchange by ranges of the key serves to tell them apart and to sort them."""
        keys = self._filtered().select(*self.schema.key)
        if not self.namespace.managed(self.state):
            keys = keys.repartitionByRange(*self.schema.key).distinct()
        return keys.orderBy(*self.schema.key)

    def ids(self) -> list[Any]:
        """All keys, or QueryLimitError if there are more than the options allow."""
        most = self.namespace.options.result_items
        with self.namespace.metrics.timed("ids"):
            rows = self._keys(self._filtered()).orderBy(*self.schema.key).limit(most + 1).collect()
        if len(rows) > most:
            raise QueryLimitError(f"more than {most} identifiers")
        keys = [self._key(r) for r in rows]
        self._weigh(keys, self.namespace.options.result_bytes)
        return keys

    def _key(self, row: Any) -> Any:
        return row[0] if len(self.schema.key) == 1 else tuple(row[: len(self.schema.key)])

    @staticmethod
    def _weigh(items: Iterable[Any], most: int) -> None:
        size = sum(len(str(x).encode()) for x in items)
        if size > most:
            raise QueryLimitError(f"{size} bytes of results; at most {most} are allowed")

    def _after(self, key: Any) -> Column:
        """Keys behind `key`, lexicographically over the key's columns."""
        values = key if isinstance(key, tuple | list) else (key,)
        out, equal = F.lit(False), F.lit(True)
        for name, value in zip(self.schema.key, values, strict=True):
            bound = F.lit(value).cast(self.schema.struct[name].dataType)
            out = out | (equal & (F.col(name) > bound))
            equal = equal & (F.col(name) == bound)
        return out

    def id_page_df(self, size: int, after: Any = None) -> DataFrame:
        """The first `size` keys, or those behind `after`."""
        rows = self._filtered() if after is None else self._filtered().where(self._after(after))
        return self._keys(rows).orderBy(*self.schema.key).limit(size)

    def page(self, size: int | None = None, token: str | None = None) -> Page:
        size = self._page_size(size)
        binding = self._binding("ids", ",".join(self.schema.key), size)
        after = None if token is None else self._from_json(self.namespace.tokens.unprotect(token, binding))
        with self.namespace.metrics.timed("page"):
            found = [self._key(r) for r in self.id_page_df(size + 1, after).collect()]
        items = found[:size]
        self._weigh(items, self.namespace.options.page_bytes)
        more = self.namespace.tokens.protect(binding, _to_json(items[-1])) if len(found) > size else None
        return Page(items, more)

    def pages(self, size: int | None = None) -> Iterator[Page]:
        page, rounds = self.page(size), 1
        yield page
        while page.token:
            if rounds == self.namespace.options.rounds:
                raise QueryLimitError(f"more than {rounds} pages; go on from the last page's token, or by walk_df(), which has no such limit")
            page, rounds = self.page(size, page.token), rounds + 1
            yield page

    def walk_df(self, folder: str, size: int | None = None) -> DataFrame:
        """All keys, with page (from 0) and token: the pages that pages() would give without a ceiling, read once.

        token is the sealed one that leads to the page, null for the first; a page's keys lie behind the position
        that its token opens to, or the result fails.  Unlike other DataFrame forms this one runs when it is called:
        it sorts the keys into files below `folder`, which driver and executors share and which must stay while the
        result is in use.  A key's place is that in its file and the rows of the files before.  The driver holds
        a key and a token for each page, and a count for each file.
        """
        size, names, spark = self._page_size(size), self.schema.key, self.namespace.spark
        binding, tokens = self._binding("ids", ",".join(names), size), self.namespace.tokens
        # The upper bits of the id are the number of the partition, and partitions are in the order of the keys.
        keys = self.ids_df().select(F.struct(*names).alias("key"), F.monotonically_increasing_id().alias("at"))
        keys.write.parquet(f"{folder}/keys")
        stored = spark.read.schema(keys.schema).parquet(f"{folder}/keys").select("key", F.shiftright("at", 33).alias("file"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row"))
        before, total = [], 0
        for file, n in sorted(stored.groupBy("file").agg(F.count("*").alias("n")).collect()):
            before.append((file, total))
            total += n
        place = stored.join(F.broadcast(spark.createDataFrame(before, "file long, before long")), "file").select("key", (F.col("before") + F.col("row")).alias("place"))  # one row a file
        placed = place.select("key", "place", F.expr(f"place div {size}").alias("page"))
        starts = []
        for last in placed.where((F.col("place") % size == size - 1) & (F.col("place") < total - 1)).select("key", "page").collect():
            token = tokens.protect(binding, _to_json(self._key(last["key"])))
            after = self._from_json(tokens.unprotect(token, binding))
            starts.append((last["page"] + 1, token, after if len(names) > 1 else (after,)))
        kinds = T.StructType().add("page", T.LongType()).add("token", T.StringType()).add("after", keys.schema["key"].dataType)
        walked = placed.drop("place").join(spark.createDataFrame(starts, kinds), "page", "left")
        behind = (F.col("page") == 0) | (F.col("key") > F.col("after"))
        checked = F.when(behind, F.col("key")).otherwise(F.raise_error(F.lit("a key of a page is not behind the page's token")))
        return walked.select(checked.alias("key"), "page", "token").select("key.*", "page", "token")

    def _page_size(self, size: int | None) -> int:
        size = self.namespace.options.page_size if size is None else size
        if not 1 <= size <= 1024:
            raise ArgumentRangeError("a page has from 1 to 1024 items")
        return size

    def _binding(self, family: str, ordering: str, size: int) -> Binding:
        query = fingerprint(self.plan, self.schema.fingerprint).hex()
        policy = hashlib.sha256(repr((self.namespace.options, size, self.namespace.layout.digest)).encode()).hexdigest()[:16]
        return Binding(self.namespace.name, family, query, ordering, self.namespace.epoch, policy)

    def _from_json(self, at: Any) -> Any:
        kinds = [self.schema.struct[k].dataType for k in self.schema.key]
        values = [_from_json(v, k) for v, k in zip(at if len(kinds) > 1 else [at], kinds, strict=True)]
        return tuple(values) if len(kinds) > 1 else values[0]

    # --- facets --------------------------------------------------------------------------------

    def _facet(self, name: str) -> Index:
        try:
            index = index_of(self.schema, name)
        except UnsupportedQueryError as e:
            raise InvalidArgumentError(str(e)) from None
        if index.membership:
            raise InvalidArgumentError("facets are over scalar indexes, not over collections")
        return index

    def _values(self, index: Index) -> DataFrame:
        """value of every matching record that has one; texts beyond the facet domain stop the facet."""
        value = F.col(index.column)
        if index.codec.family == "text":
            value = F.when(F.octet_length(value) <= FACET_TEXT_BYTES, value).otherwise(F.raise_error(F.lit("a text is too long for facets")).cast("string"))
        return self._rows().where(F.col(index.column).isNotNull()).select(value.alias("value"))

    def distinct_df(self, name: str, size: int | None = None, after: Any = None) -> DataFrame:
        """value in order, the first `size` of them, behind `after`."""
        index = self._facet(name)
        values = self._values(index)
        if after is not None:
            values = values.where(F.col("value") > literals.as_literal(index, _plain(index, after)))
        out = values.distinct().orderBy("value")
        return out if size is None else out.limit(size)

    def distinct_page(self, name: str, size: int | None = None, token: str | None = None) -> Page:
        index, size = self._facet(name), self._page_size(size)
        binding = self._binding("distinct", index.scope, size)
        after = None if token is None else _from_json(self.namespace.tokens.unprotect(token, binding), index.codec.spark_type)
        with self.namespace.metrics.timed("distinct_page"):
            found = [r[0] for r in self.distinct_df(name, size + 1, after).collect()]
        items = found[:size]
        self._weigh(items, self.namespace.options.page_bytes)
        return Page(items, self.namespace.tokens.protect(binding, _to_json(items[-1])) if len(found) > size else None)

    def counts_df(self, name: str, top: int | None = None) -> DataFrame:
        """value and n (records), by n descending, then value."""
        out = self._values(self._facet(name)).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
        return out if top is None else out.limit(self._top(top))

    def _top(self, top: int) -> int:
        if not 1 <= top <= 1024:
            raise ArgumentRangeError("top is from 1 to 1024")
        return top

    def value_counts(self, name: str, top: int | None = None) -> ValueCounts:
        top, most = self._top(self.namespace.options.facet_top_n if top is None else top), self.namespace.options.facet_items
        with self.namespace.metrics.timed("value_counts"):
            rows = self.counts_df(name).limit(max(top, most) + 1).collect()
        if len(rows) > most:
            raise QueryLimitError(f"more than {most} values; counts_df() has no such limit")
        counts = [(r["value"], r["n"]) for r in rows]
        self._weigh((v for v, _ in counts), self.namespace.options.facet_bytes)
        return ValueCounts(counts[:top], True, counts[top][1] if len(counts) > top else 0)

    def approximate_counts_df(self, name: str, top: int, owner: Column, page_size: int = 1024) -> DataFrame:
        """value, n, is_exact and maximum_omitted of a top-n that looks at few values of each owner.

        Each owner nominates its first k = ceil(top / owners) values, whatever the filter; nominated
        values get exact counts of matching records.  U, the unfiltered records of values that their
        owner did not nominate, bounds what any other value can have.  The answer is exact if every
        owner nominated all its values, or if the last count exceeds U.
        """
        index, top = self._facet(name), self._top(top)
        # Nominations, counts and the bound are of one version of the state.
        pinned = replace(self, namespace=self.namespace.pinned(self.state))
        state = pinned.namespace.data(self.state)
        data = state.where(F.col(index.column).isNotNull()).select(F.col(index.column).alias("value"), owner.alias("owner"))
        raw = data.groupBy("owner", "value").agg(F.count("*").alias("raw"))
        # The number of owners is that of the whole state, also of those without a value of this index.  It is
        # asked for first, so that k is a literal and each task ranks only k values an owner.
        owners = state.select(F.count_distinct(owner)).first()[0]
        k = min(page_size, max(1, -(-top // max(1, owners))))
        first = raw.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("value"))).where(F.col("place") <= k)
        total = raw.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("records"), F.count("*").alias("pairs"))
        named = first.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("named_records"), F.count("*").alias("named_pairs"))
        bound = total.crossJoin(named).select((F.col("records") - F.col("named_records")).alias("u"), (F.col("pairs") > F.col("named_pairs")).alias("cut"))  # one row each
        nominated = first.select("value").distinct()
        counts = pinned._values(index).groupBy("value").agg(F.count("*").alias("n")).join(nominated, "value", "left_semi")
        # The first top + 1 counts, by a top-n; only these are ranked in one place.
        placed = counts.orderBy(F.desc("n"), "value").limit(top + 1).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
        ends = placed.agg(F.max(F.when(F.col("rank") == top, F.col("n"))).alias("last"), F.coalesce(F.max(F.when(F.col("rank") > top, F.col("n"))), F.lit(0)).alias("beyond"))
        known = bound.crossJoin(ends)  # one row with one row
        proof = known.select((~F.col("cut") | F.coalesce(F.col("last") > F.col("u"), F.lit(False))).alias("is_exact"), F.greatest("u", "beyond").cast("long").alias("maximum_omitted"))
        return placed.where(F.col("rank") <= top).crossJoin(F.broadcast(proof)).select("value", "n", "is_exact", "maximum_omitted")

    def approximate_counts(self, name: str, top: int, owner: Column) -> ValueCounts:
        with self.namespace.metrics.timed("approximate_counts"):
            rows = sorted(self.approximate_counts_df(name, top, owner).collect(), key=lambda r: (-r["n"], r["value"]))
        self._weigh((r["value"] for r in rows), self.namespace.options.facet_bytes)
        if not rows:
            return ValueCounts([], True, 0)
        return ValueCounts([(r["value"], r["n"]) for r in rows], rows[0]["is_exact"], rows[0]["maximum_omitted"])

    def min_max_df(self, name: str) -> DataFrame:
        """low and high of the matching values; both null if there is none."""
        return self._values(self._facet(name)).agg(F.min("value").alias("low"), F.max("value").alias("high"))

    def min_max(self, name: str) -> tuple[Any, Any] | None:
        with self.namespace.metrics.timed("min_max"):
            row = self.min_max_df(name).first()
        return None if row["low"] is None else (row["low"], row["high"])


def find_df(namespace: Namespace, state: str, name: str, value: Any) -> DataFrame:
    """Keys of the records whose indexed value equals `value`, which must have the value's own type."""
    from postern.plans.predicate import P

    if value is None:
        raise InvalidArgumentError("a value is needed")
    return Query(namespace, state).where(P(name) == value).ids_df()


def range_df(namespace: Namespace, state: str, name: str, low: Any, high: Any, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Keys of the records between low and high; low above high is an error, an open single point is empty."""
    from postern.plans.predicate import P

    if low is None or high is None:
        raise InvalidArgumentError("both ends are needed")
    index = index_of(namespace.active_schema(state), name)
    if index.kind != RANGE:
        raise InvalidArgumentError(f"{name} has no range index")
    if low > high:
        raise InvalidArgumentError("low exceeds high")
    p = P(name)
    return Query(namespace, state).where((p >= low if include_low else p > low) & (p <= high if include_high else p < high)).ids_df()


def _plain(index: Index, value: Any) -> Any:
    return ord(value) if index.codec.family == "char" and isinstance(value, str) else value


def _to_json(value: Any) -> Any:
    if isinstance(value, tuple | list):
        return [_to_json(v) for v in value]
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return value.isoformat() if isinstance(value, dt.datetime | dt.date) else str(value) if isinstance(value, Decimal) else value


def _from_json(value: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.BinaryType):
        return bytearray.fromhex(value)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        found = dt.datetime.fromisoformat(value)
        return found.astimezone(dt.UTC) if isinstance(kind, T.TimestampType) else found
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(value)
    return Decimal(value) if isinstance(kind, T.DecimalType) else value
