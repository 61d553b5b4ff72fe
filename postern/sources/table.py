"""Keyed tables: a snapshot and deltas in Parquet, under numbered manifests.

A write adds one delta of upserts and tombstones and commits by creating the next manifest, which
fails if another writer created it first; blind writes then try again on the newer version.  Readers see
the version whose manifest they read: the latest change of each key in the deltas, and of the snapshot
the keys that no delta names.  Only deltas are aggregated, so a filter reaches the files of the snapshot
and the snapshot is not shuffled while Spark can broadcast the deltas' keys.  Compaction writes a new
snapshot.

Rows carry `__seq` (the version that wrote them, with the place within it), `__op` ("U" or "D") and
`__etag`; the tag of a row is its version as a decimal text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import CapacityError, ConcurrentWriteError, SchemaError, StorageError
from postern.limits import COMPACT_AFTER, ENTRIES_BYTES, ENTRIES_PER_INDEX, ENTRIES_PER_RECORD, ENTRY_BYTES, KEY_BYTES, PAYLOAD_BYTES, REPLAY_LIMIT
from postern.sources.files import Files
from postern.sources.schema import Index, StateSchema

SEQ, OP, ETAG = "__seq", "__op", "__etag"
#: How often a blind write that loses races is made again before it gives up.
BLIND_TRIES = 16


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    snapshot: str | None = None
    deltas: tuple[str, ...] = ()
    status: str = "active"
    generation: int = 1
    columns: str = ""
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Read:
    """What read() gives: the record or None, and its tag or None."""

    record: Row | None
    etag: str | None

    @property
    def exists(self) -> bool:
        return self.record is not None


class Table:
    """index_only keeps the key and the indexed columns, and takes blind writes only."""

    def __init__(self, spark: SparkSession, path: str, schema: StateSchema, index_only: bool = False, sink: str = "parquet") -> None:
        self.spark, self.schema, self.index_only, self.sink = spark, schema, index_only, sink
        self.files = Files(spark, path)
        columns = schema.projection(spark.createDataFrame([], schema.struct)).schema if index_only else schema.struct
        clash = {SEQ, OP, ETAG} & set(columns.fieldNames())
        if clash:
            raise StorageError(f"columns {sorted(clash)} are the table's own")
        self.columns = T.StructType([T.StructField(f.name, f.dataType, True) for f in columns.fields])
        self.stored = T.StructType([*self.columns.fields, T.StructField(SEQ, T.LongType()), T.StructField(OP, T.StringType()), T.StructField(ETAG, T.StringType())])

    # --- manifests -----------------------------------------------------------------------------

    def _latest(self) -> int:
        found = [n[:-5] for n in self.files.names("manifests") if n.endswith(".json")]
        if any(not n.isdigit() for n in found):
            raise StorageError("a manifest has no number")
        return max(map(int, found), default=0)

    def manifest(self) -> Manifest:
        """The current version.  The files that it names were whole when it was committed; recover() looks again."""
        latest = self._latest()
        if not latest:
            return Manifest(0, self.schema.fingerprint.hex(), columns=self.columns.json())
        try:
            raw = self.files.read_json(f"manifests/{latest:012d}.json")
            found = Manifest(**(raw | {"deltas": tuple(raw["deltas"])}))
        except (TypeError, KeyError, ValueError) as e:
            raise StorageError(f"manifest {latest} is malformed: {e}") from None
        if found.version != latest or len(found.deltas) > REPLAY_LIMIT:
            raise StorageError(f"manifest {latest} does not hold")
        return found

    def _whole(self, name: str) -> None:
        if not self.files.exists(f"{name}/_SUCCESS"):
            raise StorageError(f"{name} is missing or incomplete")

    def commit(self, before: Manifest, **changes: Any) -> Manifest:
        for name in {changes.get("snapshot"), *changes.get("deltas", ())} - {None, before.snapshot, *before.deltas}:
            self._whole(name)
        after = Manifest(**(before.__dict__ | {"schema": self.schema.fingerprint.hex(), "columns": self.columns.json()} | changes | {"version": before.version + 1}))
        self.files.create_json(f"manifests/{after.version:012d}.json", after.__dict__ | {"deltas": list(after.deltas)})
        return after

    # --- reading -------------------------------------------------------------------------------

    def _load(self, m: Manifest, names: tuple[str, ...]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.stored)
        if m.columns != self.columns.json():
            raise StorageError("the table was written with other columns; rebuild its schema")
        return self.spark.read.format(self.sink).schema(self.stored).load([self.files.at(n) for n in names])

    def _changes(self, m: Manifest) -> DataFrame:
        return self._load(m, (*([m.snapshot] if m.snapshot else []), *m.deltas))

    def rows(self, version: Manifest | None = None) -> DataFrame:
        """Current rows with their tags: the last change of each key, without tombstones."""
        m = version or self.manifest()
        if m.snapshot and not m.deltas:
            return self._load(m, (m.snapshot,))
        deltas = self._load(m, m.deltas)
        if len(m.deltas) > 1:  # within one delta keys are unique
            rest = [c for c in self.stored.fieldNames() if c not in self.schema.key]
            last = deltas.groupBy(*self.schema.key).agg(F.max_by(F.struct(*rest), SEQ).alias("last"))
            deltas = last.select(*self.schema.key, "last.*").select(*self.stored.fieldNames())
        live = deltas.where(F.col(OP) == "U")
        if not m.snapshot:
            return live
        changed = self._load(m, m.deltas).select(*self.schema.key)
        return self._load(m, (m.snapshot,)).join(changed, list(self.schema.key), "left_anti").unionByName(live)

    def current(self, version: Manifest | None = None) -> DataFrame:
        return self.rows(version).select(*self.columns.fieldNames())

    def _is(self, key: Any) -> Column:
        values = key if isinstance(key, tuple | list) else (key,)
        out = F.lit(True)
        for name, value in zip(self.schema.key, values, strict=True):
            out = out & (F.col(name) == F.lit(value).cast(self.columns[name].dataType))
        return out

    def read(self, key: Any) -> Read:
        """One record; the key is filtered before the fold."""
        m = self.manifest()
        if not m.version:
            return Read(None, None)
        found = self._changes(m).where(self._is(key)).orderBy(F.desc(SEQ)).limit(1).collect()
        if not found or found[0][OP] == "D":
            return Read(None, None)
        row = found[0].asDict()
        return Read(Row(**{c: row[c] for c in self.columns.fieldNames()}), row[ETAG])

    # --- writing -------------------------------------------------------------------------------

    def _within_capacity(self, df: DataFrame) -> DataFrame:
        key = sum((F.octet_length(F.col(k).cast("string")) for k in self.schema.key), F.lit(0))
        payload = sum((F.octet_length(F.col(c.name)) for c in self.columns if isinstance(c.dataType, T.StringType | T.BinaryType)), F.lit(0))
        fits = (key <= KEY_BYTES) & (F.coalesce(payload, F.lit(0)) <= PAYLOAD_BYTES)
        fits = fits & self._entries_fit()
        first = self.schema.key[0]
        return df.withColumn(first, F.when(F.coalesce(fits, F.lit(True)), F.col(first)).otherwise(F.raise_error(F.lit("a record exceeds its capacity")).cast(self.columns[first].dataType)))

    def _entries_fit(self) -> Column:
        """Whether the index entries of a record, one of each scalar and one of each member, stay within their number and bytes.

        An entry is its index's name and its value: the bytes of a text or binary value, 16 for any other.
        """
        count, total, each = F.lit(0), F.lit(0), F.lit(True)
        for index in self.schema.indexes.values():
            value, bytes_of = F.col(index.column), self._entry_bytes(index)
            if index.membership:
                sizes = F.transform(value, bytes_of)
                some = F.coalesce(F.size(value), F.lit(0))
                count = count + some
                total = total + F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0))
                each = each & F.coalesce(F.forall(sizes, lambda x: x <= ENTRY_BYTES), F.lit(True)) & (some <= ENTRIES_PER_INDEX)
            else:
                size = F.when(value.isNotNull(), bytes_of(value)).otherwise(0)
                count, total, each = count + value.isNotNull().cast("int"), total + size, each & (size <= ENTRY_BYTES)
        return each & (count <= ENTRIES_PER_RECORD) & (total <= ENTRIES_BYTES)

    @staticmethod
    def _entry_bytes(index: Index) -> Callable[[Column], Column]:
        name = F.lit(len(index.scope.encode()))
        if isinstance(index.codec.spark_type, T.StringType | T.BinaryType):
            return lambda value: F.octet_length(value) + name
        return lambda value: F.lit(16) + name

    def _delta(self, upserts: DataFrame | None, removals: DataFrame | None, order: str | None, before: Manifest) -> str:
        version, parts = before.version + 1, []
        if upserts is not None:
            place = F.col(order) if order else F.lit(0)
            rows = upserts.select("*", place.cast("long").alias("__place"), F.lit("U").alias(OP))
            parts.append(self._within_capacity(self.schema.extract(rows)).select(*self.columns.fieldNames(), "__place", OP))
        if removals is not None:
            place = F.col(order) if order else F.lit(1)
            gone = removals.select(*self.schema.key, place.cast("long").alias("__place"))
            nulls = [F.lit(None).cast(c.dataType).alias(c.name) if c.name not in self.schema.key else F.col(c.name) for c in self.columns]
            parts.append(gone.select(*nulls, "__place", F.lit("D").alias(OP)))
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = [c for c in self.columns.fieldNames() if c not in self.schema.key]
        # Within a delta the last arrival of a key wins.
        last = changes.groupBy(*self.schema.key).agg(F.max_by(F.struct(*rest, OP), F.struct("__place", OP, *[c for c in rest if not isinstance(self.columns[c].dataType, T.MapType)])).alias("last"))
        out = last.select(*self.schema.key, "last.*").select(*self.columns.fieldNames(), F.lit(version).cast("long").alias(SEQ), OP, F.when(F.col(OP) == "U", F.lit(str(version))).alias(ETAG))
        name = f"deltas/{version:012d}-{uuid.uuid4().hex}"
        out.write.format(self.sink).save(self.files.at(name))
        return name

    def _append(self, upserts: DataFrame | None, removals: DataFrame | None, order: str | None = None, before: Manifest | None = None, mark: tuple[str, int] | None = None) -> str:
        """One delta and its commit.  Without a version that it must follow, a write that loses a race is made again."""
        for turn in range(1 if before else BLIND_TRIES):
            m = before or self.manifest()
            if len(m.deltas) >= REPLAY_LIMIT:
                raise CapacityError("too many deltas; compact the table")
            if m.version and (m.status != "active" or m.schema != self.schema.fingerprint.hex()):
                raise SchemaError("the index schema of the table is not active")
            if mark and m.extra.get(mark[0], -1) >= mark[1]:
                return str(m.version)  # another run of the same batch was first
            name = self._delta(upserts, removals, order, m)
            try:
                after = self.commit(m, deltas=(*m.deltas, name), extra=m.extra | dict([mark] if mark else []))
                break
            except ConcurrentWriteError:
                self.files.remove(name)
                if before or turn == BLIND_TRIES - 1:
                    raise
        if len(after.deltas) >= COMPACT_AFTER:
            try:
                self.compact()
            except ConcurrentWriteError:
                pass  # the write itself is committed; whoever was first, or the next writer, compacts
        return str(after.version)

    def _checked(self, expected: DataFrame, m: Manifest) -> None:
        """expected: key columns and etag (null: the key must not exist).  Any mismatch stops the whole write."""
        asked = expected.select(*self.schema.key, F.col("etag").alias("__expected"))
        # Only the rows that are asked for go into the join; few keys are broadcast to the files.
        now = self.rows(m).join(asked.select(*self.schema.key), list(self.schema.key), "left_semi").select(*self.schema.key, F.col(ETAG).alias("__now"))
        wrong = asked.join(now, list(self.schema.key), "left").where(~F.col("__expected").eqNullSafe(F.col("__now")))
        if wrong.limit(1).count():
            raise ConcurrentWriteError("a record is not at the version that the write expects")

    def write(self, df: DataFrame) -> str:
        """Conditional upsert: df has the state's columns and `etag`, the tag last read or null.  Returns the new tag."""
        if self.index_only:
            raise StorageError("an index-only table takes blind writes only")
        m = self.manifest()
        self._checked(df, m)
        return self._append(df.drop("etag"), None, before=m)

    def clear(self, keys: DataFrame) -> str:
        """Conditional delete: keys and `etag`.  A missing row is no error, but its tag is still checked."""
        m = self.manifest()
        self._checked(keys, m)
        return self._append(None, keys, before=m)

    def upsert(self, df: DataFrame, order: str | None = None, mark: tuple[str, int] | None = None) -> str:
        """Blind upsert; of rows that share a key the one with the greatest `order` stays.

        mark (a source and a number) is committed with the rows, see marked().
        """
        return self._append(df, None, order, mark=mark)

    def follow(self, version: Manifest, df: DataFrame, mark: tuple[str, int] | None = None) -> str:
        """Upsert of rows that were computed from a version; ConcurrentWriteError if the table has moved on."""
        return self._append(df, None, before=version, mark=mark)

    def marked(self, source: str) -> int:
        """The last number committed for a source, or -1: what a repeated batch finds of itself."""
        return self.manifest().extra.get(source, -1)

    def remove(self, keys: DataFrame) -> str:
        """Blind delete; absent keys are fine."""
        return self._append(None, keys)

    def apply_outbox(self, changes: DataFrame, op: str = "op", order: str = "version", mark: tuple[str, int] | None = None) -> str:
        """Upserts and removals in one commit; of each key the change with the greatest order stays."""
        return self._append(changes.where(F.col(op) == "U"), changes.where(F.col(op) == "D"), order, mark=mark)

    # --- maintenance ---------------------------------------------------------------------------

    def compact(self) -> Manifest:
        """A new snapshot of the current rows, and no deltas.  Older files stay for readers at work."""
        m = self.manifest()
        if not m.deltas:
            return m
        name = f"snapshots/{m.version + 1:012d}-{uuid.uuid4().hex}"
        self.rows(m).write.format(self.sink).save(self.files.at(name))
        return self.commit(m, snapshot=name, deltas=())

    def vacuum(self) -> list[str]:
        """Removes older manifests, and snapshots and deltas that the current version does not name; no reader of
        older ones may be left, and no writer whose delta is not committed yet."""
        m = self.manifest()
        for name in self.files.names("manifests"):
            if name.endswith(".json") and int(name[:-5]) < m.version:
                self.files.remove(f"manifests/{name}")
        named = {m.snapshot, *m.deltas}
        gone = [f"{d}/{n}" for d in ("snapshots", "deltas") for n in self.files.names(d) if f"{d}/{n}" not in named]
        for name in gone:
            self.files.remove(name)
        return gone

    def recover(self) -> Manifest:
        """Checks that the current version can be read at all, with the columns it says; drops drafts."""
        for name in self.files.names("manifests"):
            if name.endswith(".draft"):
                self.files.remove(f"manifests/{name}")
        m = self.manifest()
        for name in [*([m.snapshot] if m.snapshot else []), *m.deltas]:
            self._whole(name)
        if m.version:
            if m.schema != self.schema.fingerprint.hex() and m.status == "active":
                raise StorageError("the table belongs to another schema")
            repeated = self._changes(m).groupBy(*self.schema.key, SEQ).count().where("count > 1")
            if repeated.limit(1).count():
                raise StorageError("a key was changed twice by one version")
        return m
