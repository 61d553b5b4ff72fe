"""The life of an index schema: status, and the rebuild after it changed.

A rebuild reads the stored payload, extracts the indexes of the registered schema, writes a new
snapshot and activates it by one manifest.  Its phases are manifests as well, so a rebuild that was
broken off is taken up by calling it again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import SchemaError
from postern.sources.namespace import INDEX_ONLY, Namespace
from postern.sources.table import ETAG, OP, SEQ, Manifest, Table

# Phases of a rebuild, in order.
ENABLING, SCANNING, ACTIVATING, ACTIVE = "enabling", "scanning", "activating", "active"


@dataclass(frozen=True)
class SchemaStatus:
    """registered: the fingerprint that the program has; stored: that of the table, or None if it has no rows yet."""

    state: str
    phase: str
    registered: str
    stored: str | None
    generation: int

    @property
    def active(self) -> bool:
        return self.phase == ACTIVE and self.stored in (None, self.registered)


def status(namespace: Namespace, state: str) -> SchemaStatus:
    m = namespace.table(state).manifest()
    return SchemaStatus(state, m.status, namespace.schema(state).fingerprint.hex(), m.schema if m.version else None, m.generation)


def rebuild(namespace: Namespace, state: str, stop_after: str | None = None) -> SchemaStatus:
    """Makes the registered schema the active one.  stop_after ends after a phase, as a lost driver would."""
    table, schema = namespace.table(state), namespace.schema(state)
    m = table.manifest()
    if not m.version or (m.status == ACTIVE and m.schema == schema.fingerprint.hex()):
        return status(namespace, state)
    if namespace.mode == INDEX_ONLY and (m.snapshot or m.deltas):
        raise SchemaError("an index-only table keeps no payload to rebuild from")
    stored_as, columns = m.extra.get("from", m.schema), m.extra.get("columns", m.columns)
    keep = {"schema": stored_as, "columns": columns}
    if m.status == ACTIVE:
        m = table.commit(m, status=ENABLING, extra={"from": m.schema, "columns": m.columns}, **keep)
        if stop_after == ENABLING:
            return status(namespace, state)
    if m.status == ENABLING:
        m = table.commit(m, status=SCANNING, **keep)
        if stop_after == SCANNING:
            return status(namespace, state)
    if m.status == SCANNING:
        name = f"snapshots/{m.version + 1:012d}-{uuid.uuid4().hex}"
        _extracted(table, columns, m).write.format(table.sink).save(table.files.at(name))
        m = table.commit(m, status=ACTIVATING, extra=m.extra | {"next": name}, **keep)
        if stop_after == ACTIVATING:
            return status(namespace, state)
    table.commit(m, status=ACTIVE, snapshot=m.extra["next"], deltas=(), generation=m.generation + 1, extra={})
    return status(namespace, state)


def _extracted(table: Table, columns: str, m: Manifest) -> DataFrame:
    """Current rows, read with the columns they were written with; columns that are new are null."""
    before = T.StructType.fromJson(json.loads(columns))
    reader = Table.__new__(Table)
    reader.__dict__ |= table.__dict__ | {"columns": before, "stored": T.StructType([*before.fields, *table.stored.fields[-3:]])}
    rows = reader.rows(Manifest(**(m.__dict__ | {"columns": before.json()})))
    have = set(before.fieldNames())
    wanted = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in table.columns]
    return table.schema.extract(rows.select(*wanted, SEQ, OP, ETAG))
