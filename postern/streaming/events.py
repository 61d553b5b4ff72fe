"""A strict parser of repository events, in built-in expressions.

An event is a JSON object {"id", "type", <type>: {...}} of a closed form: no other properties, no
other types.  parse() gives every input row either the event's columns or a quarantine code, so
rows that do not hold are kept aside and never stop a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and names of the event contract.
MOST_BYTES = 64 * 1024
TOKEN, DID, RKEY, CID = 128, 2048, 512, 256
COLLECTIONS = ("app.bsky.feed.post", "app.bsky.feed.like", "app.bsky.feed.repost", "app.bsky.graph.follow", "app.bsky.actor.profile")
ACTIONS = ("create", "update", "delete")
STATUSES = ("active", "deactivated", "takendown", "suspended", "deleted")
TID = "^[234567abcdefghij][234567abcdefghijklmnopqrstuvwxyz]{12}$"
DID_FORM = "^did:[a-z]+:[A-Za-z0-9._:%-]*[A-Za-z0-9._-]$"
CODES = ("EventTooLarge", "MalformedJson", "InvalidRoot", "MissingProperty", "UnexpectedProperty", "InvalidValue", "UnsupportedEventType", "UnsupportedCollection")


def _kind(v: Column, path: str) -> Column:
    """Type name of what stands at a path, or null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _keys(v: Column, path: str) -> Column:
    """Property names of the object at a path."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))


def _exact(keys: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0
    more = F.size(F.array_except(keys, F.array(*map(F.lit, required + optional)))) > 0
    return F.when(missing, "MissingProperty").when(more, "UnexpectedProperty")


def _string(v: Column, path: str, most: int) -> Column:
    text = _text(v, path)
    return F.when(_kind(v, path).isNull(), "MissingProperty").when(~F.coalesce((_kind(v, path) == "STRING") & (F.length(text) > 0) & (F.length(text) <= most), F.lit(False)), "InvalidValue")


def _flag(v: Column, path: str) -> Column:
    return F.when(F.coalesce(_kind(v, path), F.lit("")) != "BOOLEAN", "InvalidValue")


def _one_of(v: Column, path: str, values: tuple[str, ...], code: str = "InvalidValue") -> Column:
    return F.when(~_text(v, path).isin(*values), code)


def _form(v: Column, path: str, pattern: str) -> Column:
    return F.when(~_text(v, path).rlike(pattern), "InvalidValue")


def parse(df: DataFrame, value: str = "value", observed: str = "observed_at") -> DataFrame:
    """df with `code` (null if accepted), `delivery_id` and the columns of the event.

    Columns: event, did, live, revision, collection, record_key, action, cid, target_did, is_reply,
    status, minute, semantic_key (SHA-256 over what makes two deliveries the same event).
    """
    raw = F.col(value)
    rows = df.withColumn("__v", F.try_parse_json(raw)).withColumn("__minute", F.floor(F.unix_timestamp(F.col(observed)) / 60).cast("long"))
    v = F.col("__v")
    kind = _text(v, "$.type")
    object_at = lambda path: F.coalesce(F.startswith(_kind(v, path), F.lit("OBJECT")), F.lit(False))
    delivery = F.when(_kind(v, "$.id") == "BIGINT", F.try_variant_get(v, "$.id", "long"))
    root = F.coalesce(
        F.when(raw.isNull(), "MalformedJson"),
        F.when(F.octet_length(raw) > MOST_BYTES, "EventTooLarge"),
        F.when(F.col("__minute") < 0, "InvalidValue"),
        F.when(v.isNull(), "MalformedJson"),
        F.when(~object_at("$"), "InvalidRoot"),
        _string(v, "$.type", TOKEN),
        _one_of(v, "$.type", ("record", "identity", "repo_sync"), "UnsupportedEventType"),
    )

    def envelope(name: str) -> Column:
        return F.coalesce(_exact(_keys(v, "$"), ("id", "type", name)), F.when(~F.coalesce(delivery > 0, F.lit(False)), "InvalidValue"), F.when(~object_at(f"$.{name}"), "InvalidValue"))

    action, collection = _text(v, "$.record.action"), _text(v, "$.record.collection")
    has = lambda name: F.array_contains(_keys(v, "$.record"), name)
    uri_field = {
        "app.bsky.feed.post": ("reply_parent_uri", False),
        "app.bsky.feed.like": ("subject_uri", True),
        "app.bsky.feed.repost": ("subject_uri", True),
        "app.bsky.graph.follow": ("subject_did", True),
    }
    metadata = F.lit(None).cast("string")
    for name, (prop, needed) in uri_field.items():
        path = f"$.record.metadata.{prop}"
        pattern = DID_FORM if prop == "subject_did" else r"^at://did:[a-z]+:[^/]+(/.*)?$"
        wrong = F.coalesce(F.when(~object_at("$.record.metadata"), "InvalidValue"), _exact(_keys(v, "$.record.metadata"), (prop,)), _string(v, path, DID + 2 * TOKEN), _form(v, path, pattern))
        metadata = F.coalesce(metadata, F.when((collection == name) & has("metadata"), wrong))
        if needed:
            metadata = F.coalesce(metadata, F.when((collection == name) & ~has("metadata"), "MissingProperty"))
    metadata = F.coalesce(metadata, F.when((collection == "app.bsky.actor.profile") & has("metadata"), "UnexpectedProperty"))
    deleted = F.when(has("cid") | has("metadata_status") | has("metadata"), "UnexpectedProperty")
    kept = F.coalesce(
        _string(v, "$.record.cid", CID),
        _string(v, "$.record.metadata_status", TOKEN),
        F.when((_text(v, "$.record.metadata_status") == "invalid") & has("metadata"), "UnexpectedProperty"),
        F.when(_text(v, "$.record.metadata_status") != "valid", "InvalidValue"),
        metadata,
    )
    record = F.coalesce(
        envelope("record"),
        _exact(_keys(v, "$.record"), ("live", "did", "rev", "collection", "rkey", "action"), ("cid", "metadata_status", "metadata")),
        _flag(v, "$.record.live"),
        _string(v, "$.record.did", DID),
        _form(v, "$.record.did", DID_FORM),
        _string(v, "$.record.rev", TOKEN),
        _form(v, "$.record.rev", TID),
        _string(v, "$.record.collection", TOKEN),
        _one_of(v, "$.record.collection", COLLECTIONS, "UnsupportedCollection"),
        _string(v, "$.record.rkey", RKEY),
        _string(v, "$.record.action", TOKEN),
        _one_of(v, "$.record.action", ACTIONS),
        F.when(action == "delete", deleted).otherwise(kept),
    )
    identity = F.coalesce(
        envelope("identity"),
        _exact(_keys(v, "$.identity"), ("did", "is_active", "status")),
        _string(v, "$.identity.did", DID),
        _form(v, "$.identity.did", DID_FORM),
        _flag(v, "$.identity.is_active"),
        _string(v, "$.identity.status", TOKEN),
        _one_of(v, "$.identity.status", STATUSES),
        F.when(F.try_variant_get(v, "$.identity.is_active", "boolean") != (_text(v, "$.identity.status") == "active"), "InvalidValue"),
    )
    sync = F.coalesce(
        envelope("repo_sync"),
        _exact(_keys(v, "$.repo_sync"), ("did", "rev", "status")),
        _string(v, "$.repo_sync.did", DID),
        _form(v, "$.repo_sync.did", DID_FORM),
        _string(v, "$.repo_sync.rev", TOKEN),
        _form(v, "$.repo_sync.rev", TID),
        _string(v, "$.repo_sync.status", TOKEN),
        _one_of(v, "$.repo_sync.status", ("active",)),
    )
    code = F.coalesce(root, F.when(kind == "record", record).when(kind == "identity", identity).when(kind == "repo_sync", sync))
    uri = F.coalesce(_text(v, "$.record.metadata.reply_parent_uri"), _text(v, "$.record.metadata.subject_uri"))
    did = F.coalesce(_text(v, "$.record.did"), _text(v, "$.identity.did"), _text(v, "$.repo_sync.did"))
    revision = F.coalesce(_text(v, "$.record.rev"), _text(v, "$.repo_sync.rev"))
    rkey, cid = _text(v, "$.record.rkey"), _text(v, "$.record.cid")
    parts = [F.coalesce(x, F.lit("")) for x in (did, revision, collection, rkey, action, cid)]
    semantic = F.sha2(F.concat(*(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in parts)), 256)
    good = code.isNull()
    columns = {
        "event": kind,
        "did": did,
        "live": F.try_variant_get(v, "$.record.live", "boolean"),
        "revision": revision,
        "collection": collection,
        "record_key": rkey,
        "action": action,
        "cid": cid,
        "target_did": F.coalesce(_text(v, "$.record.metadata.subject_did"), F.regexp_extract(uri, "^at://([^/]+)", 1)),
        "is_reply": F.when(collection == "app.bsky.feed.post", _text(v, "$.record.metadata.reply_parent_uri").isNotNull()),
        "status": F.coalesce(_text(v, "$.identity.status"), _text(v, "$.repo_sync.status")),
        "minute": F.col("__minute"),
        "semantic_key": F.when(kind == "record", semantic),
    }
    out = rows.withColumns({"code": code, "delivery_id": delivery})
    return out.select(*df.columns, "code", "delivery_id", *(F.when(good, c).alias(n) for n, c in columns.items()))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("code IS NULL")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("code IS NOT NULL")
