"""Column expressions for names, paths, ids, hashes, statuses and cursors."""

from __future__ import annotations

import json
import unicodedata
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ledgerloom.functions.merge import same

# Budgets, statuses and identifier patterns.
MAX_DEPTH = 16
MAX_NAME_CHARACTERS = 128
MAX_NAME_BYTES = 512
MAX_REQUEST_BYTES = 256 * 1024
MAX_SNAPSHOT_BYTES = 256 * 1024
MAX_PAGE = 50
MAX_CHANGES = 64
REQUEST_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}$"
NODE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{3,127}$"
EPOCH = r"^[0-9a-fA-F]{32}$"
LOCAL_STATUSES = ("local_pending", "sending", "cloud_acknowledged", "waiting_dependency", "delivery_blocked", "cancelled")
EFFECTS = ("pending", "applied", "applied_noop", "conflict", "cancelled", "needs_attention")
BACKOFF_SECONDS = (30, 60, 120, 240, 480)
MAX_FAILURES = 5
LEASE_SECONDS = 300
CLIENT_LEASE_SECONDS = 60
PERMANENT_CODES = ("request_id_conflict", "workspace_epoch_mismatch", "invalid_request")
PREFIX = "ll1:"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def name_problem(name: Column) -> Column:
    """Why a (normalised) name is not allowed; null if it is."""
    return (
        F.when(name.isNull(), "not_a_string")
        .when(name == "", "empty")
        .when(name.isin(".", ".."), "dot_segment")
        .when(name.contains("/") | name.contains("\\"), "separator")
        .when(F.length(name) > MAX_NAME_CHARACTERS, "characters")
        .when(F.octet_length(name) > MAX_NAME_BYTES, "bytes")
    )


def path_problem(path: Column) -> Column:
    return F.when(path.isNull(), "not_array").when(F.size(path) > MAX_DEPTH, "depth").otherwise(F.get(F.filter(F.transform(path, name_problem), lambda p: p.isNotNull()), F.lit(0)))


def display_path(path: Column) -> Column:
    return F.array_join(path, "/")


def overlaps(left: Column, right: Column) -> Column:
    """One path is a prefix of the other."""
    n = F.least(F.size(left), F.size(right))
    return F.when(n == 0, F.lit(True)).otherwise(F.slice(left, F.lit(1), F.greatest(n, F.lit(1))) == F.slice(right, F.lit(1), F.greatest(n, F.lit(1))))


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def derived_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 40 hex digits of the SHA-256 of the parts, joined by a zero character."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 40))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys; null for text that is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def _object(value: Column, fields: dict[str, str | None]) -> Column:
    """Canonical JSON of some fields of a parsed object; one that is missing has the text given for it, or is left out."""
    parts = []
    for name in sorted(fields):
        text = F.to_json(F.try_variant_get(value, f"$.{name}", "variant"))
        parts.append(F.concat(F.lit(f'"{name}":'), text if fields[name] is None else F.coalesce(text, F.lit(fields[name]))))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


# The fields that each hash of a request covers, with what stands for a missing one.
CONTENT_FIELDS = dict.fromkeys(("workspaceEpoch", "requestId", "operation", "target", "dependsOn", "baseRevision", "changes", "confirmation", "replaces"))
PAYLOAD_FIELDS = {"operation": None, "baseRevision": "null", "changes": "null"}
CLIENT_FIELDS = {"protocol": None, "apiVersion": None, "workspaceEpoch": None, "requestId": None, "operation": None, "target": "null", "dependsOn": "[]", "baseRevision": "null", "changes": "null", "confirmation": "null"}


def request_hash(raw: Column, fields: dict[str, str | None] = CONTENT_FIELDS) -> Column:
    """SHA-256 of the canonical JSON of a request's fields, from its JSON text; other fields do not count. Null for text that is no JSON."""
    value = F.try_parse_json(raw)
    return F.when(value.isNotNull(), F.sha2(_object(value, fields), 256))


@F.pandas_udf(BooleanType())
def json_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    """Equal JSON values, numbers by value; text that is no JSON equals nothing, and two missing ones are equal."""
    def equal(a: str | None, b: str | None) -> bool:
        if a is None or b is None:
            return a is b
        try:
            return same(json.loads(a), json.loads(b))
        except ValueError:
            return False

    return pd.Series([equal(a, b) for a, b in zip(left, right)], dtype=bool)


def add_seconds(ts: Column, seconds: Column | int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds if isinstance(seconds, Column) else F.lit(seconds))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def backoff(failures: Column) -> Column:
    """Seconds to wait after so many failures; null where the task is parked instead."""
    return F.when(failures < MAX_FAILURES, F.element_at(F.array(*map(F.lit, BACKOFF_SECONDS)), F.greatest(failures, F.lit(1)).cast("int")))


def page_size(limit: Column | int | None, default: int = 20) -> Column:
    """0 and null give the default, negative numbers 1, and more than a page a page."""
    value = F.lit(limit).cast("int") if not isinstance(limit, Column) else limit
    return F.least(F.greatest(F.when(value.isNull() | (value == 0), default).otherwise(value), F.lit(1)), F.lit(MAX_PAGE))


def display_status(local: Column, effect: Column) -> Column:
    """What a user is told: projected only where the effect is real."""
    return (
        F.when(~local.isin(*LOCAL_STATUSES), "invalid_local_status")
        .when(effect.isNotNull() & ~effect.isin(*EFFECTS), "invalid_effect_status")
        .when(local != "cloud_acknowledged", local)
        .when(effect.isin("applied", "applied_noop"), "projected")
        .when(effect.isin("conflict", "needs_attention", "cancelled"), effect)
        .otherwise("d1_committed")
    )


def display_for(local: Column, effect: Column, target_deleted: Column) -> Column:
    """The same, where a deleted target shows as cancelled."""
    return F.when(F.coalesce(target_deleted, F.lit(False)), "cancelled").otherwise(display_status(local, effect))


def abort_reason(message: Column) -> Column:
    """The guard that a failed batch names."""
    out = F.lit(None).cast("string")
    # The guards' codes.
    for code in ("snapshot_revision_regression", "deletion_gate_blocks_write", "stale_snapshot_revision", "stale_node_state", "stale_catalog_revision", "stale_task_write"):
        out = F.when(message.contains(code), code).otherwise(out)
    return out


def rename_target(target_name: Column, changes: Column) -> Column:
    """The new name of a rename: in the target, else set by a change of the path ["name"]."""
    hit = F.filter(changes, lambda c: (c["op"] == "set") & (c["path"] == F.array(F.lit("name"))))
    return F.coalesce(target_name, F.get(hit, F.lit(0))["value"])


def encode_cursor(fields: dict) -> str:
    return PREFIX + quote(json.dumps(fields, sort_keys=True, separators=(",", ":")), safe="")


def decode_cursor(cursor: str) -> dict:
    """The fields of a cursor; ValueError ``cursor_invalid`` for anything else."""
    try:
        prefix, _, rest = cursor.partition(":")
        fields = json.loads(unquote(rest, errors="strict"))
        if prefix + ":" != PREFIX or not isinstance(fields, dict):
            raise ValueError
        return fields
    except (ValueError, AttributeError):
        raise ValueError("cursor_invalid") from None


def cursor_column(*fields: tuple[str, Column]) -> Column:
    """``encode_cursor`` of a row."""
    return F.concat(F.lit(PREFIX), F.url_encode(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields, key=lambda x: x[0]))))))
