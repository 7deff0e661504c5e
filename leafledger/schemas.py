"""Fixed schemas of the vault tables; a table that differs is refused, never repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "i": T.IntegerType()}


def _schema(spec: str) -> T.StructType:
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEMAS = {
    "files": _schema(
        "vault_id:s path:s rev:l seq:l hash:s size:l kind:s content:s blob_hash:s renamed_to:s deleted:b updated_at:l origin:s"
    ),
    "revisions": _schema("vault_id:s path:s rev:l hash:s size:l kind:s content:s blob_hash:s deleted:b origin:s at_ms:l"),
    "changes": _schema("vault_id:s seq:l op:s path:s rev:l hash:s from_path:s from_rev:l origin:s at_ms:l"),
    "receipts": _schema("vault_id:s client_id:s op_key:s fingerprint:s status:i body:s at_ms:l"),
    "pins": _schema("vault_id:s export_id:s path:s rev:l"),
    "blob_inventory": _schema("vault_id:s hash:s size:l"),
    "observations": _schema("vault_id:s client_id:s protocol:s feed_request:b observed_at:l duration_ms:l arrival:l"),
    "ops": _schema(
        "vault_id:s arrival:l op:s path:s to_path:s client_id:s op_key:s fingerprint:s expect:s expected_rev:l kind:s size:l "
        "payload_hash:s content:s heading:s source_rev:l as_conflict_copy:b at_ms:l"
    ),
    "local_events": _schema("device_id:s vault_id:s arrival:l path:s event:s to_path:s hash:s at_ms:l"),
}


class SchemaMismatch(ValueError):
    """The stored table does not have the fixed schema."""


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of table ``name``, or :class:`SchemaMismatch`."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in SCHEMAS[name]}
    wrong = sorted(n for n, t in want.items() if have.get(n) != t)
    if wrong:
        raise SchemaMismatch(f"{name}: missing or wrong columns {wrong}")
    return df.select(*want)
