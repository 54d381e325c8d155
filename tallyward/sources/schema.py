"""Explicit schemas of the canonical inputs; a mismatch fails before any work starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Vocabularies of the data model.
ASN_TYPES = ["residential", "mobile", "datacenter", "university", "corporate"]
ENDPOINTS = ["/v1/chat", "/v1/completions", "/v1/embeddings"]
NORMAL = "normal"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


def event_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return _struct(
        ("event_id", T.LongType()),
        ("user_id", id_type),
        ("ts", T.LongType()),
        ("ip", T.StringType()),
        ("asn", T.LongType()),
        ("asn_type", T.StringType()),
        ("country", T.StringType()),
        ("device_fp", T.StringType()),
        ("user_agent", T.StringType()),
        ("endpoint", T.StringType()),
        ("prompt_cluster", T.StringType()),
        ("prompt_text", T.StringType()),
        ("tokens_used", T.LongType()),
        ("success", T.BooleanType()),
    )


def account_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    return _struct(
        ("user_id", id_type),
        ("label", T.StringType()),
        ("subtype", T.StringType()),
        ("ring_id", T.StringType()),
        ("username", T.StringType()),
        ("created_at", T.LongType()),
        ("signup_country", T.StringType()),
        ("payment_hash", T.StringType()),
        ("tz_offset", T.DoubleType()),
        ("takeover_ts", T.LongType()),
        ("evasion", T.DoubleType()),
        ("label_noisy", T.StringType()),
    )


LONG, INT, DOUBLE, TEXT, TIME = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

# Columns of the given tables that the canonical views are made from.
GIVEN = {
    "customer": _struct(("c_custkey", LONG), ("c_name", TEXT), ("c_nationkey", INT), ("c_acctbal", DOUBLE), ("c_mktsegment", TEXT)),
    "documents": _struct(("doc_id", LONG), ("text", TEXT), ("lang", TEXT), ("source", TEXT), ("n_chars", LONG)),
    "embeddings": _struct(("vec_id", LONG), ("embedding", T.ArrayType(T.FloatType())), ("label", INT)),
    "events": _struct(("event_id", LONG), ("ts", TIME), ("user_id", LONG), ("event_type", TEXT), ("value", DOUBLE), ("props", TEXT)),
    "labels": _struct(("doc_id", LONG), ("quality", INT), ("toxic", INT)),
    "lineitem": _struct(
        ("l_orderkey", LONG), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_linenumber", INT), ("l_quantity", DOUBLE),
        ("l_extendedprice", DOUBLE), ("l_discount", DOUBLE), ("l_tax", DOUBLE), ("l_returnflag", TEXT), ("l_linestatus", TEXT),
        ("l_shipdate", TIME),
    ),
    "orders": _struct(
        ("o_orderkey", LONG), ("o_custkey", LONG), ("o_orderstatus", TEXT), ("o_totalprice", DOUBLE), ("o_orderdate", TIME),
        ("o_orderpriority", TEXT),
    ),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; raises when one is absent or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [
        f"{f.name}: want {f.dataType.simpleString()}, have {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if bad:
        raise ValueError("schema mismatch: " + "; ".join(bad))
    return df.select(*schema.names)
