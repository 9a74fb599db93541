"""Schemas of the tables. Money is whole micros in 64 bits, instants are UTC microseconds, and a map is
stored as canonical JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["merchant_id", "merchant_product_id"]


def _fields(spec: str) -> T.StructType:
    """``name type`` pairs; a name that ends in ? may be null."""
    out = T.StructType()
    for item in spec.split(","):
        name, kind = item.split()
        out.add(name.rstrip("?"), _TYPES[kind], name.endswith("?"))
    return out


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "texts": T.MapType(T.StringType(), T.StringType())}

CONTENT = _fields("title? string, description? string, price_micros? long, currency? string, availability? string, attributes? texts")

LANDING = _fields("partition int, seq int, merchant_id string, merchant_product_id string, source_version long, op string, listing? string, submission_id string, change_index int, received_at timestamp")
STORE = _fields("partition int, merchant_id string, merchant_product_id string, source_version long, content_hash string, is_tombstone boolean, title? string, description? string, price_micros? long, currency? string, availability? string, attributes? string, primary_category? string, classify_confidence? double, taxonomy_version? string, needs_reclassify boolean, updated_at timestamp")
SUBMISSIONS = _fields("hour string, submission_id string, change_index int, merchant_id string, accepted boolean, received_at timestamp")
OUTCOMES = _fields("hour string, submission_id string, change_index int, outcome string")

#: Outcomes, best first: a replay can only look worse than what a change got before.
RANKS = ["written", "reclassified", "already_applied", "conflict", "stale", "skipped", "failed", "rejected"]
PENDING, UNCATEGORIZED = "pending", "Uncategorized"
