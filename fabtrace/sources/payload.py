"""Landed order payloads: JSON objects holding an array of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabtrace.sources.schemas import ORDER_ELEMENT

ARRAY_KEY = "priorityOrders"


def orders_from_payload(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Orders of every payload in arrival order: the payload's columns, ``pos``, the 21 keys.

    A payload of another shape has no orders; see ``payload_errors``.
    """
    parsed = F.from_json(value, f"{ARRAY_KEY} array<struct<{ORDER_ELEMENT}>>")
    keep = [c for c in payloads.columns if c != value]
    exploded = payloads.select(*keep, F.posexplode(parsed[ARRAY_KEY]).alias("pos", "_order"))
    return exploded.select(*keep, "pos", "_order.*")


def payload_errors(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Payloads without the order array, with the keys they do have (null if not an object).

    What stands under the array's key but is no array, null too, counts as an error.
    """
    keys = F.json_object_keys(value)
    found = F.get_json_object(value, f"$.{ARRAY_KEY}")
    bad = ~F.coalesce(F.array_contains(keys, ARRAY_KEY) & found.startswith("["), F.lit(False))
    return payloads.where(bad).withColumn("keys_found", keys).drop(value)
