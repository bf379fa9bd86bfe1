"""Scans of the item tables, the vector codec, sharded scans and JSON corpora."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule import fixed

col = F.col


def list_items(items: DataFrame, user: int | str | None = None, status: str | None = None,
               category: str | None = None) -> DataFrame:
    """Items in closet order (creation time, then id) of one user, or of all users. Each user's rows stand together in
    one partition; users are in no order among each other."""
    out = items
    for name, value in (("user_id", user), ("status", status), ("category", category)):
        if value is not None:
            out = out.where(col(name) == value)
    if user is not None:
        return out.orderBy("created_at", "item_id")
    return out.repartition("user_id").sortWithinPartitions("user_id", "created_at", "item_id")


def keyed(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a table for a frame of keys, always within the owner."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def embeddings_for(embeddings: DataFrame, ids: DataFrame, kind: str, model: str | None = None) -> DataFrame:
    out = embeddings.where(col("kind") == kind)
    if model is not None:
        out = out.where(col("model") == model)
    return out.join(ids.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")


def decode_vectors(df: DataFrame, blob: str, out: str) -> DataFrame:
    """Binary float32 column to ARRAY<FLOAT>, batch-wise."""
    keep = [f for f in df.schema.fields if f.name != blob]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", {out} array<float>"

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(blob))
            lists = [None if v is None else np.frombuffer(v, dtype="<f4") for v in column.to_pylist()]
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lists, pa.list_(pa.float32()))],
                                             names=[*(f.name for f in keep), out])

    return df.mapInArrow(run, schema)


def encode_vectors(df: DataFrame, vector: str, out: str) -> DataFrame:
    """ARRAY<FLOAT> column to little-endian float32 bytes, batch-wise."""
    keep = [f for f in df.schema.fields if f.name != vector]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", {out} binary"

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(vector))
            blobs = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in column.to_pylist()]
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(blobs, pa.binary())],
                                             names=[*(f.name for f in keep), out])

    return df.mapInArrow(run, schema)


def scan_shards(spark: SparkSession, path: str, columns: Sequence[str], ids: DataFrame | None = None,
                key: str = "item_id") -> DataFrame:
    """Parquet shards with only the asked columns, the shard each row came from, and a semi join on ids."""
    out = spark.read.parquet(path).select(*columns, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"))
    return out if ids is None else out.join(ids.select(key).distinct(), key, "left_semi")


def price_rules(spark: SparkSession) -> DataFrame:
    """The ordered price rules as a table."""
    return spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(fixed.PRICE_RULES)],
                                 "ord int, regex string, price double")


def material_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in fixed.MATERIALS.items()],
                                 "material string, co2e_kg_per_kg double, water_l_per_kg double")


def garment_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in fixed.GARMENTS.items()],
                                 "garment_type string, weight_kg double, per_pair_co2e_kg double, base_wears double")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule file {"rules": [[regex, price], ...]} as ordered rows."""
    raw = spark.read.schema("rules array<array<string>>").json(path, multiLine=True)
    return raw.select(F.posexplode("rules").alias("ord", "r")).select(
        "ord", F.get("r", 0).alias("regex"), F.get("r", 1).cast("double").alias("price"))


def labelled_sets(documents: DataFrame, text: Column) -> DataFrame:
    """JSON sets {"set_id", "items": [{"item_id", "index"}]} as one row per member."""
    schema = "set_id string, items array<struct<item_id:string, index:int>>"
    return (documents.select(F.from_json(text, schema).alias("s")).select("s.set_id", F.inline("s.items")))
