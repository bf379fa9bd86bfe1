"""Written intermediate tables: cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: The JVM interprets methods of more bytes than this for good: a step whose generated method is larger runs in small ones.
METHOD_BYTES = "8000"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Runs what is inside without generated methods that the JVM does not compile, unless the session has its own limit."""
    own = METHOD_LIMIT in spark.conf.getAll
    if not own:
        spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(METHOD_LIMIT)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session in `spark.checkpoint.dir`. Only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="capsule-stage-", dir="/tmp")
    return _local[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back (columns prune, filters push down)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with compiled(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
