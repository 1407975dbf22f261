"""Helpers shared by the training-data operators: tables in the shared folder, reading inputs."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import discard, materialize, new_path, shared_dir

__all__ = ["discard", "map_arrow", "materialize", "new_path", "shared_dir", "ship", "small", "table"]
#: A table is broadcast up to so many rows and bytes of strings; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Rows of an Arrow batch, where the session has Spark's default of ten thousand: with texts that would be tens of megabytes, twice in each process.
ARROW_ROWS = "1000"
_SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that it needs no installation there."""
    context = spark.sparkContext
    if _SHIPPED.get("to") == context.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp()) / "arborql-package.zip"  # addPyFile copies it from the driver
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(str(packed))
    _SHIPPED["to"] = context.applicationId


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package on the executors and batches of a bounded size."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(function, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is small by rows and by bytes. df should be a written table, as this reads it."""
    wide = any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in df.schema.fields)
    held = F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))) if wide else F.lit(0)
    n, held = df.agg(F.count("*"), F.coalesce(held, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df
