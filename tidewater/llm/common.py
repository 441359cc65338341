"""Helpers shared by the document operators: batch mapping, exact numbering, checkpoints."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidewater.session import cut_lineage

__all__ = ["cut_lineage", "map_batches", "read", "number_rows", "row_buckets", "ship_package", "WORD_SPLIT"]

# Words are maximal runs of characters outside this class (space and \x09-\x0D).
WORD_SPLIT = r"[\x20\x09-\x0D]+"

BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"

# Rows of one numbering bucket: bounds what a single window task sorts.
BUCKET_ROWS = 20_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application (Spark's own file distribution).

    Also lowers the bytes of an Arrow batch from Spark's default, unless the caller has set them: the JVM
    and the worker each hold a batch several times while a text column passes.
    """
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidewater-py-")) / "tidewater_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._tidewater_shipped = sc.applicationId


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType | str) -> DataFrame:
    """Map Arrow batches of ``df`` through ``fn`` (batch -> dict of equally long columns).

    Batches are bounded in rows and bytes, and a worker holds one at a time; ``fn`` must
    not keep rows between batches.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in arrow],
                    schema=arrow)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, struct)


def row_buckets(n_rows: int) -> int:
    return max(1, -(-n_rows // BUCKET_ROWS))


def number_rows(df: DataFrame, n_rows: int, key: Column | None, unique: Column, name: str) -> DataFrame:
    """Gapless numbers from 0 (within ``key`` if given) without gathering a key in one task.

    ``unique`` must tell rows apart and be stable under retries (take it from a
    checkpointed table).  Rows are spread over hash buckets of about BUCKET_ROWS;
    each bucket is numbered alone, and the offsets come from a window over the
    small table of bucket counts.
    """
    b = row_buckets(n_rows)
    k = key if key is not None else F.lit(0)
    d = df.withColumn("_k", k).withColumn("_u", unique).withColumn("_b", F.pmod(F.xxhash64("_u"), F.lit(b)))
    counts = d.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_u")) - 1
    return (d.withColumn("_r", local)
            .join(offsets, ["_k", "_b"])
            .withColumn(name, (F.col("_r") + F.col("_o")).cast("long"))
            .drop("_k", "_u", "_b", "_r", "_o"))
