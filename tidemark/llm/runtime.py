"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application.

    Functions handed to Arrow operators are pickled by reference, so the workers
    must be able to import the package even where it isn't installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset, and driver and
    executors are one process, a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = os.path.join(tempfile.gettempdir(), "tidemark-shared")
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage; the files outlive any executor and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    # Nothing reads the shuffles of a finished table again: Spark removes them at once.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def keyed(documents: DataFrame) -> DataFrame:
    """(r1, r2, doc_id, text, row): 128 bits that name a row by all its columns, and the row."""
    cols: list[Column] = []
    for f in documents.schema:
        value = F.col(f"`{f.name}`")
        cols += [F.to_json(F.struct(value)) if "map<" in f.dataType.simpleString() else value, value.isNull()]  # hashes skip nulls
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    return documents.select(F.xxhash64(*cols).alias("r1"), F.xxhash64(F.lit("second"), *cols).alias("r2"), "doc_id", "text", row.alias("row"))


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold about ``most`` bytes of ``column``.

    A single row above that stays whole: texts are never cut here.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start, n - start)


def training_rows(spark_id: str, modulus: int, held: int):
    """Condition: a document may be learned from.  crc32 of the id's decimal digits
    modulo ``modulus`` is ``held`` for held-out documents."""
    return ~held_out(spark_id, modulus, held)


def held_out(spark_id: str, modulus: int, held: int):
    return F.coalesce(F.crc32(F.col(spark_id).cast("string")) % modulus == held, F.lit(False))
