"""What the operators of this subpackage share: session settings, scratch tables, held-out rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker holds few texts at once, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="zastera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/zastera/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a scratch table of which nothing is read any more, and has Spark drop the shuffle files of ended jobs."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # Spark's cleaner drops what the driver no longer refers to


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(docs: DataFrame, new: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with the new columns that work makes of a batch of texts; columns of the same names give way, others stay as they are, whatever they are called."""
    names = [f.name for f in new]
    kept = [c for c in docs.columns if c not in names]
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in kept if c != "text")).alias("others"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.StructArray.from_arrays(work(b.column(0)), names)], ["text", "others", "new"])

    rows = packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("new", T.StructType(new))]))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in kept), *(F.col(f"new.`{c}`") for c in names))


#: Rows whose ids are broadcast at most; more are joined by shuffle.
MOST_IDS = 4_000_000


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those whose monotonically_increasing_id() is in rows (row); docs has to read the same way twice."""
    rows = scratch(rows.select("row"), "rows")
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = F.broadcast(rows) if rows.count() <= MOST_IDS else rows
    return packed.join(rows, "row", "left_anti").select("doc.*")
