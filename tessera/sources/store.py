"""Tables, shared intermediate results, and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of files a core from which a table is read as its files have it.
SMALL = 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt out to all cores if it is a small table of fewer files than cores, for a file of one row group is one task's work whatever the number
    of cores. Larger tables are never shuffled for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out evenly for much work a row, whatever its files hold: one file of short rows is one task's work up to millions of them."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which every executor sees; what is written there goes when the session's process ends.

    Where that is unset, a folder of this machine's will do for a local master (tests); on a cluster it is an error, for each executor would write to a disk of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    folder = f"{sc._jsc.sc().getCheckpointDir().get().rstrip('/')}/tessera"
    if folder not in _ours:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _ours.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_ours: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the table of a written() result that nothing will read any more."""
    if path := getattr(df, "_written_at", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """name (relative to the folder, however deep), size and time of every file there that is not empty; on any file system that Spark reads, and without opening one.

    Spark lists large folders in the executors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # Local paths come with one slash or three.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return found.select(plain(F.col("path")).substr(F.length(plain(F.lit(whole))) + 2, F.length("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def only_with_files(rows: DataFrame, files: DataFrame, name: str, *scores: str) -> DataFrame:
    """rows with their scores where a file of the given name is there and not empty, 0 elsewhere; a null name has no file. Names are joined, each once."""
    there = files.where("size > 0").select(F.col("name").alias(name)).distinct().withColumn("_there", F.lit(True))
    found = rows.join(there, name, "left")
    return found.select(*[F.when(F.col("_there"), F.col(f"`{c}`")).otherwise(F.lit(0)).cast(rows.schema[c].dataType).alias(c) if c in scores else F.col(f"`{c}`") for c in rows.columns])


#: The parts of a result file's name, and how its time is written.
RESULT_PREFIX, ADAPTER_PREFIX, RESULT_TIME = "eval_result_", "_peft_", "yyyyMMdd_HHmmss"


def result_name(mode: str, model: Column, adapter: Column, at: Column) -> Column:
    """Name of a result file: mode, model, adapter if any, and the time to the second."""
    from tessera.functions.fusion import adapter_label, sanitised

    part = F.when(F.coalesce(adapter, F.lit("")) == "", "").otherwise(F.concat(F.lit(ADAPTER_PREFIX), adapter_label(adapter)))
    return F.concat(F.lit(f"{RESULT_PREFIX}{mode}_"), sanitised(model), part, F.lit("_"), F.date_format(at, RESULT_TIME), F.lit(".csv"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A CSV table with a header and a leading row_idx; part files, so that any size can be written."""
    from tessera.operators.columns import global_row_number

    rows = global_row_number(df, "row_idx", *order) if order else df.withColumn("row_idx", F.monotonically_increasing_id())
    rows.select("row_idx", *df.columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def append_manifest(spark: SparkSession, manifest: str | None, *lines: str, rows: DataFrame | None = None) -> None:
    """Add lines, or a table of them (one string column), to a manifest folder; nothing where there is none."""
    if manifest is None:
        return
    if lines:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(manifest)
    if rows is not None:
        rows.write.mode("append").text(manifest)


def show_summary(df: DataFrame) -> None:
    df.show(truncate=False, vertical=True)
