"""Column names, projection, sampling and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy(name: str, strip: bool = True) -> str:
    """A column name in lower case with underscores for spaces."""
    return (name.strip() if strip else name).lower().replace(" ", "_")


def normalise_names(df: DataFrame, strip: bool = True, like: list[str] | None = None) -> DataFrame:
    """df with tidy names. `like`: the columns of another table that df must have too."""
    if like is not None and list(like) != df.columns:
        raise ValueError(f"columns differ: {sorted(set(like) ^ set(df.columns)) or 'in order'}")
    names = [tidy(c, strip) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash once tidy: {names}")
    return df.toDF(*names)


def require(df: DataFrame, x: str, y: str) -> DataFrame:
    """df, or an error that lists which of two columns it lacks."""
    if missing := [c for c in (x, y) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def only(df: DataFrame, *columns: Column) -> DataFrame:
    """The new columns alone."""
    return df.select(*columns)


def spread(df: DataFrame, *groups: str) -> DataFrame:
    """df with the fields of struct columns in place of columns of the same name; later groups win."""
    fields: dict[str, Column] = {c: F.col(c) for c in df.columns if c not in groups}
    for g in groups:
        fields |= {f.name: F.col(f"{g}.{f.name}") for f in df.schema[g].dataType.fields}
    return df.select(*[c.alias(k) for k, c in fields.items()])


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order; all where n is not above 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def sample_exactly(df: DataFrame, n: int, *key: str, seed: int = 1230) -> DataFrame:
    """n rows (or all), the same for the same seed: those whose key has the smallest hash. Top-n a partition, then top-n: no full sort."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]).cast("binary"))
    return df.withColumn("_mark", mark).orderBy("_mark", *key).limit(n).drop("_mark")


def batches(df: DataFrame, size: int, partition: list[str], *order: str) -> DataFrame:
    """df and batch: rows of a partition in order, `size` to a batch."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def global_row_number(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df and its place in a total order, from 0. Ranges are sorted apart and counted, so no task sees all rows.

    The ranges are written before they are counted: bounds are sampled, and would differ if they were worked out twice."""
    from tessera.sources.store import written

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    # A row for each range: the broadcast is as long as the number of shuffle partitions.
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def decimate(df: DataFrame, stride: Column, partition: list[str], *order: str) -> DataFrame:
    """Every stride-th row of each partition, from the first, with its place as `frame_idx`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("frame_idx", F.row_number().over(w) - 1).where(F.pmod(F.col("frame_idx"), stride) == 0)
