"""A manifest of lines that jobs append to, each job once: a Spark data source whose writer commits.

Each task writes a file of its own. The driver commits a job by one file that names the files of the tasks that count; files of failed attempts, and of jobs that
failed, are never named, and the lines of a job that has been committed are not added again. Readers take the lines of named files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "tessera_manifest"
LINES, COMMIT = "lines", "commit"


@dataclass
class Written(WriterCommitMessage):
    """The file of one task."""

    name: str


def _files(path: str):
    """A file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[Row]) -> Written:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex}.{LINES}"
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write(row[0].encode() + b"\n")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        done = f"{folder}/{self.job}.{COMMIT}"
        if files.get_file_info(done).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        # Written aside and renamed, so that a reader sees all of it or nothing.
        aside = f"{folder}/_{self.job}-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write("".join(f"{m.name}\n" for m in messages if m is not None).encode())
        files.move(aside, done)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _files(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/{m.name}")


class Manifest(DataSource):
    """Options: path, and job, the name under which the lines are added once."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite or len(schema) != 1:
            raise ValueError("one column is appended to a manifest")
        return Writer(self.options["path"], self.options["job"])


def append_once(rows: DataFrame, path: str, job: str | None = None) -> None:
    """Add a table's lines (its one string column) to a manifest, as a job that counts once however often it is run; without a name it is a job of its own."""
    from tessera.shipping import ship

    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Manifest)
    rows.write.format(FORMAT).option("path", path).option("job", job or uuid.uuid4().hex).mode("append").save()


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a manifest's committed jobs, with the job of each: value, job."""
    named = spark.read.text(f"{path}/*.{COMMIT}").withColumnRenamed("value", "file")
    lines = spark.read.schema("value string").text(f"{path}/*.{LINES}").withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]+$", 0))
    return lines.join(named, "file", "left_semi").select("value", F.regexp_extract("file", rf"^(.*)-[0-9a-f]{{32}}\.{LINES}$", 1).alias("job"))
