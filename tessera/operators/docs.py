"""Interface notes: names looked up in a dimension of signatures and docstrings, and set out as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.templates import PLAIN, fill
from tessera.functions.text import before_examples, strip

#: The signature of an unknown name, and the formats of the notes.
NO_SIGNATURE = "()"
CALL = "- **{name}**: signature `{sig}` - {doc}\n"
PROPERTY = "- **{name}** {sig} - {doc}"
ATTRIBUTE = "- **{name}** (attribute{sig}) - {doc}"
OTHER = "- **{name}** (property/variable) - {doc}"


def look_up(names: DataFrame, docs: DataFrame, name: str = "name") -> DataFrame:
    """names with sig and doc; a name without an entry gets an empty signature and a sentence that says so.

    The dimension has a row a documented name; Spark broadcasts it by itself where its size is small."""
    entries = docs.select(F.col("name").alias("_name"), "sig", "doc")
    found = names.join(entries, F.col(name) == F.col("_name"), "left").drop("_name")
    return found.withColumns({"sig": F.coalesce("sig", F.lit(NO_SIGNATURE)), "doc": F.coalesce("doc", fill(PLAIN["no_doc"], invalid_param=F.col(name)))})


def _summary(doc: Column) -> Column:
    return F.when(doc.contains("Examples"), before_examples(doc)).otherwise(strip(doc))


def call_lines(entries: Column) -> Column:
    """Text of an array of struct(name, sig, doc) for calls: an item each, with an empty line between."""
    return F.array_join(F.transform(entries, lambda e: fill(CALL, name=e["name"], sig=e["sig"], doc=_summary(e["doc"]))), "\n")


def assignment_lines(entries: Column) -> Column:
    """The same for attributes, worded by what the signature says; empty for no entries."""

    def line(e: Column) -> Column:
        said = {"name": e["name"], "sig": e["sig"], "doc": _summary(e["doc"])}
        return F.when(e["sig"].startswith("@property"), fill(PROPERTY, **said)).when(e["sig"].startswith(":"), fill(ATTRIBUTE, **said)).otherwise(fill(OTHER, **said))

    return F.when(F.size(entries) > 0, F.concat(F.array_join(F.transform(entries, line), "\n"), F.lit("\n"))).otherwise("")


def block(assignments: Column, calls: Column) -> Column:
    return F.concat(assignment_lines(assignments), F.lit("\n"), call_lines(calls))


def notes(programs: DataFrame, docs: DataFrame, key: str, calls: str = "calls", assignments: str = "assignments") -> DataFrame:
    """key and api_info: the notes on the names of each program (two array columns)."""
    long = programs.select(key, F.explode(F.concat(F.transform(calls, lambda n: F.struct(F.lit(True).alias("call"), n.alias("name"))), F.transform(assignments, lambda n: F.struct(F.lit(False).alias("call"), n.alias("name"))))).alias("x")).select(key, "x.*")
    entry = F.struct("name", "sig", "doc")
    found = look_up(long, docs).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("call"), entry))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("call"), entry))).alias("a"))
    none = F.array().cast("array<struct<name: string, sig: string, doc: string>>")
    return programs.select(key).join(found, key, "left").select(key, block(F.coalesce("a", none), F.coalesce("c", none)).alias("api_info"))
