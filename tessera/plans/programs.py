"""Queries: edit scripts and data flow of programs of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import rounded
from tessera.operators import codebleu, dataflow, treescript
from tessera.plans.registry import query
from tessera.plans.similarity import _CHANGED_SQL, _NEXT_SQL, _programs
from tessera.sources.store import spread, table


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Programs of three shapes (a loop, a chain of branches, a class with a closure), with names from the parts' names and as many repeated lines as the size says; one in eleven doesn't
    parse. expected is the program of the next part, of another shape."""
    w = F.split("p_name", " ")
    v, u = F.concat(F.lit("v_"), F.regexp_replace(w[0], "[^A-Za-z]", "")), F.concat(F.lit("u_"), F.regexp_replace(w[1], "[^A-Za-z]", ""))
    more = (F.col("p_size") % 4).cast("int")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    times = lambda n, line: F.repeat(line, n)
    loop = text("def ", u, "(items):\n    ", v, " = 0\n    for x in items:\n", times(more + 1, text("        ", v, " = ", v, " + x\n")), "    return ", v, "\n")
    chain = text("def ", u, "(", v, "):\n    b = ", v, "\n    if ", v, ":\n        b = 1\n", times(more, text("    elif ", v, ":\n        b = 1\n")), "    c = b\n    return c\n")
    shown = text("class Show(", u, "):\n    def construct(self):\n        ", v, " = Circle(1)\n        self.b = ", v, "\n        def inner():\n            return ", v, "\n        c = inner\n", times(more, F.lit("        d = c\n")))
    kind = F.col("p_partkey") % 3
    good = F.when(kind == 0, loop).when(kind == 1, chain).otherwise(shown)
    part = table(spark, d, "part")
    made = part.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.concat(good, F.lit("  )"))).otherwise(good).alias("code"))
    both = made.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), good.alias("expected")), "p_partkey", "left")
    return spread(both, "p_partkey")


_MORE = "(p_size % 4)"
_REST = "list_transform(range(1, {0} + 1), lambda r: {1})"
#: Variables are numbered as they come: the function, its argument, then the names that it defines or reads.
_EDGES_SQL = f"""CASE p_partkey % 3
  WHEN 0 THEN list_concat([[0, -1, -1], [1, -1, -1], [2, -1, -1], [3, 1, 0], [2, 2, 0], [2, 2, {_MORE} + 1], [2, 3, 0]], flatten({_REST.format(_MORE, "[[2, 2, r], [2, 3, 0]]")}))
  WHEN 1 THEN list_concat([[0, -1, -1], [1, -1, -1], [2, 1, 0], [2, -1, -1]], {_REST.format(_MORE, "[2, -1, -1]")}, [[3, 2, 0], [3, 2, 1]], {_REST.format(_MORE, "[3, 2, r + 1]")})
  ELSE list_concat([[0, 1, -1], [2, -1, -1], [3, -1, -1], [4, 5, -1], [3, 4, 0], [3, 3, 0], [6, -1, -1], [7, 6, 0]], {_REST.format(_MORE, "[8, 7, 0]")}) END"""


@query(f"""
SELECT p_partkey, CAST(i - 1 AS INT) AS step, CAST(e[i][1] AS INT) AS variable, CAST(e[i][2] AS INT) AS source, CAST(e[i][3] AS INT) AS definition
FROM (SELECT p_partkey, {_EDGES_SQL} AS e FROM part WHERE p_partkey % 11 <> 0), unnest(range(1, len(e) + 1)) u(i)""")
def dataflow_edges(spark: SparkSession, d: str) -> DataFrame:
    """What each definition is computed from, through branches, loops and scopes."""
    found = _varied(spark, d).select("p_partkey", F.posexplode(dataflow.flow_edges("code")).alias("step", "e"))
    return found.select("p_partkey", "step", "e.variable", "e.source", "e.definition")


def _count(edits: Column, op: str) -> Column:
    return F.size(F.filter(edits, lambda e: e["op"] == op)).cast("long")


@query(f"""
SELECT p_partkey, CASE WHEN blank THEN 91 ELSE changed END AS distance, CASE WHEN blank THEN 91 ELSE 0 END AS inserted, 0 AS deleted, CASE WHEN blank THEN 0 ELSE changed END AS renamed
FROM (SELECT p.p_partkey, p.p_partkey % 7 = 0 AS blank, CAST({_CHANGED_SQL} AS INT) AS changed FROM {_NEXT_SQL} WHERE p.p_partkey % 11 <> 0)""")
def tree_script_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes a cheapest script inserts, deletes and renames."""
    t = _programs(spark, d).where("expected IS NOT NULL").select("p_partkey", treescript.code_script()("code", "expected").alias("t")).where("t.distance IS NOT NULL")
    return t.select("p_partkey", F.col("t.distance").alias("distance"), *[_count(F.col("t.edits"), op).alias(f"{op.removesuffix('e')}ed") for op in ("insert", "delete", "rename")])


@query()
def tree_script(spark: SparkSession, d: str) -> DataFrame:
    """The edits between programs of different shapes, a row each."""
    t = _varied(spark, d).where("expected IS NOT NULL").select("p_partkey", treescript.code_script()("code", "expected").alias("t"))
    return t.select("p_partkey", F.explode("t.edits").alias("e")).select("p_partkey", "e.op", "e.i", "e.j", "e.was", "e.becomes")


@query()
def tree_within(spark: SparkSession, d: str) -> DataFrame:
    """Programs of at most 40 edits from the expected one; those whose labels and numbers of children alone say that they are further apart are not compared."""
    t = _varied(spark, d).where("expected IS NOT NULL").select("p_partkey", treescript.code_script(40)("code", "expected").alias("t"))
    return t.select("p_partkey", "t.at_least", "t.distance", F.coalesce(F.col("t.distance") <= 40, F.lit(False)).alias("within"))


@query()
def codebleu_varied(spark: SparkSession, d: str) -> DataFrame:
    """Matches of programs of different shapes."""
    found = codebleu.codebleu(_varied(spark, d).where("expected IS NOT NULL"), ["p_partkey"], "code", "expected")
    return found.select("p_partkey", *[rounded(F.col(c)).alias(c) for c in ("ngram", "weighted", "syntax", "dataflow", "codebleu")])
