"""Queries: tokens, vectors, programs, frames, loops and sinks."""

from __future__ import annotations

import string
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequence, templates, text, tokens, vectors
from tessera.functions.vectors import rounded
from tessera.operators import codebleu, codegraph, columns, docs, evaluate, frames, loop, rewards, samples, treedist, visual
from tessera.plans.registry import ORACLES, query
from tessera.plans.responses import PAIRS_SQL, pairs
from tessera.plans.scores import LINE, r6
from tessera.sources import external, store
from tessera.sources.store import spread, table

_IDS_SQL = "list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> ''), lambda w: CAST(length(w) % 1000 AS INT))"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokens.white_space_ids(F.col("text")).alias("ids"))


def _text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


_PAD_SQL = "list_concat(ids, list_transform(range(64), lambda i: 0))[1:64]"


@query(f"SELECT doc_id, array_to_string({_PAD_SQL}, ',') AS input_ids, array_to_string(list_transform(range(64), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask FROM (SELECT doc_id, {_IDS_SQL} AS ids FROM documents)")
def token_pad_mask(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("doc_id", _text(tokens.pad(F.col("ids"), 64)).alias("input_ids"), _text(tokens.attention(F.col("ids"), 64)).alias("attention_mask"))


@query(f"SELECT doc_id, array_to_string(list_transform({_PAD_SQL}, lambda x, i: CASE WHEN i <= doc_id % 40 THEN -100 ELSE x END), ',') AS labels FROM (SELECT doc_id, {_IDS_SQL} AS ids FROM documents)")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("doc_id", _text(tokens.labels(tokens.pad(F.col("ids"), 64), F.col("doc_id") % 40)).alias("labels"))


@query(f"""
SELECT doc_id, array_to_string(ids[1:n], ',') AS thinking, array_to_string(ids[n + 1:], ',') AS answer
FROM (SELECT doc_id, ids, CASE WHEN list_contains(ids, 7) THEN len(ids) - list_position(list_reverse(ids), 7) + 1 ELSE 0 END AS n FROM (SELECT doc_id, {_IDS_SQL} AS ids FROM documents))""")
def split_ids_last(spark: SparkSession, d: str) -> DataFrame:
    s = _ids(spark, d).select("doc_id", tokens.split_last(F.col("ids"), 7).alias("s"))
    return s.select("doc_id", _text(F.col("s.thinking")).alias("thinking"), _text(F.col("s.answer")).alias("answer"))


@query(f"SELECT doc_id, array_to_string(ids[doc_id % 20 + 1:], ',') AS generated FROM (SELECT doc_id, {_IDS_SQL} AS ids FROM documents)")
def drop_prompt_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("doc_id", _text(tokens.without_prompt(F.col("ids"), (F.col("doc_id") % 20).cast("int"))).alias("generated"))


_WORDS_SQL = "list_transform(list_filter(regexp_split_to_array({}, '[ \\t\\n]+'), lambda w: w <> ''), lambda w: CAST(length(w) % 1000 AS INT))"
_SAID_SQL = "('Write an animation script for: ' || text || chr(10) || '<CODE>' || chr(10))"


@query(f"""
WITH s AS (SELECT {_WORDS_SQL.format(f"{_SAID_SQL} || ' </s> ' || text || ' </s> '")} AS ids, len({_WORDS_SQL.format(f"{_SAID_SQL} || ' </s> '")}) AS said FROM documents),
p AS (SELECT *, list_concat(ids, list_transform(range(128), lambda i: 0))[1:128] AS padded FROM s)
SELECT array_to_string(padded, ',') AS input_ids, array_to_string(list_transform(range(128), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask,
  array_to_string(list_transform(padded, lambda x, i: CASE WHEN i <= said THEN -100 ELSE x END), ',') AS labels FROM p""")
def sft_tokens(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select(F.col("text").alias("Reviewed Description"), F.col("text").alias("Code"))
    return samples.tokenised(raw, 128).select(*[_text(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and the one with the next id, by a join on the id: no group of vectors is sorted in one task."""
    v = table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return v.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id")


_NEIGHBOURS_SQL = "(SELECT x.vec_id, y.vec_id AS other, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query(f"SELECT vec_id, other, {r6('list_cosine_similarity(a, b)')} AS cosine, {r6('1.0 - list_dot_product(a, b)')} AS distance FROM {_NEIGHBOURS_SQL}")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, d).select("vec_id", "other", rounded(vectors.cosine(a, b)).alias("cosine"), rounded(vectors.dot_distance(a, b)).alias("distance"))


@query(f"SELECT label, CAST(k - 1 AS INT) AS dim, {r6('avg(embedding[k]::DOUBLE)')} AS value FROM embeddings, unnest(range(1, 65)) u(k) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", "dim", rounded(F.col("value")).alias("value"))


@query(f"SELECT vec_id, CAST(k - 1 AS INT) AS dim, {r6('e[k] / sqrt(list_dot_product(e, e))')} AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), unnest(range(1, 65)) u(k)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalise(F.col("embedding"))).alias("dim", "value")).select("vec_id", "dim", rounded(F.col("value")).alias("value"))


def _gram_sql(column: str, n: int) -> str:
    words = f"list_filter(regexp_split_to_array({column}, '[ \\t\\n]+'), lambda w: w <> '')"
    return f"SELECT conv_id, turn, gram, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS gram FROM (SELECT conv_id, turn, {words} AS w FROM p)) GROUP BY ALL"


def _clipped_sql(n: int) -> str:
    return f"SELECT c.conv_id, c.turn, {n} AS n, sum(least(c.c, coalesce(r.c, 0)))::BIGINT AS matched, sum(c.c)::BIGINT AS total FROM ({_gram_sql('completion', n)}) c LEFT JOIN ({_gram_sql('description', n)}) r ON c.conv_id = r.conv_id AND c.turn = r.turn AND c.gram = r.gram GROUP BY 1, 2"


@query(f"WITH p AS {PAIRS_SQL} " + " UNION ALL ".join(_clipped_sql(n) for n in range(1, 5)))
def clipped_counts(spark: SparkSession, d: str) -> DataFrame:
    return codebleu.clipped_counts(pairs(spark, d), ["conv_id", "turn"], "completion", "description", 1, 2, 3, 4)


_SIZE_SQL = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n]+'), lambda w: w <> ''))"
_SHARE_SQL = "max(CASE WHEN n = {0} THEN CASE WHEN matched > 0 THEN matched / total::DOUBLE ELSE 1.0 / (2.0 * total) END END) AS p{0}"


@query(f"""
WITH p AS {PAIRS_SQL}, k AS ({" UNION ALL ".join(_clipped_sql(n) for n in range(1, 5))}),
q AS (SELECT conv_id, turn, {", ".join(_SHARE_SQL.format(n) for n in range(1, 5))} FROM k GROUP BY 1, 2),
s AS (SELECT p.conv_id, p.turn, p1, p2, p3, p4, {_SIZE_SQL.format("completion")} AS lc, {_SIZE_SQL.format("description")} AS lr FROM p LEFT JOIN q ON p.conv_id = q.conv_id AND p.turn = q.turn),
b AS (SELECT *, CASE WHEN lc >= lr THEN 1.0::DOUBLE WHEN lc = 0 THEN 0.0::DOUBLE ELSE exp(1.0 - lr / lc::DOUBLE) END AS bp FROM s)
SELECT conv_id, turn, {r6("bp")} AS brevity, {r6("bp * exp((" + " + ".join(f"ln(coalesce(p{n}, 1e-9::DOUBLE))" for n in range(1, 5)) + ") / 4)")} AS bleu FROM b""")
def ngram_bleu(spark: SparkSession, d: str) -> DataFrame:
    out = codebleu.ngram_scores(pairs(spark, d), ["conv_id", "turn"], "completion", "description")
    return out.select("conv_id", "turn", rounded(F.col("brevity")).alias("brevity"), rounded(F.col("bleu")).alias("bleu"))


@query(f"""
WITH p AS {PAIRS_SQL}, j AS (SELECT r.conv_id, r.turn, CASE WHEN r.gram IN ('the', 'of', 'and', 'is', 'de') THEN 5 ELSE 1 END AS wt, r.c AS c, least(r.c, coalesce(x.c, 0)) AS m
  FROM ({_gram_sql('description', 1)}) r LEFT JOIN ({_gram_sql('completion', 1)}) x ON r.conv_id = x.conv_id AND r.turn = x.turn AND r.gram = x.gram)
SELECT conv_id, turn, {r6("sum(wt * m) / sum(wt * c)::DOUBLE")} AS weighted FROM j GROUP BY 1, 2""")
def weighted_ngram(spark: SparkSession, d: str) -> DataFrame:
    out = codebleu.ngram_scores(pairs(spark, d), ["conv_id", "turn"], "completion", "description", order=1, heavy=("the", "of", "and", "is", "de"))
    return out.select("conv_id", "turn", rounded(F.col("weighted")).alias("weighted"))


# Frames: embeddings as 8 x 8 images, four to a sequence, two sequences to a pair.
def _frames(spark: SparkSession, d: str) -> DataFrame:
    seq = F.floor(F.col("vec_id") / 4)
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 64 + 128))).cast("int"))
    return table(spark, d, "embeddings").select(F.floor(seq / 2).cast("long").alias("pair_id"), (seq % 2).cast("int").alias("side"), (F.col("vec_id") % 4).cast("int").alias("k"), pixels.alias("frame"), "embedding")


_FRAMES_SQL = "(SELECT CAST(vec_id // 8 AS BIGINT) AS pair_id, (vec_id // 4) % 2 AS side, CAST(vec_id % 4 AS INT) AS k, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(x::DOUBLE * 64 + 128))) AS INT)) AS frame, embedding::DOUBLE[] AS embedding FROM embeddings)"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d).select("pair_id", "side", "k", F.lit(8).alias("width"), frames.packed("frame").alias("gray"))
    return frames.matrix(f, resize=False).select("pair_id", "i", "j", rounded(F.col("ssim")).alias("ssim"))


_CELLS = "[" + ", ".join(str(dy * 8 + dx) for dy in range(7) for dx in range(7)) + "]"
_C1, _C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
_SSIM_SQL = f"""(
  WITH fp AS (SELECT x.pair_id, x.k AS i, y.k AS j, x.frame AS a, y.frame AS b FROM {_FRAMES_SQL} x JOIN {_FRAMES_SQL} y ON x.pair_id = y.pair_id AND x.side = 0 AND y.side = 1),
  s AS (SELECT pair_id, i, j, list_sum(list_transform({_CELLS}, lambda c: a[c + t])) AS sx, list_sum(list_transform({_CELLS}, lambda c: b[c + t])) AS sy,
    list_sum(list_transform({_CELLS}, lambda c: a[c + t] * a[c + t])) AS sxx, list_sum(list_transform({_CELLS}, lambda c: b[c + t] * b[c + t])) AS syy, list_sum(list_transform({_CELLS}, lambda c: a[c + t] * b[c + t])) AS sxy
    FROM fp, unnest([1, 2, 9, 10]) u(t)),
  m AS (SELECT pair_id, i, j, sx / 49.0::DOUBLE AS mx, sy / 49.0::DOUBLE AS my, sxx::DOUBLE AS sxx, syy::DOUBLE AS syy, sxy::DOUBLE AS sxy FROM s),
  v AS (SELECT *, (sxx - 49 * mx * mx) / 48 AS vx, (syy - 49 * my * my) / 48 AS vy, (sxy - 49 * mx * my) / 48 AS cxy FROM m)
  SELECT pair_id, i, j, {r6(f"avg(((2 * mx * my + {_C1!r}::DOUBLE) * (2 * cxy + {_C2!r}::DOUBLE)) / ((mx * mx + my * my + {_C1!r}::DOUBLE) * (vx + vy + {_C2!r}::DOUBLE)))")} AS ssim FROM v GROUP BY 1, 2, 3)"""


@query(f"SELECT pair_id, i, j, ssim FROM {_SSIM_SQL}")
def ssim_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


_BEST_SQL = f"(SELECT pair_id, list(v ORDER BY k) FILTER (side = 0) AS rows, list(v ORDER BY k) FILTER (side = 1) AS cols FROM (SELECT pair_id, 0 AS side, i AS k, max(ssim) AS v FROM {_SSIM_SQL} GROUP BY 1, 3 UNION ALL SELECT pair_id, 1, j, max(ssim) FROM {_SSIM_SQL} GROUP BY 1, 3) GROUP BY 1)"


@query(f"SELECT pair_id, n, rows[n] AS best_of_row, cols[n] AS best_of_column FROM {_BEST_SQL}, unnest(range(1, 5)) u(n) WHERE n <= len(rows)")
def ssim_best_match(spark: SparkSession, d: str) -> DataFrame:
    best = sequence.best_match(_matrix(spark, d))
    return best.select("pair_id", F.posexplode(F.arrays_zip("rows", "cols")).alias("n", "z")).select("pair_id", (F.col("n") + 1).cast("long").alias("n"), F.col("z.rows").alias("best_of_row"), F.col("z.cols").alias("best_of_column")).where("best_of_row IS NOT NULL")


def _dtw_sql(source: str, key: str, cost: str) -> str:
    """A WITH clause whose table `warped` has the warping distance d of two lists (key, rows, cols) of any length: a row of the table for each step of
    the recursion, each cell from its left, upper and diagonal neighbours."""
    cell = f"[{cost.format(a='rows[i + 1]', b='cols[j]')}, above[j], above[j + 1]]"
    return f"""WITH RECURSIVE source AS (SELECT * FROM {source} WHERE len(rows) > 0 AND len(cols) > 0),
steps AS (
  SELECT {key}, rows, cols, 0 AS i, list_concat([0.0::DOUBLE], list_transform(cols, lambda c: 'inf'::DOUBLE)) AS above FROM source
  UNION ALL
  SELECT {key}, rows, cols, i + 1, list_reduce(list_transform(range(1, len(cols) + 1), lambda j: {cell}), lambda row, c: list_append(row, c[1] + least(row[len(row)], c[2], c[3])), ['inf'::DOUBLE]) FROM steps WHERE i < len(rows)
), warped AS (SELECT {key}, len(rows) AS n, len(cols) AS m, above[len(above)] AS d FROM steps WHERE i = len(rows))"""


@query(f"{_dtw_sql(_BEST_SQL, 'pair_id', 'abs({a} - {b})')} SELECT pair_id, {r6('d')} AS distance, {r6('exp(-5.0 * d / greatest(n, m))')} AS score FROM warped")
def ssim_dtw_score(spark: SparkSession, d: str) -> DataFrame:
    best = sequence.best_match(_matrix(spark, d)).where("size(rows) > 0 AND size(cols) > 0").withColumn("d", sequence.dtw_fold(F.col("rows"), F.col("cols")))
    return best.select("pair_id", rounded(F.col("d")).alias("distance"), rounded(sequence.similarity(F.col("d"), F.size("rows"), F.size("cols"), 5.0)).alias("score"))


@query(f"{_dtw_sql('(SELECT vec_id, a AS rows, b AS cols FROM ' + _NEIGHBOURS_SQL + ')', 'vec_id', 'abs({a} - {b})')} SELECT vec_id, {r6('d')} AS distance FROM warped")
def dtw_series(spark: SparkSession, d: str) -> DataFrame:
    """Whole series, those of a batch together by arrays."""
    n = _neighbours(spark, d).select("vec_id", *[F.col(c).cast("array<double>").alias(c) for c in ("a", "b")])
    return n.select("vec_id", rounded(sequence.dtw_series("a", "b")).alias("distance"))


@query(ORACLES["dtw_series"])
def dtw_series_folded(spark: SparkSession, d: str) -> DataFrame:
    """The same by a fold over columns alone, which takes any cost of two elements."""
    n = _neighbours(spark, d).select("vec_id", *[F.col(c).cast("array<double>").alias(c) for c in ("a", "b")])
    return n.select("vec_id", rounded(sequence.dtw_fold(F.col("a"), F.col("b"))).alias("distance"))


_UNIT_SQL = "list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding)))"


_UNITS_SQL = f"(SELECT pair_id, list(e ORDER BY k) FILTER (side = 0) AS rows, list(e ORDER BY k) FILTER (side = 1) AS cols FROM (SELECT pair_id, side, k, {_UNIT_SQL} AS e FROM {_FRAMES_SQL}) GROUP BY 1)"


@query(f"{_dtw_sql(_UNITS_SQL, 'pair_id', '(1.0 - list_dot_product({a}, {b}))')} SELECT pair_id, {r6('d')} AS cost, {r6('exp(-d / greatest(n, m))')} AS score FROM warped")
def embed_dtw_score(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d).select("pair_id", "side", F.struct("k", vectors.normalise(F.col("embedding")).alias("e")).alias("f"))
    line = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("f")))), lambda x: x["e"])
    g = f.groupBy("pair_id").agg(line(0).alias("a"), line(1).alias("b")).where("size(a) > 0 AND size(b) > 0")
    cost = g.withColumn("c", sequence.dtw_fold(F.col("a"), F.col("b"), vectors.dot_distance))
    return cost.select("pair_id", rounded(F.col("c")).alias("cost"), rounded(sequence.similarity(F.col("c"), F.size("a"), F.size("b"))).alias("score"))


@query(f"SELECT {', '.join(LINE)}, {r6('0.299::DOUBLE * l_quantity + 0.587::DOUBLE * l_linenumber + 0.114::DOUBLE * l_suppkey')} AS gray FROM lineitem")
def gray_convert(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE, rounded(sequence.gray(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey"))).alias("gray"))


# Programs: made from part names, some of which do not parse; expected is the program of the next part.
def _programs(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    first, size = F.initcap(w[0]), F.col("p_size").cast("string")
    good = F.concat(F.lit("class Show(Scene):\n    def construct(self):\n        a = "), first, F.lit("(radius="), size, F.lit(")\n        b = Line(a.start, color="), F.upper(w[1]), F.lit(")\n        self.camera.background_color = b\n        self.play(Create(a).shift(UP), run_time="), size, F.lit(")\n"))
    code = F.when(F.col("p_partkey") % 11 == 0, F.concat(good, F.lit("  )"))).when(F.col("p_partkey") % 7 == 0, "").otherwise(good)
    part = table(spark, d, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), good.alias("expected"))
    made = part.select("p_partkey", code.alias("code")).join(nxt, "p_partkey", "left")
    return spread(made, "p_partkey")


# In SQL the programs' names and trees are closed forms: a program without an error or a blank is the same but for two names and a number.
_FIRST_SQL = "(upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2))"
_WHOLE_SQL = "p_partkey % 11 <> 0 AND p_partkey % 7 <> 0"


@query(f"""
SELECT p_partkey, CASE WHEN {_WHOLE_SQL} THEN array_to_string(list_sort(['Create', 'Create.shift', 'Line', {_FIRST_SQL}]), ',') ELSE '' END AS calls,
  CASE WHEN {_WHOLE_SQL} THEN array_to_string(list_sort([{_FIRST_SQL} || '.start', 'Scene.camera.background_color']), ',') ELSE '' END AS assignments FROM part""")
def call_extract(spark: SparkSession, d: str) -> DataFrame:
    n = _programs(spark, d).select("p_partkey", codegraph.code_names("code").alias("n"))
    kept = n.select("p_partkey", codegraph.filter_names(F.col("n.calls")).alias("c"), codegraph.filter_names(F.col("n.vars")).alias("v"))
    return kept.select("p_partkey", F.array_join("c", ",").alias("calls"), F.array_join(codegraph.vars_beyond_calls(F.col("v"), F.col("c")), ",").alias("assignments"))


@query("SELECT p_partkey, p_partkey % 11 <> 0 AS valid FROM part")
def syntax_validity(spark: SparkSession, d: str) -> DataFrame:
    return _programs(spark, d).select("p_partkey", codegraph.parses("code").alias("valid"))


_NEXT_SQL = "part p JOIN part n ON n.p_partkey = p.p_partkey + 1"
_CHANGED_SQL = "CAST((split_part(p.p_name, ' ', 1) <> split_part(n.p_name, ' ', 1))::INT + 2 * (p.p_size <> n.p_size)::INT + (split_part(p.p_name, ' ', 2) <> split_part(n.p_name, ' ', 2))::INT AS DOUBLE)"


@query(f"""
SELECT p_partkey, raw, CASE WHEN raw IS NOT NULL THEN 92.0::DOUBLE END AS max, {r6('raw / (92.0::DOUBLE + 1e-7::DOUBLE)')} AS norm, raw IS NULL AS syntax_error
FROM (SELECT p.p_partkey, CASE WHEN p.p_partkey % 11 = 0 THEN NULL WHEN p.p_partkey % 7 = 0 THEN 91.0::DOUBLE ELSE {_CHANGED_SQL} END AS raw FROM {_NEXT_SQL})""")
def tree_distance(spark: SparkSession, d: str) -> DataFrame:
    p = _programs(spark, d).where("expected IS NOT NULL").select("p_partkey", treedist.code_distance("code", "expected").alias("t"))
    return p.select("p_partkey", "t.raw", "t.max", rounded(F.col("t.norm")).alias("norm"), "t.syntax_error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 1 ELSE 92 END AS nodes FROM part")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _programs(spark, d).select("p_partkey", treedist.tree_nodes("code").alias("nodes"))


@query()
def codebleu_pairs(spark: SparkSession, d: str) -> DataFrame:
    return codebleu.codebleu(_programs(spark, d).where("expected IS NOT NULL AND code <> ''"), ["p_partkey"], "code", "expected")


def _line_sql(form: str, name: str, sig: str, doc: str) -> str:
    """An item of interface notes in SQL."""
    given = {"name": name, "sig": f"'{sig}'", "doc": doc}
    return " || ".join(x for text, slot, _, _ in string.Formatter().parse(form) for x in ([f"'{text}'"] if text else []) + ([given[slot]] if slot else []))


def _unknown_sql(form: str, name: str) -> str:
    return _line_sql(form, name, docs.NO_SIGNATURE, f"'{templates.PLAIN['no_doc'].split('{')[0]}' || {name} || '.'")


_NOTES_SQL = f"""array_to_string(list_transform(list_sort([{_FIRST_SQL} || '.start', 'Scene.camera.background_color']), lambda v: {_unknown_sql(docs.OTHER, 'v')}), chr(10)) || chr(10) || chr(10)
  || array_to_string(list_transform(list_sort(['Create', 'Create.shift', 'Line', {_FIRST_SQL}]), lambda v: CASE WHEN v = 'Line' THEN {_line_sql(docs.CALL, 'v', '(start, end)', "'A line.'")} ELSE {_unknown_sql(docs.CALL, 'v')} END), chr(10))"""


@query(f"SELECT p_partkey, CASE WHEN {_WHOLE_SQL} THEN {_NOTES_SQL} ELSE chr(10) END AS api_info FROM part")
def api_notes(spark: SparkSession, d: str) -> DataFrame:
    """Interface notes on the names of each program, from a dimension made by reflection."""
    dimension = external.api_docs(spark, string, ["Template.substitute", "Formatter", "capwords", "digits"]).unionByName(spark.createDataFrame([("Line", "(start, end)", "A line. Examples: none")], "name string, sig string, doc string"))
    n = _programs(spark, d).select("p_partkey", codegraph.code_names("code").alias("n")).select("p_partkey", codegraph.filter_names(F.col("n.calls")).alias("calls"), codegraph.filter_names(F.col("n.vars")).alias("v"))
    return docs.notes(n.withColumn("assignments", codegraph.vars_beyond_calls(F.col("v"), F.col("calls"))), dimension, "p_partkey")


def _mock_generate(df: DataFrame) -> DataFrame:
    """Stands in for a model: a program that gets longer with each round."""
    return df.withColumn("response", F.concat(F.lit("<code>"), F.coalesce(F.concat("initial_code", F.lit(";")), F.lit("")), F.lit("x = "), F.length("request").cast("string"), F.lit("</code>")))


def _mock_render(df: DataFrame) -> DataFrame:
    """Stands in for a renderer: a third of the programs succeed in each round."""
    ok = F.pmod(F.col("id") + F.length("code"), F.lit(3)) == 0
    return df.withColumns({"success": ok, "errors": F.when(ok, "").otherwise(F.concat(F.lit("\x1b[31mline 1\nno such name\n"), "code"))})


def _user_sql(template: str, **slots: str) -> str:
    """The user text of a chat template in SQL."""
    parts = string.Formatter().parse(templates.TEMPLATES[template][1])
    return " || ".join(x for text, name, _, _ in parts for x in ([f"'{text}'"] if text else []) + ([slots[name]] if name else []))


_LATER_SQL = "code || ';x = ' || length(" + _user_sql("docs_feedback", reviewed_description="text", initial_code="code", api_info="'none'", render_errors="'line 1\nno such name\n' || code") + ")"


@query(f"""
WITH r0 AS (SELECT conv_id * 1000 + turn AS id, text, 0 AS round, 'x = ' || length({_user_sql("code", reviewed_description="text")}) AS code FROM conversations WHERE role = 'user'),
{", ".join(f"r{n} AS (SELECT id, text, {n} AS round, {_LATER_SQL} AS code FROM r{n - 1} WHERE (id + length(code)) % 3 <> 0)" for n in (1, 2, 3))},
every AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT id, CAST(round AS INT) AS round, CASE WHEN round = 0 THEN 'code' ELSE 'docs_feedback' END AS template, code, (id + length(code)) % 3 = 0 AS success FROM every WHERE (id + length(code)) % 3 = 0 OR round = 3""")
def feedback_loop(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("reviewed_description"))
    out = loop.run_rounds(s, _mock_generate, _mock_render, 3, notes=lambda t: t.withColumn("api_info", F.lit("none")))
    return out.select("id", "round", "template", "code", "success")


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'code_with_plan' ELSE 'code' END AS template FROM conversations")
def plan_step(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    s = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("reviewed_description"), *[none.alias(c) for c in ("initial_code", "api_info", "render_errors")], F.when(F.col("turn") % 2 == 0, F.col("text")).alias("code_plan"))
    return loop.requests(s).select("id", "template")


@query("SELECT doc_id, 'Answer: ' || text AS response, false AS timed_out FROM documents")
def model_stage(spark: SparkSession, d: str) -> DataFrame:
    """A chat endpoint behind an injected transport."""

    def post(url: str, json: dict, timeout: float) -> dict:
        return {"choices": [{"message": {"content": f"Answer: {json['messages'][0]['content']}"}}]}

    asked = table(spark, d, "documents").select("doc_id", F.col("text").alias("request"))
    return external.with_answers(asked, external.chat_endpoint("http://localhost/v1", "none", post)).select("doc_id", "response", "timed_out")


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 9 = 4 THEN '{external.TIMED_OUT}' ELSE upper(n_name) END AS response, n_nationkey % 9 = 4 AS timed_out FROM nation")
def timed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a time limit each: those that take longer are a sentinel text, and the rest goes on."""

    def make():
        def ask(text: str) -> str:
            if text.startswith("slow "):
                time.sleep(3)
            return text.upper()

        return ask

    slow = F.when(F.col("n_nationkey") % 9 == 4, F.concat(F.lit("slow "), "n_name")).otherwise(F.col("n_name"))
    return external.with_answers(table(spark, d, "nation").select("n_nationkey", slow.alias("request")), make, timeout=0.5).select("n_nationkey", "response", "timed_out")


@query("""
SELECT p_partkey, p_size % 3 = 0 AS success, CASE WHEN p_size % 3 = 1 THEN 'There is no code to render.' WHEN p_size % 3 = 2 THEN 'The script left no video or image.' ELSE '' END AS errors,
  CASE WHEN p_size % 3 = 2 THEN 'size ' || p_size || chr(10) ELSE '' END AS info FROM part""")
def render_stage(spark: SparkSession, d: str) -> DataFrame:
    """Scripts run in processes of their own; equal ones run once, however many rows have them."""
    size, k = F.col("p_size").cast("string"), F.col("p_size") % 3
    script = F.when(k == 0, F.concat(F.lit("open('out.png', 'wb').write(b'P5 1 1 255 x')  # "), size)).when(k == 1, " ").otherwise(F.concat(F.lit("print('size', "), size, F.lit(")")))
    parts = table(spark, d, "part").select("p_partkey", script.alias("code"))
    made = external.with_renders(parts.select("code").distinct())
    return parts.join(made, "code").select("p_partkey", "success", "errors", "info")


@query("SELECT p_partkey, i AS frame_idx, CAST(2 AS INT) AS height, CAST(3 AS INT) AS width, array_to_string(list_transform(range(6), lambda k: (p_partkey + 40 * k + i) % 256), ',') AS gray FROM part, unnest([0, 2, 4]) u(i)")
def video_frames(spark: SparkSession, d: str) -> DataFrame:
    """Films of all parts, five frames at ten a second each, sampled to five a second by a decoder that gives one frame after the other."""
    return _media(spark, d, _shots(5), lambda data: ((np.frombuffer(data, np.uint8, 6, at).reshape(2, 3) for at in range(0, len(data), 6)), 10.0))


@query("SELECT p_partkey, 0 AS frame_idx, CAST(2 AS INT) AS height, CAST(3 AS INT) AS width, array_to_string(list_transform(range(6), lambda k: (p_partkey + 40 * k) % 256), ',') AS gray FROM part")
def image_frames(spark: SparkSession, d: str) -> DataFrame:
    """Still images of all parts, as portable gray maps: their one frame."""
    return _media(spark, d, F.concat(F.lit(b"P5 3 2 255 "), _shots(1)), external.decode_pnm)


def _shots(count: int) -> Column:
    """Pixels of `count` 3 x 2 frames of a part, one after the other, as bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex((F.col("p_partkey") + 40 * k + i) % 256), 2, "0") for i in range(count) for k in range(6)]))


def _media(spark: SparkSession, d: str, content: Column, decode: external.Decode) -> DataFrame:
    """Frames of media made of each part."""
    made = external.frame_rows(spread(table(spark, d, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")), decode)
    values = F.array_join(external.pixels("gray").cast("array<string>"), ",")
    return made.select(F.col("path").cast("long").alias("p_partkey"), "frame_idx", "height", "width", values.alias("gray"))


@query("SELECT p_partkey, '1. show ' || p_name AS code_plan, 'code_with_plan' AS template FROM part")
def planner_step(spark: SparkSession, d: str) -> DataFrame:
    """A planner answers each sample's plan request; its last plan goes into the request for the program."""
    none = F.lit(None).cast("string")
    s = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("reviewed_description"))
    said = F.concat(F.lit("let me think\n<PLAN>no</PLAN>\n<plan>\n1. show "), F.substring_index("request", "\n", -1), F.lit("\n</plan>"))
    planned = loop.planned(s, lambda t: t.withColumn("response", said))
    return loop.requests(planned.select("p_partkey", "reviewed_description", "code_plan", *[none.alias(c) for c in ("initial_code", "api_info", "render_errors")])).select("p_partkey", "code_plan", "template")


@query("SELECT p_partkey, true AS well_formed, 1 AS rows_with_name FROM part")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that no two rows share: what they look like, and how many rows have each."""
    named = store.written(table(spark, d, "part").select("p_partkey", text.unique_name("scene").alias("name")), "names")
    counts = named.groupBy("name").agg(F.count("*").cast("int").alias("rows_with_name"))
    return named.join(counts, "name").select("p_partkey", F.col("name").rlike(r"^scene_[0-9a-f]{12}_\d{10}$").alias("well_formed"), "rows_with_name")


@query(f"""
SELECT p_partkey, array_to_string(list_sort(['Create', {_FIRST_SQL}, {_FIRST_SQL} || '.move']), ',') AS calls, {_FIRST_SQL} || '.start' AS assignments FROM part""")
def session_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of snippets read one after the other: what one tells about a variable's type holds in the next."""
    first = F.initcap(F.split("p_name", " ")[0])
    snippets = F.array(F.concat(F.lit("a = "), first, F.lit("()")), F.lit("b = a.start"), F.lit("x = ("), F.lit("a.move(Create(1))"))
    n = spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", codegraph.session_names(snippets).alias("n"))
    kept = n.select("p_partkey", codegraph.filter_names(F.col("n.calls")).alias("c"), codegraph.filter_names(F.col("n.vars")).alias("v"))
    return kept.select("p_partkey", F.array_join("c", ",").alias("calls"), F.array_join(codegraph.vars_beyond_calls(F.col("v"), F.col("c")), ",").alias("assignments"))


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = store.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), store.shared_path(spark, "csv"), ["o_orderkey"])
    return store.read_csv(spark, path, "row_idx long, o_orderkey long, o_orderstatus string")


@query("SELECT 'eval/' || p_partkey AS value FROM part UNION ALL SELECT 'eval/last'")
def manifest_append(spark: SparkSession, d: str) -> DataFrame:
    """A manifest that grows by tables of lines and by single lines; nothing happens without one."""
    path, parts = store.shared_path(spark, "manifest"), table(spark, d, "part")
    for k in range(2):
        store.append_manifest(spark, path, rows=parts.where(F.col("p_partkey") % 2 == k).select(F.concat(F.lit("eval/"), "p_partkey").alias("value")))
    store.append_manifest(spark, path, "eval/last")
    store.append_manifest(spark, None, "nowhere")
    return spark.read.text(path)


@query("SELECT doc_id, 'Nothing is documented under ' || source || '.' AS no_doc, text || chr(10) || '(from source ' || source || ')' AS question FROM documents")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents")
    return n.select("doc_id", templates.fill(templates.PLAIN["no_doc"], invalid_param=F.col("source"), ignored=F.col("text")).alias("no_doc"), templates.fill(templates.PLAIN["question"], question=F.col("text"), source_type=F.lit("source"), source_file=F.col("source")).alias("question"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    return columns.global_row_number(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "place", "o_totalprice", "o_orderkey").select("o_orderkey", "place")


def _answer(df: DataFrame) -> DataFrame:
    """Stands in for a model: some thinking, then a program named in the request."""
    k = F.pmod(F.col("id"), F.lit(5))
    code = F.when(k == 0, "").when(k == 1, "x = (").otherwise(F.concat(F.lit("Line("), F.length("request").cast("string"), F.lit(")")))
    return df.withColumn("response", F.concat(F.lit("let me see</think>\n<code>"), code, F.lit("</code>")))


def _show(df: DataFrame) -> DataFrame:
    """Stands in for a renderer: what parses renders to its own text."""
    ok = codegraph.parses("code")
    return df.withColumn("success", ok).select("*", F.when(F.col("success"), F.col("code").cast("binary")).alias("artifact"), F.lit("").alias("info"), F.when(F.col("success"), "").otherwise("no").alias("errors"))


def _filmed(data: bytes) -> tuple[list[np.ndarray], float]:
    """Stands in for a codec: a text's bytes as 8 x 8 frames, four a second."""
    pixels = np.frombuffer(data, np.uint8)
    return [np.resize(pixels[at : at + 64], (8, 8)) for at in range(0, len(pixels), 64)], 4.0


def _pooled() -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """Stands in for an encoder: means over sixteen parts of a frame."""
    return lambda frames: [sequence.resize_area(f, 4, 4).ravel() for f in frames]


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    p = _programs(spark, d).where("expected IS NOT NULL").select(F.col("p_partkey").alias("id"), F.concat(F.lit("scene "), F.col("p_partkey").cast("string")).alias("text_script"), F.col("expected").alias("expected_code"), F.when(F.col("p_partkey") % 2 == 0, "1. go").alias("code_plan"))
    share = lambda a, b: F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return evaluate.evaluate(
        p, _answer, _show,
        lambda t: t.withColumn("codebert_similarity", share("generated_code", "expected_code")),
        lambda t: visual.visual_scores(t, _filmed, _pooled),
    )


@query()
def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation with stand-ins for the model, the renderer and the encoders: one row a sample."""
    return _evaluated(spark, d)


@query()
def evaluation_means(spark: SparkSession, d: str) -> DataFrame:
    """Its fifteen means."""
    return rewards.summary(_evaluated(spark, d))


_FIRST_CODE_SQL = f"CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x = (' ELSE 'Line(' || length({_user_sql('code', reviewed_description='text')}) || ')' END"


@query(f"""
SELECT doc_id AS id, text AS reviewed_description, {_FIRST_CODE_SQL} AS initial_code,
  CASE WHEN doc_id % 5 < 2 THEN chr(10) ELSE chr(10) || {_line_sql(docs.CALL, "'Line'", '(start, end)', "'A line.'")} END AS api_info FROM documents""")
def docs_augmented(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a first program and notes on its names."""
    dimension = spark.createDataFrame([("Line", "(start, end)", "A line. Examples: none")], "name string, sig string, doc string")

    def notes(first: DataFrame) -> DataFrame:
        n = first.select("id", codegraph.code_names("initial_code").alias("n")).select("id", codegraph.filter_names(F.col("n.calls")).alias("calls"), codegraph.filter_names(F.col("n.vars")).alias("v"))
        return first.join(docs.notes(n.withColumn("assignments", codegraph.vars_beyond_calls(F.col("v"), F.col("calls"))), dimension, "id"), "id")

    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("reviewed_description"))
    return evaluate.augmented(s, _answer, notes)
