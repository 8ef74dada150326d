"""Queries: responses, prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import messages, text
from tessera.functions.templates import PLAIN, TEMPLATES, fill, generation_template
from tessera.operators import columns, samples
from tessera.plans.registry import query
from tessera.sources.store import table


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g')"


def quoted(s: str) -> str:
    """A Python string as SQL."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


#: A completion around a turn's text; the two forms say the same.
WRAPPED_SQL = "('intro ' || CASE turn % 3 WHEN 0 THEN '<CODE>' WHEN 1 THEN '<code>' ELSE '`<CODE>`<CODE>' END || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || '</CODE>' || CASE WHEN turn % 2 = 0 THEN ' tail <CODE>last</CODE>' ELSE '' END)"


def wrapped() -> Column:
    k = F.col("turn") % 3
    start = F.when(k == 0, "<CODE>").when(k == 1, "<code>").otherwise("`<CODE>`<CODE>")
    return F.concat(F.lit("intro "), start, F.lit("\n```python\n"), F.col("text"), F.lit("\n```\n</CODE>"), F.when(F.col("turn") % 2 == 0, " tail <CODE>last</CODE>").otherwise(""))


def repair_sql(x: str, tag: str = "CODE") -> str:
    low = tag.lower()
    return f"replace(replace(replace(replace(regexp_replace({x}, '`<{tag}>`|`</{tag}>`', '', 'g'), '<{low}>', '<{tag}>'), '</{low}>', '</{tag}>'), '{tag}>', '<{tag}>'), '</<{tag}>', '</{tag}>')"


def blocks_sql(x: str, tag: str = "CODE", fence: str = "python", fall_back: bool = True) -> str:
    found = f"regexp_extract_all({repair_sql(x, tag)}, '(?s)<{tag}>(.*?)</{tag}>', 1)"
    if fall_back:
        found = f"CASE WHEN len({found}) = 0 THEN regexp_extract_all({repair_sql(x, tag)}, '(?s)```{fence}(.*?)```', 1) ELSE {found} END"
    return f"list_transform({found}, lambda b: {strip_sql(f"regexp_replace(b, '<{tag}>|</{tag}>|```{fence}|```', '', 'g')")})"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@query("SELECT doc_id, text, lang FROM documents")
def scan_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS status FROM orders")
def normalize_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias(" Order Key"), F.col("o_totalprice").alias("Total Price "), F.col("o_orderstatus").alias("STATUS"))
    return columns.normalise_names(raw)


@query('SELECT o_orderkey AS _order_key, o_orderstatus AS "status_" FROM orders')
def normalize_columns_unstripped(spark: SparkSession, d: str) -> DataFrame:
    return columns.normalise_names(table(spark, d, "orders").select(F.col("o_orderkey").alias(" Order Key"), F.col("o_orderstatus").alias("STATUS ")), strip=False)


@query("SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def filter_split_limit(spark: SparkSession, d: str) -> DataFrame:
    return columns.head(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text"), 100, "doc_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, md5('1230|' || doc_id) AS k FROM documents) ORDER BY k, doc_id LIMIT 64")
def sample_exact_n(spark: SparkSession, d: str) -> DataFrame:
    return columns.sample_exactly(table(spark, d, "documents").select("doc_id", "lang"), 64, "doc_id")


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 1 THEN NULL ELSE text END AS x FROM conversations)
SELECT conv_id, turn, (x IS NULL OR {strip_sql('x')} = '') AS blank, CASE WHEN x IS NULL OR {strip_sql('x')} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM t""")
def blank_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    x = F.when(k == 0, " \t\n").when(k == 1, F.lit(None).cast("string")).otherwise(F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", text.is_blank(x).alias("blank"), F.when(text.is_blank(x), 0.0).otherwise(1.0).alias("score"))


_SYSTEM, _USER = TEMPLATES["code"]
_USER_SQL = " || ".join([quoted(_USER.split("{")[0]), "text", quoted(_USER.split("}")[1])])


@query(f"""
SELECT conv_id, turn, 'system' AS role1, {quoted(_SYSTEM)} AS content1, 'user' AS role2, {_USER_SQL} || chr(10) || '/no_think' AS content2,
  'assistant' AS role3, '<CODE>' || chr(10) || text || chr(10) || '</CODE>' AS content3, text AS expected_code FROM conversations""")
def chat_prompt_build(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    said = messages.user_text(fill(_USER, reviewed_description=F.col("text")), True)
    built = t.select("conv_id", "turn", messages.prompt(F.lit(_SYSTEM), said).alias("p"), messages.completion(fill(PLAIN["completion"], code=F.col("text"))).alias("c"), F.col("text").alias("expected_code"))
    parts = [F.col("p")[0], F.col("p")[1], F.element_at("c", 1)]
    return built.select("conv_id", "turn", *[x for i, m in enumerate(parts, 1) for x in (m["role"].alias(f"role{i}"), m["content"].alias(f"content{i}"))], "expected_code")


@query(f"SELECT conv_id, turn, 1 AS messages, 'user' AS role, {quoted(_SYSTEM)} || chr(10) || chr(10) || {_USER_SQL} AS content FROM conversations")
def system_role_fold(spark: SparkSession, d: str) -> DataFrame:
    p = messages.prompt(F.lit(_SYSTEM), fill(_USER, reviewed_description=F.col("text")), system_role=False)
    return _turns(spark, d).select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.size("p").alias("messages"), F.col("p")[0]["role"].alias("role"), F.col("p")[0]["content"].alias("content"))


@query("""
SELECT conv_id, CASE WHEN min_by(role, turn) = 'system' THEN '' ELSE '<s>system' || chr(10) || 'You are a helpful assistant.</s>' END ||
  string_agg('<s>' || role || chr(10) || trim(text, ' ') || '</s>', '' ORDER BY turn) || '<s>assistant' || chr(10) AS rendered
FROM conversations GROUP BY conv_id""")
def chat_template_render(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return _turns(spark, d).groupBy("conv_id").agg(listed.alias("m")).select("conv_id", messages.render(F.col("m"), open_turn=True).alias("rendered"))


@query(f"""
SELECT '<s>system' || chr(10) || {quoted(_SYSTEM)} || '</s><s>user' || chr(10) || trim({_USER_SQL} || chr(10) || '/no_think', ' ') || '</s><s>assistant' || chr(10) ||
  '<CODE>' || chr(10) || text || chr(10) || '</CODE></s>' AS messages FROM documents""")
def sft_chat_text(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select(F.col("text").alias("Reviewed Description"), F.col("text").alias("Code "))
    return samples.for_tuning(samples.prepare(raw))


@query(f"SELECT conv_id, turn, coalesce(list_extract({blocks_sql(WRAPPED_SQL)}, -1), '') AS code FROM conversations")
def extract_code_last(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", text.last_code(wrapped()).alias("code"))


@query(f"SELECT conv_id, turn, n - 1 AS place, b[n] AS code FROM (SELECT conv_id, turn, {blocks_sql(WRAPPED_SQL)} AS b FROM conversations), unnest(range(1, len(b) + 1)) AS u(n)")
def extract_code_all(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.posexplode(text.code_blocks(wrapped())).alias("place", "code")).withColumn("place", F.col("place").cast("long"))


_FENCED_SQL = "(CASE turn % 3 WHEN 0 THEN 'see ```python' || chr(10) || text || chr(10) || '``` end' WHEN 1 THEN text ELSE '<CODE>' || text END)"


@query(f"SELECT conv_id, turn, coalesce(list_extract({blocks_sql(_FENCED_SQL)}, -1), '') AS code FROM conversations")
def extract_code_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 3
    c = F.when(k == 0, F.concat(F.lit("see ```python\n"), F.col("text"), F.lit("\n``` end"))).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("<CODE>"), F.col("text")))
    return _turns(spark, d).select("conv_id", "turn", text.last_code(c).alias("code"))


_PLAN_SQL = "('a <plan>' || chr(10) || '```text' || chr(10) || text || '```</plan> b' || CASE WHEN turn % 2 = 1 THEN ' PLAN>second </PLAN>' ELSE '' END)"


@query(f"SELECT conv_id, turn, coalesce(list_extract({blocks_sql(_PLAN_SQL, 'PLAN', 'text', False)}, -1), '') AS plan FROM conversations")
def extract_plan(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("a <plan>\n```text\n"), F.col("text"), F.lit("```</plan> b"), F.when(F.col("turn") % 2 == 1, " PLAN>second </PLAN>").otherwise(""))
    return _turns(spark, d).select("conv_id", "turn", text.last_plan(c).alias("plan"))


_THINK_SQL = "(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'first</think>' || chr(10) || text WHEN 2 THEN '</think>' || text ELSE 'a</think>b' || text || '</think>' || chr(10) || 'end' || chr(10) END)"


@query(f"""
WITH t AS (SELECT conv_id, turn, {_THINK_SQL} AS x FROM conversations),
u AS (SELECT *, length(x) - length(string_split(x, '</think>')[-1]) - 8 AS n FROM t)
SELECT conv_id, turn, CASE WHEN contains(x, '</think>') AND n > 0 THEN substr(x, 1, n) ELSE '' END AS thinking,
  regexp_replace(CASE WHEN contains(x, '</think>') AND n > 0 THEN string_split(x, '</think>')[-1] ELSE x END, '\\A\\n+|\\n+\\z', '', 'g') AS completion FROM u""")
def thinking_split(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("turn") % 4, F.col("text")
    x = F.when(k == 0, t).when(k == 1, F.concat(F.lit("first</think>\n"), t)).when(k == 2, F.concat(F.lit("</think>"), t)).otherwise(F.concat(F.lit("a</think>b"), t, F.lit("</think>\nend\n")))
    return _turns(spark, d).select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", text.thinking(F.col("x")).alias("thinking"), text.completion(F.col("x")).alias("completion"))


@query(r"SELECT conv_id, turn, regexp_replace(chr(27) || '[1;31m' || text || chr(27) || '[0m' || chr(27) || '[m!', '\x1B\[[0-9;]*m', '', 'g') AS plain FROM conversations")
def strip_ansi(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", text.strip_ansi(F.concat(F.lit("\x1b[1;31m"), F.col("text"), F.lit("\x1b[0m\x1b[m!"))).alias("plain"))


@query("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text || chr(10) END AS x FROM documents),
u AS (SELECT doc_id, x, string_split(regexp_replace(x, '\\n\\z', ''), chr(10)) AS l FROM t)
SELECT doc_id, CASE WHEN x = '' THEN 'NONE' ELSE array_to_string(l[greatest(len(l) - 9, 1):], chr(10)) END AS tail FROM u""")
def error_tail(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("text", F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", text.error_tail(x).alias("tail"))


@query("SELECT conv_id, turn, text || '</s>' AS prompt, text || '</s>' || role || '</s>' AS whole FROM conversations")
def eos_join(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", messages.with_eos(F.col("text")).alias("prompt"), messages.with_eos(F.col("text"), F.col("role")).alias("whole"))


@query("""
SELECT conv_id, turn, CASE WHEN fb AND docs THEN 'docs_feedback' WHEN fb THEN 'feedback' WHEN docs THEN 'docs' WHEN plan THEN 'code_with_plan' ELSE 'code' END AS template
FROM (SELECT conv_id, turn, turn % 2 = 1 AS fb, conv_id % 2 = 1 AS docs, conv_id % 3 = 1 AS plan FROM conversations)""")
def generation_table(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", generation_template(F.col("turn") % 2 == 1, F.col("conv_id") % 2 == 1, F.col("conv_id") % 3 == 1).alias("template"))


@query("SELECT event_id, coalesce(json_extract_string('{\"choices\":[{\"message\":{\"role\":\"assistant\",\"content\":\"' || event_type || '\"}}]}', '$.choices[0].message.content'), '') AS content, '' AS missing FROM events")
def json_choice(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("event_type").alias("content")).alias("message"))).alias("choices")))
    return table(spark, d, "events").select("event_id", text.first_choice(body).alias("content"), text.first_choice(F.lit('{"choices":[]}')).alias("missing"))


@query("""
SELECT conv_id, turn, text AS description, nxt AS completion FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND nrole = 'assistant'""")
def pair_by_position(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's next: (conv_id, turn, description, completion)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, d).select("conv_id", "turn", "role", F.col("text").alias("description"), F.lead("text").over(w).alias("completion"), F.lead("role").over(w).alias("nrole"))
    return t.where("role = 'user' AND nrole = 'assistant'").select("conv_id", "turn", "description", "completion")


PAIRS_SQL = """(SELECT conv_id, turn, text AS description, nxt AS completion FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND nrole = 'assistant')"""
