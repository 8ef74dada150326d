"""Queries: labels, scores, rewards, windows and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fusion, text
from tessera.functions.vectors import rounded
from tessera.operators import columns, docs, rewards
from tessera.operators.codegraph import EXCLUDED, filter_names, vars_beyond_calls
from tessera.operators.loop import first_success
from tessera.plans.registry import ORACLES, query
from tessera.plans.responses import PAIRS_SQL, pairs, strip_sql
from tessera.sources.store import result_name, table


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


#: Places of lineitem rows: (l_orderkey, l_linenumber) repeats, these four do not at the tested scale.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_LINE_SQL = ", ".join(LINE)


@query("SELECT url, translate(url, '/-.', '___') AS clean FROM pages")
def name_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", fusion.sanitised(F.col("url")).alias("clean"))


@query("SELECT page_id, translate(string_split(url, '/')[-1], '-', '_') || '_lora_r' || (page_id % 64) AS name FROM pages")
def name_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fusion.model_name(F.col("url"), F.col("page_id") % 64).alias("name"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'r8_sft_' || page_id || '_checkpoint-' || page_id ELSE 'r16_grpo_' || page_id END AS label FROM pages""")
def adapter_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("out/model_lora_r8_sft_"), k, F.lit("/checkpoint-"), k)).otherwise(F.concat(F.lit("out/a_lora_b/model_lora_r16_grpo_"), k))
    return table(spark, d, "pages").select("page_id", fusion.adapter_label(path).alias("label"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '_geomean_text_visual' WHEN p_size % 4 = 1 THEN '_mean_text_visual' WHEN p_size % 4 = 2 THEN '_visual' ELSE '_text' END AS label FROM part""")
def run_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    return table(spark, d, "part").select("p_partkey", fusion.run_label(k.isin(0, 1, 3), k.isin(0, 1, 2), k == 0).alias("label"))


@query("SELECT p_partkey, regexp_matches(lower(p_name), 'moe|mixtral|experts|num_experts|router|blue') AS mixture FROM part")
def mixture_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fusion.is_mixture(F.col("p_name"), ("moe", "mixtral", "experts", "num_experts", "router", "blue")).alias("mixture"))


@query(f"SELECT {_LINE_SQL}, CAST(floor(l_quantity * 8 * l_discount) AS INT) AS prompt_tokens, CAST(l_quantity * 8 - floor(l_quantity * 8 * l_discount) AS INT) AS completion_tokens FROM lineitem")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("l_quantity") * 8
    a, b = fusion.token_budget(total, F.col("l_discount"))
    return table(spark, d, "lineitem").select(*LINE, a.alias("prompt_tokens"), b.alias("completion_tokens"))


@query("SELECT o_orderkey, CAST(floor(o_custkey / nullif(4 * 2 * (o_orderkey % 3), 0)) AS BIGINT) AS steps FROM orders")
def steps_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fusion.steps_per_epoch(F.col("o_custkey"), F.lit(4), F.lit(2), F.col("o_orderkey") % 3).alias("steps"))


@query("""
SELECT event_id, CASE t WHEN 'gspo' THEN 'sequence' WHEN 'grpo' THEN 'token' END AS level, CASE t WHEN 'gspo' THEN 0.0::DOUBLE WHEN 'grpo' THEN 0.005::DOUBLE END AS beta,
  CASE t WHEN 'gspo' THEN 0.0003::DOUBLE WHEN 'grpo' THEN 0.2::DOUBLE END AS epsilon, CASE t WHEN 'gspo' THEN 0.0004::DOUBLE END AS epsilon_high
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'gspo' WHEN 1 THEN 'grpo' ELSE 'sft' END AS t FROM events)""")
def hyperparam_case(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    h = fusion.hyper(F.when(k == 0, "gspo").when(k == 1, "grpo").otherwise("sft"))
    return table(spark, d, "events").select("event_id", h.alias("h")).select("event_id", "h.level", "h.beta", "h.epsilon", "h.epsilon_high")


@query("""
WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'sft_rag' WHEN 2 THEN 'sft_grpo_fb' WHEN 3 THEN 'sft_gspo_rag_fb' WHEN 4 THEN 'sft' ELSE 'other' END AS mode,
  CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'out/X_SFT_a' WHEN 2 THEN 'out/x_sft_grpo_b' ELSE 'out/x_sft_gspo_c' END AS p FROM events)
SELECT event_id, mode <> 'other' AS known, contains(mode, '_rag') AS rag, contains(mode, '_fb') AS fb,
  CASE WHEN contains(mode, 'sft_gspo') THEN CASE WHEN p = '' THEN 'sft_gspo adapter is missing' WHEN contains(lower(p), 'sft_gspo') THEN 'ok' ELSE 'not an sft_gspo adapter' END
    WHEN contains(mode, 'sft_grpo') THEN CASE WHEN p = '' THEN 'sft_grpo adapter is missing' WHEN contains(lower(p), 'sft_grpo') THEN 'ok' ELSE 'not an sft_grpo adapter' END
    WHEN contains(mode, 'sft') THEN CASE WHEN p = '' THEN 'sft adapter is missing' WHEN contains(lower(p), 'sft') AND NOT contains(lower(p), 'grpo') AND NOT contains(lower(p), 'gspo') THEN 'ok' ELSE 'not an sft adapter' END
    WHEN contains(mode, 'base') THEN CASE WHEN p = '' THEN 'ok' ELSE 'adapter ignored' END ELSE 'unknown mode' END AS status FROM m""")
def mode_validate(spark: SparkSession, d: str) -> DataFrame:
    names = ("base", "sft_rag", "sft_grpo_fb", "sft_gspo_rag_fb", "sft", "other")
    mode = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    path = F.element_at(F.array(*map(F.lit, ("", "out/X_SFT_a", "out/x_sft_grpo_b", "out/x_sft_gspo_c"))), (F.col("user_id") % 4 + 1).cast("int"))
    m = table(spark, d, "events").select("event_id", mode.alias("mode"), path.alias("p"))
    return m.select("event_id", fusion.mode_flags(F.col("mode")).alias("f"), fusion.mode_status(F.col("mode"), F.col("p")).alias("status")).select("event_id", "f.known", "f.rag", "f.fb", "status")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 GROUP BY ALL")
def range_check(spark: SparkSession, d: str) -> DataFrame:
    rounds = fusion.checked_range(F.col("l_linenumber"), 1, 10, "rounds")
    return table(spark, d, "lineitem").select("l_orderkey", rounds.alias("l_linenumber")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_matches(lower(p), '\\.(png|jpe?g|bmp)$') AS image FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.mp4' ELSE 'png' END AS p FROM pages)")
def media_extension(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".mp4", "png"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text.is_media(F.concat("url", ending)).alias("image"))


_NAMES_SQL = "[string_split(p_name, ' ')[1], 'self.' || p_partkey, 'x.' || string_split(p_name, ' ')[2], 'np.array', 'Scene.play', 'print', string_split(p_name, ' ')[1]]"


def _names() -> Column:
    w = F.split("p_name", " ")
    return F.array(w[0], F.concat(F.lit("self."), F.col("p_partkey").cast("string")), F.concat(F.lit("x."), w[1]), F.lit("np.array"), F.lit("Scene.play"), F.lit("print"), w[0])


_EXCLUDED_SQL = "(" + ", ".join(f"'{x}'" for x in EXCLUDED) + ")"


@query(f"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter({_NAMES_SQL},
  lambda n: NOT (string_split(n, '.')[1] IN {_EXCLUDED_SQL}) AND NOT (CASE WHEN contains(n, '.') THEN substr(n, instr(n, '.') + 1) ELSE n END IN {_EXCLUDED_SQL})))), ',') AS names FROM part""")
def builtin_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(filter_names(_names()), ",").alias("names"))


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: length(w) > 2)"


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(w), lambda x: NOT list_contains(w[1:10], x))), ',') AS words
FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)""")
def calls_minus(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: F.length(w) > 2)
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(vars_beyond_calls(F.col("w"), F.slice("w", 1, 10)), ",").alias("words"))


@query(f"""
SELECT doc_id, len(list_distinct({_WORDS_SQL})) AS names, array_to_string(list_sort(list_distinct(list_concat(w[1:len(w) // 2], w[len(w) // 4 + 1:]))), ',') AS joined
FROM (SELECT doc_id, text, {_WORDS_SQL} AS w FROM documents)""")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: F.length(w) > 2)
    w = table(spark, d, "documents").select("doc_id", words.alias("w"))
    return w.select("doc_id", F.size(F.array_distinct("w")).cast("long").alias("names"), F.array_join(F.array_sort(F.array_union(F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int")), F.slice("w", F.floor(F.size("w") / 4).cast("int") + 1, F.size("w")))), ",").alias("joined"))


_DOCS_SQL = "(SELECT n_name AS name, '(' || r_name || ')' AS sig, 'About ' || n_name || '. Examples: ' || r_name AS doc FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0)"


def _dimension(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 3 <> 0")
    return n.select(F.col("n_name").alias("name"), F.concat(F.lit("("), "r_name", F.lit(")")).alias("sig"), F.concat(F.lit("About "), "n_name", F.lit(". Examples: "), "r_name").alias("doc"))


@query(f"""
SELECT c_custkey, n_name AS name, coalesce(sig, '()') AS sig, coalesce(doc, 'Nothing is documented under ' || n_name || '.') AS doc
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN {_DOCS_SQL} x ON x.name = n_name""")
def doc_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return docs.look_up(names, _dimension(spark, d))


_ENTRY_SQL = f"""SELECT r_regionkey AS k, n_name AS name, coalesce(sig, CASE WHEN n_nationkey % 2 = 0 THEN '@property' ELSE ': int' END) AS sig, coalesce({strip_sql("string_split(doc, 'Examples')[1]")}, 'none') AS doc
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN {_DOCS_SQL} x ON x.name = n_name"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(_dimension(spark, d), F.col("n_name") == F.col("name"), "left")
    sig = F.coalesce("sig", F.when(F.col("n_nationkey") % 2 == 0, "@property").otherwise(": int"))
    return n.groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), sig.alias("sig"), F.coalesce("doc", F.lit("none")).alias("doc")))).alias("e"))


@query(f"SELECT k, string_agg('- **' || name || '**: signature `' || sig || '` - ' || doc || chr(10), chr(10) ORDER BY name) AS notes FROM ({_ENTRY_SQL}) GROUP BY k")
def doc_call_lines(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("k", docs.call_lines(F.col("e")).alias("notes"))


@query(f"""
SELECT k, string_agg('- **' || name || '**' || CASE WHEN sig LIKE '@property%' THEN ' ' || sig WHEN sig LIKE ':%' THEN ' (attribute' || sig || ')' ELSE ' (property/variable)' END || ' - ' || doc, chr(10) ORDER BY name) || chr(10) AS notes
FROM ({_ENTRY_SQL}) GROUP BY k""")
def doc_assignment_lines(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("k", docs.assignment_lines(F.col("e")).alias("notes"))


@query(f"SELECT {_LINE_SQL}, {r6('sqrt(greatest(l_discount * l_tax, 0.0::DOUBLE))')} AS geo FROM lineitem")
def geo_reward(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE, rounded(fusion.geometric(F.col("l_discount"), F.col("l_tax"))).alias("geo"))


@query(f"SELECT {_LINE_SQL}, {r6('l_discount * 0.2::DOUBLE + l_tax * 0.8::DOUBLE')} AS score FROM lineitem")
def weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE, rounded(fusion.weighted(F.col("l_discount"), F.col("l_tax"))).alias("score"))


@query(f"""
WITH t AS (SELECT {_LINE_SQL}, l_discount AS s, CASE l_linenumber % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE l_returnflag END AS code, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END AS path, l_partkey % 5 <> 0 AS there FROM lineitem)
SELECT {_LINE_SQL}, CASE WHEN code IS NULL OR trim(code) = '' THEN 0.0::DOUBLE ELSE s END AS text_score, CASE WHEN path IS NULL THEN 0.0::DOUBLE ELSE s END AS path_score,
  CASE WHEN code IS NOT NULL AND trim(code) <> '' AND path IS NOT NULL AND there THEN s ELSE 0.0::DOUBLE END AS visual_score FROM t""")
def guarded_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    code = F.when(k == 0, " ").when(k == 1, F.lit(None).cast("string")).otherwise(F.col("l_returnflag"))
    path = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus"))
    s = F.col("l_discount")
    return table(spark, d, "lineitem").select(*LINE, fusion.zero_if_blank(s, code).alias("text_score"), fusion.zero_if_missing(s, path).alias("path_score"), fusion.visual_or_zero(s, code, path, F.col("l_partkey") % 5 != 0).alias("visual_score"))


@query("""
SELECT doc_id, """ + ", ".join(f"CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE ELSE n_chars::DOUBLE END AS {k}" for k in fusion.BLANK_SCORES) + """, doc_id % 4 = 0 AS syntax_error FROM documents""")
def blank_metrics(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 4 == 0, "\n ").otherwise(F.col("text"))
    made = {k: F.col("n_chars").cast("double") for k in fusion.BLANK_SCORES} | {"syntax_error": F.lit(False)}
    return table(spark, d, "documents").select("doc_id", *fusion.blank_metrics(code, made))


@query(f"SELECT l.{', l.'.join(LINE)}, {r6('(round(l_discount * 100) - s / n::DOUBLE) / 100.0::DOUBLE')} AS advantage FROM lineitem l JOIN (SELECT l_orderkey AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1) g ON k = l_orderkey")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    whole = F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, d, "lineitem").select(*LINE, rounded(fusion.advantage(whole, F.col("l_orderkey")) / 100).alias("advantage"))


@query(f"SELECT {r6('avg(quality::DOUBLE)')} AS quality, {r6('avg(toxic::DOUBLE)')} AS toxic, {r6('avg((n_chars > 1000)::INT::DOUBLE)')} AS long_text, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", "toxic", (F.col("n_chars") > 1000).alias("long_text"))
    means = rewards.summary(t, ("quality", "toxic", "long_text"), count="n")
    return means.select(*[rounded(F.col(c)).alias(c) for c in ("quality", "toxic", "long_text")], "n")


@query("SELECT o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return rewards.best_checkpoint(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    return rewards.keep_last(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch FROM events")
def batch_number(spark: SparkSession, d: str) -> DataFrame:
    return columns.batches(table(spark, d, "events").select("user_id", "event_id", "ts"), 8, ["user_id"], "ts", "event_id").drop("ts")


@query(f"""
SELECT user_id, event_id, {r6("sum(v) OVER w / count(*) OVER w::DOUBLE / 100.0::DOUBLE")} AS running FROM (SELECT user_id, event_id, ts, CAST(floor(coalesce(value, 0) * 100 + 0.5) AS BIGINT) AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_watch_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.floor(F.coalesce("value", F.lit(0.0)) * 100 + 0.5).cast("long").alias("v"))
    return e.select("user_id", "event_id", rounded(rewards.running_mean(e, F.col("v"), "at", ["user_id"]) / 100).alias("running"))


@query("""
SELECT user_id, event_id, k AS round, ok FROM (SELECT *, min(CASE WHEN ok THEN k END) OVER (PARTITION BY user_id) AS stop FROM (
  SELECT user_id, event_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)) WHERE stop IS NULL OR k <= stop""")
def feedback_rounds(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("round"), (F.col("event_type") == "purchase").alias("ok"))
    return first_success(e, "user_id", "round", "ok")


@query("SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def previous_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("SELECT user_id, event_id, k AS frame_idx FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % greatest(1, CAST(floor((20 + user_id % 20) / 5) AS INT)) = 0")
def frame_decimate(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions.sequence import stride

    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    out = columns.decimate(e, stride(F.lit(20) + F.col("user_id") % 20), ["user_id"], "ts", "event_id")
    return out.select("user_id", "event_id", F.col("frame_idx").cast("long").alias("frame_idx"))


@query(f"SELECT {_LINE_SQL}, l_discount AS text_reward, l_tax AS visual_reward FROM lineitem WHERE l_linenumber <= 3")
def paired_rewards(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return rewards.paired(t.select(*LINE, F.col("l_discount").alias("text_reward")), t.where("l_linenumber <= 3").select(*LINE, F.col("l_tax").alias("visual_reward")), *LINE)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def length_mismatch(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return rewards.unpaired(o, o.where("o_orderkey % 10 <> 0"), "o_orderkey")


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS label, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def date_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("label"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))


@query("SELECT user_id, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) // 1 AS elapsed FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def elapsed_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("b"), F.min("ts").alias("a"))
    return e.select("user_id", (F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))).alias("elapsed"))


@query("SELECT page_id, 'eval_result_sft_rag_' || translate(url, '/-.', '___') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '_peft_r8_x' END || '_20250102_030405.csv' AS file FROM pages")
def result_file_name(spark: SparkSession, d: str) -> DataFrame:
    adapter = F.when(F.col("page_id") % 2 == 0, "").otherwise("a/m_lora_r8_x")
    return table(spark, d, "pages").select("page_id", result_name("sft_rag", F.col("url"), adapter, F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")).alias("file"))


@query("SELECT * FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0)")
def union_results(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang")
    return t.where("doc_id % 3 = 0").unionByName(t.where("doc_id % 2 = 0").select("lang", "doc_id"))


@query("""
SELECT doc_id, 'summary ' || lang AS visual_similarity, quality AS score, toxic AS extra FROM documents JOIN labels USING (doc_id)""")
def merge_score_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    g = t.select("doc_id", F.struct(F.lit("none").alias("visual_similarity"), F.lit(0).alias("score")).alias("g1"), F.struct(F.col("quality").alias("score"), F.concat(F.lit("summary "), "lang").alias("visual_similarity"), F.col("toxic").alias("extra")).alias("g2"))
    return columns.spread(g, "g1", "g2")


@query(f"""
SELECT {_LINE_SQL}, {r6('sqrt(greatest(l_discount * l_tax, 0.0::DOUBLE))')} AS visual_similarity, {r6('sqrt(greatest(l_tax * l_tax, 0.0::DOUBLE))')} AS codebertbleu, l_returnflag AS generated_code, l_linestatus AS expected_code FROM lineitem""")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(*LINE, F.col("l_discount").alias("ssim_score"), F.col("l_tax").alias("visual_semantic_score"), F.col("l_tax").alias("codebert_similarity"), F.col("l_tax").alias("codebleu"), F.col("l_returnflag").alias("generated_code"), F.col("l_linestatus").alias("expected_code"))
    out = rewards.evaluation_rows(t)
    return out.select(*LINE, rounded(F.col("visual_similarity")).alias("visual_similarity"), rounded(F.col("codebertbleu")).alias("codebertbleu"), "generated_code", "expected_code")


_OVERLAP_SQL = "len(list_intersect(list_distinct(string_split(lower(description), ' ')), list_distinct(string_split(lower(completion), ' '))))"


@query(f"""
WITH p AS {PAIRS_SQL}, s AS (SELECT conv_id % 5 AS mode, CASE WHEN turn % 4 = 2 THEN 0 ELSE {_OVERLAP_SQL} END AS hits, len(list_distinct(string_split(lower(description), ' '))) AS n FROM p)
SELECT mode, count(*) AS pairs, {r6('avg(floor(hits / n::DOUBLE * 1000000) / 1000000)')} AS text_score, {r6('avg(floor(sqrt(hits / n::DOUBLE) * 1000000) / 1000000)')} AS fused, {r6('avg((hits > 0)::INT::DOUBLE)')} AS success FROM s GROUP BY mode""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: responses are parsed, scored against their descriptions, fused and averaged."""
    answer = F.when(F.col("turn") % 4 == 2, F.lit("no code here")).otherwise(F.concat(F.lit("done:\n<code>\n"), "completion", F.lit("\n</CODE>")))
    p = pairs(spark, d).select((F.col("conv_id") % 5).alias("mode"), "description", text.last_code(answer).alias("code"))
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    cut = lambda c: F.floor(c * 1_000_000) / 1_000_000
    hits = F.when(text.is_blank(F.col("code")), 0).otherwise(F.size(F.array_intersect(words("description"), words("code"))))
    s = p.select("mode", hits.alias("hits"), F.size(words("description")).alias("n"))
    share = F.col("hits") / F.col("n")
    scored = s.select("mode", cut(share).alias("text_score"), cut(fusion.geometric(share, F.lit(1.0))).alias("fused"), (F.col("hits") > 0).alias("success"))
    means = scored.groupBy("mode").agg(F.count("*").alias("pairs"), *[F.avg(F.col(m).cast("double")).alias(m) for m in ("text_score", "fused", "success")])
    return means.select("mode", "pairs", *[rounded(F.col(m)).alias(m) for m in ("text_score", "fused", "success")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, " + r6("sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*)::DOUBLE / 100.0::DOUBLE") + " AS mean_reward FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def strategy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: means for each configuration and their totals."""
    t = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"))
    return t.select("l_returnflag", "l_linestatus", "n", rounded(F.col("s") / F.col("n") / 100).alias("mean_reward"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS ok, " + r6("sum((event_type = 'purchase')::INT) / count(*)::DOUBLE") + " AS rate FROM events GROUP BY 1")
def stream_success_rate(spark: SparkSession, d: str) -> DataFrame:
    """Extension: a stream of the events, read to its end."""
    from tessera.sources.store import shared_path
    from tessera.streaming.rates import event_stream, run_to_table, success_rate

    stream = success_rate(event_stream(spark, d, "events.parquet", table(spark, d, "events").schema), F.col("event_type") == "purchase")
    out = run_to_table(stream.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), shared_path(spark, "rates"), shared_path(spark, "offsets"))
    return out.select("window_start", "n", "ok", rounded(F.col("rate")).alias("rate"))


@query(ORACLES["feedback_rounds"])
def feedback_stream(spark: SparkSession, d: str) -> DataFrame:
    """feedback_rounds over a stream whose files come out of order: each event up to a day late by its hash, ten days of events a file."""
    from tessera.sources.store import shared_path
    from tessera.streaming import rates, rounds

    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    come = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    folder, width = shared_path(spark, "arrivals"), 10 * 86_400
    low, high = events.agg(F.min(come), F.max(come)).first()
    starts = range(low or 0, (high or -1) + 1, width)
    for start in starts:
        events.where(come.between(start, start + width - 1)).write.mode("append").parquet(folder)
    end = spark.range(1).select(*[F.lit(-1).cast(events.schema[c].dataType).alias(c) for c in ("user_id", "event_id")], (F.lit(rounds.CLOSING).cast("timestamp") + F.expr("INTERVAL 1 YEAR")).alias("ts"), F.lit(False).alias("ok"))
    end.write.mode("append").parquet(folder)
    # Files of one arrival may come in any order, so the lateness is a width and a day. A batch takes about an arrival, for each goes over all that waits.
    files = max(8, -(-len(spark.read.schema(events.schema).parquet(folder).inputFiles()) // max(1, len(starts))))
    with rounds.state_store(spark):
        stream = rounds.attempts(rates.event_stream(spark, folder, "*.parquet", events.schema, files), "user_id", "event_id", "ts", "ok", "11 days")
        return rounds.run_appended(stream, shared_path(spark, "rounds"), shared_path(spark, "offsets"))
