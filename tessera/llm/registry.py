"""The package's queries over the corpus tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(found) if name in ("documents", "pages") else found


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import language_id
    from tessera.llm.sampling import fold

    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(F.col("doc_id"), 5) != 0)
    found = language_id.identify(docs, model, F.col("doc_id").cast("long"), "doc_id")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity
    from tessera.llm.sampling import fold

    docs = _table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, index).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality_rules

    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality_classifier
    from tessera.llm.sampling import fold

    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return quality_classifier.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import chat_format

    conversations = _table(spark, sf_dir, "conversations")
    model = chat_format.fit(conversations, chat_format.learned_from(F.col("conv_id")))
    return chat_format.format_transcripts(chat_format.as_transcripts(conversations), model)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import align

    aligned = align.align(_table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align.counted(aligned, piece_path(), groups_sha256=digest)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import merkle
    from tessera.llm.sampling import fold

    docs = _table(spark, sf_dir, "documents")
    # Tampering lower-cases the text of every fifth id; what is hashed beside it stays.
    tampered = F.when(F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)), F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = merkle.manifest(docs, merkle.leaf(*values, F.col("text")), seen=merkle.leaf(*values, tampered))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import language_model
    from tessera.llm.sampling import fold

    docs = _table(spark, sf_dir, "documents")
    model, counts = language_model.fit(docs, fold(F.col("doc_id"), 10) != 0)
    found = language_model.score(docs, model, counts)
    held_out = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _run_up(name: str, key: str, steps: int) -> str:
    """CTEs name1 .. name<steps>: the nodes of a level are the digests of runs of 16 of the level below, where more than one is left."""
    out = []
    for i in range(steps):
        out.append(f"""{name}c{i} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{i}),
{name}{i + 1} AS (
  SELECT {key}, CAST(CASE WHEN n > 1 THEN idx // 16 ELSE idx END AS BIGINT) AS idx, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
  FROM {name}c{i} GROUP BY {key}, n, CASE WHEN n > 1 THEN idx // 16 ELSE idx END)""")
    return ",\n".join(out)


def _run_down(name: str, key: str, start: str, prior: str, steps: int) -> str:
    """CTEs <start>1 .. : for rows (key, idx, cur, proof) of <prior>, the siblings of each level are joined on, and `cur` is folded with them."""
    out = []
    for i in range(steps):
        out.append(f"""{start}{i + 1} AS (
  SELECT p.* EXCLUDE (idx, cur, proof), CASE WHEN s.n > 1 THEN p.idx // 16 ELSE p.idx END AS idx,
    CASE WHEN s.n > 1 THEN sha256(s.before || p.cur || s.after) ELSE p.cur END AS cur, CASE WHEN s.n > 1 THEN p.proof || s.before || s.after ELSE p.proof END AS proof
  FROM {prior if not i else f"{start}{i}"} p JOIN (
    SELECT {key} AS k, idx, any_value(n) AS n,
      coalesce(string_agg(o, '' ORDER BY oi) FILTER (oi < idx), '') AS before, coalesce(string_agg(o, '' ORDER BY oi) FILTER (oi > idx), '') AS after
    FROM (SELECT a.{key}, a.idx, a.n, b.h AS o, b.idx AS oi FROM {name}c{i} a JOIN {name}c{i} b ON a.{key} = b.{key} AND a.idx // 16 = b.idx // 16) GROUP BY {key}, idx) s
  ON p.{key} = s.k AND p.idx = s.idx)""")
    return ",\n".join(out)


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def op12_sql(levels: int = 7, above: int = 4) -> str:
    """Trees of up to 16**levels rows a source and 16**above sources, level by level; crc32 bit by bit."""
    crc = "list_reduce(list_prepend(4294967295, [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, _: xor(x // 2, (x % 2) * 3988292384)))"
    row = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH docs AS (
  SELECT doc_id, source, sha256({row} || {_field("text")}) AS h,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({row} || {_field(lower)}) ELSE sha256({row} || {_field("text")}) END AS seen
  FROM documents
), trees AS (SELECT *, CAST(dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS BIGINT) AS tree, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS BIGINT) AS idx FROM docs),
x0 AS (SELECT tree, idx, h FROM trees),
{_run_up("x", "tree", levels)},
y0 AS (SELECT 0 AS top, tree AS idx, h FROM x{levels}),
{_run_up("y", "top", above)},
p AS (SELECT doc_id, h AS leaf, tree, idx, seen AS cur, '' AS proof FROM trees),
{_run_down("x", "tree", "p", "p", levels)},
q AS (SELECT doc_id, leaf, tree, 0 AS top, tree AS idx, cur, proof FROM p{levels}),
{_run_down("y", "top", "q", "q", above)}
SELECT q.doc_id, q.leaf, s.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = r.h AS verified
FROM q{above} q JOIN x{levels} s ON q.tree = s.tree CROSS JOIN y{above} r
"""


#: Base-32 of SHA-1: eight groups of five hex digits, each four characters.
OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages
), g AS (SELECT h, max(page_id) AS holder FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(p.h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = g.holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = g.holder THEN NULL ELSE g.holder END AS refers_to
FROM p JOIN g ON p.h = g.h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_license_scan": op3_license_scan,
        "op4_quality_rules": op4_quality_rules,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_harmonic_packing": op10_harmonic_packing,
        "op11_token_alignment": op11_token_alignment,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_language_model": op13_language_model,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_round_trip": OP8_SQL, "op12_merkle_manifest": op12_sql()}
