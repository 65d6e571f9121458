"""The operators applied to the driver's tables, and oracle SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mining_queries
from graphloom.llm.ann import ann_search
from graphloom.llm.chat_format import format_conversations, loss_text
from graphloom.llm.context_mixing import mix_documents
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.language_id import identify, train
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.ngram_join import jaccard_groups
from graphloom.llm.packing import pack_documents
from graphloom.llm.sentencepiece_codec import encode_documents
from graphloom.llm.substring_dedup import dedup_substrings
from graphloom.tables import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PLANTED_TURN = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TURN).alias("text"),
    )
    out = format_conversations(rows.unionByName(planted))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + length(role) END AS marks,
    length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|[<\[|](?:INST\]|/INST\]|s>|/s>|/\|>)'))
      + len(regexp_extract_all(text, '[<\[|]\|')) + len(regexp_extract_all(text, '[<\[|]>')) AS extra,
    regexp_matches(text, '\\.', 's') OR (role = 'user' AND contains(text, '[/INST]')) OR (role = 'assistant' AND contains(text, '</s>'))
      OR (role = 'system' AND contains(text, '<</SYS>>')) OR (role NOT IN ('user', 'assistant', 'system') AND contains(text, '<|/|>')) AS clash
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(marks + length(text)) + CASE WHEN bool_or(clash) THEN sum(extra) ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
), sized AS (SELECT *, len(words)::BIGINT AS n FROM docs),
wins AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, n - 49)) AS i FROM sized WHERE n >= 50)
), firsts AS (SELECT w, min(doc_id) AS first FROM wins GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS pos FROM wins JOIN firsts USING (w) WHERE first < doc_id
), word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM sized),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT s.doc_id, n AS n_words, n - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM sized s LEFT JOIN kept USING (doc_id)
"""


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents WHERE doc_id IS NOT NULL
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM hot)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
), starts AS (
  SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words)::BIGINT - 4))) AS i FROM docs WHERE len(words) > 0
), shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * meets.n >= 75 * (p.n + q.n - meets.n)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM docs d JOIN reach ON d.doc_id = reach.x LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(~held_out & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "pipeline": pipeline,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_ann": op3_ann,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_ngram_join": op8_ngram_join,
        "op9_packing": op9_packing,
        "op10_language_id": op10_language_id,
        **mining_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_ngram_join": OP8_SQL, **mining_queries.SQL}
