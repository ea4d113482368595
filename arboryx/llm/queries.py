"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import align, chat, e8, exact, html, lm, merkle, mixing, packing, quality, simhash, substring, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat.read_chat(F.col("formatted"))
    lines = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return (
        chat.format_chat(turns.union(extra))
        .withColumn("back", back)
        .withColumn("loss", chat.loss_text(F.col("segments")))
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(lines, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.label_grades(_table(spark, sf_dir, "labels")), 3)
    return quality.grade(docs, model, least_grade=2)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm.score(_table(spark, sf_dir, "documents"), held_out, _tokenizer("piece_bpe_32k.model"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    return merkle.verify(docs, changed={"text": tampered})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_chat": op2_chat,
        "op3_topk": op3_topk,
        "op4_mixing": op4_mixing,
        "op5_quality": op5_quality,
        "op6_html": op6_html,
        "op7_packing": op7_packing,
        "op8_lattice_lm": op8_lattice_lm,
        "op9_lattice": op9_lattice,
        "op10_simhash": op10_simhash,
        "op11_exact": op11_exact,
        "op12_merkle": op12_merkle,
        "op13_alignment": op13_alignment,
        "pipeline": corpus_pipeline.run,
    }


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w),
k AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM s),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE n > 1),
each AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length(role) + length(text) + length(regexp_replace(role || text, '[^]<>\\[]', '', 'g'))
             + length('[TURN ') + length(']') + 1 + length('</s>') + 1) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP12_SQL = r"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
           || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
           || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
           || CASE WHEN x.t IS NULL THEN '-' ELSE octet_length(encode(x.t)) || ':' || x.t END) AS h, x.k
  FROM documents, LATERAL (VALUES (0, text), (1, CASE WHEN list_reduce(
           list_concat([4294967295], flatten(list_transform(CAST(string_split(CAST(doc_id AS VARCHAR), '') AS VARCHAR[]), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END)) x(k, t)
), first AS (
  SELECT a.doc_id, a.g, a.h, b.h AS seen, CAST(row_number() OVER (PARTITION BY a.g ORDER BY a.doc_id) - 1 AS BIGINT) AS pos,
         count(*) OVER (PARTITION BY a.g) AS n
  FROM leaf a JOIN leaf b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k = 1
), low AS (
  SELECT 0 AS level, g, pos, h, n FROM first
  UNION ALL
  SELECT level + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY level, g, pos // 3
), sub AS (SELECT g, h, CAST(row_number() OVER (ORDER BY g) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM low WHERE n = 1), high AS (
  SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, pos // 3
), nodes AS (
  SELECT level, g, pos, h, n FROM low
  UNION ALL SELECT h.level, '/', h.pos, h.h, h.n FROM high h
), beside AS (
  SELECT a.level, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.g, a.pos
), climb AS (
  SELECT doc_id, g AS own, g, 0 AS level, pos, seen, '' AS proof FROM first
  UNION ALL
  SELECT doc_id, own, CASE WHEN b.pos IS NOT NULL THEN c.g ELSE '/' END, CASE WHEN b.pos IS NOT NULL THEN c.level + 1 ELSE 0 END,
         CASE WHEN b.pos IS NOT NULL THEN c.pos // 3 ELSE s.pos END,
         CASE WHEN b.pos IS NOT NULL THEN sha256(l || seen || r) ELSE seen END, CASE WHEN b.pos IS NOT NULL THEN proof || l || r ELSE proof END
  FROM climb c LEFT JOIN beside b ON b.g = c.g AND b.level = c.level AND b.pos = c.pos LEFT JOIN sub s ON s.g = c.g
  WHERE b.pos IS NOT NULL OR c.g <> '/'
), top AS (SELECT doc_id, own, seen, proof FROM climb c LEFT JOIN beside b ON b.g = c.g AND b.level = c.level AND b.pos = c.pos WHERE c.g = '/' AND b.pos IS NULL)
SELECT t.doc_id, f.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, t.seen AS folded_root, t.seen = r.h AS verified
FROM top t JOIN first f ON f.doc_id = t.doc_id JOIN sub s ON s.g = t.own CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1_SQL, "op2_chat": OP2_SQL, "op3_topk": OP3_SQL, "op11_exact": OP11_SQL, "op12_merkle": OP12_SQL}
