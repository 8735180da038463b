"""One query per operator over its whole table, with the digest columns of its contract, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import ann, byte_bpe, embedding_dedup, hard_negatives, line_dedup, merkle, packing, quality, sentence_bpe, simhash, substring, token_files, toxicity
from anchorline.llm.labelled import fold, training_rows
from anchorline.llm.tokens import vocabulary_path

#: Labelled rows that a classifier is fitted on at most, about.
MAX_ROWS = 20_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def _judged(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(training_rows(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, MAX_ROWS))
    return _judged(quality.score(docs, model), 4, 2)


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(training_rows(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, MAX_ROWS))
    return _judged(toxicity.score(docs, model), 3, 1)


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_words", "n_removed"))
    kept = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")))


@query("op9_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", F.coalesce("n_lines", F.lit(1)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_ann")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op12_merkle", r"""
WITH RECURSIVE field AS (
  SELECT doc_id, n_chars, coalesce('1' || lang, '0') AS tree,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(text) || ':' || text, '-') AS after,
         list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                     lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || after) END AS other
  FROM field),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroot AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
step AS (
  SELECT d.tree, d.pos, me.level AS seq, CASE WHEN s.h IS NULL THEN '-' WHEN me.pos % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM placed d JOIN node me ON me.tree = d.tree AND me.pos = d.pos >> me.level AND me.n > 1 LEFT JOIN node s ON s.tree = d.tree AND s.level = me.level AND s.pos = xor(me.pos, 1)
  UNION ALL
  SELECT d.tree, d.pos, 1000 + me.level, CASE WHEN s.h IS NULL THEN '-' WHEN me.pos % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
  FROM placed d JOIN subroot r ON r.tree = d.tree JOIN top me ON me.pos = r.pos >> me.level AND me.n > 1 LEFT JOIN top s ON s.level = me.level AND s.pos = xor(me.pos, 1)),
way AS (SELECT tree, pos, list(step ORDER BY seq) AS steps FROM step GROUP BY tree, pos),
done AS (
  SELECT d.doc_id, d.leaf, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(w.steps, []), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce([coalesce(d.other, d.leaf)] || coalesce(w.steps, []), lambda now, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || now WHEN 'R' THEN now || x[2:] ELSE now END)) AS folded_root
  FROM placed d JOIN subroot r USING (tree) LEFT JOIN way w ON w.tree = d.tree AND w.pos = d.pos)
SELECT *, folded_root = root AS verified FROM done""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    done = merkle.verify(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered, fold(F.col("doc_id"), 7) == 0)
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("piece_bpe_32k.model")
    done = sentence_bpe.decode(sentence_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
