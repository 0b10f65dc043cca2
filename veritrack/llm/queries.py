"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrack.llm.bpe import encode_and_decode, token_digests
from veritrack.llm.embedding_dedup import embedding_near_duplicates
from veritrack.llm.language import fit_languages, identify_languages
from veritrack.llm.mixing import ROUNDS, TARGETS, TOLERANCE, mix_sources
from veritrack.llm.near_dup import minhash_near_duplicates
from veritrack.llm.packing import decompose, number_sequences, piece_digests
from veritrack.llm.quality_knn import fit_quality, score_quality
from veritrack.llm.quality_rules import apply_rules, fit_rules
from veritrack.llm.quotes import link_quotes
from veritrack.llm.token_counts import count_tokens, read_vocabulary
from veritrack.llm.toxicity import fit_toxicity, score_toxicity
from veritrack.llm.whitening import whiten
from veritrack.llm.word_runs import find_runs, planted, run_digests


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "n_tokens", "topic", F.round("chance", 6).alias("chance"), "sampled")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_digests(decompose(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return number_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_quality_neighbours": op3_quality_neighbours,
    "op4_quote_linking": op4_quote_linking,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_binary_packing": op11_binary_packing,
    "op12_whitening": op12_whitening,
    "op13_word_runs": op13_word_runs,
}

def _values(d: str) -> str:
    return ", ".join(f"('{k}', {v}::double)" for k, v in TARGETS[d].items())


def _cell(d: str) -> str:
    return f"CASE WHEN {d} IN ({', '.join(repr(k) for k in TARGETS[d])}) THEN {d} ELSE 'other' END"


def _rake(inner: str, d: str) -> str:
    return f"SELECT k, source, lang, topic, w * coalesce({d}_want, 0) / nullif(sum(w) OVER (PARTITION BY {d}), 0) w, greatest(err, abs(coalesce({d}_want, 0) - sum(w) OVER (PARTITION BY {d}))) err, source_want, lang_want, topic_want FROM ({inner})"


_MIXED = f"""WITH RECURSIVE words AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) n_tokens FROM documents),
d AS (SELECT *, CASE WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END topic FROM words),
c AS (SELECT doc_id, n_tokens, topic, {_cell("source")} source, {_cell("lang")} lang FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens)::double tokens FROM c GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0),
s AS (SELECT v, t / sum(t) OVER () want FROM (VALUES {_values("source")}) x(v, t) WHERE v IN (SELECT source FROM cells)),
l AS (SELECT v, t / sum(t) OVER () want FROM (VALUES {_values("lang")}) x(v, t) WHERE v IN (SELECT lang FROM cells)),
p AS (SELECT v, t / sum(t) OVER () want FROM (VALUES {_values("topic")}) x(v, t) WHERE v IN (SELECT topic FROM cells)),
it AS (SELECT 0 k, source, lang, topic, tokens w, 'infinity'::double err, s.want source_want, l.want lang_want, p.want topic_want FROM cells LEFT JOIN s ON s.v = source LEFT JOIN l ON l.v = lang LEFT JOIN p ON p.v = topic
 UNION ALL SELECT k + 1, source, lang, topic, coalesce(w, 0), max(err) OVER (), source_want, lang_want, topic_want FROM ({_rake(_rake(_rake(f"SELECT * REPLACE (0.0::double AS err) FROM it WHERE k < {ROUNDS} AND err >= {TOLERANCE}", "source"), "lang"), "topic")})),
ratio AS (SELECT source, lang, topic, w * (SELECT sum(tokens) FROM cells) / tokens r FROM it JOIN cells USING (source, lang, topic) WHERE k = (SELECT max(k) FROM it)),
ch AS (SELECT c.doc_id, n_tokens, c.topic, coalesce(round(r / (SELECT max(r) FROM ratio), 9), 0.0)::double chance FROM c LEFT JOIN ratio USING (source, lang, topic))
SELECT doc_id, n_tokens, topic, round(chance, 6) chance, ('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint / 4294967296.0::double < chance sampled FROM ch"""

#: The trained models, tokenizers and near-duplicate searches have no SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {"op8_source_mixing": _MIXED}
