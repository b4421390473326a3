"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import chat, collocations, covertree, merkle, oracles, packing, phrases, pieces, quality, sharding, simhash, simple8b, toxicity, warc
from feedloom.llm.common import read
from feedloom.llm.tokens import BYTE_BPE, vocabulary_path

SEQUENCE_TOKENS = 1024
SHARDS = 24


def op1_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, with_decoded=True).select("doc_id", "n_tokens", "n_bytes", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


#: A conversation that holds the control strings of a common template, added to those of the table.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
QUERY_EVERY = 100


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(extra))).withColumnRenamed("conv", "conv_id")


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.with_quality(docs, quality.LABELLED_BANDS).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_substrings(read(spark, sf_dir, "documents"))


def op5_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE), longest=SEQUENCE_TOKENS, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.stored_tokens(read(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.quantised(read(spark, sf_dir, "embeddings"))
    return covertree.top_k(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0), 10)


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TAMPER_EVERY = 5


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    tampered = F.when(picked, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    found = merkle.manifest(read(spark, sf_dir, "documents"), presented={"text": tampered})
    root = merkle.folded(F.col("path"), F.col("shown"))
    proof = F.sha2(merkle.siblings_of(F.col("path")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


HELD_OUT_EVERY = 5


def op12_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_EVERY == 0
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits")


def op13_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_pieces": op1_suffix_pieces,
        "op2_prefix_targets": op2_prefix_targets,
        "op3_fertility_rules": op3_fertility_rules,
        "op4_phrase_automata": op4_phrase_automata,
        "op5_pow2_packing": op5_pow2_packing,
        "op6_simple8b": op6_simple8b,
        "op7_prefix_sum_shards": op7_prefix_sum_shards,
        "op8_simhash_bktree": op8_simhash_bktree,
        "op9_cover_tree": op9_cover_tree,
        "op10_warc_segments": op10_warc_segments,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_toxic_lexicon": op12_toxic_lexicon,
        "op13_stripes_collocations": op13_stripes_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
