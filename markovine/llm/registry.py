"""Queries of this subpackage over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, compress_quality, ctw, hash_forest, html_text, langid, merkle, oracles, packing, pivot_topk, simhash, token_files, toxicity, vector_codes
from ._common import Scratch, crc_of_id, table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    docs = token_files.read_ids(spark, path)
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"))


def op6_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_stream.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 4 == 2
    model = langid.train(docs.where(~held_out), "lang")
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.read_pieces(spark, packing.write_sequences(docs, clusters=simhash.text_components(docs)))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 7 == 2
    scored = ctw.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 4 == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out), "toxic")
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 4 == 2
    model = compress_quality.train(docs, table(spark, sf_dir, "labels").where(~held_out), "quality")
    scored = compress_quality.predict(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "codes") as scratch:
        coded, books, _ = vector_codes.quantise(scratch, table(spark, sf_dir, "embeddings"))
        coded = scratch.written(coded, "coded")
        rows = vector_codes.per_label(coded).select(
            F.col("id").alias("vec_id"),
            F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
            "error",
            "label_error",
            F.lit(vector_codes.digest(books)).alias("codebooks_sha256"),
        )
        return written(rows, "codes")


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf_digest(*(F.translate("text", _AZ, _AZ.lower()) if c == "text" else F.col(c) for c in _LEAF))
    suspect = F.when(crc_of_id("doc_id") % 5 == 0, tampered)
    with Scratch(spark, "manifest") as scratch:
        return written(merkle.verify(docs, _LEAF, "source", "doc_id", {"doc_id": F.col("doc_id")}, suspect, scratch), "proofs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_html_extraction": op2_html_extraction,
        "op3_simhash": op3_simhash,
        "op4_pivot_topk": op4_pivot_topk,
        "op5_hash_forest": op5_hash_forest,
        "op6_bpe_stream": op6_bpe_stream,
        "op7_language_id": op7_language_id,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_context_tree": op9_context_tree,
        "op10_toxicity": op10_toxicity,
        "op11_compression_quality": op11_compression_quality,
        "op12_vector_codes": op12_vector_codes,
        "op13_merkle_proofs": op13_merkle_proofs,
    }


def oracle_sql() -> dict[str, str]:
    """The others cannot be written in SQL; tests hold them against brute force, exact round
    trips or held-out accuracy."""
    return {"op12_vector_codes": oracles.codes(), "op13_merkle_proofs": oracles.MERKLE}
