"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    alignment,
    bpe,
    decontaminate,
    html_extract,
    jaccard_join,
    line_dedup,
    packing,
    pii,
    quality_rules,
    secrets,
    substring_dedup,
    suffix_tree,
    whitening,
)
from lodestone.llm.common import table

#: Public tokenizer files.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: The secret of the pseudonyms; a deployment sets its own.
PII_KEY = os.environ.get("PII_KEY", "pseudonym key")


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    got = bpe.encode_decode(table(spark, d, "documents"), WORD_BPE)
    return got.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html_extract(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def joined_spans(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(
        ",",
        F.transform(
            wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
    )


def op3_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = secrets.scan(docs, secrets.fit(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined_spans("spans", ("assign", "access", "hex")), 256).alias("base_sha256"),
        joined_spans("spans", secrets.KINDS).alias("spans"),
    )


def op4_suffix_tree(spark: SparkSession, d: str) -> DataFrame:
    return suffix_tree.score(table(spark, d, "documents"))


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return quality_rules.judge(docs.select("doc_id", "text"), quality_rules.learn(docs, labels)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op6_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, d, "documents")).select("doc_id", "text")


def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, d, "documents"))


def op9_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, d, "documents"))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY)


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    out = whitening.whiten(table(spark, d, "embeddings"))
    # Beyond 64 bits the exact deviation has no place in a long: null.
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), WORD_BPE, end=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.alignment_measures(table(spark, d, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html_extract": op2_html_extract,
    "op3_secrets": op3_secrets,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {}
