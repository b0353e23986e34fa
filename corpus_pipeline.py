"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. quality classifier: documents scored below 0.5 go,
2. SimHash near-dedup: of each group of near-duplicates the smallest doc_id stays,
3. benchmark decontamination: documents with a word in an occurrence of a test window go,
4. secret scans: base spans and owner-specific opaque strings are masked in the text,
5. SentencePiece encoding: ids of every text that is left.

SQL cannot express the stages; tests hold them against brute force.

Null and empty texts are scored like any other, are copies of one another, have no test words, secrets or tokens. Texts of
any length are read whole. Repeated rows are near-duplicates, of which one row stays, also where they share an id or have
none. An empty table gives empty ones. Columns besides those of documents may have any names and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import decontaminate, pieces, quality, secrets, simhash
from inkstream.llm.common import settle
from inkstream.llm.queries import read, tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8, bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs, length="n_chars" if "n_chars" in docs.columns else None)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
