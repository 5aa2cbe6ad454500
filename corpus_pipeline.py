"""A corpus cleaned, deduplicated, mixed and encoded: the stages of `STAGES`, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.llm import bpe, line_dedup, mixing, quality, simhash
from recurva.llm.queries import held_out
from recurva.llm.text import read_table
from recurva.session import scratch_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the rule ensemble gives a probability of at least one half of being good.

    The rules are learned from the labels of these documents that are not held out. Rows with NULL ids are scored like
    any other, NULL texts like empty ones, and long texts whole; a score of one half stays. Repeated rows share a score. Other columns
    pass through, whatever their names; an empty table gives an empty table.
    """
    rules = quality.learn_rules(docs, read_table(spark, sf_dir, "labels"), ~held_out(3, 1))
    scored = quality.score_quality(docs, rules, name="__score")
    return scored.where(F.col("__score") >= 0.5).drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that two others at least share and a later one keeps; `n_chars` follows the text.

    No row goes. NULL texts become empty ones. Rows that repeat an id are one document, and those with a NULL id none; of the ids that
    hold a line the largest keeps it. Other columns pass through, whatever their names; an empty table gives an empty table.
    """
    own = {name: f"__own_{name}" for name in ("n_lines", "n_dropped") if name in docs.columns}  # not those of the operator
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({held: name for name, held in own.items()}).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows that repeat this id stay together. Texts without words, NULL ones among them, are one group. A row with a NULL id goes where
    its group has an id, and stays where it has none. Other columns pass through, whatever their names; an empty table gives an
    empty table.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them, as often as it takes them; those it takes none of go.

    So do NULL and blank texts. A NULL source is a source of its own, and a NULL id an id like others. Rows equal in id, source and
    text become one that holds what the mix takes of all. Other columns pass through, whatever their names; an empty table gives an
    empty table.
    """
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its source, token ids, their number, and digests of the ids and of the bytes they decode to.

    NULL and empty texts have no ids; long ones are encoded whole. Repeated rows and NULL ids stay as they are, other columns are
    left out, whatever their names, and an empty table gives an empty table.
    """
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern, keep_text=False)
    both = bpe.decode(ids, ranks, pattern)
    return both.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_documents),
]

#: Rules, fingerprints, permutations and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each one's rows written to the folder for checkpoints and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
