"""The corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds
the columns of its operator. Results are written between stages, so each can be run again on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import decontaminate, language, pieces, simhash, suffix_dedup
from depweave.llm._common import cut

#: Below this pooled probability a document is in no language for sure.
MIN_SCORE = 0.3


def beside(docs: DataFrame, *results: str) -> tuple[DataFrame, list[Column]]:
    """docs with new names for its columns that are named like an operator's results, and what gives docs's own
    columns back afterwards."""
    names = {}
    for c in docs.columns:
        names[c] = c
        while names[c].lower() in results or (names[c] != c and names[c] in docs.columns):
            names[c] += "_own"
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those that no language fits; rows that repeat fare alike."""
    rows, own = beside(docs, "lang_pred", "score")
    judged = language.predict(rows, language.learn(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup by 5-word shingles with links of a likeness of 0.8 or more: of each group the row of least
    doc_id stays, of rows that repeat it one. Rows without a doc_id stay; a null text is an empty one."""
    found = simhash.similar(docs)
    kept = found.where("is_first").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that smaller documents hold; a document of which nothing is left goes, as does a null text;
    the others' text and n_chars are the new ones."""
    rows, own = beside(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    found = suffix_dedup.suffix_dedup(rows).where("kept <> ''")
    return found.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with any word in a benchmark window, however small a part of them it is. Of those that stay a
    null text, which holds no word, is empty."""
    rows, own = beside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(*own)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document, and adds what that gives (columns of such names are replaced)."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_bytes),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", to_pieces),
]
#: No stage but decontamination can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
