"""The cleaning pipeline over ``documents``: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``, in their order and under their
names. Rows are judged one by one or by a key over all their columns, so ids may be null or repeated: a null or empty text
has no language and goes in the first stage; of equal rows, and of near copies, one stays (the smallest id, a null id being
the largest; ties by the key); a benchmark passage removes its own row only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import bpe_digests
from quillspark.llm.decontam import decontaminated
from quillspark.llm.language import fit, is_held_out, with_language
from quillspark.llm.ngram_join import near_duplicates_removed
from quillspark.llm.secret_scan import redact
from quillspark.session import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised (no letters, or no language over one half)."""
    return with_language(docs, fit(docs.filter(~is_held_out(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars is that of the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, decodes the ids, and returns counts and digests by document."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            docs = scratch.keep(docs, f"stage{i}") if i + 1 < len(STAGES) else scratch.result(docs, "pipeline")
        return docs


#: Fitting a language model and replaying merges have no SQL form.
ORACLE_SQL = None
