"""Document lengths in tokens, for the operators that pack and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.token_counts import with_tokens


def with_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens), one row for each row that has a doc_id; a table without source has it null."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"))
    return with_tokens(rows.where("doc_id is not null"))
