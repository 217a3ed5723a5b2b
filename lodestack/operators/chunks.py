"""Cutting texts into overlapping chunks at sentence ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scalars import squeezed, tokens_words


def split_text(text: Column, size: int = 1800, overlap: int = 180) -> Column:
    """Chunks of at most ``size`` characters; a cut falls on the last full stop of the second half, if any.

    White space is squeezed first; null and blank texts have no chunks.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be under half of size, or cutting would not advance")

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_pieces(t or "", size, overlap)))

    return cut(squeezed(text))


def _pieces(text: str, size: int, overlap: int):
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text):
            stop = max(text.rfind(mark, at, to) for mark in (".", "。"))
            to = stop + 1 if stop > at + size // 2 else to
        piece = text[at:to].strip()
        if piece:
            yield piece
        if to == len(text):
            return
        at = to - overlap


def chunked(docs: DataFrame, doc: str, parts: dict[str, str], size: int = 1800, overlap: int = 180) -> DataFrame:
    """``doc, chunk_no, chunk_type, text, tokens, n_chunks``: chunks of several columns, numbered through each document.

    ``parts`` names the chunk type of each text column, in order.
    """
    def typed(kind: str):
        return lambda t: F.struct(F.lit(kind).alias("chunk_type"), t.alias("text"))

    lists = [F.transform(split_text(F.col(c), size, overlap), typed(kind)) for kind, c in parts.items()]
    whole = docs.select(doc, F.concat(*lists).alias("chunks"))
    rows = whole.select(doc, F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("chunk_no", "c"))
    return rows.select(doc, "chunk_no", "c.chunk_type", "c.text", tokens_words(F.col("c.text")).alias("tokens"), "n_chunks")


def chunk_summary(chunks: DataFrame, doc: str) -> DataFrame:
    return chunks.agg(
        F.count_distinct(doc).alias("papers"), F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "full_text").alias("full_text_chunks"),
        F.count_distinct(F.when(F.col("chunk_type") == "full_text", F.col(doc))).alias("papers_with_full_text"), F.sum("tokens").alias("tokens"),
    )
