"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word in the sense of all contracts: a run without space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def id_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
