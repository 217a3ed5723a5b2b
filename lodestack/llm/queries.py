"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from ..tables import table
from . import decontaminate, lexical, piecetable
from .common import id_residue
from .langid import LanguageModel
from .mixing import mix
from .neardup import near_duplicates
from .piecetable import fill_in_middle, restored
from .quality import QualityRules
from .secrets import scan_secrets, span_text
from .sharding import assign_shards
from .substring import remove_repeats
from .suffixes import remove_repeated_bytes
from .tokens import read_tokens, write_tokens
from .toxicity import ToxicityModel


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the entropy-coded files."""
    import public_tokenizers

    path = new_path(spark, "token-blocks")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_residue(F.col("doc_id"), 3) == 1, F.lit(False))
    model = ToxicityModel.fit(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = model.score(docs)
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), F.size("spans").alias("n_spans"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier elsewhere."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    n = lambda k: F.size(F.filter(spans, lambda m: m["rank"] == k)).cast("long")
    base = span_text(F.filter(spans, lambda m: m["rank"] < 3))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = QualityRules.fit(docs)
    return rules.apply(docs.select("doc_id", "text")).drop("text")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24 and, with one more, among 25."""
    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents similar on 2-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_residue(F.col("doc_id"), 5) == 0, F.lit(True))
    model = LanguageModel.fit(docs.where(~held_out))
    found = model.predict(docs.drop("lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous", "distance")


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start anywhere else too."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, and the text as rebuilt from the output."""
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")).drop("pieces"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256")
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_blocks": op1_token_blocks,
        "op2_toxicity": op2_toxicity,
        "op3_source_mix": op3_source_mix,
        "op4_repeated_passages": op4_repeated_passages,
        "op5_secrets": op5_secrets,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_jump_shards": op8_jump_shards,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_language_id": op10_language_id,
        "op11_suffix_arrays": op11_suffix_arrays,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontaminate.ORACLE, "op12_fill_in_middle": piecetable.ORACLE, "op13_ranked_search": lexical.ORACLE}
