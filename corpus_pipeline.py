"""Cleaning a corpus from raw documents to token blocks, as stages over the documents table.

Every stage but the last returns columns of documents as it got them. Repeated rows are documents of their
own unless a stage says otherwise; null and empty texts go in the first stage; a null id is no reason to
drop a row. A table without rows passes through all stages. Columns beyond those of documents, whatever their
names, are kept by all stages but the last. Texts are used whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import fresh_name
from lodestack.llm.decontaminate import contaminated
from lodestack.llm.langid import UNDETERMINED, LanguageModel
from lodestack.llm.mixing import mixed
from lodestack.llm.neardup import near_duplicates
from lodestack.llm.tokens import read_tokens, write_tokens
from lodestack.storage import discard, new_path, stage
from lodestack.tables import table


#: A text of this many characters is long enough to be judged, and then may lie so far from its codeword.
JUDGED, FARTHEST = 200, 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the decoder rejects.

    These are null and letterless texts, and texts of ``JUDGED`` or more characters that are ambiguous or
    farther than ``FARTHEST`` from the nearest codeword, as texts in languages are that no row names. Shorter
    texts stay: too few grams to judge. Where no row names a language there is nothing to
    learn, and every text with a letter stays.
    """
    model = LanguageModel.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # other names, lest a column be taken for one that the model adds
    names = {c: f"{fresh_name(docs, 'given')}{i}" for i, c in enumerate(docs.columns)}
    found = model.predict(docs.toDF(*names.values()), text=names["text"])
    judged = F.length(names["text"]) >= JUDGED
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & ~(judged & (F.col("ambiguous") | (F.col("distance") > FARTHEST))))
    return kept.select(*[F.col(v).alias(k) for k, v in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component similar on 5-word shingles: the one of least id.

    Rows of one id with different texts are documents of their own; equal rows stay or go together. Rows with a null id
    and texts without words stay.
    """
    surplus = near_duplicates(docs, shingle=5, percent=80).where("not head")
    key, version = fresh_name(docs, "surplus_id"), fresh_name(docs, "surplus_version")
    gone = surplus.select(F.col("doc_id").alias(key), F.col("version").alias(version)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(key)) & (F.hash("text") == F.col(version)), "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; all rows of such a document's id. Null ids stay."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix to the sources' target weights takes it, also of repeated and null ids."""
    return mixed(docs)


def write_token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode to token blocks; per document what the files hold, as read back. Null ids come first."""
    import public_tokenizers

    path = new_path(spark, "pipeline-tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_blocks", write_token_blocks),
]

#: A trained model and a tokenizer library decide in it; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a later stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
