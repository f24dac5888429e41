"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, quality, spelling, token_alignment, toxicity
from .decontaminate import contamination
from .fingerprint import edited, exact_groups
from .html_wrappers import main_texts
from .jaccard_join import jaccard_components
from .language_id import identify
from .line_dedup import line_classes
from .packing import pack


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the first line of its class; duplicates are equal or within two edits."""
    return line_classes(_table(spark, sf_dir, "documents"), edits=2, shortest=10, equal_from=1)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), "quality"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, its declared language and its source."""
    return identify(_table(spark, sf_dir, "documents"), declared="lang", host="source").drop("row").withColumnRenamed("accepted", "keep")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    return chat_format.digests(chat_format.format_chats(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all tokenised documents in sequences of at most 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, closing_id=0)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    return main_texts(_table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from its nearest labelled examples, which are named."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the group of equal canonical texts."""
    docs = _table(spark, sf_dir, "documents")
    rows = edited(docs)
    groups = exact_groups(docs, rows.select("doc_id", "fingerprint")).dropDuplicates(["doc_id", "fingerprint"])
    groups = groups.toDF("group_doc_id", "group_fingerprint", "group_id", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("group_doc_id")) & (F.col("fingerprint") == F.col("group_fingerprint"))
    return rows.join(groups, same).drop("group_doc_id", "group_fingerprint")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any occurrence of a 10-word benchmark window."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between a byte-level BPE and a sentence-piece model."""
    import public_tokenizers

    a = byte_bpe.Vocabulary.of_json(tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_alignment.alignments(_table(spark, sf_dir, "documents"), token_alignment.Pair.of_files(a, tokenizer_path("piece_bpe_32k.model")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.of_ranks(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), vocabulary)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every word of the documents, with planted typing slips."""
    return spelling.variants(_table(spark, sf_dir, "documents"), shortest=6, least=5, ratio=5, slip=spelling.crc_slips(199))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_classifier,
        op3_language_id,
        op4_chat_formatting,
        op5_best_fit_packing,
        op6_html_extraction,
        op7_jaccard_join,
        op8_toxicity,
        op9_document_fingerprints,
        op10_decontamination,
        op11_token_alignment,
        op12_byte_bpe,
        op13_spelling_variants,
    )
}

#: DuckDB SQL where SQL can state the result and run on whole tables
ORACLE: dict[str, str] = {"op4_chat_formatting": chat_format.SQL, "op13_spelling_variants": spelling.SQL}
