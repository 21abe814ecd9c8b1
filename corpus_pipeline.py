"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read
again as the next one's documents.  All but the last return the columns of documents.

Rows: a text that is null, empty or without a letter has no language and goes with the
second stage; nulls in other columns pass.  Texts of any length are treated whole.  Ties go
to the smaller key.  Of equal rows, and of near copies whatever their keys, one stays; rows
without words are no copies of each other.  Empty tables stay empty; without a label to learn
from every document passes the first stage, without a language to learn from the second.
Extra columns pass through the first four stages under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantlens.llm import jaccard, langid, lines, packing, quality
from merchantlens.llm.queries import table, vocabulary
from merchantlens.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A language below this score is not recognised.
LEAST_SCORE = 0.3
#: Near copies share 0.8 of their shingles of five words; the query op8 has a rule of its own.
NEAR = jaccard.Rule(width=5, numerator=80, denominator=100)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the table of labels, keeps."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; all if no text has a language to learn from."""
    network = langid.fit(docs)
    if network is None:
        return docs
    found = langid.predict(docs, network)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select("row.*")


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows where lines went."""
    found = lines.dedup(docs)
    changed = F.col("n_dropped") > 0
    new = {
        "text": F.col("kept"),
        "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType),
    }
    row = F.col("row")
    return found.select(
        *[
            (F.when(changed, new[name]).otherwise(row[name]) if name in new else row[name]).alias(name)
            for name in docs.columns
        ]
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, whatever its key."""
    return jaccard.first_of_each(docs, rule=NEAR, unkeyed=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("line dedup", without_frequent_lines),
    ("n-gram Jaccard join", one_of_each),
    ("packing", packed),
]

#: The classifiers are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
