"""A corpus through five stages: quality, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of `documents`. `run` writes each stage's rows as Parquet to the shared folder and reads them
back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvia.llm import bpe, minhash, mixing, quality, secrets
from pluvia.llm.common import crc_bucket, stored
from pluvia.llm.queries import tokenizer
from pluvia.sources.tables import table

#: Two stages are learned models and tokens of a vocabulary file, which SQL cannot express.
ORACLE_SQL = None


#: Near copies are texts whose sets of five-word shingles have a similarity of this many percent at least.
NEAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Each row is judged by its own text, so that repeated rows stay or go together. A null or empty text has
    the model's bias as its score; without labels all score 0.5 and stay.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return quality.passing(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Of rows that share a doc_id only those with linked texts go; texts without a word are no copies of one
    another, unless they share a doc_id; rows without doc_id stay.
    """
    return minhash.deduplicated(docs, link=NEAR)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by their kind. A null text stays null; rows are taken one by one."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not, once or twice.

    A null source is one of its own. A text without a word has nothing to take and is not drawn. Rows that
    share a doc_id are drawn together.
    """
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, for every row; a null text has no tokens."""
    return bpe.digests(docs, tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
