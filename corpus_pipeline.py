"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, piece encoding, each over what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, map_texts, table
from plumbline.llm.langid import has_letter, identify, train_profiles
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import resample
from plumbline.llm.pieces import encode_texts, load_pieces
from plumbline.llm.queries import PIECES
from plumbline.llm.simhash import near_dedup
from plumbline.session import delete_folder, ensure_checkpoint_dir

#: Below this cosine with every language a document is no text in any of them.
LEAST_SCORE = 0.02


def own_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose letters resemble no language's.

    Where no row has both a language and a letter, nothing can be learned, and only documents without a letter go.
    """
    profiles = train_profiles(docs, F.lit(True))
    if not profiles.names:
        some = fresh(docs, "has_letter")
        lettered = map_texts(docs, lambda: lambda t: (has_letter(t),), "has_letter boolean", list(docs.columns)).toDF(*docs.columns, some)
        return lettered.where(F.col(some)).select(*own_columns(docs))
    pred, score = (fresh(docs, x) for x in ("lang_pred", "score"))
    judged = identify(docs, profiles, list(docs.columns)).toDF(*docs.columns, pred, score)
    return judged.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*own_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one of them; documents that become empty are copies to the next
    stage, which keeps one."""
    return line_dedup(docs).select(*own_columns(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return resample(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's best segmentation, and the next best as changes to it."""
    return encode_texts(docs, load_pieces(PIECES), ["doc_id", "lang", "source"], n=3)


STAGES = [
    ("language ID", language_id),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies_out),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Random vectors, min-hash candidates and the piece lattice are out of SQL's reach; tests/llm/test_pipeline_stages.py
#: holds run() against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again by the next; what no
    later stage reads is deleted."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
