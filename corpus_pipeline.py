"""The corpus pipeline: five stages, each calling one operator, over all that the stage before kept.

run(spark, sf_dir) applies them to the table documents. Every stage's result is written as Parquet in the shared folder
and read again, so a lost executor costs at most one stage.

For every stage: whole texts are read, however long; rows are judged one by one, so repeated rows and repeated or null ids are
rows of their own; columns beyond those of documents are left out, whatever their names; an empty table gives an empty table
with the stage's columns. What a stage adds to that is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import bpe, lang_id, mixing, near_dup, quality_model
from hitloom.llm.common import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables of texts that a stage's result is read from, until the next stage finds that its documents no longer are.
_HELD: list[DataFrame] = []


def release(docs: DataFrame) -> None:
    """Delete the tables that earlier stages kept for their results, but those that docs is read from."""
    read = docs.inputFiles() if _HELD else []
    for kept in list(_HELD):
        if kept.sparkSession is not docs.sparkSession or not any(kept.folder.rpartition("/")[2] in f for f in read):
            _HELD.remove(kept)
            if kept.sparkSession is docs.sparkSession:
                discard(kept)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored under the classifier's threshold. A null text is scored as an empty one; where no label of each class is
    known, every score is 0.5 and nothing is rejected. Equal texts share their score, and a score at the threshold is kept."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality_model.THRESHOLD).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document the language predicted, and rejects null texts and texts without a letter. Where nothing was
    learned (no row has a language), all texts with a letter stay as they are. Ties go to the language that sorts first."""
    model = lang_id.train(docs)
    if not len(model.matrix):
        return docs.select(*COLUMNS).where(F.col("text").rlike("\\p{L}"))
    known = lang_id.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != lang_id.UNKNOWN)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: that with the least id (null ids last), of rows with one id that with the least hash.

    Rows are told apart by a key of their own, so rows with null or repeated ids are judged by their texts alone. Null texts and texts
    without words have no copies and stay. Rows that are equal in everything are one class like other copies."""
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    _HELD.append(rows)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row")
    classes = near_dup.near_duplicates(rows.select("row", "text", order.alias("order")), key="row", carry=("order",))
    kept = classes.groupBy("class_id").agg(F.min("order")["row"].alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix uses it (0 to 2 times), range-sorted by training position: so are the files it is written to.

    Null texts and texts without words have size 0 and are used 0 times; a null source is one of its own. Rows of one position are
    ordered by source, id and use."""
    release(docs)
    carry = ("text", "lang", "n_chars")
    mixed = mixing.mix_sources(docs.select(*COLUMNS), carry=carry)
    return mixing.training_order(mixed, carry).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit integers) of each use of a document; a null text has no ids."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.vocabulary_path()).drop("text")
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encoding", bpe_encoding),
]

#: Models, sketches and tokenizers can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if hasattr(before, "folder"):
            discard(before)  # the stage's result is written; nothing reads what it was made from
    return STAGES[-1][1](spark, docs, sf_dir)
