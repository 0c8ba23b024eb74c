"""Corpus pipeline: language ID, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``. All stages but the last return
the columns of ``documents``; other columns of ``docs``, whatever their names, are left
out. An empty table gives an empty one, texts are read whole at any length, and repeated
rows stay repeated unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialseg.llm import jaccard, langid, mixing, packing, pii
from spatialseg.llm.queries import tokenizer_file
from spatialseg.runtime import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that look like none of the languages that the documents are marked with go; ``lang`` becomes the language found.

    A null text, and one without letters, has no language and goes. A null id or source
    makes no difference, repeated rows are judged alike.
    """
    models = langid.train(docs)
    kept = langid.identify(docs.withColumn("_text", F.col("text")), models, ["doc_id", "text", "source", "n_chars"], seen=F.lit(True)).where(~F.col("rejected"))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays, once.

    A text without words is linked with nothing and stays; rows of a null id stay, all of
    them. Rows that repeat both id and text become one, with the least of their other
    columns; of an id with several texts all go if one of them is in a group of a smaller id.
    """
    groups = jaccard.jaccard_components(docs, SHINGLE_WORDS, *SIMILAR, count_links=False)
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(jaccard.small(gone), "doc_id", "left_anti").select(*COLUMNS)
    repeated = cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # rows that repeat both id and text are one document
    again = jaccard.small(repeated)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    return kept.join(again, "doc_id", "left_anti").unionByName(once.select("doc_id", "text", "r.*"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; every document stays.

    A null text stays null and so does its length; an empty one stays empty. Where spans
    overlap, the one that begins first gives the kind. Ids, sources and repeats play no part.
    """
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own. Texts without words, null ones too, have size 0;
    they may stay or go and take nothing of a target. Documents of equal size in a source
    go by a hash of their id. Repeated rows are drawn each.
    """
    return mixing.mix(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens.

    A null or empty text is one piece of one token, its end mark. Rows that repeat, and
    rows of a null id, are documents of their own; which of equally long pieces lies in
    which sequence is settled by id and piece.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", language_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage), ("source_mix", mixing_stage), ("packing", packing_stage)]
#: Learned models, similarity joins and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
