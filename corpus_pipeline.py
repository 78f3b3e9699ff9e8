"""From raw documents to token ids, in five stages.

Each stage works on all rows that its predecessor kept; run() writes its
result as Parquet into the shared folder and rereads it for the next one, so
a lost executor costs no more than the running stage.  All stages but the
last return the columns of documents.

1. quality_classifier: documents that the trained classifier rejects go.
2. line_dedup: later copies of line runs are cut from the texts, and of single
   lines with MIN_WORDS words or more, so that a clean text keeps its "Yes.";
   a document whose every word was in later copies goes.
3. simhash_near_dedup: of each group of linked documents one row stays, the
   first by (doc_id, nulls last; hash of the text); of rows that share both,
   the first by (lang, source, n_chars).
4. mixing: sources are brought to their target weights; a document that the
   mix takes twice is there twice.
5. bpe: token ids of every text, and whether they decode to it.

Null and empty texts get the classifier's score for a text without features;
each operator's module states what it makes of nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcraft.llm import bpe, line_dedup, mixing, quality_model, simhash
from foldcraft.llm.common import documents, has_word, text_key, text_of
from foldcraft.session import cut_lineage

MIN_WORDS = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.fit(docs, quality_model.quality_labels(spark, sf_dir))
    return quality_model.predict(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stored before it is filtered: a filter would be pushed into the text's
    # making, and split every text anew for each of its lines
    d = line_dedup.delete_later_copies(docs.select(*COLUMNS), min_words=MIN_WORDS, exact=False)
    d = cut_lineage(d, "line-dedup")
    emptied = (F.col("line_dedup.n_removed") > 0) & ~has_word(text_of(F.col("text")))
    return d.filter(~emptied).withColumn("n_chars", F.when(
        F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is named by doc_id and text, without nulls: its group's, and its own
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tkey")
    stay = simhash.near_duplicates(docs).groupBy("root").agg(F.min(name).alias("s")).select("s.*")
    stay = stay.toDF("s_no_id", "s_id", "s_tkey")
    d = docs.select(*COLUMNS, text_key(text_of(F.col("text"))).alias("tkey"))
    d = d.select("doc_id", name.alias("name"), F.struct("lang", "source", "n_chars", "text").alias("row"))
    d = d.select("doc_id", "name.*", "row").join(stay.hint("merge"), (F.col("no_id") == F.col("s_no_id")) & (
        F.col("id") == F.col("s_id")) & (F.col("tkey") == F.col("s_tkey")), "left_semi")
    # rows that share a name, in the join's own partitions
    one = d.groupBy("no_id", "id", "tkey").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    d = docs.select("doc_id", "source", text_of(F.col("text")).alias("text"))
    d = d.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    d = bpe.encode(d, path, pattern, packed=None, data="bytes")
    return d.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                    (F.sha2("bytes", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the trained classifier nor the fingerprints
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
