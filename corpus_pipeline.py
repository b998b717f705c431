"""The training-text pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``:

1. toxicity: documents that the clause grammar rejects go;
2. near duplicates: one document of each component of the 5-word shingle
   Jaccard join (0.8 or more) stays, that with the smallest id;
3. decontamination: documents that hold 10 consecutive words of a benchmark
   item go;
4. PII: personal data in the text is replaced by its kind in brackets and
   ``n_chars`` follows;
5. SentencePiece: token ids of the text.

Null texts are kept by every filter (nothing speaks against them) and end with
no ids. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrec.llm import decontaminate, ngram_join, pii, sentencepiece, toxicity
from ctxrec.llm.common import prepare, stored
from ctxrec.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    scored = toxicity.score_toxicity(whole, toxicity.trained(spark, docs, sf_dir), extra=("__row",))
    return scored.where("predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    items = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_contamination(docs, items).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    # the columns of docs travel as one struct, so that none can clash
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    return whole.join(found, F.col("i").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_hash")), "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepiece.encode(docs, sentencepiece.load_pieces())


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("pii", redact_personal_data), ("sentencepiece", encode_text)]

#: the toxicity stage learns its lexicon and weights, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
