"""Corpus pipeline: toxicity, language ID, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet in the shared folder and reads it again as the next one's docs. Stages that filter return the columns of
documents. Rows with a null doc_id, null text or repeated ids are handled as the operators say; a filter never drops a
row for having a null in another column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import crc_bucket, cut, row_key, scratch, small_batches, table
from skyledger.llm.decontaminate import decontaminate
from skyledger.llm.jaccard import jaccard_components
from skyledger.llm.langid import fit_language_model, predict_language
from skyledger.llm.packing import pack_examples
from skyledger.llm.queries import toxicity_model
from skyledger.llm.toxicity import score_toxicity

BROADCAST_KEYS = 500_000
#: Held-out documents of sf0.001 have 0.985 and more, those of sf0.1 0.990 and more; texts in other scripts are near 0.
#: A short English text of check_s with a key in it has 0.793, two Latin-script languages outside the model 0.48 and 0.59.
FAMILIAR = 0.7


def carried(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], str]:
    """docs under names that clash with nothing; the names; that of the text."""
    names = tuple(f"_c{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs less the rows with the given _k1, _k2; these are broadcast if they are few."""
    few = keys.count() <= BROADCAST_KEYS
    keyed = docs.select("*", *row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(F.broadcast(keys) if few else keys, ["_k1", "_k2"], "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold stay. The model is fitted on docs and the labels outside the held-out fold."""
    small_batches(spark)
    renamed, names, text = carried(docs)
    scored = score_toxicity(renamed, toxicity_model(docs, spark, sf_dir), text_col=text, keep=names)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose text is in a language that the model knows: not ``und``, nor an even tie of all languages, nor
    made of words and n-grams that the model has not seen."""
    small_batches(spark)
    model = fit_language_model(docs.where(crc_bucket(F.col("doc_id"), 5) != 0))
    renamed, names, text = carried(docs)
    predicted = predict_language(renamed, model, text_col=text, keep=names, with_familiar=True)
    sure = (F.col("score") > 1.05 / max(2, len(model.langs))) & (F.col("familiar") >= FAMILIAR)
    return predicted.where((F.col("lang_pred") != "und") & sure).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the smallest id's, of rows that repeat the first; rows without words all stay.

    Texts link at a similarity of 0.8 over five-word shingles, the default of such stages; op9's query has its own.
    """
    small_batches(spark)
    found = cut(jaccard_components(docs, n=5, percent=80, with_keys=True))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    firsts = cut(found.where("_label is not null").groupBy("_label").agg(F.min(key).alias("first")))
    losers = found.join(firsts, "_label").where((F.col("_k1") != F.col("first._k1")) | (F.col("_k2") != F.col("first._k2"))).select("_k1", "_k2").distinct()
    repeats = found.where("_label is not null").groupBy("_k1", "_k2").count().where("count > 1").select("_k1", "_k2")
    repeats = cut(repeats.join(losers, ["_k1", "_k2"], "left_anti"))
    if repeats.isEmpty():
        return without(docs, losers)
    keyed = docs.select("*", *row_key(F.col("doc_id"), F.col("text"))).join(repeats, ["_k1", "_k2"], "left_semi")
    return without(docs, losers.unionAll(repeats)).unionAll(keyed.dropDuplicates(["_k1", "_k2"]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    small_batches(spark)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_keys=True)
    return without(docs, cut(found.where("contaminated").select("_k1", "_k2").distinct()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_examples(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: The first two stages fit models, which SQL can't express; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # tables within a stage go when its result is written
            docs = cut(stage(spark, docs, sf_dir), kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
