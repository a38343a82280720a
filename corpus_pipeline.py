"""A corpus pipeline: five stages, each an operator of cairnspark.llm applied to what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm import decontam, langid, packing, simhash, toxicity
from cairnspark.llm.common import broadcast_below, crc_mod, fresh, materialize, read, set_aside

#: Languages below this confidence are not believed.
LEAST_CONFIDENCE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not find toxic. It learns from the labels of the
    four folds of five that op5 learns from. Null and empty texts are not toxic; repeated rows all stay or go; without
    labels of both classes nothing is rejected. An empty table stays empty; columns of any name are carried along."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    docs, own = set_aside(docs, ("score", "predicted", "spans"))
    return toxicity.score(docs, model).filter("predicted = 0").select(own)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without letters (null and empty texts too) or of low
    confidence go. Of equally likely languages the first by name is taken; repeated rows all stay or go. An empty
    table stays empty; columns of any name are carried along."""
    model = langid.train(docs, crc_mod("doc_id", 3) != 1)
    docs, own = set_aside(docs, ("lang_pred", "score"))
    return langid.identify(docs, model).filter((F.col("lang_pred") != langid.NO_LANG) & (F.col("score") >= LEAST_CONFIDENCE)).select(own)


def _document_key(docs: DataFrame) -> Column:
    """A text for each row that orders as doc_id does: its digits, of one length; of rows without one a digest."""
    number = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    known = F.concat(F.lit("d"), F.lpad(number.cast("string"), 21, "0")) if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return F.coalesce(known, F.concat(F.lit("n"), F.md5(F.coalesce("text", F.lit("")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are similar to 0.8 or more in words by five: the one of the
    least doc_id. Null and empty texts are one group. Rows of one doc_id are one document: of several that stay, the
    one of the least text (null first; then of the least other columns, in their order) does. Rows without doc_id have
    an id of their own, the digest of their text, after all others. An empty table stays empty."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    key, n = fresh(docs.columns, "key", "n")
    keyed = docs.withColumn(key, _document_key(docs))
    groups = materialize(simhash.similar_documents(keyed, key), "near-groups")
    stays = groups.filter("doc_id = component_id").groupBy("doc_id").count().withColumnRenamed("doc_id", key)
    goes = materialize(groups.select(F.col("doc_id").alias(key)).distinct().join(stays, key, "left_anti"), "near-goes")
    kept = keyed.join(broadcast_below(goes, simhash.BROADCAST_ENDS), key, "left_anti")
    again = materialize(stays.filter("count > 1").select(key), "near-again")
    if again.isEmpty():
        return kept.select(own)
    order = Window.partitionBy(key).orderBy("text", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    once = kept.join(again, key, "left_semi").withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1)
    return kept.join(again, key, "left_anti").select(own).unionByName(once.select(own))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none, null and empty items are in
    nothing; repeated rows all stay or go. An empty table stays empty; columns of any name are carried along."""
    return decontam.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: one row a piece. Null and empty texts are pieces of one token (the
    end mark), a text over the largest length is cut into several, repeated rows are packed each. An empty table gives
    no rows; other columns are not read."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("packing", pack)]
#: Trained models, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
