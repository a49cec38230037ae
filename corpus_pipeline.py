"""Training-text pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents`` for the rows they keep. ``run`` writes
each stage as Parquet in the shared checkpoint folder and reads it again for the
next; once a stage is written, the rows of the one before are deleted.

Defined cases, for every stage: an empty table gives an empty result; texts of
any length are read whole; extra columns pass through whatever their names,
those of the stages' own working columns included. Nulls, empty texts and
repeated rows are as each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, minhash, packing, quality
from helixframe.llm._common import checkpoint_folder, table, unused
from helixframe.llm.queries import tokenizer

#: Documents whose language is less sure than this are rejected; so are those without a letter.
#: Of 10,000 labelled documents no right prediction has a score under 0.65, and most wrong ones one under 0.3.
LEAST_SCORE = 0.3
#: Share of the target documents that the resampled set retains: as a filter, the stage keeps what the target is like.
RECALL = 0.999
SEED = 17


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language that the identifier is sure enough of.

    Null and empty texts, those without a letter, and junk and other languages
    go; rows with a null id or language are judged alike; equal rows stay or go
    together.
    """
    lang, score, sure = (unused(c, docs.columns) for c in ("lang_found", "lang_score", "lang_sure"))
    found = langid.identify(docs, langid.fit(docs), lang_out=lang, score_out=score, sure_out=sure)
    return found.filter((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE) & F.col(sure)).select(*docs.columns)


def selection(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents sampled by importance; texts are weighed once for the threshold and once to filter, and never shuffled.

    Null and blank texts go; rows without an id share one noise, as do rows that
    share an id; equal rows stay or go together; without a target text all
    documents with a word stay.
    """
    weight, key = unused("log_weight", docs.columns), unused("gumbel_key", docs.columns)
    ratio, chosen = quality.fit(docs, table(spark, sf_dir, "labels"))
    weighed = quality.weigh(docs, ratio, out=weight).withColumn(key, quality.gumbel_key(weight, "doc_id", SEED))
    least = quality.threshold(weighed.select("doc_id", key), key, chosen, "doc_id", RECALL)
    return weighed.filter(F.col(key) >= F.lit(least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: that with the least id, rows without an id last.

    A row's key is 128 bits of a hash of all its columns, so equal rows count
    once; rows that share an id or have none are rows of their own: they stay
    unless another row of their group does. Texts without a word link with nothing.
    """
    one, two, t1, t2 = (unused(c, docs.columns) for c in ("row_key", "row_check", "text_key", "text_check"))
    cells = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    keyed = docs.withColumns({one: F.xxhash64(*cells), two: F.xxhash64(F.lit(1), *cells, F.lit(1))} | dict(zip((t1, t2), minhash.text_hash("text").values(), strict=True)))
    groups = minhash.grouped(keyed.select(F.col(one).alias("id"), "text"), id_col="id").select("doc", F.col("t1").alias("g1"), F.col("t2").alias("g2"), "group").distinct()
    rows = keyed.select(F.col(one).alias("a"), F.col(two).alias("b"), F.col(t1).alias("c"), F.col(t2).alias("d"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("i"))
    rows = rows.join(groups, [rows["a"] == groups["doc"], rows["c"] == groups["g1"], rows["d"] == groups["g2"]])
    first = rows.filter("group is not null").groupBy("group").agg(F.min(F.struct("no_id", "i", "a", "b")).alias("row")).select("row.a", "row.b")
    kept = first.unionByName(rows.filter("group is null").select("a", "b")).select(F.col("a").alias(one), F.col("b").alias(two))
    return keyed.join(kept, [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences.

    Null and empty texts are documents of the separator alone; ids may be null
    or repeat, and repeated rows are packed once each.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("quality", selection), ("near-duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:  # nothing reads the rows before any more
            spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Hashing, training and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None
