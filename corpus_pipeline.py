"""A training corpus in five stages: toxic documents go, one document of each group of near copies stays, repeated passages are
cut, benchmark passages are removed, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fernwerk.llm.bpe import bpe_round_trip
from fernwerk.llm.decontaminate import decontaminate
from fernwerk.llm.ngram_join import jaccard_components
from fernwerk.llm.queries import table, vocabulary
from fernwerk.llm.repeats import NO_ID
from fernwerk.llm.substring_dedup import passage_dedup
from fernwerk.llm.toxicity import toxicity
from fernwerk.storage import materialise

#: A text with this has words.
WORD = "[^\\x20\\x09-\\x0D]"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars is the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Null and empty texts have the score of a text without entries, and stay; each row is
    scored by itself, whatever its id; without labels of both kinds nothing is learned, and the share of the label decides."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.where("score < 0.5").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least id stays (null is the least; of equal ids the least digest of the text; of rows equal in both
    the first).

    Rows are named by id and text, so rows without an id or with the id of another go only if their texts are linked. Null texts and
    texts without words are linked with nothing, and stay. No copy of the texts is written: they are read again for the result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    keys = F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text.cast("string")).alias("r")
    spoken = F.coalesce(text.rlike(WORD), F.lit(False))
    plain = docs.toDF(*names)
    groups = jaccard_components(docs, 5, 80, by_row=True).where("n_shingles > 0").select("k", "r", "component").distinct()
    digests = plain.where(spoken).select(*keys, F.sha2(text, 256).alias("digest")).distinct()
    least = groups.join(digests, ["k", "r"]).groupBy("component").agg(F.min(F.struct("k", "digest", "r")).alias("x")).select("x.k", "x.r")
    first = F.row_number().over(Window.partitionBy("k", "r").orderBy("at"))  # a task sends on one of its rows that are equal
    one = plain.where(spoken).select(*keys, F.monotonically_increasing_id().alias("at"), *names).withColumn("place", first).where("place = 1")
    kept = one.join(least, ["k", "r"], "left_semi").select(*names)
    return kept.unionByName(plain.where(~spoken)).toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has are cut; a text that loses nothing stays as it is, as do null and
    empty texts. A null id is the least; rows with one id cut nothing of each other."""
    return _counted(passage_dedup(docs, 50, keep="earlier_document", rewrite=True))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two items or more go; of the others the words of test passages are cut. Null and empty texts stay;
    without a benchmark all do. Each row is cut by its own text, whatever its id."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark"), 8, reject_items=2))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and their number; none for a null or an empty text."""
    return bpe_round_trip(docs, vocabulary()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", remove_benchmark),
    ("bpe", encode),
]
#: Stages learn and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
