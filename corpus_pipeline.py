"""From raw documents to a verified token store: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each as Parquet in the shared folder and reads
it again as the next one's docs. All but the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import contract, decontam, mixing, ngramjoin, ordinal, staging, tokenstore


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; toxic ones and those of low quality go. Empty and null texts get what a score of 0 gets."""
    model = ordinal.fit(docs, ordinal.ratings_of(contract.table(spark, sf_dir, "labels")), grades=3)
    judged = docs.select(F.struct("*").alias("doc"), ordinal.graded(docs, model).alias("grade"))
    return judged.filter(F.col("grade.tail") >= ordinal.SELECT).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingle sets with a similarity of 0.8 or more connect: that with the least id. Rows without an id stay; rows that share one are one document."""
    groups = ngramjoin.near_groups(docs, words=5, num=80, den=100, common=4000)
    gone = groups.filter("doc_id <> component").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. They are judged by id and the text's digest, so only these are shuffled; the few that are contaminated are then left out."""
    keyed = docs.select("doc_id", "text", _digest(F.col("text")).alias("digest"))
    judged = decontam.decontaminate(keyed, contract.table(spark, sf_dir, "benchmark"), carry=("digest",))
    # written, so that Spark knows its size when it plans the join
    gone = staging.written(judged.filter("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct())
    whole = docs.select(F.struct("*").alias("doc"))
    same = whole["doc.doc_id"].eqNullSafe(gone["gone_id"]) & (_digest(whole["doc.text"]) == gone["gone_digest"])
    return whole.join(gone, same, "left_anti").select("doc.*")


def _digest(text):
    return F.sha2(text.cast("binary"), 256)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    return mixing.mixed(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The store's verified contents: for each row of docs its place in the stream, its length and its checksum."""
    path = staging.shared_folder(spark)
    tokenstore.write(docs, path, contract.tokenizer_file())
    tokenstore.verify(spark, path)
    told = tokenstore.starts(tokenstore.digests(spark, path))
    return told.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_store", token_store),
]

#: The classifier, the hash order of the mix and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way is removed when the next one's docs are there."""
    docs = contract.table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with staging.scope(spark):
            docs = staging.written(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            staging.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
