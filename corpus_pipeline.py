"""From raw documents to token ids in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result as
Parquet below the shared folder and hands the reread table to the next.  All
stages but the last return the columns of their input.

1. quality classifier: rows it rejects go;
2. n-gram Jaccard join: of each group of near duplicates one row stays, that
   with the smallest id (null ids last, of equal ids any one);
3. benchmark decontamination: rows that hold a benchmark item go;
4. secret scan: live-looking credentials are replaced in the texts;
5. byte-level BPE: token ids, with the decoded bytes' digest.

Every stage reads null texts as empty, texts whole, and ids as they come: null
and repeated ids are rows like others.  Rows without words are linked with
nothing and hold neither items nor credentials, so only the classifier can drop
them; an empty table stays empty; other columns are carried along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontam, jaccard, quality, secret_scan
from tablewright.llm.common import stage, table
from tablewright.llm.queries import rank_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are linked by a row number, written once with them, so that neither
    repeated nor missing ids decide what goes.  The row that stays is one minimum
    a component (combined map-side), the rows that go are found by row number, so
    no join has a component as its key."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows", "zstd")
    linked = jaccard.jaccard_components(rows, row).select(F.col("doc_id").alias("r"), "component_id")
    ids = rows.select(F.col(row).alias("r"), F.col("`doc_id`").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "r"))
    stays = linked.join(ids, "r").groupBy("component_id").agg(first.alias("first")).select("first.r")
    gone = stage(ids.select("r").join(stays, "r", "left_anti").withColumnRenamed("r", row), "pipeline-copies")
    return rows.join(gone, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, by_text=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(docs, *rank_file(), decoded=True)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate),
          ("secret scans", remove_secrets), ("byte-level BPE", tokenize)]

#: Three stages (boosted trees, edit matching, BPE) have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
