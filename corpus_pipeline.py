"""The corpus pipeline: five stages over ``documents``, each one operator of ``trustlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared checkpoint folder and hands the reread table to the next, so that a lost
executor or a failed stage never recomputes the ones before. All but the last return the
columns of ``documents``. Repeated rows, null columns and empty tables pass as the operators
define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm import bitpack, chosen_path, pareto_mix, rule_ensemble, winnowing
from trustlens.llm.common import shared_folder, ship_code
from trustlens.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257
END_ID = 2


def _ready(spark: SparkSession) -> None:
    ship_code()
    ensure_checkpoint_dir(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score at least 0.3)."""
    _ready(spark)
    return rule_ensemble.reject(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8 or more. Rows that
    repeat the kept id are one row (the least text stays)."""
    _ready(spark)
    found = chosen_path.near_duplicates(docs, k=5, percent=80)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    once = named.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"), F.count(F.lit(1)).alias("n"))
    single = once.select("doc_id", "row.*").select(*COLUMNS)
    return single.unionAll(docs.select(*COLUMNS).where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no benchmark window."""
    _ready(spark)
    hit = winnowing.contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("doc_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc_id")) & (F.col("doc_hash") == F.col("hit_doc_hash"))
    return rows.join(hit, same, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: every document as often as the mix takes it."""
    _ready(spark)
    return pareto_mix.apply_mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bit-packed token files, as the directory of documents read back from them."""
    _ready(spark)
    path = shared_folder(spark, "pipeline-tokens")
    bitpack.write_blocks(docs, path, public_tokenizers.path(TOKENIZER), VOCABULARY, END_ID)
    return bitpack.read_documents(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-id binary output", tokens),
]

#: The classifier and the tokenizer are not SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
