"""One query per operator over the driver tables, and DuckDB SQL where it can say the same.

Each query applies its operator with production parameters to the whole table and derives
the contract's digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm import (
    bitpack,
    chat_grammar,
    chosen_path,
    kneser_ney,
    license_rules,
    line_variants,
    oracles,
    orchard_codes,
    pareto_mix,
    rule_ensemble,
    tag_paths,
    target_resampling,
    url_trees,
    winnowing,
)
from trustlens.llm.common import shared_folder, ship_code
from trustlens.session import ensure_checkpoint_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = 50_257
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code()
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_variants.dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id", "n_lines", "n_exact", "n_near", F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


def op3_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = shared_folder(spark, "token-blocks")
    bitpack.write_blocks(docs, path, TOKENIZER, VOCABULARY, END_ID)
    return bitpack.read_documents(spark, path)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_rules(_table(spark, sf_dir, "documents"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(_table(spark, sf_dir, "pages"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", F.array_sort("licenses")).alias("licenses"),
        F.concat_ws(",", "unmatched").alias("unmatched"),
    )


def op10_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    said = [(0, "user"), (1, "assistant")]
    probe = F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in said
    ))
    rows = _table(spark, sf_dir, "conversations").select(*columns).unionAll(spark.range(1).select(F.inline(probe)))
    back = chat_grammar.read_back(chat_grammar.format_conversations(rows))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rule_ensemble": op1_rule_ensemble,
        "op2_line_variants": op2_line_variants,
        "op3_token_bitpack": op3_token_bitpack,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_tag_paths": op5_tag_paths,
        "op6_pareto_mix": op6_pareto_mix,
        "op7_winnowing": op7_winnowing,
        "op8_chosen_path": op8_chosen_path,
        "op9_license_rules": op9_license_rules,
        "op10_chat_grammar": op10_chat_grammar,
        "op11_orchard_codes": op11_orchard_codes,
        "op12_target_resampling": op12_target_resampling,
        "op13_url_trees": op13_url_trees,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_variants": oracles.LINE_DEDUP,
        "op6_pareto_mix": oracles.PARETO_MIX,
        "op7_winnowing": oracles.WINNOWING,
        "op8_chosen_path": oracles.NEAR_DUPLICATES,
        "op9_license_rules": oracles.LICENSES,
        "op10_chat_grammar": oracles.CHAT,
    }
