"""One query for each operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (arrow_sequences, automaton_dedup, boosted_quality, counterfactual_toxicity, gumbel_pieces,
               jaccard_metric, line_crf, mixing, periodic_runs, pii_transducer, pstable_ann, spelling_variants, warc_index)
from .labelled import held_out
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


QUALITY_PASS, TOXICITY_PASS = 0.7, 0.3


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return line_crf.apply_rules(docs, line_crf.fit(docs, labels))


def _verdicts(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = boosted_quality.fit(docs, labels)
    return _verdicts(boosted_quality.score(docs.select("doc_id", "text"), model, "score"), QUALITY_PASS)


def op3_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_jaccard_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_metric.similar_documents(table(spark, sf_dir, "documents"))


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_transducer.find_pii(table(spark, sf_dir, "documents"))


def op8_pstable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = counterfactual_toxicity.fit(docs, labels)
    return _verdicts(counterfactual_toxicity.score(docs.select("doc_id", "text"), model, "score"), TOXICITY_PASS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = arrow_sequences.write_sequences(table(spark, sf_dir, "documents"),
                                            public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return arrow_sequences.read_documents(index)


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_index.write_archives(warc_index.plan_records(table(spark, sf_dir, "pages")))
    return warc_index.index_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), order=periodic_runs.tandem_order, digest=True)


QUERIES: dict[str, Query] = {
    "op1_line_crf": op1_line_crf,
    "op2_boosted_quality": op2_boosted_quality,
    "op3_gumbel_pieces": op3_gumbel_pieces,
    "op4_jaccard_metric": op4_jaccard_metric,
    "op5_automaton_dedup": op5_automaton_dedup,
    "op6_pii_transducer": op6_pii_transducer,
    "op7_mixing": op7_mixing,
    "op8_pstable_ann": op8_pstable_ann,
    "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
    "op10_arrow_sequences": op10_arrow_sequences,
    "op11_warc_index": op11_warc_index,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_metric": jaccard_metric.components_sql(),
    "op5_automaton_dedup": automaton_dedup.removal_sql(),
    "op7_mixing": mixing.taken_sql(),
    "op11_warc_index": warc_index.captures_sql(),
    "op12_spelling_variants": spelling_variants.variants_sql(),
}
