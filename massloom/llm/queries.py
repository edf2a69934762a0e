"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from massloom.llm import chat, exact, fingerprint, infill, mixing, neardup, packing, pieces, quality, repeats, runs, secrets, warc
from massloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024, with_ids=False)


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    probe = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(chat.canonical_turns(rows).unionByName(probe)))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, similarity=0.8)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(runs.plant_runs(table(spark, sf_dir, "documents")), least=24, times=3))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(infill.fill_in_middle(table(spark, sf_dir, "documents"), fim_percent=90, spm_percent=20, seed=1))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(pieces.decode_documents(pieces.encode_documents(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Query]:
    own = {name: function for name, function in globals().items() if name.startswith("op") and callable(function)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op3_merkle_fingerprint": fingerprint.ORACLE, "op4_warc_assembly": warc.ORACLE, "op7_exact_dedup": exact.ORACLE, "op8_chat_format": chat.ORACLE, "op10_source_mix": mixing.ORACLE, "op11_periodic_runs": runs.ORACLE, "op12_fill_in_middle": infill.ORACLE}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
