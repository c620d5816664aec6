"""Registered queries of the operators, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import alignment, language, mixture, packing, pieces, pii, quality, recompression, revisits, sharding, simhash, tries, winnowing


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return query


QUERIES = {
    "op1_packing": _over("documents", packing.pack),
    "op2_simhash": _over("documents", simhash.digests),
    "op3_language": _over("documents", language.digests),
    "op4_winnowing": _over("documents", winnowing.digests),
    "op5_recompression": _over("documents", recompression.digests),
    "op6_sharding": _over("documents", sharding.digests),
    "op7_revisits": _over("pages", revisits.digests),
    "op8_pieces": _over("documents", pieces.digests),
    "op9_pii": _over("documents", pii.digests),
    "op10_quality": _over("documents", quality.verdicts),
    "op11_mixture": _over("documents", mixture.pack),
    "op12_alignment": _over("documents", alignment.alignments),
    "op13_tries": _over("conversations", tries.digests),
}

ORACLES: dict[str, str] = {
    "op5_recompression": recompression.ORACLE,
    "op7_revisits": revisits.ORACLE,
    "op10_quality": quality.ORACLE,
}
