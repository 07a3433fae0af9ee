"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wattline.llm import audit, dedup, fingerprints, lm, mixing, neighbours, pieces, pii, quality, secret_scan, sharding, toxicity, whitening
from wattline.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ROOT = str(Path(__file__).resolve().parents[2])


def query(name: str, oracle: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Python workers of a local session find the package wherever they are started.
            spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and kept flag of every document, links at 85 per cent."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document and whether the sampling keeps it."""
    return quality.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[2]


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text again."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip")
    return coded.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "round_trip")


@query("op5_mixing", mixing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed by weight."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how many others are near."""
    docs = table(spark, sf_dir, "documents")
    return fingerprints.with_near(fingerprints.edited_fingerprints(docs), fingerprints.fingerprint(docs))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query("op6_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document."""
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_source_audit", audit.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and the terms that mark them."""
    return audit.divergence(table(spark, sf_dir, "documents"))


@query("op12_secret_scan", secret_scan.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.find(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that all stages leave."""
    return corpus_pipeline.run(spark, sf_dir)
