"""The corpus pipeline: each stage is written as Parquet and read again before the next."""

from __future__ import annotations

from panelith.llm.common import Scratch, table
from panelith.llm.decontam import decontaminate
from panelith.llm.jaccard import keep_one
from panelith.llm.mixing import mix_sources
from panelith.llm.quality import keep_good
from panelith.llm.secrets import redact


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each linked group stays: shingles of five words, similarity 0.8 or more."""
    return keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark, docs, sf_dir):
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs)


def mixing_stage(spark, docs, sf_dir):
    """What the mix takes of every document that is left."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The stages train models and walk graphs, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
