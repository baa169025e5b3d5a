"""The operators of this subpackage as registered queries, each over its whole tables."""

from __future__ import annotations

from .common import table
from .decontam import find_leaks
from .jaccard import jaccard_components
from .jaccard import oracle as jaccard_sql
from .langid import identify_language
from .license import oracle as license_sql
from .license import scan_licenses
from .mixing import ORACLE as MIX_SQL
from .mixing import mix_sources
from .ppm import score_texts
from .quality import quality_rules
from .secrets import scan_secrets
from .toxicity import score_toxicity
from .warc import ORACLE as WARC_SQL
from .warc import revisit_table


def op1_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark, sf_dir):
    return revisit_table(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))[0]


def op6_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


def op8_ppm(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found", "scanned", "scanned_null")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mix_sources, op3_warc_revisits, op4_jaccard_join, op5_license_scan, op6_decontamination, op7_language, op8_ppm, op9_quality_rules, op10_secret_scan)}

#: The others train models or search an index, which SQL cannot express; tests/llm holds them against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {"op2_mix_sources": MIX_SQL, "op3_warc_revisits": WARC_SQL, "op4_jaccard_join": jaccard_sql(k=4, num=85, den=100), "op5_license_scan": license_sql()}
