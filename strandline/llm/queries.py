"""The thin queries over the driver tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import jpegmedia, langid, pieces, pseudonyms, quality, secret_scan
from strandline.llm.linededup import without_recurring_lines
from strandline.llm.neardup import SketchSettings, all_pairs_sql, near_duplicates
from strandline.llm.ngram import score_texts
from strandline.llm.packing import pack
from strandline.runtime import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, links at 80 % of the union; one row per document."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), SketchSettings(words=2))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of recurring templates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_recurring_lines(spark, docs).select("doc_id", "n_dropped", (F.col("n_dropped") > 0).alias("changed"), "text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(spark, table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base scores and bigram scores of all texts."""
    return score_texts(spark, table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether they decode to it."""
    return pieces.digests(table(spark, sf_dir, "documents"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced, and what was replaced by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, spark.conf.get("spark.strandline.pseudonymKey", KEY))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    made = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])), ",")
    return out.select("doc_id", *[count(k) for k in pseudonyms.KINDS], made.alias("pseudonyms"), "text")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes as a JPEG, and what is read back from it."""
    return jpegmedia.digests(jpegmedia.store(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, "doc_id", "text", "lang", ~langid.held_out())
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every text and the cascade's verdict."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


#: Stands for the caller's secret key where the session has no spark.strandline.pseudonymKey.
KEY = "strandline"

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op1_minhash_near_dedup": all_pairs_sql(2, 80), "op2_secret_scan": secret_scan.scan_sql(), "op10_quality_rules": quality.REPORT_SQL}
