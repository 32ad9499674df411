"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.llm import oracle
from loomfield.llm.common import table
from loomfield.llm.decontaminate import contained
from loomfield.llm.divergence import divergence
from loomfield.llm.fingerprints import fingerprints
from loomfield.llm.html_extract import main_text
from loomfield.llm.license_scan import license_scan
from loomfield.llm.mixing import mix
from loomfield.llm.ngram_join import ngram_join
from loomfield.llm.packing import pack_documents
from loomfield.llm.pii import PATTERNS, sanitise
from loomfield.llm.token_counts import token_counts
from loomfield.llm.toxicity import classify, crc_third
from loomfield.llm.url_filter import url_filter
from loomfield.llm.whitening import whitened


#: Target shares of tokens by language.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def op1_ngram_join(spark, sf_dir):
    """Every document with its set size and the smallest document that links reach."""
    return ngram_join(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark, sf_dir):
    """License phrases and notices of every document."""
    return license_scan(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    """Spans of personal data of every document."""
    found = sanitise(spark, table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(named(F.slice("spans", F.lit(1), F.col("n_base"))), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op4_url_filter(spark, sf_dir):
    """The verdict on every page's url."""
    return url_filter(spark, table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    """A rate for each document that brings the languages to their target shares of all tokens."""
    return mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op6_token_counts(spark, sf_dir):
    """Tokens of every document by the byte-level vocabulary of 50,257."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark, sf_dir):
    """Benchmark items that documents hold, with the share of their shingles."""
    return contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=lambda i: crc_third(i) != 1)


def op10_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return main_text(spark, table(spark, sf_dir, "pages"))


def op11_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 4,096 tokens, by the vocabulary of 49,408."""
    import public_tokenizers

    return pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_source_divergence(spark, sf_dir):
    """Distances between the sources of each language and the terms that set each source apart."""
    return divergence(spark, table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    return whitened(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_pii, op4_url_filter, op5_mixing, op6_token_counts, op7_decontamination, op8_fingerprints, op9_toxicity, op10_html_extraction, op11_packing, op12_source_divergence, op13_whitening, pipeline)}
ORACLE: dict[str, str] = {"op1_ngram_join": oracle.NGRAM_JOIN, "op2_license_scan": oracle.license_scan(), "op3_pii": oracle.pii(), "op4_url_filter": oracle.url_filter(), "op7_decontamination": oracle.DECONTAMINATION, "op12_source_divergence": oracle.DIVERGENCE}
