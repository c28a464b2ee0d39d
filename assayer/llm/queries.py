"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import block_labeller, forest_jaccard, gram_spelling, hybrid_search, kneser_ney_quality, lattice_scores, line_rules, random_secrets, splitter_sharding, suffix_decontamination, url_lists, wavelet_tokens, weighted_mixing
from assayer.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op1_url_filter", url_lists.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against the dated lists as of its fetch time."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_lists.judge(url_lists.derived_captures(pages), url_lists.derived_entries(pages), others=["page_id"])
    return found.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_second"), "host", "lists", "n_entries", "blocked")


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the perplexity under the trusted model and the verdict."""
    return kneser_ney_quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), slim=True)


@query("op3_jaccard_join", forest_jaccard.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its class of near duplicates and its links."""
    return forest_jaccard.join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


@query("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Per page the main text."""
    return block_labeller.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its shard and slot under the law ``bytes``."""
    return splitter_sharding.shard(table(spark, folder, "documents")).drop("position")


@query("op6_mixing", weighted_mixing.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the words that the mix takes; columns of the contract."""
    return weighted_mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_decontamination", suffix_decontamination.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Per document what it shares with the benchmark; columns of the contract."""
    found = suffix_decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_wavelet_tokens")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its place, length and checksum, decoded from the written wavelet files."""
    return wavelet_tokens.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_quality_rules", line_rules.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the counts and the verdict; columns of the contract."""
    found = line_rules.judge(table(spark, folder, "documents"), cleaned=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")


@query("op10_lattice_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the unigram base and the marginal lattice score; columns of the contract."""
    return lattice_scores.score(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_spelling_variants", gram_spelling.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Per word of the corpus its frequent form and root; columns of the contract."""
    return gram_spelling.variants(table(spark, folder, "documents"))


@query("op12_secret_scan")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the spans of the fixed patterns and of random tokens; columns of the contract."""
    return random_secrets.scan(table(spark, folder, "documents")).drop("found")


@query("op13_ranked_search", hybrid_search.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Per benchmark item its best documents; columns of the contract."""
    return hybrid_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
