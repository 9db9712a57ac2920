"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import oracle
from foliospark.llm.decontamination import op7_suffix_array_decontamination
from foliospark.llm.embeddings import op9_pruned_graph_embeddings
from foliospark.llm.fertility import op12_tokeniser_fertility
from foliospark.llm.fill_middle import op13_event_scan_fill_middle
from foliospark.llm.funnels import op11_funnel_frontier
from foliospark.llm.jaccard import op8_pigeonhole_jaccard
from foliospark.llm.langid import op5_compression_langid
from foliospark.llm.packing import op6_best_fit_packing
from foliospark.llm.pages import op2_page_differencing
from foliospark.llm.pii import op3_bootstrapped_pii
from foliospark.llm.sharding import op10_feistel_sharding
from foliospark.llm.suffix_tree_lm import op4_suffix_tree_lm
from foliospark.llm.toxicity import op1_factorization_toxicity



def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """The counts of base spans that op3 gives."""
    return op3_bootstrapped_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    """Rows and last slot of each shard of op10."""
    return op10_feistel_sharding(spark, sf_dir).groupBy("shard", "law").agg(F.count(F.lit(1)).alias("n_rows"), F.max("slot").alias("last_slot"))


def fertility_base_counts(spark, sf_dir: str) -> DataFrame:
    """The plain counts and rules of op12."""
    return op12_tokeniser_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_factorization_toxicity": op1_factorization_toxicity,
    "op2_page_differencing": op2_page_differencing,
    "op3_bootstrapped_pii": op3_bootstrapped_pii,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_compression_langid": op5_compression_langid,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_array_decontamination": op7_suffix_array_decontamination,
    "op8_pigeonhole_jaccard": op8_pigeonhole_jaccard,
    "op9_pruned_graph_embeddings": op9_pruned_graph_embeddings,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_funnel_frontier": op11_funnel_frontier,
    "op12_tokeniser_fertility": op12_tokeniser_fertility,
    "op13_event_scan_fill_middle": op13_event_scan_fill_middle,
    "pii_base_counts": pii_base_counts,
    "shard_sizes": shard_sizes,
    "fertility_base_counts": fertility_base_counts,
}

ORACLE_SQL = {
    "op7_suffix_array_decontamination": oracle.OP7,
    "op8_pigeonhole_jaccard": oracle.OP8,
    "op9_pruned_graph_embeddings": oracle.OP9,
    "op11_funnel_frontier": oracle.OP11,
    "op13_event_scan_fill_middle": oracle.OP13,
    "pii_base_counts": oracle.PII_BASE,
    "shard_sizes": oracle.SHARD_SIZES,
    "fertility_base_counts": oracle.FERTILITY_BASE,
}
