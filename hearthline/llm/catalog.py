"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, extraction, hashing, importance, jaccard, langid, licenses, mixing, mtree, packing, repeats, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": warc.query,
    "op2_language_id": langid.query,
    "op3_best_fit_packing": packing.query,
    "op4_multi_index_hashing": hashing.query,
    "op5_mtree_search": mtree.query,
    "op6_license_scan": licenses.query,
    "op7_html_extraction": extraction.query,
    "op8_ngram_jaccard_join": jaccard.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
    "op11_suffix_dedup": repeats.query,
    "op12_importance_resampling": importance.query,
    "op13_collocations": collocations.query,
}

SQL: dict[str, str] = {
    "op5_mtree_search": mtree.SQL,
    "op6_license_scan": licenses.sql(),
    "op8_ngram_jaccard_join": jaccard.SQL,
    "op9_mixing": mixing.SQL,
    "op11_suffix_dedup": repeats.SQL,
    "op12_importance_resampling": importance.SQL,
    "op13_collocations": collocations.SQL,
}
