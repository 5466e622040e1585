"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import clusters, licences, turns, urls
from .ann import op10_nearest_neighbours
from .bpe import op6_bpe_round_trip
from .langid import op2_language_id
from .media import op9_media_columns
from .ngram_join import op1_ngram_jaccard_join
from .packing import op8_best_fit_packing
from .suffix_dedup import op5_suffix_array_dedup
from .tokens import op3_token_records
from .toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_language_id,
        op3_token_records,
        op4_toxicity,
        op5_suffix_array_dedup,
        op6_bpe_round_trip,
        licences.op7_licence_scan,
        op8_best_fit_packing,
        op9_media_columns,
        op10_nearest_neighbours,
        urls.op11_url_filter,
        turns.op12_conversation_repair,
        clusters.op13_centroid_clustering,
    )
}
ORACLE = licences.ORACLE | urls.ORACLE | turns.ORACLE | clusters.ORACLE
