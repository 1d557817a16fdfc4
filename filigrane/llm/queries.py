"""The contract queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from filigrane.llm.bpe import op8_bpe
from filigrane.llm.html_text import op9_html_text
from filigrane.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from filigrane.llm.language_id import op4_language_id
from filigrane.llm.merkle import OP13_SQL, op13_merkle_manifest
from filigrane.llm.metric_tree import OP5_SQL, op5_metric_tree_top_k
from filigrane.llm.packing import op3_best_fit_packing
from filigrane.llm.quality import op10_quality
from filigrane.llm.simhash import op11_simhash_near_dedup
from filigrane.llm.syncmers import op2_syncmer_fingerprints
from filigrane.llm.token_counts import op1_token_counts
from filigrane.llm.warc import OP6_SQL, op6_warc
from filigrane.llm.whitening import op12_embedding_whitening


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_token_counts, op2_syncmer_fingerprints, op3_best_fit_packing, op4_language_id, op5_metric_tree_top_k,
        op6_warc, op7_jaccard_join, op8_bpe, op9_html_text, op10_quality, op11_simhash_near_dedup, op12_embedding_whitening, op13_merkle_manifest,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op5_metric_tree_top_k": OP5_SQL, "op6_warc": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op13_merkle_manifest": OP13_SQL}
