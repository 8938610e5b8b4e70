"""The registered queries of this package and the SQL of those that have one; tests hold the others against brute force, round trips or
held-out labels."""

from __future__ import annotations

from tessera.llm.line_dedup import op5_line_dedup
from tessera.llm.merkle import op11_merkle_manifest
from tessera.llm.mixing import op10_mixing
from tessera.llm.ngram_join import op6_ngram_join
from tessera.llm.oracles import ORACLES  # noqa: F401
from tessera.llm.pieces import op8_sentencepiece
from tessera.llm.pii import op2_pii
from tessera.llm.quality import op9_quality
from tessera.llm.secrets_scan import op7_secret_scan
from tessera.llm.spelling import op13_spelling_variants
from tessera.llm.threshold_topk import op3_exact_topk
from tessera.llm.token_files import op12_token_files
from tessera.llm.toxicity import op4_toxicity
from tessera.llm.vector_dedup import op1_embedding_near_dedup

QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_pii, op3_exact_topk, op4_toxicity, op5_line_dedup, op6_ngram_join, op7_secret_scan, op8_sentencepiece, op9_quality, op10_mixing, op11_merkle_manifest, op12_token_files, op13_spelling_variants)}
