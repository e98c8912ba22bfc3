"""Operators for a large training-text corpus: one module per operator, each with its general
interface, its registered query and, where SQL can express it, the DuckDB SQL."""

from quakeframe.llm import (centroid_clusters, decontaminate, license_scan, merkle_manifest, minhash_dedup, partenum_join,
                            pii, quality, sharding, substring_dedup, token_counts, url_filter, word_bpe)

_MODULES = (decontaminate, token_counts, license_scan, url_filter, minhash_dedup, word_bpe, substring_dedup, quality, sharding, pii,
            centroid_clusters, partenum_join, merkle_manifest)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
