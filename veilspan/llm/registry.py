"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from veilspan.llm import bpe, chroma, fingerprints, language_id, near_dedup, packing, quality, sharding, substring_dedup, token_shards

_MODULES = (quality, fingerprints, token_shards, bpe, substring_dedup, sharding, packing, near_dedup, chroma, language_id)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
