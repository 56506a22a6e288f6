"""The subpackage's queries and oracle SQL, for the entry file."""

from loomgraph.llm import bpe, centroids, chat_format, exact_dedup, filter_audit, media, mixing, near_dedup, quality, sharding, substring_dedup, vector_dedup, warc

_MODULES = (chat_format, bpe, quality, warc, sharding, substring_dedup, exact_dedup, mixing, media, near_dedup, centroids, vector_dedup, filter_audit)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
