"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe_lexicon, curve_clusters, license_digests, merkle_manifest, metric_search, partition_join, quality_rules, simhash_windows, subword_lattice, suffix_buckets, toxicity_kernel, url_equivalence, warc_archive

_MODULES = (bpe_lexicon, partition_join, toxicity_kernel, url_equivalence, license_digests, warc_archive, suffix_buckets, quality_rules, metric_search, simhash_windows, subword_lattice, curve_clusters, merkle_manifest)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
