"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, contamination, divergence, infill, licenses, maintext, neardup, privacy, quality, rules, secrets, toxicity, warc

MODULES = (bpe, contamination, divergence, infill, licenses, maintext, neardup, privacy, quality, rules, secrets, toxicity, warc)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

# the pipeline belongs to this subpackage, but stands at the top of the repository
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
