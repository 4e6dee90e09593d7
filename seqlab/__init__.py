"""seqlab: rule-governed token sequences and their corpora as Spark DataFrame operators.

Sub-packages
------------
functions  column-level building blocks (tokenise, normalise, extract, md5 draws, stats)
operators  DataFrame operators (rule conformance, synthesis, corpus building, n-grams, metrics, reports)
sources    scans and sinks (driver tables, JSONL / text corpora, nested JSON results)
plans      the registered queries and their independent DuckDB SQL oracles
streaming  Structured Streaming forms of tokenise, mix and running validity
"""

from seqlab.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
