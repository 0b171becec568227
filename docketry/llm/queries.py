"""The queries of the llm operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from docketry.llm import q_content, q_counts, q_details, q_lines, q_pages, q_scans, q_tokens

MODULES = (q_content, q_counts, q_details, q_lines, q_pages, q_scans, q_tokens)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
