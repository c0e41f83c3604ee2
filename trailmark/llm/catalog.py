"""All registered queries of this folder."""

import importlib

for _name in ("token_counts", "secrets", "mixing", "simhash", "topk", "substrings", "phrases", "pieces", "language", "toolcalls", "filter_audit", "collocations", "vector_graph"):
    importlib.import_module(f"trailmark.llm.{_name}")

from trailmark.llm.book import ORACLE, QUERIES  # noqa: E402

__all__ = ["ORACLE", "QUERIES"]
