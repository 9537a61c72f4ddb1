"""All registered queries of the subpackage and the SQL of those that have one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("token_files", "bpe_tree", "feistel", "quality", "chat", "warc", "toxicity", "jaccard", "tiling", "pseudo")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
