"""Batched property-graph question answering and analytics on Spark DataFrames."""

import importlib

#: Where the package's main names live; they are imported when they are first asked for.
_HOMES = {"Index": "index", "Graph": "operators.graph", "WalkConfig": "operators.walk", "walk": "operators.walk", "link": "operators.link", "LexicalDecider": "operators.decide", "TableDecider": "operators.decide", "FunctionDecider": "operators.decide", "read_triples": "sources.triples", "read_documents": "sources.documents"}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_HOMES[name]}"), name)
