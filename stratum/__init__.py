"""Spark-native text retrieval, entity-graph and ranking-evaluation engine."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What users import from here, and where it is.
_PUBLIC = {
    "TextCorpus": "facade", "build_session": "session", "ingest": "sources.xml_corpus", "build_index": "operators.bm25", "search": "operators.bm25", "search_text": "operators.bm25",
    "batch_search": "operators.bm25", "vector_rank": "operators.vectors", "rrf": "operators.fusion", "hybrid": "operators.fusion", "local_graph": "operators.graph", "fdbscan": "operators.clustering",
    "place_clusters": "operators.clustering", "suggest": "operators.clustering", "build_readings": "operators.readings", "per_query": "operators.evaluate", "occurrences": "operators.lookup",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    import importlib

    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)
