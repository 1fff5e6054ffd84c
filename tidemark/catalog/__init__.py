"""The registered queries, grouped as in the operator inventory."""
import importlib

MODULES = ["calendar_queries", "label_queries", "study_queries", "fold_queries", "enrich_queries", "report_queries", "model_queries"]


def _load():
    from tidemark.catalog import registry
    for name in MODULES:
        importlib.import_module(f"tidemark.catalog.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
