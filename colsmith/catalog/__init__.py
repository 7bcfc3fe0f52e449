"""Named queries over the parquet tables, most of them with an equivalent SQL text."""

from colsmith.catalog import registry


def load():
    """(queries, SQL texts) of every catalogue module."""
    import importlib

    for module in registry.MODULES:
        importlib.import_module(f"colsmith.catalog.{module}")
    return dict(registry.QUERIES), dict(registry.SQL)
