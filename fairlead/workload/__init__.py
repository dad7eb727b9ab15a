"""Queries over the given tables, one per operator, with the SQL that checks them."""


def all_queries():
    import importlib

    from fairlead.workload import registry

    for module in MODULES:
        importlib.import_module(f"fairlead.workload.{module}")
    return registry.QUERIES, registry.ORACLES


MODULES = ["core", "figures", "frames", "quality", "lookups", "files", "output", "feed"]
