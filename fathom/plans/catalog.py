"""All contract queries, imported in one place."""

from __future__ import annotations

from fathom.plans import contract
from fathom.plans import q_profile  # noqa: F401  (registers profile_*)

_LOADED = False


def load() -> None:
    global _LOADED
    if _LOADED:
        return
    import importlib
    for mod in ("q_clean", "q_transform", "q_chart", "q_query", "q_io"):
        try:
            importlib.import_module(f"fathom.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"fathom.plans.{mod}":
                raise
    _LOADED = True


def queries():
    load()
    return dict(contract.QUERIES)


def oracle_sql():
    load()
    return dict(contract.ORACLE)
