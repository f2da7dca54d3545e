"""Query plans: test-bed views, registered queries, flagship."""

import importlib

MODULES = (
    "q_hierarchy",
    "q_vocab",
    "q_combine",
    "q_clean",
    "q_rules",
    "q_sources",
    "q_mappings",
    "q_collections",
    "q_documentation",
    "q_enrich",
    "q_catalog",
)


def load_all() -> None:
    """Import every query module once so the registry is filled."""
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")
