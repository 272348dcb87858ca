"""All registered queries; importing this package fills the registry."""

from importlib import import_module

from lodework.plans.registry import PLANS

MODULES = (
    "scans", "relational", "joins", "aggregates", "windows", "scalars",
    "search", "vectors", "geo", "graph", "collections", "temporal",
    "privacy", "streams", "quality", "routines",
)

for _name in MODULES:
    import_module(f"lodework.plans.{_name}")

__all__ = ["PLANS"]
