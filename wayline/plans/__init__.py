"""Registered queries on the given tables, each with its SQL twin where one exists."""

from wayline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load_all"]


def load_all():
    """Import every plan module once, which fills the two tables."""
    from importlib import import_module

    for name in PLAN_MODULES:
        import_module(f"wayline.plans.{name}")
    return QUERIES, ORACLES


PLAN_MODULES = ["time_plans", "geometry_plans", "spatial_plans", "box_plans", "trace_plans", "source_plans", "stream_plans", "can_plans"]
