"""Walks over the preorder ``nodes`` array of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.urls import let


def node_at(nodes: Column, node_id: Column) -> Column:
    return F.element_at(nodes, node_id + 1)


def over_ancestors(nodes: Column, n: Column, init: Column, step) -> Column:
    """Fold ``step(value, ancestor)`` from ``n``'s parent up to the root: as many steps as
    ``n`` is deep, and no list of ancestors is kept for any node."""
    start = F.struct(n["parent_id"].alias("up"), init.alias("value"))
    climb = lambda acc, _: let(node_at(nodes, acc["up"]), lambda a: F.struct(
        a["parent_id"].alias("up"), step(acc["value"], a).alias("value")))
    return F.aggregate(F.array_repeat(F.lit(0), n["depth"]), start, climb, lambda acc: acc["value"])


def any_ancestor(nodes: Column, n: Column, pred) -> Column:
    """Whether ``pred(ancestor)`` holds for some ancestor of ``n``."""
    return over_ancestors(nodes, n, F.lit(False), lambda hit, a: hit | F.coalesce(pred(a), F.lit(False)))
