"""Selectors as data (H2 for many profiles): steps in rows, matched in one pass over a page's nodes.

``selectors.py`` writes one selector into the plan. Here the selector of each row is
data: ``parsed_steps`` turns a column of selector texts into an array of steps (one
per compound of each chain), and ``matched_nodes`` walks the preorder array of nodes once
with them. The state handed from a node to its children is the set of steps matched by the parent
itself (for ``>``) and by any ancestor (for a blank); a step matches a node if its compound does and the
step before it stands in the set its combinator asks for. So any number of distinct selectors runs in
one plan, and the cost of a page is its nodes times the steps of its own selector.

A selector that cannot be parsed has null steps: it matches nothing and is an error row of its profile.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.selectors import SelectorError, parse_selector
from mdloom.functions.urls import let

STEPS = ("array<struct<id:int,prev:int,comb:string,last:boolean,tag:string,classes:array<string>,ids:array<string>,"
         "attrs:array<struct<name:string,op:string,value:string>>>>")


def steps_of(selector: str | None) -> list[dict] | None:
    """The steps of a selector list: ``prev`` is the step before it in its chain, -1 for the first."""
    try:
        chains = parse_selector(selector)
    except SelectorError:
        return None
    out = []
    for chain in chains:
        for place, (comb, compound) in enumerate(chain):
            out.append({"id": len(out), "prev": len(out) - 1 if place else -1, "comb": comb.strip(), "last": place == len(chain) - 1,
                        "tag": None if compound["tag"] in (None, "*") else compound["tag"], "classes": compound["classes"], "ids": compound["ids"],
                        "attrs": [{"name": n, "op": op or "", "value": v} for n, op, v in compound["attrs"]]})
    return out


def parsed_steps(selector) -> Column:
    """Steps of a column of selector texts (a table of profiles or of distinct selectors); null where a text is no selector."""
    @F.pandas_udf(STEPS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(steps_of)
    return run(selector)


def _attr(attrs: Column, a: Column) -> Column:
    value, want, op = F.try_element_at(attrs, a["name"]), a["value"], a["op"]
    some = want != ""
    holds = (F.when(op == "", F.lit(True)).when(op == "=", value == want)
             .when(op == "~=", F.array_contains(F.split(F.trim(value), r"\s+"), want))
             .when(op == "^=", F.startswith(value, want) & some).when(op == "$=", F.endswith(value, want) & some)
             .when(op == "*=", F.contains(value, want) & some)
             .when(op == "|=", (value == want) | F.startswith(value, F.concat(want, F.lit("-")))))
    return value.isNotNull() & F.coalesce(holds, F.lit(False))


def _compound(n: Column, s: Column) -> Column:
    return ((s["tag"].isNull() | (s["tag"] == n["tag"])) & F.forall(s["classes"], lambda c: F.array_contains(n["classes"], c))
            & F.forall(s["ids"], lambda i: F.coalesce(n["elem_id"] == i, F.lit(False))) & F.forall(s["attrs"], lambda a: _attr(n["attrs"], a)))


def matched_nodes(nodes: Column, steps: Column, only_first: bool = False) -> Column:
    """node_ids that match, in document order (or the first alone); empty where steps are null."""
    none = F.array().cast("array<int>")
    path = F.array().cast("array<struct<own:array<int>,above:array<int>>>")

    def step(acc: Column, n: Column) -> Column:
        """acc: the sets of the open elements from the root down, and the matches so far."""
        def entered(up: Column) -> Column:
            own = F.transform(F.filter(steps, lambda s: _compound(n, s) & (
                (s["prev"] < 0) | F.array_contains(F.when(s["comb"] == ">", up["own"]).otherwise(up["above"]), s["prev"]))), lambda s: s["id"])
            return let(own, lambda o: let(F.exists(steps, lambda s: s["last"] & F.array_contains(o, s["id"])), lambda hit: F.struct(
                F.concat(F.slice(acc["path"], F.lit(1), n["depth"]), F.array(F.struct(o.alias("own"), F.array_union(o, up["above"]).alias("above")))).alias("path"),
                F.when(hit, F.concat(acc["out"], F.array(n["node_id"]))).otherwise(acc["out"]).alias("out"))))

        top = F.struct(none.alias("own"), none.alias("above"))
        inside = let(F.when(n["depth"] > 0, F.get(acc["path"], n["depth"] - 1)).otherwise(top), entered)
        skip = n["kind"] != "element"
        if only_first:
            skip = skip | (F.size(acc["out"]) > 0)
        return F.when(skip, acc).otherwise(inside)

    found = F.aggregate(nodes, F.struct(path.alias("path"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(steps.isNull() | nodes.isNull(), none).otherwise(found)


class MatchedNodes:
    """A selector for the operators of ``operators.html``: the nodes whose ids stand in a column made by ``matched_nodes``."""

    def __init__(self, ids: Column):
        self.ids = ids

    def nodes(self, nodes: Column) -> Column:
        return F.transform(self.ids, lambda i: F.element_at(nodes, i + 1))
