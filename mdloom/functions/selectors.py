"""CSS selector list → Column predicate over a node struct.

Supported (what site profiles use): type ``tag``, universal ``*``, ``.class``,
``#id``, attribute ``[a]``, ``[a='v']``, ``[a="v"]``, ``[a=v]``, ``[a~=v]``,
``[a^=v]``, ``[a$=v]``, ``[a*=v]``, compound forms such as ``div[role='main']``,
the descendant combinator (whitespace), the child combinator ``>``, and comma
lists. Ancestors are looked up by index in the same page's ``nodes`` array
(``node_id`` is the 0-based preorder index), so matching never joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.tree import any_ancestor, node_at

_TOKEN = re.compile(r"""
    (?P<ws>\s*>\s*|\s+)
  | (?P<tag>[A-Za-z][A-Za-z0-9_-]*|\*)
  | \.(?P<cls>-?[A-Za-z_][A-Za-z0-9_-]*)
  | \#(?P<id>-?[A-Za-z_][A-Za-z0-9_-]*)
  | \[\s*(?P<attr>[A-Za-z_:][A-Za-z0-9_:.-]*)\s*
        (?:(?P<op>[~^$*|]?=)\s*(?:'(?P<v1>[^']*)'|"(?P<v2>[^"]*)"|(?P<v3>[^\]\s]+))\s*)?\]
""", re.X)


class SelectorError(ValueError):
    pass


def parse_selector(selector: str) -> list[list[tuple[str, dict]]]:
    """Selector list → list of chains; a chain is [(combinator, compound), ...]
    left to right, combinator of the first item is ''."""
    if selector is None or not selector.strip():
        raise SelectorError("empty selector")
    chains = []
    for part in _split_commas(selector):
        part = part.strip()
        if not part:
            raise SelectorError(f"empty item in selector list: {selector!r}")
        chain: list[tuple[str, dict]] = []
        comb = ""
        cur: dict | None = None
        pos = 0
        while pos < len(part):
            m = _TOKEN.match(part, pos)
            if not m or m.end() == pos:
                raise SelectorError(f"unsupported selector syntax at {part[pos:]!r}")
            pos = m.end()
            if m.group("ws") is not None:
                if cur is not None:
                    chain.append((comb, cur))
                    cur = None
                comb = ">" if ">" in m.group("ws") else " "
                continue
            if cur is None:
                cur = {"tag": None, "classes": [], "ids": [], "attrs": []}
            if m.group("tag"):
                if cur["tag"] is not None or cur["classes"] or cur["ids"] or cur["attrs"]:
                    raise SelectorError(f"type selector must come first: {part!r}")
                cur["tag"] = m.group("tag").lower()
            elif m.group("cls"):
                cur["classes"].append(m.group("cls"))
            elif m.group("id"):
                cur["ids"].append(m.group("id"))
            else:
                val = next((v for v in (m.group("v1"), m.group("v2"), m.group("v3")) if v is not None), None)
                cur["attrs"].append((m.group("attr").lower(), m.group("op"), val))
        if cur is None:
            raise SelectorError(f"dangling combinator in {part!r}")
        chain.append((comb, cur))
        chains.append(chain)
    return chains


def _split_commas(s: str) -> list[str]:
    out, depth, quote, buf = [], 0, None, []
    for ch in s:
        if quote:
            buf.append(ch)
            if ch == quote:
                quote = None
            continue
        if ch in "'\"":
            quote = ch
        elif ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append("".join(buf))
            buf = []
            continue
        buf.append(ch)
    out.append("".join(buf))
    return out


def _compound(n: Column, c: dict) -> Column:
    pred = n["kind"] == F.lit("element")
    if c["tag"] and c["tag"] != "*":
        pred = pred & (n["tag"] == F.lit(c["tag"]))
    for cl in c["classes"]:
        pred = pred & F.array_contains(n["classes"], F.lit(cl))
    for i in c["ids"]:
        pred = pred & (F.coalesce(n["elem_id"], F.lit("")) == F.lit(i))
    for name, op, val in c["attrs"]:
        v = F.element_at(n["attrs"], F.lit(name))
        if op is None:
            pred = pred & F.map_contains_key(n["attrs"], F.lit(name))
        elif op == "=":
            pred = pred & F.coalesce(v == F.lit(val), F.lit(False))
        elif op == "~=":
            pred = pred & F.coalesce(F.array_contains(F.split(F.trim(v), r"\s+"), F.lit(val)), F.lit(False))
        elif op == "^=":
            pred = pred & F.coalesce(v.startswith(F.lit(val)) & (F.lit(val) != ""), F.lit(False))
        elif op == "$=":
            pred = pred & F.coalesce(v.endswith(F.lit(val)) & (F.lit(val) != ""), F.lit(False))
        elif op == "*=":
            pred = pred & F.coalesce(F.contains(v, F.lit(val)) & (F.lit(val) != ""), F.lit(False))
        elif op == "|=":
            pred = pred & F.coalesce((v == F.lit(val)) | v.startswith(F.lit(val + "-")), F.lit(False))
    return pred


def _chain_pred(nodes: Column, n: Column, chain: list[tuple[str, dict]]) -> Column:
    comb, comp = chain[-1]
    pred = _compound(n, comp)
    if len(chain) == 1:
        return pred
    rest = chain[:-1]
    if comb == ">":
        parent = node_at(nodes, n["parent_id"])
        return pred & (n["parent_id"] >= 0) & F.coalesce(_chain_pred(nodes, parent, rest), F.lit(False))
    return pred & any_ancestor(nodes, n, lambda a: _chain_pred(nodes, a, rest))


def selector_predicate(selector: str, nodes: Column):
    """Return ``fn(n) -> Column`` testing whether node struct ``n`` (an element of
    ``nodes``) matches the selector list."""
    chains = parse_selector(selector)

    def pred(n: Column) -> Column:
        out = None
        for ch in chains:
            p = _chain_pred(nodes, n, ch)
            out = p if out is None else (out | p)
        return out
    return pred


def is_valid_selector(selector: str) -> bool:
    try:
        parse_selector(selector)
        return True
    except SelectorError:
        return False
