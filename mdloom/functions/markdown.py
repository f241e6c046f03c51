"""H7: cleaned node array → Markdown string, as one Spark expression per page.

Each kept node contributes an *open* piece (sorted at ``(node_id, 0)``) and
elements also a *close* piece (sorted at ``(end_id, 1, -depth)``, i.e. after
their last descendant and before their parent's close). Pieces are sorted with
``array_sort`` and joined; block and line structure is carried by control
markers and resolved with a few ``regexp_replace`` passes.

Rendering rules (our declared Markdown, pinned by golden tests):
  * headings ``#``..``######``; paragraphs and other blocks separated by one
    blank line; whitespace inside text collapsed;
  * ``**strong**``, ``*em*``, inline ``code`` in backticks, ``pre`` as a fenced
    block with its text verbatim;
  * ``[text](href)`` links (href as written), ``![alt](src)`` images;
  * ``-`` bullets and ``1.`` numbers, two spaces of indent per nesting level;
  * ``br`` is a hard break (two spaces + newline), dropped at the end of a block;
  * tables as pipe tables with a ``---`` row after the first row;
  * every line inside a blockquote starts with ``> `` per nesting level;
  * ``\\ * _ ` [ ]`` in text are backslash-escaped; Unicode is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.tree import any_ancestor, node_at, over_ancestors
from mdloom.functions.urls import let

BLK = "\u0001"    # block boundary (blank line)
BRK = "\u0002"    # hard line break
NL = "\u0003"     # single newline (list items, table rows, code lines)
SP = "\u0004"     # protected space (code text, indentation)
QS = "\u0005"     # blockquote start
QE = "\u0006"     # blockquote end
# generated syntax characters, kept apart from text so line-start escaping
# only touches characters that came from the page
G_HASH, G_DASH, G_GT, G_DOT = "\ue000", "\ue001", "\ue002", "\ue003"
# emphasis openers / closers (strong, em), resolved after whitespace moves
S_O, E_O, S_C, E_C = "\ue004", "\ue005", "\ue006", "\ue007"

# --- fixed values: tag classes for rendering --------------------------------
BLOCK_TAGS = ["p", "div", "article", "section", "main", "body", "header", "footer", "nav",
              "aside", "address", "figure", "figcaption", "form", "fieldset", "details",
              "summary", "dl", "dt", "dd", "html", "center", "hgroup", "ul", "ol", "table",
              "blockquote", "caption"]
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
SKIP_TAGS = ["head", "script", "style", "title", "template", "noscript"]
# ----------------------------------------------------------------------------


def _inside(nodes: Column, n: Column, *tags: str) -> Column:
    return any_ancestor(nodes, n, lambda a: a["tag"].isin(*tags))


def _escape_text(s: Column) -> Column:
    s = F.regexp_replace(s, r"[\s]+", " ")
    s = F.regexp_replace(s, r"\\", r"\\\\")
    return F.regexp_replace(s, r"([*_`\[\]])", r"\\$1")


def _open_piece(nodes: Column, n: Column, src_map: Column | None) -> Column:
    tag = n["tag"]
    attrs = n["attrs"]
    parent = node_at(nodes, n["parent_id"])
    list_depth = over_ancestors(nodes, n, F.lit(0), lambda d, a: d + a["tag"].isin("ul", "ol").cast("int"))
    indent = F.repeat(F.lit(SP + SP), F.greatest(list_depth - 1, F.lit(0)))
    li_no = F.size(F.filter(F.slice(nodes, n["parent_id"] + 2, n["node_id"] - n["parent_id"]),
                            lambda x: (x["parent_id"] == n["parent_id"]) & (x["tag"] == "li")))
    bullet = F.when(parent["tag"] == "ol", F.concat(li_no.cast("string"), F.lit(G_DOT + " "))) \
        .otherwise(F.lit(G_DASH + " "))
    src = F.coalesce(F.element_at(attrs, F.lit("src")), F.lit(""))
    if src_map is not None:
        src = F.coalesce(F.element_at(src_map, src), src)
    heading = F.lit("")
    for h, k in HEADINGS.items():
        heading = F.when(tag == h, F.lit(BLK + G_HASH * k + " ")).otherwise(heading)
    in_pre = _inside(nodes, n, "pre")
    text = F.when(in_pre, F.regexp_replace(F.regexp_replace(n["text"], " ", SP), "\n", NL)) \
        .otherwise(_escape_text(n["text"]))
    in_skip = _inside(nodes, n, *SKIP_TAGS)
    return (F.when(n["kind"] == "text", F.when(in_skip, F.lit("")).otherwise(text))
            .when(tag.isin(*HEADINGS.keys()), heading)
            .when(tag == "li", F.concat(F.lit(NL), indent, bullet))
            .when(tag.isin("b", "strong"), F.lit(S_O))
            .when(tag.isin("i", "em"), F.lit(E_O))
            .when((tag == "code") & ~in_pre, F.lit("`"))
            .when(tag == "pre", F.lit(BLK + "```" + NL))
            .when((tag == "a") & F.map_contains_key(attrs, F.lit("href")), F.lit("["))
            .when(tag == "img", F.concat(F.lit("!["), F.coalesce(F.element_at(attrs, F.lit("alt")), F.lit("")),
                                         F.lit("]("), src, F.lit(")")))
            .when(tag == "br", F.lit(BRK))
            .when(tag == "hr", F.lit(BLK + "* * *" + BLK))
            .when(tag == "blockquote", F.lit(BLK + QS))
            .when(tag == "tr", F.lit(NL))
            .when(tag.isin("td", "th"), F.lit("| "))
            .when(tag.isin("ul", "ol") & (list_depth > 0), F.lit(NL))
            .when(tag.isin(*BLOCK_TAGS), F.lit(BLK))
            .otherwise(F.lit("")))


def _close_piece(nodes: Column, n: Column) -> Column:
    tag = n["tag"]
    # the nearest table: the first one on the way up
    table_id = over_ancestors(nodes, n, F.lit(None).cast("int"), lambda t, a: F.coalesce(t, F.when(a["tag"] == "table", a["node_id"])))
    first_tr = ~F.exists(F.slice(nodes, table_id + 2, n["node_id"] - table_id - 1),
                         lambda x: x["tag"] == "tr")
    ncells = F.size(F.filter(F.slice(nodes, n["node_id"] + 2, n["end_id"] - n["node_id"]),
                             lambda x: (x["parent_id"] == n["node_id"]) & x["tag"].isin("td", "th")))
    sep = F.concat(F.lit(NL), F.repeat(F.lit("| --- "), ncells), F.lit("|"))
    return (F.when(tag.isin(*HEADINGS.keys()), F.lit(BLK))
            .when(tag == "li", F.lit(NL))
            .when(tag.isin("b", "strong"), F.lit(S_C))
            .when(tag.isin("i", "em"), F.lit(E_C))
            .when((tag == "code") & ~_inside(nodes, n, "pre"), F.lit("`"))
            .when(tag == "pre", F.lit(NL + "```" + BLK))
            .when((tag == "a") & F.map_contains_key(n["attrs"], F.lit("href")),
                  F.concat(F.lit("]("), F.element_at(n["attrs"], F.lit("href")), F.lit(")")))
            .when(tag == "tr", F.when(table_id.isNotNull() & first_tr, F.concat(F.lit("|"), sep))
                  .otherwise(F.lit("|")))
            .when(tag.isin("td", "th"), F.lit(" "))
            .when(tag == "blockquote", F.lit(QE + BLK))
            .when(tag.isin("ul", "ol") & _inside(nodes, n, "ul", "ol"),
                  F.lit(NL))
            .when(tag.isin(*BLOCK_TAGS), F.lit(BLK))
            .otherwise(F.lit("")))


def _quote_lines(text: Column) -> Column:
    """Prefix every line inside (nested) blockquotes with ``> `` per level;
    blank quoted lines keep the bare ``>`` marks."""
    init = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        opened = F.size(F.split(line, QS, -1)) - 1
        closed = F.size(F.split(line, QE, -1)) - 1
        depth = acc["d"] + opened
        body = F.regexp_replace(line, f"[{QS}{QE}]", "")
        pre = F.repeat(F.lit(G_GT + " "), depth)
        pre = F.when(body == "", F.rtrim(pre)).otherwise(pre)
        return F.struct((depth - closed).alias("d"), F.array_append(acc["out"], F.concat(pre, body)).alias("out"))
    return F.array_join(F.aggregate(F.split(text, "\n", -1), init, step)["out"], "\n")


def render_markdown(kept: Column, nodes: Column, src_map: Column | None = None) -> Column:
    """Markdown of the cleaned content ``kept`` (a preorder sub-array of ``nodes``)."""
    opens = F.transform(kept, lambda n: F.struct(
        n["node_id"].alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"),
        _open_piece(nodes, n, src_map).alias("s")))
    closes = F.transform(F.filter(kept, lambda n: (n["kind"] == "element") & (n["tag"] != "img")
                                  & (n["tag"] != "br") & (n["tag"] != "hr")),
                         lambda n: F.struct(n["end_id"].alias("k1"), F.lit(1).alias("k2"),
                                            (-n["depth"]).alias("k3"), _close_piece(nodes, n).alias("s")))
    pieces = F.array_sort(F.concat(opens, closes))
    s = F.array_join(F.transform(pieces, lambda p: p["s"]), "")
    s = F.regexp_replace(s, " {2,}", " ")
    # spaces at the inner edge of emphasis move outside it; empty emphasis goes
    for _ in range(2):
        s = F.regexp_replace(s, f"([{S_O}{E_O}]+)( +)", "$2$1")
        s = F.regexp_replace(s, f"( +)([{S_C}{E_C}]+)", "$2$1")
        s = F.regexp_replace(s, f"{S_O}{S_C}|{E_O}{E_C}", "")
    s = F.regexp_replace(s, " {2,}", " ")
    s = F.regexp_replace(s, f" *([{BLK}{BRK}{NL}{QS}{QE}]) *", "$1")
    # quote markers hug their text: starts move after block breaks, ends before them
    for _ in range(2):
        s = F.regexp_replace(s, f"({QS}+)([{BLK}{NL}]+)", "$2$1")
        s = F.regexp_replace(s, f"([{BLK}{NL}]+)({QE}+)", "$2$1")
    # a hard break right before a block end (emphasis marks may sit between) is dropped
    s = F.regexp_replace(s, f"{BRK}([{S_C}{E_C}` ]*)(?=[{BLK}{NL}{QE}]|$)", "$1")
    s = F.regexp_replace(s, f"[{BLK}{NL}]*{BLK}[{BLK}{NL}]*", "\n\n")
    s = F.regexp_replace(s, f"{NL}+", "\n")
    s = F.regexp_replace(s, BRK, "  \n")
    s = F.regexp_replace(s, SP, " ")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = let(s, lambda v: F.when(F.contains(v, F.lit(QS)), _quote_lines(v)).otherwise(v))
    # page text that would read as Markdown syntax at a line start is escaped
    q = f"((?:{G_GT} ?)*)"
    s = F.regexp_replace(s, f"(^|\n){q}([#>])", r"$1$2\\$3")
    s = F.regexp_replace(s, f"(^|\n){q}([-+]) ", r"$1$2\\$3 ")
    s = F.regexp_replace(s, f"(^|\n){q}([0-9]+)\\. ", r"$1$2$3\\. ")
    for g, ch in ((G_HASH, "#"), (G_DASH, "-"), (G_GT, ">"), (G_DOT, "."),
                  (f"[{S_O}{S_C}]", "**"), (f"[{E_O}{E_C}]", "*")):
        s = F.regexp_replace(s, g, ch)
    out = let(s, lambda v: F.when(v == "", F.lit("")).otherwise(F.concat(v, F.lit("\n"))))
    return F.when(kept.isNull(), F.lit(None).cast("string")).otherwise(out)
