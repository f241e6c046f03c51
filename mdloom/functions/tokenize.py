"""HTML → flat preorder node list (the only per-row Python in the engine).

A small helper around the standard library's ``html.parser``: it emits one
record per element or text node, in document order, with the subtree interval
``[node_id, end_id]`` and the parent's id, so every tree question afterwards
(selector match, containment, first match, cleaning, Markdown order) is a
Spark expression over the ``nodes`` array.

Declared tree-repair rules (the subset browsers apply that matters for
documentation pages):
  * void elements never take children;
  * a block-level start tag closes an open ``p`` (and any inline element still
    open inside it, such as an unclosed ``b``);
  * ``li`` closes an open ``li`` of the same list, ``dt``/``dd`` likewise,
    ``tr``/``td``/``th``/``option`` close their open siblings;
  * an end tag closes up to its matching open element, or is ignored;
  * content outside ``head`` lands in an implicit ``body`` (created if absent);
  * ``script``/``style`` are raw text (a ``"</p>"`` in a script is text);
  * comments, doctype and processing instructions are dropped.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from html.parser import HTMLParser

# --- fixed values: HTML element classes -------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split())
P_CLOSERS = frozenset(
    ("address article aside blockquote center details dialog dir div dl fieldset "
     "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu "
     "nav ol p pre section summary table ul plaintext listing xmp").split())
SCOPE_STOP = frozenset("html table td th caption button object template marquee applet".split())
HEAD_TAGS = frozenset("head title meta link style script base noscript template".split())
SIBLING_CLOSE = {
    "li": ("li", frozenset(["ul", "ol", "menu"])),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr", frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": ("td th", frozenset(["tr", "table"])),
    "th": ("td th", frozenset(["tr", "table"])),
    "option": ("option", frozenset(["select", "datalist"])),
}
# -----------------------------------------------------------------------------

NODE_FIELDS = ("node_id", "end_id", "parent_id", "depth", "kind", "tag", "elem_id",
               "classes", "attrs", "text")

NODE_DDL = ("node_id INT, end_id INT, parent_id INT, depth INT, kind STRING, tag STRING, "
            "elem_id STRING, classes ARRAY<STRING>, attrs MAP<STRING,STRING>, text STRING")


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.stack: list[int] = []      # node ids of open elements
        self.tags: list[str] = []       # tags of open elements
        self.n_open: Counter = Counter()  # how many of each are open
        self.has_html = False
        self.has_body = False
        self.in_head = False

    # -- helpers -------------------------------------------------------------
    def _open(self, tag, attrs, void=False):
        nid = len(self.nodes)
        parent = self.stack[-1] if self.stack else -1
        amap = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        cls = amap.get("class")
        classes = cls.split() if cls else []
        self.nodes.append([nid, nid, parent, len(self.stack), "element", tag,
                           amap.get("id"), classes, list(amap.items()), None])
        if not void:
            self.stack.append(nid)
            self.tags.append(tag)
            self.n_open[tag] += 1

    def _pop(self):
        nid = self.stack.pop()
        self.n_open[self.tags.pop()] -= 1
        self.nodes[nid][1] = len(self.nodes) - 1

    def _pop_to(self, idx):
        while len(self.stack) > idx:
            self._pop()

    def _find(self, names, stops):
        if not any(self.n_open[t] for t in names):
            return -1
        for i in range(len(self.tags) - 1, -1, -1):
            t = self.tags[i]
            if t in names:
                return i
            if t in stops:
                return -1
        return -1

    def _ensure_body(self):
        if self.has_body:
            return
        if self.in_head:
            i = self._find(("head",), ())
            if i >= 0:
                self._pop_to(i)
            self.in_head = False
        if not self.has_html:
            self._open("html", [])
            self.has_html = True
        self._open("body", [])
        self.has_body = True

    # -- parser callbacks ----------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag == "html":
            if not self.has_html:
                self._open("html", attrs)
                self.has_html = True
            return
        if tag == "head":
            if not self.has_body and not self.in_head:
                if not self.has_html:
                    self._open("html", [])
                    self.has_html = True
                self._open("head", attrs)
                self.in_head = True
            return
        if tag == "body":
            if not self.has_body:
                if self.in_head:
                    i = self._find(("head",), ())
                    if i >= 0:
                        self._pop_to(i)
                    self.in_head = False
                if not self.has_html:
                    self._open("html", [])
                    self.has_html = True
                self._open("body", attrs)
                self.has_body = True
            return
        if not self.has_body and not (tag in HEAD_TAGS and (self.in_head or not self.has_html
                                                            or self.tags[-1:] == ["html"])):
            self._ensure_body()
        if tag in P_CLOSERS:
            i = self._find(("p",), SCOPE_STOP)
            if i >= 0:
                self._pop_to(i)
        if tag in SIBLING_CLOSE:
            names, stops = SIBLING_CLOSE[tag]
            i = self._find(names.split(), stops | SCOPE_STOP)
            if i >= 0:
                self._pop_to(i)
        self._open(tag, attrs, void=tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.tags and self.tags[-1] == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "head":
            if self.in_head:
                i = self._find(("head",), ())
                if i >= 0:
                    self._pop_to(i)
                self.in_head = False
            return
        i = self._find((tag,), ())
        if i >= 0:
            self._pop_to(i)

    def handle_data(self, data):
        if not data:
            return
        if not self.has_body and not (self.tags and self.tags[-1] in HEAD_TAGS):
            if not data.strip():
                return
            self._ensure_body()
        nid = len(self.nodes)
        parent = self.stack[-1] if self.stack else -1
        self.nodes.append([nid, nid, parent, len(self.stack), "text", None, None, [], [], data])

    def close(self):
        super().close()
        self._pop_to(0)


def tokenize(html: str | None) -> list[list] | None:
    """Nodes of one page as lists in ``NODE_FIELDS`` order; NULL html → NULL."""
    if html is None:
        return None
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    return b.nodes


def node_arrow_type():
    import pyarrow as pa
    return pa.struct([
        ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()),
        ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
        ("elem_id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ])


#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory of this worker's pools back to the system: Spark keeps workers
    for later tasks, idle ones count against the executor's memory too."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def nodes_arrow_array(htmls):
    """Arrow ``list<struct>`` array for a batch of HTML strings, built column-wise."""
    import pyarrow as pa
    t = node_arrow_type()
    cols = [[] for _ in NODE_FIELDS]
    offsets = [0]
    valid = []
    for h in htmls:
        rows = tokenize(h)
        if rows is None:
            valid.append(False)
        else:
            valid.append(True)
            for r in rows:
                for c, v in zip(cols, r):
                    c.append(v)
        offsets.append(len(cols[0]))
    i32 = pa.int32()
    str_list = pa.list_(pa.string())
    arrays = [
        pa.array(cols[0], i32), pa.array(cols[1], i32), pa.array(cols[2], i32),
        pa.array(cols[3], i32), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()),
        pa.array(cols[6], pa.string()), pa.array(cols[7], str_list),
        pa.array(cols[8], pa.map_(pa.string(), pa.string())), pa.array(cols[9], pa.string()),
    ]
    structs = pa.StructArray.from_arrays(arrays, fields=list(t))
    mask = None if all(valid) else pa.array([not v for v in valid])
    return pa.ListArray.from_arrays(pa.array(offsets, i32), structs, type=pa.list_(t), mask=mask)
