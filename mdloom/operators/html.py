"""HTML structure operators (H1-H8) on the per-page ``nodes`` array.

``parse_pages`` tokenises each page once (Arrow batches in a Python worker) and
replaces the ``html`` column with ``nodes ARRAY<STRUCT<...>>``. Everything else
in this module is a higher-order-function expression over that array: the page
row is the unit of work, so these operators never shuffle, and they run where
the page was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdloom.functions.selector_rows import MatchedNodes
from mdloom.functions.selectors import selector_predicate
from mdloom.functions.urls import let

NODE_TYPE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("end_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()),
    T.StructField("elem_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])
NODES_TYPE = T.ArrayType(NODE_TYPE)

# --- fixed values: cleaning list applied inside the content root ------------
UNWANTED_SELECTOR = ("script, style, nav, header, footer, .advertisement, .ads, "
                     ".social-share, .breadcrumb, .pagination, #comments")
# default selectors of a profile
DEFAULT_NAV_SELECTOR = "nav"
DEFAULT_CONTENT_SELECTOR = "main"
# HTML bytes tokenised per output Arrow batch: as Python objects nodes take some
# ten times their HTML, and each core of an executor has its own worker
ARROW_CHUNK_BYTES = 512 * 1024
# ----------------------------------------------------------------------------


def parse_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """H1: replace ``html`` by ``nodes``; other columns pass through unchanged.

    Select only the columns you need before calling: the Python worker receives
    every input column. It holds one input batch (Spark ends one at 64 MB by default)
    and the nodes of ``ARROW_CHUNK_BYTES`` of HTML, however large its partition is.
    """
    import pyarrow as pa  # noqa: F401  (worker side)

    try:
        par = pages.sparkSession.sparkContext.defaultParallelism
        few = pages.rdd.getNumPartitions() < par
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect)
        par, few = 0, False
    if few:
        # few input splits (e.g. one row group): spread pages over all cores so
        # the Python tokeniser is not a single task; large inputs skip this
        pages = pages.repartition(2 * par)
    keep = [f for f in pages.schema.fields if f.name != html_col]
    out_schema = T.StructType(keep + [T.StructField("nodes", NODES_TYPE, True)])
    names = [f.name for f in keep] + ["nodes"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from mdloom.functions.tokenize import nodes_arrow_array, release
        for b in batches:
            idx = b.schema.get_field_index(html_col)
            # slice by HTML volume so one output batch stays bounded (node arrays
            # are several times the size of their HTML)
            sizes = pc.fill_null(pc.binary_length(b.column(idx)), 0).to_pylist()
            for start, end in byte_chunks(sizes, ARROW_CHUNK_BYTES):
                part = b.slice(start, end - start)
                arr = nodes_arrow_array(part.column(idx).to_pylist())
                cols = [part.column(k) for k in range(part.num_columns) if k != idx] + [arr]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            # neither the batch nor what its tokenising left in the pools stays until the next one is read
            b = part = arr = cols = None
            release()

    return pages.mapInArrow(run, out_schema)


def byte_chunks(sizes: list[int], limit: int):
    """Consecutive (start, end) row ranges whose sizes sum to at most ``limit``
    (a single oversized row forms its own range)."""
    start, acc = 0, 0
    for i, sz in enumerate(sizes):
        if i > start and acc + sz > limit:
            yield start, i
            start, acc = i, 0
        acc += sz
    if start < len(sizes):
        yield start, len(sizes)


def node_at(nodes: Column, node_id: Column) -> Column:
    return F.element_at(nodes, node_id + 1)


def subtree(nodes: Column, n: Column) -> Column:
    """Strict descendants of node ``n`` (preorder keeps them contiguous)."""
    return F.slice(nodes, n["node_id"] + 2, n["end_id"] - n["node_id"])


def node_text(nodes: Column, n: Column, strip: bool = False, sep: str = "") -> Column:
    """Text of ``n``'s subtree; ``strip`` trims each string (get_text(strip=True))
    and drops the ones left empty."""
    texts = F.transform(F.filter(subtree(nodes, n), lambda t: t["kind"] == "text"),
                        lambda t: t["text"])
    if strip:
        texts = F.filter(F.transform(texts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")),
                         lambda s: s != "")
    text = F.array_join(texts, sep)
    return F.when(n["kind"] == "text", n["text"]).otherwise(text)


def matches(nodes: Column, selector) -> Column:
    """H2: nodes matching a selector list, in document order; ``MatchedNodes`` brings
    the matches of each row's own selector."""
    if isinstance(selector, MatchedNodes):
        return selector.nodes(nodes)
    return F.filter(nodes, selector_predicate(selector, nodes))


def content_root(nodes: Column, selector=DEFAULT_CONTENT_SELECTOR) -> Column:
    """H3: struct(root node, source) — first selector match in document order,
    else ``body`` (source 'body', a LOW error), else NULL (source 'none', MEDIUM)."""
    hit = F.try_element_at(matches(nodes, selector), F.lit(1))
    body = F.try_element_at(F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "body")),
                            F.lit(1))

    def pick(h):
        root = F.coalesce(h, body)
        source = (F.when(nodes.isNull(), F.lit("no_html"))
                  .when(h.isNotNull(), F.lit("selector"))
                  .when(root.isNotNull(), F.lit("body")).otherwise(F.lit("none")))
        return F.struct(root.alias("root"), source.alias("source"))
    return let(hit, pick)


def clean_nodes(nodes: Column, root: Column, unwanted: str = UNWANTED_SELECTOR) -> Column:
    """H4: the root's subtree minus every subtree rooted at an unwanted
    descendant; the root itself is never dropped."""
    inside = F.slice(nodes, root["node_id"] + 2, root["end_id"] - root["node_id"])

    def drop_bad(ins):
        # removed intervals, computed once per page (not per node)
        bad = F.transform(F.filter(ins, selector_predicate(unwanted, nodes)),
                          lambda b: F.struct(b["node_id"].alias("s"), b["end_id"].alias("e")))
        return let(bad, lambda bd: F.filter(
            ins, lambda n: ~F.exists(bd, lambda b: (n["node_id"] >= b["s"]) & (n["node_id"] <= b["e"]))))
    kept = let(inside, drop_bad)
    return F.when(root.isNull(), F.lit(None)).otherwise(F.concat(F.array(root), kept))


def nav_links(nodes: Column, nav_selector=DEFAULT_NAV_SELECTOR) -> Column:
    """H5: every ``a[href]`` inside every navigation match, nav matches in document
    order, links in document order within each; nested matches repeat links.
    Array of struct(nav_id, a_id, href (raw), link_text)."""
    navs = matches(nodes, nav_selector)
    per_nav = F.transform(navs, lambda m: F.transform(
        F.filter(subtree(nodes, m), lambda x: (x["kind"] == "element") & (x["tag"] == "a")
                 & F.map_contains_key(x["attrs"], F.lit("href"))),
        lambda a: F.struct(m["node_id"].alias("nav_id"), a["node_id"].alias("a_id"),
                           F.element_at(a["attrs"], F.lit("href")).alias("href"),
                           node_text(nodes, a, strip=True).alias("link_text"))))
    return F.flatten(per_nav)


def images(nodes: Column) -> Column:
    """H6: ``img`` elements with a non-empty ``src`` among ``nodes`` (document order):
    struct(img_id, src, alt)."""
    imgs = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "img")
                    & (F.coalesce(F.element_at(n["attrs"], F.lit("src")), F.lit("")) != ""))
    return F.transform(imgs, lambda n: F.struct(
        n["node_id"].alias("img_id"), F.element_at(n["attrs"], F.lit("src")).alias("src"),
        F.element_at(n["attrs"], F.lit("alt")).alias("alt")))
