"""Secret scans: fixed patterns and character Markov models (operator 3).

All steps are DataFrame operations. One pass over the texts pulls out the spans of
three patterns and all runs of 16 or more of the characters that secrets are
made of; the rest works on those few strings. Each step takes time in proportion to the text.

Two Markov models of characters (order one, over ``ALPHABET``) are trained from
labelled samples of the corpus itself: values that the patterns confirm as secrets and that mix
digits with letters or upper with lower case (``random``), and runs of words in letters, joined by signs or capitals
(``ordinary``). Counts are taken over all documents; each distinct string counts once. Both models
are taken under the condition that only the character classes of the run occur (lower, upper, digits, signs), and
both give a part of their weight to all characters alike: half of it the random one, a hundredth the ordinary one, so that a
number in a name is not decisive. Strings without lower case are read in lower case. A run is a secret if its mean log-likelihood ratio per
transition is above ``LEAST``, or above ``LEAST_ONE`` if its letters and digits are of one class. Without both samples nothing is added.

Spans are in code points, end exclusive. Pattern spans always stay; of a run that is a secret
the method adds the parts outside them (kind ``markov``).

Results for odd input: a null text is an empty one, without spans; null
doc_ids and repeated rows keep a row each; other columns are kept whatever their names; an
empty table gives an empty result; texts of any length are scanned whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions.urls import let
from mdloom.llm.common import load, written

#: Fixed patterns of the scan, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a greedy run from its first AKIA on: 20 characters in all
HEX = r"[0-9a-f]{24,}"  # runs are greedy, so shorter ones are dropped here
RUN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}"
#: Words of at most 20 letters, in one case or with a capital, joined by signs or put together with capitals.
ORDINARY = r"^[+/_.=-]*(([a-z]{1,20}|[A-Z]{1,20})([+/_.=-]+([a-z]{1,20}|[A-Z]{1,20}|[A-Z][a-z]{1,19}))*|([a-z]{1,20}|[A-Z][a-z]{1,19})([+/_.=-]*[A-Z][a-z]{2,19}|[+/_.=-]+[a-z]{1,20})*)[+/_.=-]*$"
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.=-")
ALPHABET = "".join(CLASSES)
LEAST, LEAST_ONE = 0.35, 0.6
#: Part of the random and of the ordinary model's weight that all characters share.
SHARED = (0.5, 0.01)
#: Matches, and characters of a text, that are handled at once.
CHUNK, BLOCK = 256, 4096

_SPAN = "struct<start:bigint,stop:bigint,kind:string,value:string>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, stop, kind, value) of the pattern's matches, from the pieces between them. Running
    places are summed by chunks of matches, so that no array grows by one entry at a time for long."""
    none = F.array().cast(f"array<{_SPAN}>")

    def size(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["m"])

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("out"))

    def chunked(matches: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda k: F.slice(matches, k * CHUNK + 1, F.lit(CHUNK)))

    def starts(chunks: Column) -> Column:
        """Where each chunk begins in the text."""
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + size(x)))
        return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def placed(chunks: Column, begin: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda c, k: F.aggregate(
            c, F.struct(F.get(begin, k).alias("at"), none.alias("out")), place, lambda acc: acc["out"])))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else whole
    gaps = F.split(text, pattern, -1)
    matches = let(whole, lambda w: F.zip_with(F.zip_with(w, value, lambda m, v: F.struct(m.alias("m"), v.alias("value"))), F.slice(gaps, F.lit(1), F.size(w)),
                                              lambda x, g: F.struct(x["m"].alias("m"), x["value"].alias("value"), g.alias("gap"))))
    found = let(matches, lambda m: let(chunked(m), lambda c: let(starts(c), lambda b: placed(c, b))))
    found = F.when(text.rlike(pattern), found).otherwise(none)
    return F.filter(found, keep) if keep else found


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind in the order listed."""
    every = F.concat(_spans(text, ASSIGN, "0assign", lambda x: F.length(x["value"]) >= 6), _spans(text, ACCESS, "1access"), _spans(text, HEX, "2hex"))
    return F.transform(F.array_sort(F.transform(every, lambda x: F.struct(x["start"], x["kind"].alias("k"), x["stop"], x["value"]))),
                       lambda x: F.struct(x["start"], x["stop"], F.substring(x["k"], 2, 99).alias("kind"), x["value"]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _pairs(value: Column) -> Column:
    """Transitions of a run, as two-character strings."""
    return F.regexp_extract_all(value, F.lit("(?=(..))."), F.lit(1))


def _folded(value: Column) -> Column:
    return F.when(value.rlike("[a-z]"), value).otherwise(F.lower(value))


def _mixes(value: Column) -> Column:
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | (value.rlike("[A-Z]") & value.rlike("[a-z]"))


def trained(runs: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition for each set of classes, from rows (value,
    secret): set * n * n + i * n + j for the characters i and j of ALPHABET, n their number. Empty without both samples."""
    counts = (runs.where(F.col("secret").isNotNull()).select(_folded(F.col("value")).alias("value"), "secret").distinct()
              .select("secret", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("pair").pivot("secret", [True, False]).count().na.fill(0).collect())
    n = len(ALPHABET)  # at most n * n rows
    by_pair = {r["pair"]: (r["true"], r["false"]) for r in counts}
    if not sum(x for x, _ in by_pair.values()) or not sum(y for _, y in by_pair.values()):
        return []
    random, plain = [], []
    for a in ALPHABET:
        own = [by_pair.get(a + b, (0, 0)) for b in ALPHABET]
        # one count is spread over each row, so that unseen transitions stay possible
        sums = [sum(x) + 0.5 * n for x in zip(*own, strict=True)]
        for model, total, part, seen in zip((random, plain), sums, SHARED, zip(*own, strict=True), strict=True):
            model.append([(1 - part) * (x + 0.5) / total + part / n for x in seen])
    table = []
    for classes in range(1 << len(CLASSES)):
        inside = [classes >> next(k for k, c in enumerate(CLASSES) if b in c) & 1 for b in ALPHABET]
        for p, q in zip(random, plain, strict=True):
            of = [max(1e-12, sum(x for x, i in zip(row, inside, strict=True) if i)) for row in (p, q)]
            table += [round(math.log(x / of[0]) - math.log(y / of[1]), 3) for x, y in zip(p, q, strict=True)]
    return table


def _is_secret(ratios: Column, least: float, least_one: float):
    """Whether a run's mean ratio is above its bound."""
    n = len(ALPHABET)

    def test(value: Column) -> Column:
        has = [value.rlike(f"[{c}]").cast("int") for c in ("a-z", "A-Z", "0-9", "+/_.=-")]
        shape = F.struct((has[0] + has[1] * 2 + has[2] * 4 + has[3] * 8).alias("classes"), (has[0] + has[1] + has[2]).alias("kinds"), value.alias("value"))

        def mean(s: Column) -> Column:
            def ratio(pair: Column) -> Column:
                i, j = (F.position(F.substr(pair, F.lit(k), F.lit(1)), F.lit(ALPHABET)) - 1 for k in (1, 2))
                return F.get(ratios, (s["classes"] * n + i) * n + j)
            total = F.aggregate(_pairs(s["value"]), F.lit(0.0), lambda acc, p: acc + ratio(p))
            return total / (F.length(s["value"]) - 1) > F.when(s["kinds"] > 1, F.lit(least)).otherwise(F.lit(least_one))
        return let(shape, mean)
    return lambda value: let(_folded(value), test)


def _with_assigned(runs: Column, base: Column) -> Column:
    """The runs, each with the start of the assign span that covers its end (null: none). Such a span ends with a run, since its
    value is made of their characters; or its key stands at the end of a run and its value behind. Either way it is the
    neighbour of the run in the order of their ends."""
    kinds = [F.transform(F.filter(base, lambda b: b["kind"] == "assign"), lambda b: F.struct(b["stop"], F.lit(0).alias("run"), b["start"], F.lit("").alias("value"))),
             F.transform(runs, lambda r: F.struct(r["stop"], F.lit(1).alias("run"), r["start"], r["value"]))]

    def beside(ends: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            prev, after = F.get(ends, i - 1), F.get(ends, i + 1)
            own = F.when((i > 0) & (prev["stop"] == x["stop"]) & (prev["run"] == 0), prev["start"])
            next_ = F.when((after["run"] == 0) & (after["start"] < x["stop"]), after["start"])
            return F.struct(x["run"].alias("run"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"),
                            F.coalesce(own, next_).alias("assigned"))
        return F.filter(F.transform(ends, before), lambda x: x["run"] == 1)
    return let(F.array_sort(F.concat(*kinds)), beside)


def _outside(run: Column) -> Column:
    """The parts of a run outside its pattern spans; those of hex and access lie inside it."""
    own = F.array_sort(F.transform(F.concat(_spans(run["value"], ACCESS, ""), _spans(run["value"], HEX, "")),
                                   lambda x: F.struct((x["start"] + run["start"]).alias("start"), (x["stop"] + run["start"]).alias("stop"))))
    covers = F.concat(own, F.array(F.struct(F.coalesce(run["assigned"], run["stop"]).alias("start"), run["stop"].alias("stop"))))
    covers = F.array_sort(covers)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def gap(acc: Column, c: Column) -> Column:
        return F.struct(F.greatest(acc["at"], c["stop"]).alias("at"), F.when(c["start"] > acc["at"], F.concat(
            acc["out"], F.array(F.struct(acc["at"].alias("start"), c["start"].alias("stop"))))).otherwise(acc["out"]).alias("out"))
    return F.transform(F.aggregate(covers, F.struct(run["start"].alias("at"), none.alias("out")), gap, lambda acc: acc["out"]),
                       lambda p: F.struct(p["start"], p["stop"], F.lit("markov").alias("kind"), F.lit(None).cast("string").alias("value")))


def scanned(docs: DataFrame, keep: list[str], least: float = LEAST, least_one: float = LEAST_ONE) -> DataFrame:
    """(row, text, base, spans): the columns ``keep`` of docs as one struct, the text if it is among them, the pattern
    spans, and those with the added ones. Texts are scanned once: the spans are written beside the rows."""
    text = F.coalesce(docs["text"], F.lit(""))
    row = F.struct(F.lit(0).alias("c"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    found = written(docs.select(row, base_spans(text).alias("base"), _spans(text, RUN, "markov").alias("runs")), "secret-spans")
    runs = _with_assigned(F.col("runs"), F.col("base"))
    # labelled samples: values of confirmed spans, and words
    confirmed = F.transform(F.filter("base", lambda b: _mixes(b["value"])), lambda b: F.struct(b["value"].alias("value"), F.lit(True).alias("secret")))
    words = F.transform(F.filter(runs, lambda r: r["assigned"].isNull() & r["value"].rlike(ORDINARY)), lambda r: F.struct(r["value"].alias("value"), F.lit(False).alias("secret")))
    table = trained(found.select(F.explode(F.concat(confirmed, words)).alias("r")).select("r.value", "r.secret"))
    extra = F.filter("runs", lambda r: F.lit(False))
    if table:
        secret = _is_secret(F.from_json(F.lit(json.dumps(table)), "array<double>"), least, least_one)
        extra = F.flatten(F.transform(F.filter(runs, lambda r: secret(r["value"])), _outside))
    return found.select("row", "base", F.concat("base", extra).alias("spans"))


def _fresh(name: str, cols: list[str]) -> str:
    while name in cols:
        name = "_" + name
    return name


def with_spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """All columns of docs, with ``_base`` (pattern spans) and ``_spans`` (those and the
    added ones); where docs has such names, the added ones get more underscores in front."""
    cols = docs.columns
    return scanned(docs, cols, least).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)],
                                             F.col("base").alias(_fresh("_base", cols)), F.col("spans").alias(_fresh("_spans", cols)))


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, each span of a secret replaced by ``mark`` and n_chars counted anew."""
    cols = docs.columns
    old = {c: F.col(f"row.c{i}") for i, c in enumerate(cols)}
    some = F.size("spans") > 0
    text = F.when(some, redacted(old["text"], F.col("spans"), mark)).otherwise(old["text"])
    new = old | {"text": text}
    if "n_chars" in cols:
        new["n_chars"] = F.when(some, F.length(text)).otherwise(old["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return scanned(docs, cols).select(*[new[c].alias(c) for c in cols])


def _sorted_like_base(spans: Column) -> Column:
    order = F.transform(spans, lambda x: F.struct(
        x["start"], F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3).alias("k"), x["stop"], x["kind"]))
    return F.transform(F.array_sort(order), lambda x: F.struct(x["start"], x["stop"], x["kind"]))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (merged where they overlap) replaced by ``mark``. The text is read in blocks of
    ``BLOCK`` characters, so that a place far inside is not counted out from the front for each span."""
    def merged(found: Column) -> Column:
        """Chunks of spans hand on what is left between them: (at, pieces)."""
        def put(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            piece = F.struct(acc["at"].alias("start"), s["start"].alias("stop"))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(found, k * CHUNK + 1, F.lit(CHUNK)))

        def chunk(acc: Column, c: Column) -> Column:
            one = F.aggregate(c, F.struct(acc["at"].alias("at"), none.alias("out")), put)
            return let(one, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,stop:bigint>>>").alias("out"))
        return F.aggregate(chunks, start, chunk)

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        head = F.substr(F.get(blocks, i), (a % BLOCK + 1).cast("int"), F.when(i == j, b - a).otherwise(F.lit(BLOCK)).cast("int"))
        rest = F.concat(F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), (b % BLOCK).cast("int")))
        return F.concat(F.coalesce(head, F.lit("")), F.when(i == j, F.lit("")).otherwise(rest))

    def done(blocks: Column, m: Column) -> Column:
        pieces = F.transform(F.flatten(m["out"]), lambda p: F.concat(cut(blocks, p["start"], p["stop"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), cut(blocks, m["at"], F.length(text).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    found = let(_sorted_like_base(spans), merged)
    return F.when(F.size(spans) > 0, let(blocks, lambda b: let(found, lambda m: done(b, m)))).otherwise(text)


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(load(spark, sf_dir, "documents"), ["doc_id"])

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("row.c0").alias("doc_id"), *[number(k) for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(_sorted_like_base(F.col("spans"))).alias("spans"))
