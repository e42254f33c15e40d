"""URL filters: boosted trees on lexical features, trained from the URLs that rules label.

**Rules.** A rule names a verdict, a host and a path; it fits URLs of its host and all its subdomains
whose path starts with the rule's. The longest fitting rule decides (equal lengths: the longer
host, then block before allow). These URLs are the labelled ones.

**Features** of the other URLs, and of the labelled ones to learn from: lengths of URL, host,
path and query, depth, digit and capital shares, character entropy, parameters, host labels,
hyphens, scheme, extension; and statistics of the host's last label, its last two labels and the first
path segment: how many labelled URLs share them, and the smoothed share of blocked ones. A labelled
URL takes these from the half of the labelled URLs that it is not in, so that its own label never
enters its features.

**Trees.** Feature values fall into fixed bins. Labelled URLs are counted by their bins, then every
level of a tree is one aggregate over those counts: gradients and curvatures of the logistic loss by
(node, feature, bin), in integer millionths, so that sums do not depend on the order of rows. The
driver sees only these histograms (nodes x features x bins) and picks the best splits. The finished
trees compile into one column expression. DataFrame functions only.

**Scale.** Only the url column is read. Labelled URLs are pre-aggregated before each shuffle; a
suffix table is broadcast when counted to be small, else joined by shuffle with each suffix
spread over ``SALTS`` keys. Nothing is sampled: all labelled URLs train.

**Cases.** A null URL and one without ``://`` have an empty host and path, fit no rule with a host and
are judged as an empty or plain text. With labels of one class only, that class is the verdict; without
any, allow. Repeated rows count and are returned one by one. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import MAX_BROADCAST_ROWS, shared_folder, stored_table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TREES = 10
DEPTH = 3
SHRINKAGE = 0.4
#: Weight of the overall blocked share in a suffix's share, least labelled URLs on a split's side,
#: ridge of a leaf's value.
PRIOR = 5.0
LEAST = 5
RIDGE = 1.0
SALTS = 32
UNIT = 1_000_000

_LENGTHS = (0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 48, 56, 64, 96, 128, 256, 1024)
_COUNTS = (0, 1, 2, 3, 4, 5, 6, 8, 12, 16, 64)
_SHARES = tuple(i / 20 for i in range(20))
_FEW_SHARES = (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
_ENTROPIES = tuple(i / 4 for i in range(8, 22))
_SEEN = (0, 1, 3, 10, 30, 100, 300, 1000, 10_000, 100_000)
#: Upper edges of the bins of every feature; a value above the last edge is in the last bin.
EDGES = {
    "url_length": _LENGTHS, "host_length": _LENGTHS, "path_length": _LENGTHS, "query_length": _LENGTHS,
    "depth": _COUNTS, "digits": _FEW_SHARES, "capitals": _FEW_SHARES, "entropy": _ENTROPIES, "parameters": _COUNTS,
    "host_labels": _COUNTS, "hyphens": _COUNTS, "host_digits": _COUNTS, "secure": (0,), "extension": (0,), "fragment": (0,),
    "last_label_share": _SHARES, "last_label_seen": _SEEN, "domain_share": _SHARES, "domain_seen": _SEEN,
    "segment_share": _SHARES, "segment_seen": _SEEN,
}
FEATURES = tuple(EDGES)
SUFFIXES = ("last_label", "domain", "segment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path up to a query or fragment; empty without."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def decided(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r))
    for verdict, rule_host, rule_path in ranked:  # the last one to fit is the longest
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character: runs of the sorted characters, one after another."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))
    bits = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def add(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.when(same, acc["total"]).otherwise(acc["total"] + bits(acc["run"])).alias("total"),
        )

    n = F.length(text)
    runs = F.aggregate(F.array_sort(F.split(text, "")), start, add, lambda acc: acc["total"] + bits(acc["run"]))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - runs / n)).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, ...) with the lexical features and the keys of the suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda part, whole: F.when(F.length(whole) > 0, part / F.length(whole)).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "query_length": F.length(query),
            "depth": _count(F.col("path"), r"/[^/]"),
            "digits": share(_count(url, "[0-9]"), url),
            "capitals": share(_count(url, "[A-Z]"), url),
            "entropy": _entropy(url),
            "parameters": _count(query, r"[^&;]+"),
            "host_labels": _count(F.col("host"), r"[^.]+"),
            "hyphens": _count(F.col("host"), "-"),
            "host_digits": _count(F.col("host"), "[0-9]"),
            "secure": F.startswith(F.lower(F.substring(url, 1, 8)), F.lit("https://")).cast("int"),
            "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
            "fragment": F.contains(url, F.lit("#")).cast("int"),
            "last_label": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(kind, key, n0, n1, blocked0, blocked1): labelled URLs, and blocked ones, of each half by suffix."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in SUFFIXES]))
    rows = labelled.select(keys.alias("of"), "half", "blocked").select("of.*", "half", "blocked")
    measures = []
    for half in (0, 1):
        inside = F.col("half") == half
        measures += [F.count_if(inside).alias(f"n{half}"), F.count_if(inside & (F.col("blocked") == 1)).alias(f"blocked{half}")]
    return rows.groupBy("kind", "key").agg(*measures)


def with_suffixes(rows: DataFrame, table: DataFrame, few: bool, prior: float) -> DataFrame:
    """``rows`` with each suffix's share and count, a labelled row's from the other half."""
    out = rows
    if not few:
        out = out.withColumn("salt", F.pmod(F.xxhash64("url", "place"), F.lit(SALTS)))
    for kind in SUFFIXES:
        one = table.where(F.col("kind") == kind).drop("kind").withColumnRenamed("key", "of_key")
        same = F.col(kind) == F.col("of_key")
        if few:
            one = F.broadcast(one)
        else:
            one = one.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
            same = same & (F.col("salt") == F.col("of_salt"))
        out = out.join(one, same, "left")

        def seen(name: str) -> Column:
            both = F.col(f"{name}0") + F.col(f"{name}1")
            other = F.when(F.col("half") == 0, F.col(f"{name}1")).when(F.col("half") == 1, F.col(f"{name}0"))
            return F.coalesce(other, both, F.lit(0))

        n, blocked = seen("n"), seen("blocked")
        out = out.withColumns({f"{kind}_seen": n, f"{kind}_share": (blocked + PRIOR * prior) / (n + PRIOR)})
        out = out.drop("of_key", "n0", "n1", "blocked0", "blocked1", "of_salt")
    return out


def binned() -> Column:
    """The bins of all features as one array."""
    bins = []
    for name, edges in EDGES.items():
        bins.append(sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges[1:]), F.when(F.col(name) > edges[0], 1).otherwise(0)))
    return F.array(*[b.cast("tinyint") for b in bins])


@dataclass(frozen=True)
class Node:
    """A split on bins of one feature (goes left up to ``bin``), or a leaf with a value."""

    value: float = 0.0
    feature: int = -1
    bin: int = -1
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self, bins: Column) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(bins[self.feature] <= self.bin, self.left.column(bins)).otherwise(self.right.column(bins))


@dataclass(frozen=True)
class Trees:
    """Sum of the trees' values and a start, on the log-odds scale."""

    start: float
    trees: tuple[Node, ...] = ()

    def column(self, bins: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(bins)
        return total


def _gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def _best_split(cells: dict) -> tuple | None:
    """(gain, feature, bin, left sums, right sums) of the best split of a node's cells (feature, bin) ->
    (gradient, curvature, count); ties go to the lowest feature and bin."""
    best = None
    for f in range(len(FEATURES)):
        bins = sorted(b for g, b in cells if g == f)
        whole = [sum(cells[f, b][i] for b in bins) for i in range(3)]
        left = [0, 0, 0]
        for b in bins[:-1]:
            left = [x + y for x, y in zip(left, cells[f, b])]
            right = [x - y for x, y in zip(whole, left)]
            if min(left[2], right[2]) < LEAST:
                continue
            gain = (_gain(left[0] / UNIT, left[1] / UNIT) + _gain(right[0] / UNIT, right[1] / UNIT)
                    - _gain(whole[0] / UNIT, whole[1] / UNIT))
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = (gain, f, b, left, right)
    return best


def grow(counted: DataFrame, model: Trees) -> Node | None:
    """One more tree for the counted labelled URLs (bins, n, blocked), None if nothing splits."""
    p = 1 / (1 + F.exp(-model.column(F.col("bins"))))
    rows = counted.select(
        "bins", "n",
        F.round((F.col("blocked") - F.col("n") * p) * UNIT).cast("long").alias("g"),
        F.round(F.col("n") * p * (1 - p) * UNIT).cast("long").alias("h"),
    )
    splits: dict[int, tuple] = {}  # heap numbers: node i has the children 2 i and 2 i + 1
    values: dict[int, float] = {1: 0.0}
    for depth in range(DEPTH):
        open_nodes = [i for i in values if i >> depth == 1]
        at = _place(1, splits, F.col("bins"))
        cells = rows.select(at.alias("node"), "n", "g", "h", F.posexplode("bins").alias("feature", "bin"))
        cells = cells.where(F.col("node").isin(open_nodes)).groupBy("node", "feature", "bin")
        found: dict[int, dict] = {i: {} for i in open_nodes}
        for r in cells.agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).collect():  # nodes x features x bins
            found[r["node"]][r["feature"], r["bin"]] = (r["g"], r["h"], r["n"])
        for i in open_nodes:
            split = _best_split(found[i])
            if split:
                splits[i] = split
                for child, part in ((2 * i, split[3]), (2 * i + 1, split[4])):
                    values[child] = SHRINKAGE * (part[0] / UNIT) / (part[1] / UNIT + RIDGE)
        if not any(i in splits for i in open_nodes):
            break
    return _node(1, splits, values) if splits else None


def _place(i: int, splits: dict, bins: Column) -> Column:
    """Heap number of the node a row is in."""
    if i not in splits:
        return F.lit(i)
    _, f, b, _, _ = splits[i]
    return F.when(bins[f] <= b, _place(2 * i, splits, bins)).otherwise(_place(2 * i + 1, splits, bins))


def _node(i: int, splits: dict, values: dict) -> Node:
    if i not in splits:
        return Node(values[i])
    _, f, b, _, _ = splits[i]
    return Node(0.0, f, b, _node(2 * i, splits, values), _node(2 * i + 1, splits, values))


def train(counted: DataFrame, n: int, blocked: int) -> Trees:
    """Boosted trees from the counted labelled URLs; a constant when one class is missing."""
    if blocked in (0, n):
        return Trees(30.0 if n and blocked else -30.0)
    model = Trees(math.log(blocked / (n - blocked)))
    for _ in range(TREES):
        tree = grow(counted, model)
        if tree is None:
            break
        model = Trees(model.start, (*model.trees, tree))
    return model


def labelled_rows(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (of the rule), blocked and half (both null without a rule)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("decided", decided(F.col("host"), F.col("path"), rules)).select("*", "decided.*").drop("decided")
    half = F.when(F.col("verdict").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(2)))
    return rows.withColumn("blocked", (F.col("verdict") == "block").cast("long")).withColumn("half", half)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block by the trees) of every page."""
    folder = shared_folder(pages.sparkSession, "url-trees")
    # the place only spreads rows over salts; it is taken once, so that both passes agree
    rows = lexical(labelled_rows(pages, rules)).withColumn("place", F.monotonically_increasing_id())
    known = rows.where(F.col("blocked").isNotNull())
    table = stored_table(suffix_statistics(known), f"{folder}/suffixes")
    size = table.agg(
        F.count(F.lit(1)),
        *[F.coalesce(F.sum(F.when(F.col("kind") == SUFFIXES[0], F.col(c))), F.lit(0)) for c in ("n0", "n1", "blocked0", "blocked1")],
    ).first()
    n, blocked, few = size[1] + size[2], size[3] + size[4], size[0] <= MAX_BROADCAST_ROWS
    prior = blocked / n if n else 0.0
    whole = with_suffixes(rows, table, few, prior).withColumn("bins", binned())
    counted = whole.where(F.col("blocked").isNotNull()).groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
    model = train(stored_table(counted, f"{folder}/counted"), n, blocked) if 0 < blocked < n else train(counted, n, blocked)
    margin = model.column(F.col("bins"))
    by_method = F.when(margin >= 0, F.lit("block")).otherwise(F.lit("allow"))
    return whole.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), (1 / (1 + F.exp(-margin))).alias("score")
    )
