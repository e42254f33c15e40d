"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. **Statistics** of the whole text, as Spark columns: lengths, symbol, case and digit shares,
   repeated words and lines. Nothing else about a document enters a score.
2. **Rules.** Boosted trees of depth ``DEPTH`` are grown on the labelled sample; every path from a
   root to a node is a rule, a conjunction of thresholds.
3. **Lasso.** L1-penalised logistic regression over the rules (0 or 1 per document); the penalty
   is the one with the least loss on a validation fold. Most weights are exactly 0.
4. **Columns.** The remaining rules compile into one Spark column expression: scoring is a
   projection of the document scan, with no Python and no shuffle.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (those with the least
hash of their id), each a short row of numbers; scoring reads every document whole.

**Cases.** Null and empty texts have all statistics 0 and are scored like any text. Rows of
``labels`` without an id or label are not learned from; an id with several labels or texts
counts once per pair. With labels of one class only, or none, the score is the constant share
of good labels (1 if there are none): nothing is rejected without evidence. Rows without an id
are scored and are not held out. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import words
from trustlens.plans.sizing import materialize

#: Labelled rows the fit may use at most.
SAMPLE = 20_000
TREES = 30
DEPTH = 3
BINS = 48
SHRINKAGE = 0.3
#: Least rows on either side of a split (less in samples below 1,000 rows).
MIN_ROWS = 25
PENALTIES = (0.03, 0.015, 0.008, 0.004, 0.002, 0.001)
FOLDS = 5
THRESHOLD = 0.3

STATISTICS = (
    "n_words", "word_length", "symbols", "marks", "upper", "digits", "stops", "other",
    "stutter", "distinct_words", "repeated_lines", "line_words", "first_upper", "bare_words",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(text: str, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("double")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the statistics of column ``text`` as doubles."""
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("words", words(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    )
    n_chars, n_words = F.length("text").cast("double"), F.size("words").cast("double")
    n_lines = F.size("lines").cast("double")
    before = F.transform("words", lambda w, i: F.when(i > 0, F.get("words", i - 1) == w).otherwise(F.lit(False)))
    return out.select(
        *keep,
        n_words.alias("n_words"),
        _share(n_chars - (n_words - 1), n_words).alias("word_length"),
        _share(_count("text", r"[#*$%&|<>]"), n_words).alias("symbols"),
        _share(_count("text", r"[!?]"), n_words).alias("marks"),
        _share(_count("text", r"\p{Lu}"), n_chars).alias("upper"),
        _share(_count("text", r"[0-9]"), n_chars).alias("digits"),
        _share(_count("text", r"[.,;:]"), n_words).alias("stops"),
        _share(F.octet_length("text") - n_chars, n_chars).alias("other"),
        _share(F.size(F.filter(before, lambda x: x)).cast("double"), n_words).alias("stutter"),
        _share(F.size(F.array_distinct("words")).cast("double"), n_words).alias("distinct_words"),
        _share(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("repeated_lines"),
        _share(n_words, n_lines).alias("line_words"),
        _share(_count("text", r"(?m)^\p{Lu}"), n_lines).alias("first_upper"),
        _share(F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("double"), n_words).alias("bare_words"),
    )


Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """intercept + sum of weight over the rules that hold, on the log-odds scale."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...] = field(default=())

    def column(self) -> Column:
        """The score (0 to 1) as an expression over the statistics columns."""
        total = F.lit(float(self.intercept))
        for weight, conditions in self.rules:
            held = F.lit(True)
            for name, side, threshold in conditions:
                held = held & (F.col(name) <= threshold if side == "<=" else F.col(name) > threshold)
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]))


def _best_split(binned: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
    """(gain, feature, bin) of the best split of ``rows``, None if none has gain."""
    g, h = gradient[rows], weight[rows]
    base = g.sum() ** 2 / (h.sum() + 1)
    best = None
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        bins = binned[rows, f]
        size = len(cuts) + 1
        n = np.cumsum(np.bincount(bins, minlength=size))[:-1]
        left_g = np.cumsum(np.bincount(bins, g, size))[:-1]
        left_h = np.cumsum(np.bincount(bins, h, size))[:-1]
        gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - base
        fewest = min(MIN_ROWS, max(2, len(gradient) // 40))
        gain[(n < fewest) | (len(rows) - n < fewest)] = 0
        at = int(np.argmax(gain))
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), f, at)
    return best


def _grow(binned, edges, names, rows, gradient, weight, path, depth, out) -> None:
    """Appends (path, value, is_leaf) of every node below the root."""
    split = _best_split(binned, edges, rows, gradient, weight) if depth < DEPTH else None
    value = gradient[rows].sum() / (weight[rows].sum() + 1)
    if path:
        out.append((path, value, split is None))
    if split is None:
        return
    _, f, at = split
    left = binned[rows, f] <= at
    threshold = float(edges[f][at])
    for side, part in (("<=", rows[left]), (">", rows[~left])):
        _grow(binned, edges, names, part, gradient, weight, (*path, (names[f], side, threshold)), depth + 1, out)


def _holds(x: np.ndarray, names: tuple[str, ...], path) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for name, side, threshold in path:
        column = x[:, names.index(name)]
        held &= column <= threshold if side == "<=" else column > threshold
    return held


def _simplify(path) -> tuple[Condition, ...]:
    """A path with one bound per statistic and side."""
    bounds: dict[tuple[str, str], float] = {}
    for name, side, threshold in path:
        old = bounds.get((name, side), threshold)
        bounds[name, side] = min(old, threshold) if side == "<=" else max(old, threshold)
    return tuple((n, s, t) for (n, s), t in sorted(bounds.items()))


def extract_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees."""
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    random = np.random.default_rng(20)
    score = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = _sigmoid(score)
        rows = np.sort(random.choice(len(y), max(1, len(y) // 2), replace=False))
        nodes: list = []
        _grow(binned, edges, names, rows, y - p, p * (1 - p), (), 0, nodes)
        for path, value, leaf in nodes:
            rules[_simplify(path)] = None
            if leaf:
                score[_holds(x, names, path)] += SHRINKAGE * value
    return list(rules)


def _lasso(design: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Accelerated proximal gradient for mean logistic loss + penalty * |w|; the last weight is
    the intercept and is not penalised."""
    n = len(y)
    v = np.ones(design.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * np.linalg.norm(design @ v) ** 2 / n * 1.05 + 1e-9)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        gradient = design.T @ (_sigmoid(design @ z) - y) / n
        new = z - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t_new
    return w


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, names: tuple[str, ...] = STATISTICS) -> RuleModel:
    """The rule ensemble of statistics ``x`` (rows by names), labels ``y`` (0 or 1) and validation
    folds (fold 0 selects the penalty)."""
    if len(y) == 0:
        return RuleModel(30.0)
    if y.min() == y.max():
        return RuleModel(30.0 if y[0] else -30.0)
    rules = extract_rules(x, y, names)
    design = np.ones((len(y), len(rules) + 1))
    for i, rule in enumerate(rules):
        design[:, i] = _holds(x, names, rule)
    learn, check = fold != 0, fold == 0
    chosen = PENALTIES[-1]
    if check.any() and 0 < y[learn].mean() < 1:
        tried, w = [], np.zeros(design.shape[1])
        for penalty in PENALTIES:
            w = _lasso(design[learn], y[learn], penalty, w)
            p = np.clip(_sigmoid(design[check] @ w), 1e-6, 1 - 1e-6)
            loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
            tried.append((penalty, loss.mean()))
        chosen = min(tried, key=lambda t: t[1])[0]
    w = np.zeros(design.shape[1])
    for penalty in [p for p in PENALTIES if p >= chosen]:
        w = _lasso(design, y, penalty, w)
    kept = sorted(((float(c), r) for c, r in zip(w[:-1], rules) if c), key=lambda t: (-abs(t[0]), t[1]))
    return RuleModel(float(w[-1]), tuple(kept))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """The model fitted on at most ``sample`` labelled rows that are not held out."""
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL"
    )
    usable = usable.where(~held_out(F.col("doc_id"))).distinct()
    chosen = materialize(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    # at most ``sample`` rows of two numbers: small by construction
    learned = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(learned, "doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *STATISTICS)
    table = rows.limit(2 * sample).toArrow().to_pandas()
    fold = (table["doc_id"].to_numpy(dtype=np.int64) % np.int64(9973)) % FOLDS
    return fit(table[list(STATISTICS)].to_numpy(dtype=float), (table["label"].to_numpy() > 0).astype(float), fold)


def score(docs: DataFrame, model: RuleModel, *keep: str) -> DataFrame:
    """``keep`` columns and the score of every document."""
    return statistics(docs, *keep).select(*keep, model.column().alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels), "doc_id")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns kept."""
    columns = docs.columns
    model = train(docs, labels)
    whole = statistics(docs.select(F.struct(*columns).alias("row"), "text"), "row")
    # A filter is pushed below a projection by copying the projection's expressions into it, each
    # as often as it is used: every statistic once per rule. One column that may not be copied
    # keeps the filter above the statistics.
    whole = whole.withColumn("place", F.monotonically_increasing_id())
    return whole.where((model.column() >= THRESHOLD) & (F.col("place") >= 0)).select("row.*")
