"""Quality classifier: a sparse rule ensemble over statistics of the whole text.

1. ``statistics`` gives each text a fixed list of numbers (shares of character classes, word and line figures).
2. On a bounded sample of labelled rows (``max_rows``, the first by hash) small regression trees are boosted; every
   path from a root to a node is a conjunctive rule.
3. Lasso logistic regression (proximal gradient) over the rules sets most weights to 0.
4. The rules left are compiled into one Spark column expression: intercept plus the weight of each rule that holds,
   through the logistic function.

Nulls: a null text counts as empty and gets the statistics of an empty text; rows whose label or id is null teach
nothing; of repeated labels of an id the lowest counts, and of its repeated rows the one with the least statistics, so
what is learned from is bounded. Very long texts are measured whole; equal texts get equal scores; an empty table gives
an empty result. Without labels of both classes the score is the share of
label 1, or 1.0 if there are none at all. Other columns pass through,
whatever their names; ``score`` replaces columns called score or predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, free_prefix, utf8

FEATURES = (
    "n_bytes", "n_words", "n_lines", "upper_share", "lower_share", "digit_share", "symbol_share", "mark_share", "other_share",
    "space_share", "word_bytes", "longest_word", "distinct_words", "distinct_lines", "symbols_a_word", "words_a_line", "marks_a_word",
)

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = 5 if _c >= 128 else 0 if chr(_c).isupper() else 1 if chr(_c).islower() else 2 if chr(_c).isdigit() else 6 if chr(_c).isspace() else 4 if chr(_c) in ".,;:'\"?()-" else 3


def figures(text: str | None) -> list[float]:
    raw = utf8(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    upper, lower, digit, symbol, mark, other, space = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7).tolist()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    return [
        float(n), float(len(words)), float(len(lines)), upper / n, lower / n, digit / n, symbol / n, mark / n, other / n,
        space / n, (n - space) / w, float(max(map(len, words), default=0)), len(set(words)) / w, len(set(lines)) / k, symbol / w, len(words) / k, mark / w,
    ]


def statistics(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """``docs`` with the columns <prefix><feature> double."""

    def run(texts):
        rows = np.asarray([figures(t) for t in texts.to_pylist()], np.float64).reshape(len(texts), len(FEATURES))
        return [pa.array(rows[:, i]) for i in range(len(FEATURES))]

    return annotate(docs, ", ".join(f"{prefix}{f} double" for f in FEATURES), run, [text])


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (feature index, is it above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, at in self.terms:
            ok &= (x[:, f] > at) == above
        return ok

    def column(self, prefix: str = "q_") -> Column:
        out = F.lit(True)
        for f, above, at in self.terms:
            c = F.col(f"{prefix}{FEATURES[f]}")
            out = out & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """Boosting's regression tree on gradients: yields (terms, rows, value) of every node under the root."""
    stack = [((), np.arange(len(x)), 0)]
    while stack:
        terms, rows, level = stack.pop()
        leaf = True
        if level < depth and len(rows) >= 2 * least:
            best, G, H = (1e-6, None, None), g[rows].sum(), h[rows].sum()
            for f, at in enumerate(cuts):
                if not len(at):
                    continue
                b = np.searchsorted(at, x[rows, f], "left")
                gs, hs, ns = (np.bincount(b, w, len(at) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, float(at[gain.argmax()]))
            if best[1] is not None:
                _, f, at = best
                above, leaf = x[rows, f] > at, False
                stack += [((*terms, (f, False, at)), rows[~above], level + 1), ((*terms, (f, True, at)), rows[above], level + 1)]
        if terms:
            yield terms, rows, (-g[rows].sum() / (h[rows].sum() + 1)) if leaf else None


def rules_from_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.15, seed: int = 11) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    margin, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        part = np.sort(rng.permutation(len(y))[: max(20, int(0.7 * len(y)))])
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y)[part], (p * (1 - p))[part]
        for terms, _, value in _tree(x[part], g, h, cuts, int(rng.integers(1, depth + 1)), max(3, len(part) // 200)):
            rule = Rule(tuple(sorted(terms)))
            found.setdefault(rule.terms, rule)
            if value is not None:
                margin[rule.holds(x)] += rate * value
    return list(found.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalized."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]
    constant: float | None = None

    def column(self, prefix: str = "q_") -> Column:
        """The score as one Spark column over the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0, [], float(y.mean()) if len(y) else 1.0)
    rules = rules_from_trees(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.empty((len(y), 0))
    intercept, w = lasso_logistic(z, y, penalty)
    return RuleModel(intercept, [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6])


def held_out() -> Column:
    """Rows that never teach: the checksum of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> RuleModel:
    """Learn from at most ``max_rows`` labelled rows that are not held out, the first by hash of their id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows ids: small enough to broadcast
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    one = rows.groupBy("doc_id").agg(F.min("q_label").alias("q_label"), F.min(F.struct(*(f"q_{f}" for f in FEATURES))).alias("x"))  # max_rows at most
    got = one.select("doc_id", "q_label", "x.*").toPandas().sort_values("doc_id")
    return fit(got.iloc[:, 2:].to_numpy(float), (got["q_label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score double and predicted int."""
    p = free_prefix(docs)
    s = statistics(docs, prefix=p).withColumn("score", model.column(p))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*(f"{p}{f}" for f in FEATURES))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those predicted to be of low quality; the columns stay as they are."""
    names, p = docs.columns, free_prefix(docs)
    s = statistics(docs, prefix=p).filter(train(docs, labels).column(p) >= threshold)
    return s.select(*[F.col(f"`{c}`") for c in names])
