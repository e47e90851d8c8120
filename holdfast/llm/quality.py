"""Quality scores by a sparse rule ensemble.

Statistics of whole texts are Spark columns. Boosted trees are grown on a bounded sample of labelled
rows, every path from a root becomes a rule (a conjunction of comparisons), a logistic model with a
lasso penalty weighs rules and plain statistics, and the few that keep a weight are compiled into one
Spark column, so scoring is a projection without a shuffle.

Defined results: a null text counts as empty; statistics of empty texts are 0; several labels of one id
count by their largest; without labels of both kinds the score is the share of ones (0.5 without labels);
ids that are null are never learned from and not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.workspace import materialise

#: Labelled rows that the model is fitted on, about this many at most.
SAMPLE = 20_000
TREES, DEPTH, LEAF, RATE = 40, 3, 20, 0.3
CUTS = 32
PENALTY = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "lines", "word_length", "longest_word", "distinct_words", "distinct_lines", "line_words",
    "short_words", "letters", "capitals", "digits", "marks", "bars", "exclamations", "stops", "same_word",
)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def with_statistics(df: DataFrame, text: str, into: str = "stats") -> DataFrame:
    """Adds a struct of ``STATISTICS``; replaces a column of that name."""
    held = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = held.withColumns({
        "w": F.filter(F.split("t", r"\s+"), lambda x: x != ""),
        "l": F.filter(F.split("t", "\n"), lambda x: x != ""),
    })
    n, words, lines = F.length("t"), F.size("w"), F.size("l")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    # One capital marks the start of a sentence, so characters are counted by class.
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    without = lambda c: n - F.length(F.replace("t", F.lit(c), F.lit("")))
    following = F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1)))
    statistics = {
        "chars": n, "words": words, "lines": lines,
        "word_length": share(F.aggregate("w", F.lit(0), lambda total, x: total + F.length(x)), words),
        "longest_word": F.coalesce(F.aggregate("w", F.lit(0), lambda most, x: F.greatest(most, F.length(x))), F.lit(0)),
        "distinct_words": share(F.size(F.array_distinct("w")), words),
        "distinct_lines": share(F.size(F.array_distinct("l")), lines),
        "line_words": share(words, lines),
        "short_words": share(F.size(F.filter("w", lambda x: F.length(x) <= 3)), words),
        "letters": share(count(r"\p{L}"), n), "capitals": share(count(r"\p{Lu}"), n), "digits": share(count("[0-9]"), n),
        "marks": share(count(r"[^\p{L}\p{N}\s.,]"), n), "bars": share(without("|"), n),
        "exclamations": share(without("!"), n), "stops": share(without("."), words),
        "same_word": share(following, words),
    }
    counted = split.select("row", F.struct(*[statistics[s].cast("double").alias(s) for s in STATISTICS]).alias("counted"))
    field = F.col("row").getField
    return counted.select(*[field(c).alias(c) for c in df.columns if c != into], F.col("counted").alias(into))


@dataclass(frozen=True)
class Rule:
    """Conjunction of ``(statistic, above, cut)``: greater than the cut, or not."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, cut in self.parts:
            out &= (x[:, feature] > cut) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for feature, above, cut in self.parts:
            value = stats.getField(STATISTICS[feature])
            out = out & (value > cut if above else value <= cut)
        return out


@dataclass(frozen=True)
class Ensemble:
    """Weights of rules and of standardised, clipped statistics, and the intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()
    linear: tuple[tuple[int, float, float, float, float, float], ...] = ()

    def column(self, stats: Column) -> Column:
        """The score as one Spark expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        for feature, low, high, mean, scale, weight in self.linear:
            value = F.least(F.greatest(stats.getField(STATISTICS[feature]), F.lit(low)), F.lit(high))
            total = total + (value - mean) / scale * weight
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray):
    """One tree: the rules of its paths, and its prediction."""
    rules, value = [], np.zeros(len(x))

    def node(rows: np.ndarray, parts: tuple, depth: int) -> None:
        if parts:
            rules.append(Rule(parts))
        value[rows] = residual[rows].sum() / (weight[rows].sum() + 1.0)
        if depth == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-6, None, None)
        for f, c in enumerate(cuts):
            if len(c) == 0:
                continue
            g = np.bincount(bins[rows, f], residual[rows], len(c) + 1).cumsum()
            h = np.bincount(bins[rows, f], weight[rows], len(c) + 1).cumsum()
            n = np.bincount(bins[rows, f], minlength=len(c) + 1).cumsum()
            left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
            gain = np.where((n[:-1] >= LEAF) & (n[-1] - n[:-1] >= LEAF), left + right - g[-1] ** 2 / (h[-1] + 1), 0)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return
        _, f, at = best
        cut = float(cuts[f][at])
        below = bins[rows, f] <= at
        node(rows[below], (*parts, (f, False, cut)), depth + 1)
        node(rows[~below], (*parts, (f, True, cut)), depth + 1)

    node(np.arange(len(x)), (), 0)
    return rules, value


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    score, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = _sigmoid(score)
        rules, value = _grow(x, bins, cuts, y - p, p * (1 - p))
        score = score + RATE * value
        found.update(dict.fromkeys(rules))
    return list(found)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal steps; the intercept is not penalised."""
    n = len(y)
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, w0 = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, v0, t = w, w0, 1.0
    for _ in range(rounds):
        error = _sigmoid(a @ v + v0) - y
        new = v - step * (a.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new0 = v0 - step * error.mean()
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v0 = new + (t - 1) / further * (new - w), new0 + (t - 1) / further * (new0 - w0)
        w, w0, t = new, new0, further
    return w0, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble of statistics ``x`` (a row per text) and labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2 * LEAF:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))))
    rules = extract_rules(x, y)
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    clipped = np.clip(x, low, high)
    mean, scale = clipped.mean(0), clipped.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    a = np.column_stack([*(r.holds(x) for r in rules), (clipped - mean) / scale * 0.4])
    intercept, w = lasso_logistic(a.astype(float), y)
    kept = [(r, float(x)) for r, x in zip(rules, w) if x]
    linear = [(f, float(low[f]), float(high[f]), float(mean[f]), float(scale[f]), float(0.4 * x))
              for f, x in enumerate(w[len(rules):]) if x]
    return Ensemble(float(intercept), tuple(kept), tuple(linear))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Ensemble:
    """Fits on labelled rows that are not held out, about ``sample`` of them, drawn by a hash of the id.

    Only the sample's statistics reach the driver. The ids of the sample, of bounded number, are sent to the
    tasks, so the texts are not shuffled.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    rows = usable.groupBy(F.col(key).alias("labelled")).agg(F.max(F.col(label)).alias("y"))
    number = rows.count()
    if number > sample:
        rows = rows.filter(F.pmod(F.xxhash64("labelled"), F.lit(number)) < sample)
    rows = materialise(rows, "label-sample")
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(rows), F.col("id") == F.col("labelled"))
    seen = with_statistics(given, "t").select("id", "y", *[f"stats.{s}" for s in STATISTICS])
    drawn = materialise(seen, "quality-sample").toPandas().sort_values(["id", *STATISTICS])
    return fit(drawn[list(STATISTICS)].to_numpy(float), drawn["y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the score of every whole text."""
    return with_statistics(docs, text, "quality_stats").withColumn(into, model.column(F.col("quality_stats"))).drop("quality_stats")
