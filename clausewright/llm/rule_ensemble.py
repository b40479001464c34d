"""A quality classifier: a sparse ensemble of rules over text statistics, run as one Spark column expression.

Statistics are Spark expressions over the text.  Boosted trees over them, grown on a bounded sample of labelled
rows, give rules: the path to each node is a conjunction of bounds.  A lasso-penalised logistic fit leaves few
rules with a weight, and these compile back to an expression, so scoring is a narrow, JVM-side pass.

The sample is the ``most`` labelled rows whose keys have the least hashes; all else covers all rows.  Defined cases:
a null text is the empty one, which gets a score as any other; rows without a label, or with a null one, don't train;
several labels of a key count by their mean; with labels of one class or none the score is their smoothed
mean; repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: A word that the next one repeats; words are runs without blanks.
SAME_AS_LAST = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))"


def statistics(text: Column) -> dict[str, Column]:
    """What rules look at; ratios are 0 where they have nothing to count."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.split(F.trim(t), r"[\x20\x09-\x0D]+")
    n_words = F.size(words)
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lower = F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    lines = F.split(t, "\n")
    return {
        "n_chars": F.length(t).cast("double"),
        "n_words": n_words.cast("double"),
        "symbols": without(SYMBOLS) / n_words,
        "pipes": without("|") / n_words,
        "marks": without("!?") / n_words,
        "stops": without(".,;:") / n_words,
        "digits": without("0123456789") / n,
        "upper": (F.length(t) - lower) / n,
        "word_chars": (n - (n_words - 1)) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "same_as_last": F.regexp_count(t, F.lit(SAME_AS_LAST)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": n_words / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, is an upper bound, bound)."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


def _grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, edges: list[np.ndarray], depth: int, least: int, path: tuple, out: list, rows: np.ndarray, values: np.ndarray) -> None:
    """Split by the greatest gain of a Newton step; every path below the root is a rule, leaves set ``values``."""
    values[rows] = g[rows].sum() / (w[rows].sum() + 1.0)
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    total_g, total_w, best = g[rows].sum(), w[rows].sum(), (1e-6, None)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        bin_ = np.searchsorted(cuts, x[rows, f], "left")  # bin <= k means value <= cuts[k]
        n = np.cumsum(np.bincount(bin_, minlength=len(cuts) + 1))[:-1]
        gs = np.cumsum(np.bincount(bin_, g[rows], len(cuts) + 1))[:-1]
        ws = np.cumsum(np.bincount(bin_, w[rows], len(cuts) + 1))[:-1]
        gain = gs**2 / (ws + 1) + (total_g - gs) ** 2 / (total_w - ws + 1) - total_g**2 / (total_w + 1)
        gain[(n < least) | (len(rows) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, cuts[k]))
    if best[1] is None:
        return
    f, cut = best[1]
    low = x[rows, f] <= cut
    _grow(x, g, w, edges, depth - 1, least, (*path, (f, True, float(cut))), out, rows[low], values)
    _grow(x, g, w, edges, depth - 1, least, (*path, (f, False, float(cut))), out, rows[~low], values)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, upper, cut in path:
        out &= (x[:, f] <= cut) if upper else (x[:, f] > cut)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic fit with an L1 penalty by accelerated proximal gradient; columns of ``r`` are centred and scaled."""
    beta, b0 = np.zeros(r.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    look, look0, t = beta.copy(), b0, 1.0
    v = np.ones(r.shape[1])
    for _ in range(30):  # the greatest eigenvalue, for the step
        v = r.T @ (r @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 4.0 / max(1.05 * np.linalg.norm(r @ v) ** 2 / len(y), 1e-9)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ look + look0, -30, 30))) - y
        new = look - rate * (r.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new0 = look0 - 4.0 * e.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look0 = new + (t - 1) / t_new * (new - beta), new0 + (t - 1) / t_new * (new0 - b0)
        beta, b0, t = new, new0, t_new
    return beta, b0


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 16, depth: int = 3, least: int = 10, cuts: int = 32, shrink: float = 0.3, penalties: tuple[float, ...] = (0.01, 0.003, 0.001)) -> tuple[list[Rule], float]:
    """Rules with weights, and the intercept.  The penalty is the one with the least loss on every fifth row."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 4 * least or y.min() == y.max():
        return [], float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    paths: list[tuple] = []
    z = np.full(len(y), np.log(prior / (1 - prior)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        values = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), edges, depth, least, (), paths, np.arange(len(y)), values)
        z = z + shrink * values
    paths = list(dict.fromkeys(paths))
    r = np.column_stack([_holds(x, p) for p in paths]).astype(np.float32)
    mean, sd = r.mean(0), np.maximum(r.std(0), 1e-3)
    scaled = (r - mean) / sd
    held = np.arange(len(y)) % 5 == 0
    losses = []
    for penalty in penalties:
        beta, b0 = _lasso(scaled[~held], y[~held], penalty)
        p = 1 / (1 + np.exp(-np.clip(scaled[held] @ beta + b0, -30, 30)))
        losses.append(-np.mean(np.log(np.where(y[held] == 1, p, 1 - p) + 1e-9)))
    beta, b0 = _lasso(scaled, y, penalties[int(np.argmin(losses))])
    rules = [Rule(tuple((names[f], upper, cut) for f, upper, cut in p), float(b / s)) for p, b, s in zip(paths, beta, sd, strict=True) if b]
    return rules, float(b0 - (beta * mean / sd).sum())


def compiled(rules: list[Rule], intercept: float) -> Column:
    """The probability as an expression over columns named as the statistics are."""
    z = F.lit(intercept)
    for rule in rules:
        holds = F.lit(True)
        for name, upper, cut in rule.bounds:
            holds = holds & ((F.col(name) <= cut) if upper else (F.col(name) > cut))
        z = z + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def crc_fold(key: Column, folds: int = 5) -> Column:
    """Which fold a key is in: CRC-32 of its decimal text modulo ``folds``."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, **fitting) -> tuple[list[Rule], float]:
    """Fit on at most ``most`` labelled keys outside fold 0.  The broadcast and what the driver takes have that bound."""
    mine = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_fold(F.col(key)) != 0))
    mine = mine.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sample = mine.orderBy(F.xxhash64("key"), "key").limit(most)
    stats = statistics(F.col("text"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").select("key", "y", *(c.alias(n) for n, c in stats.items()))
    found = rows.groupBy("key").agg(F.min(F.struct("y", *stats)).alias("r")).select("key", "r.*").orderBy(F.xxhash64("key"), "key").toPandas()
    names = list(stats)
    return fit(found[names].to_numpy(float), found["y"].to_numpy(float), names, **fitting)


def scored(docs: DataFrame, model: tuple[list[Rule], float], *, text: str = "text", out: str = "score", least: float | None = None) -> DataFrame:
    """``docs`` with a column ``out``; statistics live in a struct, so no column name can clash with theirs.

    With ``least``, only rows of at least that score.  A filter on the score must not be moved below the statistics,
    where every rule would compute them anew; a column that Spark can't compute twice keeps it above them.
    """
    stats = statistics(F.col(text))
    rules, intercept = model
    used = {b[0] for r in rules for b in r.bounds}
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(stats[n].alias(n) for n in stats if n in used), F.spark_partition_id().alias("fixed"))
    score = compiled(rules, intercept)
    if least is not None:
        inner = inner.where((score >= least) & (F.col("fixed") >= 0))
    return inner.select("row.*", score.alias(out))
