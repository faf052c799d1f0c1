"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk estimator.

Trusted positives and unlabelled text train a linear model on surface statistics of whole texts. With the class prior
p of positives, the risk is p E_pos[loss(+)] + max(0, E_unl[loss(-)] - p E_pos[loss(-)]); where the second part turns
negative, the step climbs it back instead. The prior is estimated from the data by best-bin estimation: of all score
thresholds, the one where the share of unlabelled over the share of positive texts, with its confidence width, is
smallest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .columns import set_aside, values

CLASSES = 12
EXTRA = 6
WIDTH = CLASSES * CLASSES + EXTRA
SLICE = 1 << 20


@lru_cache(1)
def _char_classes() -> np.ndarray:
    """Class of each code point below 0x3000; later ones count as letters."""
    table = np.full(0x3000, 11, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch == "\n":
            table[c] = 3
        elif ch.isspace():
            table[c] = 2
        elif ch.isupper():
            table[c] = 0
        elif ch.isalpha():
            table[c] = 1
        elif ch.isdigit():
            table[c] = 4
        elif ch in ".,":
            table[c] = 5
        elif ch in ";:?'\"()-":
            table[c] = 6
        elif ch == "!":
            table[c] = 7
        elif ch == "|":
            table[c] = 8
        elif ch in "#*%&$@^~=+_":
            table[c] = 9
        elif ch in "<>[]{}/\\":
            table[c] = 10
    return table


def features(text: str | None) -> np.ndarray:
    """Surface statistics of a whole text: frequencies of character-class pairs, and how words repeat. Empty: zeros."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    pairs, table = np.zeros(CLASSES * CLASSES, np.int64), _char_classes()
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[max(0, at - 1) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 1).astype(np.int64)
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    words = text.split()
    n = len(words)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(text) - 1))
    if n:
        distinct = len(set(words))
        out[-EXTRA:] = (
            distinct / n,
            np.log1p(n) / 10,
            sum(map(eq, words, words[1:])) / n,
            min(3.0, np.log1p(len(text) / n) / 2),
            (distinct / n) * (np.log1p(n) / 10),  # long texts repeat words by nature
            1.0,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(all_p: np.ndarray, all_u: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 1e-3, batch: int = 2048) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with logistic loss; without a prior, on plain positive-against-unlabelled loss."""
    w = np.zeros(all_p.shape[1] + 1)
    all_p, all_u = np.hstack([all_p, np.ones((len(all_p), 1))]), np.hstack([all_u, np.ones((len(all_u), 1))])
    m, v, draw = np.zeros_like(w), np.zeros_like(w), np.random.default_rng(11)
    for step in range(1, steps + 1):
        p1, u1 = all_p[draw.integers(0, len(all_p), min(batch, len(all_p)))], all_u[draw.integers(0, len(all_u), min(batch, len(all_u)))]
        zp, zu = np.clip(p1 @ w, -30, 30), np.clip(u1 @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        towards = -((1 - sp) @ p1) / len(p1)  # gradient of E_pos[loss(+)]
        away_p, away_u = (sp @ p1) / len(p1), (su @ u1) / len(u1)
        if prior is None:
            grad = towards + away_u
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad = prior * towards + (away_u - prior * away_p) if negative >= 0 else prior * away_p - away_u
        grad = grad + decay * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of rows that the scorer was not fitted on."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.98, 99)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    qp, qu = np.maximum(above(positive), 1e-9), above(unlabelled)
    width = (np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive)))) / qp
    at = int(np.argmin(qu / qp + width))
    return float(np.clip(qu[at] / qp[at], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> QualityModel:
    """Fit on feature rows. Without positives every text scores 1; without unlabelled rows the positives stand in."""
    if not len(positive):
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 30.0, 1.0)
    unlabelled = unlabelled if len(unlabelled) else positive
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-4] = 1.0
    scale = lambda x: np.clip((x - mean) / spread, -6, 6)
    p, u = scale(positive.astype(np.float64)), scale(unlabelled.astype(np.float64))
    w, b = _descend(p[::2], u[::2], None, steps // 2)
    held_p, held_u = (p[1::2], u[1::2]) if min(len(p), len(u)) > 1 else (p, u)
    prior = best_bin_prior(held_p @ w + b, held_u @ w + b)
    w, b = _descend(p, u, prior, steps)
    return QualityModel(mean, spread, w, b, prior)


def train(docs: DataFrame, positives: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 8192, most_unlabelled: int = 8192, seed: int = 5) -> QualityModel:
    """Fit on a bounded sample: about ``most_positive`` of the ids in ``positives`` and ``most_unlabelled`` rows of ``docs``.

    Both are drawn by a seeded hash of the id, among rows where ``may_train`` holds (an expression over the id, valid
    for both tables); only their feature rows reach the driver (600 bytes each). Labels of other classes are not
    used. Repeated labels count once; null ids are not used; without any label every text scores 1. Rows of one id are
    drawn together, ties of the order among drawn rows broken by their features.
    """
    ship(docs.sparkSession)
    trusted = positives.select(F.col(id_col)).filter(may_train & F.col(id_col).isNotNull()).distinct()
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30))
    share = lambda most, n: int((1 << 30) * min(1.0, most / max(1, n)))
    chosen = trusted.filter(at < share(most_positive, trusted.count())).withColumn("_trusted", F.lit(True))
    other = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(1 << 30)) < share(most_unlabelled, docs.count())

    @F.arrow_udf("binary")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).tobytes() for t in values(texts)], pa.binary())

    drawn = docs.select(F.col(id_col), F.col(text_col)).filter(may_train & F.col(id_col).isNotNull()).join(F.broadcast(chosen), id_col, "left").withColumn("_drawn", other)
    got = drawn.filter("_trusted OR _drawn").select(F.coalesce("_trusted", F.lit(False)).alias("t"), "_drawn", measure(text_col).alias("x"), F.xxhash64(id_col).alias("o")).toArrow().sort_by([("o", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, WIDTH)
    is_pos, is_unl = np.array(got["t"].to_pylist(), bool), np.array(got["_drawn"].to_pylist(), bool)
    return fit(x[is_pos], x[is_unl])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); only the text is read.

    Whole texts of any length are read, in slices; null texts score as empty ones do; other columns may be null;
    repeated rows score alike; an empty table gives an empty result. Columns of ``docs`` named as a result are replaced,
    others keep their values whatever their names. No shuffle.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        rows = [features(t) for t in values(texts)]
        return pa.array(model.scores(np.vstack(rows)) if rows else np.zeros(0), pa.float64())

    rows, back = set_aside(docs, rated=rate(F.col(text_col)))
    return rows.select(*back("score", "predicted"), F.col("rated").alias("score"), (F.col("rated") >= threshold).cast("int").alias("predicted"))
