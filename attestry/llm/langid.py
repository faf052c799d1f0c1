"""Language identification of words and texts by a linear-chain conditional random field.

Every word is a place in the chain and gets a language. Its features are its affixes (first and last three letters),
the three-letter windows over the word and its borders, and the word itself if the lexicon holds it; between
neighbours, transitions are learned. Forward-backward gives each word's posterior, so a code-switched text gets
several languages; a text's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .columns import set_aside

BITS = 17
UNDECIDED = "und"
CHUNK = 3 << 20
BORDER = np.uint64(7)


@lru_cache(1)
def _letters() -> np.ndarray:
    """2 for letters, 1 for marks, which belong to a word but make none alone, 0 for other code points."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(sys.maxunicode + 1):
        table[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
    return table


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Hash 64-bit numbers into the feature table."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Words:
    """Words of several texts in one row: feature numbers per letter window and per word, and each text's word count."""

    windows: np.ndarray
    first_window: np.ndarray
    affixes: np.ndarray  # two per word
    whole: np.ndarray  # 64-bit hash of the word
    per_text: np.ndarray


def read_words(texts: list[str | None]) -> Words:
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n\n" + "\n\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters()[codes]
    inside = kinds > 0
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    letters = np.concatenate(([0], np.cumsum(kinds == 2)))
    real = letters[ends] > letters[starts]
    for a, b in zip(starts[~real].tolist(), ends[~real].tolist()):
        inside[a:b] = False
    starts, ends = starts[real], ends[real]
    c = np.where(inside, codes, 0).astype(np.uint64) * np.uint64(0x100000001B3) + BORDER
    c[~inside] = BORDER
    at = np.flatnonzero(inside)
    a, b, d = np.uint64(0x9E3779B1), np.uint64(0x85EBCA6B), np.uint64(0xC2B2AE35)
    windows = _mix(c[at - 1] * a + c[at] * b + c[at + 1] * d, 1)
    first = np.searchsorted(at, starts)
    after = np.minimum(starts + 2, ends)  # of short words, the border itself
    head = c[starts] * a + c[np.minimum(starts + 1, ends)] * b + c[after] * d
    before = np.maximum(ends - 3, starts - 1)
    tail = c[ends - 1] * a + c[np.maximum(ends - 2, starts - 1)] * b + c[before] * d
    power = np.cumprod(np.full(64, 0x5851F42D4C957F2D, np.uint64))
    place = at - np.repeat(starts, ends - starts)
    whole = np.add.reduceat(c[at] * power[place % 64] + place.astype(np.uint64) // np.uint64(64), first) if len(first) else np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    borders = np.concatenate(([0], np.cumsum(lengths)))
    per_text = np.diff(np.searchsorted(starts, borders))
    return Words(windows, first, np.stack([_mix(head, 2), _mix(tail, 3)], axis=1), whole, per_text)


@dataclass
class LanguageModel:
    labels: list[str]
    window: np.ndarray  # weights: feature by label
    affix: np.ndarray
    words: np.ndarray  # hashes of the lexicon's words, sorted
    lexicon: np.ndarray  # weights: word by label, and zeros for all other words
    start: np.ndarray
    step: np.ndarray  # transitions, from row to column

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.whole):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.stack([np.add.reduceat(column[words.windows], words.first_window) for column in self.window.T.copy()], axis=1)
        return out + self.affix[words.affixes[:, 0]] + self.affix[words.affixes[:, 1]] + self.lexicon[_places(self.words, words.whole)]


def _places(lexicon: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the lexicon; behind its end for words that it does not hold."""
    if not len(lexicon):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
    return np.where(lexicon[at] == words, at, len(lexicon))


def forward_backward(emit: np.ndarray, start: np.ndarray, step: np.ndarray, lengths: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of padded chains ``emit`` (places, chains, labels); places past a chain's length are left 0.

    ``moves``, if given, gets the expected transition counts added.
    """
    places, chains, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True), dtype=np.float64) + 1e-12
    first, move = np.exp(start - start.max()), np.exp(step - step.max())
    padded = lengths.min() < places if chains else False
    live = np.arange(places)[:, None, None] < lengths[None, :, None]
    if padded:
        e = np.where(live, e, 1.0)
    ahead = np.empty((places, chains, labels))
    x = first * e[0]
    ahead[0] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, places):
        x = (ahead[t - 1] @ move) * e[t]
        x /= x.sum(axis=1, keepdims=True)
        ahead[t] = x
    back, post, turned = np.ones((chains, labels)), np.empty((places, chains, labels)), move.T.copy()
    for t in range(places - 1, -1, -1):
        np.multiply(ahead[t], back, out=post[t])
        x = e[t] * back
        y = x @ turned
        if moves is not None and t:
            z = (ahead[t - 1] * y).sum(axis=1, keepdims=True)
            moves += move * ((ahead[t - 1] * live[t] / z).T @ x)
        y /= y.sum(axis=1, keepdims=True)
        back = np.where(live[t], y, 1.0) if padded else y
    post /= post.sum(axis=2, keepdims=True)
    return np.where(live, post, 0.0) if padded else post


def label_texts(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean word posteriors (texts by labels), and each text's word count."""
    mean, count = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK):
            size += len(texts[to] or "")
            to += 1
        words = read_words(texts[at:to])
        emit, n = model.emissions(words), words.per_text
        ends = np.cumsum(n)
        count[at:to] = n
        room = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        for width in np.unique(room[n > 0]).tolist():
            some = np.flatnonzero((room == width) & (n > 0))
            longest = int(n[some].max())
            source = np.minimum((ends[some] - n[some])[None, :] + np.arange(longest)[:, None], ends[some][None, :] - 1)
            post = forward_backward(emit[source], model.start, model.step, n[some])
            mean[at + some] = post.sum(axis=0) / n[some, None]
        at = to
    return mean, count


def fit(texts: list[str], langs: list[str], chain: int = 64, rounds: int = 15, rate: float = 0.3, seed: int = 13, least: int = 3) -> LanguageModel:
    """Fit on labelled texts: count-based weights first, then rounds of gradient on chains spliced from different texts.

    Half of the chains switch to another text, of any language, at random places, so transitions are learned from
    code-switched text. The lexicon holds words seen ``least`` times.
    """
    labels = sorted(set(langs)) or [UNDECIDED]
    k, size, draw = len(labels), 1 << BITS, np.random.default_rng(seed)
    words = read_words(texts)
    truth = np.repeat(np.array([labels.index(x) for x in langs], np.int64), words.per_text) if texts else np.zeros(0, np.int64)
    n = len(truth)
    of_window = np.repeat(np.arange(n), np.diff(np.append(words.first_window, len(words.windows)))) if n else np.zeros(0, np.int64)
    distinct, seen_times = np.unique(words.whole, return_counts=True)
    lexicon = distinct[seen_times >= least]
    held = _places(lexicon, words.whole)

    def spread(per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = [[], [], []]
        for j in range(k):
            w = per_word[:, j]
            columns[0].append(np.bincount(words.windows, w[of_window], size))
            columns[1].append(np.bincount(words.affixes[:, 0], w, size) + np.bincount(words.affixes[:, 1], w, size))
            columns[2].append(np.append(np.bincount(held, w, len(lexicon) + 1)[: len(lexicon)], 0.0))
        return tuple(np.stack(x, axis=1) for x in columns)

    eye = np.eye(k)
    counts = spread(eye[truth])
    weights = []
    for c in counts:
        seen = np.log((c + 0.1) / (c.sum(axis=0) + 0.1 * len(c)))
        weights.append(0.3 * (seen - seen.mean(axis=1, keepdims=True)) * (c.sum(axis=1, keepdims=True) > 0))
    start, step = np.zeros(k), 3.0 * eye
    window, affix, word = (w.astype(np.float32) for w in weights)
    model = LanguageModel(labels, window, affix, lexicon, word, start, step)
    if n < chain or k < 2:
        return model
    grads2 = [np.full_like(w, 1e-2, np.float64) for w in weights]
    step2, start2 = np.full((k, k), 1e-2), np.full(k, 1e-2)
    chains = n // chain
    for _ in range(rounds):
        origin = draw.integers(0, n - chain + 1, chains)
        index = origin[:, None] + np.arange(chain)
        switch = (draw.random((chains, chain)) < 0.06) & (draw.random(chains) < 0.5)[:, None]
        moved = np.maximum.accumulate(np.where(switch, np.arange(chain), 0), axis=1)  # since the last switch
        jump = draw.integers(0, n, (chains, chain))
        base = np.take_along_axis(jump, moved, axis=1)
        index = np.where(moved > 0, (base + np.arange(chain) - moved) % n, index)
        index = index.T
        gold, expected = truth[index], np.zeros((k, k))
        post = forward_backward(model.emissions(words)[index], start, step, np.full(chains, chain), expected)
        error = np.zeros((n, k))
        for j in range(k):
            error[:, j] = np.bincount(index.ravel(), ((gold == j) - post[:, :, j]).ravel(), n)
        for w, g, g2 in zip((model.window, model.affix, model.lexicon), spread(error), grads2):
            g -= 1e-2 * w
            g2 += g * g
            w += (rate * g / np.sqrt(g2)).astype(np.float32)
        pairs = np.zeros((k, k))
        np.add.at(pairs, (gold[:-1], gold[1:]), 1.0)
        g = (pairs - expected) / chains
        step2 += g * g
        step += rate * g / np.sqrt(step2)
        g = np.bincount(gold[0], minlength=k) / chains - post[0].mean(axis=0)
        start2 += g * g
        start += rate * g / np.sqrt(start2)
    return model


def train(docs: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 600, longest: int = 200_000, seed: int = 3) -> LanguageModel:
    """Fit on about ``most`` labelled texts of at most ``longest`` characters where ``may_train`` holds, drawn by a seeded
    hash of the id; so ``most`` times ``longest`` characters bound what reaches the driver. Rows without label, id or text
    are not used. Rows of one id are drawn together. Without rows the model knows no language but ``und``."""
    able = docs.select(id_col, text_col, lang_col).filter(may_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= longest))
    share = int((1 << 30) * min(1.0, most / max(1, able.count())))
    drawn = able.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < share)
    rows = drawn.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(id_col).alias("o")).toArrow().sort_by([("o", "ascending"), ("t", "ascending"), ("l", "ascending")])
    return fit(rows["t"].to_pylist(), rows["l"].to_pylist())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (mean posterior of that language).

    Null texts and texts without a letter (marks alone are none) get ``und`` and score 0. Whole texts of any length are
    read, in batches of about ``CHUNK`` characters or one text; of languages with equal posteriors the first by name
    wins; repeated rows are predicted alike; an empty table gives an empty result. Columns of ``docs`` named as a result
    are replaced, others keep their values whatever their names. The model is broadcast: its tables hold two times
    2^``BITS`` features and the lexicon of the bounded sample, times the languages. No shuffle.
    """
    spark = ship(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        own = held.value
        mean, count = label_texts(texts.to_pylist(), own)
        best = mean.argmax(axis=1) if mean.size else np.zeros(0, np.int64)
        names = [own.labels[b] if n else UNDECIDED for b, n in zip(best.tolist(), count.tolist())]
        scores = np.where(count > 0, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), 0.0) if len(best) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    rows, back = set_aside(docs, guess=guess(F.col(text_col)))
    return rows.select(*back("lang_pred", "score"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def word_languages(text: str | None, model: LanguageModel) -> list[str]:
    """The most likely language of every word of one text, in order."""
    words = read_words([text])
    emit = model.emissions(words)
    if not len(emit):
        return []
    post = forward_backward(emit[:, None], model.start, model.step, np.array([len(emit)]))[:, 0]
    return [model.labels[j] for j in post.argmax(axis=1).tolist()]
