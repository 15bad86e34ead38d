"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's embedding is the sum of rows of several hashed tables: two by the whole word,
so that words which share one bucket are still told apart, and others by its first
bytes, so that unseen forms of a known stem are told too. Filters of several widths
slide over a text's embeddings; the ``TOP`` largest responses of each filter anywhere
in the whole text go to a logistic layer. The first embedding component
starts as each bucket's log-odds in the training texts over its standard error; all
weights are then trained by Adam, until labelled rows that take no part in the training
fit no better. A language is inferred from a text's function words,
and the threshold that separates those rows best is found for each language;
scores are shifted so that every language's threshold is ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh
from .labelled import fold, sample, with_labels, within
from .words import as_utf8, hashes, mix, slices, split

FOLDS, HELD_OUT = 4, 2
#: Labelled rows and characters of each class in the fit, at most.
SAMPLE_PER_CLASS = 3000
SAMPLE_CHARS = 9_000_000
CUT = 0.3
BUCKETS = 1 << 16
#: The tables: leading bytes of a word that each hashes (0: all), and a salt.
TABLES = [(0, 71), (0, 73), (4, 79), (5, 83), (6, 89), (7, 97)]
DIMENSIONS = 8
#: Filters of each width in words.
WIDTHS = {1: 4, 2: 4, 3: 4}
#: Largest responses kept of each filter.
TOP = 3
EPOCHS = 12
#: One in so many labelled rows calibrates: it ends the training, which goes on for PATIENCE
#: epochs without gain, and sets the thresholds.
CALIBRATION = 4
PATIENCE = 2
RATE = 0.02
#: Texts of each class that a language needs for a threshold of its own.
LANGUAGE_ROWS = 20

# Frequent function words, by which a text's language is inferred.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "mit", "den", "von"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "qui", "pour", "pas"],
    "es": ["el", "los", "del", "y", "con", "por", "las", "una", "se", "al"],
}

_U = np.uint64
#: Bytes between words here: ASCII other than letters and digits.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


_FUNCTION_HASHES = [hashes(split(pa.array([" ".join(words)]))) for words in FUNCTION_WORDS.values()]


class Tokens(NamedTuple):
    """Buckets of the words of some texts, one row a table, and where each text's begin."""

    ids: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    language: np.ndarray


def tokens(texts: pa.Array, a: int, b: int) -> Tokens:
    w = split(texts, a, b, lower=True, breaks=_BREAKS)
    h = hashes(w)
    votes = np.stack([np.bincount(w.doc, np.isin(h, own), b - a) for own in _FUNCTION_HASHES])
    language = np.where(votes.max(axis=0) > 0, votes.argmax(axis=0), -1)
    by_size = {size: hashes(w._replace(end=np.minimum(w.end, w.start + size))) if size else h for size, _ in TABLES}
    ids = np.stack([(mix(by_size[size], salt) % _U(BUCKETS)).astype(np.int32) for size, salt in TABLES])
    return Tokens(ids, w.first, w.doc, language)


class Net(NamedTuple):
    tables: np.ndarray  # TABLES x BUCKETS x DIMENSIONS
    filters: dict[int, np.ndarray]  # by width: width x DIMENSIONS x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray  # raw threshold by language; the last for none
    slope: float

    def raw(self, t: Tokens) -> np.ndarray:
        return _pool(t.ids, t.first, t.doc, self)[0].reshape(len(t.first) - 1, -1) @ self.out + self.out_bias

    def score(self, t: Tokens) -> np.ndarray:
        z = self.slope * (self.raw(t) - self.cuts[t.language]) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pool(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, net: Net, where: bool = False):
    """Each text's rectified largest responses, rows x filters x TOP, the embeddings, and
    (if asked for) the words that the responses start at, -1 where there is none."""
    x = sum(table[i] for table, i in zip(net.tables, ids, strict=True))
    n, rows, done, total = len(x), len(first) - 1, 0, len(net.bias)
    y = np.full((n, total), -np.inf, np.float32)
    for width, f in net.filters.items():
        m, own = n - width + 1, slice(done, done + f.shape[2])
        if m > 0:
            y[:m, own] = sum(x[k : k + m] @ f[k] for k in range(width)) + net.bias[own]
            if width > 1:
                y[:m, own][doc[:m] != doc[width - 1 :]] = -np.inf
        done += f.shape[2]
    pooled = np.zeros((rows, total, TOP), np.float32)
    places = np.full((rows, total, TOP), -1)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        k = min(TOP, b - a)
        if not k:
            continue
        if where:
            at = np.argpartition(y[a:b], b - a - k, axis=0)[b - a - k :]
            top = np.take_along_axis(y[a:b], at, axis=0)
            order = np.argsort(-top, axis=0, kind="stable")
            top, at = np.take_along_axis(top, order, axis=0), np.take_along_axis(at, order, axis=0)
            places[r, :, :k] = np.where(top > 0, at + a, -1).T
        else:
            top = -np.sort(-np.partition(y[a:b], b - a - k, axis=0)[b - a - k :], axis=0)
        pooled[r, :, :k] = np.maximum(top, 0).T
    return pooled, x, places


def _start(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Tables whose first component is a share of each bucket's standardised log-odds in the
    words that ``mine`` marks."""
    doc = doc[mine]
    tables = np.random.default_rng(11).normal(0, 0.01, (len(TABLES), BUCKETS, DIMENSIONS)).astype(np.float32)
    clean, bad = (y == 0).sum(), (y == 1).sum()
    for table, bucket in zip(tables, ids, strict=True):
        d, b = np.divmod(np.unique(doc * BUCKETS + bucket[mine].astype(np.int64)), BUCKETS)
        a, c = np.bincount(b, y[d] == 1, BUCKETS), np.bincount(b, y[d] == 0, BUCKETS)
        odds = np.log((a + 0.5) / (bad - a + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5))
        table[:, 0] = np.where(a + c > 0, odds / np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) / (2 * len(TABLES)), 0)
    return tables


def fit(parts: list[Tokens], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Net | None:
    """Train on texts given as parts; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    first = [np.zeros(1, np.int64)]
    for p in parts:
        first.append(p.first[1:] + first[-1][-1])
    first = np.concatenate(first)
    ids = np.concatenate([p.ids.astype(np.uint16) for p in parts], axis=1)
    language = np.concatenate([p.language for p in parts])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts.clear()  # their arrays are in ids now; the fit's memory is bounded by the sample
    rng = np.random.default_rng(seed)
    held = _calibration(y)
    learn = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    learned = np.isin(np.arange(len(y)), learn)
    mine = np.repeat(learned, np.diff(first))
    tables = _start(ids, doc, np.where(learned, y, -1), mine)
    filters = {}
    for width, count in WIDTHS.items():
        f = rng.normal(0, 0.1, (width, DIMENSIONS, count)).astype(np.float32)
        f[0, 0] = 1
        filters[width] = f
    total = sum(WIDTHS.values())
    net = Net(tables, filters, np.full(total, -0.5, np.float32), np.full(total * TOP, 0.1, np.float32), 0.0, np.zeros(len(FUNCTION_WORDS) + 1), 1.0)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    bias, out, out_bias = net.bias, net.out, np.zeros(1, np.float32)
    params = {"bias": bias, "out": out, "out_bias": out_bias, **{f"f{w}": f for w, f in filters.items()}}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    squares = np.zeros((len(TABLES), BUCKETS), np.float32)
    step, best, worse = 0, (np.inf, None), 0
    for _ in range(epochs):
        order = learn[rng.permutation(len(learn))]
        for batch in np.array_split(order, max(1, len(order) // 128)):
            step += 1
            sizes = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            f0 = np.concatenate(([0], np.cumsum(sizes)))
            d0 = np.repeat(np.arange(len(batch)), sizes)
            some = ids[:, at].astype(np.int64)
            now = net._replace(out_bias=float(out_bias[0]))
            pooled, x, places = _pool(some, f0, d0, now, where=True)
            flat = pooled.reshape(len(batch), -1)
            p = 1 / (1 + np.exp(-np.clip(flat @ out + out_bias[0], -40, 40)))
            g = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads = {"out": flat.T @ g, "out_bias": np.array([g.sum()], np.float32), "bias": np.zeros_like(bias)}
            up, col = (g[:, None] * out).reshape(pooled.shape), 0
            dx_at, dx = [], []
            for width, f in filters.items():
                df = np.zeros_like(f)
                for j in range(f.shape[2]):
                    r, t = np.nonzero(places[:, col] >= 0)
                    if len(r):
                        u, at = up[r, col, t], places[r, col, t]
                        grads["bias"][col] = u.sum()
                        for k in range(width):
                            df[k, :, j] = u @ x[at + k]
                            dx_at.append(at + k)
                            dx.append(u[:, None] * f[k, :, j])
                    col += 1
                grads[f"f{width}"] = df
            for k, v in params.items():
                m, s = state[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            if dx_at:
                w, dv = np.concatenate(dx_at), np.concatenate(dx)
                for table, bucket, sq in zip(tables, some, squares, strict=True):
                    np.add.at(sq, bucket[w], (dv**2).mean(axis=1))
                    np.add.at(table, bucket[w], -RATE * dv / (np.sqrt(sq[bucket[w]])[:, None] + 1e-6) * 0.2)
        # the weights that the calibration rows fit best are kept
        now = net._replace(out_bias=float(out_bias[0]))
        raw = _raw(now, ids, first, np.flatnonzero(held))
        loss = float((weight[held] * np.logaddexp(0, np.where(y[held] == 1, -raw, raw))).mean())
        if loss < best[0]:
            best, worse = (loss, (now._replace(tables=tables.copy(), filters={w: f.copy() for w, f in filters.items()}, bias=bias.copy(), out=out.copy()), raw)), 0
        else:
            worse += 1
        if worse == PATIENCE:
            break
    net, raw = best[1]
    return net._replace(cuts=_cuts(raw, y[held], language[held]), slope=_slope(raw, y[held]))


def _calibration(y: np.ndarray) -> np.ndarray:
    """One in CALIBRATION rows of each class, the least at once: no weight is fitted on them."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::CALIBRATION]] = True
        if held[y == c].all():  # a lone row of a class is learned from too
            return np.ones(len(y), bool)
    return held


def _raw(net: Net, ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    one = lambda a, b: net.raw(Tokens(ids[:, a:b], np.array([0, b - a]), np.zeros(b - a, np.int64), np.zeros(1, np.int64)))
    return np.concatenate([one(first[r], first[r + 1]) for r in rows])


def _cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among thresholds with the best F1."""
    order = np.argsort(raw)
    s, t = raw[order], y[order]
    bad = t.sum()
    hit = bad - np.concatenate(([0], np.cumsum(t)))[:-1]
    f1 = 2 * hit / (np.arange(len(s), 0, -1) + bad)
    gap = s - np.concatenate(([s[0] - 1], s[:-1]))
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(s[k] - gap[k] / 2)


def _cuts(raw: np.ndarray, y: np.ndarray, language: np.ndarray) -> np.ndarray:
    out = np.full(len(FUNCTION_WORDS) + 1, _cut(raw, y))
    for k in range(len(FUNCTION_WORDS)):
        own = language == k
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LANGUAGE_ROWS:
            out[k] = _cut(raw[own], y[own])
    return out


def _slope(raw: np.ndarray, y: np.ndarray) -> float:
    return float(8 / max(raw[y == 1].mean() - raw[y == 0].mean(), 1e-3))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Net | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    chosen, _ = sample(labels, id_col, label_col, fold(id_col, FOLDS) != HELD_OUT, per_class)
    chosen = within(docs, chosen, id_col, text_col, SAMPLE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1))
            for a, b in slices(texts):
                t = tokens(texts, a, b)
                packed = np.ascontiguousarray(t.ids.T.astype(np.uint16))
                cells = [packed[i:j].tobytes() for i, j in zip(t.first[:-1], t.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cells, pa.binary()), pa.array(t.language)], names=["y", "cells", "language"])

    got = with_labels(docs, chosen, id_col, text_col).mapInArrow(run, "y int, cells binary, language long").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["cells"])))
    parts, y = [], np.array([r["y"] for r in got])
    for r in got:
        ids = np.frombuffer(bytes(r["cells"]), np.uint16).reshape(-1, len(TABLES)).T
        n = ids.shape[1]
        parts.append(Tokens(ids, np.array([0, n]), np.zeros(n, np.int64), np.array([r["language"]])))
    del got
    return fit(parts, y) if parts else None


def score(docs: DataFrame, model: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row from its text alone; 0.5 for all without a model.

    Null and empty texts get the score of a text without words; null and repeated ids
    are rows like any other; an empty table gives no rows; other columns are ignored.
    The model is a few megabytes whatever the corpus, so it is broadcast.
    """
    fresh(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(tuple(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(*shared.value) if shared.value else None
        for batch in batches:
            texts = as_utf8(batch.column(1))
            s = [net.score(tokens(texts, a, b)) if net else np.full(b - a, 0.5) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
