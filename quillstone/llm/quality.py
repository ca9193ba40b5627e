"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes ``FEATURES`` numbers by vectorised passes over its bytes and words.  Cyclic boosting visits the
features in turn, each time fitting a tree of three leaves to the gradient's histogram and adding it to that feature's
lookup table; then the pairs of features with the most left to explain are boosted with four-leaf trees over two
features.  A document's score is the logistic of the sum of its bins' entries.

Training takes at most ``max_rows`` labelled rows (chosen by hash of doc_id), the only bound here; every document is
scored, in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.scratch import fresh
from ._text import U, Spans, words

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "other", "symbol_ends", "distinct_words", "repeated_grams", "words_a_line", "stops", "capitals")
MAX_ROWS, BINS, ROUNDS, PAIRS, RATE, LEAST = 20_000, 32, 120, 6, 0.15, 0.5


def _lut(*classes: str | range) -> np.ndarray:
    """A byte table with one count in the low and one in the high half."""
    out = np.zeros(256, np.uint64)
    for k, c in enumerate(classes):
        out[[ord(x) if isinstance(x, str) else x for x in c]] |= U(1) << U(32 * k)
    return out


_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
_SYMBOLS = "#$%&*@^~<>{}[]=+_\\/"
_TABLES = [_lut(_LETTERS, range(65, 91)), _lut("0123456789", _SYMBOLS), _lut("!", "|"), _lut("\n", ".?")]
_SYMBOL_END = np.zeros(256, bool)
_SYMBOL_END[[ord(x) for x in _SYMBOLS + "!|"]] = True


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes (44 bits of them) of each document."""
    key = np.sort((doc.astype(np.uint64) << U(44)) | (h >> U(20)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> U(44)).astype(np.int64), minlength=n)[:n]


def features(texts: pa.Array) -> np.ndarray:
    """(rows, len(FEATURES)) float32; a null or word-less text is all zeros."""
    parts = []
    for w in words(texts):
        n = w.hi - w.lo
        count = np.diff(w.first).astype(float)
        sums = []
        for t in _TABLES:
            total = np.concatenate([[U(0)], np.cumsum(t[w.data])])
            got = np.diff(total[w.at])
            sums += [(got & U(0xFFFFFFFF)).astype(float), (got >> U(32)).astype(float)]
        letters, upper, digits, symbols, bangs, pipes, lines, stops = sums
        doc = w.doc
        size = np.bincount(doc, w.end - w.start, n)
        some, solid = np.maximum(count, 1), np.maximum(size, 1)
        bad = np.bincount(doc, _SYMBOL_END[w.data[w.end - 1]], n) if len(doc) else np.zeros(n)
        first = w.data[w.start] if len(doc) else np.zeros(0, np.uint8)
        caps = np.bincount(doc, (first >= 65) & (first <= 90), n)
        grams = Spans(w.hash).grams(4)
        inside = np.arange(len(grams)) + 4 <= np.repeat(w.first[1:], np.diff(w.first))[: len(grams)]
        gdoc = doc[: len(grams)][inside]
        gcount = np.bincount(gdoc, minlength=n)
        again = 1 - _distinct(grams[inside], gdoc, n) / np.maximum(gcount, 1)
        again[gcount == 0] = 0
        x = np.stack([np.log1p(count), size / some, upper / np.maximum(letters, 1), digits / solid, symbols / solid, bangs / solid, pipes / solid, 1 - (letters + digits) / solid, bad / some, _distinct(w.hash, doc, n) / some, again, np.log1p(count / (lines + 1)), stops / some, caps / some], 1)
        x[count == 0] = 0
        parts.append(x.astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Gam:
    """Cut points of each feature, its table, and the tables of pairs."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[f]]
        for (f, g), t in self.pairs.items():
            z += t[b[f], b[g]]
        return 1 / (1 + np.exp(-z))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree of up to ``leaves`` leaves over one feature's histogram."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, i = max((*_best(g[lo:hi], h[lo:hi]), i) for i, (lo, hi) in enumerate(parts))
        if gain <= 1e-9:
            break
        lo, hi = parts[i]
        parts[i : i + 1] = [(lo, lo + k), (lo + k, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one axis and then each half on the other."""
    best = (0.0, np.zeros_like(g))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a), max(1, len(a) // 8)):
            gain, out = -_gain(g.sum(), h.sum()), np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, None)):
                x, y = a[rows].sum(0), b[rows].sum(0)
                v = _tree(x, y, 2)
                gain += sum(_gain(x[v == u].sum(), y[v == u].sum()) for u in np.unique(v))
                out[rows] = v
            if gain > best[0]:
                best = (float(gain), out if axis == 0 else out.T)
    return best


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """Fit on features and 0/1 labels.  With one class only, or no rows, every score is 0.5 or the class."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Gam(0.0 if not len(y) else 4.0 * (2 * share - 1), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    cuts = [np.unique(np.quantile(x[:, f].astype(float), np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    m = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    b, z = m.bins(x), np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(m.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[f], g, len(t)), np.bincount(b[f], h, len(t)))
            t += step
            z += step[b[f]]

    def square(f: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(m.tables[f]), len(m.tables[k])
        at = b[f] * shape[1] + b[k]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-_pair_tree(*square(f, k, g, h))[0], f, k) for f in range(x.shape[1]) for k in range(f)))
    m.pairs = {(f, k): np.zeros((len(m.tables[f]), len(m.tables[k]))) for _, f, k in ranked[:pairs]}
    for _ in range(rounds // 6):
        for (f, k), t in m.pairs.items():
            step = RATE * _pair_tree(*square(f, k, *slopes()))[1]
            t += step
            z += step[b[f], b[k]]
    return m


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Train on documents that ``labels`` (doc_id, quality) covers, at most ``max_rows`` rows by least hash of doc_id, of the
    labels and of the documents that join with them.
    Rows with a null id (or one that is no integer) or label are left out; a document with several labels counts with each."""
    known = labels.select(F.col("doc_id").try_cast("bigint").alias("k"), F.col("quality").cast("double").alias("y")).where("k is not null and y is not null")
    chosen = known.orderBy(F.xxhash64("k"), "k", "y").limit(max_rows)
    text = docs.select(F.col(f"`{id_col}`").try_cast("bigint").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2)).astype(float)), pa.list_(pa.float64()))], ["k", "y", "x"])

    rows = text.join(F.broadcast(chosen), "k").select("k", "y", "t").mapInArrow(measured, "k bigint, y double, x array<double>").orderBy(F.xxhash64("k"), "k", "y", "x").limit(max_rows).toPandas().sort_values(["k", "y"], kind="stable")
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)).astype(np.float32)
    return train(x, (rows["y"].to_numpy() >= 0.5).astype(float))


def scorer(model: Gam):
    return arrow_udf(lambda t: pa.array(model.score(features(t)), pa.float64()), "double")


def classify(docs: DataFrame, model: Gam, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) of every row of ``docs``; keep is 1 where the score is ``least`` or more.

    Defined cases: a null, empty or word-less text is scored like any other, on features that are all zero; ids may be
    null or repeated; other columns are ignored whatever their names; an empty table gives no rows."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(b.column(1))), pa.float64())], ["doc_id", "score"])

    src = src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, score double")  # no text waits in the JVM for its score
    return src.select("doc_id", "score", (F.col("score") >= least).cast("int").alias("keep"))


def accepted(docs: DataFrame, model: Gam, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, scorer(model)(F.col(f"`{text_col}`").cast("string"))).where(F.col(score) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
