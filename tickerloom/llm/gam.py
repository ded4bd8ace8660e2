"""Generalised additive quality model with pairwise interactions.

Each feature of a text is cut into bins by quantiles of the training rows.
Boosting goes round the features in turn; each step fits a tree of a few
leaves to the loss gradients of one feature's bins and adds it, shrunk, to
that feature's lookup table.  Then the pairs of features that explain most of
what is left get tables over two coarser bins each, boosted the same way.  A
text's score is the sum of its bins' entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, Words, chunks, sums
from tickerloom.llm.rules import text_counts
from tickerloom.session import pin

FEATURES = (
    "log_words", "word_chars", "symbols", "exclaimed", "piped", "upper", "digits", "dup_lines", "repeats", "distinct", "same_as_last", "line_words", "stops",
)
BARRED = ("doc_id", "lang", "source", "labels")  # never inputs of a score


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LETTER, DIGIT = _is(bytes(range(65, 91))), _is(bytes(range(65, 91)) + bytes(range(97, 123))), _is(b"0123456789")
# Upper case of the two-byte letters of Latin-1: second bytes 0x80 to 0x9E after 0xC3.
ENDS = _is(b".?;:")


def features(texts: Texts) -> np.ndarray:
    """One row of float features per text; an empty text gets zeros."""
    data, at = texts.data, texts.at
    base = text_counts(texts)
    words = Words(texts, lower=True)
    n = np.maximum(1, base["n_words"]).astype(float)
    chars = np.maximum(1, base["word_chars"]).astype(float)
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = np.maximum(1, sums(LETTER[data], at) + sums(data == 0xC3, at)).astype(float)
    owner = np.repeat(np.arange(texts.n), words.per_text)
    order = np.lexsort((words.key, owner))
    k, o = words.key[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=texts.n)
    again = np.zeros(len(words), bool)
    again[1:] = (words.key[1:] == words.key[:-1]) & (owner[1:] == owner[:-1])
    lines = sums(data == 10, at) + 1
    return np.column_stack([
        np.log1p(base["n_words"]), base["word_chars"] / n, base["n_symbols"] / chars, sums(data == 33, at) / n, sums(data == 124, at) / n,
        (sums(UPPER[data], at) + sums(accent, at)) / letters, sums(DIGIT[data], at) / chars, base["n_dup_lines"] / lines, base["n_repeat_words"] / n,
        # Distinct words grow slower than words, so they are set against a power of their number.
        distinct / n**0.85, np.bincount(owner[again], minlength=texts.n) / n, np.log1p(base["n_words"] / lines), sums(ENDS[data], at) / n,
    ]).astype(np.float32)


@dataclass
class Model:
    """``edges[f]``: ascending cuts of feature f; ``tables[f]``: one entry per bin; ``pairs``: (f, g, cuts of f, cuts of g, table)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    known: bool = True  # whether it has seen labels of both classes

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (cuts, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for f, g, cf, cg, table in self.pairs:
            total += table[np.searchsorted(cf, x[:, f], side="right"), np.searchsorted(cg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of one row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree over a row of bins, grown best cut first."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        found = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A cut of the first feature, then one of the second on either side; its gain and Newton steps."""
    best, step = 0.0, np.zeros_like(g)
    for at in range(1, g.shape[0]):
        gain, now = -(g.sum() ** 2) / (h.sum() + ridge), np.zeros_like(g)
        for rows in (slice(0, at), slice(at, None)):
            gr, hr = g[rows].sum(0), h[rows].sum(0)
            gained, cut = _best_cut(gr, hr, ridge)
            gain += gained + gr.sum() ** 2 / (hr.sum() + ridge)
            for columns in (slice(0, cut), slice(cut, None)) if gained > 0 else (slice(None),):
                now[rows, columns] = -gr[columns].sum() / (hr[columns].sum() + ridge)
        if gain > best:
            best, step = float(gain), now
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, leaves: int = 3, rate: float = 0.1, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 1.0) -> Model:
    """Cyclic boosting of single features, then of the ``n_pairs`` strongest pairs.  Rows of one class (or none) give a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    n_features = x.shape[1]
    model.edges = [_cuts(x[:, f], bins) for f in range(n_features)]
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    if not len(y) or y.min() == y.max():
        model.known = False
        return model
    binned = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(n_features)]
    total = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size), leaves, ridge)
            model.tables[f] += step
            total += step[binned[f]]

    coarse = [_cuts(x[:, f], pair_bins) for f in range(n_features)]
    places = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(n_features)]

    def grid(f, k, values):
        a, b = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(places[f] * b + places[k], values, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((-_pair_tree(grid(f, k, g), grid(f, k, h), ridge)[0], f, k) for f, k in combinations(range(n_features), 2)))
    chosen = [(f, k, np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))) for gain, f, k in ranked[:n_pairs] if gain < 0]
    for _ in range(pair_rounds):
        for f, k, table in chosen:
            g, h = slopes()
            step = rate * _pair_tree(grid(f, k, g), grid(f, k, h), ridge)[1]
            table += step
            total += step[places[f], places[k]]
    model.pairs = [(f, k, coarse[f], coarse[k], table) for f, k, table in chosen]
    return model


def feature_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the features of every whole text as columns of floats."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_body"))
    schema = source.select(*keep, *[F.lit(0).cast("float").alias(f) for f in FEATURES]).schema

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_body"):
                x = features(Texts(part.column("_body")))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x[:, f]) for f in range(x.shape[1])], names=[*keep, *FEATURES])

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(table: DataFrame, labels: DataFrame, target: str = "quality", most_rows: int = 20_000) -> Model:
    """Model from the labelled rows of ``table``; at most ``most_rows`` of them, chosen by a hash of the id, come to the driver."""
    known = labels.select(F.col("doc_id"), F.col(target).cast("double").alias("_y")).filter(~held_out()).filter("_y IN (0, 1) AND doc_id IS NOT NULL").distinct()
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "_y").limit(most_rows)
    rows = table.join(picked, "doc_id").select("doc_id", "_y", *FEATURES).distinct()
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "_y", *FEATURES).limit(most_rows).toArrow()
    # One order whatever order the rows came in, so that reruns agree to the last bit.
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES]).astype(float)
    y = rows.column("_y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score_table(table: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of each row of a feature table."""
    schema = table.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).astype(float)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(x))], names=[*keep, "score"])

    return table.select(*keep, *FEATURES).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.7, most_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only the text is an input of the score.  Null and empty texts are scored
    like any other (all features zero); repeated rows get equal scores; with
    no usable labels every score is one half; an empty table gives no rows;
    other columns, also those named like a feature, are not looked at.
    """
    table = pin(feature_table(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]))
    model = train(table, labels, most_rows=most_rows)
    scored = score_table(table, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.7, most_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts good, with all their columns.

    Features are worked out twice, for training and in the filter, so that no
    text moves.  A model that has not seen labels of both classes drops nothing.
    """
    model = train(pin(feature_table(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])), labels, most_rows=most_rows)

    if not model.known:
        return docs

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                good = model.score(features(Texts(part.column(text))).astype(float)) >= limit
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
