"""Quality of texts by a generalised additive model with pairwise interactions.

The score is the logistic of an intercept, one lookup table per feature and one per chosen pair of features. The tables are
learned by cyclic boosting: in every round each feature in turn gets a tree of at most four leaves on its bins, fitted to what is
left of the log-loss gradient, and shrunk; pairs come after, on the residuals. Scoring bins the features and adds table cells.

Features describe the text alone: shares of kinds of signs, word lengths, repetition. An empty or null text has all features 0 and
is scored like any other. Labels that are null are ignored; without labels of both kinds every score is the (smoothed) share of
good labels. A text with several label rows counts once for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.arrow import append_columns, lists, slices, text_bytes
from reelmill.llm.store import stored
from reelmill.llm.words import WHITE, hash_words, word_spans

FEATURES = (
    "log_bytes upper digit bar bang stop symbol comma accent newline "
    "word_length word_length_spread distinct_words top_word repeats symbol_words line_length two_words"
).split()
#: Labelled rows that are brought to the driver to learn from, about; all if there are fewer.
SAMPLE_ROWS = 200_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1


def byte_class(signs: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[*signs.encode()]] = 1
    return table


UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_class("0123456789")
BAR, BANG, NEWLINE = byte_class("|"), byte_class("!"), byte_class("\n")
STOP, COMMA = byte_class(".?"), byte_class(",;:")
SYMBOL = byte_class("#$%&*+/<=>@\\^_`{|}~!")
ACCENT = np.zeros(256, np.uint8)
ACCENT[192:] = 1  # first bytes of longer UTF-8 signs


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    size = np.diff(offsets)
    full = size > 0
    if not full.any():
        return out

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return np.diff(total[offsets]) / np.maximum(of, 1)

    words, at = hash_words(data, offsets)
    count = np.diff(at)
    begin, end = word_spans(data, offsets)
    length = (end - begin).astype(np.float64)
    text = np.repeat(np.arange(n), count)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, n) / np.maximum(count, 1)

    average = mean(length)
    spread = np.sqrt(np.maximum(mean(length * length) - average**2, 0))
    order = np.lexsort((words, text))
    w, t = words[order], text[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    often = np.diff(np.append(starts, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, t[starts], often)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    marked = SYMBOL[data[end - 1]].astype(np.float64) if len(end) else np.zeros(0)
    pairs = words[:-1] * np.uint64(31) + words[1:] if len(words) > 1 else np.zeros(0, np.uint64)
    pt = text[:-1] if len(words) > 1 else text[:0]
    inside = pt == text[1:] if len(words) > 1 else np.zeros(0, bool)
    pairs, pt = pairs[inside], pt[inside]
    order = np.lexsort((pairs, pt))
    p, q = pairs[order], pt[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    columns = [
        np.log1p(size), share(UPPER, size), share(DIGIT, size), share(BAR, size), share(BANG, size), share(STOP, size),
        share(SYMBOL, size), share(COMMA, size), share(ACCENT, size), share(NEWLINE, size), average, spread,
        np.bincount(t, new, n) / np.maximum(count, 1), top / np.maximum(count, 1), mean(same), mean(marked),
        np.log1p(size / (share(NEWLINE, np.ones(n)) + 1)), np.bincount(q, fresh, n) / np.maximum(np.bincount(pt, minlength=n), 1),
    ]
    out[:] = np.stack(columns, axis=1)
    out[~full] = 0
    return out


def add_features(df: DataFrame, text: str = "text", features: str = "features") -> DataFrame:
    """``df`` with the array of features of its texts."""

    def work(texts: pa.Array) -> list[pa.Array]:
        f = text_features(texts)
        return [lists(f.ravel(), np.arange(len(f) + 1) * f.shape[1])]

    return append_columns(df, text, f"`{features}` array<float>", lambda: work)


@dataclass
class Model:
    """Lookup tables: ``tables[k][bin of feature k]``, ``pair_tables[m][bin of i, bin of j]``; ``edges`` separate the bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for pair in self.pairs for k in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal numbers of rows."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return np.nextafter(values, np.float32(np.inf)).astype(np.float32)


def leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
    """Leaf values by bin: greedily the best of the cuts of all present leaves, ``cuts`` times."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(cuts):
        best, at = 1e-9, None
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            lg, lh, rg, rh = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
            if gain.max() > best:
                best, at = gain.max(), int(m[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree with one cut of the first feature and one cut of the second in each half; its values and its gain."""
    value, gain = np.zeros_like(g), 0.0
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(1, g.shape[0]):
        found, parts = 0.0, []
        for a, b in ((0, i), (i, g.shape[0])):
            left_g, left_h = cg[b, 1:-1] - cg[a, 1:-1], ch[b, 1:-1] - ch[a, 1:-1]
            all_g, all_h = cg[b, -1] - cg[a, -1], ch[b, -1] - ch[a, -1]
            if not len(left_g):
                continue
            each = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
            j = int(each.argmax())
            found += each[j]
            parts.append((a, b, j + 1, leaf(left_g[j], left_h[j]), leaf(all_g - left_g[j], all_h - left_h[j])))
        if found > gain:
            gain, value = found, np.zeros_like(g)
            for a, b, j, low, high in parts:
                value[a:b, :j], value[a:b, j:] = low, high
    return value, gain - g.sum() ** 2 / (h.sum() + 1)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables from feature rows ``x`` and labels ``y`` (0 or 1)."""
    base = (y.sum() + 1.0) / (len(y) + 2.0)
    k = len(FEATURES)
    if not 0 < y.sum() < len(y):
        return Model(float(np.log(base / (1 - base))), [np.zeros(0, np.float32)] * k, [np.zeros(1)] * k, [], [], [])
    edges = [quantile_edges(x[:, i], BINS) for i in range(k)]
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), np.log(base / (1 - base)))

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = gradient()
            step = RATE * tree(np.bincount(bins[i], g, len(tables[i])), np.bincount(bins[i], h, len(tables[i])))
            tables[i] += step
            f += step[bins[i]]
    coarse = [quantile_edges(x[:, i], PAIR_BINS) for i in range(k)]
    cells = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    gains = sorted(((pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(k) for j in range(i)), reverse=True)
    pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for m, (i, j) in enumerate(pairs):
            g, h = gradient()
            step = RATE * pair_tree(grid(i, j, g), grid(i, j, h))[0]
            pair_tables[m] += step
            f += step[cells[i], cells[j]]
    return Model(float(np.log(base / (1 - base))), edges, tables, pairs, coarse, pair_tables)


def remainder(doc_id: str, by: int) -> F.Column:
    """crc32 of the id as text, modulo ``by``; of a null id, -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % by, F.lit(-1))


def learn(features: DataFrame, labels: DataFrame, doc_id: str, label: str) -> Model:
    """A model from the labelled rows outside the held-out fifth, about ``SAMPLE_ROWS`` of them at most (by the hash of the id)."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y"))
    rows = known.where(remainder("__id", 5) != 0)
    n = rows.count()
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_ROWS / n))
    got = features.select(F.col(doc_id).alias("__id"), "features").join(rows, "__id").select("__y", "features").toArrow()
    x = np.asarray(got.column("features").combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    y = (np.asarray(got.column("__y"), np.float64) > 0).astype(np.float64)
    order = np.lexsort((*x.T, y))  # the model doesn't depend on the order of the rows
    return fit(x[order], y[order])


def learned_model(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[DataFrame, Model]:
    """The features of all documents, written once to the shared folder, and the model learned from the labelled ones."""
    features = stored(add_features(docs.select(doc_id, text), text).select(doc_id, "features"), "features")
    return features, learn(features, labels, doc_id, label)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``. Rows are judged where they lie, so no text is shuffled."""
    _, model = learned_model(docs, labels, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                yield part.filter(pa.array(shared.value.score(text_features(texts)) >= cut))

    return docs.mapInArrow(judge, docs.schema)


def score_documents(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3
) -> DataFrame:
    """One row per document: its id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on).

    Features are computed once and kept in the shared checkpoint folder; the sample and the model (a few thousand numbers) are all
    that the driver sees.
    """
    features, model = learned_model(docs, labels, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            x = np.asarray(batch.column("features").flatten(), np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=[doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = features.mapInArrow(score, f"`{doc_id}` {kind}, score double")
    return scored.select(
        doc_id,
        (remainder(doc_id, 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
