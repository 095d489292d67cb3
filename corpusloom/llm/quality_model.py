"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Round after round, one shallow tree per feature is fitted to the
gradient and added, with a small step, to the feature's lookup table; then the pairs of features with the greatest
remaining gain get two-dimensional tables in the same way. A score is the sum of one table entry per feature and
pair, through the logistic function, for all rows at once.

The model is fitted on at most `Options.sample` labelled rows, chosen by a hash of the id. Every whole text is scored.

Defined results: null and empty texts have all features 0 and get a score like any other; ties and repeated rows are
scored alike; without labelled rows, or with one class only, the score is the (smoothed) share of label 1; an empty
table gives an empty result; other columns are ignored by `score_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.kernels import Slice, mix, slices
from corpusloom.llm.labels import chosen, held_out, sample_ids
from corpusloom.runtime import ship, table


@dataclass(frozen=True)
class Options:
    sample: int = 20_000
    bins: int = 32
    rounds: int = 200
    step: float = 0.1
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 60


def _mask(chars: str | bytes | range) -> np.ndarray:
    t = np.zeros(256, dtype=np.int32)
    t[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return t


#: Classes of bytes.
CLASSES = {
    "lower": _mask(range(97, 123)),
    "upper": _mask(range(65, 91)),
    "digit": _mask(range(48, 58)),
    "white": _mask(" \t\n\x0b\x0c\r"),
    "line": _mask("\n"),
    "stop": _mask(".,;:?'\"()-"),
    "bang": _mask("!"),
    "bar": _mask("|"),
    "symbol": _mask("#*$%&<>@^~=+_\\/{}[]`"),
    "high": _mask(range(128, 192)),
}
FEATURES = [*CLASSES, "log_words", "word_length", "distinct_words", "same_neighbour", "repeated_runs", "distinct_lines", "short_words", "long_words"]


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each of n groups; groups ascend."""
    if not len(value):
        return np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n).astype(float)


def slice_features(part: Slice) -> np.ndarray:
    """A row of features for each text of a slice."""
    part.words()
    h = part.hash_words()
    n, words = part.count, part.n_words.astype(float)
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(part.offsets), 1)
    columns = []
    for t in CLASSES.values():
        total = np.concatenate([[0], np.cumsum(t[part.data], dtype=np.int64)])
        columns.append((total[part.offsets[1:]] - total[part.offsets[:-1]]) / size)
    lengths = part.ends - part.starts
    doc = np.repeat(np.arange(n), part.n_words)
    sums = lambda x: np.bincount(doc, weights=x, minlength=n)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    runs = part.runs(3)
    inside = part.inside(3)
    run_doc = doc[: len(runs)][inside]
    run_count = np.maximum(np.bincount(run_doc, minlength=n), 1)
    # a line's hash: its words in their order
    breaks = np.concatenate([[0], np.cumsum(CLASSES["line"][part.data], dtype=np.int64)])
    line = breaks[part.starts] if len(h) else np.zeros(0, dtype=np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) if len(h) else np.zeros(0, dtype=np.int64)
    line_hash = np.add.reduceat(mix(h + place.astype(np.uint64)), at) if len(at) else np.zeros(0, dtype=np.uint64)
    lines = np.maximum(np.bincount(doc[at], minlength=n), 1)
    columns += [
        np.log1p(words),
        sums(lengths) / some,
        _distinct(doc, h, n) / some ** 0.9,
        sums(same) / some,
        1 - _distinct(run_doc, runs[inside], n) / run_count,
        _distinct(doc[at], line_hash, n) / lines,
        sums(lengths <= 3) / some,
        sums(lengths >= 12) / some,
    ]
    return np.nan_to_num(np.column_stack(columns)).astype(np.float32)


def features(column) -> np.ndarray:
    found = [slice_features(p) for p in slices(column)]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)), dtype=np.float32)


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), values in zip(self.pairs, self.pair_tables):
                total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut an ordered histogram in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of depth two."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h)
    for a, b in ((0, cut), (cut, len(g))):
        if a == b:
            continue
        gain, inner = _best_cut(g[a:b], h[a:b])
        for c, d in ((a, a + inner), (a + inner, b)) if gain > 0 else ((a, b),):
            if c < d:
                out[c:d] = _leaf(g[c:d].sum(), h[c:d].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross cut of a two-dimensional histogram: its gain and leaf values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    rows, cols = g.shape
    best, cut = 0.0, None
    whole = _gain(g.sum(), h.sum())
    for r in range(1, rows):
        c = np.arange(1, cols)
        quarter = [(s[r, c], s[r, -1] - s[r, c], s[-1, c] - s[r, c], s[-1, -1] - s[r, -1] - s[-1, c] + s[r, c]) for s in (cg, ch)]
        gain = sum(_gain(quarter[0][k], quarter[1][k]) for k in range(4)) - whole
        if len(gain) and gain.max() > best:
            best, cut = float(gain.max()), (r, int(np.argmax(gain)) + 1)
    out = np.zeros_like(g)
    if cut:
        r, c = cut
        for s in ((slice(0, r), slice(0, c)), (slice(0, r), slice(c, None)), (slice(r, None), slice(0, c)), (slice(r, None), slice(c, None))):
            out[s] = _leaf(g[s].sum(), h[s].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray, options: Options = Options()) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(x[:, j], options.bins) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    p = 1 / (1 + np.exp(-total))
    for _ in range(options.rounds):
        for j, b in enumerate(binned):
            size = len(model.tables[j])
            update = options.step * _shallow_tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size))
            model.tables[j] += update
            total += update[b]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    model.pair_edges = [_edges(x[:, j], options.pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        return tuple(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    gains = sorted(((_pair_tree(*grids(a, b))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[: options.pairs]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(options.pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            update = options.step * _pair_tree(*grids(a, b))[1]
            model.pair_tables[k] += update
            total += update[coarse[a], coarse[b]]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", options: Options = Options()) -> Model:
    """Fit on labelled rows that aren't held out: `labels` has doc_id and the target (0 or 1)."""
    ship(docs.sparkSession)
    usable = labels.filter(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = sample_ids(usable, options.sample)

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), type=pa.list_(pa.float32()))], names=["doc_id", "x"])

    key = docs.schema["doc_id"].dataType.simpleString()
    found = chosen(docs, ids).mapInArrow(run, f"doc_id {key}, x array<float>")
    truth = usable.groupBy("doc_id").agg(F.max(target).alias("y"))
    rows = found.join(truth, "doc_id").orderBy("doc_id").limit(options.sample).select("x", "y").toArrow()
    if not rows.num_rows:
        return Model()
    x = rows["x"].combine_chunks()
    return fit(np.asarray(x.flatten()).reshape(rows.num_rows, len(FEATURES)), rows["y"].to_numpy().astype(float), options)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
