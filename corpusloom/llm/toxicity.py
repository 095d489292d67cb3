"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts of the training folds, whatever their label, are unlabelled.
A text is the set of its hashed words and word beginnings. Features are the commonest ones by frequency (the shares of
positives and of unlabelled texts that have them, added up), without those that most unlabelled texts have. A linear
model with signed weights that begin at zero is trained in numpy on the risk
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]) with the logistic loss and a lasso; where the second
term falls below zero its gradient is reversed, so that the model can't gain by overfitting the unlabelled rows.

The prior is estimated from positives and unlabelled texts, not from labels: three models, each fitted on two thirds of
both, give scores to the third they have not seen, and the least ratio of the unlabelled share to the positive share
above any score, with a bound for chance, is the prior. Where it differs from the one assumed, the three models are fitted
anew with it. The same scores give the cut that best weighs positives caught against negatives flagged (`false_alarm` times). The model is the mean of the three, moved so that the cut lies at the threshold. Below
`least_for_estimate` texts on either side there is one model, with the prior that was given, at its own cut.

Each of the three models is fitted by a task of its own from the sampled sets of features, which are broadcast: numbers
of two or four bytes each, no more than sampled texts times `max_features`. An unlabelled text may be one of the positives.

The model is fitted on at most `Options.positives` and `Options.unlabelled` ids, chosen by a hash (repeated rows of one count as
often as they occur); of those only the chosen features (`max_features` at most) come to the driver. Every whole text is scored.

Defined results: null and empty texts have no features and get the score of the bias alone; rows with a null id are
scored and never learned from; ties and repeated rows are scored alike; without positives, or where no feature is common
enough among them, there is a warning and every score is near 0; an empty table gives an empty result;
`filter_documents` keeps the columns that came in.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.kernels import _BASE, _BYTE, _power_tables, Slice, mix, slices
from corpusloom.llm.labels import chosen, held_out, sample_ids
from corpusloom.runtime import settle, ship, table


@dataclass(frozen=True)
class Options:
    positives: int = 4_000
    unlabelled: int = 10_000
    buckets: int = 1 << 19
    beginnings: tuple[int, ...] = (4, 5, 6)
    max_features: int = 8_192
    #: Positives that must have a feature, and the largest share of unlabelled texts that may.
    min_count: int = 5
    max_share: float = 0.5
    steps: int = 300
    rate: float = 0.05
    #: Shrinking by a step of `rate`, for `lasso_positives` positives or more; with fewer it grows by the root.
    lasso: float = 0.1
    lasso_positives: int = 300
    #: The share of toxic texts among the unlabelled ones; None: estimated, from this start.
    prior: float | None = None
    start_prior: float = 0.1
    #: What a negative that is flagged costs, against a positive that is missed.
    false_alarm: float = 5.0
    #: Models, each fitted without its share of the texts; the result is their mean.
    folds: int = 3
    #: Positives that an estimate of the prior and the cut needs.
    least_for_estimate: int = 12
    threshold: float = 0.7


_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?'\"()[]{}<>#*$%&|-_")] = True


def slice_features(part: Slice, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word beginning of a slice; bytes A-Z are lower-cased already."""
    part.words()
    a, b = part.starts.copy(), part.ends.copy()
    for _ in range(4):  # punctuation at both ends of a word
        cut = (a < b) & _EDGE[part.data[np.minimum(a, len(part.data) - 1)]] if len(a) else np.zeros(0, dtype=bool)
        a[cut] += 1
        cut = (a < b) & _EDGE[part.data[np.maximum(b - 1, 0)]] if len(a) else cut
        b[cut] -= 1
    doc = np.repeat(np.arange(part.count), part.n_words)
    some = a < b
    a, b, doc = a[some], b[some], doc[some]
    up, down = _power_tables(_BASE, len(part.data) + 1)
    total = np.zeros(len(part.data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[part.data] * up[: len(part.data)], out=total[1:])
    docs, found = [doc], [mix((total[b] - total[a]) * down[a])]
    for k in options.beginnings:
        long = b - a > k
        s = a[long]
        docs.append(doc[long])
        found.append(mix((total[s + k] - total[s]) * down[s] + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(found) % np.uint64(options.buckets)).astype(np.int64)


@dataclass
class Model:
    options: Options
    weights: np.ndarray  # by bucket, zero for those not chosen
    bias: float
    prior: float | None = None

    def score(self, column) -> np.ndarray:
        out = []
        for part in slices(column, lower=True):
            doc, bucket = slice_features(part, self.options)
            on = self.weights[bucket] != 0
            # a text is a set: each feature counts once
            pairs = np.unique(doc[on] * self.options.buckets + bucket[on])
            total = np.bincount(pairs // self.options.buckets, self.weights[pairs % self.options.buckets], part.count)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Sets:
    """Texts as sets of features, one after the other: small numbers in one array."""

    flat: np.ndarray  # int32
    sizes: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Sets:
        flat = np.concatenate(sets).astype(np.int32) if sets else np.zeros(0, dtype=np.int32)
        return cls(flat, np.array([len(x) for x in sets], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.sizes)

    def pick(self, on: np.ndarray) -> Sets:
        return Sets(self.flat[np.repeat(on, self.sizes)], self.sizes[on])

    def columns(self, index: np.ndarray) -> Sets:
        """Features renumbered, those of number -1 left out."""
        new = index[self.flat]
        kept = new >= 0
        before = np.concatenate([[0], np.cumsum(kept)])
        ends = np.cumsum(self.sizes)
        return Sets(new[kept], before[ends] - before[ends - self.sizes])


class Rows:
    """Texts as rows of a sparse matrix of ones."""

    def __init__(self, sets: Sets | list[np.ndarray], columns: int):
        sets = sets if isinstance(sets, Sets) else Sets.of(sets)
        self.n, self.columns, self.c = len(sets), columns, sets.flat.astype(np.intp)
        self.full = np.flatnonzero(sets.sizes)
        self.starts = (np.cumsum(sets.sizes) - sets.sizes)[self.full]
        order = np.argsort(sets.flat, kind="stable")
        self.by_column = np.repeat(np.arange(self.n), sets.sizes)[order]
        self.held = np.empty(len(self.c))
        counts = np.bincount(self.c, minlength=columns)
        self.used = np.flatnonzero(counts)
        self.column_starts = (np.cumsum(counts) - counts)[self.used]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(np.take(w, self.c, out=self.held, mode="clip"), self.starts)
        return out

    def turned_times(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(self.columns)
        if len(self.used):
            out[self.used] = np.add.reduceat(np.take(a, self.by_column, out=self.held, mode="clip"), self.column_starts)
        return out


def risk(w: np.ndarray, bias: float, p: Rows, u: Rows, prior: float, corrected: bool = True) -> tuple[float, float, np.ndarray, float]:
    """(risk, its second term, gradient of the step for w and for the bias). With the second term below zero the step
    undoes what lowered it; `corrected=False` takes unlabelled texts for negatives."""
    zp, zu = p.times(w) + bias, u.times(w) + bias
    gp, gu = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    as_positive, as_negative, others = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
    second = others - prior * as_negative if corrected else others
    over_p, over_u = prior * (gp - 1) / p.n, gu / u.n
    if corrected and second >= 0:
        over_p = over_p - prior * gp / p.n
    elif corrected:
        over_p, over_u = prior * gp / p.n, -over_u
    return prior * as_positive + max(second, 0.0), second, p.turned_times(over_p) + u.turned_times(over_u), float(over_p.sum() + over_u.sum())


def descend(p: Rows, u: Rows, prior: float, options: Options, corrected: bool = True) -> tuple[np.ndarray, float]:
    """Weights from zero by Adam steps of falling size on the risk, each followed by the lasso's shrinking."""
    w, bias = np.zeros(p.columns), 0.0
    shrink = options.lasso * max(1.0, float(np.sqrt(options.lasso_positives / max(p.n, 1))))
    m, v = np.zeros(p.columns + 1), np.zeros(p.columns + 1)
    for step in range(1, options.steps + 1):
        _, _, over_w, over_bias = risk(w, bias, p, u, prior, corrected)
        grad = np.append(over_w, over_bias)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = options.rate * (1 - (step - 1) / options.steps)
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0.0)
    return w, float(bias)


def estimated_prior(zp: np.ndarray, zu: np.ndarray, chance: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from scores of both that the model was not fitted on."""
    cuts = np.sort(zp)
    in_p = 1 - np.arange(len(cuts)) / len(cuts)
    in_u = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    error = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(len(zu)) + 1 / np.sqrt(len(zp)))
    k = int(np.argmin((in_u + error) / in_p))
    return float(np.clip(in_u[k] / in_p[k], 0.005, 0.5))


def best_cut(zp: np.ndarray, zu: np.ndarray, prior: float, false_alarm: float) -> float:
    """A score from which on positives caught, less `false_alarm` times negatives flagged, are most: half-way between the
    highest such score of a positive and the next score below it."""
    cuts = np.unique(zp)[::-1]
    caught = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    flagged = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    least = min(prior, float((flagged / caught)[caught >= 0.2].min(initial=1.0)))  # so that no cut looks better than free of error
    wrong = np.maximum(flagged - least * caught, 0) / (1 - least)
    cut = cuts[np.argmax(caught - false_alarm * wrong)]
    below = max((z[z < cut].max() for z in (zp, zu) if (z < cut).any()), default=cut)
    return float((cut + below) / 2)


def common_buckets(positive: Sets, unlabelled: Sets, options: Options) -> np.ndarray:
    """The features: buckets by frequency."""
    in_p, in_u = (np.bincount(s.flat, minlength=options.buckets) for s in (positive, unlabelled))
    able = np.flatnonzero((in_p >= options.min_count) & (in_u <= options.max_share * len(unlabelled)))
    frequency = in_p[able] / len(positive) + in_u[able] / len(unlabelled)
    return able[np.argsort(-frequency, kind="stable")][: options.max_features]


@dataclass
class Training:
    """What a fold's model is fitted from: both sides as sets of column numbers, and the fold of each text."""

    positive: Sets
    unlabelled: Sets
    folds: tuple[np.ndarray, np.ndarray]
    columns: int
    options: Options
    corrected: bool

    def fold(self, k: int, prior: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Weights and bias learned without the texts of fold k, and the scores of both sides' texts in it."""
        sides = list(zip((self.positive, self.unlabelled), self.folds))
        w, bias = descend(*(Rows(s.pick(f != k), self.columns) for s, f in sides), prior, self.options, self.corrected)
        return w, bias, *(Rows(s.pick(f == k), self.columns).times(w) + bias for s, f in sides)


def _each_here(training: Training, jobs: list[tuple]) -> list[tuple]:
    return [training.fold(*job) for job in jobs]


def _each_in_tasks(spark):
    """Folds as tasks of one Spark job; weights and scores come back."""
    held: list = []

    def each(training: Training, jobs: list[tuple]) -> list[tuple]:
        if not held:
            held.append(spark.sparkContext.broadcast(training))
        sent = held[0]

        def run(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    w, bias, zp, zu = sent.value.fold(*jobs[k])
                    yield pa.RecordBatch.from_pydict({"k": [k], "bias": [bias], "w": [w], "zp": [zp], "zu": [zu]})

        found = spark.range(len(jobs), numPartitions=len(jobs)).mapInArrow(run, "k long, bias double, w array<double>, zp array<double>, zu array<double>").collect()
        return [(np.array(r["w"]), r["bias"], np.array(r["zp"]), np.array(r["zu"])) for r in sorted(found, key=lambda r: r["k"])]

    return each


def fit(
    positive: Sets | list[np.ndarray], unlabelled: Sets | list[np.ndarray], options: Options = Options(), chosen_buckets: np.ndarray | None = None, corrected: bool = True, each=_each_here
) -> Model:
    """From sets of buckets; texts are dealt out to the folds in the given order, and `each` fits the folds' models."""
    positive, unlabelled = (s if isinstance(s, Sets) else Sets.of(s) for s in (positive, unlabelled))
    empty = Model(options, np.zeros(options.buckets), -30.0)
    if not len(positive) or not len(unlabelled):
        warnings.warn("no positive or no unlabelled texts: no text will score as toxic", stacklevel=2)
        return empty
    able = common_buckets(positive, unlabelled, options) if chosen_buckets is None else chosen_buckets
    if not len(able):
        warnings.warn("no word is common enough among the positives: no text will score as toxic", stacklevel=2)
        return empty
    index = np.full(options.buckets, -1, dtype=np.int16 if len(able) < 1 << 15 else np.int32)
    index[able] = np.arange(len(able))
    positive, unlabelled = positive.columns(index), unlabelled.columns(index)
    prior = options.start_prior if options.prior is None else options.prior
    shift = 0.0
    if len(positive) >= options.least_for_estimate and len(unlabelled) >= options.least_for_estimate:
        folds = tuple(np.arange(len(s)) % options.folds for s in (positive, unlabelled))
        training = Training(positive, unlabelled, folds, len(able), options, corrected)
        models = each(training, [(k, prior) for k in range(options.folds)])
        pooled = lambda i: np.concatenate([m[i] for m in models])
        if options.prior is None:
            found = estimated_prior(pooled(2), pooled(3))
            if abs(found - prior) > 0.25 * prior:
                models = each(training, [(k, found) for k in range(options.folds)])
            prior = found
        w, bias = np.mean([m[0] for m in models], axis=0), float(np.mean([m[1] for m in models]))
        shift = float(np.log(options.threshold / (1 - options.threshold))) - best_cut(pooled(2), pooled(3), prior, options.false_alarm)
    else:
        w, bias = descend(Rows(positive, len(able)), Rows(unlabelled, len(able)), prior, options, corrected)
    bias += shift
    weights = np.zeros(options.buckets)
    weights[able] = w
    return Model(options, weights, float(bias), prior)


def _sample_sets(docs: DataFrame, wanted: list, options: Options) -> DataFrame:
    """(doc_id, x): the buckets of each wanted text."""

    def run(batches):
        for batch in batches:
            sets: list = []
            for part in slices(batch.column(1), lower=True):
                doc, bucket = slice_features(part, options)
                pairs = np.unique(doc * options.buckets + bucket)
                cuts = np.searchsorted(pairs // options.buckets, np.arange(part.count + 1))
                sets += [(pairs[i:j] % options.buckets).astype(np.int32) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.list_(pa.int32()))], names=["doc_id", "x"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return chosen(docs, wanted).mapInArrow(run, f"doc_id {key}, x array<int>")


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", options: Options = Options(), corrected: bool = True) -> Model:
    """The features of the sampled texts are counted in Spark; the driver gets those of the chosen columns alone."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    positive = sample_ids(usable.filter(F.col(target) == 1), options.positives)
    others = sample_ids(docs.filter(~held_out(F.col("doc_id"))), options.unlabelled)
    if not positive or not others:
        return fit([], [], options)
    ids = docs.select("doc_id").schema
    side = lambda found, name: F.broadcast(spark.createDataFrame([(i,) for i in found], ids)).withColumn(name, F.lit(1))
    sample = settle(_sample_sets(docs, list(dict.fromkeys([*positive, *others])), options), "toxicity-sample")
    sample = sample.join(side(positive, "p"), "doc_id", "left").join(side(others, "u"), "doc_id", "left").fillna(0, ["p", "u"])
    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return fit([], [], options)
    counts = sample.select(F.explode("x").alias("b"), "p", "u").groupBy("b").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    able = counts.filter((F.col("p") >= options.min_count) & (F.col("u") <= options.max_share * n_u))
    able = able.orderBy(F.desc(F.col("p") / n_p + F.col("u") / n_u), "b").limit(options.max_features)
    buckets = np.array([r["b"] for r in able.select("b").collect()], dtype=np.int64)
    wanted = np.zeros(options.buckets, dtype=bool)
    wanted[buckets] = True
    sent = spark.sparkContext.broadcast(np.packbits(wanted))

    def only_chosen(batches):
        able = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            x = batch.column(3)
            flat, ends = x.flatten().to_numpy(), np.cumsum(np.asarray(pc.list_value_length(x)))
            on = able[flat]
            offsets = np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], ends])].astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[on], type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], kept], names=["doc_id", "p", "u", "x"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "p", "u", "x").mapInArrow(only_chosen, f"doc_id {key}, p int, u int, x array<int>").toArrow()
    # the order of the sample, by a hash, deals texts out to the folds
    order = np.argsort([hashlib.blake2b(repr(i).encode(), digest_size=8).hexdigest() for i in rows["doc_id"].to_pylist()])
    rows = rows.take(pa.array(order)).combine_chunks()
    x = rows["x"].combine_chunks()
    sets = Sets(x.flatten().to_numpy(), np.asarray(pc.list_value_length(x)).astype(np.int64))
    sides = [sets.pick(rows[c].to_numpy() == 1) for c in ("p", "u")]
    del rows, x, sets
    model = fit(*sides, options, buckets, corrected, _each_in_tasks(spark))
    pa.default_memory_pool().release_unused()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights by bucket: a fixed size

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Documents whose score stays below the threshold, with the columns that came in."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(batch.column(at)) < sent.value.options.threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.options.threshold).cast("int").alias("predicted")
    )
