"""Substring deduplication over a log-structured fingerprint index.

A window is `window` consecutive words of one document. A word is removed if a window covers it whose words also start
in a document with a smaller id.

Every window contains `window - gram + 1` runs of `gram` words; the smallest of their hashes is the window's
fingerprint. Equal windows have equal fingerprints, and neighbouring windows mostly share one, so a document has few.
The index (see FingerprintIndex) is a folder of immutable runs, each bucketed and sorted by its keys: fingerprints with
their first and last document, verified windows with their first document, and hashes of whole word sequences. A batch of
new documents is aggregated into runs of its own, which are merge-joined with the runs of the history bucket by bucket, so
the history is neither shuffled nor sorted again. Two runs of one level are compacted into one of the next by a merge.

A fingerprint that the batch shares with the history, or that two documents of the batch share, is verified: all windows
under it are hashed to 96 bits, the smallest document of each window is found with map-side aggregation, and windows that
start later are removed. Of the history only documents whose fingerprint has had no second document until now are read
again; windows under fingerprints shared before are in the index. Documents with the same words as an earlier one are found
by a hash of the whole sequence first, so that a large group of copies is carried through the index once.

Defined results: null and empty texts have no words and lose none; a null id is never removed from and never a
source; repeated rows of one id don't count against each other; texts shorter than a window stay whole; an empty
table gives an empty result; `dedup_documents` keeps the columns that came in, whatever their names, and a document that
loses every word stays as an empty text. A later batch is judged against the history; its ids should be greater, as
nothing is removed from earlier batches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.joins import by_key, hot_keys
from corpusloom.llm.kernels import mix, slices
from corpusloom.llm.names import free_prefix
from corpusloom.runtime import drop, scratch, settle, ship, table, tidy

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Options:
    window: int = 50
    gram: int = 8
    #: Batches that one table goes through the index in.
    batches: int = 2
    #: Documents of the history that are read again are found by broadcasting their ids up to so many, else by a shuffle.
    broadcast_ids: int = 2_000_000


def window_fingerprints(part, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every window that lies within one text of a slice with words and hashes."""
    k = options.window - options.gram + 1
    m = part.runs(options.gram)
    if len(m) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    span = 1
    while 2 * span <= k:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < k:
        m = np.minimum(m[: len(m) - (k - span)], m[k - span :])
    starts = np.flatnonzero(part.inside(options.window))
    return starts, m[starts]


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def describe(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_words, hash of the whole word sequence (two parts), digest of the words, distinct fingerprints."""
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                part.words()
                h = part.hash_words()
                starts, prints = window_fingerprints(part, options)
                cuts = np.searchsorted(starts, part.bounds)
                raw, whole, shas, found = part.data.tobytes(), [], [], []
                place = np.arange(len(h)) - np.repeat(part.bounds[:-1], part.n_words)
                for seed in (3, 5):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * np.uint64(seed) + mix(place.astype(np.uint64) + np.uint64(seed))))])
                    whole.append(_as_long(total[part.bounds[1:]] - total[part.bounds[:-1]]))
                for d in range(part.count):
                    shas.append(hashlib.sha256(b" ".join(raw[part.offsets[d] : part.offsets[d + 1]].split())).hexdigest())
                    found.append(_as_long(np.unique(prints[cuts[d] : cuts[d + 1]])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        pa.array(part.n_words, type=pa.int64()),
                        pa.array(whole[0]),
                        pa.array(whole[1]),
                        pa.array(shas),
                        pa.array(found, type=pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_words", "w1", "w2", "sha", "prints"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_words bigint, w1 bigint, w2 bigint, sha string, prints array<bigint>")


@contextmanager
def _bucketed_plans(spark, buckets: int):
    """Plans rely on the order within a bucket's file, and an exchange by a run's keys deals rows out to its buckets, so that
    an aggregate is written as a run without a second exchange."""
    wanted = {
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": str(buckets),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class SortedRuns:
    """Immutable runs of (keys, first, last), bucketed and sorted by the keys, with the smallest and largest document of
    each key in a run. A run is an external table; `state` lists (level, folder name) of each."""

    def __init__(self, spark, folder: str, keys: dict[str, str], kind: str, buckets: int, state: list):
        self.spark, self.folder, self.keys, self.kind, self.buckets = spark, folder, keys, kind, buckets
        self.state, self.tables = [tuple(x) for x in state], {}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            columns = ", ".join(f"`{k}` {t}" for k, t in {**self.keys, "first": self.kind, "last": self.kind}.items())
            by = ", ".join(self.keys)
            known = f"corpusloom_run_{uuid.uuid4().hex}"
            path = self._path(name).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[name] = known
        return self.spark.table(self.tables[name])

    def write(self, rows: DataFrame) -> str:
        """A new run of rows (keys, first, last) with one row for each key; not listed until `append`."""
        name = f"run-{uuid.uuid4().hex}"
        known = f"corpusloom_run_{uuid.uuid4().hex}"
        by = list(self.keys)
        # one task for each bucket, so a bucket is one file
        rows.select(*by, "first", "last").write.bucketBy(self.buckets, *by).sortBy(*by).option("path", self._path(name)).format("parquet").saveAsTable(known)
        self.tables[name] = known
        return name

    def new_run(self, rows: DataFrame) -> str:
        """A run of rows (keys, doc_id): aggregated map-side, dealt out to the buckets by the aggregate's exchange."""
        by = list(self.keys)
        return self.write(rows.groupBy(*by).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))

    def meet(self, name: str) -> DataFrame:
        """(keys, first, last) of the history for the keys that a run shares with it, by merge joins with each run; a key
        of several runs has several rows."""
        new = self.read(name).select(*self.keys)
        joined = [new.hint("merge").join(self.read(old).hint("merge"), list(self.keys)) for _, old in self.state]
        if not joined:
            return self.read(name).limit(0)
        return reduce(DataFrame.unionByName, joined)

    def append(self, name: str) -> list[str]:
        """List a run and compact runs of one level; returns the runs that are not needed any more."""
        gone: list[str] = []
        self.state.append((0, name))
        while len(self.state) > 1 and self.state[-1][0] == self.state[-2][0]:
            gone += self._merge_last(self.state[-1][0] + 1)
        return gone

    def compact(self) -> list[str]:
        gone: list[str] = []
        while len(self.state) > 1:
            gone += self._merge_last(self.state[-2][0] + 1)
        return gone

    def _merge_last(self, level: int) -> list[str]:
        (_, a), (_, b) = self.state[-2:]
        x, y = (self.read(n).select(*self.keys, F.col("first").alias(f"f{k}"), F.col("last").alias(f"l{k}")).hint("merge") for k, n in enumerate((a, b)))
        merged = x.join(y, list(self.keys), "full").select(*self.keys, F.least("f0", "f1").alias("first"), F.greatest("l0", "l1").alias("last"))
        self.state[-2:] = [(level, self.write(merged))]
        return [a, b]

    def forget(self, names: list[str]) -> None:
        """Delete runs."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class FingerprintIndex:
    """What earlier batches held, in a folder that all executors share.

    `open` makes the folder or finds what is in it; `dedup` judges a batch against the history and adds it; `compact`
    merges all runs. A batch counts once its manifest is written, after all of its results: a run that fails before can
    be repeated. Invariants: a fingerprint with one document only has first = last; all windows under the others are
    among the verified ones."""

    def __init__(self, spark, path: str, options: Options, version: int, state: dict):
        self.spark, self.path, self.options, self.version, self.kind = spark, path, options, version, state["kind"]
        self.buckets = state["buckets"]
        runs = lambda name, keys: SortedRuns(spark, f"{path}/{name}", keys, self.kind, self.buckets, state.get(name, []))
        self.prints = runs("prints", {"print": "bigint"})
        self.windows = runs("windows", {"w1": "bigint", "w2": "int"})
        self.wholes = runs("wholes", {"w1": "bigint", "w2": "bigint"})

    @classmethod
    def open(cls, spark, path: str, kind: str = "bigint", options: Options = Options(), buckets: int | None = None) -> FingerprintIndex:
        """kind: the type of document ids; buckets: of a new index, by default the session's shuffle partitions."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            fresh = {"kind": kind, "buckets": buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "window": options.window, "gram": options.gram}
            return cls(spark, path, options, 0, fresh)
        state = json.loads(spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()[0])
        if (state["window"], state["gram"], state["kind"]) != (options.window, options.gram, kind):
            raise ValueError(f"the index holds windows of {state['window']} words with runs of {state['gram']} and ids of type {state['kind']}")
        return cls(spark, path, options, int(names[-1].split(".")[0]), state)

    def _commit(self) -> None:
        state = {"kind": self.kind, "buckets": self.buckets, "window": self.options.window, "gram": self.options.gram}
        state |= {name: getattr(self, name).state for name in ("prints", "windows", "wholes")}
        self.version += 1
        conf, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{self.version:08d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        files = target.getFileSystem(conf)
        out = files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(draft, target):
            raise OSError(f"another writer has made {target.toString()}")

    def compact(self) -> None:
        with _bucketed_plans(self.spark, self.buckets):
            gone = {name: getattr(self, name).compact() for name in ("prints", "windows", "wholes")}
        self._commit()
        for name, runs in gone.items():
            getattr(self, name).forget(runs)

    def dedup(self, batch: DataFrame, archive: DataFrame, text: bool = True) -> tuple[DataFrame, DataFrame]:
        """The batch's (doc_id, n_words, sha, copy: whether an earlier document has the same words), and for the others
        that lose words (doc_id, n_removed, kept: the text or its digest). archive: the documents of the history."""
        with _bucketed_plans(self.spark, self.buckets):
            return self._dedup(batch.select("doc_id", "text"), archive.select("doc_id", "text"), text)

    def _dedup(self, batch: DataFrame, archive: DataFrame, text: bool) -> tuple[DataFrame, DataFrame]:
        options = self.options
        described = settle(describe(batch, options), "described")
        long = described.filter((F.col("n_words") >= options.window) & F.col("doc_id").isNotNull())
        # copies of a whole text: only the first document of the batch goes on, unless the history has the words
        wholes = self.wholes.new_run(long.select("w1", "w2", "doc_id"))
        before = self.wholes.meet(wholes).groupBy("w1", "w2").agg(F.min("first").alias("before"))
        firsts = long.groupBy("w1", "w2").agg(F.min_by("prints", "doc_id").alias("prints"), F.min("doc_id").alias("doc_id"))
        firsts = firsts.join(before, ["w1", "w2"], "left").filter("before is null or before >= doc_id")
        firsts = settle(firsts.select("doc_id", "prints"), "firsts")
        entries = firsts.select("doc_id", F.explode("prints").alias("print"))
        # fingerprints that are shared within the batch or with the history
        prints = self.prints.new_run(entries.select("print", "doc_id"))
        met = settle(self.prints.meet(prints).groupBy("print").agg(F.min("first").alias("first"), F.max("last").alias("last")), "met-prints")
        shared = settle(self.prints.read(prints).filter("first < last").select("print").union(met.select("print")).distinct(), "shared-prints")
        sizes = entries.groupBy("print").agg(F.count("*").alias("m"))
        held = by_key(entries, shared.hint("merge"), hot_keys(sizes, "print"), "print").groupBy("doc_id").agg(F.collect_list("print").alias("prints"))
        source = batch.filter("doc_id is not null")
        candidates = settle(source.join(settle(held, "held").hint("merge"), "doc_id"), "candidates")
        windows = settle(_windows(candidates, options), "windows")
        # a fingerprint of one historical document was never verified: that document is read again
        single = met.filter("first = last").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("print").alias("prints"))
        single = settle(single, "single-prints")
        n_single = single.count()
        everything = windows.select("w1", "w2", "doc_id")
        if n_single:
            few = F.broadcast(single) if n_single <= options.broadcast_ids else single
            again = archive.join(F.broadcast(single.select("doc_id")), "doc_id", "left_semi") if n_single <= options.broadcast_ids else archive
            everything = everything.union(_windows(again.join(few, "doc_id"), options).select("w1", "w2", "doc_id"))
        found = self.windows.new_run(everything)
        earlier = self.windows.meet(found).select("w1", "w2", "first").groupBy("w1", "w2").agg(F.min("first").alias("first"))
        first = self.windows.read(found).filter("first < last").select("w1", "w2", "first").union(earlier)
        first = settle(first.groupBy("w1", "w2").agg(F.min("first").alias("first")), "first-windows")
        hot = hot_keys(windows.groupBy("w1", "w2").agg(F.count("*").alias("m")), "w1", "w2")
        later = by_key(windows, first.hint("merge"), hot, "w1", "w2").filter("doc_id > first").select("doc_id", "start")
        later = settle(later.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "later")
        lost = settle(_kept(candidates.drop("prints").join(later.hint("merge"), "doc_id"), options, text).dropDuplicates(["doc_id"]), "lost")
        copy = (F.col("n_words") >= options.window) & F.col("doc_id").isNotNull() & F.col("own").isNull()
        marked = described.select("doc_id", "n_words", "sha").join(firsts.select("doc_id", F.lit(True).alias("own")).distinct(), "doc_id", "left")
        marked = settle(marked.select("doc_id", "n_words", "sha", copy.alias("copy")), "marked")
        gone = {name: getattr(self, name).append(run) for name, run in (("wholes", wholes), ("prints", prints), ("windows", found))}
        self._commit()
        for name, runs in gone.items():
            getattr(self, name).forget(runs)
        drop(described, firsts, met, shared, candidates, windows, single, first, later)
        tidy(self.spark)
        return marked, lost


def _windows(candidates: DataFrame, options: Options) -> DataFrame:
    """(w1, w2, doc_id, start) of the candidates' windows whose fingerprint is among their shared ones."""
    key = candidates.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            shared = batch.column(2)
            for part in slices(batch.column(1)):
                part.words()
                part.hash_words()
                starts, prints = window_fingerprints(part, options)
                w1, w2 = part.runs(options.window, 0), part.runs(options.window, 1)
                cuts = np.searchsorted(starts, part.bounds)
                at, rows = [], []
                for d in range(part.count):
                    a, b = cuts[d], cuts[d + 1]
                    wanted = np.asarray(shared[part.first + d].values).view(np.uint64)
                    hit = starts[a:b][np.isin(prints[a:b], wanted)]
                    at.append(hit)
                    rows.append(np.full(len(hit), part.first + d))
                at, rows = np.concatenate(at), np.concatenate(rows)
                begin = part.bounds[rows - part.first] if len(rows) else rows
                for i in range(0, len(at), 50_000):
                    j = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_as_long(w1[at[j]])),
                            pa.array((w2[at[j]] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                            batch.column(0).take(pa.array(rows[j])),
                            pa.array((at[j] - begin[j]).astype(np.int32)),
                        ],
                        names=["w1", "w2", "doc_id", "start"],
                    )

    return candidates.select("doc_id", "text", "prints").mapInArrow(run, f"w1 bigint, w2 int, doc_id {key}, start int")


def _kept(candidates: DataFrame, options: Options, text: bool) -> DataFrame:
    """(doc_id, n_removed, kept) of candidates with the starts of the windows to remove; kept: the text or its digest."""
    key = candidates.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            starts = batch.column(2)
            for part in slices(batch.column(1)):
                part.words()
                raw, removed, kept = part.data.tobytes(), [], []
                for d in range(part.count):
                    a, b = int(part.bounds[d]), int(part.bounds[d + 1])
                    at = np.asarray(starts[part.first + d].values)
                    edge = np.bincount(at, minlength=b - a + options.window + 1) - np.bincount(at + options.window, minlength=b - a + options.window + 1)
                    stay = np.flatnonzero(np.cumsum(edge)[: b - a] == 0) + a
                    removed.append(b - a - len(stay))
                    words = b" ".join([raw[i:j] for i, j in zip(part.starts[stay].tolist(), part.ends[stay].tolist())])
                    kept.append(words.decode("utf-8", "replace") if text else hashlib.sha256(words).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.count), pa.array(removed, type=pa.int64()), pa.array(kept, type=pa.string())],
                    names=["doc_id", "n_removed", "kept"],
                )

    return candidates.select("doc_id", "text", "starts").mapInArrow(run, f"doc_id {key}, n_removed bigint, kept string")


def id_ranges(docs: DataFrame, n: int) -> list:
    """The first ids of about n ranges of near equal numbers of rows, whatever the ids' type and spread."""
    ranges = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(n, "doc_id")
    found = sorted(r["low"] for r in ranges.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low")).collect())
    return [found[k * len(found) // n] for k in range(n)] if len(found) > n else found


def find_repeats(docs: DataFrame, options: Options = Options(), text: bool = True) -> tuple[DataFrame, DataFrame]:
    """`FingerprintIndex.dedup` of a whole table, which goes through an index of its own in batches by ranges of ids."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = FingerprintIndex.open(spark, f"{scratch(spark)}/index-{uuid.uuid4().hex}", kind, options)
    lows = id_ranges(docs, options.batches)
    key, results = F.col("doc_id"), []
    for k, low in enumerate(lows):
        batch = docs.filter(key < lows[k + 1]) if k + 1 < len(lows) else docs.filter(key.isNotNull())
        batch = batch.filter(key >= low) if k else batch
        results.append(index.dedup(batch, docs.filter(key < low), text))
    for runs in (index.prints, index.windows, index.wholes):
        runs.forget([name for _, name in runs.state])
    nameless = docs.filter(key.isNull()) if lows else docs
    alone = describe(nameless, options).select("doc_id", "n_words", "sha", F.lit(False).alias("copy"))
    marked = reduce(DataFrame.unionByName, [m for m, _ in results], alone)
    none = spark.createDataFrame([], f"doc_id {kind}, n_removed bigint, kept string")
    return marked, reduce(DataFrame.unionByName, [x for _, x in results], none)


def digest(docs: DataFrame, options: Options = Options()) -> DataFrame:
    marked, lost = find_repeats(docs, options, text=False)
    return marked.join(lost, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def dedup_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """All documents with the columns that came in; the text of those that lose words is the kept words, joined by a
    space (empty if none is kept), and n_chars, where there is one, follows."""
    marked, lost = find_repeats(docs, options, text=True)
    own = free_prefix(docs.columns, "_s_") + "kept"
    changed = marked.filter("copy").select("doc_id", F.lit("").alias(own)).dropDuplicates(["doc_id"])
    changed = changed.union(lost.select("doc_id", "kept"))
    out = docs.join(changed, "doc_id", "left").withColumn("text", F.coalesce(own, "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own).isNotNull(), F.char_length(own).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, CASE WHEN trim(t, c) = '' THEN [] ELSE regexp_split_to_array(trim(t, c), '[ \t-\r]+') END AS w
  FROM (SELECT doc_id, coalesce(text, '') AS t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS c FROM documents)
), win AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM win JOIN first USING (h) WHERE doc_id > f),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w) ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
