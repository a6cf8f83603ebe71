"""Quality classification by co-training two views of a document.

The text view sees which words and glyph runs a text holds and its shape (length, letter case, symbols, lines, variety);
the page view sees only metadata: language, source, stated length. Both are logistic models fitted on labelled documents.
Over rounds each view labels all unlabelled documents of which it is sure and hands them to the other view: every part of
the table fits both views from the common weights on the labelled rows and its own pseudo-labels, and the weights are
averaged. Held-out labels calibrate both views, others fit their combination, which then scores all documents.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, materialize, span_hashes, word_spans

#: Bound of the fit: labelled rows (by smallest hash of the id); unlabelled ones all serve.
MAX_LABELLED = 10_000
ROUNDS = 3
SURE = 0.98
#: Gradient steps on the labelled rows, then of each part in each round.
STEPS, PART_STEPS = 150, 30
TEXT_BITS = 18
TEXT_FEATURES = 2048
LEAST_ROWS = 5
LEAST_Z = 3.5
LEAST_LIFT = 3.0
#: Quantiles of the labelled rows at which shapes and lengths are cut: finer towards the tails.
CUTS = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99)
BINS = len(CUTS) - 1
THRESHOLD = 0.5

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FLAGS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": (_KIND == 2) & ~np.isin(np.arange(256), np.frombuffer(b".,;:'\"?-", np.uint8)),
    "line": np.arange(256) == 10,
}
SHAPE = ("bytes", "words", "word_bytes", *_FLAGS, "variety", "stutter")


def text_view(data: np.ndarray, offsets: np.ndarray, bits: int = TEXT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features that each text holds (sorted, once each), and how many: runs of letters, runs of glyphs."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(offsets, starts, side="right") - 1
    feature = (span_hashes(_LOWER[data], starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(row << bits | feature)
    return both & ((1 << bits) - 1), np.bincount(both >> bits, minlength=rows)


def text_shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The shape of each text, one column for each name in SHAPE."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), n_words)
    hashed = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashed, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashed[order[1:]] != hashed[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])

    def total(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    columns = [np.log1p(size), np.log1p(n_words), np.bincount(row, weights=ends - starts, minlength=rows) / w]
    columns += [total(flag[data]) / b for flag in _FLAGS.values()]
    columns += [np.bincount(row[order[fresh]], minlength=rows) / w, np.bincount(row[again], minlength=rows) / w]
    return np.column_stack(columns)


def _named(column: pa.Array, buckets: int) -> np.ndarray:
    """Hashed buckets of a short text column; null is bucket 0."""
    values = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    names = values.dictionary.to_pylist()
    lookup = np.array([1 + zlib.crc32(str(x).encode()) % (buckets - 1) for x in names] + [0])
    index = values.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    return lookup[index]


FEATURES = "features array<int>, shape array<double>, n_chars double, lang_key int, source_key int"
LANG_KEYS, SOURCE_KEYS = 32, 256


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Per slice of (text, lang, source, n_chars, ...): rows; features, how many, shape, stated lengths, language and
    source keys."""
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            features, many = text_view(data, offsets)
            stated = np.log1p(np.maximum(rows.column("n_chars").fill_null(0.0).to_numpy(zero_copy_only=False), 0.0))
            yield rows, (features, many, text_shape(data, offsets), stated, _named(rows.column("lang"), LANG_KEYS), _named(rows.column("source"), SOURCE_KEYS))


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, (features, many, shape, stated, lang, source) in _featurise(batches):
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pa.array(features.astype(np.int32)))
        shapes = pa.ListArray.from_arrays(np.arange(0, shape.size + 1, shape.shape[1]).astype(np.int32), pa.array(shape.ravel()))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("bad"), lists, shapes, pa.array(stated), pa.array(lang.astype(np.int32)), pa.array(source.astype(np.int32))], names=["doc_id", "bad", *FEATURE_NAMES])


FEATURE_NAMES = ("features", "shape", "n_chars", "lang_key", "source_key")


def _views_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """What ``_featurise`` gives, read back from rows of ``_emit_features``."""
    lists, shapes = table.column("features"), table.column("shape")
    if isinstance(lists, pa.ChunkedArray):
        lists, shapes = lists.combine_chunks(), shapes.combine_chunks()
    shape = shapes.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHAPE))
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), shape, *(table.column(c).to_numpy() for c in FEATURE_NAMES[2:])


def fit_logistic(row: np.ndarray, index: np.ndarray, y: np.ndarray, weights: np.ndarray, start: np.ndarray, steps: int, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model over 0/1 features given as (row, index) pairs; full-batch Adam."""
    w, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    width = len(start) - 1
    scale = weights.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[index], minlength=len(y)) + w[-1]
        error = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / scale
        g = np.append(np.bincount(index, weights=error[row], minlength=width), error.sum())
        g[:-1] += ridge * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dense_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Newton's method for a few dense features and a bias, with a slight ridge towards ``prior``: few rows change little."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.astype(float)
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * (w - prior))
    return w


def _cut(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


Pairs = tuple[np.ndarray, np.ndarray]


class CoTrained:
    """The pair of views, their calibrations and their combination. Scores are logits of being bad."""

    def __init__(self, views: tuple[np.ndarray, ...], bad: np.ndarray):
        """Fit on labelled rows, which come ordered by hash: three fifths train, one calibrates, one combines."""
        self.bad, self.fold = bad, np.arange(len(bad)) % 5
        self.views = views
        train = self.fold < 3
        shape, stated = views[2][train], views[3][train]
        self.edges = [np.quantile(column, CUTS) if len(column) else np.zeros(len(CUTS)) for column in (*shape.T, stated)]
        seen = np.repeat(train, views[1])
        at = np.repeat(bad, views[1])[seen]
        size = 1 << TEXT_BITS
        #: Of the training rows: how many hold each feature, bad ones and others, and how many there are.
        self.counts = np.stack([np.bincount(views[0][seen], weights=at, minlength=size), np.bincount(views[0][seen], weights=1 - at, minlength=size)])
        self.rows = np.array([bad[train].sum(), (1 - bad[train]).sum()], float)
        self.chosen = np.zeros(0, np.int64)
        self.text_w, self.page_w = np.zeros(self._bins() + 1), np.zeros(BINS + 2 + LANG_KEYS + SOURCE_KEYS + 1)
        self.choose(np.zeros_like(self.counts), np.zeros(2))
        base = np.log((self.rows[0] + 0.5) / (self.rows[1] + 0.5))
        self.text_w[-1] = self.page_w[-1] = base
        self.text_w, self.page_w = self.fitted(*self.training(), STEPS)
        self.finish()

    @staticmethod
    def _bins() -> int:
        return len(SHAPE) * (BINS + 2)

    def choose(self, counts: np.ndarray, rows: np.ndarray) -> None:
        """Keep the features whose presence speaks most against a text, by the labelled rows and ``counts`` of pseudo-
        labelled ones: only such, so that short texts are not suspect. Weights of features that stay are kept."""
        c1, c0 = self.counts + counts
        n1, n0 = np.maximum(self.rows + rows, 1)
        p = (c1 + c0 + 1) / (n1 + n0 + 2)
        z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        z[(c1 + c0 < LEAST_ROWS) | (c1 / n1 < LEAST_LIFT * c0 / n0)] = 0
        chosen = np.sort(np.argsort(-z, kind="stable")[:TEXT_FEATURES])
        chosen = chosen[z[chosen] >= LEAST_Z]
        held = dict(zip(self.chosen.tolist(), self.text_w[: len(self.chosen)].tolist()))
        self.text_w = np.concatenate([[held.get(f, 0.0) for f in chosen.tolist()], self.text_w[len(self.chosen) :]])
        self.chosen = chosen
        self.slot = np.full(1 << TEXT_BITS, -1, np.int32)
        self.slot[chosen] = np.arange(len(chosen))

    def text_pairs(self, views: tuple[np.ndarray, ...]) -> Pairs:
        """0/1 features of the text view as (row, index): chosen words and glyph runs, cut shapes."""
        features, many, shape = views[:3]
        n = len(many)
        slot = self.slot[features]
        keep = slot >= 0
        bins = [len(self.chosen) + j * (BINS + 2) + _cut(shape[:, j], self.edges[j]) for j in range(len(SHAPE))]
        return np.concatenate([np.repeat(np.arange(n), many)[keep], np.repeat(np.arange(n), len(SHAPE))]), np.concatenate([slot[keep], np.column_stack(bins).ravel()]).astype(np.int64)

    def page_pairs(self, views: tuple[np.ndarray, ...]) -> Pairs:
        """0/1 features of the page view: cut stated length, language, source."""
        stated, lang, source = views[3:]
        base = BINS + 2
        return np.repeat(np.arange(len(stated)), 3), np.column_stack([_cut(stated, self.edges[-1]), base + lang, base + LANG_KEYS + source]).ravel().astype(np.int64)

    def logits(self, views: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Of being bad: by the text view, by the page view."""
        n = len(views[1])
        return tuple(np.bincount(row, weights=w[index], minlength=n) + w[-1] for (row, index), w in ((self.text_pairs(views), self.text_w), (self.page_pairs(views), self.page_w)))

    def training(self) -> tuple[Pairs, Pairs, np.ndarray, np.ndarray]:
        """The labelled training rows in both views, their targets twice."""
        place = np.cumsum(self.fold < 3) - 1
        pairs = []
        for row, index in (self.text_pairs(self.views), self.page_pairs(self.views)):
            keep = self.fold[row] < 3
            pairs.append((place[row[keep]], index[keep]))
        y = self.bad[self.fold < 3].astype(float)
        return pairs[0], pairs[1], y, y

    def fitted(self, text: Pairs, page: Pairs, text_y: np.ndarray, page_y: np.ndarray, steps: int, text_weights: np.ndarray | None = None, page_weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights of both views after some steps from the present ones."""
        out = []
        for (row, index), y, weights, w in ((text, text_y, text_weights, self.text_w), (page, page_y, page_weights, self.page_w)):
            out.append(fit_logistic(row, index, y, np.ones(len(y)) if weights is None else weights, w, steps) if len(y) else w)
        return out[0], out[1]

    def fit_part(self, parts: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both views' weights after steps on the labelled rows and on the documents of a part of the table of which the
        other view is sure; how many of these there were for each, and the counts of the text view's. All pseudo-labels
        of a part weigh as much as the labelled rows, or less if they are fewer."""
        text, page, text_y, page_y = self.training()
        texts, pages, ys = [text], [page], [[text_y], [page_y]]
        counts = np.zeros_like(self.counts)
        rows, n = np.zeros(2), [len(text_y), len(page_y)]
        for views in parts:
            z = self.logits(views)
            for k, (pairs, into) in enumerate(((self.text_pairs(views), texts), (self.page_pairs(views), pages))):
                p = _sigmoid(z[1 - k])
                sure = np.maximum(p, 1 - p) >= SURE
                place = np.cumsum(sure) - 1
                row, index = pairs
                keep = sure[row]
                into.append((n[k] + place[row[keep]], index[keep]))
                label = (p[sure] > 0.5).astype(float)
                ys[k].append(label)
                n[k] += len(label)
                if k == 0 and len(label):
                    held = np.repeat(sure, views[1])
                    at = np.repeat((p > 0.5).astype(float), views[1])[held]
                    counts += np.stack([np.bincount(views[0][held], weights=x, minlength=counts.shape[1]) for x in (at, 1 - at)])
                    rows += [label.sum(), (1 - label).sum()]
        y = [np.concatenate(x) for x in ys]
        new = np.array([len(y[0]) - len(text_y), len(y[1]) - len(page_y)])
        weights = [np.concatenate([np.ones(len(text_y)), np.full(m, min(1.0, len(text_y) / m) if m else 1.0)]) for m in new]
        pairs = [tuple(np.concatenate(x) for x in zip(*into)) for into in (texts, pages)]
        text_w, page_w = self.fitted(pairs[0], pairs[1], y[0], y[1], PART_STEPS, weights[0], weights[1])
        return text_w, page_w, new, counts, rows

    def finish(self) -> None:
        """Calibrate the views on one fifth of the labelled rows and combine them on another."""
        z = self.logits(self.views)
        a, b = self.fold == 3, self.fold == 4
        self.calibration = [_dense_logistic(x[a][:, None], self.bad[a].astype(float), np.array([1.0, 0.0])) for x in z]
        calibrated = np.column_stack([c[0] * x[b] + c[1] for c, x in zip(self.calibration, z)])
        self.combination = _dense_logistic(calibrated, self.bad[b].astype(float), np.array([0.5, 0.5, 0.0]))

    def score(self, views: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good: by the text view, by the page view, by both."""
        a, b = (c[0] * z + c[1] for c, z in zip(self.calibration, self.logits(views)))
        both = self.combination[0] * a + self.combination[1] * b + self.combination[2]
        return 1 - _sigmoid(a), 1 - _sigmoid(b), 1 - _sigmoid(both)

    def slim(self) -> "CoTrained":
        """What scoring needs, without the labelled rows."""
        out = object.__new__(CoTrained)
        for name in ("edges", "chosen", "slot", "text_w", "page_w", "calibration", "combination"):
            setattr(out, name, getattr(self, name))
        return out


#: What a part of the table sends, by kind: pseudo-labels, text weights, page weights, rows and counts of the text view's.
N, TEXT_W, PAGE_W, N_ROWS, COUNTS = range(5)
PART = "kind int, index int, a double, b double"


def _fit_parts(shared):
    """Rows of unlabelled documents' features to sums that each part of the table adds to (weights times pseudo-labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        full = (batch for batch in batches if batch.num_rows)
        first = next(full, None)
        if first is None:
            return
        text_w, page_w, n, counts, rows = model.fit_part(map(_views_of, itertools.chain([first], full)))
        held = np.flatnonzero(counts.any(axis=0))
        sent = [(N, [0], n[:1], n[1:]), (TEXT_W, range(len(text_w)), n[0] * text_w, None), (PAGE_W, range(len(page_w)), n[1] * page_w, None), (N_ROWS, [0], rows[:1], rows[1:]), (COUNTS, held, *counts[:, held])]
        for kind, index, a, b in sent:
            size = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.asarray(index, np.int32)), pa.array(np.asarray(a, float)), pa.array(np.zeros(size) if b is None else np.asarray(b, float))], names=["kind", "index", "a", "b"])

    return run


def co_train(model: CoTrained, unlabelled: DataFrame, rounds: int) -> None:
    """Rounds over all unlabelled documents; each part's weights count by how many pseudo-labels it had.

    The sums that reach the driver have at most one row for each feature.
    """
    spark = unlabelled.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        parts = unlabelled.mapInArrow(_fit_parts(shared), PART)
        sums = parts.groupBy("kind", "index").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        shared.destroy()
        kind, index, a, b = (sums.column(c).to_numpy() for c in ("kind", "index", "a", "b"))

        def held(which: int, size: int, values: np.ndarray) -> np.ndarray:
            out = np.zeros(size)
            out[index[kind == which]] = values[kind == which]
            return out

        total = [held(N, 1, a)[0], held(N, 1, b)[0]]
        if total[0]:
            model.text_w = held(TEXT_W, len(model.text_w), a) / total[0]
            size = model.counts.shape[1]
            model.choose(np.stack([held(COUNTS, size, a), held(COUNTS, size, b)]), np.array([held(N_ROWS, 1, a)[0], held(N_ROWS, 1, b)[0]]))
        if total[1]:
            model.page_w = held(PAGE_W, len(model.page_w), a) / total[1]
        if not any(total):
            break
    model.finish()


def _view_columns(docs: DataFrame) -> list:
    have = set(docs.columns)
    given = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return [F.col("text"), *given, (F.col("n_chars").try_cast("double") if "n_chars" in have else F.lit(None).cast("double")).alias("n_chars")]


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> tuple[CoTrained | None, DataFrame]:
    """The model and the features of all documents. At most ``max_labelled`` labelled documents, taken by smallest hash of
    the id, fit it directly; all others take part in the rounds.

    A document is bad if its quality is 0 or it is toxic; rows with null quality do not count; of several labels for
    one id the worst counts. Few labels, or of one class only, give a model near their share; none give no model.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
    marks = marks.agg(F.max(((F.col("quality") != 1) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    order = F.xxhash64("doc_id")
    named = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled)
    # bounded by the parameter, so it is broadcast
    named = F.broadcast(materialize(named, "quality-labelled").withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", *_view_columns(docs)).join(named, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = materialize(rows.mapInArrow(_emit_features, f"doc_id {kind}, bad int, {FEATURES}"), "quality-features")
    labelled = features.filter("bad is not null").dropDuplicates(["doc_id"]).withColumn("_h", order).orderBy("_h", "doc_id").toArrow()
    if not labelled.num_rows:
        return None, features
    model = CoTrained(_views_of(labelled), labelled.column("bad").to_numpy().astype(np.int64))
    co_train(model, features.filter("bad is null").select(*FEATURE_NAMES), rounds)
    return model.slim(), features


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """Rows of ``docs`` (doc_id only) with text_score, page_score, score (probabilities of being good) and kept.

    kept: score >= threshold. Null text is empty; null lang, source or n_chars is a value of its own. Without any label all
    rows are kept with null scores. Every row is scored on its whole text, in place, without a shuffle.
    """
    model, features = fit_quality(docs, labels, **bounds)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("text_score"), nothing.alias("page_score"), nothing.alias("score"), F.lit(True).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                a, b, both = model.score(_views_of(rows))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], names=["doc_id", "text_score", "page_score", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", *FEATURE_NAMES).mapInArrow(run, f"doc_id {kind}, text_score double, page_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    model, _ = fit_quality(docs, labels, **bounds)
    if model is None:
        return docs

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, lang, source, n_chars in columns:
            batch = pa.RecordBatch.from_arrays([text, lang, source, n_chars], names=["text", "lang", "source", "n_chars"])
            kept = [model.score(views)[2] >= threshold for _, views in _featurise([batch])]
            yield pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    judge = arrow_udf(run, "boolean")
    return docs.filter(judge(*_view_columns(docs)))
