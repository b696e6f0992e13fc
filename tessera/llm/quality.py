"""Quality by co-training: a view of the content and a view of the metadata teach each other, then score all texts together."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, Words, chunks, flat, mix

#: Labelled rows that training reads at most, and unlabelled ones: the first by a hash of their id. Half of the labelled rows of either class
#: are seeds, half calibrate; the unlabelled ones are the pool from which the views label texts for one another.
SAMPLE, POOL = 8000, 8000
ROUNDS = 3
#: How sure a view must be, on calibrated scale, to label a text for the other.
SURE = 0.97
SLOTS = 32
#: Hashed counts of the content view: of words, and of runs of three bytes.
WORDS, GRAMS = 256, 128

_class = np.zeros(256, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "!", "#$%&*@^~+=<>", "|/\\_{}[]"], 1):
    _class[[ord(c) for c in _chars]] = _k
_class[128:] = 1


def content(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first view: one row a text, from its bytes and words alone."""
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    share = np.bincount(doc * 8 + _class[buf], minlength=8 * n_docs).reshape(n_docs, 8).astype(float)
    lines = np.bincount(doc[buf == 10], minlength=n_docs) + 1
    words = Words(buf, off, lower=True)
    n = np.diff(words.begin)
    hashes = words.hashes
    order = np.lexsort((hashes, words.doc))
    h, d = hashes[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n_docs)
    size = np.diff(words.at) - 1
    long_ = np.bincount(words.doc[size > 25], minlength=n_docs)
    marks = np.maximum(share.sum(1), 1)[:, None]
    ratios = share[:, 1:] / marks
    per = np.maximum(n, 1)
    stutter = np.bincount(words.doc[1:][(hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n_docs) / per
    x = np.column_stack([ratios, np.sqrt(ratios), distinct / per, share.sum(1) / per, np.log1p(n), lines / per, long_ / per, n < 3, stutter, np.sqrt(stutter)])
    x[:, 15] = np.minimum(x[:, 15], 40)

    def hashed(doc: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
        slot = (h % np.uint64(slots)).astype(np.int64)
        count = np.bincount(doc * slots + slot, minlength=n_docs * slots).reshape(n_docs, slots)
        return np.sqrt(count / np.maximum(count.sum(1), 1)[:, None])

    low = LOWER[buf].astype(np.uint64)
    runs_ = low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)
    inside = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    return np.hstack([x, hashed(words.doc, mix(hashes, 9), WORDS), hashed(doc[inside], (runs_[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40), GRAMS)])


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The second view: language and source by hashed slot, and the stated length."""
    def slot(values: list, seed: int) -> np.ndarray:
        import zlib

        h = np.array([zlib.crc32(str(v).encode()) if v is not None else 0xFFFFFFFF for v in values], np.uint64)
        return np.eye(SLOTS)[(mix(h, seed) % np.uint64(SLOTS)).astype(int)] if len(values) else np.zeros((0, SLOTS))

    size = np.log1p(np.array([max(v, 0) if v is not None else 0 for v in n_chars], float))[:, None]
    steps = size > np.log(np.array([[64, 256, 1024, 4096, 16384, 65536]]))
    return np.hstack([slot(lang, 1), slot(source, 2), size, steps])


@dataclass(frozen=True)
class View:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, standard: bool = True) -> View:
    a = np.ones((len(x), x.shape[1] + 1))
    f = a[:, :-1]
    f[:] = x
    mean, scale = (f.mean(0), np.maximum(f.std(0), 1e-6)) if standard else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    f -= mean
    f /= scale
    np.clip(f, -8, 8, out=f)
    w, hold = np.zeros(a.shape[1]), np.append(np.full(a.shape[1] - 1, ridge), 1e-3)
    for _ in range(30):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ a + np.diag(hold), a.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return View(mean, scale, w)


@dataclass(frozen=True)
class Model:
    views: tuple[View, View]
    calibrations: tuple[View, View]
    combined: View
    held_out: dict

    def __call__(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [c(v(f)[:, None]) for v, c, f in zip(self.views, self.calibrations, (x, m), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.combined(np.column_stack(z)))


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, role: np.ndarray, rounds: int = ROUNDS) -> Model:
    """role: 0 is labelled, 1 is not and lends its features only, 2 calibrates. In a round either view is fitted on the labels it has, calibrated,
    and hands the labels of the texts it is sure of to the other view."""
    seeds, pool, hold = (np.flatnonzero(role == r) for r in range(3))
    given: list[dict[int, int]] = [{}, {}]
    views: list = []
    for r in range(rounds + 1):
        views = []
        for v, f in enumerate((x, m)):
            rows = np.concatenate([seeds, np.fromiter(given[v], int, len(given[v]))])
            views.append(fit(f[rows], np.concatenate([y[seeds], np.fromiter(given[v].values(), float, len(given[v]))])))
        scales = [fit(view(f[hold])[:, None], y[hold], 1e-3, False) for view, f in zip(views, (x, m), strict=True)]
        if r < rounds:
            for v, f in enumerate((x, m)):
                p = sigmoid(scales[v](views[v](f[pool])[:, None]))
                for i, q in zip(pool, p, strict=True):
                    if q >= SURE or q <= 1 - SURE:
                        given[1 - v].setdefault(int(i), int(q > 0.5))
    z = [s(v(f)[:, None]) for s, v, f in zip(scales, views, (x, m), strict=True)]
    combined = fit(np.column_stack(z)[hold], y[hold], 1e-2, False)
    p = sigmoid(combined(np.column_stack(z)[hold]))
    return Model(tuple(views), tuple(scales), combined, {"calibration_accuracy": float(((p > 0.5) == y[hold]).mean()), "exchanged": [len(g) for g in given]})


def _column(part: pa.RecordBatch, name: str) -> list:
    """A column's values, whatever its type; one that is missing is null."""
    at = part.schema.get_field_index(name)
    if at < 0:
        return [None] * part.num_rows
    return part.column(at).cast(pa.int64() if name == "n_chars" else pa.string()).to_pylist()


def _views(part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return content(buf, off), metadata(*(_column(part, c) for c in ("lang", "source", "n_chars")))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in chunks(batch):
            x, m = _views(part, buf, off)
            yield pa.record_batch([part.column("doc_id"), part.column("quality"), *(pa.array([r.tobytes() for r in v.astype("<f4")], pa.binary()) for v in (x, m))], names=["doc_id", "quality", "x", "m"])


def _typed(docs: DataFrame, *extra: str) -> DataFrame:
    """What the views read, of one type; columns that are missing are null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select("doc_id", *[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *extra)


def _sampled(docs: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """Features of the rows with the ids of `few`, at most `most` of them: the first by a hash of their id, ties by all that is read."""
    rows = _typed(docs).join(F.broadcast(few), "doc_id").mapInArrow(_features, "doc_id long, quality long, x binary, m binary")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x", "m").limit(most)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model as bytes, from the labelled rows and then those without (quality -1), all in one task; no row where no text or only one class is labelled."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for have, c in zip(parts, ("x", "m"), strict=False):
            have.append(np.frombuffer(flat(batch.column(c))[0].tobytes(), "<f4").reshape(batch.num_rows, -1))
        parts[2].append(batch.column("quality").to_numpy().astype(float))
    if not sum(map(len, parts[2])):
        return
    x, m, y = (np.concatenate([v for v in have if len(v)]) for have in parts)
    del parts
    labelled = int((y >= 0).sum())
    if len(set(y[:labelled])) < 2:
        return
    # every other row of a class calibrates, by the hash of the id, so that either class is on both sides
    role = np.where(np.arange(len(x)) < labelled, 0, 1)
    for q in (0.0, 1.0):
        role[np.flatnonzero(y == q)[1::2]] = 2
    if len(set(y[role == 2])) < 2:
        own = np.flatnonzero(role != 1)
        role[own] = 0
        x, m, y, role = np.vstack([x, x[own]]), np.vstack([m, m[own]]), np.append(y, y[own]), np.append(role, np.full(len(own), 2))
    yield pa.record_batch([pa.array([pickle.dumps(co_train(x, m, y, role))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> Model | None:
    """The model from at most `sample` labelled rows and `pool` unlabelled ones; None where no text or only one class is labelled. Labels with a null
    id or another quality than 0 and 1 are left out; a document with labels of both is labelled twice; repeated ids are rows of their
    own. Null texts are empty, null or missing languages, sources and lengths have values of their own.

    With a single row of a class there is none to calibrate by: then all rows are seeds and calibrate too.

    A task of an executor holds the features and trains; the driver gets the model alone, about 12 kB."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")).filter("doc_id is not null")
    rows = labels.filter("quality in (0, 1)").distinct()
    docs = _typed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    labelled = _sampled(docs, rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample), sample)
    other = docs.filter("doc_id is not null").select("doc_id").join(labels, "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    both = labelled.unionByName(_sampled(docs, other.withColumn("quality", F.lit(-1).cast("long")), pool)).coalesce(1)
    got = both.sortWithinPartitions(F.col("quality") < 0, F.xxhash64("doc_id"), "doc_id", "quality", "x", "m").mapInArrow(_trained, "model binary").collect()
    return pickle.loads(got[0][0]) if got else None  # noqa: S301


def _apply(model: Model | None, threshold: float, filter_: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                p = model(*_views(part, buf, off)) if model else (np.ones(part.num_rows),) * 3
                keep = p[2] >= threshold
                if filter_:
                    yield part.filter(pa.array(keep))
                else:
                    yield pa.record_batch([part.column(0), *map(pa.array, p), pa.array(keep)], names=["doc_id", "p_content", "p_metadata", "p_quality", "keep"])

    return apply


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_content, p_metadata, p_quality, keep) of every row: either view's calibrated probability of quality, their combination,
    and whether that reaches the threshold.

    Null texts are empty, null or missing languages, sources and lengths have values of their own; very long texts are read whole; without a
    model all are kept. Null and repeated ids stay rows of their own, equal rows get equal results; no rows give no rows; extra
    columns are ignored."""
    return _typed(docs).mapInArrow(_apply(model, threshold, False), "doc_id long, p_content double, p_metadata double, p_quality double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with the columns of docs."""
    return docs.mapInArrow(_apply(model, threshold, True), docs.schema)
