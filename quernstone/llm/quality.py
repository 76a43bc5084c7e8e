"""Document quality by a linear-chain CRF that labels every line good or bad.

A line's features are those of its bytes and words and of its neighbours. The
CRF is trained on lines that carry their document's label; forward-backward
marginals, weighted by line length, make a document's share of good text, which
a logistic curve turns into a score. Labels are learnt only from the training
fold and never are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textvec
from quernstone.llm.shared import Work, small_batches

#: The model is fitted on at most so many labelled documents (those of least hash) ...
FIT_DOCUMENTS = 3000
#: ... of which, in order of the hash, as many are used whole as have so many lines together.
FIT_LINES = 300_000
HELD_OUT = 1
_GRAM = 5
_SHARED = ("upper", "symbol", "mark", "pipe", "digit", "repeat", "gram", "same_line")
NAMES = ("words", "word_length", *_SHARED, "stop", "ends", "starts", "foreign", "longest")
N_FEATURES = 1 + len(NAMES) + 4 * len(_SHARED) + 2


def _classes() -> np.ndarray:
    """Per byte: upper, lower, digit, symbol, mark, pipe, stop, non-ASCII lead byte."""
    t = np.zeros((8, 256), np.int32)
    t[0, 65:91] = t[1, 97:123] = t[2, 48:58] = 1
    for row, chars in ((3, b"#*$%&<>@^~_=+{}[]\\/"), (4, b"!?"), (5, b"|"), (6, b".,;:")):
        t[row, list(chars)] = 1
    t[7, 0xC0:] = 1
    return t


_CLASS = _classes()


@dataclass
class Lines:
    """Features of all lines with a word; text ``i`` has lines ``ptr[i]:ptr[i+1]``."""

    x: np.ndarray
    weight: np.ndarray
    ptr: np.ndarray


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once in its document."""
    if not len(keys):
        return np.zeros(0, bool)
    k = textvec.mix(keys ^ textvec.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(k, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def features(texts: list[str | None]) -> Lines:
    """Lines of a batch; null and blank texts have none."""
    w = textvec.words(texts)
    data, n_docs = w.data, len(texts)
    if not len(w.starts):
        return Lines(np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(n_docs + 1, np.int64))
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, w.base[:-1])
    line = np.searchsorted(cuts, w.starts, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))  # first word of each line
    last = np.append(first[1:], len(line)) - 1
    doc_of_word = w.doc
    doc = doc_of_word[first]
    lo, hi = w.starts[first], w.ends[last]
    n_words = (last - first + 1).astype(np.float64)
    sums = np.zeros((8, len(data) + 1), np.int32)
    for k in range(8):
        np.cumsum(_CLASS[k][data], out=sums[k, 1:])
    upper, lower, digit, symbol, mark, pipe, stop, foreign = (sums[:, hi] - sums[:, lo]).astype(np.float64)
    size = np.add.reduceat(w.ends - w.starts, first).astype(np.float64)
    longest = np.maximum.reduceat(w.ends - w.starts, first).astype(np.float64)
    hashes = w.hashes(lower=True)
    in_line = _repeats(hashes, line)
    gram = np.zeros(len(hashes), bool)
    if len(hashes) >= _GRAM:
        n = len(hashes) - _GRAM + 1
        code = textvec.Spans(hashes).hash(np.arange(n), np.arange(n) + _GRAM)
        own = doc_of_word[:n] == doc_of_word[_GRAM - 1 :]
        again = np.flatnonzero(own)[_repeats(code[own], doc_of_word[:n][own])]
        for k in range(_GRAM):
            gram[again + k] = True
    same = _repeats(textvec.Spans(hashes).hash(first, last + 1), doc)
    letters = upper + lower + foreign + 1
    shared = {
        "upper": upper / letters,
        "symbol": np.minimum(symbol / n_words, 3),
        "mark": np.minimum(mark / n_words, 3),
        "pipe": np.minimum(pipe / n_words, 2),
        "digit": digit / (size + 1),
        "repeat": np.add.reduceat(in_line, first, dtype=np.int64) / n_words,
        "gram": np.add.reduceat(gram, first, dtype=np.int64) / n_words,
        "same_line": same.astype(np.float64),
    }
    tail = data[hi - 1]
    own = {
        "words": np.log1p(n_words),
        "word_length": np.minimum(size / n_words / 5, 6),
        **shared,
        "stop": np.minimum(stop / n_words, 3),
        "ends": np.isin(tail, list(b".!?\"")).astype(float),
        "starts": ((data[lo] >= 65) & (data[lo] <= 90) | (data[lo] >= 0xC0)).astype(float),
        "foreign": foreign / letters,
        "longest": np.log1p(longest),
    }
    begin, end = np.concatenate([[True], doc[1:] != doc[:-1]]), np.concatenate([doc[1:] != doc[:-1], [True]])
    cols = [np.ones(len(first)), *(own[n] for n in NAMES)]
    for n in _SHARED:
        v = shared[n]
        cols += [(v > 0.3).astype(float), (v > 0.05).astype(float), np.where(begin, 0, np.roll(v, 1)), np.where(end, 0, np.roll(v, -1))]
    cols += [begin.astype(float), end.astype(float)]
    return Lines(np.stack(cols, 1).astype(np.float32), size, np.searchsorted(doc, np.arange(n_docs + 1)))


def _padded(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line index of each (document, step), and which are real."""
    n = np.diff(ptr)
    steps = np.arange(max(1, n.max(initial=0)))
    real = steps[None, :] < n[:, None]
    return np.where(real, ptr[:-1, None] + steps[None, :], 0), real


def _padded_blocks(ptr: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for documents of similar length together, so that a long one pads no others; those without lines are left out."""
    n, out = np.diff(ptr), []
    kinds = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))), -1)
    for kind in np.unique(kinds[n > 0]):
        group = np.flatnonzero(kinds == kind)
        steps = np.arange(n[group].max())
        real = steps[None, :] < n[group][:, None]
        out.append((np.where(real, ptr[group][:, None] + steps[None, :], ptr[group][:, None]), real))
    return out


def marginals(unary: np.ndarray, pair: np.ndarray, at: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of both labels for each padded line, and summed pair marginals, by forward-backward."""
    docs, steps = at.shape
    e = np.exp(unary - unary.max(1, keepdims=True))[at] if len(unary) else np.ones((docs, steps, 2))
    t = np.exp(pair - pair.max())
    alpha, beta = np.full((docs, steps, 2), 0.5), np.ones((docs, steps, 2))
    a = np.ones((docs, 2))
    for k in range(steps):
        step = e[:, k] * (a if k == 0 else a @ t)
        a = np.where(real[:, k, None], step / step.sum(1, keepdims=True), a)
        alpha[:, k] = a
    b = np.ones((docs, 2))
    pairs = np.zeros((2, 2))
    for k in range(steps - 1, 0, -1):
        beta[:, k] = b
        into = e[:, k] * b
        joint = alpha[:, k - 1, :, None] * t * into[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True))[real[:, k]].sum(0)
        back = into @ t.T
        b = np.where(real[:, k, None], back / back.sum(1, keepdims=True), b)
    beta[:, 0] = b
    m = alpha * beta
    return m / m.sum(2, keepdims=True), pairs


@dataclass
class Model:
    """Standardized features to two label scores, label transitions, and the final curve."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def share(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of the label good, per text; 0.5 without lines."""
        out = np.full(len(lines.ptr) - 1, 0.5)
        n = np.diff(lines.ptr)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        scores = np.clip((lines.x - self.mean) / self.scale, -6, 6) @ self.unary
        i = 0
        while i < len(order):  # documents of similar length together, so that padding stays small
            j = min(len(order), i + 256)
            while j - i > 1 and n[order[j - 1]] > 2 * n[order[i]] + 8:
                j = i + (j - i + 1) // 2
            group = order[i:j]
            steps = np.arange(n[group[-1]])
            real = steps[None, :] < n[group][:, None]
            at = np.where(real, lines.ptr[group][:, None] + steps[None, :], lines.ptr[group][:, None])
            good = marginals(scores, self.pair, at, real)[0][:, :, 1]
            weight = np.where(real, lines.weight[at], 0)
            out[group] = (good * weight).sum(1) / weight.sum(1)
            i = j
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability-like quality of each text."""
        out = np.empty(len(texts))
        for i, j in textvec.groups(texts):
            out[i:j] = self.curve(self.share(features(texts[i:j])))
        return out

    def curve(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _adam(params: list[np.ndarray], grads, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        for p, g, a, b in zip(params, grads(), m, v, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)


def fit(lines: Lines, labels: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Model:
    """A model of documents with labels 0 and 1; without documents, one that scores 0.5."""
    x = lines.x.astype(np.float64)
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(N_FEATURES)
    mean[0], scale[0] = 0, 1
    model = Model(mean, scale, np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    if not len(x):
        return model
    x = np.clip((x - mean) / scale, -6, 6)
    n = np.diff(lines.ptr)
    y = np.repeat(labels, n).astype(int)
    want = np.eye(2)[y]
    pairs = np.zeros((2, 2))
    np.fill_diagonal(pairs, [np.maximum(n - 1, 0)[labels == k].sum() for k in (0, 1)])
    # Both classes weigh the same, so that a rare one isn't ignored.
    balance = np.array([len(labels) / (2 * max(1, (labels == k).sum())) for k in (0, 1)])
    per_doc = balance[labels.astype(int)]
    blocks = _padded_blocks(lines.ptr)
    line_weight = np.repeat(per_doc, n)
    total = line_weight.sum()

    def grads():
        scores, made, gap = x @ model.unary, np.zeros((2, 2)), np.empty_like(want)
        for at, real in blocks:
            m, own = marginals(scores, model.pair, at, real)
            made += own
            gap[at[real]] = m[real]
        gap = (gap - want) * line_weight[:, None]
        return [x.T @ gap / total + ridge * model.unary, (made - pairs) / max(1.0, pairs.sum()) + ridge * model.pair]

    _adam([model.unary, model.pair], grads, steps, 0.05)
    q = np.clip(model.share(lines), 1e-4, 1 - 1e-4)
    z, curve = np.log(q / (1 - q)), np.array([1.0, 0.0])

    def curve_grads():
        p = 1 / (1 + np.exp(-(curve[0] * z + curve[1])))
        g = (p - labels) * per_doc
        return [np.array([(g * z).mean() + 1e-3 * (curve[0] - 1), g.mean()])]

    _adam([curve], curve_grads, 200, 0.05)
    model.slope, model.shift = float(max(curve[0], 1e-3)), float(curve[1])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """Fits on a bounded sample: the labelled training rows of least hash, their whole texts.

    Only ids and labels are ranked; the texts of the chosen ids (at most
    ``documents``) are joined and turned into features on the executors. Where
    their lines are more than :data:`FIT_LINES`, fewer documents are used, at
    least that of least hash. Rows with a null id, label or text are no examples.
    """
    small_batches(docs.sparkSession)
    chosen = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(documents)
    own = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            for i in range(len(b)):
                f = features([b.column("text")[i].as_py()])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, 1), "quality": b.column("quality").slice(i, 1).cast(pa.int32()), "n": pa.array([len(f.x)], pa.int64()), "x": pa.array([f.x.astype("<f4").tobytes()], pa.binary()), "w": pa.array([f.weight.tobytes()], pa.binary())})

    made = own.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, n long, x binary, w binary")
    made = Work(docs.sparkSession, "fit").save(made.withColumn("h", F.xxhash64("doc_id")), "lines")
    sizes = made.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()  # at most `documents` rows
    upto = np.cumsum([r.n for r in sizes])
    used = max(1, int(np.searchsorted(upto, FIT_LINES, "right")))
    rows = made.filter(F.col("h") <= sizes[used - 1].h).collect() if sizes else []
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.x)))
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in rows]
    ptr = np.cumsum([0, *map(len, xs)])
    lines = Lines(np.concatenate([np.zeros((0, N_FEATURES), np.float32), *xs]), np.concatenate([np.zeros(0), *(np.frombuffer(r.w) for r in rows)]), ptr)
    keep = np.diff(ptr) > 0
    if not keep.all():
        lines = Lines(lines.x, lines.weight, np.append(0, np.cumsum(np.diff(ptr)[keep])))
    return fit(lines, np.array([r.quality for r in rows], int)[keep])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null and blank texts get the score of no evidence. Narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores ``least`` or more."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            yield b.filter(pa.array(model.score(b.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, schema)
