"""Repeated passages by relative Lempel-Ziv parsing against an index of all documents.

The reference is the corpus itself, cut at content-defined places: in every
window of :data:`WINDOW` words the :data:`GRAM`-word sequence of least hash is
the anchor, and the words of all neighbouring windows with one anchor are a
reference block. Equal windows have equal anchors wherever they stand, so an
index of blocks by (anchor, content) finds every repeat with one index row for
about seven words. Each content has one place in the reference, an earlier one
than that of the block looked up (the earliest, or the earliest of its task).

A document is parsed from left to right and greedily: a factor ``(start, length,
source document, source start)`` takes one window after the other as long as the
reference holds them one after the other too; where it does not, the factor ends
and the next begins at the next window that the reference holds. Factors are at
least a window long. Where blocks share an anchor but not their whole content a
factor begins or ends; only there single windows are looked up, by two hashes,
which makes the factor boundaries exact. The words of factors are the repeated ones.

``doc_id`` null counts as the least id. Rows of equal id and text are the same
place, so neither is a repeat of the other. Null, empty and blank texts and those
below a window have no factors; no column but ``doc_id`` and ``text`` is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textvec
from quernstone.llm.shared import Work, salt_count

WINDOW = 20
GRAM = 8
#: Blocks that a task resolves among themselves before it hands over one for each content.
LOCAL_BLOCKS = 1 << 18
_NULL_ID = -(1 << 63)
_BLOCK, _MULTI, _COPY, _EXPAND, _DOC = range(5)
_SCHEMA = "kind int, ah long, eh long, doc long, th int, lo int, cnt int, sdoc long, slo int, n_words long, sha string"


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values."""
    v, at, w = values, np.arange(len(values)), 1

    def merge(v: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        left = v[:-step] <= v[step:]
        return np.where(left, v[:-step], v[step:]), np.where(left, at[:-step], at[step:])

    while 2 * w <= width:
        v, at = merge(v, at, w)
        w *= 2
    return at if w == width else merge(v, at, width - w)[1]


def blocks(words: textvec.Words, hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, text index, first window (word in its text) and windows of each block."""
    n = len(hashes)
    if n < window:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e
    doc = words.doc
    spans = textvec.Spans(hashes)
    at = np.arange(n - gram + 1)
    grams = spans.hash(at, at + gram)
    anchor = _argmin(grams, window - gram + 1)
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    anchor = anchor[start]
    if not len(start):
        return grams[:0], grams[:0], start, start, start
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last]
    text = doc[lo]
    return grams[anchor[first]], spans.hash(lo, hi + window), text, lo - words.ptr[text], hi - lo + 1


def kept_digest(text: str | None, removed: np.ndarray | None = None) -> tuple[int, int, str]:
    """Number of words, of removed words, and the SHA-256 of the words kept."""
    w = (text or "").encode("utf-8", "surrogatepass").split()  # at the white space of ASCII
    left = w if removed is None else [x for x, gone in zip(w, removed.tolist(), strict=True) if not gone]
    return len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batch(kind: int | np.ndarray, n: int, **cols) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "ah": pa.int64(), "eh": pa.int64(), "doc": pa.int64(), "th": pa.int32(), "lo": pa.int32(), "cnt": pa.int32(), "sdoc": pa.int64(), "slo": pa.int32(), "n_words": pa.int64(), "sha": pa.string()}
    cols["kind"] = np.full(n, kind, np.int32) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _resolve(ah: np.ndarray, eh: np.ndarray, doc: np.ndarray, lo: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each block is among these, sorted by anchor, content and place; and which is the first of its content.

    A later block of equal content is a copy; a first one is expanded if its
    anchor has several contents (or is marked so) and stays a block otherwise.
    """
    n = len(ah)
    new_a = np.concatenate([[True], ah[1:] != ah[:-1]])
    new_e = new_a | np.concatenate([[True], eh[1:] != eh[:-1]])
    group = np.cumsum(new_a) - 1
    contents = np.bincount(group, new_e & ~multi)
    expand = (contents > 1) | (np.bincount(group, multi) > 0)
    first = np.flatnonzero(new_e)[np.cumsum(new_e) - 1]
    same_place = (doc == doc[first]) & (lo == lo[first])
    out = np.where(new_e | same_place, np.where(expand[group], _EXPAND, _BLOCK), _COPY)
    out[np.arange(n)[multi]] = _MULTI
    return out, first


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents, resolved among themselves, and a row for each document."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        ah, eh, doc, th, lo, cnt = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((lo, doc, eh, ah))
        ah, eh, doc, th, lo, cnt = (x[order] for x in (ah, eh, doc, th, lo, cnt))
        kind, first = _resolve(ah, eh, doc, lo, np.zeros(len(ah), bool))
        kind = kind.astype(np.int32)
        # One row tells the index of an anchor with several contents here.
        a = np.flatnonzero(kind == _EXPAND)
        a = a[np.concatenate([[True], ah[a][1:] != ah[a][:-1]])] if len(a) else a
        extra = _batch(_MULTI, len(a), ah=_signed(ah[a]), eh=np.zeros(len(a), np.int64), doc=np.zeros(len(a), np.int64), th=np.zeros(len(a), np.int32), lo=np.zeros(len(a), np.int32), cnt=np.zeros(len(a), np.int32))
        # Among equal places of repeated rows one index row is enough.
        once = np.concatenate([[True], (ah[1:] != ah[:-1]) | (eh[1:] != eh[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]) | (th[1:] != th[:-1])])
        keep = np.sort(order[once])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        k = back[keep]  # in reading order, which packs ids well
        own = _batch(kind[k], len(k), ah=_signed(ah[k]), eh=_signed(eh[k]), doc=doc[k], th=th[k], lo=lo[k].astype(np.int32), cnt=cnt[k].astype(np.int32), sdoc=doc[first[k]], slo=lo[first[k]].astype(np.int32))
        return pa.Table.from_batches([own, extra]).combine_chunks().to_batches()[0]

    size = 0
    for b in textvec.slices(batches):
        texts, docs, ths = b.column("text").to_pylist(), b.column("doc").to_numpy(), b.column("th").to_numpy()
        for i, j in textvec.groups(texts):
            w = textvec.words(texts[i:j])
            ah, eh, text, lo, cnt = blocks(w, w.hashes())
            if len(ah):
                held.append((ah, eh, docs[i:j][text], ths[i:j][text], lo, cnt))
                size += len(ah)
            rows = [kept_digest(t) for t in texts[i:j]]
            yield _batch(_DOC, j - i, doc=docs[i:j], th=ths[i:j], n_words=[r[0] for r in rows], sha=[r[2] for r in rows])
            if size >= LOCAL_BLOCKS:
                yield flush()
                size = 0
    if held:
        yield flush()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Resolves blocks sorted by anchor, content and place; emits copies and blocks to expand."""
    names, held = ("ah", "eh", "doc", "lo", "multi", "th", "cnt"), None

    def settle(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        kind, first = _resolve(c["ah"], c["eh"], c["doc"], c["lo"], c["multi"])
        k = np.flatnonzero((kind == _COPY) | (kind == _EXPAND))
        cols = [pa.array(c[n][k], t) for n, t in (("doc", pa.int64()), ("th", pa.int32()), ("lo", pa.int32()), ("cnt", pa.int32()))]
        cols += [pa.array(kind[k] == _EXPAND), pa.array(c["doc"][first[k]]), pa.array(c["lo"][first[k]], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "th", "lo", "cnt", "expand", "sdoc", "slo"])

    for b in batches:
        if not len(b):
            continue
        new = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in names}
        cut = int(np.searchsorted(held["ah"], held["ah"][-1]))  # the last anchor may go on
        if cut:
            yield settle({n: x[:cut] for n, x in held.items()})
            held = {n: x[cut:] for n, x in held.items()}
    if held is not None and len(held["ah"]):
        yield settle(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes and the place of every window of the blocks to expand."""
    for b in textvec.slices(batches):
        texts = b.column("text").to_pylist()
        marks = b.column("marks").to_pylist()
        for i, j in textvec.groups(texts):
            w = textvec.words(texts[i:j])
            h = w.hashes()
            if not len(h):
                continue
            one, two = textvec.Spans(h), textvec.Spans(textvec.mix(h ^ np.uint64(0x5BD1E995)))
            for k in range(i, j):
                own = [np.arange(m["lo"], m["lo"] + m["cnt"]) for m in marks[k] if m["expand"]]
                if own:
                    at = np.concatenate(own)
                    s = at + w.ptr[k - i]
                    n = len(at)
                    yield pa.RecordBatch.from_pydict({"w1": _signed(one.hash(s, s + WINDOW)), "w2": _signed(two.hash(s, s + WINDOW)), "doc": pa.array(np.full(n, b.column("doc")[k].as_py())), "th": pa.array(np.full(n, b.column("th")[k].as_py(), np.int32)), "at": pa.array(at.astype(np.int32))})


def parse(marks: list[dict] | None, again: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The factors of a document: first word, words, source document and first word there, from left to right.

    ``marks`` are blocks and ``again`` single windows with their places in the
    reference. A factor goes on while its next window is next in the reference too.
    """
    blocks = [m for m in marks or () if not m["expand"]]
    lo, cnt, sdoc, slo = (np.array([m[c] for m in blocks], np.int64) for c in ("lo", "cnt", "sdoc", "slo"))
    step = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    one = (np.array([m[c] for m in again or ()], np.int64) for c in ("at", "sdoc", "sat"))
    at, doc, place = (np.concatenate(x) for x in zip((np.repeat(lo, cnt) + step, np.repeat(sdoc, cnt), np.repeat(slo, cnt) + step), one, strict=True))
    order = np.argsort(at, kind="stable")
    at, doc, place = at[order], doc[order], place[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(place) != 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    return at[first], windows + WINDOW - 1, doc[first], place[first]


def _mask(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of ``n`` words a factor covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _original(doc: str = "doc") -> Column:
    return F.when(F.col(doc) != _NULL_ID, F.col(doc)).alias("doc_id")


def repeated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without a factor (``doc, th, n_words, sha``), and the others with text and factors.

    The second table has ``doc, th, text, marks`` (blocks) and ``again`` (single
    repeated windows at factor boundaries), both with places in the reference.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "substrings")
    parts = salt_count(spark)
    keyed = df.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = keyed.select("doc", "th", "text").mapInArrow(_parse, _SCHEMA)
    path = f"{work.path}/parsed"
    parsed.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
    parsed = spark.read.schema(_SCHEMA).parquet(path)
    index = parsed.filter(F.col("kind").isin(_BLOCK, _MULTI)).select("ah", "eh", "doc", "lo", (F.col("kind") == _MULTI).alias("multi"), "th", "cnt")
    index = index.repartition(parts, "ah").sortWithinPartitions("ah", "eh", "doc", "lo")
    marks = work.save(index.mapInArrow(_index, "doc long, th int, lo int, cnt int, expand boolean, sdoc long, slo int"), "marks")
    work.drop(f"parsed/kind={_BLOCK}", f"parsed/kind={_MULTI}")
    local = parsed.filter(F.col("kind").isin(_COPY, _EXPAND)).select("doc", "th", "lo", "cnt", (F.col("kind") == _EXPAND).alias("expand"), "sdoc", "slo")
    # Sets, as rows of one id and text in several tasks have the same marks.
    by_doc = marks.union(local).groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "cnt", "expand", "sdoc", "slo")).alias("marks"))
    marked = work.save(keyed.join(by_doc, ["doc", "th"]), "marked")
    windows = marked.filter(F.exists("marks", lambda m: m["expand"])).mapInArrow(_windows, "w1 long, w2 long, doc long, th int, at int")
    windows = work.save(windows.distinct(), "windows")
    place = F.struct("doc", "at")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = windows.join(earliest, ["w1", "w2"]).filter(place > F.col("first"))
    again = again.groupBy("doc", "th").agg(F.collect_set(F.struct("at", F.col("first.doc").alias("sdoc"), F.col("first.at").alias("sat"))).alias("again"))
    plain = parsed.filter(F.col("kind") == _DOC).select("doc", "th", "n_words", "sha").join(marked.select("doc", "th"), ["doc", "th"], "left_anti")
    return plain, marked.join(again, ["doc", "th"], "left")


def digest_rows(df: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``df(doc_id, text)``; a null text counts as empty."""
    plain, factored = repeated(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            rows = []
            for text, marks, again in zip(*(b.column(c).to_pylist() for c in ("text", "marks", "again")), strict=True):
                n = len(text.encode("utf-8", "surrogatepass").split())
                rows.append(kept_digest(text, _mask(n, *parse(marks, again)[:2])))
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([r[2] for r in rows], pa.string())})

    some = factored.select("doc", "text", "marks", "again").mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string")
    none = plain.select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return some.union(none).select(_original(), "n_words", "n_removed", "kept_sha256")


def factors(df: DataFrame) -> DataFrame:
    """The factors ``doc_id, start, length, source_id, source_start`` (in words) of every document.

    A factor equals the words at its source, which starts earlier; neighbouring
    factors of different sources may overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.empty((5, 0), np.int64)]
            for doc, marks, again in zip(*(b.column(c).to_pylist() for c in ("doc", "marks", "again")), strict=True):
                f = parse(marks, again)
                out.append(np.stack([np.full(len(f[0]), doc), *f]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], names=["doc", "start", "length", "source", "source_start"])

    found = repeated(df)[1].select("doc", "marks", "again").mapInArrow(run, "doc long, start long, length long, source long, source_start long")
    return found.select(_original(), "start", "length", _original("source").alias("source_id"), "source_start")
