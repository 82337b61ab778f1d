"""Problem 7: passages of held-out items inside a training corpus, by latent semantic retrieval and an exact check.

1. *Coding.*  Every text is cut into words once and written as numbers of the items' vocabulary; the later steps read this
   narrow table.  The same pass counts in how many of all passages (``window`` words every ``stride``) each term occurs.
2. *Distributed randomised SVD.*  With A the TF-IDF matrix of all passages (corpus and items) and a seeded Gaussian test
   matrix G, every task adds up its rows' share of ``A.T @ (A @ G)`` (terms x rank; this is the sketch with one power step);
   its QR gives Q.  A second pass adds up ``(A @ Q).T @ (A @ Q)`` (rank x rank), whose eigenvalues are the squared singular
   values of A on that range; the basis is Q turned to the right singular vectors, of which those with ``energy`` of the
   sum are kept.  Shares are summed in a tree, so neither a task nor the driver gets one share of every task.
3. *Cosine candidates.*  Passages of documents and of items are projected on the basis; an item is a candidate for a
   document where a cosine of two passages reaches ``least_cosine``.  A passage of documents with fewer than ``least_known``
   words of the item vocabulary is not projected: it cannot hold a run that the check accepts.
4. *Candidates by shared words.*  No cosine above zero is sure for every run the check accepts: what stands beside a run in
   its passage can weigh more than the run.  So an item is also a candidate where the document shares ``least_exact`` words
   in a row with it as often as every accepted run does (edits part it into few pieces).  Whatever the cosine search misses
   is found here; ``least_cosine`` bears on no result.
5. *Check.*  A longest-common-subsequence alignment decides exactly: some run of at least ``least_words`` item words must
   occur in order, with at most one word in ten changed, dropped or added.  Every stretch with shared words is aligned, many
   at once.

The items go to the tasks as constants, at most ``max_items`` at a time; more are searched in parts.

Defined results: null or empty texts and items hold nothing; items shorter than ``least_words`` cannot leak; repeated
documents are reported under each id; an empty corpus gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import cut, scan, ship, table

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Settings:
    window: int = 24
    stride: int = 8  # a divisor of the window
    item_stride: int = 2
    rank: int = 192
    energy: float = 0.999
    seed: int = 7
    least_words: int = 16
    one_in: int = 10
    least_known: int = 12
    least_cosine: float = 0.75
    max_items: int = 50_000


@dataclass
class Items:
    """The held-out items, their vocabulary and their passages (lists of term numbers)."""

    ids: list[int]
    words: list[list[str]]
    settings: Settings
    terms: dict[str, int] = field(default_factory=dict)
    coded: list[np.ndarray] = field(default_factory=list)
    owner: np.ndarray | None = None
    passages: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for ws in self.words:
            self.coded.append(np.array([self.terms.setdefault(w, len(self.terms)) for w in ws], np.int32))
        owner, n = [], self.settings.least_words
        for k, c in enumerate(self.coded):
            for a in sorted({*range(0, len(c) - n + 1, self.settings.item_stride), len(c) - n}) if len(c) >= n else ():
                owner.append(k)
                self.passages.append(c[a : a + n])
        self.owner = np.array(owner, np.int32)


@dataclass
class Texts:
    """Coded documents laid end to end, each with at least one -1 after it and filled up to whole strides."""

    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    blocks: np.ndarray  # first stride of each passage
    owner: np.ndarray  # the document of each passage


def lay(coded: list[np.ndarray], window: int, stride: int) -> Texts:
    """Passages begin every ``stride`` words, so that every run of ``window - stride + 1`` words lies inside one."""
    size = np.array([len(c) for c in coded], np.int64)
    room = np.maximum((size // stride + 1) * stride, window)
    begin = np.cumsum(room) - room
    flat = np.full(int(room.sum()) + window, -1, np.int32)
    if len(coded):
        flat[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(coded)
    n = np.where(size > 0, 1 + -(-np.maximum(size - window, 0) // stride), 0)
    owner = np.repeat(np.arange(len(coded)), n)
    blocks = np.repeat(begin // stride, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return Texts(flat, begin, size, blocks, owner)


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rows of a terms x rank table times their term's weight, and a last row of zeros for unknown words (-1)."""
    return np.vstack([table * idf[:, None], np.zeros((1, table.shape[1]), table.dtype)]).astype(np.float32)


def by_stride(flat: np.ndarray, rows: np.ndarray, stride: int, at_once: int = 1 << 11) -> np.ndarray:
    """Sums of the rows of each stride's words; each word is looked up once however many passages it is in."""
    words = flat[: len(flat) // stride * stride].reshape(-1, stride)
    return np.concatenate([rows[words[a : a + at_once]].sum(1) for a in range(0, len(words), at_once)] or [np.zeros((0, rows.shape[1]), np.float32)])


def project(t: Texts, rows: np.ndarray, s: Settings) -> np.ndarray:
    """TF-IDF rows of the passages times a table; no TF-IDF row is ever dense."""
    sums = by_stride(t.flat, rows, s.stride)
    return sum((sums[t.blocks + k] for k in range(s.window // s.stride)), np.zeros((len(t.blocks), rows.shape[1]), np.float32))


def sketch(t: Texts, y: np.ndarray, idf: np.ndarray, into: np.ndarray, s: Settings) -> None:
    """Add ``A.T @ y`` of the passages to ``into`` (terms x rank)."""
    per = np.zeros((len(t.flat) // s.stride, y.shape[1]), np.float32)
    for k in range(s.window // s.stride):
        per[t.blocks + k] += y  # a stride is the k-th of one passage at most
    for a in range(0, len(per) * s.stride, 1 << 16):
        terms = t.flat[a : a + (1 << 16)]
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 0) :]
        order = order[(order + a) // s.stride < len(per)]
        if len(order):
            kept = terms[order]
            first = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
            into[kept[first]] += np.add.reduceat(per[(order + a) // s.stride], first) * idf[kept[first], None]


def frequencies(t: Texts, n_terms: int, s: Settings) -> np.ndarray:
    """How many passages have each term, and last how many passages there are."""
    out = np.zeros(n_terms + 1, np.float64)
    for a in range(0, len(t.blocks), 1 << 14):
        w = np.sort(t.flat[t.blocks[a : a + (1 << 14), None] * s.stride + np.arange(s.window)], 1)
        own = (w >= 0) & np.c_[np.ones(len(w), bool), w[:, 1:] != w[:, :-1]]
        out[:n_terms] += np.bincount(w[own], minlength=n_terms)
    out[n_terms] = len(t.blocks)
    return out


_CODED = "doc_id long, codes binary, counts binary"


def _code(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, v = items.settings, len(items.terms)
        counts = np.zeros(v + 1)
        names = ["doc_id", "codes", "counts"]
        for batch in batches:
            coded = [np.array([items.terms.get(w, -1) for w in words_of(text)], np.int32) for text in batch.column("text").to_pylist()]
            counts += frequencies(lay(coded, s.window, s.stride), v, s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.tobytes() for c in coded], pa.binary()), pa.nulls(len(coded), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return run


def _laid(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[list[int], Texts]]:
    """Slices of coded documents, of some ten thousand words each."""
    for batch in batches:
        codes = [np.frombuffer(c, np.int32) for c in batch.column("codes").to_pylist()]
        ids = batch.column("doc_id").to_pylist()
        begin = size = 0
        for end, c in enumerate(codes, 1):
            size += len(c)
            if size > 1 << 16 or end == len(codes):
                yield ids[begin:end], lay(codes[begin:end], s.window, s.stride)
                begin, size = end, 0


def _share(settings: Settings, shape: tuple[int, int], add, rows_at_once: int = 4096):
    """One share of a matrix a task, in chunks of its rows: ``add(texts, into)`` takes in a slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(shape)
        for _, texts in _laid(batches, settings):
            add(texts, into)
        chunks = [into[a : a + rows_at_once].tobytes() for a in range(0, shape[0], rows_at_once)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "share"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, share in zip(batch.column("chunk").to_pylist(), batch.column("share").to_pylist()):
            total[chunk] = total[chunk] + np.frombuffer(share) if chunk in total else np.frombuffer(share)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "share"])


def tree_sum(shares: DataFrame, columns: int, rows: int) -> np.ndarray:
    """The sum of all tasks' shares: over about the square root of as many tasks, then by chunk."""
    schema = "chunk int, share binary"
    fan = max(1, int(shares.rdd.getNumPartitions() ** 0.5))
    part = shares.repartition(fan).mapInArrow(_add_up, schema)
    got = part.repartition(min(fan, 1 + rows // 4096), "chunk").mapInArrow(_add_up, schema).collect()  # one row a chunk
    return np.concatenate([np.frombuffer(r.share) for r in sorted(got, key=lambda r: r.chunk)]).reshape(-1, columns) if got else np.zeros((rows, columns))


def test_matrix(n_terms: int, s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).standard_normal((n_terms, min(s.rank, n_terms))).astype(np.float32)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def holds_runs(items: list[np.ndarray], docs: list[np.ndarray], least: int, one_in: int) -> np.ndarray:
    """For each pair, whether some run of at least ``least`` item words occurs in the document's words in order with at most
    one edit in ``one_in`` words.

    ``best[p, e]`` holds, for a row of the alignment of pair p, the most item words of a run that ends there with e edits at
    most.  Pairs are filled up to one size; nothing beyond an item's end counts.
    """
    sizes = np.array([len(i) for i in items])
    rows, width = sizes.max(), max(len(d) for d in docs)
    a, b = np.full((len(items), rows), -2, np.int32), np.full((len(docs), width), -3, np.int32)
    for p, (i, d) in enumerate(zip(items, docs)):
        a[p, : len(i)], b[p, : len(d)] = i, d
    edits = int(rows) // one_in
    need = np.maximum(least, one_in * np.arange(edits + 1))[None, :, None]
    best = np.zeros((len(items), edits + 1, width + 1), np.int16 if rows < 30_000 else np.int32)
    found = np.zeros(len(items), bool)
    for i in range(rows):
        now = np.zeros_like(best)
        now[:, :, 1:] = np.where((a[:, i, None] == b)[:, None, :], best[:, :, :-1] + 1, 0)
        if edits:
            np.maximum(now[:, 1:, 1:], best[:, :-1, :-1] + 1, out=now[:, 1:, 1:])  # changed
            np.maximum(now[:, 1:], best[:, :-1] + 1, out=now[:, 1:])  # dropped
            for e in range(1, edits + 1):
                np.maximum(now[:, e, 1:], now[:, e - 1, :-1], out=now[:, e, 1:])  # added
        found |= (now >= need).any((1, 2)) & (i < sizes)
        best = now
    return found


def gram_keys(coded: np.ndarray, n: int) -> np.ndarray:
    if len(coded) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(coded) - n + 1, np.int64)
    known = np.ones(len(out), bool)
    for k in range(n):
        part = coded[k : k + len(out)]
        out = out * np.int64(1_000_003) + part + 1
        known &= part >= 0
    return np.where(known, out, -1 - np.arange(len(out)))


def least_exact(longest: int, least: int, one_in: int) -> int:
    """Words in a row that any accepted run must share exactly, for runs of up to ``longest`` words."""
    return min((-(-(n - n // one_in) // (n // one_in + 1)) for n in range(least, longest + 1)), default=1)


def least_shared(longest: int, least: int, one_in: int, n: int) -> int:
    """How many stretches of n words any accepted run of up to ``longest`` words must share: e edits leave e + 1 pieces, of
    which each has n - 1 fewer stretches than words."""
    return max(1, min(((k - k // one_in) - (n - 1) * (k // one_in + 1) for k in range(least, longest + 1)), default=1))


class Checker:
    """The exact check of candidates."""

    def __init__(self, items: Items):
        s = items.settings
        self.items, self.s = items, s
        usable = [len(c) >= s.least_words for c in items.coded]
        self.n = [least_exact(len(c), s.least_words, s.one_in) for c in items.coded]
        self.least = np.array([least_shared(len(c), s.least_words, s.one_in, n) for c, n in zip(items.coded, self.n)] or [1])
        self.reach = np.array([len(c) + len(c) // s.one_in + 1 for c in items.coded] or [1])
        grams = [np.unique(gram_keys(c, n)) for c, n in zip(items.coded, self.n)]
        self.index = {}
        for n in sorted({n for n, ok in zip(self.n, usable) if ok}):
            own = [k for k, ok in enumerate(usable) if ok and self.n[k] == n]
            keys = np.concatenate([grams[k] for k in own])
            order = np.argsort(keys, kind="stable")
            self.index[n] = keys[order], np.repeat(own, [len(grams[k]) for k in own])[order]

    def stretches(self, t: Texts) -> list[tuple[int, int, int, int]]:
        """``document, item, from, to`` of every stretch that can hold a run; two unlike stretches with one key only add to
        them."""
        out: list[tuple[int, int, int, int]] = []
        doc_of = np.repeat(np.arange(len(t.begin)), np.diff(np.r_[t.begin, len(t.flat)]))
        for n, (keys, owner) in self.index.items():
            own = gram_keys(t.flat, n)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            at = np.repeat(np.arange(len(own)), hi - lo)
            if not len(at):
                continue
            item = owner[np.repeat(lo, hi - lo) + np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            order = np.lexsort((at, item, doc_of[at]))
            at, item = at[order], item[order]
            doc = doc_of[at]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > self.reach[item[1:]])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(at)] - 1
            many = last - first + 1 >= self.least[item[first]]
            for f, l in zip(first[many].tolist(), last[many].tolist()):  # noqa: E741
                k, d = int(item[f]), int(doc[f])
                out.append((d, k, max(int(t.begin[d]), int(at[f] - self.reach[k])), min(int(t.begin[d] + t.size[d]), int(at[l] + n + self.reach[k]))))
        return out

    def leaks(self, t: Texts, cells: int = 1 << 21) -> set[tuple[int, int]]:
        """``document, item`` of every leak."""
        found: set[tuple[int, int]] = set()
        todo = sorted(self.stretches(t), key=lambda x: (len(self.items.coded[x[1]]), x[3] - x[2]))
        while todo:
            rows, width = len(self.items.coded[todo[-1][1]]), max(x[3] - x[2] for x in todo[-64:])
            part = todo[-max(1, min(64, cells // ((rows // self.s.one_in + 1) * (width + 1)))) :]
            del todo[-len(part) :]
            hit = holds_runs([self.items.coded[k] for _, k, _, _ in part], [t.flat[a:b] for _, _, a, b in part], self.s.least_words, self.s.one_in)
            found.update((d, k) for (d, k, _, _), h in zip(part, hit) if h)
        return found


class Retriever:
    """Cosine search of passages among the items' passages."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.s, self.rows = items, items.settings, weighted(basis, idf)
        square = np.stack(items.passages) if items.passages else np.zeros((0, 1), np.int32)
        self.latent = unit(np.concatenate([self.rows[square[a : a + 1024]].sum(1) for a in range(0, len(square), 1024)] or [np.zeros((0, basis.shape[1]), np.float32)]))

    def candidates(self, t: Texts) -> dict[tuple[int, int], float]:
        """The best cosine of each ``document, item`` that reaches the threshold."""
        s = self.s
        known = by_stride(t.flat, np.r_[np.ones((len(self.rows) - 1, 1), np.float32), [[0]]].astype(np.float32), s.stride)[:, 0]
        enough = sum(known[t.blocks + k] for k in range(s.window // s.stride)) >= s.least_known
        z = unit(project(t, self.rows, s)[enough])
        of = t.owner[enough]
        best: dict[tuple[int, int], float] = {}
        for a in range(0, len(z), 512):
            cosine = z[a : a + 512] @ self.latent.T
            r, c = np.nonzero(cosine >= s.least_cosine)
            for d, k, x in zip(of[a + r].tolist(), self.items.owner[c].tolist(), cosine[r, c].tolist()):
                if x > best.get((d, k), 0.0):
                    best[d, k] = x
        return best


def _search(items: Items, idf: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        retriever, checker = Retriever(items, idf, basis), Checker(items)
        for ids, texts in _laid(batches, items.settings):
            best = retriever.candidates(texts)
            found = [(items.ids[k], ids[d], best.get((d, k))) for d, k in sorted(checker.leaks(texts))]
            if found:
                a, b, c = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["item_id", "doc_id", "cosine"])

    return run


def load_items(items: DataFrame, settings: Settings) -> Iterator[Items]:
    """The items on the driver, at most ``max_items`` at a time."""
    rows = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = -(-rows.count() // settings.max_items)
    for i in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else rows
        got = own.orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in got], [words_of(r.text) for r in got], settings)


def fit_basis(coded: DataFrame, held: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IDF of each term, the right singular vectors kept (terms x components), and all singular values."""
    v, s = len(held.terms), held.settings
    texts = coded.where(F.col("codes").isNotNull()).select("doc_id", "codes")
    counts = coded.where(F.col("counts").isNotNull()).select(F.lit(0).alias("chunk"), F.col("counts").alias("share"))
    n = tree_sum(counts, v + 1, 1)[0]
    own = lay(held.passages, s.window, s.stride)
    n += frequencies(own, v, s)
    idf = np.log((1 + n[v]) / (1 + n[:v])).astype(np.float32) + 0.1
    test = weighted(test_matrix(v, s), idf)
    add = lambda t, into: sketch(t, project(t, test, s), idf, into, s)
    total = tree_sum(texts.mapInArrow(_share(s, (v, test.shape[1]), add), "chunk int, share binary"), test.shape[1], v)
    add(own, total := total.copy())
    q = np.linalg.qr(total)[0].astype(np.float32)
    turned = weighted(q, idf)

    def gram(t: Texts, into: np.ndarray) -> None:
        z = project(t, turned, s)
        into += z.T @ z

    square = tree_sum(texts.mapInArrow(_share(s, (q.shape[1], q.shape[1]), gram), "chunk int, share binary"), q.shape[1], q.shape[1]).copy()
    gram(own, square)
    values, vectors = np.linalg.eigh(square)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    kept = min(len(values), 1 + int(np.searchsorted(np.cumsum(values), s.energy * values.sum())))
    return idf, (q @ vectors[:, :kept]).astype(np.float32), np.sqrt(values)


def find_leaks(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``item_id, doc_id, cosine`` of every document that holds a passage of an item; the cosine is null where the search by
    cosine missed the pair."""
    ship(docs.sparkSession)
    schema = "item_id long, doc_id long, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for held in load_items(items, settings or Settings()):
        if held.passages:
            coded = cut(rows.mapInArrow(_code(held), _CODED), "coded")
            idf, basis, _ = fit_basis(coded, held)
            out = out.unionByName(coded.where(F.col("codes").isNotNull()).select("doc_id", "codes").mapInArrow(_search(held, idf, basis), schema))
    return out


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(scan(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_item")).select("item_id", "doc_id").distinct()
