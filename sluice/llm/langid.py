"""Problem 9: the language, with a confidence, of each document and of each of its paragraphs.

Prediction by partial matching: each language has a tree of byte contexts of order 0 to ``ORDER`` with symbol counts; a byte
costs the code length of its symbol in the longest context that has it, plus the escapes (method C: as likely as the
context has different symbols) of the longer contexts that were seen without it.  After training the statistics are
frozen into one table: each byte string seen has, for every language, the cost of its last byte after the others and
the escape cost it has as a context.  A paragraph gets the language with the least total code length.

Training is on a bounded sample: about ``per_language`` labelled documents of each language (in the order of a seeded hash,
so anywhere in the corpus and the same in every run), reduced to the blocks that look like their label (``purify``), which
drops wrong labels.  Nothing else is used; no held-out text of another problem enters.  Scoring is one Python stage over
all whole texts; only the table is sent.

The confidence is the posterior of the best language under equal priors, each bit counted as ``temper`` bits, the temper
being the one under which held-out pieces of the sample are likeliest (``calibrate``).

Defined results: a block without letters outside markup, JSON, code and numbers has null language and confidence 0, and
so has prose with many bytes that no language has (a script none of the labels has; prose of an unknown language in a known
script is given to the nearest one); a null text has no paragraphs; an empty text is one block without
language; a document has the language most of its bytes of prose have, null if none; labels are read in any spelling (case,
region, two-letter and three-letter codes, names in five languages and in their own), others name none.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import bind
from sluice.session import scan, ship

ORDER = 4
#: Confidence where nothing is held out to calibrate it.
TEMPER = 0.02
#: Prose with more than this part of bytes that no language has is in none of them.
STRANGE = 0.25

# Bibliographic three-letter codes, where they are not the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is",
    "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
# Spellings that no code table has.
SPELLINGS = {"castellano": "es", "castilian": "es", "francais": "fr", "espanol": "es", "portugues": "pt", "farsi": "fa", "flemish": "nl", "in": "id", "iw": "he", "ji": "yi"}
_names: dict[str, str] = {}


def language_names(spark: SparkSession) -> dict[str, str]:
    """Code of each way a language can be named, in lower case: its two-letter and three-letter codes, and its name in English,
    French, German, Spanish and in itself, from the language tables of the session's JVM."""
    if not _names:
        locale = spark.sparkContext._jvm.java.util.Locale
        readers = [locale.forLanguageTag(t) for t in ("en", "fr", "de", "es")]
        for code in locale.getISOLanguages():
            own = locale.forLanguageTag(code)
            code = SPELLINGS.get(code, code)
            for name in (own.getISO3Language(), *(own.getDisplayLanguage(r) for r in (*readers, own))):
                _names.setdefault(name.lower(), code)
            _names[code] = code
        _names.update(BIBLIOGRAPHIC)
        _names.update(SPELLINGS)
        _names.pop("", None)
    return _names


def label_language(label: Column) -> Column:
    """The two-letter code a label names, in whatever spelling; null if it names none."""
    names = language_names(SparkSession.active())
    codes = sorted(c for c, of in names.items() if c == of)
    others = {n: c for n, c in names.items() if n != c}
    listed = lambda xs: F.split(F.lit("\x01".join(xs)), "\x01")
    table = F.map_from_arrays(listed(others), listed(others.values()))  # a constant
    low = F.lower(F.trim(label))
    head = F.regexp_extract(low, r"^([^\s_-]+)(?:[_-].*)?$", 1)
    return F.when(head.isin(codes), head).otherwise(F.coalesce(F.try_element_at(table, head), F.try_element_at(table, low)))


_NOISE = re.compile(r"`[^`]*`|<[^<>]*>|https?://[!-~]*|[!-~]*[@/=_{}\\][!-~]*|\b[A-Z]-?\d+\b|[\d#*|>+-]+")
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s+")


def prose(block: str) -> str:
    """What a block holds besides markup, JSON, code and numbers, in lower case; empty if that has no letters."""
    if block.lstrip()[:1] in ("{", "["):
        try:
            json.loads(block)
            return ""
        except (ValueError, RecursionError):
            pass
    kept = _SPACE.sub(" ", _NOISE.sub(" ", block)).strip().lower()
    return kept if _LETTER.search(kept) else ""


@dataclass
class Model:
    """The frozen statistics of all languages."""

    languages: list[str]
    keys: np.ndarray  # open addressing: 0 is free
    rows: np.ndarray
    cost: np.ndarray  # row x language: what the last byte costs after the others, escapes included
    escape: np.ndarray  # row x language, 0 where it was not seen as a context; the last row is zero
    root: np.ndarray  # what a byte costs that was never seen
    bytes_seen: np.ndarray  # whether any language has each byte
    temper: float = TEMPER


_MUL = np.uint64(0x9E3779B97F4A7C15)
_PAD = b"\n" * (ORDER + 1)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """For length 1 to ORDER + 1, a key of the string that ends at each byte."""
    out = []
    h = np.full(len(data), 0x1234567, np.uint64)
    for k in range(ORDER + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[k:] = data[: len(data) - k] if k else data
        h = (h ^ (shifted + np.uint64(1))) * _MUL
        h ^= h >> np.uint64(29)
        out.append(np.maximum(h + np.uint64(k), np.uint64(1)))
    return out


def _join(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All blocks as bytes, each after padding; and the place where each begins and ends."""
    encoded = [b.encode("utf-8", "replace") for b in blocks]
    data = np.frombuffer(_PAD + b"".join(e + _PAD for e in encoded), np.uint8)
    lens = np.array([len(e) for e in encoded], np.int64)
    starts = np.cumsum(lens + len(_PAD)) - lens
    return data, np.stack([starts, starts + lens], 1)


def train(texts: dict[str, list[str]]) -> Model:
    """Frozen context trees of all languages from blocks of prose."""
    languages = sorted(texts)
    counted: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    parents: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]  # per order: key, key of its context, key of its suffix
    for lang in languages:
        data, spans = _join(texts[lang])
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, spans[:, 0], 1)
        np.add.at(inside, spans[:, 1], -1)
        mask = np.cumsum(inside)[:-1] > 0
        mine, shorter = [], np.zeros(len(data), np.uint64)
        for k, key in enumerate(_grams(data)):
            context = np.zeros_like(key)
            context[1:] = shorter[:-1]
            u, first, n = np.unique(key[mask], return_index=True, return_counts=True)
            own = context[mask][first]
            mine.append((u, n, own))
            parents[k].append(np.stack([u, own, shorter[mask][first]]))
            shorter = key
        counted.append(mine)
    every = np.unique(np.concatenate([p[:2].ravel() for ps in parents for p in ps] or [np.zeros(0, np.uint64)]))
    every = every[every != 0]
    cost = np.full((len(every) + 1, len(languages)), np.nan, np.float32)
    escape = np.zeros((len(every) + 1, len(languages)), np.float32)
    root = np.full(len(languages), 8.0, np.float32)
    for j, mine in enumerate(counted):
        for k, (u, n, context) in enumerate(mine):
            contexts, at = np.unique(context, return_inverse=True)
            total, different = np.bincount(at, n), np.bincount(at)
            cost[np.searchsorted(every, u), j] = np.log2((total + different)[at] / n)
            leave = np.log2((total + different) / np.maximum(different, 1))
            if k == 0:
                root[j] += leave[0] if len(leave) else 0
            else:
                escape[np.searchsorted(every, contexts), j] = leave
    for k, ps in enumerate(parents):  # shorter strings first: a language that has not seen a string falls back on its suffix
        if ps:
            u, context, suffix = np.concatenate(ps, 1)
            u, first = np.unique(u, return_index=True)
            row = np.searchsorted(every, u)
            back = root if k == 0 else escape[np.searchsorted(every, context[first])] + cost[np.searchsorted(every, suffix[first])]
            cost[row] = np.where(np.isnan(cost[row]), back, cost[row])
    keys, rows = _table(every)
    seen = np.zeros(256, bool)
    for blocks in texts.values():
        for b in blocks:
            seen[np.frombuffer(b.encode("utf-8", "replace"), np.uint8)] = True
    return Model(languages, keys, rows, cost, escape, root, seen)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _MUL) >> np.uint64(64 - bits)).astype(np.int64)


def _table(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = max(4, int(np.ceil(np.log2(max(len(every), 1) * 2 + 1))))
    keys, rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(every), np.int32)
    left, place = np.arange(len(every)), _slot(every, bits)
    while len(left):
        free = keys[place] == 0
        slots, first = np.unique(place[free], return_index=True)
        won = left[free][first]
        keys[slots], rows[slots] = every[won], won
        lost = ~np.isin(left, won)
        left, place = left[lost], (place[lost] + 1) & ((1 << bits) - 1)
    return keys, rows


def _find(model: Model, key: np.ndarray) -> np.ndarray:
    """The row of each key, or the last row (nothing known)."""
    bits = len(model.keys).bit_length() - 1
    place = _slot(key, bits)
    got = np.full(len(key), len(model.cost) - 1, np.int32)
    todo = np.arange(len(key))
    while len(todo):
        have = model.keys[place]
        hit = have == key[todo]
        got[todo[hit]] = model.rows[place[hit]]
        on = ~hit & (have != 0)
        todo, place = todo[on], (place[on] + 1) & (len(model.keys) - 1)
    return got


def code_lengths(model: Model, blocks: list[str], at_once: int = 1 << 16) -> np.ndarray:
    """Bits of each block (rows) under each language (columns).

    The row of the longest string seen holds the cost with all fallbacks; only bytes whose long strings no language has seen
    are looked up in shorter ones.
    """
    out = np.zeros((len(blocks), len(model.languages)))
    data, spans = _join(blocks)
    unknown = len(model.cost) - 1
    for begin in range(len(_PAD), len(data), at_once):  # stretches of bytes, each read with the contexts before it
        end = min(begin + at_once, len(data))
        lead = begin - len(_PAD)
        a, b = np.searchsorted(spans[:, 1], begin, "right"), np.searchsorted(spans[:, 0], end)  # blocks that reach into it
        own = [(i, max(s, begin) - lead, min(e, end) - lead) for i, (s, e) in zip(range(a, b), spans[a:b].tolist()) if s < e]
        if not own:
            continue
        grams = _grams(data[lead:end])
        todo = np.concatenate([np.arange(s, e) for _, s, e in own])
        bits = np.zeros((len(todo), len(model.languages)), np.float32)
        left = np.arange(len(todo))
        for k in range(ORDER, -1, -1):
            row = _find(model, grams[k][todo[left]])
            seen = row != unknown
            bits[left[seen]] += model.cost[row[seen]]
            left = left[~seen]
            if not len(left):
                break
            bits[left] += model.escape[_find(model, grams[k - 1][todo[left] - 1])] if k else model.root
        firsts = np.cumsum([0] + [e - s for _, s, e in own[:-1]])
        out[[i for i, _, _ in own]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.float64)
    return out


def decide(model: Model, blocks: list[str]) -> list[tuple[str | None, float, int]]:
    """Language, confidence and bytes of prose of each block; equal blocks are read once."""
    texts = {b: prose(b) for b in set(blocks)}
    some = sorted({t for t in texts.values() if t})
    found: dict[str, tuple[str | None, float, int]] = {"": (None, 0.0, 0)}
    if some and model.languages:
        bits = code_lengths(model, some)
        best = bits.argmin(1)
        odds = np.exp2(-np.minimum((bits - bits.min(1, keepdims=True)) * model.temper, 500)).sum(1)
        for t, j, o in zip(some, best.tolist(), odds.tolist()):
            data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
            strange = np.count_nonzero(~model.bytes_seen[data]) > STRANGE * len(data)
            found[t] = (None, 0.0, len(data)) if strange else (model.languages[j], 1 / o, len(data))
    return [found.get(texts[b], (None, 0.0, 0)) for b in blocks]


def fit(docs: DataFrame, clean: DataFrame | None = None, per_language: int = 150, seed: int = 5) -> Model:
    """Train on about ``per_language`` labelled documents a language, and ``clean`` (``lang, text``) if given.

    Documents are taken in the order of a seeded hash of their number, so every run takes the same; the driver gets no more than
    twice ``per_language`` times the labels' languages, and as many clean texts.  A fifth of the blocks, by hash, is kept
    apart to calibrate the confidence.
    """
    lang = label_language(F.col("lang"))
    labelled = docs.select(bind(lang).alias("lang"), "doc_id", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a code
    parts = 1 << 20
    keep = F.lit(False)
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(parts))
    for code, n in counts.items():
        keep = keep | ((F.col("lang") == code) & (place < max(1, int(parts * min(1.0, per_language / n)))))
    most = 2 * per_language * max(1, len(counts))
    rows = labelled.where(keep).withColumn("_place", place).orderBy("_place", "doc_id", "lang", "text").limit(most).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).extend(t for b in r.text.split("\n\n") if (t := prose(b)))
    if clean is not None:
        given = clean.select(label_language(F.col("lang")).alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        for r in given.orderBy("lang", "text").limit(most).collect():
            texts.setdefault(r.lang, []).append(prose(r.text))
    texts = {k: v for k, v in texts.items() if any(v)}
    if not texts:
        return Model([], np.zeros(16, np.uint64), np.zeros(16, np.int32), np.zeros((1, 0), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32), np.zeros(256, bool))
    texts = purify(texts)
    model = train(texts)
    model.temper = calibrate(texts)
    return model


def calibrate(texts: dict[str, list[str]], piece: int = 12) -> float:
    """The temper under which the languages of held-out pieces are likeliest; short pieces, as longer ones are hardly ever
    mistaken."""
    apart: list[tuple[str, str]] = []
    rest: dict[str, list[str]] = {}
    for lang, blocks in texts.items():
        for b in blocks:
            if zlib.crc32(b.encode("utf-8", "replace")) % 5 == 0:
                apart += [(lang, b[i : i + piece]) for i in range(0, len(b) - piece + 1, piece)]
            else:
                rest.setdefault(lang, []).append(b)
    if len(texts) < 2 or not apart:
        return TEMPER
    model = train({k: rest.get(k) or texts[k] for k in texts})
    bits = code_lengths(model, [t for _, t in apart])
    over = bits - bits[np.arange(len(apart)), [model.languages.index(lang) for lang, _ in apart]][:, None]
    tempers = np.geomspace(0.005, 1.0, 40)
    return float(min(tempers, key=lambda t: np.log2(np.exp2(np.clip(-over * t, -500, 500)).sum(1)).mean()))


def purify(texts: dict[str, list[str]], length: int = 4, rounds: int = 6) -> dict[str, list[str]]:
    """Without the blocks that look more like the texts of another label; repeated blocks count once.

    Whole strings of ``length`` bytes are compared by how often they occur among all *other* blocks of a label, not after their
    context: a share of wrongly labelled text is thereby diluted by its share, where a context that only it has would give it
    full credit.  Rounds go on until no block is dropped, or ``rounds`` are done.
    """
    blocks = {code: [np.unique(_strings(t, length), return_counts=True) for t in dict.fromkeys(texts[code])] for code in sorted(texts)}
    kept = {code: list(dict.fromkeys(texts[code])) for code in blocks}
    for _ in range(rounds):
        counted = {}
        for code, own in blocks.items():
            u, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
            counted[code] = u, np.bincount(at, np.concatenate([n for _, n in own]), len(u))
        dropped = 0
        for code, own in blocks.items():
            good = [min(counted, key=lambda other: (_bits(*b, *counted[other], other == code), other != code)) == code for b in own]
            if any(good) and not all(good):
                dropped += len(good) - sum(good)
                blocks[code] = [b for b, g in zip(own, good) if g]
                kept[code] = [t for t, g in zip(kept[code], good) if g]
        if not dropped:
            break
    return kept


def _strings(text: str, length: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - length + 1), np.uint64)
    for k in range(length):
        out = out * np.uint64(256) + data[k : k + len(out)]
    return out


def _bits(strings: np.ndarray, times: np.ndarray, known: np.ndarray, counts: np.ndarray, own: bool) -> float:
    """What a block's strings cost by their frequency in a label's blocks, without the block itself if it is one of them."""
    total = max(2.0, counts.sum() - (times.sum() if own else 0))
    if not len(known):
        return float(times.sum()) * (np.log2(total) + 3)
    at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
    n = np.where(known[at] == strings, counts[at], 0) - (times if own else 0)
    return float((times * np.where(n > 0, np.log2(total / np.maximum(n, 1)), np.log2(total) + 3)).sum())


_PARAGRAPHS = pa.struct([("para", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("bytes", pa.int64())])


def _label(model, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin = size = 0
            for end, text in enumerate(texts, 1):  # slices of a batch by their characters
                size += len(text or "")
                if size >= most or end == len(texts):
                    yield named(batch.slice(begin, end - begin), texts[begin:end], frozen)
                    begin, size = end, 0

    def named(batch: pa.RecordBatch, texts: list[str | None], frozen: Model) -> pa.RecordBatch:
        cut = [text.split("\n\n") if text is not None else [] for text in texts]
        decided = decide(frozen, [b for blocks in cut for b in blocks])
        offsets = np.cumsum([0] + [len(blocks) for blocks in cut])
        para = np.arange(len(decided)) - np.repeat(offsets[:-1], np.diff(offsets))
        lang, sure, size = zip(*decided) if decided else ((), (), ())
        flat = pa.StructArray.from_arrays([pa.array(para, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(size, pa.int64())], fields=list(_PARAGRAPHS))
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), rows], names=["doc_id", "label", "paragraphs"])

    return run


def label_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, label, paragraphs``: the label's code (null if it names none), and for each block its number, language,
    confidence and bytes of prose."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = docs.select("doc_id", "text", label_language(F.col("lang")).alias("lang"))
    return rows.mapInArrow(_label(sent), "doc_id long, label string, paragraphs array<struct<para int, lang string, confidence double, bytes long>>")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents", "doc_id", "lang", "text")
    return label_paragraphs(docs, fit(docs))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder).select("doc_id", "label", F.explode("paragraphs").alias("p"))
    other = F.col("p.lang").isNotNull() & ~F.col("p.lang").eqNullSafe(F.col("label"))
    return rows.where(other).select("doc_id", "p.para", "p.lang").distinct()


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's label, the language of most of its prose, how sure, and how many languages it has."""
    rows = _labelled(spark, folder)
    with_lang = F.filter("paragraphs", lambda p: p["lang"].isNotNull())
    langs = F.array_distinct(F.transform(with_lang, lambda p: p["lang"]))
    size = lambda code: F.aggregate(F.filter(with_lang, lambda p: p["lang"] == code), F.lit(0).cast("bigint"), lambda a, p: a + p["bytes"])
    sure = lambda code: F.aggregate(F.filter(with_lang, lambda p: p["lang"] == code), F.lit(0.0), lambda a, p: a + p["bytes"] * p["confidence"])
    best = F.array_max(F.transform(langs, lambda c: F.struct(size(c).alias("bytes"), c.alias("lang"), sure(c).alias("sure"))))
    rows = rows.select("doc_id", "label", F.size(langs).alias("languages"), best.alias("b"))
    return rows.select("doc_id", "label", F.col("b.lang").alias("lang"), F.round(F.coalesce(F.try_divide(F.col("b.sure"), F.col("b.bytes")), F.lit(0.0)), 6).alias("confidence"), "languages")
