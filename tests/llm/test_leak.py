import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.leak import Settings, find_leaks, fit_basis, holds_runs, lay, least_exact, least_shared, load_items


def plain_check(item, doc, least, one_in):
    """Every run of the item against every stretch of the document, by edit distance."""
    for a in range(len(item)):
        for b in range(a + least, len(item) + 1):
            run, most = item[a:b], (b - a) // one_in
            row = [0] * (len(doc) + 1)  # a stretch may begin anywhere
            for i, w in enumerate(run):
                new = [i + 1]
                for j, d in enumerate(doc):
                    new.append(min(row[j] + (w != d), row[j + 1] + 1, new[j] + 1))
                row = new
            if min(row) <= most:
                return True
    return False


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), max_size=18)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_alignment_is_exact(pairs):
    got = holds_runs([np.array(i) for i, _ in pairs], [np.array(d, int) for _, d in pairs], 6, 4)
    assert got.tolist() == [plain_check(i, d, 6, 4) for i, d in pairs]


def test_least_exact():
    assert least_exact(95, 16, 10) == 6 and least_exact(16, 16, 10) == 8
    assert least_shared(95, 16, 10, 6) == 3 and least_shared(16, 16, 10, 8) == 1


def test_every_run_is_inside_a_passage():
    for n in (0, 1, 5, 24, 25, 31, 32, 33, 100):
        t = lay([np.arange(n), np.arange(500, 500 + n)], 24, 8)
        seen = [set(t.flat[b * 8 : b * 8 + 24].tolist()) - {-1} for b in t.blocks]
        for d, own in ((0, range(n)), (1, range(500, 500 + n))):
            mine = [w for w, o in zip(seen, t.owner) if o == d]
            assert all(w <= set(own) for w in mine)
            assert all(any(set(own[a : a + 16]) <= w for w in mine) for a in range(max(0, n - 16 + 1))), n


def test_singular_values(spark):
    """The values are those of the dense TF-IDF matrix."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(i, " ".join(rng.choices(vocab, k=40))) for i in range(6)], "item_id long, text string")
    texts = [" ".join(rng.choices([*vocab, "other"], k=rng.randrange(0, 90))) for _ in range(40)]
    s = Settings(rank=30, energy=1.0)
    (held,) = load_items(items, s)
    codes = [np.array([held.terms.get(w, -1) for w in t.split()], np.int32) for t in texts]
    from sluice.llm.leak import _CODED, _code

    coded = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).mapInArrow(_code(held), _CODED)
    idf, basis, values = fit_basis(coded, held)
    rows = []
    for t in (lay(codes, 24, 8), lay(held.passages, 24, 8)):
        for b in t.blocks:
            row = np.zeros(len(held.terms))
            for w in t.flat[b * 8 : b * 8 + 24]:
                if w >= 0:
                    row[w] += idf[w]
            rows.append(row)
    dense = np.linalg.svd(np.array(rows), compute_uv=False)
    assert np.allclose(values[: len(dense)], dense[: len(values)], rtol=1e-2)


def edited(rng, words, edits):
    out = list(words)
    step = len(words) // (edits + 1)
    for k in range(edits, 0, -1):
        at = k * step
        kind = rng.choice("cda")
        if kind == "c":
            out[at] = "changedword"
        elif kind == "d":
            del out[at]
        else:
            out.insert(at, "addedword")
    return out


def test_planted_passages(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    noise = [f"n{i}" for i in range(300)] + vocab[:40]
    items = [(i, "en", " ".join(rng.choice(vocab) for _ in range(rng.randrange(40, 90)))) for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        words = [rng.choice(noise) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            i, _, text = rng.choice(items)
            ws = text.split()
            n = rng.choice([16, 17, 20, 32, len(ws)])
            a = rng.randrange(len(ws) - n + 1)
            passage = edited(rng, ws[a : a + n], rng.randrange(n // 10 + 1))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
            want.add((i, d))
        docs.append((d, "\n| ".join(" ".join(words[k : k + 7]).upper() for k in range(0, len(words), 7)), "own"))
    docs += [(1000, None, ""), (1001, "", ""), (1002, "x " * 200_000, ""), (1003, items[0][2], ""), (1004, items[0][2], "")]
    want |= {(0, 1003), (0, 1004)}
    items += [(90, "en", None), (91, "en", ""), (92, "en", "short " * 10), (None, "en", "x")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, lang string, text string"))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want


def test_near_misses_and_empty(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    short = " ".join(words[:14])
    broken = " ".join(w for i, w in enumerate(words) if i % 5)
    docs = spark.createDataFrame([(1, short), (2, broken), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(docs, items, Settings(rank=4)).count() == 0
    more = items.unionByName(spark.createDataFrame([(k, " ".join(f"v{k}{i}" for i in range(20))) for k in range(2, 6)], items.schema))
    found = docs.unionByName(spark.createDataFrame([(9, " ".join(f"v3{i}" for i in range(20)))], docs.schema))
    assert [(r.item_id, r.doc_id) for r in find_leaks(found, more, Settings(max_items=2)).collect()] == [(3, 9)]


def test_short_runs_beside_other_items(spark):
    """Runs of the least length, one word changed, between passages of other items, which outweigh them in every window."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(440)]
    texts = [[rng.choice(vocab) for _ in range(60)] for _ in range(40)]
    docs, want = [], set()
    for d in range(300):
        i, j, k = rng.sample(range(40), 3)
        a = rng.randrange(60 - 16 + 1)
        run = texts[i][a : a + 16]
        run[rng.randrange(1, 15)] = rng.choice(("changedword", rng.choice(texts[j])))
        loud = rng.choice(texts[j])
        beside = [w for w in texts[j][:8]] if d % 2 else [loud] * 8
        docs.append((d, " ".join(beside + run + (texts[k][:8] if d % 2 else [loud] * 8))))
        want.add((i, d))
    items = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in find_leaks(frame, items).collect()} == want
    assert {(r.item_id, r.doc_id) for r in find_leaks(frame, items, Settings(least_cosine=1.1)).collect()} == want
