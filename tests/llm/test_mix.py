import pytest

from sluice.llm.mix import VOCABULARY, budgets, grow, hand_down, leaves_of, mix, settle, shares, sized, tree_budgets

DOCS = "doc_id long, text string, lang string, source string, tokens string"


def test_budgets_go_to_siblings_first():
    leaves = {("a", "x", "s1"): (0.25, 10), ("a", "x", "s2"): (0.25, 1000), ("b", "x", "s3"): (0.5, 1000)}
    got = dict(hand_down(grow(leaves), 100))
    assert got[("a", "x", "s1")] == pytest.approx(10) and got[("a", "x", "s2")] == pytest.approx(40) and got[("b", "x", "s3")] == pytest.approx(50)
    leaves[("a", "x", "s2")] = (0.25, 20)
    got = dict(hand_down(grow(leaves), 100))
    assert got[("a", "x", "s2")] == pytest.approx(20) and got[("b", "x", "s3")] == pytest.approx(70)
    assert sum(v for v in dict(hand_down(grow(leaves), 10_000)).values()) == pytest.approx(1030)


def test_largest_total_meets_all_shares():
    plan = budgets([("d", "en", "a", 100), ("d", "en", "b", 1000)], {"a": (0.5, 3), "b": (0.5, 1)})
    assert plan[("d", "en", "a")] == (100, 3, 0) and plan[("d", "en", "b")] == (1000, 0, 300)


def test_shortage_is_handed_on():
    """Beyond the largest total that all can meet, a short leaf's part goes to the other languages of its domain first."""
    counts = [("d", "en", "a", 100), ("d", "de", "b", 900), ("e", "en", "c", 10_000)]
    goals = {"a": (0.25, 1), "b": (0.25, 1), "c": (0.5, 1)}
    got = {k[2]: v[2] for k, v in tree_budgets(counts, goals, stretch=2).items()}
    assert got == pytest.approx({"a": 100, "b": 300, "c": 400})
    got = {k[2]: v[2] for k, v in tree_budgets(counts, goals, total=4000).items()}
    assert got == pytest.approx({"a": 100, "b": 900, "c": 3000})


def test_ends_are_settled_by_source():
    leaves = [("d", str(i), "s") for i in range(4)]
    got = settle([(*k, 10, 10) for k in leaves], dict.fromkeys(leaves, 14))
    assert abs(sum(got.values()) - 4 * 14) <= 5 and set(got.values()) == {10, 20}
    assert settle([("d", "x", "s", 0, 9)], {("d", "x", "s"): 0}) == {("d", "x", "s"): 0}


def test_domains_are_a_table(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", s, "") for i, s in enumerate(("s", "S ", "t", "u"))], DOCS)
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1)], "source string, target_share double, max_repeats int")
    table = spark.createDataFrame([("s", "one"), ("u", "two")], "source string, domain string")
    assert sorted((r.doc_id, r.domain) for r in leaves_of(docs, targets, table).collect()) == [(0, "one"), (1, "one"), (2, "t")]


def test_mix(spark):
    docs = [(i, f"text number {i} about " + "word " * (i % 40), ("en", "de", None)[i % 3], ("Issue-Tracker", "issue_tracker ", "spec_notes", "field_report")[i % 4 if i % 50 else 3], "x") for i in range(3000)]
    docs += [(5000, None, "en", "spec_notes", ""), (5001, "", "en", "spec_notes", ""), (5002, "x", "en", "unknown", ""), (5003, "x", "en", None, ""), (5004, "long " * 2_000, "en", "spec_notes", "")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("issue_tracker", 0.5, 1), ("spec_notes", 0.3, 2), ("field_report", 0.2, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    chosen = mix(df, targets)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    report = {r.source: r for r in shares(chosen, targets).collect()}
    for s, share, most in (("issue_tracker", 0.5, 1), ("spec_notes", 0.3, 2), ("field_report", 0.2, 4)):
        assert report[s].actual_share == pytest.approx(share, abs=0.06) and report[s].most_repeats <= most
    caps = {"issue_tracker": 1, "spec_notes": 2, "field_report": 4}
    assert all(r.copies <= caps[r.source] for r in rows)
    assert report["absent"].tokens == 0 and not {5000, 5002, 5003} & {r.doc_id for r in rows}
    assert sorted((r.doc_id, r.copies) for r in mix(df, targets).collect()) == sorted((r.doc_id, r.copies) for r in rows), "the same seed gives the same choice"
    assert {r.doc_id for r in mix(df, targets, seed=12).collect()} != {r.doc_id for r in rows}


def test_prefix_is_that_of_the_seeded_order(spark):
    """Against an ordering of a whole leaf by the hash."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 5), "en", "s", "") for i in range(500)], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    total = 4321
    rows = {r.doc_id: r.copies for r in mix(docs, targets, total=total, seed=3).collect()}
    t = sized(leaves_of(docs, targets))
    tokens = t.agg(F.sum("tokens")).first()[0]
    whole, rest = divmod(total, tokens)
    h = F.xxhash64(F.lit(3), F.lit(whole).cast("long"), "doc_id")
    cum = t.withColumn("h", h).withColumn("c", F.sum("tokens").over(W.orderBy("h", "doc_id")) - F.col("tokens") / 2)
    want = {r.doc_id: whole + (r.c <= rest) for r in cum.collect()}
    assert rows == {k: v for k, v in want.items() if v}


def test_empty_texts_keep_to_the_cap(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "a b c", "en", "s", "") for i in range(100)], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert {r.copies for r in mix(docs, targets).collect()} == {2}


def test_tokens_and_empty(spark):
    tok = pytest.importorskip("tokenizers")
    from pathlib import Path

    t = tok.Tokenizer.from_file(str(Path(VOCABULARY).parent / "byte_bpe_50k.json"))
    texts = ["It's  a\n\n test, naïve 日本 12345!  ", "<|endoftext|>", " ", "don't"]
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(i, x, "en", "s", "") for i, x in enumerate(texts)], DOCS)
    t.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in sized(leaves_of(df, targets)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0
