"""Problem 8: records of several sources are combined to target shares of the whole, small sources repeated up to a cap.

*Budgets.*  The leaves (domain, language, source) form a tree.  A leaf weighs its source's target times the language's part
of the source; a node weighs what its leaves weigh.  The total is handed down by weight; what a node cannot hold
(tokens times ``max_repeats``) goes to its siblings by weight, and only what they cannot hold goes to the ancestors'
siblings.  Without a given total, the largest one is taken for which every source can give its share, times ``stretch``;
above 1 leaves run short and their shortage is handed on.

*Selection.*  A leaf with budget b and t tokens gives b // t whole epochs, and of the next epoch the token prefix in a seeded
order.  The prefix is found by bucket: 4096 buckets of the order's hash have their tokens added up (map-side first), only
the bucket in which the budget ends is ordered row by row, so no leaf is ever gathered.  Records stay whole: whether a leaf
takes the record in which its budget ends is decided so that the error of its source stays least.

Token counts are made once (byte-level BPE of a public vocabulary, whole texts) and kept as a narrow written table.  The
vocabulary is the parameter ``vocabulary``, or the session's ``spark.sluice.vocabulary``.

Defined results: a record of a source without target, or with null text, is not used; a source without records gives
nothing and its share goes to its siblings; spellings of a source (case, outer space, - for _) are one source; a source
that the table of domains has not is its own domain; a null language is its own branch; ties of the order go by doc_id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.langid import label_language
from sluice.session import cut, scan, ship, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

LEAF = ("domain", "language", "source")


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _count_tokens(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in ("doc_id", *LEAF)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=["doc_id", *LEAF, "tokens"])

    return run


@dataclass
class Branch:
    weight: float
    room: int
    children: dict[str, "Branch"]


def grow(leaves: dict[tuple[str, ...], tuple[float, int]]) -> Branch:
    """A tree from leaf paths with (weight, room)."""
    root = Branch(0.0, 0, {})
    for path, (weight, room) in leaves.items():
        node = root
        node.weight, node.room = node.weight + weight, node.room + room
        for step in path:
            node = node.children.setdefault(step, Branch(0.0, 0, {}))
            node.weight, node.room = node.weight + weight, node.room + room
    return root


def hand_down(node: Branch, budget: float, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], float]]:
    """Budgets of the leaves; shortages go to siblings first because no node gets more than its leaves can hold."""
    if not node.children:
        yield path, budget
        return
    given = {k: 0.0 for k in node.children}
    open_, left = {k for k, c in node.children.items() if c.room > 0 and c.weight > 0}, min(budget, node.room)
    while open_ and left > 1e-6:
        weight = sum(node.children[k].weight for k in open_)
        parts = {k: left * node.children[k].weight / weight for k in open_}
        full = {k for k in open_ if given[k] + parts[k] >= node.children[k].room}
        if not full:
            for k in open_:
                given[k] += parts[k]
            break
        for k in full:
            left -= node.children[k].room - given[k]
            given[k] = node.children[k].room
        open_ -= full
    for k, c in node.children.items():
        yield from hand_down(c, given[k], (*path, k))


def leaves_of(docs: DataFrame, targets: DataFrame, domains: DataFrame | None = None, language: Column | None = None) -> DataFrame:
    """``doc_id, domain, language, source, text`` of every record of a source with a target; ``domains`` has ``source, domain``."""
    names = targets.select(source_name(F.col("source")).alias("source")).distinct()
    code = label_language(F.col("lang")) if language is None else language
    rows = docs.select("doc_id", "text", source_name(F.col("source")).alias("source"), F.coalesce(code, F.lit("?")).alias("language"))
    rows = rows.where(F.col("text").isNotNull()).join(F.broadcast(names), "source", "left_semi")  # one row a target
    if domains is None:
        rows = rows.withColumn("domain", F.col("source"))
    else:
        of = names.join(domains.groupBy(source_name(F.col("source")).alias("source")).agg(F.min("domain").alias("domain")), "source")
        rows = rows.join(F.broadcast(of), "source", "left").withColumn("domain", F.coalesce("domain", "source"))  # at most one row a target
    return rows.select("doc_id", *LEAF, "text")


def sized(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, domain, language, source, tokens`` of the records of ``leaves_of``."""
    ship(rows.sparkSession)
    with open(vocabulary or rows.sparkSession.conf.get("spark.sluice.vocabulary", VOCABULARY), "rb") as f:
        ranks = f.read()
    return rows.mapInArrow(_count_tokens(ranks), "doc_id long, domain string, language string, source string, tokens long")


def goals_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """``source -> (target share, most repeats)``."""
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").distinct().orderBy("source", "target_share", "max_repeats").collect()
    return {r.source: (max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0)) for r in rows if r.source is not None}


def tree_budgets(counts: list, goals: dict[str, tuple[float, int]], total: int | None = None, stretch: float = 1.0) -> dict[tuple[str, ...], tuple[float, int, float]]:
    """``leaf -> (weight, room, budget)`` from ``(domain, language, source, tokens)`` rows."""
    of: dict[str, int] = {}
    for *_, source, tokens in counts:
        of[source] = of.get(source, 0) + tokens
    share = sum(w for w, _ in goals.values()) or 1.0
    leaves = {(d, l, s): (goals[s][0] / share * t / of[s], t * goals[s][1]) for d, l, s, t in sorted(counts) if t > 0 and s in goals}  # noqa: E741
    if total is None:
        total = int(stretch * min((of.get(s, 0) * cap / (w / share) for s, (w, cap) in goals.items() if w > 0 and of.get(s, 0) > 0), default=0))
    return {leaf: (*leaves[leaf], budget) for leaf, budget in hand_down(grow(leaves), total)} if leaves else {}


def budgets(counts: list, goals: dict[str, tuple[float, int]], total: int | None = None, stretch: float = 1.0) -> dict[tuple[str, ...], tuple[int, int, int]]:
    """``leaf -> (tokens, whole epochs, tokens of the last epoch)``."""
    plan = {}
    for leaf, (_, room, budget) in tree_budgets(counts, goals, total, stretch).items():
        most = goals[leaf[2]][1]
        tokens = room // most if most else 0
        if tokens:
            whole, rest = divmod(round(budget), tokens)
            plan[leaf] = (tokens, whole, rest) if whole < most else (tokens, most, 0)
    return plan


def settle(ends: list[tuple], rests: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
    """Tokens each leaf gives of its last epoch, from ``(leaf..., tokens before, tokens of)`` the record in which its budget ends:
    without or with that record, so that the error of the source, leaf after leaf, stays least."""
    out, error = dict.fromkeys(rests, 0), {}
    for *leaf, low, step in sorted(ends):
        rest, so_far = rests[tuple(leaf)], error.get(leaf[2], 0)
        given = low if not rest or abs(so_far + low - rest) < abs(so_far + low + step - rest) else low + step
        out[tuple(leaf)], error[leaf[2]] = given, so_far + given - rest
    return out


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, vocabulary: str | None = None, domains: DataFrame | None = None, stretch: float = 1.0) -> DataFrame:
    """``doc_id, domain, language, source, tokens, copies`` of the records chosen; copies counts their repeats."""
    spark = docs.sparkSession
    rows = cut(sized(leaves_of(docs, targets, domains), vocabulary), "sizes")
    counts = [tuple(r) for r in rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).collect()]  # targets x languages
    plan = budgets(counts, goals_of(targets), total, stretch)
    leaf = "domain string, language string, source string"
    planned = spark.createDataFrame([(*k, whole, rest) for k, (_, whole, rest) in plan.items()], leaf + ", whole long, rest long")
    rows = rows.join(F.broadcast(planned), list(LEAF))  # one row a leaf
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "whole", "doc_id")).withColumn("bucket", F.shiftright("h", 52))
    before = W.partitionBy(*LEAF).orderBy("bucket")
    sums = rows.groupBy(*LEAF, "bucket", "rest").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(before))
    edges = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).select(*LEAF, F.col("bucket").alias("edge"), (F.col("upto") - F.col("t")).alias("at"))
    rows = rows.join(F.broadcast(edges), list(LEAF), "left")  # at most one row a leaf
    run = F.sum("tokens").over(W.partitionBy(*LEAF).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) + F.col("at")
    inside = rows.where(F.col("bucket") == F.col("edge")).withColumn("run", run)
    ends = inside.where((F.col("run") > F.col("rest")) & (F.col("run") - F.col("tokens") <= F.col("rest"))).select(*LEAF, (F.col("run") - F.col("tokens")).alias("low"), "tokens").collect()  # one row a leaf
    given = settle([tuple(r) for r in ends], {k: rest for k, (_, _, rest) in plan.items()})
    given = spark.createDataFrame([(*k, n) for k, n in given.items()], leaf + ", given long")
    inside = inside.join(F.broadcast(given), list(LEAF)).withColumn("last", ((F.col("rest") > 0) & (F.col("run") <= F.col("given"))).cast("int")).drop("run", "given")  # one row a leaf
    outside = rows.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("last", F.coalesce(((F.col("rest") > 0) & (F.col("bucket") < F.col("edge"))).cast("int"), F.lit(0)))
    chosen = outside.unionByName(inside).withColumn("copies", (F.col("whole") + F.col("last")).cast("int"))
    return chosen.where(F.col("copies") > 0).select("doc_id", *LEAF, "tokens", "copies")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, records, most repeats, tokens given and the share they are of the whole."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    got = chosen.groupBy("source").agg(F.count("*").alias("records"), F.max("copies").alias("most_repeats"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    out = goal.join(got, "source", "left").fillna(0, ["records", "most_repeats", "tokens"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy())), F.lit(0.0)))  # one row a target


#: Domains of the sources, for these queries; a table like any other.
DOMAINS = (
    ("issue_tracker", "talk"), ("player_forum", "talk"), ("support_mail", "talk"), ("spec_notes", "reference"),
    ("release_notes", "reference"), ("packager_manual", "reference"), ("vector_readme", "reference"), ("field_report", "reference"),
)


def _domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "source string, domain string")


def p8_mix(spark: SparkSession, folder: str, stretch: float = 1.0) -> DataFrame:
    return mix(scan(spark, folder, "documents", "doc_id", "text", "lang", "source"), table(spark, folder, "mix_target"), domains=_domains(spark), stretch=stretch)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p8_mix(spark, folder), table(spark, folder, "mix_target"))


def p8_short(spark: SparkSession, folder: str) -> DataFrame:
    """A total of half as much again as all sources can give their shares of: some run short, and others give more."""
    return shares(p8_mix(spark, folder, 1.5), table(spark, folder, "mix_target"))


def p8_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """The tree's budgets for four fifths of all that fits, sizes being characters and languages the labels as written."""
    targets = table(spark, folder, "mix_target")
    rows = leaves_of(table(spark, folder, "documents"), targets, _domains(spark), F.lower(F.trim("lang"))).groupBy(*LEAF).agg(F.sum(F.length("text").cast("bigint")).alias("tokens"))
    counts, goals = [tuple(r) for r in rows.collect()], goals_of(targets)  # targets x labels
    total = 4 * sum(t * goals[s][1] for *_, s, t in counts if s in goals) // 5
    out = [(*leaf, room, round(weight * total), round(budget)) for leaf, (weight, room, budget) in tree_budgets(counts, goals, total).items()]
    return spark.createDataFrame(out, "domain string, language string, source string, room long, wanted long, budget long")


def _level(n: int, above: str, key: str) -> str:
    """SQL that gives the children of each node their budgets: those with least room for their weight fill up first."""
    by = f"PARTITION BY {above}" if above else ""
    keys = f"{above}, {key}" if above else key
    using = f"JOIN b{n - 1} USING ({above})" if above else "CROSS JOIN b0"
    match = f"JOIN m{n} USING ({above})" if above else f"CROSS JOIN m{n}"
    return f"""
  c{n} AS (SELECT {keys}, w, r, b - coalesce(sum(r) OVER ({by} ORDER BY r / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb, row_number() OVER ({by} ORDER BY r / w, {key}) AS k,
    sum(w) OVER ({by} ORDER BY r / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM (SELECT {keys}, sum(w) AS w, CAST(sum(room) AS DOUBLE) AS r FROM leaf GROUP BY ALL) {using}),
  m{n} AS (SELECT {above + ", " if above else ""}arg_min(lb / lw, k) FILTER (WHERE lb / lw <= r / w) AS lam FROM c{n} {"GROUP BY " + above if above else ""}),
  b{n} AS (SELECT {keys}, least(r, coalesce(lam * w, r)) AS b FROM c{n} {match})"""


P8_BUDGETS_SQL = f"""
WITH d AS (SELECT regexp_replace(lower(trim(source, ' ')), '[\\s-]+', '_', 'g') AS source, coalesce(lower(trim(lang, ' ')), '?') AS language, length(text) AS n FROM documents WHERE text IS NOT NULL),
  dom(source, domain) AS (VALUES {", ".join(str(x) for x in DOMAINS)}),
  t AS (SELECT coalesce(domain, source) AS domain, language, source, CAST(sum(n) AS BIGINT) AS tokens, any_value(target_share) AS share, any_value(max_repeats) AS cap FROM d JOIN mix_target USING (source) LEFT JOIN dom USING (source) GROUP BY ALL HAVING sum(n) > 0),
  leaf AS (SELECT domain, language, source, tokens * cap AS room, share / (SELECT sum(target_share) FROM mix_target) * tokens / sum(tokens) OVER (PARTITION BY source) AS w FROM t),
  b0 AS (SELECT CAST(4 * sum(room) // 5 AS DOUBLE) AS b FROM leaf),{_level(1, "", "domain")},{_level(2, "domain", "language")},{_level(3, "domain, language", "source")}
SELECT domain, language, source, CAST(room AS BIGINT) AS room, CAST(round(w * (SELECT b FROM b0)) AS BIGINT) AS wanted, CAST(round(b3.b) AS BIGINT) AS budget FROM leaf JOIN b3 USING (domain, language, source)"""
