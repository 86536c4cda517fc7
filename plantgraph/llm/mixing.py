"""Mixing sources to target weights by min-cost flow.

Sources share all words by weight; no source's target exceeds ``cap`` times its size, and what is cut
off is shared again by weight among the others. Documents are aggregated by membership pattern (the
set of sources they belong to). Words flow from patterns to the quotas of their sources; every
further repetition of a pattern's words costs more than the one before, so overlapping patterns are
used evenly. A pattern's flow is whole repetitions of all its documents plus a part: documents in
the order of a seeded hash while they fit, and the one further document that comes nearest to what
is still open. Patterns that share no source, not even through others, are flows of their own, so the
work grows with the number of patterns and the square of the largest group that overlaps.

That order is never sorted as a whole: documents fall into 4,096 hash buckets per pattern, sums of
buckets give the one in which the part ends, and only that bucket is ranked. The driver sees one row
per source and per pattern, never documents.

Null texts have no words and are taken as nothing. A null source is a source of its own, the last.
Rows are mixed one by one, also where an id repeats or is missing; equal rows are interchangeable.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

BUCKETS = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in tx.slices(batch.column(2)):
            gap = tx.SPACE[s.data]
            start = ~gap
            start[1:] &= gap[:-1]
            inner = s.offs[:-1][np.diff(s.offs) > 0]
            start[inner] = ~gap[inner]
            total = np.concatenate([[0], np.cumsum(start)])
            out.append(total[s.offs[1:]] - total[s.offs[:-1]])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["doc_id", "pattern", "size"])


def targets(sizes: dict, weights: tuple[float, ...], cap: int) -> dict:
    """Each source's target; sources in code point order, null (None) last, take weights in turn."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    out: dict = {}
    left, free = total, set(names)
    while free:
        share = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / share > cap * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / share for s in free}
            break
        for s in names:
            if s in full:
                out[s] = float(cap * sizes[s])
                left -= out[s]
        free -= full
    return out


def route(patterns: dict[tuple, int], quotas: dict, cap: int) -> dict[tuple, int]:
    """Words taken from each pattern: a min-cost flow of maximal value, repetitions ever dearer. Of
    several such flows, the order of patterns by code point decides, not that in which they came."""
    patterns = {p: patterns[p] for p in sorted(patterns, key=lambda p: [(x is None, x or "") for x in p])}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for p in patterns:
        for x in p:
            root[find(x)] = find(p[0])
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(p[0]), []).append(p)
    taken = dict.fromkeys(patterns, 0)
    for own in groups.values():
        taken |= _flow({p: patterns[p] for p in own if patterns[p] > 0}, quotas, cap)
    return taken


def _flow(patterns: dict[tuple, int], quotas: dict, cap: int) -> dict[tuple, int]:
    """The flow of patterns that hang together, by shortest augmenting paths with potentials."""
    graph: list[list[int]] = []
    to, room, cost = [], [], []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    begin, end = node(), node()
    at_source = {s: node() for p in patterns for s in p}
    ways = {}
    for p in patterns:
        n = node()
        ways[p] = [arc(begin, n, patterns[p], k * k) for k in range(cap)]
        for s in p:
            arc(n, at_source[s], cap * patterns[p], 0)
    for s, n in at_source.items():
        arc(n, end, quotas[s], 0)
    price = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[begin], via, heap = 0, {}, [(0, begin)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (nd := d + cost[e] + price[x] - price[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if far[end] == float("inf"):
            break
        price = [p + d if d < float("inf") else p for p, d in zip(price, far, strict=True)]
        path, x = [], end
        while x != begin:
            path.append(via[x])
            x = to[via[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    return {p: sum(room[e ^ 1] for e in own) for p, own in ways.items()}


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs. The source column is a
    string, or an array of strings where sources overlap: sizes and targets then name the first."""
    spark = docs.sparkSession
    s = st.Stages(spark, "mixing")
    many = dict(docs.dtypes)[source_col].startswith("array")
    pattern = F.array_sort(F.array_distinct(F.col(source_col).cast("array<string>"))) if many else F.array(F.col(source_col).cast("string"))
    if many:
        pattern = F.when(F.size(F.coalesce(pattern, F.array().cast("array<string>"))) > 0, pattern).otherwise(F.array(F.lit(None).cast("string")))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), pattern.alias("pattern"), F.col(text_col).cast("string").alias("text"))
    sized = plain.mapInArrow(_sizes, "doc_id long, pattern array<string>, size long")
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.expr(f"pmod(h, {BUCKETS})")).withColumn("row", F.monotonically_increasing_id())
    sized = s.keep(sized, "sized")
    buckets = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    buckets = s.keep(buckets, "buckets")
    patterns = {tuple(r.pattern): r.words for r in buckets.groupBy("pattern").agg(F.sum("words").alias("words")).toLocalIterator()}
    sizes: dict = {}
    for p, n in patterns.items():
        for x in p:
            sizes[x] = sizes.get(x, 0) + n
    goal = targets(sizes, weights, cap)
    taken = route(patterns, {x: round(t) for x, t in goal.items()}, cap)
    plan = []
    for p, n in patterns.items():
        times, part = divmod(taken[p], n) if n else (0, 0)
        plan.append((list(p), sizes[p[0]], goal[p[0]], int(times), int(part)))
    plan = spark.createDataFrame(plan, "pattern array<string>, source_size long, target double, times long, part long")
    running = buckets.selectExpr("pattern", "bucket", "words", "sum(words) OVER (PARTITION BY pattern ORDER BY bucket) upto")
    cut = running.join(plan, "pattern").where("upto > part AND upto - words <= part").groupBy("pattern").agg(F.min("bucket").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before"))
    plan = plan.join(cut, "pattern", "left").selectExpr("pattern", "source_size", "target", "times", "part", f"coalesce(cut, CASE WHEN part > 0 THEN {BUCKETS} ELSE -1 END) cut", "coalesce(before, 0) before")
    plan = s.keep(plan, "plan")
    rows = sized.join(plan, "pattern")
    ranked = rows.where("bucket = cut").selectExpr("row", "pattern", "size", "h", "part", "before", "before + sum(size) OVER (PARTITION BY pattern ORDER BY h, row ROWS UNBOUNDED PRECEDING) upto")
    ranked = s.keep(ranked, "ranked")
    inside = ranked.where("upto <= part").groupBy("pattern").agg(F.max("upto").alias("inside"))
    gaps = plan.join(inside, "pattern", "left").selectExpr("pattern", "part - coalesce(inside, before) gap")
    left = rows.where("bucket > cut AND part > 0").select("pattern", "row", "size", "h").unionByName(ranked.where("upto > part AND part > 0").select("pattern", "row", "size", "h"))
    nearest = left.join(gaps, "pattern").where("abs(size - gap) < gap").groupBy("pattern").agg(F.min(F.struct(F.expr("abs(size - gap)"), "h", "row")).row.alias("fill"))
    plan = s.keep(plan.join(nearest, "pattern", "left"), "filled")
    edge = ranked.where("upto <= part").select("row", F.lit(True).alias("fits"))
    rows = sized.join(plan, "pattern").join(edge, "row", "left")
    return rows.selectExpr("doc_id", "size", "source_size", "target", "size * (times + CASE WHEN bucket < cut OR fits OR row <=> fill THEN 1 ELSE 0 END) taken", "pattern[0] source")
