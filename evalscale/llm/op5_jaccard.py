"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric, so pivots, Voronoi regions and the triangle
inequality apply.  Most texts share nothing with any pivot, though: their
distance to all is 1, and windows around 1 would put every text into every
region.  So regions are found by what near texts must have in common:

1.  Equal sets are one class, known by a hash of the set.
2.  Tokens (shingle hashes) have a global order, frequent ones last.  Two sets
    with similarity t or more share a token within their first n - ceil(t n) + 1;
    the prefix here is longer by `slack` n tokens, so that near sets must share
    more than `slack` t n of them, and a set that shares fewer is dropped.
3.  Sets that share a prefix token and have sizes within the ratio t form a
    neighbourhood.  Its pivot is a set with as many frequent tokens as any, which
    in a group of near copies is its centre.  All sets with a pivot in common are
    that pivot's region; a set is in the regions of all its pivots, so each pair
    of near sets meets in one.
4.  A region is joined exactly and recursively.  Pivots, its centre first, are
    compared with all its sets; each other set belongs to the Voronoi cell of the
    nearest pivot, and what lies in the triangle-inequality window around a cell
    (distances to its pivot that differ by no more than 1 - t) is copied to it.
    Cells are joined in turn, until all sets of one are tied together or cells save
    little; then pairs inside the windows of all pivots are compared.  Regions of
    few sets and bytes (`REGION_SETS`, `REGION_BYTES`) are joined so within a task,
    larger ones first dealt to tasks by cells, in the same way; one that does not
    shrink is joined block against block.

The links are true links with the components of all links, at most a few per set
and region.  `component_id` is the smallest doc_id over a component's classes.

Cases: a null or empty text, or one without words, has an empty set, linked with
nothing; one of fewer than five words is one token; repeated rows and copies are
in one class; rows with a null doc_id join components but name none; columns
beyond doc_id and text are ignored; no documents, no rows.

Scale: one row per prefix token (about a quarter of all) is shuffled and sorted by
token, in a stream that never holds a group; sets travel only for texts that
share enough.  Broadcast are at most `hot` frequent tokens (any choice of them
gives right results) and a list of set hashes if measured small.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalscale.llm.common import BROADCAST_BYTES, ROW_KEY, cut, join_measured, join_small, packed_longs, row_key, small
from evalscale.llm.graph import Forest, components
from evalscale.llm.text import SPACED, Lookup, Words, buffers, grams, mix, release, slices

SHINGLE = 5
PERCENT = 80
SLACK = 5  # hundredths of a set
HOT_TOKENS = 1_000_000
HOT_COUNT = 16
#: What one task joins by itself; regions beyond either are split by tasks in the same way.
REGION_SETS, REGION_BYTES = 2048, 16 << 20
PIVOTS = 8
DEPTH = 4

SETS = "fp long, n int, tokens binary"


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t n)"""
    return -(-percent * n // 100)


def row_sets(part: pa.RecordBatch, column: int, k: int) -> list[np.ndarray]:
    """The sorted token set of every row."""
    w = Words(part.column(column), SPACED)
    g = grams(w.hashes, k)
    out = []
    for a, c in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if c >= k:
            x = np.sort(g[a : a + c - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(grams(w.hashes[a : a + c], c)[:1] if c else np.zeros(0, np.uint64))
    return out


def fingerprint(x: np.ndarray) -> int:
    return int(mix(np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0]) if len(x) else 0


def lower_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Size class: sets within the ratio t are in the same or neighbouring ones."""
    return np.floor(np.log(n) / -math.log(percent / 100) + 1e-9).astype(np.int64)


def describe(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, row key, n, fp) of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = row_sets(part, 1, k)
                n, fp = pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], n, fp], names=["doc_id", *ROW_KEY, "n", "fp"])

    return documents.mapInArrow(run, "doc_id long, key long, key2 long, n long, fp long")


def distinct_sets(batches, column: int, k: int):
    """(fp, tokens) of the sets that this task sees for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for x in row_sets(part, column, k):
                fp = fingerprint(x)
                if len(x) and fp not in seen:
                    seen.add(fp)
                    out.append((fp, x))
            yield out


def prefix_length(n: int, percent: int, slack: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + slack * n // 100)


def hot_tokens(documents: DataFrame, k: int, percent: int, slack: int, most: int, least: int) -> np.ndarray:
    """The most frequent prefix tokens (in hash order), at most `most`; their choice affects the work only."""

    def run(batches):
        for sets in distinct_sets(batches, 1, k):
            tokens = np.concatenate([np.zeros(0, np.uint64), *(x[: prefix_length(len(x), percent, slack)] for _, x in sets)])
            values, counts = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["t", "n"])

    counts = documents.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return packed_longs(counts.orderBy(F.desc("n"), "t").limit(most), "t")


def prefixes(documents: DataFrame, k: int, percent: int, slack: int, hot: np.ndarray) -> DataFrame:
    """(token, meta, fp) of every prefix token; meta holds size class, rank as a pivot, and size, in sorting order."""
    lookup = Lookup(hot)

    def run(batches):
        for sets in distinct_sets(batches, 1, k):
            tokens, metas, fps, sizes = [], [], [], []
            for fp, x in sets:
                p = prefix_length(len(x), percent, slack)
                is_hot = np.zeros(len(x), bool)
                is_hot[lookup.find(x)[0]] = True
                rank = 255 - 255 * int(is_hot[:p].sum()) // p  # by how many of its first tokens other sets have
                x = np.concatenate([x[~is_hot], x[is_hot]])
                size_class = int(lower_class(np.array([len(x)]), percent)[0])
                tokens.append(x[:p])
                metas.append(size_class << 40 | rank << 32 | len(x))
                fps.append(fp)
                sizes.append(p)
            flat = np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)
            repeat = lambda v: pa.array(np.repeat(np.array(v, np.int64), np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(flat), repeat(metas), repeat(fps)], names=["t", "meta", "fp"])

    return documents.mapInArrow(run, "t long, meta long, fp long")


def by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition("t").sortWithinPartitions("t", "meta", "fp")


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose token some other set has too; sorted input, one batch and one row held."""

    def run(batches):
        held = np.zeros((0, 3), np.int64)
        before = None  # (token, fp) of the row before the held one

        def told(x: np.ndarray, last: bool):
            """Rows to pass on; the last one waits for its successor."""
            nonlocal before
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:, 0] != x[:-1, 0]) | (x[1:, 2] != x[:-1, 2])
            x = x[fresh]
            n = len(x) if last else len(x) - 1
            same = np.zeros(len(x) + 1, bool)  # whether a row has the token of the one before
            same[1 : len(x)] = x[1:, 0] == x[:-1, 0]
            same[0] = before is not None and len(x) > 0 and before[0] == x[0, 0]
            keep = (same[:-1] | same[1:])[:n]
            if n:
                before = (x[n - 1, 0], x[n - 1, 2])
            return x[:n][keep], x[n:]

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            out, held = told(np.concatenate([held, x]), False)
            yield as_rows(out)
        out, _ = told(held, True)
        yield as_rows(out)

    def as_rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(3)], names=["t", "meta", "fp"])

    return by_token(rows).select("t", "meta", "fp").mapInArrow(run, "t long, meta long, fp long")


def elect(rows: DataFrame) -> DataFrame:
    """(pivot, fp) for each row: the first of its size class under the token, and the first of the class below."""

    def run(batches):
        last = None  # (token, class, pivot, pivot of the class below or None) of the newest run

        for batch in batches:
            t, meta, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(t):
                continue
            size_class = meta >> 40
            starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (size_class[1:] != size_class[:-1])]))
            run_t, run_c, run_p = t[starts], size_class[starts], fp[starts].copy()
            below, has = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
            if last is not None and last[0] == run_t[0]:
                if last[1] == run_c[0]:
                    run_p[0] = last[2]
                    below[0], has[0] = (last[3], True) if last[3] is not None else (0, False)
                elif last[1] == run_c[0] - 1:
                    below[0], has[0] = last[2], True
            near = (run_t[1:] == run_t[:-1]) & (run_c[1:] == run_c[:-1] + 1)
            below[1:][near], has[1:][near] = run_p[:-1][near], True
            last = (run_t[-1], run_c[-1], run_p[-1], below[-1] if has[-1] else None)
            of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(t)]])))
            low = has[of]
            pivot, member = np.concatenate([run_p[of], below[of][low]]), np.concatenate([fp, fp[low]])
            pairs = np.unique(np.stack([pivot, member], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["region", "fp"])

    return by_token(rows).select("t", "meta", "fp").mapInArrow(run, "region long, fp long").distinct()


class Region:
    """The sets of one region with dense token numbers, for fast intersections with one of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.ends = ids, np.cumsum(self.sizes)
        self.mask = np.zeros(len(values), bool)

    def own(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def intersections(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the others."""
        self.mask[self.own(i)] = True
        if len(others) * 4 > len(self.sizes):
            every = np.add.reduceat(self.mask[self.ids].astype(np.int64), self.ends - self.sizes)[others]
        else:
            every = np.array([np.count_nonzero(self.mask[self.own(j)]) for j in others.tolist()], np.int64)
        self.mask[self.own(i)] = False
        return every


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def region_links(
    names: list[int], sets: list[np.ndarray], asks: np.ndarray, percent: int, pivots: int = PIVOTS, groups: list[int] | None = None, centre: int | None = None, trace: Counter | None = None
) -> list[tuple[int, int]]:
    """Links that join whatever near sets of the region join; of each pair one set at least must ask, and sets of one group are joined already.

    Pivots, the centre first and the others far from those before, are compared with all; the other sets go to the cell of
    their nearest pivot, and those in a cell's window are copied to it; cells are
    joined in turn, or pair by pair inside the windows of all pivots where cells
    would save less than half.  `trace` counts regions, pivots, cells, copies and pairs.
    """
    region, forest, out = Region(sets), Forest(), []
    n, named, trace = region.sizes, np.array(names, np.int64), Counter() if trace is None else trace
    reach = 1 - percent / 100 + 1e-9
    firsts: dict[int, int] = {}
    for i, group in enumerate(groups or []):
        forest.join(i, firsts.setdefault(group, i))

    def compare(i: int, others: np.ndarray) -> np.ndarray:
        """Distances to others; near ones are tied."""
        trace["pairs"] += len(others)
        both = region.intersections(i, others)
        for j in others[linked(both, n[others], n[i], percent) & (others != i)].tolist():
            if forest.join(i, j):
                out.append((names[i], names[j]))
        return 1 - both / (n[others] + n[i] - both)

    def one(members: np.ndarray) -> bool:
        root = forest.root(int(members[0]))
        return all(forest.root(i) == root for i in members.tolist())

    todo = [(np.arange(len(sets)), np.array(asks, bool))]
    while todo:
        members, asking = todo.pop()
        if not asking.any() or one(members):
            continue
        trace["regions"] += 1
        at = int((asking & (named[members] == centre if centre is not None else True)).argmax())
        at = at if asking[at] else int(asking.argmax())
        chosen, distances, nearest = [], [], np.where(asking, np.inf, -1.0)
        for _ in range(max(2, min(pivots, math.isqrt(len(members))))):
            chosen.append(at)
            distances.append(compare(int(members[at]), members))
            if one(members):
                break
            nearest = np.minimum(nearest, distances[-1])
            nearest[chosen] = -1
            at = int(nearest.argmax())  # the next pivot is as far as possible from those before
            if nearest[at] < 0:
                break
        if not one(members):
            d = np.stack(distances)
            is_pivot = np.zeros(len(members), bool)
            is_pivot[chosen] = True
            asking = asking & ~is_pivot
            home = d.argmin(0)
            cells = []
            for c, row in enumerate(d):
                inside = asking & (home == c)
                if inside.any():
                    cells.append((inside, ~is_pivot & (row >= row[inside].min() - reach) & (row <= row[inside].max() + reach)))
            trace["pivots"] += len(chosen)
            trace["cells"] += len(cells)
            trace["copies"] += sum(int((window & ~inside).sum()) for inside, window in cells)
            if 2 * sum(inside.sum() * window.sum() for inside, window in cells) <= asking.sum() * (~is_pivot).sum():
                todo += [(members[window], inside[window]) for inside, window in cells]
                continue
            open_ = ~is_pivot  # not compared with all yet
            for k in np.flatnonzero(asking).tolist():
                open_[k] = False
                i, size = int(members[k]), n[members]
                fits = open_ & (100 * size >= percent * n[members[k]]) & (100 * n[members[k]] >= percent * size) & (np.abs(d - d[:, k : k + 1]) <= reach).all(0)
                root = forest.root(i)
                others = np.array([j for j in members[fits].tolist() if forest.root(j) != root], np.int64)
                if len(others):
                    compare(i, others)
    return out


LINKS = "a long, b long"


def join_small_regions(rows: DataFrame, percent: int) -> DataFrame:
    """Joins regions whole; rows (region, fp, asks, group, tokens), of which a task holds one region at a time."""

    def run(batches):
        name, held, out = None, [], []

        def close():
            if len(held) > 1 and any(h[1] for h in held):
                names, asks, groups, sets = zip(*held, strict=True)
                out.extend(region_links(names, [np.frombuffer(x, np.uint64) for x in sets], np.array(asks), percent, groups=groups, centre=name))

        for batch in batches:
            data, offsets = buffers(batch.column(4))
            bounds = offsets.tolist()
            for i, (region, fp, asks, group) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if region != name:
                    close()
                    name, held = region, []
                held.append((fp, asks, group, data[bounds[i] : bounds[i + 1]].tobytes()))
            yield links_of(out)
            out = []
            release()
        close()
        yield links_of(out)

    def links_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("region").sortWithinPartitions("region", "fp").select("region", "fp", "asks", "group", "tokens").mapInArrow(run, LINKS)


def merged_groups(chains: DataFrame) -> DataFrame:
    """(region, node, root) of the group names that chains (region, nodes) say are one component; few in each region."""

    def run(batches):
        for batch in batches:
            out = []
            for region, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forest = Forest()
                for p in pairs:
                    forest.join(p["a"], p["b"])
                out += [(region, x, forest.root(x)) for x in forest.up]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["region", "node", "root"])

    first = F.get("nodes", F.lit(0))
    pairs = F.transform(F.slice("nodes", F.lit(2), F.size("nodes")), lambda x: F.struct(F.get("nodes", F.lit(0)).alias("a"), x.alias("b")))
    pairs = chains.where(first.isNotNull()).select("region", F.explode(pairs).alias("pair")).where("pair.a <> pair.b").distinct()
    return pairs.groupBy("region").agg(F.collect_list("pair").alias("pairs")).mapInArrow(run, "region long, node long, root long")


def split(rows: DataFrame, percent: int, pivots: int, level: int, cap: int, cap_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voronoi cells of regions, with boundary copies; the links found to the pivots; and blocks of the regions whose cells save little.

    Pivots are done: they were compared with the whole region.  Sets near a pivot
    get the name of its group, and groups with a set or pivot in common are one:
    their members are linked already.  One group of a region stops asking, the
    largest that has all sets that did not ask; the others ask on, since two sets
    near different pivots can be the only link between their groups.
    """
    reach = 1 - percent / 100 + 1e-9
    order = Window.partitionBy("region").orderBy(F.col("fp") != F.col("region"), F.xxhash64("fp", F.lit(level)), "fp")  # the centre first
    chosen = rows.where("asks").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pivots)
    packed = chosen.groupBy("region").agg(F.collect_list(F.struct("fp", "group", "tokens")).alias("pivots"))  # at most `pivots` sets

    def measure(batches):
        for batch in batches:
            out = {"region": [], "fp": [], "asks": [], "group": [], "tokens": [], "d": [], "near": [], "nodes": [], "pivot": []}
            for region, fp, asks, group, tokens, centres in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, d, near = np.frombuffer(tokens, np.uint64), [], []
                is_pivot = any(c["fp"] == fp for c in centres)
                nodes = [group] if is_pivot or group != fp else []
                for c in centres:
                    y = np.frombuffer(c["tokens"], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    d.append(1 - both / (len(x) + len(y) - both))
                    if c["fp"] != fp and 100 * both >= percent * (len(x) + len(y) - both):
                        near.append(c["fp"])
                        nodes.append(c["group"])
                for key, v in zip(out, (region, fp, asks, group, tokens, d, near, nodes, is_pivot), strict=True):
                    out[key].append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    size = F.aggregate("pivots", F.lit(64).cast("long"), lambda n, p: n + 32 + F.length(p["tokens"]))
    joined = join_measured(rows, cut(packed, "pivots"), "region", "inner", size).select("region", "fp", "asks", "group", "tokens", "pivots")
    kinds = "region long, fp long, asks boolean, group long, tokens binary, d array<double>, near array<long>, nodes array<long>, pivot boolean"
    measured = cut(joined.mapInArrow(measure, kinds), "cells")
    links = measured.select(F.col("fp").alias("a"), F.explode("near").alias("b"))

    roots = cut(merged_groups(measured.select("region", "nodes")), "groups")
    named = measured.where("not pivot").withColumn("node", F.coalesce(F.get("nodes", F.lit(0)), "group")).drop("group", "near", "pivot")
    named = join_small(named, roots, ["region", "node"], "left", 24).withColumn("group", F.coalesce("root", "node"))
    silent = F.sum((~F.col("asks")).cast("long")).alias("silent")
    groups = named.where(F.size("nodes") > 0).groupBy("region", "group").agg(silent, F.sum(F.col("asks").cast("long")).alias("asking"))
    all_silent = named.groupBy("region").agg(silent.alias("all_silent"))
    quiet = groups.join(all_silent, "region").where("silent = all_silent and asking > 0").groupBy("region").agg(F.max(F.struct("asking", "group")).alias("most"))
    quiet = cut(quiet.select("region", F.col("most.group").alias("quiet")), "quiet")
    named = join_small(named, quiet, "region", "left", 16).withColumn("asks", F.col("asks") & ~F.col("group").eqNullSafe(F.col("quiet")))
    # where all that ask are of one group, they need not see its others
    asking = F.when(F.col("asks"), F.col("group"))
    state = named.groupBy("region").agg(F.min(asking).alias("low_ask"), F.max(asking).alias("high_ask"), F.min("group").alias("low_all"), F.max("group").alias("high_all"))
    state = cut(state.where("low_ask is not null and low_all <> high_all").select("region", "low_ask", "high_ask"), "state")
    needed = F.col("asks") | (F.col("low_ask") != F.col("high_ask")) | (F.col("group") != F.col("low_ask"))
    left = join_small(named, state, "region", "inner", 24).where(needed).select("region", "fp", "asks", "group", "tokens", "d")

    home = F.array_position("d", F.array_min("d")) - 1
    ranges = left.where("asks").select("region", home.cast("int").alias("cell"), F.array_min("d").alias("x")).groupBy("region", "cell").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ranges = ranges.groupBy("region").agg(F.collect_list(F.struct("cell", "low", "high")).alias("cells"))  # at most `pivots`
    placed = join_small(left, cut(ranges, "ranges"), "region", "inner", 64 + 24 * pivots).withColumn("home", home.cast("int")).withColumn("c", F.explode("cells"))
    inside = (F.col("c.cell") == F.col("home")) & F.col("asks")
    distance = F.element_at("d", F.col("c.cell") + 1)
    boundary = (distance >= F.col("c.low") - reach) & (distance <= F.col("c.high") + reach)
    placed = placed.where(inside | boundary)
    count, asked = F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))
    work = placed.groupBy("region", "c.cell").agg((count * F.sum(inside.cast("long"))).alias("work")).groupBy("region").agg(F.sum("work").alias("work"))
    whole = left.groupBy("region").agg(count.alias("size"), F.sum(F.length("tokens")).alias("bytes"), (count * asked).alias("whole"))
    stuck = cut(whole.join(work, "region").where("2 * work > whole").select("region", "size", "bytes"), "stuck")
    cells = join_small(placed, stuck.select("region"), "region", "left_anti", 8)
    cells = cells.select(F.xxhash64("region", "c.cell", F.lit(level)).alias("region"), "fp", inside.alias("asks"), "group", "tokens")
    return cells, links, blocks(left.drop("d"), stuck, cap, cap_bytes)


def blocks(rows: DataFrame, sizes: DataFrame, cap: int, cap_bytes: int) -> DataFrame:
    """Regions that do not shrink, as pairs of blocks: asking sets of one against all sets of another."""
    n = F.greatest(F.ceil(F.col("size") / (cap // 2)), F.least(F.ceil(F.col("bytes") / (cap_bytes // 2)), F.col("size"))).cast("int")
    marked = join_small(rows, sizes, "region", "inner", 32).withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    unit = lambda i, j: F.xxhash64("region", i, j)
    askers = marked.where("asks").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("j <> own").select(unit(F.col("own"), F.col("j")).alias("region"), "fp", "asks", "group", "tokens")
    others = marked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    others = others.select(unit(F.col("i"), F.col("own")).alias("region"), "fp", (F.col("asks") & (F.col("i") == F.col("own"))).alias("asks"), "group", "tokens")
    return askers.unionByName(others)


def join_regions(rows: DataFrame, percent: int, cap: int = REGION_SETS, cap_bytes: int = REGION_BYTES, pivots: int = PIVOTS, depth: int = DEPTH) -> DataFrame:
    """Links of all regions (region, fp, asks, group, tokens) of a written table; those beyond a task's bounds are split recursively."""
    links: list[DataFrame] = []
    for level in range(depth + 1):
        size, weight = F.count(F.lit(1)).alias("size"), F.sum(F.length("tokens")).alias("bytes")
        sizes = rows.groupBy("region").agg(size, weight, F.max("asks").alias("open")).where("open and size > 1")
        large = cut(sizes.where(beyond(cap, cap_bytes)).select("region", "size", "bytes"), "large")
        if large.isEmpty():
            links.append(join_small_regions(rows, percent))
            break
        names = large.select("region")
        links.append(join_small_regions(join_small(rows, names, "region", "left_anti", 16), percent))
        big = join_small(rows, names, "region", "left_semi", 16)
        if level == depth:
            links.append(join_small_regions(blocks(big, large, cap, cap_bytes), percent))
            break
        cells, found, blocked = split(big, percent, pivots, level, cap, cap_bytes)
        links += [found, join_small_regions(blocked, percent)]
        rows = cut(cells, "regions")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def sets_of(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(fp, tokens), once, of the classes in `wanted`."""
    lookup = Lookup(packed_longs(wanted, "fp")) if small(wanted, 8, BROADCAST_BYTES) else None

    def run(batches):
        for sets in distinct_sets(batches, 1, k):
            fps = np.array([fp for fp, _ in sets], np.int64)
            at = np.arange(len(fps)) if lookup is None else lookup.find(fps.view(np.uint64))[0]
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array([sets[i][1].tobytes() for i in at.tolist()], pa.binary())], names=["fp", "tokens"])

    found = documents.mapInArrow(run, "fp long, tokens binary")
    return (found if lookup is not None else found.join(wanted, "fp", "left_semi")).dropDuplicates(["fp"])


def regions_of(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, slack: int = SLACK, hot: int = HOT_TOKENS, least: int = HOT_COUNT) -> DataFrame:
    """Members (region, fp, n) of the regions around elected centres that have two or more."""
    frequent = hot_tokens(documents, k, percent, slack, hot, least)
    rows = cut(shared(prefixes(documents, k, percent, slack, frequent)), "tokens")
    size = F.col("meta").bitwiseAND((1 << 32) - 1)
    enough = 1 + F.floor(F.lit(slack) * F.lit(percent) * size / 10_000)
    able = cut(rows.groupBy("fp", "meta").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") >= enough).select("fp", size.alias("n")), "able")
    members = cut(elect(rows.join(able, "fp", "left_semi")), "regions")
    alone = members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    return cut(members.join(alone, "region", "left_semi").join(able, "fp").select("region", "fp", "n"), "members")


def shipped(documents: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The members with their sets, ready to be joined; each set is made once and travels to its regions."""
    sets = sets_of(documents, cut(members.select("fp").distinct(), "wanted"), k)
    return members.join(sets, "fp").select("region", "fp", F.lit(True).alias("asks"), F.col("fp").alias("group"), "tokens")


def links(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, cap: int = REGION_SETS, cap_bytes: int = REGION_BYTES, **options) -> DataFrame:
    """True links (a, b) between set hashes, with the components of all links."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    members = regions_of(docs, k, percent, **options)
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum("n")).alias("bytes"))
    large = cut(sizes.where(beyond(cap, cap_bytes)).select("region"), "large")
    found = join_small_regions(shipped(docs, join_small(members, large, "region", "left_anti", 16), k), percent)
    if large.isEmpty():
        return found
    return found.unionByName(join_regions(cut(shipped(docs, join_small(members, large, "region", "left_semi", 16), k), "shipped"), percent, cap, cap_bytes))


def beyond(cap: int, cap_bytes: int) -> Column:
    """Regions that one task does not join by itself."""
    return (F.col("size") > cap) | (F.col("size") > 2) & (F.col("bytes") > cap_bytes)


def jaccard_components(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; its set's hash and that of its component's root; its row key."""
    k = options.get("k", SHINGLE)
    own = cut(describe(documents.select(F.col("doc_id").cast("long"), "text", *row_key()), k), "sets")
    roots = cut(components(links(documents, **options)), "roots")
    classes = own.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("fp", "root", "component_id")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return own.join(ids, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "fp", "root", *ROW_KEY)


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One document of each component, that with the smallest doc_id (a null one comes last); those without words all stay."""
    found = cut(jaccard_components(documents, **options).where("n_shingles > 0").select("root", "doc_id", *ROW_KEY), "components")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)).alias("first"))
    go = cut(found.join(stay, "root").where(F.struct(*ROW_KEY) != F.struct(*[f"first.{k}" for k in ROW_KEY])).select(*ROW_KEY).distinct(), "copies")
    left = join_small(documents.select(F.struct("*").alias("row"), *row_key()), go, ROW_KEY, "left_anti", 32)
    again = cut(found.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ROW_KEY), "again")
    if not again.isEmpty():  # rows repeated whole
        once = left.join(again, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
        left = left.join(again, ROW_KEY, "left_anti").unionByName(once)
    return left.select("row.*")
