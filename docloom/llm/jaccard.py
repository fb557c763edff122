"""Exact n-gram Jaccard join at a threshold, by set relations.

Sets are the distinct five-word shingles of a text. Equal sets are one node. A global order puts frequent
shingles last (their document counts are taken over all texts), and a pair at or above the threshold must share
``COMMON`` shingles among the first ``n - ceil(t * n) + COMMON`` of each set (all of the fewer that tiny sets need),
so only these prefixes are indexed and pairs that meet less often are never looked at.

Index-level skipping: each inverted list is ordered by set size and by the shingle's position in the set, and cut into
blocks of entries that agree in both. Sizes bound the partners of a block, positions bound the overlap that is still
possible, and a pair of blocks that can't reach the threshold is skipped without a look at its entries.

Answer-level skipping: in a long list few leading sets are compared with all others first. Members that turn out
similar to a leader share its component and need no answers of their own. The lists of one leader are a family of
sets that are alike. The answers of members left outside the family's largest component are derived from the leader's:
a member Y is the leader L without ``|L - Y|`` shingles and with those of ``Y - L``, so with the differences d(Y) from
the leader the overlap of two members is ``|L| - |L - Y| - |L - Z| + |d(Y) & d(Z)|``, and whole sets aren't compared again.

Shingles in very many texts (``HOT``) are no task's list: their leaders are minima that combine before the shuffle, and
their members meet the leaders by a join.

Every pair and every family is decided on whole sets.

Null, empty and wordless texts have the empty set and link with nothing; texts of fewer words than a shingle
are one whole-text shingle. Repeated rows and equal texts share a component; ties go to the least id. Rows with null ids
link like others. Very long texts are hashed in chunks. Extra columns play no part. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, mapped, only, release_worker_cache, staged
from ._words import SHINGLE, chunks, mixed, shingle_sets

THRESHOLD = Fraction(3, 4)
#: Shingles in at least so many texts are ordered last, the more frequent the later.
FREQUENT = 8
#: Most frequent shingles whose order every task knows: 9 bytes each. Any order is exact; this bounds memory.
ORDERED_AT_MOST = 4_000_000
#: Shingles that the prefixes of a pair must share.
COMMON = 4
#: Lists up to this length are compared at once, longer ones by leaders first.
SHORT_LIST = 16
LEADERS = 3
#: Shingles in 2**HOT texts or more are joined with their leaders as rows.
HOT = 12
#: Members of a family in one block: a FAMILY_BLOCKS-th of the family within these bounds; and shingles of their
#: differences. A task holds two blocks. Rows and columns of its products.
FAMILY_BLOCK, LARGEST_BLOCK = 256, 4096
FAMILY_BLOCKS = 32
FAMILY_SHINGLES = 500_000
ROW_BLOCK = 512
COLUMN_BLOCK = 2048
#: Edges that one task unites; more are contracted by all executors.
LOCAL_EDGES = 1_000_000
#: Node numbers that are broadcast to select texts: 8 bytes each; a shuffle join takes over beyond.
BROADCAST_NODES = 4_000_000
#: Shingles of all leaders that are broadcast: 8 bytes each; a shuffle join takes over beyond. The same for families.
BROADCAST_SHINGLES = 2_000_000
BROADCAST_FAMILIES = 500_000

#: Shingles that a task holds before it sends them on.
HELD_SHINGLES = 1_000_000

_U = np.uint64


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _key(hashes: np.ndarray, parts: int) -> np.ndarray:
    """(part, low 32 bits) of a hash as one number: as many bits as the table's size asks for."""
    return ((hashes >> _U(32)) % _U(parts)) << _U(32) | (hashes & _U(0xFFFFFFFF))


def _node(members: np.ndarray) -> int:
    """A set's number: 64 bits of a digest of its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _split_by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(parts + 1, dtype=np.uint64) << _U(32))
    return order, cuts


def frequent_shingles(texts: DataFrame, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, frequency class) of the shingles in many texts, counted over all texts."""
    spark = texts.sparkSession
    parts = _parts(spark)

    def pack(batches):
        release_worker_cache()
        found, size = [], 0
        for batch in batches:
            for _, _, data, at in chunks(batch):
                for s in shingle_sets(data, at, n):
                    found.append(s)
                    size += len(s)
                if size >= HELD_SHINGLES:
                    yield from packed(found)
                    found, size = [], 0
        if size:
            yield from packed(found)

    def packed(found):
        """One entry for each shingle of a block: those that occur once, and the others with their number."""
        keys = np.sort(_key(np.concatenate(found), parts))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
        keys = keys[first]
        cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << _U(32))
        low, rows = (keys & _U(0xFFFFFFFF)).astype(np.uint32), []
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own, n = low[cuts[p] : cuts[p + 1]], times[cuts[p] : cuts[p + 1]]
            rows.append((int(p), own[n == 1].tobytes(), own[n > 1].tobytes(), n[n > 1].tobytes()))
        columns = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=["part", "low", "more", "times"])

    def count(batches):
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["part"], []).append((row["low"], row["more"], row["times"]))
        for part in list(held):
            low, more, times = (np.frombuffer(b"".join(x), dtype=np.uint32) for x in zip(*held.pop(part), strict=True))
            values, times = np.concatenate([low, more]), np.concatenate([np.ones(len(low), np.uint32), times])
            order = np.argsort(values, kind="stable")
            values = values[order]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            times = np.add.reduceat(times[order], first, dtype=np.int64)
            often = times >= FREQUENT
            level = np.floor(np.log2(times[often])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((part << 32) + values[first[often]].astype(np.int64), pa.int64()), pa.array(level, pa.int32())], names=["key", "level"])

    counted = staged(mapped(mapped(texts, pack, "part int, low binary, more binary, times binary").repartition(parts, "part"), count, "key long, level int"), "frequent")
    levels = sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, total = 64, 0
    for level, m in levels:
        if total + m > ORDERED_AT_MOST:
            break
        lowest, total = level, total + m
    got = counted.where(F.col("level") >= lowest).toArrow()
    discard(counted)
    keys, level = got.column("key").to_numpy(), got.column("level").to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), level[order].astype(np.uint8)


def _prefix_length(n: int, t: Fraction) -> int:
    return min(n, n - ceil(t * n) + COMMON)


def set_table(texts: DataFrame, n: int = SHINGLE, t: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, node, prefix, hot): one row per text; ``hot`` has the keys of the prefix's shingles in very many
    texts, ``prefix`` the others. Written once to the shared folder."""
    spark = texts.sparkSession
    parts = _parts(spark)
    order = spark.sparkContext.broadcast(frequent_shingles(texts, n))

    def run(batches):
        release_worker_cache()
        keys, level = order.value
        for batch in batches:
            size, node, prefix, hot = [], [], [], []
            for _, _, data, at in chunks(batch):
                for s in shingle_sets(data, at, n):
                    size.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    take, late = _prefix_length(len(s), t), None
                    if len(keys) and len(s):
                        mine = _key(s, parts)
                        at_key = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                        late = np.where(keys[at_key] == mine, level[at_key], 0)
                        rare = s[late == 0]
                        if len(rare) >= take:
                            s, late = rare, None
                        else:
                            first = np.lexsort((s, late))[:take]
                            s, late = s[first], late[first]
                    s = s[:take]
                    burst = len(s) if late is None else int(np.searchsorted(late, HOT))
                    prefix.append(s[:burst].tobytes())
                    hot.append(_key(s[burst:], parts).tobytes() if burst < len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary()), pa.array(hot, pa.binary())], names=["doc_id", "n_shingles", "node", "prefix", "hot"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    table = staged(mapped(texts, run, f"doc_id {kind}, n_shingles long, node long, prefix binary, hot binary"), "sets")
    order.unpersist()
    return table


def _blocks(node, size, place, run):
    """(first, length) of the blocks of entries that agree in list, size and place. Entries come in this order."""
    first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (size[1:] != size[:-1]) | (place[1:] != place[:-1])])
    return first, np.diff(np.r_[first, len(node)])


def _open_pairs(node, size, place, run, t: Fraction):
    """Pairs in the same list that sizes and positions leave open, block by block. Blocks of a list are in order of size,
    so the partner is never smaller and the size test ends the scan."""
    num, den = t.numerator, t.denominator
    found: list[np.ndarray] = []
    if not len(node):
        return found
    first, length = _blocks(node, size, place, run)
    list_of, size_of, place_of = run[first], size[first], place[first]
    alive = np.arange(len(first))
    d = 0
    while len(alive):
        i, j = alive, alive + d
        inside = j < len(first)
        i, j = i[inside], j[inside]
        near = (list_of[i] == list_of[j]) & (den * size_of[i] >= num * size_of[j])
        i, j = i[near], j[near]
        alive = i
        small, large = size_of[i], size_of[j]
        left = np.minimum(small - place_of[i], large - place_of[j]) + COMMON - 1  # of a needed shingle and all behind it
        open_ = (left * (den + num) >= num * (small + large)) & ((d > 0) | (length[i] > 1))
        i, j, large = i[open_], j[open_], large[open_]
        count = length[i] * length[j]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(length[j], count)
        x, y = np.repeat(first[i], count) + at // width, np.repeat(first[j], count) + at % width
        need = np.repeat(np.minimum(COMMON, -(-num * large // den)), count)
        keep = (node[x] != node[y]) & ((x < y) | (d > 0))
        x, y = node[x[keep]], node[y[keep]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y), need[keep]]))
        d += 1
    return found


def _candidates(reps: DataFrame, t: Fraction) -> DataFrame:
    """Rows (a, b, met, need, members): a pair that met in some short lists and how often it must meet in all, or a long
    list (a is its number) to come back to."""
    parts = _parts(reps.sparkSession)

    def dealt(nodes, sizes, entries):
        lengths = np.array([len(e) for e in entries])
        owner = np.repeat(np.arange(len(entries), dtype=np.uint32), lengths)
        place = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
        keys = _key(np.concatenate(entries), parts)
        by_part, cuts = _split_by_part(keys, parts)
        rows = []
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            some = by_part[cuts[p] : cuts[p + 1]]
            who, back = np.unique(owner[some], return_inverse=True)
            rows.append((int(p), nodes[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), back.astype(np.uint32).tobytes(), np.minimum(place[some], 65535).astype(np.uint16).tobytes(), (keys[some] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["part", "nodes", "sizes", "owner", "place", "low"])

    def scatter(batches):
        release_worker_cache()
        nodes, sizes, entries, held = [], [], [], 0
        for batch in batches:
            nodes.append(batch.column("node").to_numpy())
            sizes.append(batch.column("n_shingles").to_numpy())
            entries += [np.frombuffer(p.as_buffer(), dtype=np.uint64) for p in batch.column("prefix")]
            held += sum(map(len, entries[-batch.num_rows :])) if batch.num_rows else 0
            if held >= HELD_SHINGLES:
                yield from dealt(np.concatenate(nodes), np.concatenate(sizes), entries)
                nodes, sizes, entries, held = [], [], [], 0
        if held:
            yield from dealt(np.concatenate(nodes), np.concatenate(sizes), entries)

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                owner = np.frombuffer(row["owner"], np.uint32)
                held.setdefault(row["part"], []).append(
                    (np.frombuffer(row["low"], np.uint32), np.frombuffer(row["nodes"], np.int64)[owner], np.frombuffer(row["sizes"], np.uint32)[owner], np.frombuffer(row["place"], np.uint16))
                )
        for part in list(held):
            low, node, size, place = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            order = np.argsort(low, kind="stable")
            low = low[order]
            alike = np.r_[False, low[1:] == low[:-1]]
            shared = alike | np.r_[alike[1:], False]
            order, low = order[shared], low[shared]
            node, size, place = node[order], size[order].astype(np.int64), place[order].astype(np.int64)
            order = np.lexsort((node, place, size, low))
            low, node, size, place = low[order], node[order], size[order], place[order]
            if not len(low):
                continue
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            length = np.diff(np.r_[first, len(low)])
            short = np.repeat(length <= SHORT_LIST, length)
            found = _open_pairs(node[short], size[short], place[short], low[short], t)
            if found:
                pairs = np.concatenate(found, axis=1)
                pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
                first_of = np.flatnonzero(np.r_[True, (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])]) if pairs.shape[1] else np.zeros(0, np.int64)
                met = np.diff(np.r_[first_of, pairs.shape[1]])
                need = np.minimum.reduceat(pairs[2], first_of) if len(first_of) else pairs[2]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, first_of]), pa.array(pairs[1, first_of]), pa.array(met), pa.array(need), pa.nulls(len(first_of), pa.binary())], names=["a", "b", "met", "need", "members"])
            lists: dict[int, bytes] = {}
            for k in np.flatnonzero(length > SHORT_LIST):
                members = np.unique(node[first[k] : first[k] + length[k]])
                lists[_node(members.astype(np.uint64))] = members.tobytes()
            names = list(lists)
            for k in range(0, len(names), 64):
                some = names[k : k + 64]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), none, none, none, pa.array([lists[x] for x in some], pa.binary())], names=["a", "b", "met", "need", "members"])

    scattered = mapped(reps.where("length(prefix) > 0"), scatter, "part int, nodes binary, sizes binary, owner binary, place binary, low binary")
    return mapped(scattered.repartition(parts, "part"), meet, "a long, b long, met long, need long, members binary")


def _leaders(nodes: np.ndarray) -> list[int]:
    """The same few leaders for lists with nearly the same members: least under fixed hash orders."""
    return sorted({int(nodes[np.argmin(mixed(nodes.astype(np.uint64) + _U(k)))]) for k in range(LEADERS)})


def _led(lists: DataFrame) -> DataFrame:
    """(lead, node, own): members of long lists with the lists' leaders; own marks the first leader."""

    def spread(batches):
        for batch in batches:
            for members in batch.column("members").to_pylist():
                nodes = np.frombuffer(members, np.int64)
                leaders = _leaders(nodes)
                columns = np.repeat(leaders, len(nodes)), np.tile(nodes, len(leaders)), np.arange(len(leaders) * len(nodes)) < len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lead", "node", "own"])

    return mapped(lists.dropDuplicates(["a"]).select("members"), spread, "lead long, node long, own boolean")


def _hot_led(reps: DataFrame) -> DataFrame | None:
    """The same for the lists of shingles in very many texts: leaders are least under fixed hash orders."""
    hot = reps.where("hot is not null").select("node", "hot")
    if hot.isEmpty():
        return None

    def spread(batches):
        for batch in batches:
            nodes, keys = batch.column("node").to_numpy(), [np.frombuffer(h.as_buffer(), dtype=np.int64) for h in batch.column("hot")]
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, [len(k) for k in keys]))], names=["key", "node"])

    entries = staged(mapped(hot, spread, "key long, node long"), "hot-entries")
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"].alias(f"l{k}") for k in range(LEADERS)]
    leaders = staged(entries.groupBy("key").agg(*least, F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"), "hot-leaders")
    small = F.broadcast(leaders) if leaders.count() <= BROADCAST_FAMILIES else leaders
    each = F.array(*[F.struct(F.col(f"l{k}").alias("lead"), F.lit(k == 0).alias("own")) for k in range(LEADERS)])
    return entries.join(small, "key").select("node", F.explode(each).alias("x")).select("x.lead", "node", "x.own").distinct()


def _whole_sets(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, shingles) for the wanted nodes only: one text of each is hashed again."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in chunks(batch):
                found = [(_node(s), s.astype(np.int64)) for s in shingle_sets(data, at, n) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = nodes.select(F.col("doc_id").alias("_wanted")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    return mapped(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi"), run, "node long, shingles array<long>")


def _sets_of(nodes: DataFrame, texts: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, shingles): the whole sets of some nodes."""
    wanted = staged(reps.select("node", "doc_id").join(nodes.distinct(), "node", "left_semi"), "wanted")
    sets = staged(_whole_sets(texts, wanted, n).dropDuplicates(["node"]), "whole-sets")
    discard(wanted)
    return sets


def _similar(common, x, y, t: Fraction):
    """Whether sets of sizes x and y with so much in common reach the threshold."""
    return common * (t.denominator + t.numerator) >= (x + y) * t.numerator


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that link, decided on their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), t)).select("a", "b")


def _with_leader(led: DataFrame, sets: DataFrame) -> DataFrame:
    """``led`` with the leader's set x and the member's set y. The leaders' sets are broadcast if they are small in all."""
    leaders = sets.join(led.select(F.col("lead").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("lead"), F.col("shingles").alias("x"))
    size = leaders.agg(F.sum(F.size("x"))).first()[0] or 0
    return led.join(sets.select("node", F.col("shingles").alias("y")), "node").join(F.broadcast(leaders) if size <= BROADCAST_SHINGLES else leaders, "lead")


def _united(batches):
    """(node, component) of a bounded edge table by union-find in one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 200, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of an undirected graph, component being its least node.

    Up to ``local_edges`` edges, counted first, are united in one task of bounded memory. Larger graphs go by alternating
    large-star and small-star contractions: each round works on the edge table in the shared folder; a hub's
    neighbours meet only through a minimum, which is combined before the shuffle, and one join. The number of rounds grows
    with the logarithm of the graph; a graph that isn't contracted after ``rounds`` is an error.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= local_edges:
        return mapped(edges.coalesce(1), _united, "node long, component long")
    sign = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == sign:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        sign = mark
        # large star: neighbours above a node hang on the least of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node itself, hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        done, edges = edges, staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(done)
    raise RuntimeError(f"the graph is not contracted after {rounds} rounds")


def _family_links(led: DataFrame, found: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): links that join the components of families (lead, node), a spanning forest of them at most.

    Members carry their differences from the leader, and overlaps are products of these, a block of rows and columns at a
    time. Only members outside a family's largest component (the rest) need answers: blocks of the rest meet blocks of
    all members, one task for a pair of blocks, which bounds a task's memory. A family whose rest fits a block sends
    each member once.
    """
    rows = led.join(found, "node", "left").select("lead", "node", F.coalesce("component", "node").alias("component"))
    kinds = rows.groupBy("lead", "component").agg(F.count("*").alias("n"))
    open_ = kinds.groupBy("lead").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.sum("n").alias("k"), F.max("n").alias("n_core"), F.count("*").alias("kinds")).where("kinds > 1")
    open_ = staged(open_.select("lead", "core", "k", (F.col("k") - F.col("n_core")).alias("r")), "open-families")
    few = F.broadcast(open_) if open_.count() <= BROADCAST_FAMILIES else open_
    both = _with_leader(rows.join(few.select("lead", "core"), "lead"), sets)
    away = F.array_except("x", "y")
    far = both.select("lead", "node", "component", (F.col("component") != F.col("core")).alias("rest"), F.size("x").alias("n_lead"), F.size("y").alias("size"), F.size(away).alias("away"), F.concat(away, F.array_except("y", "x")).alias("far"))
    far = staged(far, "differences")
    shingles = far.groupBy("lead").agg(F.sum(F.size("far")).alias("all"), F.sum(F.when(F.col("rest"), F.size("far")).otherwise(0)).alias("some"))
    block = F.least(F.greatest(F.col("k") / FAMILY_BLOCKS, F.lit(FAMILY_BLOCK)), F.lit(LARGEST_BLOCK))
    blocks = lambda members, held: F.greatest(F.ceil(F.col(members) / block), F.ceil(F.col(held) / FAMILY_SHINGLES), F.lit(1)).cast("int")
    cut = staged(open_.join(shingles, "lead").select("lead", blocks("r", "some").alias("rows"), blocks("k", "all").alias("columns")), "blocks")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_FAMILIES else cut
    far = far.join(cut, "lead")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    keep = ["lead", "node", "component", "n_lead", "size", "away", "far"]
    left = far.where("rest").select(*keep, of("rows").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("row"))
    right = far.select(*keep, F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), of("columns").alias("j"), F.lit(False).alias("row"))

    def links(key, table):
        node, part, is_row = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("row").to_numpy(zero_copy_only=False)
        size, away = table.column("size").to_numpy().astype(np.int64), table.column("away").to_numpy().astype(np.int64)
        n_lead = int(table.column("n_lead")[0].as_py())
        lists = table.column("far").combine_chunks()
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
        _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        width = int((times > 1).sum())
        kinds, kind = np.unique(part, return_inverse=True)
        parent = np.arange(len(kinds))

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        out = []
        rest, members = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        for lo in range(0, len(rest), ROW_BLOCK):
            some = rest[lo : lo + ROW_BLOCK]
            common = np.zeros((len(some), len(members)), dtype=np.float32)
            for first in range(0, width, COLUMN_BLOCK):
                mine = (column >= first) & (column < first + COLUMN_BLOCK)
                member = np.zeros((len(node), min(COLUMN_BLOCK, width - first)), dtype=np.float32)
                member[owner[mine], column[mine] - first] = 1
                common += member[some] @ member[members].T
            overlap = n_lead - away[some][:, None] - away[members][None, :] + common.astype(np.int64)
            linked = (overlap > 0) & _similar(overlap, size[some][:, None], size[members][None, :], t) & (kind[some][:, None] != kind[members][None, :])
            for r, row in zip(some, linked, strict=True):
                at = members[np.flatnonzero(row)]
                for c in at[np.unique(kind[at], return_index=True)[1]]:
                    x, y = root(kind[r]), root(kind[c])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((min(node[r], node[c]), max(node[r], node[c])))
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    return left.unionByName(right).groupBy("lead", "i", "j").applyInArrow(links, "a long, b long")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, t: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) per text; component_id is the least id reachable by links (null if no
    text of the component has an id). A text with null ids only is fetched again by the null id."""
    texts = only(df, doc_id=id_col, text=text_col)
    sets = set_table(texts, n, t)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_shingles", "prefix", "hot")).alias("r")
    reps = staged(sets.where("node is not null").groupBy("node").agg(first).select("node", "r.doc_id", "r.n_shingles", "r.prefix", "r.hot"), "nodes")
    met = staged(_candidates(reps, t), "candidates")
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")
    led, hot = _led(met.where("b is null")), _hot_led(reps)
    led = staged((led if hot is None else led.unionByName(hot)).where("lead <> node").groupBy("lead", "node").agg(F.bool_or("own").alias("own")), "led")
    pairs = staged(pairs, "pairs")
    discard(met)
    ends = [pairs.select(F.col("a").alias("node")), pairs.select(F.col("b").alias("node")), led.select(F.col("lead").alias("node")), led.select("node")]
    whole = _sets_of(ends[0].union(ends[1]).union(ends[2]).union(ends[3]), texts, reps, n)
    answered = _with_leader(led.select("lead", "node"), whole).where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), t))
    linked = staged(_linked(pairs, whole, t).union(answered.select(F.col("lead").alias("a"), F.col("node").alias("b"))), "links")
    found = staged(components(linked), "components")
    families = led.where("own").select("lead", "node")
    if not families.isEmpty():
        leaders = families.select("lead").distinct().select("lead", F.col("lead").alias("node"))
        more = staged(_family_links(families.union(leaders), found, whole, t), "family-links")
        found = staged(components(linked.union(more)), "components") if not more.isEmpty() else found
    discard(pairs, led, whole)
    labels = reps.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(least, "component").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
