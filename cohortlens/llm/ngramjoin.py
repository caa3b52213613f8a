"""Operator 6: n-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_bits, bloom_of, bloom_slots, checkpointed, column, columns, connected_components, filter_size, free_names, join_spread, large_join, lean_batches, parted, with_fields
from .kernels import mix, pieces, shingle_sets

#: Shingles in more distinct sets than this are frequent and indexed in pairs.
RARE = 16
#: Shingles, about, that one verifying task takes from each of its two blocks.
BLOCK = 1 << 17
#: Sets of one signature that are compared in one task; more are compared in pairs of parts of this size.
GROUP = 4096


def hash_limit(pct: int) -> int:
    """Shingles with smaller hashes are counted: a bit more, in sixteenths of all, than a prefix needs."""
    return min(15, math.ceil((100 - pct) * 0.16 + 1.6)) << 60


def extension(n: np.ndarray, pct: int) -> np.ndarray:
    """Groups of frequent shingles for sets of band b(n) and b(n) + 1: arrays (band, groups, groups of the next).

    Bands are so wide that two sets that may link lie in the same or in
    neighbouring bands. A band's groups are no more than a pair of its smallest
    sets has common shingles, less one, and a fiftieth of its smallest size.
    """
    band = np.floor(np.log(np.maximum(n, 1)) / math.log(100 / pct) + 1e-9).astype(np.int64)

    def groups(b):
        low = np.floor((100 / pct) ** (b - 1.0))  # sets of the band below meet at this band's key
        return np.maximum(0, np.minimum(low // 50, np.ceil(low * pct / 100) - 1)).astype(np.int64)

    return band, groups(band), groups(band + 1)


def prefix_length(n: np.ndarray, pct: int) -> np.ndarray:
    """Shingles in a set's prefix, with the extension: two sets that link have groups + 1 common ones there."""
    _, g, g1 = extension(n, pct)
    return np.minimum(n, n - -(-n * pct // 100) + 1 + np.maximum(g, g1))


def sketches(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parity sketch of each set: 64-bit words, set after set, and where each set's begin.

    A set of n shingles has a power of two of bits, n / 2 or some more, and each
    shingle flips one. Two sets that differ in k shingles have sketches that
    differ in k bits at most, and folding the upper half of a sketch on the
    lower gives the sketch of half the bits.
    """
    n = np.diff(at)
    words = sketch_words(n)
    start = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(start[-1], np.uint64)
    h = mix(s + np.uint64(0xB175))
    bit = h & (np.repeat(words, n).astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(out, np.repeat(start[:-1], n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, start


def sketch_words(n: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(n, 1) / 128)).clip(0).astype(np.int64)


def set_profiles(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """(node, n, counted, toks, sketch) of every row with shingles: its set's identity and size, the shingles a prefix
    may hold (all counted ones, then as many others, by hash, as the prefix length asks for), and its size and parity sketch in one."""
    limit = np.uint64(hash_limit(pct))

    def profile(batches):
        for batch in pieces(batches, 0):
            s, at = shingle_sets(batch.column(0), k)
            n = np.diff(at)
            key = set_identity(s, at)
            low = np.concatenate([[0], np.cumsum(s < limit)])
            counted = low[at[1:]] - low[at[:-1]]  # hashes ascend within a set
            take = np.maximum(counted, prefix_length(n, pct))
            take[n == 0] = 0
            inside = np.arange(len(s)) - np.repeat(at[:-1], n)
            toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(s[inside < np.repeat(take, n)].view(np.int64)))
            bits, start = sketches(s, at)
            head = start + np.arange(len(start))
            packed = np.empty(head[-1], np.uint64)
            packed[head[:-1]] = n
            packed[np.delete(np.arange(head[-1]), head[:-1])] = bits
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((head * 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(counted.astype(np.int32)), toks, sketch],
                names=["node", "n", "counted", "toks", "sketch"],
            )

    return docs.select("text").mapInArrow(profile, "node long, n long, counted int, toks array<long>, sketch binary").where("n > 0")


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node) of every row: its set's size and identity."""

    def keys(batches):
        for batch in pieces(batches, 1):
            s, at = shingle_sets(batch.column(1), k)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(set_identity(s, at).view(np.int64))], names=["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long")


def set_identity(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set of shingles, whatever their order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s + np.uint64(77)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def signatures(prefixes: DataFrame, pct: int, rare: int) -> DataFrame:
    """(sig, node) of sets (node, n, counted, own: their repeated shingles with the number of sets holding each).

    Shingles are ordered: counted ones by frequency and hash, then the others
    by hash. Rare shingles of a prefix are signatures of their own. The
    frequent ones are dealt to groups by hash and each pair within a group is
    one; as there are as many groups as a prefix is extended by, two sets that
    link share a rare shingle or two frequent ones of a group.
    """
    limit = np.uint64(hash_limit(pct))

    def index(batches):
        for batch in batches:
            key, n, counted = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            toks = lists.values.field("tok").to_numpy().view(np.uint64)
            dfs = lists.values.field("df").to_numpy()
            low = np.concatenate([[0], np.cumsum(toks < limit)])
            length = prefix_length(n, pct)
            once = counted - (low[at[1:]] - low[at[:-1]])  # counted shingles of this set only come first
            sig, node = [], []
            # a prefix of shingles that no other set has has no signature
            for d in np.flatnonzero((length > once) & (at[1:] > at[:-1])).tolist():
                tok, df = toks[at[d] : at[d + 1]], dfs[at[d] : at[d + 1]]
                is_counted = tok < limit
                order = np.lexsort((tok, df))
                first = order[is_counted[order]][: max(0, int(length[d] - once[d]))]
                rest = np.flatnonzero(~is_counted)
                rest = rest[np.argsort(tok[rest])] if length[d] > counted[d] else rest[:0]
                take = np.concatenate([first, rest])
                tok, df = tok[take], df[take]
                band, g, g1 = (int(x[0]) for x in extension(n[d : d + 1], pct))
                out = [tok[df <= rare]]
                often = tok[df > rare]
                for b, groups in ((band, g), (band + 1, g1)):
                    if groups == 0:
                        out.append(mix(often + np.uint64(b)))
                        continue
                    group = mix(often) % np.uint64(groups)
                    for x in np.unique(group):
                        t = np.sort(often[group == x])
                        i, j = np.triu_indices(len(t), 1)
                        out.append(mix(mix(t[i] + np.uint64(b)) * np.uint64(3) + t[j]))
                out = np.unique(np.concatenate(out))
                sig.append(out)
                node.append(np.full(len(out), key[d], np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], names=["sig", "node"])

    return prefixes.select("node", "n", "counted", "own").mapInArrow(index, "sig long, node long")


def _root(parent: np.ndarray) -> np.ndarray:
    """The root of every place, by doubling."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


class Sketches:
    """The sizes and sketches of a batch of sets, compared in pairs."""

    def __init__(self, column: pa.Array):
        self.flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        size = pa.compute.binary_length(column).to_numpy().astype(np.int64) // 8
        self.start = np.cumsum(size) - size + 1
        self.words, self.n = size - 1, self.flat[self.start - 1].astype(np.int64)

    def _of(self, i: np.ndarray, words: int) -> np.ndarray:
        """Sketches of sets i, folded to so many words."""
        out = np.zeros((len(i), words), np.uint64)
        for own in np.unique(self.words[i]).tolist():
            at = np.flatnonzero(self.words[i] == own)
            whole = self.flat[self.start[i[at]][:, None] + np.arange(own)]
            out[at] = np.bitwise_xor.reduce(whole.reshape(len(at), own // words, words), axis=1)
        return out

    def near(self, i: np.ndarray, j: np.ndarray, pct: int) -> np.ndarray:
        """Whether sets i and j may link: by their sizes, and as they differ in no fewer shingles than their sketches do in bits."""
        a, b = self.n[i], self.n[j]
        out = (100 * np.minimum(a, b) >= pct * np.maximum(a, b))
        least = np.minimum(self.words[i], self.words[j])
        for words in np.unique(least[out]).tolist():
            at = np.flatnonzero(out & (least == words))
            step = max(1, (1 << 17) // words)
            for k in range(0, len(at), step):
                p = at[k : k + step]
                away = np.bitwise_count(self._of(i[p], words) ^ self._of(j[p], words)).sum(axis=1, dtype=np.int64)
                out[p] = away * (100 + pct) <= (100 - pct) * (a[p] + b[p])
        return out


def near_pairs(group: np.ndarray, part: np.ndarray, across: np.ndarray, sketch: Sketches, pct: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within a group that may link; ``across`` rows only pair with another part.

    Groups are runs of rows, by size within. Rows a distance apart are compared,
    distance by distance, until sizes are too far apart; rows that are
    connected already aren't. Memory is that of the rows.
    """
    parent = np.arange(len(group))
    i, away, edges = np.arange(max(0, len(group) - 1)), 1, []
    while len(i):
        i = i[i + away < len(group)]
        i = i[(group[i] == group[i + away]) & (100 * sketch.n[i] >= pct * sketch.n[i + away])]
        if not len(i):
            break
        open_ = (parent[i] != parent[i + away]) & ~(across[i] & (part[i] == part[i + away]))
        a = i[open_]
        a = a[sketch.near(a, a + away, pct)] if len(a) else a
        for x, y in zip(a.tolist(), (a + away).tolist(), strict=True):
            rx, ry = x, y
            while parent[rx] != rx:
                rx = parent[rx]
            while parent[ry] != ry:
                ry = parent[ry]
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                edges.append((x, y))
        if len(a):
            parent = _root(parent)
        away += 1
    return edges


def candidate_edges(postings: DataFrame, nodes: DataFrame, pct: int, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of sets that share a signature and may link by size and sketch, a spanning forest for each group.

    The sets of a signature are led by the least of them, and a group is all
    sets of a leader's signatures: every pair that shares a signature is in a
    group, and sets that share many meet once or a few times. The sets of a
    group of more than ``group`` are dealt to parts by hash, and each pair of
    parts is a task's.
    """
    held = checkpointed(postings.groupBy("sig").agg(F.count("*").alias("m"), F.min("node").alias("leader")).where("m > 1"))
    led = checkpointed(join_spread(postings, held, "sig", "m", F.col("node")).select("leader", "node").distinct())
    sizes = led.groupBy("leader").agg(F.count("*").alias("m"), F.ceil(F.count("*") / group).cast("int").alias("parts"))
    met = join_spread(led, sizes, "leader", "m", F.col("node"))
    met = large_join(met, nodes.select("node", "n", "sketch"), "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # the two parts of a task and the row's own in one number
    place = F.least("part", "other").cast("long") * (1 << 42) + F.greatest("part", "other") * (1 << 21) + F.col("part")
    rows = met.select("leader", place.alias("place"), "n", "node", "sketch")

    def compare(batches):
        kept = None
        for batch in batches_with_end(batches):
            if batch is not None:
                kept = batch if kept is None else pa.concat_batches([kept, batch])
            if kept is None or not kept.num_rows:
                continue
            leader, place = (kept.column(k).to_numpy() for k in range(2))
            task = place >> 21
            change = np.concatenate([[0], np.cumsum((leader[1:] != leader[:-1]) | (task[1:] != task[:-1]))])
            # the last task may go on in the next batch
            cut = int(np.searchsorted(change, change[-1])) if batch is not None else len(change)
            if not cut:
                continue
            now, kept = kept.slice(0, cut), kept.slice(cut)
            node, own = now.column(3).to_numpy(), place[:cut] & ((1 << 21) - 1)
            # of two parts, the pairs within one are compared elsewhere
            across = (task >> 21 != task & ((1 << 21) - 1))[:cut]
            edges = np.array(near_pairs(change[:cut], own, across, Sketches(now.column(4)), pct), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names=["a", "b"])

    task = F.shiftright("place", 21)
    return rows.repartition("leader", task).sortWithinPartitions("leader", task, "n", "node").mapInArrow(compare, "a long, b long")


def batches_with_end(batches):
    yield from batches
    yield None


def _union_find(n: int):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def forest(sets: list[np.ndarray], pct: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |x & y| >= pct * |x | y| among sets; with split, of those across it only.

    Goes through the sets in order, adding up common shingles by inverted
    lists: exact for every pair, in memory of the input's size.
    """
    parent, find = _union_find(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, tok = np.unique(flat, return_inverse=True)
    order = np.lexsort((owner, tok))
    owners, bounds = owner[order], np.searchsorted(tok[order], np.arange((tok.max() + 1 if len(tok) else 0) + 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    edges = []
    for i in range(split or 0, len(sets)):
        mine = tok[starts[i] : starts[i + 1]]
        lists = [owners[bounds[t] : bounds[t + 1]] for t in mine if bounds[t + 1] - bounds[t] > 1]
        if not lists:
            continue
        common = np.bincount(np.concatenate(lists), minlength=len(sets))
        common = common[: split if split is not None else i]
        near = np.flatnonzero((100 + pct) * common >= pct * (sizes[i] + sizes[: len(common)]))
        for j in near[common[near] > 0].tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                edges.append((i, j))
    return edges


def linked_sets(docs: DataFrame, k: int = 4, pct: int = 85, rare: int = RARE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(node, component) of the distinct shingle sets that have a link to another one.

    1. Equal sets become one node, so groups of copies cost one row each.
    2. Shingles are counted over all nodes; most occur once and end there.
    3. Prefixes give signatures (see ``signatures``); sets that share none can't link.
    4. Pairs that share one are compared by size and sketch, which rejects
       nearly all that don't link and none that do (see ``candidate_edges``).
    5. What is left is connected nearly as closely as links are. Its groups are
       verified exactly, a pair of blocks of bounded size at a time, and only
       a spanning forest of the links leaves the task.
    """
    lean_batches(docs.sparkSession)
    nodes = checkpointed(set_profiles(docs, k, pct).groupBy("node", "n", "counted").agg(F.first("toks").alias("toks"), F.first("sketch").alias("sketch")))
    # another set differs by a shingle at least, so small sets have no link
    apart = nodes.where(F.col("n") * (100 - pct) >= pct)
    tokens = apart.select("node", F.explode("toks").alias("tok"))
    df = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    repeated = large_join(tokens, df, "tok").groupBy("node").agg(F.collect_list(F.struct("tok", "df")).alias("own"))
    prefixes = large_join(repeated, apart.select("node", "n", "counted"), "node")
    postings = checkpointed(signatures(prefixes, pct, rare))
    groups = checkpointed(large_join(connected_components(candidate_edges(postings, nodes, pct, group)), nodes.select("node", "n"), "node"))

    # Blocks: a group's nodes are dealt by size, so that blocks too different in size never meet.
    many = checkpointed(groups.groupBy("component").agg(F.sum("n").alias("m"), F.count("*").alias("nodes")))
    large = many.where(F.col("m") > block)
    single = join_spread(groups, many.where(F.col("m") <= block).select("component", "nodes"), "component", "nodes", F.col("node"))
    step = math.log(100 / pct)
    placed = join_spread(groups, large.select("component", "nodes"), "component", "nodes", F.col("node")).withColumn("band", F.floor(F.log("n") / F.lit(step) + 1e-9))
    placed = checkpointed(placed.withColumn("key", F.struct("component", "band")))
    inband = placed.groupBy("key").agg(F.sum("n").alias("in_band"), F.count("*").alias("nodes"))
    placed = join_spread(placed, inband, "key", "nodes", F.col("node")).withColumn("slot", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_band") / F.lit(block))))
    placed = checkpointed(placed.select("node", "component", "band", "slot"))
    blocks = placed.select("component", "band", "slot").distinct()
    other = blocks.select("component", F.col("band").alias("band2"), F.col("slot").alias("slot2"))
    meets = (F.col("band2") == F.col("band")) & (F.col("slot2") >= F.col("slot")) | (F.col("band2") == F.col("band") + 1)
    tasks = large_join(blocks, other, "component").where(meets)
    one = F.concat_ws(":", "component", "band", "slot")
    two = F.concat_ws(":", "component", "band2", "slot2")
    tasks = tasks.select(one.alias("x"), two.alias("y"), F.concat_ws("|", one, two).alias("task"))
    sides = tasks.select(F.col("x").alias("block"), "task", F.lit(0).alias("side")).union(tasks.where("x <> y").select(F.col("y").alias("block"), "task", F.lit(1).alias("side")))
    work = large_join(placed.select("node", one.alias("block")), sides, "block").select("node", "task", "side")
    work = checkpointed(work.union(single.select("node", F.col("component").cast("string").alias("task"), F.lit(0).alias("side"))))

    sets = candidate_sets(docs, groups.select("node"), k, filter_size(groups.count())).dropDuplicates(["node"])
    verified = large_join(work, sets, "node").groupBy("task").applyInArrow(lambda t: _verify(t, pct), "a long, b long")
    return connected_components(verified)


def components_of_sets(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, rows, doc_id, keeper): of the sets of keys (doc_id, n, node) with several rows or a link, how many rows each has,
    the smallest doc_id of its component, and the least set of the component with it. A null doc_id is the smallest of none but nulls."""
    held = keys.where("n > 0").groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("own"))
    both = checkpointed(large_join(held, linked, "node", "left").where("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node")))
    lowest = both.groupBy("component").agg(F.min(F.when(F.col("own").isNotNull(), F.struct("own", "node"))).alias("low"), F.count("*").alias("nodes"))
    out = join_spread(both, lowest, "component", "nodes", F.col("node"))
    return checkpointed(out.select("node", "rows", F.col("low.own").alias("lowest"), F.col("low.node").alias("keeper")))


def link_components(docs: DataFrame, k: int = 4, pct: int = 85, rare: int = RARE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Rows whose k-word shingle sets have a Jaccard similarity of pct % or more
    are linked; component_id is the smallest doc_id that links reach. An empty
    or null text has no shingles and is its own component. Repeated rows have
    equal sets and share a component; a null doc_id never names one unless
    nothing else does. Words and texts may be of any length; other columns of
    docs aren't read. See ``linked_sets`` for the method.
    """
    linked = linked_sets(docs, k, pct, rare, block, group)
    keys = checkpointed(set_keys(docs, k))
    found = components_of_sets(keys, linked)
    out = join_spread(keys, found, "node", "rows", F.col("doc_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("keeper").isNotNull(), F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def _verify(table: pa.Table, pct: int) -> pa.Table:
    table = table.sort_by([("side", "ascending"), ("node", "ascending")])
    node = table["node"].to_numpy()
    column = table["shingles"].combine_chunks()
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    sets = [values[offsets[i] : offsets[i + 1]] for i in range(len(node))]
    split = int((table["side"].to_numpy() == 0).sum())
    edges = forest(sets, pct, split if split < len(node) else None)
    return pa.table({"a": pa.array(node[[i for i, _ in edges]] if edges else [], pa.int64()), "b": pa.array(node[[j for _, j in edges]] if edges else [], pa.int64())})


def candidate_sets(docs: DataFrame, nodes: DataFrame, k: int, bits: int) -> DataFrame:
    """(node, shingles) of the rows of docs whose sets may be among nodes, by a Bloom filter of bounded size."""

    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(nodes, bits))

    def emit(batches):
        wanted = sent.value
        for batch in pieces(batches, 0):
            s, at = shingle_sets(batch.column(0), k)
            n = np.diff(at)
            key = set_identity(s, at)
            hit = all_bits(wanted, bloom_slots(key, bits, 3)) & (n > 0)
            _, once = np.unique(key, return_index=True)
            keep = np.zeros(len(n), bool)
            keep[once] = True
            keep &= hit
            values = pa.array(s[np.repeat(keep, n)].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), lists], names=["node", "shingles"])

    return docs.select("text").mapInArrow(emit, "node long, shingles array<long>")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: four-word shingles, 85 %."""
    return link_components(docs)


def keep_one_of_each(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component of linked texts one row of its smallest doc_id stays.

    Rows are judged by their texts: of rows that repeat a doc_id with other
    texts each belongs to its own component. Rows without shingles stay, and so
    do those without doc_id. Other columns pass through, whatever their names.
    Rows whose id is surely not among those to look at, by a Bloom filter,
    pass on as they are; only the others' texts are shuffled for the exact join.
    """
    keys = checkpointed(set_keys(docs, k))
    found = components_of_sets(keys, linked_sets(docs, k, pct))
    stays = (F.col("doc_id") == F.col("lowest")) & (F.col("node") == F.col("keeper"))
    looked = join_spread(keys.where("doc_id IS NOT NULL AND n > 0"), found, "node", "rows", F.col("doc_id"))
    ident, node, place, stay, tag = free_names(docs, "ident", "node", "place", "stay", "tag")
    looked = checkpointed(looked.select(F.col("doc_id").alias(ident), F.col("node").alias(place), stays.alias(stay)).distinct())
    text, names = docs.columns.index("text"), [*docs.columns, node]

    def identify(batches):
        for batch in pieces(batches, text):
            s, start = shingle_sets(batch.column(text), k)
            empty = np.diff(start) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_identity(s, start).view(np.int64), mask=empty)], names=names)

    known, others = parted(docs, column("doc_id"), looked.select(F.xxhash64(ident)), filter_size(looked.count()), inside=(identify, with_fields(docs, (node, "long"))))
    judged = large_join(known, looked, (column("doc_id") == F.col(ident)) & (F.col(node) == F.col(place)), "left").where(F.coalesce(stay, F.lit(True)))
    # where a row stays for its component, one does; rows of no component all do
    once = judged.withColumn(tag, F.when(F.col(stay), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return others.unionByName(once.dropDuplicates([ident, place, tag]).select(*columns(docs)))
