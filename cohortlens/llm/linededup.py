"""Operator 7: line deduplication behind two Bloom filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_bits, bloom_slots, checkpointed, column, columns, filter_size, free_names, join_spread, lean_batches, map_rows, parted, set_bits, with_fields
from .kernels import LOWER, SPACE, pieces, span_hashes, text_bytes

#: Bits of a filter, at most: what is broadcast is bounded. Up to there filters grow with the text; a full one only lets more hashes shuffle.
MOST_BITS = 1 << 28
HASHES = 3
#: Repeated keys up to so many (24 bytes each, about) are broadcast; beyond that they are joined to the documents that have any.
MOST_KEYS = 1 << 19


class Lines:
    """The lines of a batch of texts: two hashes of the key, its code points, its text's number."""

    def __init__(self, column):
        data, offsets = text_bytes(column)
        newline = data == 10
        n = len(offsets) - 1
        # a text of k newlines has k + 1 lines, each ended by a newline or the text's end
        breaks = np.flatnonzero(newline)
        owner = np.searchsorted(offsets, breaks, side="right") - 1
        ends = np.concatenate([breaks, offsets[1:]])
        self.owner = np.concatenate([owner, np.arange(n)])
        order = np.lexsort((ends, self.owner))
        self.ends, self.owner = ends[order], self.owner[order]
        self.starts = np.empty_like(self.ends)
        if len(self.ends):
            self.starts[0] = offsets[0]
            self.starts[1:] = np.where(self.owner[1:] != self.owner[:-1], offsets[self.owner[1:]], self.ends[:-1] + 1)
        # the key: from the first to the last byte of the line that is no white space
        solid = ~SPACE[data]
        place = np.flatnonzero(solid)
        lo, hi = np.searchsorted(place, self.starts), np.searchsorted(place, self.ends)
        full = hi > lo
        self.key_start = np.where(full, place[np.minimum(lo, len(place) - 1)] if len(place) else 0, 0)
        self.key_end = np.where(full, place[np.maximum(hi - 1, 0)] + 1 if len(place) else 0, 0)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.points = points[self.key_end] - points[self.key_start]
        self.data = data
        self.texts = n

    def hashes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the lines whose keys have ``least`` code points or more, and two 64-bit hashes of the keys."""
        at = np.flatnonzero(self.points >= least)
        low = LOWER[self.data]
        a, b = self.key_start[at], self.key_end[at]
        return at, span_hashes(low, a, b, 101), span_hashes(low, a, b, 211)


def _distinct(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the first of each (text, key)."""
    order = np.lexsort((b, a, owner))
    keep = np.ones(len(order), bool)
    keep[1:] = (owner[order][1:] != owner[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[keep]


def filter_bits(docs: DataFrame, min_chars: int) -> tuple[int, int]:
    """Bits of a filter for docs, and tasks to fill it: bits for four times as many keys as the bytes of text can hold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(16, (4 * size // (min_chars + 1)).bit_length()))
    # a task sends its filters once, so it should read far more than it sends
    return bits, max(4 * docs.sparkSession.sparkContext.defaultParallelism, size // (8 * bits))


def repeat_filter(docs: DataFrame, min_chars: int, bits: int, builders: int) -> np.ndarray:
    """The filter of keys that were seen in two documents or more (and of some others).

    Each task fills a once-seen and a twice-seen filter: a key whose bits are
    all in the once-seen one already goes into the twice-seen one. Filters
    are merged block by block in Spark: bits in two tasks' once-seen filters
    are twice seen too, so a key that two documents hold is always found.
    """
    block = max(bits // 8 // 4096, 16)

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in pieces(batches, 0):
            lines = Lines(batch.column(0))
            at, a, b = lines.hashes(min_chars)
            first = _distinct(lines.owner[at], a, b)
            h = np.sort(a[first])
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            slots = bloom_slots(h, bits, HASHES)
            again = ~new | all_bits(once, slots)
            set_bits(twice, slots[:, again])
            set_bits(once, slots)
        some = np.flatnonzero(once.reshape(-1, block).any(axis=1))
        for k in range(0, len(some), 256):
            i = some[k : k + 256]
            cut = lambda x: pa.array([r.tobytes() for r in x.reshape(-1, block)[i]], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), cut(once), cut(twice)], names=["block", "once", "twice"])

    def merge(batches):
        # rows come sorted by block
        now, once, twice = None, None, None
        for batch in batches:
            for k, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], names=["block", "twice"])
                    now, once, twice = k, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], names=["block", "twice"])

    built = docs.select("text").coalesce(builders).mapInArrow(build, "block int, once binary, twice binary")
    merged = built.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.block * block : row.block * block + block] = np.frombuffer(row.twice, np.uint8)
    return out


def suspected_lines(docs: DataFrame, min_chars: int, most_bits: int | None = None) -> DataFrame:
    """(h1, h2, doc_id), each once, of the keys that the twice-seen filter suspects, as two 64-bit hashes. Rows without doc_id count as no document."""
    bits, builders = filter_bits(docs, min_chars)
    bits = min(bits, most_bits or bits)
    sent = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, min_chars, bits, builders))

    def suspects(batches):
        twice = sent.value
        for batch in pieces(batches, 1):
            lines = Lines(batch.column(1))
            at, a, b = lines.hashes(min_chars)
            ids = batch.column(0).take(pa.array(lines.owner[at]))
            hit = all_bits(twice, bloom_slots(a, bits, HASHES))
            first = _distinct(lines.owner[at][hit], a[hit], b[hit])
            where = np.flatnonzero(hit)[first]
            yield pa.RecordBatch.from_arrays([pa.array(a[where].view(np.int64)), pa.array(b[where].view(np.int64)), ids.take(pa.array(where))], names=["h1", "h2", "doc_id"])

    schema = f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(suspects, schema)


def repeated_keys(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of the keys that min_docs distinct documents hold or more, with how many do and the largest doc_id."""
    return suspects.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)


class KeyTable:
    """Repeated keys in the order of their hashes, with their keepers; found by both hashes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, keeper: pa.Array | None = None):
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        self.keeper = keeper.take(pa.array(order)) if keeper is not None else None

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each (a, b), or -1."""
        out = np.full(len(a), -1, np.int64)
        at = np.searchsorted(self.h1, a)
        left = np.flatnonzero(at < len(self.h1))
        while len(left):
            left = left[self.h1[at[left]] == a[left]]
            same = self.h2[at[left]] == b[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.h1)]
        return out


def _without(lines: Lines, texts: pa.Array, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without the lines that are gone, and how many of its lines each text loses."""
    n_dropped = np.bincount(lines.owner[gone], minlength=lines.texts)
    if not gone.any():
        return texts, n_dropped
    data, out = lines.data.tobytes(), texts.to_pylist()
    first = np.searchsorted(lines.owner, np.arange(lines.texts + 1))
    for i in np.flatnonzero(n_dropped).tolist():
        stay = first[i] + np.flatnonzero(~gone[first[i] : first[i + 1]])
        out[i] = b"\n".join(data[lines.starts[k] : lines.ends[k]] for k in stay.tolist()).decode()
    return pa.array(out, texts.type), n_dropped


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, most_bits: int | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """docs with repeated lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped`` at the end.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased. Keys of ``min_chars`` code points or more that ``min_docs``
    documents hold lose all their lines but those in the largest doc_id.

    Only lines that the twice-seen filter suspects are shuffled, as two 64-bit
    hashes, for exact counts; texts stay where they are read. The repeated keys
    go to all tasks if they are few; else they are joined to their documents,
    and of texts only those move that a filter suspects of such a line.

    A null or empty text is one empty line; a null stays null. Rows that repeat
    a doc_id are one document in the counts; rows without one count as none and
    lose nothing. Lines and texts may be of any length. Other columns pass
    through, whatever their names; if docs has a column ``n_lines`` or
    ``n_dropped``, the added one has underscores at its end.
    """
    lean_batches(docs.sparkSession)
    suspects = suspected_lines(docs, min_chars, most_bits)
    keys = checkpointed(repeated_keys(suspects, min_docs))
    names = free_names(docs, "n_lines", "n_dropped")
    out_names = [*docs.columns, *names]
    at, ident, width = docs.columns.index("text"), docs.columns.index("doc_id"), len(docs.columns)
    schema = with_fields(docs, (names[0], "long"), (names[1], "long"))

    def finished(batch, lines, gone):
        texts, n_dropped = _without(lines, batch.column(at), gone)
        n_lines = np.bincount(lines.owner, minlength=lines.texts)
        return pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 : width], pa.array(n_lines.astype(np.int64)), pa.array(n_dropped.astype(np.int64))], names=out_names)

    if keys.count() <= most_keys:
        few = keys.select("h1", "h2", "keeper").toArrow().combine_chunks()
        column_of = lambda i: few.column(i).combine_chunks() if few.num_rows else pa.array([], few.schema.field(i).type)
        sent = docs.sparkSession.sparkContext.broadcast((column_of(0).to_numpy().view(np.uint64), column_of(1).to_numpy().view(np.uint64), column_of(2)))

        def apply(batches):
            table = KeyTable(*sent.value)
            for batch in pieces(batches, at):
                lines = Lines(batch.column(at))
                number, a, b = lines.hashes(min_chars)
                place = table.find(a, b)
                number, place = number[place >= 0], place[place >= 0]
                ids = batch.column(ident).take(pa.array(lines.owner[number]))
                lost = pa.compute.less(ids, table.keeper.take(pa.array(place))).fill_null(False)
                gone = np.zeros(len(lines.owner), bool)
                gone[number[np.asarray(lost)]] = True
                yield finished(batch, lines, gone)

        return map_rows(docs, apply, schema)

    suspects = checkpointed(suspects.withColumn("key", F.struct("h1", "h2")).select("key", "doc_id"))
    lost = join_spread(suspects, keys.select(F.struct("h1", "h2").alias("key"), "keeper", "n"), "key", "n", F.col("doc_id")).where(F.col("doc_id") < F.col("keeper"))
    # a document's keys: as many as it has lines at most
    ident_name, drop = free_names(docs, "id", "drop")
    drops = checkpointed(lost.groupBy(F.col("doc_id").alias(ident_name)).agg(F.collect_list("key").alias(drop)))

    def apply_lists(batches):
        for batch in pieces(batches, at):
            lines = Lines(batch.column(at))
            number, a, b = lines.hashes(min_chars)
            gone = np.zeros(len(lines.owner), bool)
            if batch.num_columns > width:
                lists = batch.column(width)
                bounds = np.searchsorted(lines.owner[number], np.arange(lines.texts + 1))
                for i in np.flatnonzero(np.asarray(lists.is_valid())).tolist():
                    pairs = lists[i].values
                    h1, h2 = (pairs.field(k).to_numpy().view(np.uint64) for k in (0, 1))
                    mine = slice(bounds[i], bounds[i + 1])
                    gone[number[mine][KeyTable(h1, h2).find(a[mine], b[mine]) >= 0]] = True
            yield finished(batch, lines, gone)

    touched, others = parted(docs, column("doc_id"), drops.select(F.xxhash64(ident_name)), filter_size(drops.count()), outside=(apply_lists, schema))
    joined = touched.join(drops, column("doc_id") == F.col(ident_name), "left").select(*columns(docs), drop)
    return map_rows(joined, apply_lists, schema).union(others)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the hash of what is kept."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines dropped and n_chars, where there is one, brought up to date.

    A document that had text and keeps none but white space goes. Nulls, odd
    texts and other columns are as ``dedup_lines`` says.
    """
    n_lines, n_dropped = free_names(docs, "n_lines", "n_dropped")
    kept = dedup_lines(docs).where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(*columns(docs))
