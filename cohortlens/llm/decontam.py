"""Operator 2: benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

import functools
import itertools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, filter_size, free_names, in_turn, join_spread, lean_batches, map_rows, parted, with_fields
from .kernels import pieces, words

#: Most item words of one automaton: about 2 states a word, some 100 MB in a worker at this size.
SHARD_WORDS = 150_000


class Automaton:
    """Generalised suffix automaton over the word sequences of benchmark items.

    For a text position the automaton knows the longest suffix that occurs in
    an item. ``window`` consecutive item words (the whole item, if shorter) are
    one window; ``marks`` holds, for a state, the length from which its
    matches contain a window as suffix and the items having that window.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        ends: list[tuple[int, int, int]] = []
        for number, (_, seq) in enumerate(items):
            last = 0
            for k, w in enumerate(seq):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                if k + 1 >= window or len(seq) < window and k + 1 == len(seq):
                    ends.append((last, number, min(len(seq), window)))
        # A window ends at these prefixes: its state is the ancestor whose lengths hold the window's.
        marks: dict[int, dict[int, set[int]]] = {}
        for state, number, size in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            marks.setdefault(state, {}).setdefault(size, set()).add(number)
        # marks of a state's ancestors hold for it too
        self.marks: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple((size, frozenset(n)) for size, n in marks.get(state, {}).items())
            self.marks[state] = self.marks[self.link[state]] + own if own else self.marks[self.link[state]]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._new(length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals [start, end) hit by windows, ascending and disjoint, and the items found."""
        nxt, link, length, marks = self.next, self.link, self.length, self.marks
        spans: list[list[int]] = []
        found: set[int] = set()
        known: set[tuple[int, int]] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocab.get, text)):
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state >= 0 and to is None:
                    state = link[state]
                    to = nxt[state].get(w) if state >= 0 else None
                if to is None:
                    state = matched = 0
                    continue
                matched = length[state] + 1
            else:
                matched += 1
            state = to
            if m := marks[state]:
                size = 0
                for s, numbers in m:
                    if s <= matched:
                        size = max(size, s)
                        if (state, s) not in known:
                            found |= numbers
                if size:
                    known.update((state, s) for s, _ in m if s <= matched)
                    start = i + 1 - size
                    if spans and start <= spans[-1][1]:
                        while spans and start <= spans[-1][1]:
                            start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def _shards(benchmark: DataFrame, shard_words: int):
    """Lists of (item, words), each of a bounded number of words but for a single longer item."""
    shard, size = [], 0
    for row in benchmark.select(F.col("item_id").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        seq = words(bytes(row.t or b""))
        if seq:
            if shard and size + len(seq) > shard_words:
                yield shard
                shard, size = [], 0
            shard.append((row.i, seq))
            size += len(seq)
    yield shard


_BUILT: dict[str, Automaton] = {}


def automaton_of(key: str, items: list[tuple[object, list[bytes]]], window: int) -> Automaton:
    """The automaton of a shard, built once in a worker process and kept until another is asked for."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


SPANS = "array<struct<a:int,b:int>>"


def _scan_with(spark, shard, window: int):
    """A function from a text to its number of words, its spans and the ids of its items as strings."""
    sent, key = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

    def scan(text: str | None):
        automaton = automaton_of(key, sent.value, window)
        seq = words((text or "").encode())
        hits, found = automaton.scan(seq)
        return len(seq), hits, sorted({str(i) if i is not None else "null" for i in (automaton.ids[k] for k in found)})

    return scan


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, then=None) -> DataFrame:
    """docs with ``n_words``, ``spans`` (hit word intervals) and ``items`` (found item ids as strings) at the end.

    The benchmark is read in shards of at most ``shard_words`` words, so what a
    worker holds is bounded however large the benchmark is. One shard is one
    scan. With more, each scan gives the spans of the texts it hits, and these
    are joined to the documents by a hash of their text; of the documents'
    texts only those move that a filter suspects of a hit.

    Null or empty texts have no words; texts may be of any length; repeated
    rows have equal results; null item ids count as the string "null". Other
    columns pass through, whatever their names; an added column whose name is
    taken has underscores at its end. ``then`` is (work, schema) as ``map_rows``
    takes them, to be done to the result by the same Python workers.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    names = free_names(docs, "n_words", "spans", "items")
    schema = with_fields(docs, (names[0], "long"), (names[1], SPANS), (names[2], "array<string>"))
    out_names, at, width = [*docs.columns, *names], docs.columns.index("text"), len(docs.columns)
    work, out_schema = then or (in_turn(), schema)
    shards = _shards(benchmark, shard_words)
    first, second = next(shards), next(shards, None)
    if second is None:
        look = _scan_with(spark, first, window)

        def scan(batches):
            for batch in pieces(batches, at):
                n, spans, items = zip(*[look(t.as_py()) for t in batch.column(at)], strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], names=out_names)

        return map_rows(docs, in_turn(scan, work), out_schema)

    # a text's hits follow from the text, so a text's hash stands for its rows
    texts, hits = docs.select(F.sha2("text", 256).alias("key"), "text").where("text IS NOT NULL"), None
    for shard in itertools.chain([first, second], shards):
        look = _scan_with(spark, shard, window)

        def scan_hits(batches, look=look):
            for batch in pieces(batches, 1):
                found = [look(t.as_py()) for t in batch.column(1)]
                keep = [i for i, x in enumerate(found) if x[1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), _spans([found[i][1] for i in keep]), pa.array([found[i][2] for i in keep], pa.list_(pa.string()))], names=["key", "spans", "items"])

        one = checkpointed(texts.mapInArrow(scan_hits, f"key string, spans {SPANS}, items array<string>").groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("rows")))
        hits = one if hits is None else hits.unionByName(one)
    key, spans, items = free_names(docs, "key", "span_lists", "item_lists")
    found = checkpointed(hits.groupBy(F.col("key").alias(key)).agg(F.collect_list("spans").alias(spans), F.collect_list("items").alias(items), F.max("rows").alias("rows")))
    def finish(batches):
        for batch in pieces(batches, at):
            n = [len(words((t.as_py() or "").encode())) for t in batch.column(at)]
            lists = list(zip(*[c.to_pylist() for c in batch.columns[width:]], strict=True)) or [(None, None)] * batch.num_rows
            merged = [functools.reduce(union_spans, ([(s["a"], s["b"]) for s in one] for one in x or []), []) for x, _ in lists]
            ids = [sorted({i for one in y or [] for i in one}) for _, y in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n, pa.int64()), _spans(merged), pa.array(ids, pa.list_(pa.string()))], names=out_names)

    last = in_turn(finish, work)
    touched, others = parted(docs, F.sha2("text", 256), found.select(F.xxhash64(key)), filter_size(found.count()), outside=(last, out_schema))
    keyed = touched.withColumn(key, F.sha2("text", 256))
    joined = join_spread(keyed, found, key, "rows", F.monotonically_increasing_id(), "left").select(*columns(docs), spans, items)
    return map_rows(joined, last, out_schema).union(others)


def union_spans(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not x or not y:
        return x or y
    out: list[tuple[int, int]] = []
    for a, b in sorted([*x, *y]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document is contaminated if words are hit and they are at least one in
    ``coverage`` of its words.
    """
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x.b - x.a))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """docs with the hit words of lightly hit texts cut out and contaminated documents removed.

    Documents without any hit keep their texts unchanged. Where some words are
    hit, but too few to reject the document, the text from the first to the
    last character of each hit interval is removed and n_chars, where there is one, brought up to date.
    Nulls, odd texts and other columns are as ``find_contamination`` says.
    """
    names = docs.columns
    length_at = names.index("n_chars") if "n_chars" in names else None
    text_at, at = names.index("text"), len(names)

    def cut(batches):
        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            n_hit = [sum(s["b"] - s["a"] for s in spans) for spans in batch.column(at + 1).to_pylist()]
            batch = batch.filter(pa.array([not (k > 0 and coverage * k >= n) for k, n in zip(n_hit, batch.column(at).to_pylist(), strict=True)], pa.bool_()))
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(at + 1).to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    place = [m.span() for m in word.finditer(raw)]
                    for s in reversed(spans):
                        raw = raw[: place[s["a"]][0]] + raw[place[s["b"] - 1][1] :]
                    texts[i] = raw.decode()
            columns = batch.columns[:at]
            if length_at is not None:
                lengths = [len(t) if s else n for t, s, n in zip(texts, batch.column(at + 1).to_pylist(), columns[length_at].to_pylist(), strict=True)]
                columns[length_at] = pa.array(lengths).cast(columns[length_at].type)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return find_contamination(docs, benchmark, window, then=(cut, docs.schema))
