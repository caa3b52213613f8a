"""Operator 5: language identification by rank-order n-gram profiles."""

from __future__ import annotations

import functools
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, columns, free_names, lean_batches, map_rows, with_fields
from .kernels import pieces

#: Runs of anything that is no letter part words; a word is padded by one space at both ends. Other numbers are letters here, see ``other_numbers``.
_GAPS = re.compile(r"[\W\d_]+")
#: Length of a profile, of languages and of documents.
TOP = 400
#: Training documents of a language, about, at most.
SAMPLE = 20_000
#: Languages whose profiles are broadcast at once, some 5 KB each; more take further passes over the texts.
LANGUAGES = 5000


@functools.cache
def other_numbers() -> dict[int, str]:
    """A translation of fractions, numerals and the like, which are neither letters (of Unicode category L) nor decimal digits, to spaces."""
    return {c: " " for c in range(128, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()}


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1-, 2- and 3-grams of a whole text as numbers, ascending, and their counts.

    Code points take 21 bits each; n-grams don't reach across words.
    """
    plain = _GAPS.sub(" ", (text if text.isascii() else text.translate(other_numbers())).lower()).strip()
    if not plain:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = c == 32
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    grams = np.concatenate([c[~gap], two, three[~gap[1:-1]]])
    return np.unique(grams, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by number."""
    return grams[np.lexsort((grams, -counts))[:top]]


class Profiles:
    """Rank-order profiles of languages: for every n-gram the languages that have it and its ranks there."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(profiles), top
        grams = np.concatenate([np.zeros(0, np.uint64), *(np.asarray(profiles[x], np.uint64) for x in self.langs)])
        lang = np.repeat(np.arange(len(self.langs)), [len(profiles[x]) for x in self.langs])
        rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(profiles[x])) for x in self.langs)])
        order = np.argsort(grams, kind="stable")
        self.lang, self.rank = lang[order], rank[order]
        self.vocab, first = np.unique(grams[order], return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(order)))

    def nearest(self, text: str | None) -> tuple[str, int, int]:
        """The language of least out-of-place distance (the first by name of several), that distance, and the greatest possible one."""
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.langs:
            return "und", 0, 0
        doc = ranked(grams, counts, self.top)
        i = np.minimum(np.searchsorted(self.vocab, doc), max(0, len(self.vocab) - 1))
        here = np.flatnonzero(self.vocab[i] == doc) if len(self.vocab) else np.zeros(0, np.int64)
        n = self.count[i[here]]
        at = np.repeat(self.first[i[here]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # an n-gram that a language lacks counts the whole length of a profile
        saved = np.bincount(self.lang[at], self.top - np.abs(self.rank[at] - np.repeat(here, n)), minlength=len(self.langs))
        best, most = int(saved.argmax()), self.top * len(doc)
        return self.langs[best], most - int(saved[best]), most

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance and how far it is from the greatest distance, 0 to 1."""
        lang, distance, most = self.nearest(text)
        return lang, 1 - distance / most if most else 0.0


def highest_hash(n: Column, sample: int) -> Column:
    """Of n rows with signed 64-bit hashes, ``sample`` have no higher one than this on average."""
    share = F.lit(float(sample)) / n
    return F.when(n <= sample, F.lit((1 << 63) - 1)).otherwise(((share * 2 - 1) * float(1 << 63)).cast("long"))


def learn(train: DataFrame, top: int = TOP, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles of all languages in train (text, lang, ``__order``); rows without text or lang are passed over.

    Learns from about ``sample`` documents of a language at most: those whose
    64-bit hash ``__order`` lies in the lowest share of all hashes that holds
    so many on average. N-grams are counted in each task and summed by Spark;
    only the sizes of languages, to be broadcast, and the finished profiles,
    ``top`` numbers each, come to the driver. No language is left out, however
    many there are.
    """
    lean_batches(train.sparkSession)
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(highest_hash(F.count("*"), sample).alias("__most"))
    rows = rows.join(F.broadcast(most), "lang").where(F.col("__order") <= F.col("__most"))

    def count(batches):
        for batch in pieces(batches, 0, 4 << 20):
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    profiles = best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gram"))), lambda x: x.gram).alias("grams"))
    return {row.lang: row.grams for row in profiles.toLocalIterator()}


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` at the end; ``und`` and 0 where the text is null or has no letter.

    Whole texts of any length count; repeated rows are judged alike, and equal
    distances go to the first language by name. Other columns pass through,
    whatever their names; if docs has a column ``lang_pred`` or ``score``, the
    added one has underscores at its end.
    """
    at, names = docs.columns.index("text"), free_names(docs, "lang_pred", "score")
    lean_batches(docs.sparkSession)
    langs, n = sorted(profiles), len(docs.columns)
    out = docs
    for start in range(0, max(1, len(langs)), LANGUAGES):
        sent = docs.sparkSession.sparkContext.broadcast({x: profiles[x] for x in langs[start : start + LANGUAGES]})
        out = map_rows(out, _predictions(sent, top, at, n, [*docs.columns, *names]), with_fields(docs, (names[0], "string"), (names[1], "double")))
    return out


def _predictions(sent, top: int, at: int, n: int, out_names: list[str]):
    """Adds each text's language and score, or keeps those that languages of an earlier pass have given it, if they aren't worse."""

    def predict(batches):
        model = Profiles(sent.value, top)
        for batch in pieces(batches, at):
            said = [model.predict(t.as_py()) for t in batch.column(at)]
            if batch.num_columns > n:
                before = zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)
                said = [old if old[1] >= new[1] else new for old, new in zip(before, said, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=out_names)

    return predict


def held_out() -> F.Column:
    """Documents kept from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from the labelled documents that aren't held out; a null doc_id takes no part."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return learn(rows.select("text", "lang", F.xxhash64("doc_id").alias("__order")))


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; a null doc_id isn't held out."""
    said = identify(docs.select("doc_id", "text"), train_profiles(docs))
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language, which is any letter where some language was learned; their columns are unchanged."""
    return identify(docs, train_profiles(docs)).where(column(free_names(docs, "lang_pred")[0]) != "und").select(*columns(docs))
