"""Source divergence and importance resampling against brute force and SQL, on small and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import divergence, importance
from cohortlens.llm.common import columns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = ["term", "n", "sig", "value", "n_words", "score", "rank", "tie", "part", "a.b", "tick`ed"]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def named(spark, rows):
    more = ", ".join("`" + n.replace("`", "``") + "` string" for n in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], f"doc_id long, text string, lang string, source string, {more}").repartition(3)


def random_rows(rng, n):
    vocab = ["a", "B", "c2c", "straße", "Éa", "\U0001f600", "zz"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(30))), rng.choice(["de", "en", None]), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, "zz orphan", "de", "s1"), (n, None, "fr", "s9"), (n + 1, "", "fr", "s8"), (n + 2, "zz B " * 4000, "en", "s2")]


def as_sql(sql, docs, bench=None):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    if bench is not None:
        con.register("benchmark", bench.toArrow())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return sorted((tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names)) for r in found.fetchall()), key=repr)


def plain(df):
    return sorted((tuple(r[n] for n in sorted(df.columns)) for r in df.collect()), key=repr)


def brute_divergence(rows, min_docs, top):
    groups, df, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall(low(text))
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
        lang_n[lang or ""].update(terms)
    out = set()
    for (lang, source), n in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def p(counts):
            total = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        own, whole = p(n), p(lang_n[lang])
        pairs = [(-sum(abs(own[t] - q) for t, q in p(m).items()), s) for (x, s), m in groups.items() if x == lang and s != source]
        over = [(whole[t] - own[t], t) for t in kept if n[t] and own[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", over)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, -value, rank))
    return out


@pytest.mark.parametrize("blocks", [(128, 2048), (1, 2)])
def test_divergence_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "SOURCES", blocks[0])
    monkeypatch.setattr(divergence, "COLUMNS", blocks[1])
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = random_rows(random.Random(4), 60)
    got = divergence.source_divergence(named(spark, rows), min_docs=5, top_terms=3)
    want = brute_divergence(rows, 5, 3)
    assert len(want) > 20
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == want and got.count() == len(want)


def test_divergence_sql_and_empty_table(spark):
    docs = named(spark, [r for k in range(8) for r in random_rows(random.Random(k), 40)])
    assert plain(divergence.source_divergence(docs)) == as_sql(divergence.DIVERGENCE_SQL, docs)
    assert divergence.source_divergence(named(spark, []).where("false")).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (7, 10, 3), (10**12, 9 * 10**14, 10**6), (9 * 10**14, 9 * 10**14, 1)]
    rows = spark.createDataFrame(cases, "n long, total long, terms long").withColumn("p", divergence.smoothed("n", "total", "terms"))
    assert [r.p for r in rows.collect()] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=70), min_size=3, max_size=3))
def test_crc_of_concatenations(parts):
    a, b, c = parts
    crc = lambda x: np.array([zlib.crc32(x)], np.uint32)
    ab = importance.crc_joined(crc(a), crc(b), np.array([len(b)]))
    assert ab[0] == zlib.crc32(a + b) and importance.crc_joined(ab, crc(c), np.array([len(c)]))[0] == zlib.crc32(a + b + c)


def features(text):
    w = WORD.findall(low(text))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abA é.", max_size=40), max_size=5))
def test_suffix_array_enumerates_every_feature(texts):
    block = importance.SuffixArray([None if t is None else t.encode() for t in texts])
    found, owner = block.buckets(10_000)
    for i, t in enumerate(texts):
        assert Counter(found[owner == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(t))
    tails = [tuple(int(block.word[n][k]) for n in range(3)) for k in block.order]
    assert tails == sorted(tails)


def test_wide_vocabularies_sort_alike(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500)).encode()
    fast = importance.SuffixArray([text])
    monkeypatch.setattr(importance, "DEPTH", 3)
    slow = np.lexsort(fast.word[::-1])
    assert (fast.order == slow).all()


def brute_importance(rows, bench, share, min_words):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(zlib.crc32(f.encode()) % 10_000 for f in features(r[1]))
    for b in bench:
        t.update(zlib.crc32(f.encode()) % 10_000 for f in features(b[1]))
    ns, nt = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    out = []
    for doc_id, text, *_ in rows:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[k] + 1.0) * ns / ((s[k] + 1.0) * nt))) for k in (zlib.crc32(x.encode()) % 10_000 for x in f))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD.findall(low(text)))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_importance_matches_brute_force_and_sql(spark):
    rows = random_rows(random.Random(9), 150)
    docs = named(spark, rows)
    bench = [(1, "zz zz B"), (2, None), (2, "straße éa a"), (None, "c2c a B c2c")]
    target = spark.createDataFrame(bench, "item_id long, text string")
    got = importance.importance_digest(docs, target)
    # rows of one id have one score: which of them is drawn is not told apart
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute_importance(rows, bench, (5, 100), 20)
    assert plain(got) == as_sql(importance.IMPORTANCE_SQL, docs, target)
    kept = importance.resample(docs, target, (30, 100), 5)
    drawn = [r for r in brute_importance(rows, bench, (30, 100), 5) if r[4]]
    assert kept.columns == [*docs.columns, "rank_"]
    assert sorted((r.doc_id, r["rank_"]) for r in kept.collect()) == sorted((r[0], r[4]) for r in drawn)
    assert kept.select(*columns(docs)).subtract(docs).count() == 0


def test_importance_of_empty_tables(spark):
    docs, target = named(spark, random_rows(random.Random(2), 3)), spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_digest(docs.where("false"), target).collect() == []
    assert importance.importance_digest(docs, target).count() == docs.count()
