"""Operator 12 against a search of every period at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from missive.llm import periodic
from missive.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs: stretches whose words q apart are equal,
    as far as they go, if no smaller period does for the whole stretch."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            own = words[start : i + q]
            if len(own) >= max(6, 4 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((start, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_brute_force(spark):
    got = QUERIES["op12_periodic"](spark, SF)
    assert got.columns == COLUMNS
    want = [row(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(w[1] > 0 for w in want) > 5


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 8)):
            unit = [rng.randint(1, 3) for _ in range(rng.randint(1, 6))]
            ends = [[rng.randint(1, 4) for _ in range(rng.randint(0, 5))] for _ in range(2)]
            texts.append(rng.choice([ends[0] + unit * rng.randint(2, 9) + ends[1], [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))], unit * 5 + ends[0] + unit * 4]))
        found = periodic.runs(np.array([c for t in texts for c in t], np.int64), np.cumsum([0, *map(len, texts)]))
        got = [[] for _ in texts]
        for t, *own in zip(*found, strict=True):
            got[t].append(tuple(map(int, own)))
        assert got == [brute(t) for t in texts]


def test_next_smaller_along_long_chains():
    rng = random.Random(2)
    for _ in range(100):
        v = np.array([0] * rng.randint(0, 1) + list(range(rng.randint(1, 200), 0, -1)) + [rng.randint(0, 300) for _ in range(rng.randint(1, 100))])
        assert periodic.next_smaller(v).tolist() == [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (5, "a a a a a"), (None, "x y " * 4), (10, "b\x85b b c " * 5), (7, "A a " * 3 + "A"), (8, "A a " * 4)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows += [(i, t) for i, t in zip(ids, [None, "", " ", "one", "one two", "é\x0bé z", *(" ".join(f"w{k}" for k in range(n)) for n in (3, 10, 11, 12, 40, 101))], strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("runs", "collapsed", "text_", "runs_", "keep0_", "top")})
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, QUERIES["op12_periodic"](spark, str(tmp_path)).collect()), key=key) == sorted((row(*r) for r in rows), key=key)
    assert periodic.find(df.limit(0)).count() == 0
    kept = periodic.find(df).filter("doc_id = 8").collect()[0]
    assert (kept.text_, kept.collapsed, [tuple(r) for r in kept.runs]) == ("text_", "A a", [(0, 8, 2)])


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], [f"w{i}" for i in range(50_000)], [f"w{i:06}" for i in range(200_000, 0, -1)]])
def test_very_long_texts(unit):
    import pyarrow as pa

    began = time.time()
    found, collapsed = periodic._searched(pa.array([" ".join(unit * (400_000 // len(unit) + 2))]))
    n = len(unit) * (400_000 // len(unit) + 2)
    assert [tuple(r.values()) for r in found.to_pylist()[0]] == [(0, n, len(unit))]
    assert collapsed[0].as_py() == " ".join(unit) and time.time() - began < 60
