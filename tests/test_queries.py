"""Every registered query of the engine against its SQL."""

import math
import re
import unicodedata

import pytest
from oracle import SF, assert_same

from missive.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(found, SQL[name])
    else:
        assert found.count() > 0


def test_group_address_takes_every_message(spark):
    from missive.sources.events import messages

    everyone = {}
    for r in messages(spark, SF).select("thread_id", "address").collect():
        everyone.setdefault(r.thread_id, set()).add(r.address)
    found = {r.thread_id: r for r in QUERIES["group_address"](spark, SF).collect()}
    assert {t: r.participants for t, r in found.items()} == {t: len(a) for t, a in everyone.items()}
    assert all(r.address == ",".join(sorted(everyone[t])) for t, r in found.items() if len(everyone[t]) >= 3)


def test_search_takes_every_turn(spark, tmp_path):
    """Brute force over turns in several scripts, each word with and without accents."""
    texts = [
        "Thé café wîth ñandú fröm Málaga", "the plain turn", "WITH Öl from the shop", "ōf thē whítе", "of the whiskey — привет", "Привет, 世界 the with",
        "wïth one two three four five six fróm", "from two with", "naïve whîte of, the", "世界 你好", "", None, "a thé: with", "of é the", "whimsy ẁith with",
    ]
    spark.createDataFrame([(1, n, "user", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    words = [re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c)).lower()) for t in texts]
    joined = [f" {' '.join(w)} " for w in words]
    near = lambda w: any(abs(i - j) <= 6 for i, x in enumerate(w) if x == "with" for j, y in enumerate(w) if y == "from")
    want = {
        "search_term": lambda w, j: "the" in w,
        "search_and": lambda w, j: "the" in w and "with" in w,
        "search_or": lambda w, j: "from" in w or "with" in w,
        "search_not": lambda w, j: "the" in w and "with" not in w,
        "search_phrase": lambda w, j: " of the " in j,
        "search_prefix": lambda w, j: " whi" in j,
        "search_first": lambda w, j: w[:1] == ["the"],
        "search_near": lambda w, j: near(w),
    }
    for name, test in want.items():
        ids = {1_000_000 + n for n, (w, j) in enumerate(zip(words, joined, strict=True)) if test(w, j)}
        assert {r.id for r in QUERIES[name](spark, str(tmp_path)).collect()} == ids, name
    n, df, average = len(words), sum("with" in w for w in words), sum(map(len, words)) / len(words)
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    scores = {1_000_000 + i: round(-idf * w.count("with") * 2.2 / (w.count("with") + 1.2 * (0.25 + 0.75 * len(w) / average)), 6) for i, w in enumerate(words) if "with" in w}
    assert {r.id: r.score for r in QUERIES["search_bm25"](spark, str(tmp_path)).collect()} == pytest.approx(scores, abs=2e-6)
    results = {r.id: r.snippet for r in QUERIES["search_results"](spark, str(tmp_path)).collect()}
    assert set(results) == {1_000_000 + i for i, (w, j) in enumerate(zip(words, joined, strict=True)) if "with" in w or " of the " in j}
    assert "<mark>wîth</mark>" in results[1_000_000]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
