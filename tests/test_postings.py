"""The kept index against rebuilds, its pruning, and snippets against all windows."""

import random

import pytest
from pyspark.sql import functions as F

from missive.operators import postings, search
from missive.operators.store import Conflict

WORDS = ["river", "stone", "with", "from", "of", "the", "café", "Ärger", "lamp", "blue"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = rng.choices(WORDS, weights=[0.3, 2, 6, 5, 8, 9, 1, 1, 3, 2], k=rng.randint(15, 40) if i % 50 else 0)
        rows.append((i * 3, None if i % 97 == 0 else ", ".join(words)))
    rows[300] = (900, "river river river river with from")  # what a query for these finds first
    rows[301] = (903, "river river with from")
    return rows


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(texts, "id long, body string").cache()


def kept(spark, folder, documents, **sizes):
    """Appended in three, with rows that were deleted and came again, and others that stay away."""
    index = postings.Index(spark, str(folder), **sizes)
    index.append(documents.filter("id % 9 = 0"))
    index.append(documents.filter("id % 9 = 3"))
    index.delete(documents.filter("id % 9 = 0 AND id % 7 = 0 OR id % 9 = 3 AND id % 7 = 1"))
    index.append(documents.filter("id % 9 = 6 OR id % 9 = 0 AND id % 7 = 0"))
    return index, documents.filter("NOT (id % 9 = 3 AND id % 7 = 1)")


def ranking(rows):
    return [(r.id, round(r.score, 9)) for r in rows.collect()]


QUERIES = ["river OR with OR from", "river with", "the NOT river", "cafe", "absent OR lamp", '"of the" OR blue', "ri* OR stone", "^with", "NEAR(river blue, 3)", "absent"]


def test_a_kept_index_ranks_like_a_rebuild(spark, tmp_path, documents):
    index, living = kept(spark, tmp_path / "i", documents, span=128, block=4)
    rebuilt, lengths = search.postings(living).cache(), search.lengths(living).cache()
    for round_ in range(2):
        for text in QUERIES:
            tree = search.parse(text)
            want = search.scores(rebuilt, lengths, search.matches(rebuilt, tree), tree).orderBy("score", "id").limit(15)
            assert ranking(index.top(tree, 15)) == ranking(want), (round_, text)
        if round_ == 0:
            state = index.state()
            assert index.merge() and len(index.state()["segments"]) == 1 and not index.state()["gone"]
            assert (index.state()["docs"], index.state()["words"]) == (state["docs"], state["words"])
            index.vacuum()
    assert sorted(map(tuple, index.lengths().collect())) == sorted(map(tuple, lengths.collect()))


def test_only_files_of_the_query_are_read(spark, tmp_path, documents):
    index, _ = kept(spark, tmp_path / "i", documents)

    def read(text: str) -> set[str]:
        rows = index.blocks(search.parse(text))
        filters = rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert ("bucket" in filters) == (text == "river")
        return {r.file for r in rows.select(F.col("_metadata.file_path").alias("file")).collect()}

    buckets = {f.split("/bucket=")[1].split("/")[0] for f in read("river")}
    assert buckets == {str(postings._bucket("river"))}
    assert len(read("r*")) >= len(read("river"))  # a prefix may be in any bucket


@pytest.mark.parametrize("gone", [False, True])
def test_blocks_under_the_threshold_are_passed_over(spark, tmp_path, documents, gone):
    index = postings.Index(spark, str(tmp_path / "i"), span=64, block=4)
    index.append(documents)
    if gone:
        index.delete(documents.filter("id = 3"))
    tree = search.parse("river OR with OR from")
    candidates, heads = index.candidates(tree, 2)
    read, there = (df.agg(F.sum("n")).collect()[0][0] for df in (candidates, heads))
    matching = search.matches(index.postings(tree), tree).count()
    assert read < matching < there
    assert [i for i, _ in ranking(index.top(tree, 2))] == [900, 903]


def test_writers_and_empty_tables(spark, tmp_path, documents, monkeypatch):
    index = postings.Index(spark, str(tmp_path / "i"))
    assert index.top(search.parse("river"), 5).count() == 0 and not index.merge()
    index.append(documents.limit(0))
    assert index.top(search.parse("river OR absent"), 5).count() == 0
    written = postings.Index._written

    def meanwhile(self, *args):
        monkeypatch.setattr(postings.Index, "_written", written)
        postings.Index(spark, str(tmp_path / "i")).append(documents.filter("id = 900"))
        return written(self, *args)

    monkeypatch.setattr(postings.Index, "_written", meanwhile)
    with pytest.raises(Conflict):
        index.append(documents.filter("id = 903"))
    assert [r.id for r in index.top(search.parse("river"), 5).collect()] == [900]
    index.vacuum()
    assert [r.id for r in index.top(search.parse("river"), 5).collect()] == [900]


# ------------------------------------------------------------ snippets


def every_window(n, found, sentences, size):
    """(score, start) of all that may be shown, in the order in which they are tried."""
    def score(start):
        own = [k for at, k, _ in found if start <= at < start + size]
        return 1000 * len(set(own)) + len(own) - len(set(own))

    out = []
    for at, _, _ in found:
        own = [x for x in found if at <= x[0] < at + size]
        middle = own[0][0] - max(0, size - (own[-1][0] + own[-1][2] - own[0][0])) // 2
        out.append((score(at), max(0, min(middle, n - size))))
        earlier = [s for s in sentences if s < at]
        if n > size and earlier:
            out.append((score(earlier[-1]) + (100 if earlier[-1] else 120), earlier[-1]))
    return out


def test_the_best_of_all_windows():
    rng = random.Random(3)
    for _ in range(3000):
        n, size = rng.randint(1, 60), rng.choice([1, 3, 8, 20])
        found = sorted({(rng.randrange(n), rng.randrange(3)) for _ in range(rng.randint(1, 12))})
        found = [(at, k, 1 + k % 2) for at, k in found]
        sentences = sorted({0, *(rng.randrange(n) for _ in range(3))})
        want = max(every_window(n, found, sentences, size), key=lambda w: w[0])[1]
        assert search.best_window(n, found, sentences, size) == want


def test_marks_and_dots():
    phrases = lambda text: [p for p in dict.fromkeys(search._phrases(search.parse(text)))]
    show = lambda text, query, size=50: search.marked(text, phrases(query), size, ("[", "]"), "...")
    assert show("Un Café, s'il vous", "cafe") == "Un [Café], s'il vous" and show("cafés x", "caf*") == "[cafés] x"
    assert show("one of the two, of the three", '"of the"') == "one [of the] two, [of the] three"
    assert show("a b c a b", '"a b" OR "b c"') == "[a b c] [a b]"
    assert show("x " * 20 + "hit " + "y " * 20, "hit", 5) == "...x x [hit] y y..."
    assert show("Start here. " + "x " * 3 + "hit" + " z" * 30, "hit", 10) == "...x x x [hit] z z z z z z..."  # from the last sentence before it
    assert show("Start here x x hit" + " z" * 30, "hit", 10) == "Start here x x [hit] z z z z z..."
    assert show("x " * 30 + "end. Now hit it" + " z" * 30, "hit", 6) == "...Now [hit] it z z z..."
    assert show(None, "hit") == "" and show("no match at all", "hit", 2) == "no match..."
    assert show("ΣΊΣΥΦΟΣ hit", "σισυφος") == "[ΣΊΣΥΦΟΣ] hit"
