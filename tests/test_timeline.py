"""Pages by number and by key against the sorted whole, and the files that they read."""

import random

import pytest

from missive.operators.timeline import Timeline


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(400)]), f"b{i}") for i in range(2000)]  # one second holds most
    t = Timeline(spark, str(tmp_path_factory.mktemp("t")))
    t.write(spark.createDataFrame(rows, "id long, date long, body string"), 100)
    return t, sorted((d, i) for i, d, _ in rows)


def keys(df):
    return [(r.date, r.id) for r in df.collect()]


def test_pages_by_number(kept):
    t, whole = kept
    for limit, offset in ((50, 0), (50, 950), (1, 1999), (300, 1850), (10, 5000), (2500, 0)):
        assert keys(t.page(limit, offset)) == whole[offset : offset + limit], (limit, offset)


def test_pages_by_key(kept):
    t, whole = kept
    for at in (0, 1, 99, 777, 1998, 1999):
        date, id_ = whole[at]
        assert keys(t.following(60, date, id_)) == whole[at + 1 : at + 61]
        assert keys(t.preceding(60, date, id_)) == whole[max(0, at - 60) : at]
    assert keys(t.following(5, -1, 0)) == whole[:5] and keys(t.preceding(45)) == whole[-45:] and keys(t.following(5, 500, 0)) == []


def test_a_deep_page_reads_a_file_or_two(kept):
    t, whole = kept
    assert t.bounds().count() >= 15
    assert len(t.page(50, 1730).inputFiles()) <= 2
    assert len(t.following(50, *whole[1730]).inputFiles()) <= 3 and len(t.preceding(50, *whole[1730]).inputFiles()) <= 3


def test_empty(spark, tmp_path):
    t = Timeline(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([], "id long, date long, body string"))
    assert t.page(10).count() == 0 and t.preceding(10).count() == 0 and t.following(10, 1, 1).count() == 0
