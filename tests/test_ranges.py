"""Backup files read by byte ranges against the whole-file scanner."""

import hashlib
import os
import random

import pandas as pd
import pytest

from missive.sources import backup, ranges

WELL = [
    b"<sms a='1'/>", b'<sms b="x < y > z"/>', b"<call n='>'/>", b"<mms x='1'><parts><part t=\"a'b\"/></parts></mms>", b"<mms><addrs><addr/></addrs><sms q='1'/></mms>", b"<!-- <sms/> -- -->", b"<![CDATA[<sms/>]] >]]>",
    b"<?pi <sms/> ?>", b"text", b" > ", b"<other>", b"</other>", b"<x:sms k='\"'/>", b"<!DOCTYPE a '>' >", b"<smsx/>", b"<sms>body<b>c</b></sms>", b"<big d='" + b"A" * 50 + b"<'/>", b'<sms d="' + b"B" * 70 + b'"/>',
]
ILL = [b"<", b"<<", b"<< ", b"< >", b"<>", b"</mms>", b"<sms", b"'", b'"', b"<!--", b"<![CDATA[", b"<sms a='&bad;'/>", b"<mms>", b"<sms a=1/>", b"<s<ms/>", b"<sms<x/>", b"<sms/<>"]


def lines(data: bytes, size: int):
    """(path, size, block, piece) as a text reader that cuts at "<" would deliver them."""
    starts = [0, *(i + 1 for i, b in enumerate(data) if b == 0x3C)]
    if starts[-1] == len(data) and data:
        starts.pop()
    for at in starts:
        end = data.find(b"<", at)
        piece = data[at : end if end >= 0 else len(data)]
        yield "f", len(data), 0 if at == 0 else (at - 1) // size * size, piece.removeprefix(b"\xef\xbb\xbf") if at == 0 else piece


def by_ranges(data: bytes, size: int):
    own = {}
    for row in lines(data, size):
        own.setdefault(row[2], []).append(row)
    surveyed = []
    for block in sorted(own):
        r = ranges._Range("f", len(data), block)
        for row in own[block]:
            r.take(row[3])
        surveyed.append(r.row())
    rows, parts = [], {}
    for place in ranges._folded(pd.DataFrame(surveyed)).to_dict("records"):
        for row in ranges._read((p, b, piece, place) for p, _, b, piece in own[place["block"]]):
            (parts.setdefault(row["ordinal"], []) if row["part"] else rows).append(row)
    for ordinal, each in parts.items():
        one = lambda c: next((r[c] for r in each if r[c] is not None), None)  # noqa: B023, E731
        if one("start") is not None and one("stop") is not None:
            rows.append({"ordinal": ordinal, "kind": one("kind"), "start": one("start"), "stop": one("stop"), "raw": b"".join(r["raw"] for r in each), "status": "ok", "part": False})
    rows = sorted(ranges._decoded(rows), key=lambda r: r["ordinal"])
    first = next((i for i, r in enumerate(rows) if r["kind"] == "error"), len(rows))
    return [(r["ordinal"], r["kind"], r["start"], r["stop"], r["raw"], r["status"]) for r in rows[: first + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_scanner_rows(seed):
    rng = random.Random(seed)
    for _ in range(600):
        tokens = [rng.choice(WELL) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            tokens.insert(rng.randint(0, len(tokens)), rng.choice(ILL))
        data = b"".join(tokens)
        data = b"<smses>" + data + b"</smses>" if rng.random() < 0.7 else data
        data = b"\xef\xbb\xbf" + data if rng.random() < 0.1 else data
        want = [(r["ordinal"], r["kind"], r["start"], r["stop"], r["raw"], r["status"]) for r in backup.records([data], "f")]
        for size in (1, 3, 7, 16, 40, 1000):
            assert by_ranges(data, size) == want, (size, data)


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    home = tmp_path_factory.mktemp("inbox")
    made = {
        "long.xml": b"<smses count='200'>" + b"".join(b"<sms address='%d' date='1000' type='1' body='&lt; > %s'/>\n" % (i, b"y" * (i % 50)) for i in range(200)) + b"</smses>",
        "wide.XML": b"\xef\xbb\xbf<smses><mms date='1000'><parts><part data='" + b"A" * 3000 + b"'/></parts></mms><call number='3' date='2000'/></smses>",
        "cut.xml": b"<smses><sms a='1' date='1'/><",
        "bad.xml": b"<smses><sms a='1' date='1'/><sms a=2/><sms a='3'/></smses>",
        "plain.xml": b"no markup",
    }
    for name, data in made.items():
        (home / name).write_bytes(data)
    return str(home), made


@pytest.mark.parametrize("size, sent", [(100, 100_000), (1000, 100_000), (1000, 0), (1 << 20, 100_000)])
def test_spark_reads_ranges(spark, inbox, monkeypatch, size, sent):
    home, made = inbox
    monkeypatch.setattr(ranges, "SENT", sent)
    found = ranges.pieces(spark, home, size)
    got = {name: [] for name in made}
    for r in ranges.until_error(ranges.elements(found)).collect():
        got[os.path.basename(r.file)].append((r.ordinal, r.kind, r.start, r.stop, None if r.raw is None else bytes(r.raw), r.attrs, r.status))
    for name, data in made.items():
        assert sorted(got[name]) == [(r["ordinal"], r["kind"], r["start"], r["stop"], r["raw"], r["attrs"], r["status"]) for r in backup.records([data], name)], name
    if size == 100:
        assert found.select("path", "block").distinct().count() > 100
    assert {os.path.basename(r.file): r.file_hash for r in ranges.file_hashes(found).collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in made.items()}


def test_no_range_is_read_otherwise_than_it_was_surveyed():
    with pytest.raises(RuntimeError, match="cut otherwise"):
        list(ranges._read([("f", 0, b"", None)]))


def test_small_ranges_share_tasks(spark, inbox):
    """A file of many ranges is no task for each of them, and those of a task are surveyed as one."""
    found = ranges.pieces(spark, inbox[0], 100)
    tasks = found.rdd.getNumPartitions()
    assert tasks <= ranges.TASKS * spark.sparkContext.defaultParallelism < found.select("path", "block").distinct().count()
    assert ranges.placed(found, together=True).count() <= tasks + len(inbox[1])
    assert ranges.placed(found).count() == found.select("path", "block").distinct().count()


def test_elements_decoded_together():
    raws = [b"<sms a='1'/>", b"<x:mms b='&#55357;'><parts><part ct='t'/></parts></x:mms>", b"<sms a='&bad;'/>", b"<call c='3'></sms>", b"<sms d='4'>x</sms>"]
    for some in (raws, raws[:2], raws[::4], []):
        for raw, got in zip(some, backup.decode_all(some), strict=True):
            if isinstance(got, Exception):
                with pytest.raises(type(got), match=str(got)):
                    backup.decode(raw)
            else:
                assert got == backup.decode(raw)


def test_held_rows_are_not_dealt_by_file(spark, tmp_path):
    """Rows up to each file's first error, without all rows of a large file in one task."""
    home = tmp_path / "in"
    home.mkdir()
    one = b'<sms address="1" date="1000" body="x" />'
    (home / "good.xml").write_bytes(b"<smses>" + one * 50 + b"</smses>")
    (home / "bad.xml").write_bytes(b"<smses>" + one * 30 + b'<sms body="&nothing;" />' + one * 20 + b"</smses>")
    rows = ranges.elements(ranges.pieces(spark, str(home), 200), keep=True)
    held = ranges.until_error(rows, held=True)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    by = lambda found: sorted((r.file.rpartition("/")[2], r.ordinal, r.kind) for r in found.collect())
    got = by(held)
    assert got == by(ranges.until_error(rows)) and [sum(r[0] == n for r in got) for n in ("bad.xml", "good.xml")] == [31, 50]
    good = ranges.elements(ranges.pieces(spark, str(home / "good.xml"), 200), keep=True)
    assert ranges.until_error(good, held=True) is good
    rows.scanned.unpersist()
    good.scanned.unpersist()
