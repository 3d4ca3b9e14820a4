"""The store's commit point, its buckets, and imports of pieces and streams."""

import os

import pytest
from pyspark.sql import functions as F

from missive.operators import store
from missive.sources import ranges
from missive.streaming import ingest


def backup_of(*rows: tuple[int, str]) -> bytes:
    each = "".join(f'<sms address="{900 + n % 7}" date="{n * 1000}" type="1" body="{body}"/>' for n, body in rows)
    return f"<smses>{each}</smses>".encode()


def contents(spark, **files: bytes):
    return spark.createDataFrame([(f"{n}.xml", bytearray(b)) for n, b in files.items()], "path string, content binary")


def seen(s):
    return sorted((r.id, r.date, r.body) for r in s.messages().collect())


@pytest.mark.parametrize("dies_at", ["messages", "media", "imports", "files", "commit"])
def test_an_append_that_dies_leaves_the_state_before(spark, tmp_path, monkeypatch, dies_at):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append(contents(spark, a=backup_of((1, "x"), (2, "y"))))
    before, state = seen(s), s.state()
    write, commit = store.Store._write, store.Store._commit

    def broken(self, rows, name, batch):
        write(self, rows, name, batch)
        if name == dies_at:
            raise KeyboardInterrupt

    def late(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_write", broken)
        if dies_at == "commit":
            m.setattr(store.Store, "_commit", late)
        with pytest.raises(KeyboardInterrupt):
            s.append(contents(spark, b=backup_of((3, "z"))))
    monkeypatch.setattr(store.Store, "_commit", commit)
    assert seen(s) == before and s.state() == state and s.imports().count() == 1 and s.files().count() == 1
    s.append(contents(spark, b=backup_of((3, "z"), (1, "x"))))
    assert seen(s) == [*before, (3, 3, "z")] and sorted(r.id for r in s.imports().collect()) == [1, 2]
    assert len(s.vacuum()) == 1 and seen(s) == [*before, (3, 3, "z")]


def test_the_first_of_two_writers_wins(spark, tmp_path, monkeypatch):
    one, other = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    write = store.Store._written

    def meanwhile(self, *args):
        monkeypatch.setattr(store.Store, "_written", write)
        other.append(contents(spark, b=backup_of((2, "theirs"))))
        return write(self, *args)

    monkeypatch.setattr(store.Store, "_written", meanwhile)
    with pytest.raises(store.Conflict):
        one.append(contents(spark, a=backup_of((1, "mine"))))
    assert seen(one) == [(1, 2, "theirs")]


def test_an_append_reads_its_own_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append(contents(spark, a=backup_of(*((n, f"text {n}") for n in range(300)))))
    few = spark.createDataFrame([(3,), (5,)], "bucket int")
    own = s._own("messages", s.state(), few)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and " IN (" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in own.select("bucket").distinct().collect()} <= {3, 5} and 0 < own.count() < 100


def test_compaction_keeps_the_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    for n in range(3):
        s.append(contents(spark, **{f"f{n}": backup_of((n, "a"), (n + 1, "b"))}), "stream", n)
    rows, imports = seen(s), s.imports().count()
    s.compact()
    assert len(s.state()["batches"]) == 1 and seen(s) == rows and s.imports().count() == imports
    assert len(s.vacuum()) == 3 and seen(s) == rows
    assert s.append(contents(spark, again=backup_of((9, "c"))), "stream", 2).count() == 1 and seen(s) == rows
    s.append(contents(spark, new=backup_of((0, "a"), (9, "c"))))
    assert seen(s) == [*rows, (max(r[0] for r in rows) + 1, 9, "c")]


def test_pieces_give_the_store_that_contents_give(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    data = {"a.xml": backup_of(*((n, f"text {n}" * (n % 9)) for n in range(80))), "b.xml": backup_of((1, "text 1"), (500, "x")), "c.xml": backup_of((7, "kept")) + b"<", "d.xml": b"<smses>" + backup_of((8, "ok"))[7:-8] + b"<sms a=1/>" + backup_of((9, "lost"))[7:]}
    for name, b in data.items():
        (home / name).write_bytes(b)
    whole, cut = store.Store(spark, str(tmp_path / "w")), store.Store(spark, str(tmp_path / "c"))
    logs = [
        sorted((os.path.basename(r.file), r.status, r.records) for r in s.append(found).collect())
        for s, found in ((whole, spark.read.format("binaryFile").load(str(home))), (cut, ranges.pieces(spark, str(home), 200)))
    ]
    assert logs[0] == logs[1] and [r[1] for r in logs[0]] == ["completed", "completed", "error", "error"]
    assert seen(whole) == seen(cut) and not any("lost" in (r[2] or "") for r in seen(cut))
    key = lambda s: sorted((r.file_hash, r.record_count, r.chain_hash) for r in s.imports().collect())
    assert key(whole) == key(cut) and len(key(cut)) == 2


def test_stream_moves_files_by_their_outcome(spark, tmp_path):
    home, archive = tmp_path / "in", tmp_path / "done"
    home.mkdir()
    (home / "good.xml").write_bytes(backup_of((1, "x")))
    (home / "bad.xml").write_bytes(backup_of((2, "y")) + b"<")
    s = store.Store(spark, str(tmp_path / "s"))
    run = lambda: ingest.start(spark, str(home), s, str(tmp_path / "check"), archive=str(archive), once=True).awaitTermination(90)
    run()
    assert sorted(os.listdir(home)) == ["bad.xml"] and sorted(n for n in os.listdir(archive) if n.endswith("xml")) == ["good.xml"]
    (home / "good.xml").write_bytes(backup_of((3, "z")))
    os.utime(home / "good.xml", (2_000_000_000, 2_000_000_000))
    (home / "other.xml").write_bytes(backup_of((1, "x")))
    run()
    assert sorted(os.listdir(home)) == ["bad.xml", "good.xml"]  # the source knows a file by its path
    assert {r.status for r in ingest.log(s).collect()} == {"completed", "error"} and s.messages().filter("body = 'x'").count() == 1


def test_byte_ranges_read_their_own_chunks(spark, tmp_path):
    import base64
    import hashlib

    blobs = [bytes(range(n)) * 3 for n in (1, 5, 40, 200)] + [b"x"]
    each = [f'<mms date="{i}000" m_id="m{i}" address="771"><parts><part ct="image/png" data="{base64.b64encode(b).decode()}"/></parts></mms>' for i, b in enumerate(blobs)]
    s = store.Store(spark, str(tmp_path / "s"), chunk=16)
    s.append(contents(spark, a=f"<smses>{''.join(each)}</smses>".encode()))
    keys = [hashlib.sha256(e.encode()).hexdigest() for e in each]
    assert {r.content_hash: bytes(r.media_data) for r in s.media().collect()} == dict(zip(keys, blobs, strict=True))
    for first, last in ((0, 0), (3, 20), (15, 16), (16, 31), (100, 599), (590, 2000)):
        assert {r.content_hash: bytes(r.media_data) for r in s.media_range(first, last).collect()} == {k: b[first : last + 1] for k, b in zip(keys, blobs, strict=True) if len(b) > first}
    one = s.media_range(100, 130, keys[3])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert bytes(one.collect()[0].media_data) == blobs[3][100:131]
    assert "GreaterThanOrEqual(n,6)" in plan.split("PushedFilters")[1]
    assert s.chunks().filter(F.col("content_hash") == keys[3]).count() == 38
