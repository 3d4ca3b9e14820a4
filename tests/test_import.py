"""From raw backup bytes to stored rows, hashes and exports."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from missive.operators import custody, export, normalize, reads, store
from missive.sources import backup

PAIR = b"""<?xml version="1.0"?>
<!-- made for these tests: <sms address="no"/> -->
<smses count="2" note="a > b">
  <sms date="1600000000999" type="2" address="771" status="-1" read="1" subject="NULL" service_center="null" body="1 &lt; 2, 3 > 2" />
  <sms date="1500000000001" type="1" address="(202) 555-0147" read="0" contact_name="Ann" body="soup"/>
</smses>"""
IMAGE = base64.b64encode(b"\xff\xd8image").decode()
GROUP = f"""<smses count="3">
<mms date="1300000000999" msg_box="1" address="(555) 000-1111~5550002222" ct_t="application/vnd.wap.multipart.related" m_id="m1" sub="Null" read="1" body="ignored">
<parts><part seq="-1" ct="application/smil" text="&lt;smil/&gt;"/><part ct="text/plain" text="first"/><part ct="image/jpeg" data="%%%" text="null"/>
<part ct="image/png" data="{IMAGE}"/><part ct="image/gif" data="{IMAGE}"/><part ct="text/plain" text="second"/><part ct="text/plain" text="null"/></parts>
<addrs><addr address="5550001111" type="151"/><addr address="+1 (555) 000-2222" type="137"/><addr address="15550003333" type="151"/><addr address="insert-address-token" type="137"/></addrs></mms>
<call number="15551234567" duration="61" date="1300000001000" type="3" presentation="1" contact_name="(Unknown)"/>
<sms address="5551234567" date="oops" type="1" body="dropped"/>
<sms address="BANK" date="1300000002000" type="1" body="&#55357;&#56832; ok"/>
</smses>""".encode()


def rows(spark, *files):
    found = spark.createDataFrame([(f"f{i}.xml", bytearray(b)) for i, b in enumerate(files)], "path string, content binary")
    return found, backup.split(found)


def test_scanner_spans_and_chunks():
    whole = list(backup.Scanner([PAIR]))
    assert [k for k, *_ in whole] == ["sms", "sms"]
    for size in (1, 2, 3, 7, 64):
        assert list(backup.Scanner(PAIR[i : i + size] for i in range(0, len(PAIR), size))) == whole
    for _, start, stop, raw in whole:
        assert PAIR[start:stop] == raw and raw.startswith(b"<sms") and raw.endswith(b"/>")
    scanner = backup.Scanner([PAIR])
    list(scanner)
    assert scanner.count == 2


def test_two_sms(spark):
    got = normalize.messages(rows(spark, PAIR)[1]).orderBy("ordinal").collect()
    assert [(r.address, r.date, r.read, r.body) for r in got] == [("771", 1600000000, True, "1 < 2, 3 > 2"), ("+12025550147", 1500000000, False, "soup")]
    assert got[0].subject == "" and got[0].service_center == "null" and got[0].status == -1
    assert got[1].sender == "+12025550147" and got[0].sender == "" and got[0].addresses == ["771"]
    raw = [r for *_, r in backup.Scanner([PAIR])]
    assert [r.content_hash for r in got] == [hashlib.sha256(r).hexdigest() for r in raw]


def test_group_mms_calls_and_bad_records(spark):
    got = {r.ordinal: r for r in normalize.messages(rows(spark, GROUP)[1]).collect()}
    assert sorted(got) == [0, 1, 3]
    mms, call, sms = got[0], got[1], got[3]
    assert mms.record_type == 2 and mms.address == "+15550001111,+15550002222,+15550003333"
    assert mms.sender == "+15550002222" and mms.body == "first second" and mms.subject == ""
    assert mms.media_type == "image/png" and bytes(mms.media_data) == b"\xff\xd8image" and mms.date == 1300000000
    assert call.record_type == 3 and call.duration == 61 and call.body is None and call.type == 3
    assert sms.address == "" and sms.body == "�� ok"


@pytest.mark.parametrize(
    "addrs, own, address, sender",
    [
        ('<addr address="5550001111" type="151"/><addr address="5550002222" type="151"/>', "5550002222", "+15550002222", "+15550001111"),
        ("", "5550002222", "+15550002222", ""),
    ],
)
def test_small_mms(spark, addrs, own, address, sender):
    text = f'<smses><mms date="1000" msg_box="1" address="{own}"><addrs>{addrs}</addrs></mms></smses>'.encode()
    got = normalize.messages(rows(spark, text)[1]).collect()[0]
    assert (got.address, got.sender, got.record_type) == (address, sender, 1)


def test_syntax_error_keeps_what_was_before(spark):
    got = rows(spark, PAIR.replace(b'body="soup"/>', b'body="soup">'))[1].orderBy("ordinal").collect()
    assert [r.kind for r in got] == ["sms", "error"]
    assert rows(spark, b"<smses count='0'></smses>")[1].count() == 0


def test_chain_and_vectors(spark):
    assert hashlib.sha256(b"abc").hexdigest().startswith("ba7816bf")
    links = ["11", "22", "33"]
    want = ""
    for h in links:
        want = hashlib.sha256(f"{want}\n{h}".encode()).hexdigest()
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate(links)], "file string, ordinal long, content_hash string")
    assert custody.chain(df).collect()[0].chain_hash == want
    col = spark.range(1).select(custody.chain_column(F.array(*map(F.lit, links))).alias("c"), custody.chain_column(F.array().cast("array<string>")).alias("e")).collect()[0]
    assert col.c == want and col.e == ""
    back = df.withColumn("ordinal", -F.col("ordinal"))
    assert custody.chain(back).collect()[0].chain_hash != want


def test_store_is_idempotent(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    found, _ = rows(spark, PAIR, GROUP, PAIR.replace(b"</smses>", b'<sms address="771" date="1600000000999" type="2" body="1 &lt; 2, 3 > 2"/></smses>'))
    done = {r.file: r for r in s.append(found).collect()}
    assert {r.status for r in done.values()} == {"completed"}
    assert done["f2.xml"].records == 3
    first = s.messages().collect()
    assert len(first) == 5 and sorted(r.id for r in first) == [1, 2, 3, 4, 5]
    s.append(found)
    assert s.messages().count() == 5 and s.media().count() == 1
    imports = s.imports().orderBy("id").collect()
    assert [r.id for r in imports] == [1, 2, 3, 4, 5, 6]
    assert [r.chain_hash for r in imports[:3]] == [r.chain_hash for r in imports[3:]]
    assert imports[0].file_hash == hashlib.sha256(PAIR).hexdigest() and imports[0].record_count == 2
    assert custody.latest(s.imports()).collect()[0].id == 6
    mms = s.messages().filter("media_type = 'image/png'").collect()[0]
    media = reads.media_content(s.messages(), s.media(), mms.id)
    assert bytes(media.collect()[0].media_data) == b"\xff\xd8image"
    assert bytes(reads.slice_media(media, *reads.byte_range("bytes=2-", 7)).collect()[0].media_data) == b"image"
    names = [r.name for r in export.columns_in_use(export.split(s.messages())[0]).collect()]
    assert names == sorted(names) and "media_type" in names and "sim_slot" not in names
    kinds = {(r.kind, json.loads(r.json).get("number")) for r in export.json_rows(s.messages()).collect()}
    assert ("call", "+15551234567") in kinds
    summary = export.summary(s.messages(), s.imports()).collect()[0]
    assert (summary.message_count, summary.call_count) == (4, 1) and summary.custody.record_count == 3


def test_failed_file_has_no_import_row(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    found, _ = rows(spark, PAIR + b"<")
    assert [r.status for r in s.append(found).collect()] == ["error"]
    assert s.messages().count() == 2 and s.imports().count() == 0


def test_data_source_and_listing(spark, tmp_path):
    (tmp_path / "a.XML").write_bytes(PAIR)
    (tmp_path / ".b.xml").write_bytes(PAIR)
    (tmp_path / "c.log").write_bytes(b"x")
    spark.dataSource.register(backup.BackupSource)
    assert spark.read.format("missive_backup").load(str(tmp_path)).count() == 2
    assert backup.read_backups(spark, str(tmp_path)).count() == 2
    assert [r.name for r in backup.backup_files(spark, str(tmp_path)).collect()] == ["a.XML"]
    for bad in (None, " ", str(tmp_path / "none"), str(tmp_path)):
        with pytest.raises((ValueError, OSError)):
            backup.checked_path(bad)


def test_byte_ranges():
    assert reads.byte_range(None, 5) is None and reads.byte_range("bytes=1-3", 5) == (1, 3)
    for bad in ("bytes=5-", "bytes=3-1", "items=0-1", "bytes=a-"):
        with pytest.raises(ValueError):
            reads.byte_range(bad, 5)


def test_contents_are_split_by_chunks(spark):
    """Files longer than a chunk, one with an error before others, one empty and one without content, in one task."""
    own = b"<sms address='1' date='1000' body='" + b"y" * 700 + b"'/>"
    made = {"a": b"<smses>" + own * 40 + b"</smses>", "b": own * 9 + b"</x>" + own * 20, "c": b"", "d": own * 8, "e": None}
    found = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in made.items()], "path string, content binary").coalesce(1)
    sizes = [len(r.chunk) for r in backup.chunked(found).collect()]
    assert max(sizes) == backup.SENT and sum(sizes) == sum(len(c or b"") for c in made.values())
    got = {n: [] for n in made}
    for r in backup.split(found).collect():
        got[r.file].append((r.ordinal, r.kind, r.start, r.stop, None if r.raw is None else bytes(r.raw), r.status))
    for name, data in made.items():
        assert got[name] == [(r["ordinal"], r["kind"], r["start"], r["stop"], r["raw"], r["status"]) for r in backup.records([data or b""], name)]
