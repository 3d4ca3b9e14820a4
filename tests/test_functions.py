"""Scalar semantics, parameters, search expressions, cards and the stream."""

import shutil

import pytest
from pyspark.sql import functions as F

from missive.functions import labels, mime, phone, text, vcard
from missive.operators import analytics, control, reads, search
from missive.operators.store import Store
from missive.streaming import ingest


def values(spark, column, *inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_phones(spark):
    got = values(spark, phone.normalize, "", "ABC", "332", "5551234567", "15551234567", "+44 20 7946", "(555) 123-4567", "+ABC")
    assert got == ["", "", "332", "+15551234567", "+15551234567", "+44207946", "+15551234567", ""]
    assert values(spark, lambda c: phone.format_number(c, "list"), None, "5551234567, 332", "+445551234567") == ["Unknown", "(555) 123-4567, 332", "+44 555 123 4567"]
    assert values(spark, lambda c: phone.format_number(c, "activity"), "+15551234567", "+4420", "") == ["+1 (555) 123-4567", "+4420", ""]
    with pytest.raises(ValueError):
        phone.format_one(F.lit(""), "other")


def test_text(spark):
    assert values(spark, text.null_string, "null", " NULL\t", "nulls", "") == ["", "", "nulls", ""]
    assert values(spark, text.whole, "12", "-3", "+4", "1 ", "", "x", "99999999999999999999") == [12, -3, 4, 0, 0, 0, 0]
    assert values(spark, text.preview, None, "short", "x" * 60) == ["", "short", "x" * 50 + "..."]
    assert values(spark, text.sanitize_username, "Ann Lee!", "__", "bob") == ["ann_lee", "user", "bob"]
    assert values(spark, text.fold, "Élan VITAL", None, "ABC") == ["elan vital", None, "abc"]
    assert values(spark, mime.needs_conversion, "image/heif", "audio/3gpp", "audio/amr", "image/png") == ["image", "video", "audio", None]
    assert values(spark, mime.is_smil_markup, " <smil>", "<?xml", "hi") == [True, True, False]


def test_labels(spark):
    assert values(spark, labels.call, 1, 6, 9, kind="int") == ["Incoming call", "Refused call", "Call"]
    assert values(spark, labels.status, -1, 64, 5, kind="int") == ["none", "failed", None]
    assert values(spark, labels.presentation, 4, kind="int") == ["payphone"]
    assert values(spark, lambda c: labels.progress_percent(c, F.lit(0)), 0, 5, kind="int") == [0, 100]
    assert values(spark, lambda c: labels.progress_percent(c, F.lit(3)), 1, 2, kind="int") == [33, 67]
    now = 1_700_000_000
    got = values(spark, lambda c: labels.relative_date(c, F.lit(now)), now - 60, now - 90_000, now - 400_000, now - 5_000_000, now - 50_000_000, kind="long")
    assert got[0].startswith("Today at") and got[1].startswith("Yesterday at") and got[2].startswith("Friday at")
    assert got[3].startswith("Sep 18, ") and got[4].startswith("Apr 15, 2022, ")
    assert values(spark, lambda c: labels.sender_name(F.lit(""), c), ["5551234567", "x"], [], kind="array<string>") == ["+1 (555) 123-4567", "Unknown"]
    assert values(spark, labels.is_group, ["a"], ["a", "b"], None, kind="array<string>") == [False, True, False]
    assert values(spark, lambda c: labels.display_name(F.lit("12345678"), c, F.lit("1")), "Trip", "proto:x", "") == ["Trip", "12345678", "12345678"]
    assert values(spark, lambda c: labels.display_name(F.lit(""), c, F.lit("5551234567"), "print"), "Message", "Trip") == ["(555) 123-4567", "Trip"]


def test_parameters():
    assert analytics.parameters() == (10, 0) and analytics.parameters("50", "-840") == (50, -840)
    assert analytics.parameters("51", "841") == (10, 0) and analytics.parameters("x", None) == (10, 0)
    assert reads.instant("2024-01-01T00:00:00Z") == 1704067200 and reads.instant("yesterday") is None and reads.instant("2024-01-01") is None
    assert reads.instant("2024-01-01T01:00:00.5+01:00") == 1704067200 and reads.instant(None) is None
    for loose in ("2024-01-01T00Z", "2024-W01-1T00:00:00Z", "20240101T000000Z", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "2024-01-01 00:00:00Z"):
        assert reads.instant(loose) is None
    assert reads.is_last(49) and not reads.is_last(50)
    assert control.settings_of(None)["message_limit"] == 100_000 and control.settings_of('{"show_calls": false}')["show_calls"] is False


def test_search_language():
    assert search.parse("") is None
    assert search.parse('a "b c" d*') == search.Op("and", search.Op("and", search.Phrase(("a",)), search.Phrase(("b", "c"))), search.Phrase(("d",), prefix=True))
    assert search.parse("a OR b AND c").kind == "or" and search.parse("a NOT b").kind == "not"
    assert search.parse("^é") == search.Phrase(("e",), first=True)
    for bad in ("(a", "a)", "a ;", "NEAR(a, x)"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


def test_search_results(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "the cafe is closed"), (3, "au revoir"), (4, None)], "id long, body string")
    docs = docs.selectExpr("id", "'a' address", "null contact_name", "body", "0 date")
    ids = lambda q: sorted(r.id for r in search.search(docs, q).collect())
    assert ids("CAFE") == [1, 2] and ids("café au") == [1] and ids('"au lait"') == [1] and ids("au NOT lait") == [3]
    assert ids("ca*") == [1, 2] and ids("^au") == [3] and ids("") == [] and ids("NEAR(cafe closed, 1)") == [2] and ids("NEAR(cafe closed, 0)") == []
    assert "<mark>cafe</mark>" in search.search(docs, "closed OR cafe").filter("id = 2").collect()[0].snippet


def test_cards(spark):
    card = "BEGIN:VCARD\r\nVERSION:2.1\r\nN:Lee;Ann;;Dr.;\r\nFN:Ann\r\nTEL;WORK;FAX:1\r\nEMAIL;TYPE=internet:a@b.c\r\nNOTE;ENCODING=QUOTED-PRINTABLE:a=3Db\r\nPHOTO;ENCODING=b;TYPE=png:aa\r\n bb\r\nBDAY:--0203\r\nURL:http://x:8\r\n"
    got = vcard.parse(card)
    assert got["name"] == "Dr. Ann Lee" and got["note"] == "a=b" and got["photo"] == "data:image/png;base64,aabb" and got["url"] == "http://x:8"
    assert got["phone_numbers"] == [{"type": "Work, Fax", "number": "1"}] and got["emails"][0]["type"] == "Email"
    assert vcard.parse("FN:Only")["name"] == "Only" and vcard.parse(None)["name"] == ""
    assert values(spark, vcard.format_birthday, "--0203", "1990-02-03", "19900203", "x", None) == ["02/03", "02/03/1990", "02/03/1990", "x", ""]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, record_type int, address string, contact_name string, subject string, body string, type long, date long, duration long, media_type string")
    figures = analytics.analytics(empty)
    assert set(figures["summary"].collect()[0]) == {0, 0.0}
    assert [r["count"] for r in figures["hourly"].collect()] == [0] * 24 and figures["daily"].count() == 0
    assert reads.date_range(empty).collect()[0].first_date is None and reads.conversations(empty).count() == 0
    assert reads.activity(empty).count() == 0


def test_all_figures_from_one_scan(spark, tmp_path):
    """The bundle is what its parts are one by one, and reads its table once."""
    rows = [(i, i % 3 + 1, f"+1{i % 4}" if i % 9 else None, None if i % 5 == 0 else f"c{i}", "", "x" * (i % 7) if i % 3 < 2 else None, i % 6 + 1, 1_700_000_000 + 5000 * i, i if i % 3 == 2 else None, "") for i in range(200)]
    columns = "id long, record_type int, address string, contact_name string, subject string, body string, type long, date long, duration long, media_type string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "m"))
    messages = spark.read.parquet(str(tmp_path / "m"))
    window = (1_700_050_000, 1_700_800_000)
    got = analytics.analytics(messages, *window, top=3, tz_offset=-330, zone="Asia/Tokyo")
    own = reads.between(messages, *window)
    want = {"summary": analytics.summary(own), "top_contacts": analytics.top_contacts(own, 3), "hourly": analytics.hourly(own, -330), "daily": analytics.daily(own, "Asia/Tokyo")}
    want = {name: (df.columns, df.collect()) for name, df in want.items()}
    for name, (names, rows) in want.items():
        assert (got[name].columns, got[name].collect()) == (names, rows), name
        shutil.rmtree(tmp_path / "m", ignore_errors=True)  # the first has read all there is
    got["figures"].unpersist()


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.xml").write_bytes(b'<smses><sms address="332" date="1000" type="1" body="x"/></smses>')
    (inbox / "b.txt").write_bytes(b"no")
    s = Store(spark, str(tmp_path / "store"))
    seen = []
    run = lambda: ingest.start(spark, str(inbox), s, str(tmp_path / "check"), once=True, after=lambda df, n: seen.append(n)).awaitTermination(60)
    run()
    assert s.messages().count() == 1 and ingest.log(s).collect()[0].status == "completed"
    (inbox / "c.XML").write_bytes(b'<smses><sms address="332" date="1000" type="1" body="x"/><sms address="332" date="2000" type="1" body="y"/></smses>')
    run()
    assert s.messages().count() == 2 and s.imports().count() == 2 and len(seen) == 2


def test_jobs(spark):
    jobs = ingest.Jobs()
    done = spark.createDataFrame([("f", "completed", 2)], "file string, status string, records long")
    job = jobs.submit("ann", "p", lambda: done)
    jobs.wait(job, 60)
    assert jobs.status("ann", job)["records"] == 2 and jobs.status("bob", job) is None
    bad = jobs.submit("ann", "p", lambda: 1 / 0)
    jobs.wait(bad, 60)
    assert jobs.status("ann", bad)["status"] == "error"
