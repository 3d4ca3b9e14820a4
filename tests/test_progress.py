"""Progress of imports, whole documents, and the queue of jobs."""

import threading

from pyspark.sql import functions as F

from missive.operators.store import Store
from missive.sources import ranges
from missive.streaming import ingest
from missive.streaming.progress import Progress

SMS = '<sms address="771" date="{}000" type="1" body="{}"/>'
MMS = '<mms address="772" date="{}000" msg_box="1"><parts><part ct="text/plain" text="m"/></parts></mms>'
CALL = '<call number="773" date="{}000" duration="1" type="1"/>'


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.xml").write_text(text)
    return str(folder)


def mixed(n, said):
    return f'<?xml version="1.0"?><!-- <sms/> --><smses count="{said}">' + "".join((CALL, MMS, SMS)[i % 3].format(i + 1, "b" * 40) for i in range(n)) + "</smses>"


def test_progress_of_ranges_equals_what_is_stored(spark, tmp_path):
    inbox = put(tmp_path / "in", a=mixed(300, 300), b=mixed(30, 31), c=f"<smses>{SMS.format(9, 'x')}</smses>", d=f'<smses count="2">{SMS.format(8, "y")}<')
    p, s = Progress(spark), Store(spark, str(tmp_path / "store"))
    assert p.status() == {"total": None, "records": 0, "errors": 0, "running": False}
    log = s.append(ranges.pieces(spark, inbox, 1000), progress=p)
    assert p.status() == {"total": 333, "records": 332, "errors": 1, "running": False}
    assert log.agg(F.sum("records")).first()[0] == 332  # an element over ranges counts once
    s.append(ranges.pieces(spark, inbox, 5000), progress=p)  # again: read again, nothing new
    assert p.status() == {"total": 666, "records": 664, "errors": 2, "running": False}
    assert s.messages().count() == 302  # b's records are a's first thirty


def test_running_figures_become_exact(spark, tmp_path):
    inbox = put(tmp_path / "in", a=mixed(600, 600))
    p = Progress(spark)
    rows = p.begin(ranges.scanned(ranges.pieces(spark, inbox, 2000), p.counters()))
    assert p.status() == {"total": None, "records": 0, "errors": 0, "running": True}
    rows.write.format("noop").mode("overwrite").save()
    assert p.status() == {"total": 600, "records": 600, "errors": 0, "running": True}  # of the tasks that have ended
    p.end()
    assert p.status() == {"total": 600, "records": 600, "errors": 0, "running": False}
    p.begin(rows)
    p.drop()
    assert p.status()["records"] == 600


def test_documents_are_whole_and_ordered_by_kind(spark, tmp_path):
    inbox = put(tmp_path / "in", good=mixed(7, 7), none='<smses count="0"/>', other=f"<calls>{CALL.format(1)}</calls>", bare=SMS.format(1, "x"), cut=f"<smses>{SMS.format(1, 'x')}<", words="no markup")
    for size in (None, 64):
        got = ranges.documents(ranges.pieces(spark, inbox, size))
        by = {}
        for r in got.orderBy("file", "kind_order", "ordinal").collect():
            by.setdefault(r.file.rsplit("/")[-1], []).append((r.kind, r.ordinal, r.status))
        assert by.pop("good.xml") == [(k, i, "ok") for k, i in [("sms", 2), ("sms", 5), ("mms", 1), ("mms", 4), ("call", 0), ("call", 3), ("call", 6)]]
        assert {f: r for f, ((*_, r),) in by.items()} == {"other.xml": "root is calls", "bare.xml": "root is sms", "cut.xml": by["cut.xml"][0][2], "words.xml": "no element"}
        got.scanned.unpersist()


def test_jobs_run_one_after_another(spark, tmp_path):
    inbox, s, go, order = put(tmp_path / "in", a=mixed(3, 3)), Store(spark, str(tmp_path / "store")), threading.Event(), []
    jobs, p = ingest.Jobs(), Progress(spark)

    def first():
        go.wait(60)
        order.append(1)
        return s.append(ranges.pieces(spark, inbox), progress=p)

    def second():
        order.append(2)
        return s.append(ranges.pieces(spark, inbox))

    one, two = jobs.submit("ann", inbox, first, p), jobs.submit("ann", inbox, second)
    assert jobs.status("ann", two)["status"] == "queued" and jobs.status("bob", one) is None
    assert jobs.status("ann", one)["processed"] == 0
    go.set()
    jobs.wait(two, 120)
    assert order == [1, 2]  # two at once would meet in a Conflict
    state = jobs.status("ann", one)
    assert (state["status"], state["total"], state["processed"], state["records"]) == ("completed", 3, 3, 3)
    assert jobs.status("ann", two)["status"] == "completed"
    jobs.close()
