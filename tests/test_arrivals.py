"""Files that grow, settle, fail and are mended."""

import os

from missive.operators.store import Store
from missive.streaming import arrivals

ONE = '<sms address="771" date="{}000" type="1" body="{}"/>'


def put(path, text, when):
    path.write_text(text)
    os.utime(path, (when, when))


def test_states_of_arrival(spark, tmp_path):
    inbox, archive, sightings = tmp_path / "in", tmp_path / "done", tmp_path / "seen"
    inbox.mkdir(), sightings.mkdir()
    s = Store(spark, str(tmp_path / "store"))

    def turn(now):
        arrivals.look(spark, str(inbox), str(sightings), now)
        arrivals.start(spark, str(sightings), s, str(tmp_path / "check"), str(archive), once=True).awaitTermination(60)
        return sorted(r.body for r in s.messages().collect()), sorted(n for n in os.listdir(inbox) if n.endswith("xml"))

    put(inbox / "whole.xml", f"<smses>{ONE.format(1, 'a')}</smses>", 1000)
    put(inbox / "grows.xml", f"<smses>{ONE.format(2, 'b')}", 1000)
    put(inbox / "bad.xml", f"<smses>{ONE.format(3, 'c')}<", 1000)
    assert turn(10) == ([], ["bad.xml", "grows.xml", "whole.xml"])  # seen once
    assert turn(12) == ([], ["bad.xml", "grows.xml", "whole.xml"])  # the same, but too soon
    put(inbox / "grows.xml", f"<smses>{ONE.format(2, 'b')}{ONE.format(4, 'd')}</smses>", 1003)
    assert turn(16) == (["a", "c"], ["bad.xml", "grows.xml"])  # what failed keeps its place, and its records before the error
    assert turn(20) == (["a", "c"], ["bad.xml", "grows.xml"])
    assert turn(22) == (["a", "b", "c", "d"], ["bad.xml"])
    assert turn(40) == (["a", "b", "c", "d"], ["bad.xml"])  # not tried again as it is
    put(inbox / "bad.xml", f"<smses>{ONE.format(3, 'c')}{ONE.format(5, 'e')}</smses>", 1050)
    turn(50)
    assert turn(60) == (["a", "b", "c", "d", "e"], [])
    assert sorted(n for n in os.listdir(archive) if n.endswith("xml")) == ["bad.xml", "grows.xml", "whole.xml"]
    assert sorted((os.path.basename(r.file), r.status) for r in s.files().collect()) == [("bad.xml", "completed"), ("bad.xml", "error"), ("grows.xml", "completed"), ("whole.xml", "completed")]
