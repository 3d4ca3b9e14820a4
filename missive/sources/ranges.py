"""Backup files cut at byte ranges, so that one large file is read by many tasks.

The text reader delivers a file in pieces between "<" bytes, and cuts it at byte ranges
as it does any text; a range thus begins at a "<" that may open markup, or may stand in
a comment, a CDATA section, a processing instruction or a quoted attribute. What it is
depends on all that came before. So a first pass works out, for every state in which a
range may be entered, in which it is left and what that does to the nesting: states run
together after a few pieces, so this costs little more than one scan. A fold over the
ranges of a file then gives the state, depth, place and next ordinal at which each is
really entered, and a second pass takes out the elements. An element that crosses ranges
comes out in parts, which are put together by its ordinal.

Ranges are what can be read apart, not what a task is started for: small ones share a
task, and those of a task that follow each other in a file are read as one.

The results are those of `backup.records` over the whole file. No file content is ever
one value, and nothing is shuffled but elements that cross ranges. An empty file has no
pieces and leaves no trace.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.schema import RAW
from missive.sources import backup
from missive.streaming.progress import Progress

PIECES = "path string, size long, block long, until long, piece binary"
#: XML files, in any case, but no dot files.
NAMES = "[!.]*.[xX][mM][lL]"
#: Ranges whose places are sent to every task (some 100 bytes each); with more of them the pieces are shuffled to their range.
SENT = 100_000
#: Bytes of ranges that share a task, at the least number of tasks for each core.
TASK, TASKS = 32 << 20, 3
#: Elements that are decoded together.
DECODED = 100
#: Bytes of a file that are hashed at a time.
HASHED = 1 << 20

_IN_TAG = re.compile(rb"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+""")
#: Markup from its "<" on: what has its own ending, else what a tag begins with (nothing: no name, or one that a "<" follows) and its ">".
_MARKUP = re.compile(rb"<(?:(!--|!\[CDATA\[|\?)|(?=(/|!|[^\s/><]++(?=[\s/>])|))" + _IN_TAG.pattern + rb"(>?))")
_COUNT = re.compile(rb"""\scount\s*=\s*["']([0-9]{1,18})["']""")
_CLOSED_BY = {"comment": b"-->", "cdata": b"]]>", "pi": b"?>"}
_OPENED_BY = {b"!--": "comment", b"![CDATA[": "cdata", b"?": "pi"}
#: What a tag that goes on over a "<" may be: a start tag, one of a wanted kind, an end tag, a declaration, one without a name.
_TAGS = ("open", "want", "shut", "else", "void")
STATES = ["text", *_CLOSED_BY, *[tag + quote for tag in _TAGS for quote in ("", '"', "'")]]


def pieces(spark: SparkSession, path: str | list[str], range_bytes: int | None = None, names: str = NAMES) -> DataFrame:
    """PIECES of files, or of those under a path, whose names fit a pattern. Both passes must cut a file alike, so the
    number of tasks that the cuts depend on is fixed in a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if range_bytes:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
    lines = own.read.option("lineSep", "<").option("pathGlobFilter", names).text(path)
    if range_bytes and range_bytes < TASK:
        least = TASKS * spark.sparkContext.defaultParallelism
        lines = lines.coalesce(max(least, -(-lines.rdd.getNumPartitions() * range_bytes // TASK)))
    return cut(lines)


def cut(lines: DataFrame) -> DataFrame:
    """PIECES of lines that a text reader, of a table or a stream, splits at "<"."""
    at = F.col("_metadata")
    block = at["file_block_start"]
    return lines.select(at["file_path"].alias("path"), at["file_size"].alias("size"), block.alias("block"), (block + at["file_block_length"]).alias("until"), F.col("value").cast("binary").alias("piece"))


def _stretches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list, list[bytes]]]:
    """The pieces of one range that stand together in a batch, with its path, block and names."""
    for batch in batches:
        n = batch.num_rows
        if n:
            path, block = batch.column("path"), batch.column("block").to_numpy()
            new = (block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            pieces = batch.column("piece").to_pylist()
            for first, end in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), n]):
                yield [batch.column(c)[first].as_py() for c in ("path", "block", *names)], pieces[first:end]


# ------------------------------------------------------------ pieces, entered in one state


def _left(state: str, data: bytes, known: dict[str, int]) -> int:
    """Where data, entered inside markup, leaves it: after its ending, or for a tag at its ">" or
    at the quote that does not end; else the length of data. What holds for all tags is known."""
    if state in _CLOSED_BY:
        end = data.find(_CLOSED_BY[state])
        return len(data) if end < 0 else end + len(_CLOSED_BY[state])
    quote = state[4:]
    if quote not in known:
        at = data.find(quote.encode()) + 1 if quote else 0
        known[quote] = -1 if quote and not at else _IN_TAG.match(data, at).end()
    return known[quote]


def _event(tag: str, single: bool) -> str | None:
    return {"open": "leaf" if single else "open", "want": "solo" if single else "want", "shut": "shut", "else": None, "void": "fail"}[tag]


def advance(state: str, data: bytes, known: dict[str, int] | None = None) -> tuple[list[tuple[str, int, int]], str, int]:
    """Of pieces with a "<" before each, entered in a state: the events (open, want, leaf, solo,
    shut or fail), each with the places of its tag's "<" (-1 if it began before) and of what
    follows its ">"; the state after them; and where a tag that goes on begins, or -1."""
    found, at = [], 0
    if state != "text":
        at = _left(state, data, {} if known is None else known)
        if state in _CLOSED_BY:
            if at == len(data) and not data.endswith(_CLOSED_BY[state]):
                return found, state, -1
        elif at < 0 or at == len(data):
            return found, state if at < 0 else state[:4], -1
        elif data[at] != 0x3E:
            return found, state[:4] + chr(data[at]), -1
        else:
            event = _event(state[:4], at > 0 and data[at - 1] == 0x2F)
            at += 1
            if event:
                found.append((event, -1, at))
    search, add, wanted = _MARKUP.search, found.append, backup.KINDS
    while match := search(data, at):
        opening, name, end = match.groups()
        begin, at = match.span()
        if opening:
            kind = _OPENED_BY[opening]
            at = data.find(_CLOSED_BY[kind], at) + len(_CLOSED_BY[kind])
            if at < len(_CLOSED_BY[kind]):
                return found, kind, -1
            continue
        tag = "shut" if name == b"/" else "else" if name == b"!" else "void" if not name else "want" if name in wanted or name.rpartition(b":")[2] in wanted else "open"
        if not end:
            return found, tag if at == len(data) else tag + chr(data[at]), begin
        if tag == "shut":
            add(("shut", begin, at))
        elif event := _event(tag, data[at - 2] == 0x2F):
            add((event, begin, at))
    return found, "text", -1


# ------------------------------------------------------------ a range, entered in any state


@dataclass
class Effect:
    """What a stretch of pieces does to nesting, seen from outside any wanted element.

    low holds, for each depth under the first that is reached, the wanted elements begun
    before and the place: at such a place nothing begun in the stretch is open, so that an
    element that was open before and ends there is followed by what follows for all."""

    delta: int = 0
    low: list[tuple[int, int]] = field(default_factory=list)
    begun: int = 0
    open_at: int | None = None  # depth at which the last wanted element, still open, began
    stop: int = -1  # where the last one ended
    failed: bool = False

    def take(self, event: str | None, end: int) -> None:
        if self.failed or event == "leaf":
            return
        if event == "fail":
            self.failed = True
        elif event == "shut":
            self.delta -= 1
            if self.open_at is not None and self.delta == self.open_at:
                self.open_at, self.stop = None, end
            if self.delta < -len(self.low):
                self.low.append((self.begun, end))
        else:
            if event != "open" and self.open_at is None:
                self.begun += 1
                if event == "want":
                    self.open_at = self.delta
                else:
                    self.stop = end
            self.delta += event != "solo"

    def then(self, other: Effect) -> Effect:
        """This and what comes after it."""
        if self.failed:
            return self
        inside = None if self.open_at is None else self.delta - self.open_at
        begun, stop, open_at = entered(other, inside)
        before = 0 if inside is None or inside > len(other.low) else other.low[inside - 1][0]
        low = list(self.low)
        while (level := len(low) + 1 + self.delta) <= len(other.low):
            low.append((self.begun + other.low[level - 1][0] - before, other.low[level - 1][1]))
        return Effect(self.delta + other.delta, low, self.begun + begun, self.open_at if open_at == "still" else None if open_at is None else open_at + self.delta, max(self.stop, stop), other.failed)


def entered(effect: Effect, inside: int | None) -> tuple[int, int, int | str | None]:
    """(elements begun, last stop or -1, depth of the open one) if a stretch is entered so
    many levels inside a wanted element; "still" if that one stays open."""
    if inside is None:
        return effect.begun, effect.stop, effect.open_at
    if inside > len(effect.low):
        return 0, -1, "still"
    before, place = effect.low[inside - 1]
    return effect.begun - before, max(place, effect.stop), effect.open_at


class _Run:
    """Pieces read in one state, until another run comes to the same state."""

    def __init__(self, state: str):
        self.state, self.effect, self.next = state, Effect(), None

    def whole(self) -> tuple[str, Effect]:
        if self.next is None:
            return self.state, self.effect
        state, rest = self.next.whole()
        return state, self.effect.then(rest)


class _Range:
    def __init__(self, path: str, size: int, block: int):
        self.path, self.size, self.block, self.bytes = path, size, block, 0
        self.entries = {s: _Run(s) for s in STATES}
        self.live = list(self.entries.values())
        self.headless = block == 0  # the first piece of a file follows no "<"
        self.most = 1  # pieces until runs are looked at again: they meet early or seldom

    def take(self, *pieces: bytes) -> None:
        at = 0
        if self.headless:
            self.headless, at = False, 1
            self.bytes += len(pieces[0]) + 1
        while at < len(pieces):
            self._take(b"<" + b"<".join(pieces[at : at + self.most]))
            at, self.most = at + self.most, 2 * self.most

    def _take(self, data: bytes) -> None:
        place = self.bytes - (self.block == 0)  # of the data in the range
        self.bytes += len(data)
        by: dict[str, list[_Run]] = {}
        known: dict[str, int] = {}
        for run in self.live:
            events, run.state, _ = advance(run.state, data, known)
            take = run.effect.take
            for event, _, end in events:
                take(event, place + end)
            by.setdefault(run.state, []).append(run)
        if len(by) < len(self.live):
            self.live = []
            for state, runs in by.items():
                if len(runs) > 1:
                    met = _Run(state)
                    for run in runs:
                        run.next = met
                    runs = [met]
                self.live.append(runs[0])

    def row(self) -> dict:
        ways = []
        for entry, run in self.entries.items():
            state, e = run.whole()
            ways.append({"entry": entry, "state": state, "delta": e.delta, "begun": e.begun, "open": e.open_at is not None, "open_at": e.open_at or 0, "stop": e.stop, "failed": e.failed, "low_begun": [b for b, _ in e.low], "low_place": [p for _, p in e.low]})
        return {"path": self.path, "size": self.size, "block": self.block, "bytes": self.bytes, "ways": ways}


_WAY = pa.struct([("entry", pa.string()), ("state", pa.string()), ("delta", pa.int64()), ("begun", pa.int64()), ("open", pa.bool_()), ("open_at", pa.int64()), ("stop", pa.int64()), ("failed", pa.bool_()), ("low_begun", pa.list_(pa.int64())), ("low_place", pa.list_(pa.int64()))])
_RANGE = pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("ways", pa.list_(_WAY))])
_RANGE_DDL = "path string, size long, block long, bytes long, ways array<struct<entry: string, state: string, delta: long, begun: long, open: boolean, open_at: long, stop: long, failed: boolean, low_begun: array<long>, low_place: array<long>>>"


def _surveyed(batches: Iterator[pa.RecordBatch], together: bool) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    last = next_ = None
    for (path, block, size, until), pieces in _stretches(batches, ["size", "until"]):
        if (path, block) != last and not (together and (path, block) == next_):
            if now is not None:
                yield pa.RecordBatch.from_pylist([now.row()], schema=_RANGE)
            now = _Range(path, size, block)
        last, next_ = (path, block), (path, until)
        now.take(*pieces)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema=_RANGE)


# ------------------------------------------------------------ the ranges of a file, in order

_PLACED = "path string, block long, entry string, depth long, open_at long, ordinal long, offset long, stop long, dead boolean, last boolean, tail boolean"


def _folded(ranges: pd.DataFrame) -> pd.DataFrame:
    ranges = ranges.sort_values("block")
    # the reader drops a byte order mark, and a "<" that ends the file
    missing = int(ranges["size"].iloc[0] - ranges["bytes"].sum() + 1)
    state, depth, open_at, ordinal, offset, stop, dead = "text", 0, None, 0, 3 * (missing >= 3), 0, False
    out = []
    for i, r in enumerate(ranges.itertuples()):
        last = i == len(ranges) - 1
        out.append((r.path, r.block, state, depth, -1 if open_at is None else open_at, ordinal, offset, stop, dead, last, last and missing % 3 == 1))
        w = next(w for w in r.ways if w["entry"] == state)
        effect = Effect(w["delta"], list(zip(w["low_begun"], w["low_place"], strict=True)), w["begun"], w["open_at"] if w["open"] else None, w["stop"], w["failed"])
        begun, at, opened = entered(effect, None if open_at is None else depth - open_at)
        dead = dead or effect.failed or depth < len(effect.low)
        open_at = open_at if opened == "still" else None if opened is None else depth + opened
        state, depth, ordinal = w["state"], depth + effect.delta, ordinal + begun
        stop = offset + at if at >= 0 else stop
        offset += r.bytes - (r.block == 0)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PLACED.split(", ")])


def placed(found: DataFrame, together: bool = False) -> DataFrame:
    """For each range of PIECES the state in which it is entered, the depth, that of the open
    element (or -1), the next ordinal, the offset of its first "<", and where the last
    element ended. With together, ranges of a task that follow each other are one."""
    ranges = found.select("path", "size", "block", "until", "piece").mapInArrow(lambda batches: _surveyed(batches, together), _RANGE_DDL)
    return ranges.groupBy("path").applyInPandas(_folded, _PLACED)


# ------------------------------------------------------------ elements

_OUT = f"{RAW}, block long, part boolean"


class _Reader:
    """The second pass over one range."""

    def __init__(self, path: str, block: int, place: dict | None):
        if place is None:
            raise RuntimeError(f"{path} was cut otherwise the first time")
        self.path, self.block, self.place = path, block, place
        self.state, self.depth, self.ordinal = place["entry"], place["depth"], place["ordinal"]
        self.at, self.stop, self.over = place["offset"], place["stop"], place["dead"]
        self.headless = block == 0
        self.open_at = None if place["open_at"] < 0 else place["open_at"]
        self.counted = False  # whether the open element has its ordinal from this range
        self.root: bytes | None = None  # the tag of the document's element, if it is here
        self.kind: str | None = None
        self.start: int | None = None  # where it begins, if it does so here
        self.held: list[bytes] | None = [] if self.open_at is not None or self.state[:4] == "want" else None

    def _row(self, kind: str | None, raw: bytes | None, start: int | None, stop: int | None, status: str = "ok") -> dict:
        mine = self.ordinal - (self.open_at is not None and not self.counted)
        part = kind != "error" and (start is None or stop is None)
        return {"file": self.path, "ordinal": mine, "kind": kind, "start": start, "stop": stop, "raw": raw, "attrs": {}, "parts": [], "addrs": [], "status": status, "block": self.block, "part": part}

    def _error(self, what: str) -> dict:
        self.over = True
        return self._row("error", None, self.stop, self.stop, what)

    def take(self, *pieces: bytes) -> Iterator[dict]:
        if self.headless:
            self.headless = False
            self.at += len(pieces[0])
            pieces = pieces[1:]
        if self.over or not pieces:
            return
        data, at = b"<" + b"<".join(pieces), self.at
        self.at += len(data)
        events, self.state, going = advance(self.state, data)
        held = 0  # from where on the data is the open element's
        for event, begin, end in events:
            if self.held is None and begin >= 0 and event in ("want", "solo"):
                held = self._begun(data, at, begin)
            if self.root is None and not self.depth and begin >= 0 and event not in ("shut", "fail") and data.find(b"<", begin + 1, end) < 0:
                self.root = data[begin + 1 : end]
            if event == "fail":
                yield self._error("tag without name")
                return
            if event == "shut":
                self.depth -= 1
                if self.depth < 0:
                    yield self._error("end tag without element")
                    return
                if self.depth == self.open_at:
                    yield self._ended(data[held:end], at + end)
            elif event in ("want", "solo") and self.open_at is None:
                self.open_at, self.counted = self.depth, True
                if event == "solo":
                    yield self._ended(data[held:end], at + end)
                else:
                    self.depth += 1
            elif event in ("want", "open"):
                self.depth += 1
        if self.held is None and going >= 0 and self.state[:4] == "want":
            held = self._begun(data, at, going)
        if self.held is not None:
            self.held.append(data[held:])

    def _begun(self, data: bytes, at: int, begin: int) -> int:
        self.held, self.start, self.kind = [], at + begin, backup.NAME.match(data, begin + 1)[0].rpartition(b":")[2].decode()
        return begin

    def _ended(self, rest: bytes, stop: int) -> dict:
        self.stop = stop
        row = self._row(self.kind, b"".join([*self.held, rest]), self.start, self.stop)
        self.ordinal += self.counted
        self.open_at, self.held, self.counted, self.kind, self.start = None, None, False, None, None
        return row

    def said(self) -> Iterator[dict]:
        """What the document's element says of itself: its name, and how many records follow."""
        if self.root is not None:
            count = _COUNT.search(self.root)
            attrs = {"name": backup.NAME.match(self.root)[0].rpartition(b":")[2].decode(errors="replace")} | ({"count": count[1].decode()} if count else {})
            yield self._row("root", None, self.place["offset"], self.place["offset"]) | {"ordinal": -1, "attrs": attrs}

    def end(self) -> Iterator[dict]:
        if self.place["tail"]:
            yield from self.take(b"")
        if self.over:
            return
        if not self.place["last"]:
            if self.held is not None:
                yield self._row(self.kind, b"".join(self.held), self.start, None)
        elif self.state in _CLOSED_BY:
            yield self._error("markup without end")
        elif self.state != "text":
            yield self._error("attribute without end" if self.state[4:] else "tag without end")
        elif self.depth:
            yield self._error("element without end")


_ARROW = pa.schema([*backup.ARROW, ("block", pa.int64()), ("part", pa.bool_())])


def _read(rows: Iterator[tuple[str, int, bytes, dict | None]], roots: bool = False) -> Iterator[dict]:
    """Rows of each range, by its pieces and its place; with roots, also what the documents' elements say."""
    for (path, block), own in groupby(rows, lambda r: r[:2]):
        reader = None
        for _, _, piece, place in own:
            reader = reader or _Reader(path, block, place)
            yield from reader.take(piece)
        yield from chain(reader.end(), reader.said() if roots else ())


def _read_together(batches: Iterator[pa.RecordBatch], places: dict[tuple[str, int], dict]) -> Iterator[dict]:
    """Rows of ranges, and what the documents' elements say; those that follow each other are one."""
    now: _Reader | None = None
    last = next_ = None
    for (path, block, until), pieces in _stretches(batches, ["until"]):
        if (path, block) != last and (path, block) != next_:
            if now is not None:
                yield from chain(now.end(), now.said())
            now = _Reader(path, block, places.get((path, block)))
        last, next_ = (path, block), (path, until)
        yield from now.take(*pieces)
    if now is not None:
        yield from chain(now.end(), now.said())


def _decoded(rows: Iterable[dict]) -> Iterator[dict]:
    rows = iter(rows)
    while some := list(islice(rows, DECODED)):
        own = [row for row in some if row["kind"] not in ("error", "root") and not row["part"]]
        for row, said in zip(own, backup.decode_all([row["raw"] for row in own]), strict=True):
            if isinstance(said, Exception):
                row |= {"kind": "error", "raw": None, "start": row["stop"], "status": str(said)}
            else:
                row["attrs"], row["parts"], row["addrs"] = said
        yield from some


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    return backup.batches(_decoded(rows), schema=_ARROW)


def _metered(batches: Iterator[pa.RecordBatch], meter: tuple | None) -> Iterator[pa.RecordBatch]:
    """The same batches; a meter takes up what they announce and the records that begin in them."""
    for batch in batches:
        if meter is not None:
            for kind, part, start, attrs in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "start", "attrs")), strict=True):
                if kind == "root":
                    meter[0].add(int(dict(attrs).get("count", 0)))
                elif kind != "error" and (not part or start is not None):
                    meter[1].add(1)
        yield batch


def _scan(found: DataFrame) -> Callable[..., DataFrame]:
    """A scan(parts, meter) of PIECES whose places are known: all rows, or only parts of elements."""
    columns = ["path", "block", "piece"]
    rows = placed(found, together=True).limit(SENT + 1).collect()

    def out(rows: Iterator[dict], parts: bool, meter: tuple | None) -> Iterator[pa.RecordBatch]:
        return _metered(_batches(r for r in rows if r["part"] or not parts), meter)

    if len(rows) <= SENT:
        sent = found.sparkSession.sparkContext.broadcast({(r["path"], r["block"]): r.asDict() for r in rows})

        def scan(parts: bool = False, meter: tuple | None = None) -> DataFrame:
            return found.select(*columns, "until").mapInArrow(lambda batches: out(_read_together(batches, sent.value), parts, meter), _OUT)

        return scan

    places = placed(found)
    names = [c for c in places.columns if c not in columns]
    place = F.when(F.col("entry").isNotNull(), F.struct(*names)).alias("place")
    numbered = found.select(*columns, F.monotonically_increasing_id().alias("at"))
    dealt = numbered.join(places, ["path", "block"], "left").select(*columns, "at", place).repartition("path", "block").sortWithinPartitions("path", "block", "at")

    def scan_joined(parts: bool = False, meter: tuple | None = None) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = (row for b in batches for row in b.select([*columns, "place"]).to_pylist())
            return out(_read(((r["path"], r["block"], r["piece"], r["place"]) for r in each), roots=True), parts, meter)

        return dealt.mapInArrow(read, _OUT)

    return scan_joined


def scanned(found: DataFrame, meter: tuple | None = None) -> DataFrame:
    """RAW rows of the elements that lie within one range, the parts of the others, errors, and
    for each file that has it a row of kind "root" with its first element's name and count. A
    meter is two accumulators, of records announced and read (`Progress.counters`)."""
    return _scan(found)(meter=meter)


def elements(found: DataFrame, keep: bool = False, progress: Progress | None = None) -> DataFrame:
    """RAW rows of PIECES. Rows after a file's first error are not left out where the error
    is in an element's own text: see `until_error`. With keep the scan's rows are held on
    disk, as `result.scanned`, for the caller to unpersist; without it, files are read again for
    parts of elements. A progress is told what the scan meets."""
    scan = _scan(found)
    rows = scan() if progress is None else progress.begin(scan(meter=progress.counters()))
    if keep:
        rows = rows.persist(StorageLevel.DISK_ONLY)
    columns = [f.split(" ")[0] for f in ("file", "ordinal", "kind", "start", "stop", "raw", "attrs", "parts", "addrs", "status")]
    parts = (rows if keep else scan(parts=True)).filter("part").groupBy("file", "ordinal").agg(F.max("kind").alias("kind"), F.max("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("parts"))
    # an element of which the beginning or the end is missing was cut short by an error

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = {"attrs": {}, "parts": [], "addrs": [], "status": "ok", "block": 0, "part": False}
        yield from _batches(blank | r | {"raw": b"".join(p["raw"] for p in r.pop("pieces"))} for b in batches for r in b.to_pylist())

    whole = parts.filter("start IS NOT NULL AND stop IS NOT NULL").withColumnRenamed("parts", "pieces").mapInArrow(assemble, _OUT)
    out = rows.filter("NOT part AND kind != 'root'").select(*columns).unionByName(whole.select(*columns))
    out.scanned = rows
    return out


def until_error(rows: DataFrame, held: bool = False) -> DataFrame:
    """RAW rows up to the first error of each file, which ends it. rows are read twice. With held,
    which says that they are kept, they are looked at first: the errors of up to SENT files are
    sent to every task, so that rows stay where they are and a large file is not one task's."""
    first = rows.filter("kind = 'error'").groupBy("file").agg(F.min("ordinal").alias("last_ordinal"))
    if held:
        found = first.limit(SENT + 1).collect()
        if len(found) <= SENT:
            if not found:
                return rows
            first = F.broadcast(rows.sparkSession.createDataFrame(found, first.schema))
    return rows.join(first, "file", "left").filter("last_ordinal IS NULL OR ordinal < last_ordinal OR (ordinal = last_ordinal AND kind = 'error')").select(*rows.columns)


#: The order of a whole document's records, and the name of its first element: fixed values.
KIND_ORDER = ("sms", "mms", "call")
ROOT = "smses"


def documents(found: DataFrame) -> DataFrame:
    """RAW rows of PIECES as whole documents, with `kind_order`: a document's order is by
    kind_order and ordinal. A file is taken whole or not at all: one with an error, or whose
    first element is not ROOT, gives one row of kind "error" and no other. Files without any
    element are refused too. The scan is held on disk, as `result.scanned`."""
    rows = elements(found, keep=True)
    first_error = rows.filter("kind = 'error'").groupBy("file").agg(F.min_by("status", "ordinal").alias("wrong"))
    roots = rows.scanned.filter("kind = 'root'").groupBy("file").agg(F.min_by(F.col("attrs")["name"], "start").alias("name"))
    files = found.select(F.col("path").alias("file")).distinct().join(first_error, "file", "left").join(roots, "file", "left")
    reason = F.coalesce("wrong", F.when(F.col("name").isNull(), "no element").when(F.col("name") != ROOT, F.concat(F.lit("root is "), "name")))
    bad = files.select("file", reason.alias("wrong")).filter("wrong IS NOT NULL")
    kept = rows.filter("kind != 'error'").join(bad, "file", "left_anti")
    types = dict(kept.dtypes)
    said = {"kind": F.lit("error"), "ordinal": F.lit(0), "status": F.col("wrong"), "file": F.col("file")}
    refused = bad.select(*[said.get(c, F.lit(None)).cast(types[c]).alias(c) for c in kept.columns])
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")).cast("int")
    out = kept.unionByName(refused).withColumn("kind_order", order)
    out.scanned = rows.scanned
    return out


# ------------------------------------------------------------ hashes of files


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, block, n, bytes): what a range holds from its first "<" on, in order."""
    key, n, held, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [key[0]], "size": [key[1]], "block": [key[2]], "n": [n], "bytes": [b"".join(held)]}, schema=_CHUNK)

    for (path, block, whole), pieces in _stretches(batches, ["size"]):
        now = (path, whole, block)
        if now != key or size >= HASHED:
            if held:
                yield out()
            n, held, size = (n + 1 if now == key else 0), [], 0
        data = b"<".join(pieces)
        held.append(data if now != key and block == 0 else b"<" + data)
        key = now
        size += len(data) + 1
    if held:
        yield out()


_CHUNK = pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, length, size, plain, marked = None, 0, 0, None, None

    def out() -> pa.RecordBatch:
        missing = size - length  # a byte order mark, a "<" at the end, or both
        found = marked if missing >= 3 else plain
        if missing % 3 == 1:
            found.update(b"<")
        return pa.RecordBatch.from_pydict({"file": [now], "file_hash": [found.hexdigest()]})

    for batch in batches:
        for r in batch.to_pylist():
            if r["path"] != now:
                if now is not None:
                    yield out()
                now, size, length, plain, marked = r["path"], r["size"], 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
            for h in (plain, marked):
                h.update(r["bytes"])
            length += len(r["bytes"])
    if now is not None:
        yield out()


def file_hashes(found: DataFrame) -> DataFrame:
    """H1 of each file. A hash has one order, so a file's bytes go through one task, in
    chunks and constant memory."""
    chunks = found.select("path", "size", "block", "piece").mapInArrow(_joined, "path string, size long, block long, n long, bytes binary")
    return chunks.repartition("path").sortWithinPartitions("path", "block", "n").mapInArrow(_hashed, "file string, file_hash string")


def read_backups(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Like backup.read_backups, for files of any size."""
    return until_error(elements(pieces(spark, path, range_bytes)))
