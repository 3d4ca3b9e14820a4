"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into windows of CHUNK code points plus OVERLAP of the next window,
which are pre-tokenised each by itself and then stitched. Two neighbouring windows are
joined at the first place in their overlap where both have a pre-token boundary: the
split pattern never looks back, so from such a place on both split alike. Where an
overlap has none (a run of one kind longer than the overlap), the two windows are
joined and split again from the last certain boundary. The pieces between the joints
are encoded, and their ids follow one another. Decoding concatenates the tokens' bytes.

The windows of a text of up to DEALT code points are worked on where it lies. Those of
a longer one have DEALT code points, are dealt out, pre-tokenised and encoded in
parallel, and then stitched by the same code.

Text that is null counts as empty; it has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP = 1 << 10, 1 << 7
DEALT, DEALT_OVERLAP = 1 << 16, 1 << 12
SLICE_BYTES = 4 << 20
#: A boundary this near to a window's end may move once more text is seen:
#: the longest alternative that a following character can complete has 3.
UNSURE = 4

_OUT = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def codec(path: str):
    """The encoding, its compiled split pattern and each id's decimal text."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, regex.compile(public_tokenizers.PATTERN), {i: str(i) for i in ranks.values()}


def decode(ids: list[int], path: str) -> bytes:
    return codec(path)[0].decode_bytes(ids)


class Window:
    """A piece of a text from `start` on, and the ends of its pre-tokens."""

    def __init__(self, start: int, text: str, last: bool, ends: list[int], ids: list[list[int]] | None = None):
        self.start, self.text, self.last, self.ends, self.ids = start, text, last, ends, ids

    @classmethod
    def split(cls, start: int, text: str, last: bool, path: str) -> Window:
        return cls(start, text, last, [start + m.end() for m in codec(path)[1].finditer(text)])

    def sure(self) -> set[int]:
        stop = self.start + len(self.text) - (0 if self.last else UNSURE)
        return {e for e in [self.start, *self.ends] if e <= stop}

    def each(self, path: str) -> list[list[int]]:
        """The ids of every pre-token."""
        encode = codec(path)[0].encode_ordinary
        return [encode(self.text[a - self.start : b - self.start]) for a, b in zip([self.start, *self.ends], self.ends, strict=False)]

    def encoded(self, a: int, b: int, path: str) -> list[int]:
        """The ids of the text between two boundaries."""
        if self.ids is None:
            return codec(path)[0].encode_ordinary(self.text[a - self.start : b - self.start])
        return [i for end, ids in zip(self.ends, self.ids, strict=True) if a < end <= b for i in ids]


def windows_of(text: str, chunk: int, overlap: int, path: str) -> list[Window]:
    starts = range(0, max(len(text), 1), chunk)
    if len(starts) == 1:
        return [Window(0, text, True, [len(text)])]
    return [Window.split(a, text[a : a + chunk + overlap], a + chunk >= len(text), path) for a in starts]


def stitch(windows: list[Window], path: str) -> list[int]:
    """The ids of the whole text from its windows in order."""
    out: list[int] = []
    at, now = 0, windows[0]
    for after in windows[1:]:
        sure = now.sure()
        meet = next((p for p in [after.start, *after.ends] if p >= at and p in sure), None)
        if meet is None:
            rest = now.text[at - now.start :] + after.text[now.start + len(now.text) - after.start :]
            now = Window.split(at, rest, after.last, path)
            continue
        out += now.encoded(at, meet, path)
        at, now = meet, after
    return out + now.encoded(at, now.start + len(now.text), path)


def _digest(doc_id, ids: list[int], path: str) -> tuple:
    decimal = codec(path)[2]
    return doc_id, len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()


def _rows(rows: list[tuple], ids: list[list[int]] | None) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_OUT)
    out = {name: pa.array(column, kind) for (name, kind), column in zip(_OUT, columns, strict=True)}
    if ids is not None:
        out["token_ids"] = pa.array(ids, pa.list_(pa.int32()))
    return pa.table(out)


def _here(path: str, keep_ids: bool, chunk: int, overlap: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                ids = [stitch(windows_of(t or "", chunk, overlap, path), path) for t in part.column("text").to_pylist()]
                rows = [_digest(d, i, path) for d, i in zip(part.column("doc_id").to_pylist(), ids, strict=True)]
                yield from _rows(rows, ids if keep_ids else None).to_batches()

    return encode


def _windows(path: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Window.split(row["start"], row["text"], row["last"], path)
                ids = w.each(path)
                yield pa.RecordBatch.from_pylist([{**row, "ends": w.ends, "n": [len(i) for i in ids], "ids": [x for i in ids for x in i]}], schema=_WINDOW)

    return encode


_WINDOW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("ends", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))]
)
_WINDOW_DDL = "row long, doc_id long, start long, last boolean, text string, ends array<long>, n array<int>, ids array<int>"


def _stitched(path: str, keep_ids: bool) -> Callable:
    def join(group: pa.Table) -> pa.Table:
        windows = []
        for row in sorted(group.to_pylist(), key=lambda r: r["start"]):
            ids, at = [], 0
            for n in row["n"]:
                ids.append(row["ids"][at : at + n])
                at += n
            windows.append(Window(row["start"], row["text"], row["last"], row["ends"], ids))
        found = stitch(windows, path)
        return _rows([_digest(group["doc_id"][0].as_py(), found, path)], [found] if keep_ids else None)

    return join


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT, dealt_overlap: int = DEALT_OVERLAP) -> DataFrame:
    """Encode docs(doc_id, text) by the ranks at `path`, then decode the ids.

    One row for each row of docs: doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by commas), decoded_sha256 (of the decoded bytes) and, with
    keep_ids, token_ids. Null and empty texts have no ids and the digests of an
    empty string. Repeated rows are encoded each. Other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    path = path or vocabulary_path()
    ddl = _DDL + (", token_ids array<int>" if keep_ids else "")
    rows = docs.select("doc_id", "text")
    size = F.char_length("text")
    short = rows.filter(F.coalesce(size <= dealt, F.lit(True))).mapInArrow(_here(path, keep_ids, chunk, overlap), ddl)
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / dealt).cast("int") - 1))
    windows = (
        rows.filter(size > dealt)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", size.alias("size"))
        .select("row", "doc_id", "text", "size", number.alias("k"))
        .select("row", "doc_id", (F.col("k") * F.lit(dealt).cast("long")).alias("start"), ((F.col("k") + 1) * dealt >= F.col("size")).alias("last"), F.col("text").substr(F.col("k") * dealt + 1, F.lit(dealt + dealt_overlap)).alias("text"))
        .repartition("row", "start")
    )
    long = windows.mapInArrow(_windows(path), _WINDOW_DDL).groupBy("row").applyInArrow(_stitched(path, keep_ids), ddl)
    return short.unionByName(long)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
