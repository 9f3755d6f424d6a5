"""Document fingerprints from closed syncmers.

Of all substrings of ``K`` code points those are anchors whose smallest inner substring of ``S`` code points (by hash)
lies at the left or right edge. Whether a substring is an anchor depends on itself alone, so an edit moves no anchors
beyond its reach. A fingerprint holds all anchors of the whole text as (hash, position) and is written as text,
``n_chars:`` and in base64 one bit for each code point (does an anchor begin there?), then the 64-bit hashes in order of
position. About 2/7 of the code points begin an anchor, so a written fingerprint has some 3 bytes for each of them.

Two fingerprints are compared by position: the n-th place of an anchor in one text meets the n-th place of the same
anchor in the other, counted from the beginning and from the end. The likeness is the share of anchors (Dice) on the
longest chain of such meetings that goes forward in both texts, so an insertion costs the anchors that it touches. Of an
anchor that is inserted at several places between its other occurrences, those between the first and the last place may
miss their partner.

The successor of a document (by doc_id, then text) may lie in another partition: documents are dealt to ranges of
doc_id, and the first document of each range is also given to the range before. Ranges come from quantiles of doc_id, so
one shuffle moves the texts, and no range grows with the table beyond its share. Tasks pack the texts that they have for
a range and compress them, so the shuffle is smaller than the texts however finely they are dealt; Spark sorts them
after it.

Cases: NULL text is an empty text; a text shorter than ``K`` has one anchor, its whole; an empty text has none; two
fingerprints without anchors are alike (1.0), one without and one with are not (0.0). NULL doc_ids sort first; repeated
rows follow each other; of a table with one row the row itself is the next; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import chunks

K = 10
S = 4
#: Rows that one range of doc_id should hold.
RANGE_ROWS = 4_000
#: Bytes of texts that a task holds to pack them by range, and that it unpacks together.
PACKED_BYTES = 1 << 25
UNPACKED_BYTES = 1 << 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_NULL_ID = -(1 << 63)

Print = tuple[int, np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolled(points: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each substring of ``width`` points, by doubling."""
    power, done, total = _MULTIPLIER, 1, points
    out, out_width = None, 0
    while True:
        if width & done:
            if out is None:
                out, out_width = total, done
            else:
                n = len(points) - out_width - done + 1
                out = out[:n] * power + total[out_width : out_width + n]
                out_width += done
        if out_width == width:
            return out
        n = len(total) - done
        total = total[:n] * power + total[done : done + n]
        power = power * power
        done *= 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of one text, in order of position."""
    found = _all_anchors([text], k, s)
    return found[0]


def _all_anchors(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = [none] * len(texts)
    begins = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        if len(points) >= k:
            inner = _mixed(_rolled(points, s))
            least = _sliding_min(inner, k - s + 1)
            n = len(points) - k + 1
            chosen = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
            # no anchor spans two texts
            owner = np.searchsorted(begins, chosen, side="right") - 1
            inside = chosen + k <= begins[owner] + lengths[owner]
            chosen, owner = chosen[inside], owner[inside]
            hashes = _mixed(_rolled(points, k))[chosen]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[i], cuts[i + 1])
                out[i] = (hashes[own], chosen[own] - begins[i])
        for i in np.flatnonzero((lengths > 0) & (lengths < k)).tolist():
            own = points[begins[i] : begins[i] + lengths[i]]
            out[i] = (_mixed(_rolled(own, len(own)) + np.uint64(len(own))), np.zeros(1, np.int64))
    return out


def prints(texts: list[str], k: int = K, s: int = S) -> list[Print]:
    """Fingerprints as (number of code points, hashes ascending, positions); equal hashes are in order of position."""
    out: list[Print] = []
    for lo, hi in chunks(texts, 1 << 19):
        for text, (hashes, places) in zip(texts[lo:hi], _all_anchors(texts[lo:hi], k, s), strict=True):
            order = np.argsort(hashes, kind="stable")
            out.append((len(text), hashes[order], places[order]))
    return out


def written(one: Print) -> str:
    n, hashes, places = one
    begins, by_place = np.zeros(n, bool), np.zeros(n, "<u8")
    begins[places], by_place[places] = True, hashes
    return f"{n}:" + base64.b64encode(np.packbits(begins).tobytes() + by_place[begins].tobytes()).decode()


def read(text: str) -> Print:
    number, _, rest = text.partition(":")
    n, data = int(number), base64.b64decode(rest)
    bits = -(-n // 8)
    places = np.flatnonzero(np.unpackbits(np.frombuffer(data[:bits], np.uint8), count=n))
    hashes = np.frombuffer(data[bits:], "<u8").astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    return n, hashes[order], places[order]


def _matches(a: Print, b: Print) -> np.ndarray:
    """Positions in the second text of the anchors that meet, by position in the first, the latest first."""
    (_, ha, pa_), (_, hb, pb) = a, b
    at = np.arange(len(ha))
    low, high = np.searchsorted(hb, ha), np.searchsorted(hb, ha, "right")
    fore = low + at - np.searchsorted(ha, ha)
    back = high + at - np.searchsorted(ha, ha, "right")
    ahead, behind = fore < high, (back >= low) & (back != fore)
    here = np.concatenate([pa_[ahead], pa_[behind]])
    there = np.concatenate([pb[fore[ahead]], pb[back[behind]]])
    return there[np.lexsort((-there, here))]


def _chain(values: list[int]) -> int:
    """Length of the longest strictly increasing run, gaps allowed."""
    ends: list[int] = []  # the smallest end of a run of each length
    last = -1
    for x in values:
        if x > last:
            ends.append(x)
        else:
            ends[bisect_left(ends, x)] = x
        last = ends[-1]
    return len(ends)


def likeness(a: Print, b: Print) -> float:
    """Share of anchors on the longest common chain, 0 to 1."""
    total = len(a[1]) + len(b[1])
    if not len(a[1]) or not len(b[1]):
        return float(not total)
    return 2 * _chain(_matches(a, b).tolist()) / total


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _bounds(docs: DataFrame, range_rows: int) -> list[int]:
    """Values of doc_id that begin a range; their number follows the rows and is at most 100,000."""
    ids = docs.select("doc_id").where("doc_id is not null")
    rows = ids.count()
    ranges = min(100_000, rows // range_rows + 1)
    if ranges < 2:
        return []
    cuts = [i / ranges for i in range(1, ranges)]
    got = ids.agg(F.percentile_approx("doc_id", cuts, min(10 * ranges + 1_000, 1_000_000)).alias("q")).first()["q"]
    return sorted(set(got))


_ROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lent", pa.int32())])
_DEALT = "doc_id long, text string, lent int, range int"
_PACKED = "range int, size int, data binary"
_CODEC = "zstd"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of about ``PACKED_BYTES``; a larger batch makes a table of its own."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if some and size + batch.nbytes > PACKED_BYTES:
            yield pa.Table.from_batches(some)
            some, size = [], 0
        some.append(batch)
        size += batch.nbytes
    if some:
        yield pa.Table.from_batches(some)


def _packed(table: pa.Table, which: np.ndarray, to: np.ndarray, n_own: int) -> pa.RecordBatch:
    """Rows ``which`` of a table, the first ``n_own`` of them not lent, as one compressed row for each range in ``to``."""
    order = np.argsort(to, kind="stable")
    to, sorted_rows = to[order], table.take(pa.array(which[order]))
    columns = [sorted_rows.column("doc_id"), sorted_rows.column("text"), pa.array((order >= n_own).astype(np.int32))]
    whole = pa.table([c.cast(kind) for c, kind in zip(columns, _ROW.types, strict=True)], schema=_ROW).combine_chunks()
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
    ranges, sizes, data = [], [], []
    for start, end in zip(starts, [*starts[1:], len(to)], strict=True):
        for batch in whole.slice(start, end - start).to_batches():
            plain = batch.serialize()
            ranges.append(int(to[start]))
            sizes.append(plain.size)
            data.append(pa.compress(plain, _CODEC, asbytes=True))
    columns = [pa.array(ranges, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "size", "data"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for number, size, data in zip(*(batch.column(c) for c in ("range", "size", "data")), strict=True):
            rows = pa.ipc.read_record_batch(pa.decompress(data.as_buffer(), size.as_py(), _CODEC), _ROW)
            some.append(rows.append_column("range", pa.repeat(number, rows.num_rows)))
            held += size.as_py()
            if held > UNPACKED_BYTES:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, held = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compared(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every text with its fingerprint, that of its edited form, and both likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(_bounds(rows, range_rows), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    # Long's smallest value stands for NULL, so range 0 holds NULLs and ids below the first bound.
    low = F.coalesce("doc_id", F.lit(_NULL_ID))
    firsts = rows.select(low.alias("low")).withColumn("range", range_of("low")).groupBy("range").agg(F.min("low").alias("low"))
    # one row per range: at most 100,001
    begin = {r["range"]: r["low"] for r in firsts.collect()}
    used = sorted(begin)
    lowest, before = np.zeros((2, len(bounds) + 1), np.int64)
    lowest[used] = [begin[k] for k in used]
    before[used] = used[-1:] + used[:-1]  # the last range precedes the first

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows go to the range of their id and, with the first id of a range, to the range before it as well."""
        for table in _gathered(batches):
            ids = table.column("doc_id").fill_null(_NULL_ID).to_numpy()
            held = np.searchsorted(bounds, ids, side="right")
            lent = np.flatnonzero(lowest[held] == ids)
            which, to = np.concatenate([np.arange(len(ids)), lent]), np.concatenate([held, before[held[lent]]])
            yield _packed(table, which, to, len(ids))

    # Each range has a partition of its own, where hashes of range numbers would bring some together.
    packed = rows.mapInArrow(dealt, _PACKED).repartitionById(len(bounds) + 1, F.col("range"))
    ordered = packed.mapInArrow(_unpacked, _DEALT).sortWithinPartitions("range", "lent", "doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (range, doc_id, text, print) whose next row has not come yet
        rows_out: list[tuple] = []
        size = 0

        def done(row: tuple, following: tuple) -> tuple[int, str, str, Print, Print]:
            return (row[1], row[2], edited(row[2], following[2]), row[3], following[3])

        def flush(some: list[tuple]) -> pa.RecordBatch:
            changed = prints([r[2] for r in some])
            columns = [
                pa.array([r[0] for r in some], pa.int64()),
                pa.array([len(r[1]) for r in some], pa.int64()),
                pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in some]),
                pa.array([written(r[3]) for r in some]),
                pa.array([written(c) for c in changed]),
                pa.array([likeness(r[3], c) for r, c in zip(some, changed, strict=True)], pa.float64()),
                pa.array([likeness(r[3], r[4]) for r in some], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCHEMA.split(", ")])

        over = False  # the lent row has closed the range
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = (one for lo, hi in chunks(texts, 1 << 19) for one in prints(texts[lo:hi]))
            ids, ranges = batch.column("doc_id").to_pylist(), batch.column("range").to_pylist()
            for doc_id, text, held_in, is_lent, mark in zip(
                ids, texts, ranges, batch.column("lent").to_pylist(), own, strict=True
            ):
                row = (held_in, doc_id, text, mark)
                if waiting is not None and waiting[0] == held_in and not over:
                    rows_out.append(done(waiting, row))
                    size += len(waiting[2])
                over = bool(is_lent) and (waiting is None or waiting[0] == held_in)
                waiting = row
                if size > 1 << 20:
                    yield flush(rows_out)
                    rows_out, size = [], 0
        if rows_out:
            yield flush(rows_out)

    return ordered.select("doc_id", "text", "range", "lent").mapInArrow(each, _SCHEMA)
