"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents longer than a sequence are cut into full pieces (the first piece takes the remainder); all pieces are packed
whole. Pieces of equal length are interchangeable, so the problem is its histogram of lengths: at most ``LENGTH`` rows,
whatever the data. The histogram is solved by bin completion: around the largest remaining length all *undominated*
fillings of the rest of a sequence are enumerated (a filling is dominated if another holds at least as much in larger
pieces), and depth-first search takes them in order of waste. A branch is cut when the waste so far admits no better
solution than the incumbent. The first incumbent is best-fit decreasing; a filling is applied to as many sequences at
once as its pieces allow, so the search depends on the distinct lengths and not on the number of pieces. ``NODES`` and
``FILLINGS`` bound the search; when they run out, the incumbent is the answer and stays a full packing.

The answer is a list of patterns with counts. Pieces are numbered within their length without a window over a whole
length: hash buckets are numbered on their own and shifted by the counts of the buckets before them. A number is then
looked up in the broadcast patterns, whose size the number of distinct lengths bounds.

Token ids are those of the byte-level BPE file; the rank form of the same vocabulary is read, which gives the same ids.

Cases: NULL and empty texts have the end token alone; repeated rows are packed once each; a NULL doc_id stays NULL; an
empty table gives no rows; texts longer than any sequence are cut, never shortened; further columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import chunks
from evenkeel.session import pinned

LENGTH = 1024
END = 2
SPECIAL = {"<|endoftext|>": 50256}
NODES = 3_000
FILLINGS = 4
#: Nodes between two best-fit incumbents of what is left.
_STRIDE = 50
BUCKETS = 256

Pattern = tuple[tuple[int, ...], int]


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encoded(text: str, path: str) -> np.ndarray:
    """Token ids of a text; the strings of special tokens have their ids, as in the tokenizer's own file."""
    return _encoding(path).encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids of every piece; ids are unsigned little-endian 32-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                at, piece, start, size, ids = [], [], [], [], []
                for i in range(lo, hi):
                    tokens = np.append(encoded(texts[i], path), end).astype("<u4")
                    first = len(tokens) % length or length
                    bounds = [0, *range(min(first, len(tokens)), len(tokens), length), len(tokens)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        at.append(i)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        ids.append(tokens[a:b].tobytes())
                columns = [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        each, "doc_id long, piece int, start long, length long, ids binary"
    )


def best_fit(counts: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each length goes where the least room that holds it is left."""
    rooms: dict[int, list[list]] = {}  # room -> [contents, sequences]
    full: list[Pattern] = []
    for size in sorted(counts, reverse=True):
        todo = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            groups = rooms.pop(room)
            while groups and todo:
                contents, n = groups.pop()
                each = min(room // size, todo)
                take = min(n, todo // each)
                if take < n:
                    groups.append([contents, n - take])
                rooms.setdefault(room - each * size, []).append([contents + (size,) * each, take])
                todo -= take * each
                if todo and take < n and todo < each:
                    continue
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if not todo:
                break
        each = length // size
        if todo // each:
            rooms.setdefault(length - each * size, []).append([(size,) * each, todo // each])
        if todo % each:
            rooms.setdefault(length - todo % each * size, []).append([(size,) * (todo % each), 1])
    for groups in rooms.values():
        full += [(tuple(c), n) for c, n in groups]
    return full


def lower_bound(counts: dict[int, int], length: int = LENGTH) -> int:
    """Martello and Toth's bound: pieces above ``length - k`` stand alone, those above half share with smaller ones."""
    best = -(-sum(s * n for s, n in counts.items()) // length)
    sizes = sorted(counts)
    for k in [0, *(s for s in sizes if s <= length // 2)]:
        alone = sum(n for s, n in counts.items() if s > length - k)
        large = [(s, n) for s, n in counts.items() if length // 2 < s <= length - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= length // 2)
        room = sum((length - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // length)))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be placed into the pieces of ``a`` as if those were bins (first-fit test)."""
    rooms = list(a)
    for piece in b:
        for i, room in enumerate(rooms):
            if room >= piece:
                rooms[i] -= piece
                break
        else:
            return False
    return True


def fillings(counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first; at most ``most``.

    The one or two largest pieces are enumerated, from large to small, and what room they leave takes the largest piece
    that fits, again and again: any smaller choice of a last piece is dominated by that one. Enumeration ends with
    ``most`` fillings without waste.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    found: set[tuple[int, ...]] = set()
    exact = 0

    def largest(limit: int, used: tuple[int, ...]) -> int | None:
        at = bisect_left(sizes, -limit, key=neg)
        while at < len(sizes) and used.count(sizes[at]) >= counts[sizes[at]]:
            at += 1
        return sizes[at] if at < len(sizes) else None

    def add(used: tuple[int, ...], left: int) -> int:
        while left and (s := largest(left, used)) is not None:
            used, left = (*used, s), left - s
        found.add(used)
        return not left

    for first in sizes:
        exact += add((first,), room - first)
        left = room - first
        at = bisect_left(sizes, -min(first, left), key=neg)
        for second in sizes[at : at + 12]:
            if counts[second] > (second == first):
                exact += add((first, second), left - second)
        if exact >= most or len(found) >= 64 * most:
            break
    ranked = sorted(found, key=lambda f: (room - sum(f), [-s for s in sorted(f, reverse=True)]))
    kept: list[tuple[int, ...]] = []
    for f in ranked:
        f = tuple(sorted(f, reverse=True))
        if f not in kept and not any(_dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept or [()]


def solved(counts: dict[int, int], length: int = LENGTH, nodes: int = NODES) -> list[Pattern]:
    """Patterns (pieces in descending order, sequences) that hold every piece of the histogram."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, length)
    best = best_fit(counts, length)
    best_n = sum(n for _, n in best)
    visited = 0
    # Depth-first: (remaining pieces, patterns so far, sequences so far, waste so far, choices left)
    stack: list[list] = [[counts, [], 0, 0, None]]
    while stack and best_n > bound and visited < nodes:
        left, chosen, used, waste, choices = stack[-1]
        if choices is None:
            visited += 1
            if not left:
                if used < best_n:
                    best, best_n = list(chosen), used
                stack.pop()
                continue
            if visited % _STRIDE == 0:  # best fit of what is left, as an incumbent
                rest = best_fit(left, length)
                if used + sum(n for _, n in rest) < best_n:
                    best, best_n = chosen + rest, used + sum(n for _, n in rest)
            largest = max(left)
            less = dict(left)
            less[largest] -= 1
            choices = stack[-1][4] = [(largest, f) for f in fillings(less, length - largest)]
        if not choices:
            stack.pop()
            continue
        largest, filling = choices.pop(0)
        whole = (largest, *filling)
        lost = length - sum(whole)
        times = min(left[s] // whole.count(s) for s in set(whole))
        # waste that a better solution may have in all
        allowed = (best_n - 1) * length - total
        if waste + lost > allowed:
            continue
        times = min(times, (allowed - waste) // lost) if lost else times
        rest = {s: n - times * whole.count(s) for s, n in left.items()}
        rest = {s: n for s, n in rest.items() if n}
        stack.append([rest, [*chosen, (whole, times)], used + times, waste + times * lost, None])
    return [(tuple(sorted(p, reverse=True)), n) for p, n in best]


@dataclass
class _Slots:
    """For one length: where the numbers of its pieces go."""

    until: np.ndarray  # first number beyond each entry
    begin: np.ndarray
    first_sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray


def _lookup(patterns: list[Pattern]) -> dict[int, _Slots]:
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for contents, n in patterns:
        offset = 0
        for size in dict.fromkeys(contents):
            copies = contents.count(size)
            begin = used.get(size, 0)
            used[size] = begin + copies * n
            rows.setdefault(size, []).append((used[size], begin, sequence, copies, offset))
            offset += copies * size
        sequence += n
    return {size: _Slots(*(np.array(c, np.int64) for c in zip(*r, strict=True))) for size, r in rows.items()}


def numbered(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``number``: 0, 1, ... within each length, by hash bucket, then by doc_id and piece."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # at most `buckets` rows per length
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return (
        dealt.withColumn("inner", F.row_number().over(inner))
        .join(shifts, ["length", "bucket"])
        .withColumn("number", F.col("shift") + F.col("inner") - 1)
        .drop("bucket", "inner", "shift")
    )


def packed(rows: DataFrame, length: int = LENGTH, nodes: int = NODES, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; hand over a written table."""
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(_lookup(solved(histogram, length, nodes)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            numbers = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = slots[size]
                k = np.searchsorted(own.until, numbers[at], side="right")
                turn = numbers[at] - own.begin[k]
                sequence[at] = own.first_sequence[k] + turn // own.copies[k]
                offset[at] = own.offset[k] + turn % own.copies[k] * size
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(rows, buckets).select(*columns, "number").mapInArrow(each, schema)


def placement(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Tokenize once, keep each piece's place and checksum in the shared folder, and pack the pieces."""
    rows = pieces(docs, path, length, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pinned(rows), length)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and ids, from the pieces and their places (rows that agree in all keys pair up)."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = Window.partitionBy(*keys)
    left = pieces_with_ids.withColumn("ids_crc32", F.crc32("ids")).withColumn(
        "turn", F.row_number().over(order.orderBy("ids"))
    )
    right = placed.withColumn("turn", F.row_number().over(order.orderBy("sequence_id", "offset")))
    same = [left[k].eqNullSafe(right[k]) for k in [*keys, "turn"]]
    both = left.join(right, same).select(right["sequence_id"], right["offset"], left["ids"])
    return both.groupBy("sequence_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]), ""
        ).alias("hex")
    ).select("sequence_id", F.unhex("hex").alias("ids"))
