"""SimHash near-duplicates, joined on deletion-variant signatures.

A fingerprint has 64 bits; bit b is 1 if more than half of a text's shingle hashes have it. Two fingerprints link when
at most ``BITS`` (3) bits differ. Cut into two halves of 32 bits, one half of such a pair differs in at most one bit,
so both share one of the 32 *one-wildcard variants* of that half (the half with one bit blanked out). Every distinct
fingerprint is indexed by its 64 variants; rows with equal variants are brought together and verified.

Texts with equal fingerprints are folded to one before indexing, so copies cost nothing. Among fingerprints with the
same variant only a spanning forest of the verified links is put out, never all pairs: enough for the components, and
linear in the rows. A variant with more than ``MOST_IN_RUN`` fingerprints is not cut off: its rows are indexed once more
by the one-wildcard variants of the quarters of the *other* half (which differs in at most 3 bits, so one quarter
differs in at most one). Such a second-level group has 18 free bits, that is at most 2**18 fingerprints whatever the
data, and is compared block by block.

Components come from ``components.py``. What cuts lineage is written to the shared folder of the cluster.

Cases: NULL and empty texts have no words and the fingerprint 0, which links like any other; a text with fewer words
than a shingle is one shingle; repeated rows stay, each with the result of its text; a NULL doc_id is no candidate for
the smallest id of a component (NULL if there is no other); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.llm.common import chunks
from evenkeel.llm.components import components
from evenkeel.session import pinned

SHINGLE = 3
BITS = 3
SEED = 42
MOST_IN_RUN = 4_096
_BLOCK = 2_048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return int(fingerprints([text], shingle, seed)[0])


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        # bytes.lower folds A-Z alone, bytes.split cuts at ASCII white space alone
        words = (text or "").encode().lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(digest(b" ".join(words), seed))
            counts[i] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        stops = ends[shingle - 1 :]
        starts = np.append(0, ends[: len(stops) - 1] + 1)
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        counts[i] = len(stops)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    values = np.array(hashes, np.uint64)
    full = np.flatnonzero(counts)
    begins = np.append(0, np.cumsum(counts[full])[:-1])
    for bit in range(64):
        ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begins)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and simhash (the 64 bits as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [fingerprints(texts[lo:hi], shingle) for lo, hi in chunks([t or "" for t in texts])]
            bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "simhash"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, simhash long")


def _half(bits: Column, upper: int) -> Column:
    return F.shiftrightunsigned(bits, 32) if upper else bits.bitwiseAND(F.lit(0xFFFFFFFF))


def variants(bits: Column) -> Column:
    """The 64 one-wildcard variants: (half, blanked bit, rest of the half) in one long each."""
    out = []
    for upper in (0, 1):
        half = _half(bits, upper)
        for bit in range(32):
            tag = (upper * 32 + bit) << 32
            out.append(half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit(tag)))
    return F.array(*out)


def _second(bits: Column, signature: Column) -> Column:
    """Variants of the quarters of the half that the signature does not cover: (quarter, blanked bit, rest)."""
    covered = F.shiftrightunsigned(signature, 37)  # 1 if the signature is of the upper half
    other = F.when(covered == 1, _half(bits, 0)).otherwise(_half(bits, 1))
    out = []
    for quarter in (0, 1):
        part = F.shiftrightunsigned(other, 16 * quarter).bitwiseAND(F.lit(0xFFFF))
        for bit in range(16):
            tag = (quarter * 16 + bit) << 16
            out.append(part.bitwiseAND(F.lit(0xFFFF ^ (1 << bit))).bitwiseOR(F.lit(tag)))
    return F.array(*out)


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    # of a negative number numpy counts the bits of its absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def forest(values: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest (as index pairs) of the links among ``values``, compared block by block.

    Values already known to be connected to everything in reach are not compared again: a breadth-first search takes
    each value once from the unreached ones, so the work is (values x unreached values) at most.
    """
    out: list[tuple[int, int]] = []
    unreached = np.arange(len(values))
    while len(unreached):
        queue, unreached = [int(unreached[0])], unreached[1:]
        while queue and len(unreached):
            at = queue.pop()
            for lo in range(0, len(unreached), _BLOCK * _BLOCK):
                part = unreached[lo : lo + _BLOCK * _BLOCK]
                near = part[_linked(values[part], values[at], bits)]
                if len(near):
                    out += [(at, int(x)) for x in near]
                    queue += near.tolist()
            if queue:
                reached = np.zeros(len(values), bool)
                reached[queue] = True
                unreached = unreached[~reached[unreached]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int, bits: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal keys of sorted rows; with a limit, rows of longer runs come out as they are.

    Output columns: the keys (of rows of longer runs, else NULL), a, b (b NULL for such rows).
    """

    def emit(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b)], ["signature", "a", "b"]
        )

    def solved(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        heads = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(heads, key.shape[1]))
        left, right = [], []
        size_of = np.repeat(sizes, sizes)
        run_of = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero((size_of > 1) & (size_of <= 8))
        for gap in range(1, 8):  # short runs all at once
            a = small[small + gap < key.shape[1]]
            b = a + gap
            a, b = a[run_of[a] == run_of[b]], b[run_of[a] == run_of[b]]
            ok = _linked(fp[a], fp[b], bits)
            left.append(fp[a[ok]])
            right.append(fp[b[ok]])
        for head, size in zip(heads[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            own = fp[head : head + size]
            if limit is not None and size > limit:
                yield emit(own, None, np.repeat(key[0, head], size))
            elif pairs := forest(own.view(np.uint64), bits):
                at = np.array(pairs)
                left.append(own[at[:, 0]])
                right.append(own[at[:, 1]])
        if sum(map(len, left)):
            yield emit(np.concatenate(left), np.concatenate(right), None)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 1)]
        held.append((np.stack(columns[:keys]), columns[keys]))
        waiting += len(columns[keys])
        if waiting < 1 << 18:
            continue
        key = np.concatenate([k for k, _ in held], axis=1)
        fp = np.concatenate([f for _, f in held])
        last = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from solved(key[:, :cut], fp[:cut])
            key, fp = key[:, cut:], fp[cut:]
        elif limit is not None and len(fp) > limit + 1:
            # One run, longer than the limit already: pass its rows on, but for enough to know the run as long.
            yield emit(fp[: -limit - 1], None, key[0, : -limit - 1])
            key, fp = key[:, -limit - 1 :], fp[-limit - 1 :]
        held, waiting = [(key, fp)], len(fp)
    if waiting:
        key = np.concatenate([k for k, _ in held], axis=1)
        fp = np.concatenate([f for _, f in held])
        yield from solved(key, fp)


def _brought(rows: DataFrame, keys: list[str], bits: int, limit: int | None) -> DataFrame:
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "simhash")
    return ordered.select(*keys, "simhash").mapInArrow(
        lambda batches: _runs(batches, len(keys), bits, limit), "signature long, a long, b long"
    )


def links(prints: DataFrame, bits: int = BITS, most_in_run: int = MOST_IN_RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints: verified, and enough to connect all that are within ``bits``."""
    if bits > 3:
        raise ValueError("two segments with one wildcard find pairs of at most 3 differing bits")
    distinct = prints.select("simhash").distinct()
    rows = distinct.select("simhash", F.explode(variants(F.col("simhash"))).alias("signature"))
    found = pinned(_brought(rows, ["signature"], bits, most_in_run))
    crowded = found.where("b is null").select(F.col("a").alias("simhash"), "signature")
    again = crowded.select("simhash", "signature", F.explode(_second(F.col("simhash"), F.col("signature"))).alias("inner"))
    more = _brought(again, ["signature", "inner"], bits, None)
    return found.where("b is not null").select("a", "b").unionByName(more.select("a", "b")).distinct()


def near_duplicates(prints: DataFrame, bits: int = BITS, most_in_run: int = MOST_IN_RUN) -> DataFrame:
    """doc_id, simhash and component_id (smallest doc_id within reach over links) and root of every row of ``prints``.

    ``prints`` has doc_id and simhash; it is read several times, so hand over a written table.
    """
    labelled = components(links(prints, bits, most_in_run))
    smallest = prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    grouped = smallest.join(labelled.withColumnRenamed("node", "simhash"), "simhash", "left").select(
        "simhash", "doc_id", F.coalesce("root", "simhash").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = grouped.select("simhash", "root").join(least, "root")
    return prints.select("doc_id", "simhash").join(whole, "simhash").select("doc_id", "simhash", "component_id", "root")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, of one document per group: the one with the smallest doc_id.

    Rows that share a group and a doc_id leave one row as well.
    """

    mark = "_simhash"
    while mark.lower() in map(str.lower, docs.columns):
        mark += "_"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [fingerprints(texts[lo:hi], shingle) for lo, hi in chunks([t or "" for t in texts])]
            bits_of = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield batch.append_column(mark, pa.array(bits_of.view(np.int64)))

    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
    marked = pinned(docs.mapInArrow(each, schema))
    prints = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("simhash"))
    groups = near_duplicates(prints, bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = groups.groupBy("root").agg(F.min(F.struct("doc_id", "simhash")).alias("one")).select("one.*")
    same = [marked["doc_id"].eqNullSafe(chosen["doc_id"]), marked[mark] == chosen["simhash"]]
    rows = marked.join(chosen, same, "left_semi")
    repeated = prints.groupBy("doc_id", "simhash").count().where("count > 1")
    if not repeated.isEmpty():  # only then are texts moved once more
        rows = rows.dropDuplicates(["doc_id", mark])
    return rows.drop(mark)


def hexed(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
