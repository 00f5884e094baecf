"""Best-two-fit packing of tokenized documents into sequences.

The packing itself works on the histogram of piece lengths, which never has
more than `capacity` entries: a recipe (which lengths share a sequence) is
built once and applied as often as the counts allow. Recipes are few whatever
the number of documents; the rows are dealt to them by their rank among the
pieces of their length."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import load, proof, tokenizer_path
from .common import by_batch, documents_of, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Recipe = tuple[int, list[tuple[int, int]]]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row for each piece: whole documents, or `capacity`-token cuts whose first may be shorter."""
    proved = proof(vocabulary)

    def make():
        table, end = load(vocabulary, proved), array("I", [end_id]).tobytes()

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = table.ids(text or "") + end
                n = len(ids) // 4
                stop = n % capacity or capacity
                start = piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return lambda batch: cut(batch) if batch.num_rows else None

    return by_batch(documents_of(docs), PIECES, make)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Recipe]:
    """Recipes (how many sequences, [(length, times), ...]) that use up the counts.

    A sequence is filled greedily with the longest piece that fits. While
    that leaves a gap, its smallest piece is exchanged for the two unpacked
    pieces that fill the gap and its place most tightly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = [int(x) for x in np.flatnonzero(left)]
    out: list[Recipe] = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            k = bisect_right(lengths, gap)
            while k and used.get(lengths[k - 1], 0) >= left[lengths[k - 1]]:
                k -= 1
            if not k:
                break
            length = lengths[k - 1]
            times = min(gap // length, int(left[length]) - used.get(length, 0))
            used[length] = used.get(length, 0) + times
            gap -= times * length
        while gap:
            small = min(used)
            pair = _two(lengths, left, used, small, gap + small)
            if pair is None:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for x in pair:
                used[x] = used.get(x, 0) + 1
            gap += small - sum(pair)
        m = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= m * n
        out.append((m, sorted(used.items(), reverse=True)))
        lengths = [x for x in lengths if left[x]]
    return out


def _two(lengths: list[int], left: np.ndarray, used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum over `small` and not over `room`."""
    free = [x for x in lengths[: bisect_right(lengths, room)] if left[x] > used.get(x, 0)]
    best, pair = small, None
    i, j = 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[free[i]] - used.get(free[i], 0) > 1):
            best, pair = total, (free[i], free[j])
            if total == room:
                break
        i += 1
    return pair


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A null or empty text is the end token alone. Documents over `capacity`
    tokens are cut from their end, so that only the first piece is shorter.
    Texts of any length are read whole. Repeated rows are packed as often as
    they occur, pieces of equal length in the order of doc_id and piece; an
    empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, vocabulary or tokenizer_path(), capacity, end_id)
    pieces = written(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")))
    by_bucket = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    first = by_bucket.select("bucket", "length", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("rank", within - 1).join(first, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return _dealt(ranked, best_two_fit(counts, capacity))


def _dealt(ranked: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Deals pieces to sequences: by length, a recipe takes a run of ranks."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for m, parts in recipes:
        offset = 0
        for length, times in parts:
            at = taken.get(length, 0)
            runs.setdefault(length, []).append((at, sequence, times, offset))
            taken[length] = at + m * times
            offset += length * times
        sequence += m
    tables = {length: np.array(x, np.int64).T for length, x in runs.items()}

    def make():
        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            sequence_id, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                at, seq, times, off = tables[int(x)]
                k = np.searchsorted(at, rank[own], "right") - 1
                within = rank[own] - at[k]
                sequence_id[own] = seq[k] + within // times[k]
                offset[own] = off[k] + within % times[k] * x
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence_id), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return deal

    return by_batch(ranked, PIECES + ", sequence_id long, offset long", make)
