"""MinHash near-duplicate detection by a multi-index Hamming join.

Each distinct shingle set gets a signature of 16-bit MinHash symbols, cut into
chunks. Two signatures that differ in at most `2 * chunks - 1` symbols have,
by the pigeonhole principle, a chunk with at most one error; the allowed
errors of a chunk are enumerated by leaving out one symbol at a time, so such
pairs meet in a bucket. With 18 chunks of 7 symbols a pair of similarity 0.8
misses all buckets with a probability of 2e-7.

What meets in a bucket is compared by its signatures and then, if those are
close enough, by its full sets, without listing pairs: sets are put into
blocks of at most `BLOCK` around the smallest id they met, and pairs of blocks
that share a bucket are compared inside one task, which returns only links
that join two classes. Texts go only to tasks where the signatures left
something to compare. Blocks of a very large neighbourhood are first held
against its centre; sets that link to it need no comparison with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, documents_of, written

CHUNKS, WIDTH, BLOCK = 18, 7, 256
#: Most symbols in which two signatures may differ for their sets to be compared: at similarity 0.8 more differ with a probability of 1e-8.
DISTANCE = 52
SYMBOLS = CHUNKS * WIDTH
_RANDOM = np.random.RandomState(20)
_A, _B = (_RANDOM.randint(0, 2**63, SYMBOLS).astype(np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
_R = _RANDOM.randint(0, 2**63, (CHUNKS, WIDTH)).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 40:
            if len(self) > 200_000:
                self.clear()
            self[word] = h
        return h


def shingle_hashes(text: str | None, words: _Words) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct 2-word shingles (a single word is its own shingle)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array(list(map(words.__getitem__, found)), np.uint64)
    if len(h) == 1:
        return _mixed(h + np.uint64(77))
    return np.unique(_mixed(_mixed(h[:-1]) + (h[1:] << np.uint64(1) | h[1:] >> np.uint64(63))))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (_A[:, None] * shingles[None, k : k + 2048] + _B[:, None]).min(1))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def _signatures(docs: DataFrame) -> DataFrame:
    def make():
        words = _Words()

        def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, low, high, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, words)
                digest = _digest(s)
                n.append(len(s))
                low.append(digest[0])
                high.append(digest[1])
                signs.append(signature(s).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_low", "set_high", "sign"])

        return sign

    return by_batch(docs, "doc_id long, n_shingles long, set_low long, set_high long, sign binary", make)


def _keys(sets: DataFrame) -> DataFrame:
    """key, id: a row for each chunk and left-out symbol."""

    def make():
        salt = _mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64)).reshape(CHUNKS, WIDTH)

        def enumerate_errors(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.asarray(batch.column(0))
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64) * _R
            keys = _mixed(signs.sum(2, dtype=np.uint64)[:, :, None] - signs + salt)
            return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, SYMBOLS))], ["key", "id"])

        return enumerate_errors

    return by_batch(sets.select("id", "sign"), "key long, id long", make)


class Classes(dict):
    """Union-find by smallest member."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def linked(ids: list[int], sets: list[np.ndarray], hubs: list[int | None], percent: int) -> list[tuple[int, int]]:
    """Links by full sets that join two classes; members of one hub are taken as joined."""
    classes, links, first = Classes(), [], {}
    for i, hub in enumerate(hubs):
        if hub is not None:
            classes.join(first.setdefault(hub, i), i)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    starts = np.cumsum(counts) - counts
    for i in range(len(sets)):
        own = inverse[ends[i] - sizes[i] : ends[i]]
        n = counts[own]
        at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posted[at], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * both >= percent * (sizes[:i] + sizes[i] - both)):
            if ids[i] != ids[j] and classes.join(i, int(j)):
                links.append((ids[i], ids[int(j)]))
    return links


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _close(rows: DataFrame) -> DataFrame:
    """task, id, hub of rows (task, id, hub, sign) that some other row of the task, of no common hub, may be linked with by the distance of their signatures."""

    def close(ids: np.ndarray, hubs: list[int | None], signs: np.ndarray) -> np.ndarray:
        found = np.zeros(len(ids), bool)
        hub = np.array([-1 - k if h is None else 0 for k, h in enumerate(hubs)])
        names: dict[int, int] = {}
        for k, h in enumerate(hubs):
            if h is not None:
                hub[k] = names.setdefault(h, len(names))
        for k in range(0, len(ids), 64):
            differ = (signs[k : k + 64, None, :] != signs[None, :, :]).sum(2)
            found[k : k + 64] |= ((differ <= DISTANCE) & (hub[k : k + 64, None] != hub[None, :])).any(1)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, hubs, signs = None, [], [], []

        def table() -> pa.RecordBatch:
            at = np.flatnonzero(close(np.array(ids), hubs, np.frombuffer(b"".join(signs), np.uint16).reshape(-1, SYMBOLS)))
            return pa.RecordBatch.from_arrays([pa.array([task] * len(at), pa.int64()), pa.array([ids[k] for k in at], pa.int64()), pa.array([hubs[k] for k in at], pa.int64())], ["task", "id", "hub"])

        for batch in batches:
            for t, i, hub, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    if len(ids) > 1:
                        yield table()
                    task, ids, hubs, signs = t, [], [], []
                ids.append(i)
                hubs.append(hub)
                signs.append(sign)
        if len(ids) > 1:
            yield table()

    return rows.select("task", "id", "hub", "sign").repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "task long, id long, hub long")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links from rows (task, id, hub, text, set_low), a task's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, ids, sets, hubs, out = _Words(), None, [], [], [], []

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return made

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4)]
            for k, (t, i, hub, set_low) in enumerate(zip(*columns, strict=True)):
                if t != task:
                    if len(ids) > 1:
                        out += linked(ids, sets, hubs, percent)
                    task, ids, sets, hubs = t, [], [], []
                own = shingle_hashes(batch.column(3)[k].as_py(), words)
                if _digest(own)[0] == set_low:  # else another text of the same doc_id
                    ids.append(i)
                    hubs.append(hub)
                    sets.append(own)
            if out:
                yield table()
        if len(ids) > 1:
            out += linked(ids, sets, hubs, percent)
        if out:
            yield table()

    ordered = rows.select("task", "id", "hub", "text", "set_low").repartition("task").sortWithinPartitions("task", "id")
    return ordered.mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    keys = _keys(sets)
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "least")
    met = written(keys.join(shared, "key"))
    centres = met.groupBy("id").agg(F.min("least").alias("centre"))
    counted = centres.join(centres.groupBy("centre").agg(F.count("*").alias("n")), "centre")
    first = written(counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))))

    placed = first
    low = sets.select("id", "set_low")
    found = docs.withColumnRenamed("doc_id", "id").join(placed.select("id"), "id", "left_semi")
    texts = written(found.withColumn("of", F.xxhash64("text")).dropDuplicates(["id", "of"]).drop("of"))  # one row for each different text of a doc_id

    hot = placed.filter(F.col("n") > BLOCK)
    star = None
    if hot.limit(1).count():
        tasks = hot.select(F.xxhash64("centre", "salt").alias("task"), "centre", "id")
        with_centre = tasks.unionByName(tasks.select("task", "centre", F.col("centre").alias("id"))).distinct()
        star = written(_to_centre(with_centre.join(low, "id").join(texts, "id"), percent))
        hub = star.select(F.col("a").alias("id"), F.lit(True).alias("near")).distinct()
        placed = placed.join(hub, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)) | ((F.col("id") == F.col("centre")) & (F.col("n") > BLOCK)))
    else:
        placed = placed.withColumn("near", F.lit(False))
    placed = written(placed.select("id", "centre", "near", F.xxhash64("centre", "near", "salt").alias("block")))

    boxes = met.select("key", "id").join(placed.select("id", "block", F.when(F.col("near"), F.col("centre")).alias("hub")), "id").select("key", "block", "hub").distinct()
    other = boxes.select("key", F.col("block").alias("block_b"), F.col("hub").alias("hub_b"))
    pairs = boxes.join(other, "key").filter("block <= block_b and (hub is null or hub_b is null or hub <> hub_b)").select("block", "block_b").distinct()
    tasks = pairs.select(F.xxhash64("block", "block_b").alias("task"), F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"))
    members = tasks.join(placed, "block").select("task", "id", F.when(F.col("near"), F.col("centre")).alias("hub"))
    close = written(_close(members.join(sets.select("id", "sign"), "id")))
    links = _compared(close.join(low, "id").join(texts, "id"), percent)
    out = written(links if star is None else links.unionByName(star))
    for table in (met, first, texts, placed, close, *([] if star is None else [star])):
        discard(table)
    return out


def _to_centre(rows: DataFrame, percent: int) -> DataFrame:
    """Links to the centre alone: rows (task, centre, id, text, set_low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, middle = _Words(), None, None
        for batch in batches:
            a, b = [], []
            for k, (t, centre, i, set_low) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 5)), strict=True)):
                own = shingle_hashes(batch.column(4)[k].as_py(), words)
                if _digest(own)[0] != set_low:  # another text of the same doc_id
                    continue
                if t != task:
                    task, middle = t, own  # the centre sorts first
                else:
                    both = len(np.intersect1d(own, middle, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(middle) - both):
                        a.append(i)
                        b.append(centre)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    first = (F.col("id") != F.col("centre")).alias("member")
    ordered = rows.select("task", "centre", "id", first, "text", "set_low").repartition("task").sortWithinPartitions("task", "member", "id")
    return ordered.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component_id (the smallest id reachable) of every id in links (a, b): least labels of neighbours, then pointer jumping."""
    edges = written(links.union(links.select("b", "a")).toDF("id", "to").distinct())
    table = written(edges.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:
        labels = table.select("id", "label")
        near = edges.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        new = written(step.join(above, "label").select("id", "old", F.least("label", "above").alias("label")))
        discard(table)
        table = new
        if not new.filter("old <> label").limit(1).count():
            discard(edges)
            out = written(new.select("id", F.col("label").alias("component_id")))
            discard(new)
            return out


def near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null or empty texts and texts without words have no shingles, are linked
    with nothing and are kept. Texts of any length count whole. Shingles are
    told apart by 64-bit hashes, sets by 128 bits: a link could only be wrong
    if two of a pair's shingles collide, for texts of n shingles with a chance
    below n^2 / 2^63. Equal rows get equal results; rows that share a doc_id
    count as one document, which has the links of that one of its texts whose
    set has the least digest (each row keeps its own n_shingles). Rows without
    a doc_id get the class of their set. Other columns are ignored, and an
    empty table gives no rows."""
    docs = documents_of(documents)
    signed = written(_signatures(docs))
    known = signed.filter("doc_id is not null and n_shingles > 0")
    own = known.groupBy("doc_id").agg(F.min(F.struct("set_low", "set_high")).alias("own"))
    signs = known.groupBy("set_low", "set_high").agg(F.first("sign").alias("sign"))  # equal sets have equal signatures
    least = own.groupBy(F.col("own.set_low").alias("set_low"), F.col("own.set_high").alias("set_high")).agg(F.min("doc_id").alias("id"))
    sets = written(least.join(signs, ["set_low", "set_high"]))
    links = _links(docs.filter("doc_id is not null"), sets, percent)
    found = components(links)
    discard(links)
    owners = sets.select("set_low", "set_high", "id").join(found, "id", "left").select("set_low", "set_high", F.coalesce("component_id", "id").alias("component_id"))
    of = signed.select("doc_id", "n_shingles", "set_low", "set_high").join(own, "doc_id", "left")
    of = of.select("doc_id", "n_shingles", F.coalesce("own.set_low", "set_low").alias("set_low"), F.coalesce("own.set_high", "set_high").alias("set_high"))
    out = of.join(owners, ["set_low", "set_high"], "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    for table in (signed, sets, found):
        discard(table)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
