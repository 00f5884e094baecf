"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units where no piece can cross. The distinct units become a
table: `folded` explodes their substrings of bounded length, joins those by
equality to the piece table, groups the edges by unit and folds each lattice
by higher-order `aggregate`. Unigram models are folded by Viterbi; BPE models,
whose results Viterbi does not give, by merging in order of score.

No occurrence of a unit is shuffled. A task reads its texts once, numbers the
distinct words of a chunk of them and hands on two things: the texts as
numbers, and the chunk's units as sorted lists by hash. The lists meet in the
lattice; their ids go back to the chunk, whose texts are put together there.
Units over `LONGEST` characters, whose lattices would have rows without bound,
are merged where their text is read."""

from __future__ import annotations

import heapq
import pickle
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents_of

SPACE = "▁"
#: The longest unit that is folded in Spark: its places are the bits of a long.
LONGEST = 60
#: Words and distinct words after which a chunk ends, and how many times finer than the session's its partitions are.
CHUNK_WORDS, CHUNK_DISTINCT, FINER = 4_000_000, 300_000, 2
KNOWN_KINDS = {1: "unigram", 2: "bpe"}
FLAG = 1 << 62


@dataclass(frozen=True)
class Model:
    kind: str  # unigram or bpe
    pieces: dict[str, tuple[int, float]]
    bytes: dict[int, int]  # byte -> id
    unknown: int
    longest: int
    newline_alone: bool
    plain: bool  # normalizing only puts SPACE before the text and for its spaces
    joined: frozenset[str]  # pairs of characters that some piece holds side by side
    library: sentencepiece.SentencePieceProcessor


def _fields(data: bytes):
    """(number, value) of a protobuf message; value is an int or the bytes of a field with a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


def model_of(kind: str, pieces: dict[str, tuple[int, float]], raw: dict[int, int], unknown: int, library, plain: bool) -> Model:
    newline_alone = not any("\n" in p for p in pieces)
    joined = frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))
    return Model(kind, pieces, raw, unknown, max(map(len, pieces)), newline_alone, plain and newline_alone, joined, library)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    trainer, normalizer = (next((dict(_fields(v)) for k, v in parts if k == n), {}) for n in (2, 3))
    kind = KNOWN_KINDS.get(trainer.get(3, 1))
    if kind is None or any(dict(_fields(v)).get(3) == 4 for k, v in parts if k == 1):
        raise ValueError("only unigram and BPE models without user-defined pieces have a lattice")
    pieces, raw = {}, {}
    for i in range(library.vocab_size()):
        p = library.id_to_piece(i)
        if library.is_byte(i):
            raw[int(p[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            pieces[p] = (i, library.get_score(i))
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or not normalizer.get(5, 1):
        raise ValueError("a piece goes over the end of a word, or spaces stay as they are")
    plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0
    return model_of(kind, pieces, raw, library.unk_id(), library, plain)


_TOKENS = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_RUNS = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def words(model: Model, text: str) -> list[str]:
    """The pieces of a text before runs of spaces and before line ends, the same for the same string: see normal()."""
    if not text:
        return []
    if not model.plain:
        return (_TOKENS if model.newline_alone else _RUNS).findall(model.library.normalize(text))
    if text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and SPACE not in text:
        return text.replace("\n", " \n").split(" ")
    found = _TOKENS.findall(SPACE + text.replace(" ", SPACE))
    return [w if w[0] == "\n" else w[1:] for w in found]


def normal(model: Model, word: str) -> str:
    """The normalized characters of a word; words of plain models leave out the SPACE before them."""
    return word if not model.plain or word[:1] == "\n" else SPACE + word


class Cutter:
    """Cuts words into units wherever no piece can cross.

    Models without byte fallback join unknown characters, so their words stay whole."""

    def __init__(self, model: Model) -> None:
        self.model = model
        letters = sorted({c for pair in model.joined for c in pair})
        self._kind = np.zeros(0x110000, np.uint16)
        self._kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for pair in model.joined:
            self._joined[self._kind[ord(pair[0])], self._kind[ord(pair[1])]] = True

    def units(self, found: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all words, one after the other, and where each word's begin (and the last one's end)."""
        texts = [normal(self.model, w) for w in found]
        begins = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        cut = np.zeros(len(whole) + 1, bool)
        if self.model.bytes and whole:
            kinds = self._kind[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
            cut[1:-1] = ~self._joined[kinds[:-1], kinds[1:]]
        cut[begins] = True
        places = np.flatnonzero(cut)
        at = places.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:], strict=False)], np.searchsorted(places, begins)


def fold(model: Model, unit: str) -> list[int]:
    """The ids of one unit of any length, in time nearly linear in it."""
    cuts = _merged(model, unit) if model.kind == "bpe" else _viterbi(model, unit)
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        e = model.pieces.get(unit[a:b])
        if e is not None:
            out.append(e[0])
        elif model.bytes:
            out += [model.bytes[c] for c in unit[a:b].encode("utf-8", "replace")]
        elif not out or out[-1] != model.unknown:
            out.append(model.unknown)
    return out


def _merged(model: Model, unit: str) -> list[int]:
    """Cuts after merging neighbours, best score first and leftmost among equals, by a heap over a linked list."""
    n = len(unit)
    after, before, heap = list(range(1, n + 2)), list(range(-1, n)), []

    def offer(a: int) -> None:
        if a >= 0 and after[a] < n:
            b = after[after[a]]
            e = model.pieces.get(unit[a:b]) if b - a <= model.longest else None
            if e is not None:
                heapq.heappush(heap, (-e[1], a, after[a], b))

    for a in range(n):
        offer(a)
    while heap:
        _, a, m, b = heapq.heappop(heap)
        if before[m] == a and after[a] == m and after[m] == b:
            after[a], before[m] = b, -2
            if b <= n:
                before[b] = a
            offer(a)
            offer(before[a])
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(after[cuts[-1]])
    return cuts


def _viterbi(model: Model, unit: str) -> list[int]:
    floor, n = _floor(model), len(unit)
    score, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        for a in range(max(0, b - model.longest), b):
            e = model.pieces.get(unit[a:b])
            s = score[a] + (e[1] if e is not None else floor if b == a + 1 else float("-inf"))
            if s > score[b]:
                score[b], back[b] = s, a
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _floor(model: Model) -> float:
    return min(s for _, s in model.pieces.values()) - 10


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, score, order, at, cut: what the lattice's edges are joined to; its size is that of the vocabulary.

    For BPE, `order` is the rank of the score. A piece whose part ranks after
    it can also become ready late, once that part is there: such parts add a
    row with that part's rank, its place `at` in the piece and the `cut`."""
    ranks = {s: k for k, s in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
    rows = []
    for p, (i, s) in model.pieces.items():
        rows.append((p, i, s, ranks[s], 0, None))
        for k in range(1, len(p)) if model.kind == "bpe" else ():
            parts = [-1 if len(x) == 1 else ranks[model.pieces[x][1]] if x in model.pieces else None for x in (p[:k], p[k:])]
            if None not in parts and max(parts) >= ranks[s]:
                rows.append((p, i, s, max(parts), 0 if parts[0] > parts[1] else k, k))
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int, at int, cut int")


def folded(spark: SparkSession, distinct_units: DataFrame, path: str) -> DataFrame:
    """place, unit, homes, ids of distinct (place, unit) with any homes, all in Spark: explode, equi-join, group and fold.

    Null, empty and overlong units (over LONGEST characters) give no row. Cuts
    are the bits of a long; of an edge, `ends` are the bits of both ends and
    `mid` those of the places between them. Rows that are partitioned by
    place stay where they are."""
    model = load(path)
    table = F.broadcast(piece_table(spark, model))
    some = distinct_units.filter(f"unit <> '' and length(unit) <= {LONGEST}").select("place", "unit", "homes", F.length("unit").alias("len"))
    starts = some.select("*", F.explode(F.expr("sequence(0, len - 1)")).alias("a"))
    spans = starts.select("*", F.explode(F.expr(f"sequence(1, least({model.longest}, len - a))")).alias("width"))
    spans = spans.select("*", F.expr("substr(unit, a + 1, width)").alias("piece"))
    met = spans.join(table, "piece", "left").filter("id is not null or (a = 0 and width = 1)")
    bit = "shiftleft(1L, {})".format
    ends = f"{bit('a')} + {bit('a + width')} + if(cut is null, 0L, {bit('a + cut')})"
    mid = f"{bit('a + width')} - {bit('a + 1')} - if(cut is null, 0L, {bit('a + cut')})"
    key = "(cast(rank as long) * 64 + a + at) * 2 + if(cut is null, 0, 1)"
    fields = f"struct({key} as k, {mid} as mid, {ends} as ends, id)" if model.kind == "bpe" else f"struct(a + width as b, a, score, {mid} as mid, {ends} as ends, id)"
    edge = F.expr(f"case when id is not null then {fields} end").alias("e")
    once = F.when(F.expr("a = 0 and width = 1"), F.col("homes")).alias("homes")
    grouped = met.select("place", "unit", "len", edge, once).groupBy("place", "unit", "len").agg(F.sort_array(F.collect_list("e")).alias("edges"), F.first("homes", True).alias("homes"))
    return _with_ids(_merge_cuts(grouped) if model.kind == "bpe" else _viterbi_cuts(grouped, model), model)


def _merge_cuts(grouped: DataFrame) -> DataFrame:
    """cuts by merging. Edges come in order of rank and place, so one pass merges them; should a
    piece become ready late, which its extra rows tell, every merge looks for the best edge anew."""
    ready = "(c & e.ends) = e.ends and bit_count(c & e.mid) = {}"
    once = f"""aggregate(edges, shiftleft(1L, len + 1) - 1, (c, e) -> case
        when (e.k & 1) = 0 then if({ready.format(1)}, c & ~e.mid, c)
        else if({ready.format(0)}, c | {FLAG}L, c) end)"""
    best = f"get(filter(edges, e -> (e.k & 1) = 0 and {ready.format(1)}), 0).mid"
    anew = f"aggregate(sequence(2, len), shiftleft(1L, len + 1) - 1, (c, i) -> c & ~coalesce({best}, 0L))"
    passed = grouped.withColumn("once", F.expr(once))
    return passed.withColumn("cuts", F.expr(f"case when (once & {FLAG}L) = 0 or len < 2 then once else {anew} end")).withColumn("edges", F.expr("filter(edges, e -> (e.k & 1) = 0)")).drop("once")


def _viterbi_cuts(grouped: DataFrame, model: Model) -> DataFrame:
    """cuts by Viterbi: the best score of every place, then the way back."""
    into = f"transform(sequence(greatest(0, b - {model.longest}), b - 1), a -> struct(best[a].s + coalesce(get(filter(edges, e -> e.a = a and e.b = b), 0).score, if(b = a + 1, {_floor(model)}D, double('-Infinity'))) as s, -a as first, a as a))"
    forward = f"aggregate(sequence(1, len), array(struct(0D as s, 0 as first, 0 as a)), (best, b) -> array_append(best, array_max({into})))"
    back = "aggregate(sequence(1, len), struct(len as at, shiftleft(1L, len) as cuts), (w, k) -> if(w.at = 0, w, struct(best[w.at].a as at, w.cuts | shiftleft(1L, best[w.at].a) as cuts)), w -> w.cuts)"
    return grouped.withColumn("best", F.expr(forward)).withColumn("cuts", F.expr(back)).drop("best")


def _with_ids(folded_units: DataFrame, model: Model) -> DataFrame:
    """place, unit, homes, ids: the edges that the cuts leave, and bytes or the unknown id for characters without a piece."""
    left = folded_units.withColumn("left", F.expr("filter(edges, e -> (cuts & e.ends) = e.ends and (cuts & e.mid) = 0)"))
    own = "transform(array_sort(transform(left, e -> struct(e.ends as ends, e.id as id))), e -> e.id)"
    hexed = "hex(encode(substr(unit, i + 1, 1), 'utf-8'))"
    raw = "array(" + ",".join(str(model.bytes[b]) for b in range(256)) + ")" if model.bytes else ""
    lost = f"transform(sequence(1, length({hexed}), 2), k -> {raw}[cast(conv(substr({hexed}, k, 2), 16, 10) as int)])" if raw else f"array({model.unknown})"
    at = "filter(left, e -> (e.ends & (shiftleft(1L, i + 1) - 1)) = shiftleft(1L, i))"
    mixed = f"flatten(transform(filter(sequence(0, len - 1), i -> (cuts & shiftleft(1L, i)) <> 0), i -> if(size({at}) > 0, transform({at}, e -> e.id), {lost})))"
    if not raw:
        mixed = f"aggregate({mixed}, cast(array() as array<int>), (s, x) -> if(x = {model.unknown} and size(s) > 0 and element_at(s, -1) = x, s, array_append(s, x)))"
    return left.select("place", "unit", "homes", F.expr(f"case when size(left) = bit_count(cuts) - 1 then {own} else {mixed} end").alias("ids"))


def _planes(x: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Numbers below 2^32 by their low, second and high bytes, which compress better apart."""
    return x.astype(np.uint8).tobytes(), (x >> 8).astype(np.uint8).tobytes(), (x >> 16).astype(np.uint16).tobytes()


def _from_planes(planes: tuple[bytes, bytes, bytes]) -> np.ndarray:
    low, second, high = (np.frombuffer(p, t) for p, t in zip(planes, (np.uint8, np.uint8, np.uint16), strict=True))
    return low + (second.astype(np.int64) << 8) + (high.astype(np.int64) << 16)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    """The texts of a chunk as numbers of its distinct words."""

    def __init__(self) -> None:
        self.numbers, self.indexes = _Numbers(), array("I")
        self.rows: list[tuple[int | None, int, int, int]] = []  # doc_id, words, bytes, crc32 of the text

    def add(self, doc_id: int | None, text: str, model: Model) -> None:
        found, raw = words(model, text), text.encode("utf-8", "surrogatepass")
        self.indexes.extend(map(self.numbers.__getitem__, found))
        self.rows.append((doc_id, len(found), len(raw), zlib.crc32(raw)))

    def full(self) -> bool:
        return len(self.indexes) >= CHUNK_WORDS or len(self.numbers) >= CHUNK_DISTINCT

    def handed_on(self, chunk: int, places: list[int], cutter: Cutter) -> pa.RecordBatch:
        """A row for each list of units (at a place of its own), and one for the texts (place chunk).

        A list is one string, in which spaces part the units. Units are
        numbered by first use; overlong ones go with the texts, with their ids."""
        found, self.numbers = list(self.numbers), _Numbers()
        seen, flat, begins = _Numbers(), array("I"), []
        for k in range(0, len(found), 20_000):
            own, at = cutter.units(found[k : k + 20_000])
            begins.append(at[:-1] + len(flat))
            flat.extend(map(seen.__getitem__, own))
        begins = np.concatenate([*begins, [len(flat)]]).astype(np.int64)
        del found
        distinct = sorted(seen)
        of = np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) % len(places) if len(u) <= LONGEST else len(places) for u in distinct], np.int64)
        order = np.argsort(of, kind="stable").tolist()
        ends = np.cumsum(np.bincount(of, minlength=len(places) + 1)).tolist()
        held = {places[k]: [distinct[j] for j in order[a:b]] for k, (a, b) in enumerate(zip([0, *ends], ends[:-1], strict=False)) if a < b}
        long = {seen[distinct[j]]: fold(cutter.model, distinct[j]) for j in order[ends[-2] :]}
        numbers = np.fromiter((seen[u] for units in held.values() for u in units), np.int64, len(distinct) - len(long))
        doc_ids, counts, raw, crcs = zip(*self.rows, strict=True)
        texts = {
            "doc_ids": doc_ids, "counts": np.array(counts), "bytes": np.array(raw), "crcs": np.array(crcs), "lists": [(place, len(units)) for place, units in held.items()], "long": long,
            "begins": _planes(np.diff(begins)), "numbers": _planes(numbers), "units": _planes(_new_ones(np.frombuffer(flat, np.uint32))), "words": _planes(_new_ones(np.frombuffer(self.indexes, np.uint32))),
        }
        packed = zstd.ZstdCompressor(level=3).compress(pickle.dumps(texts, protocol=5))
        rows = [pa.array([*held, chunk], pa.int64()), pa.array([chunk] * (len(held) + 1), pa.int64()), pa.array([*map(" ".join, held.values()), None], pa.string()), pa.array([None] * len(held) + [packed], pa.binary())]
        return pa.RecordBatch.from_arrays(rows, ["place", "home", "units", "texts"])


def _new_ones(x: np.ndarray) -> np.ndarray:
    """Numbers given by first use, with 0 for the first use of each and one more for all others."""
    out = x.astype(np.int64) + 1
    out[np.unique(x, return_index=True)[1]] = 0
    return out


def _old_ones(x: np.ndarray) -> np.ndarray:
    """What _new_ones() was made from."""
    first = x == 0
    out = x - 1
    out[first] = np.arange(first.sum())
    return out


def _chunks(documents: DataFrame, path: str, places: list[int]) -> DataFrame:
    """place, home, units, texts: what the chunks of each task hand on.

    A chunk's number is that of its partition and its place in it, so that a task that is run again hands on the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, chunk, n = Cutter(load(path)), _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, text.as_py() or "", cutter.model)
                if chunk.full():
                    yield chunk.handed_on(n, places, cutter)
                    chunk, n = _Chunk(), n + 1
        if chunk.rows:
            yield chunk.handed_on(n, places, cutter)

    return documents.mapInArrow(run, "place long, home long, units string, texts binary")


def _gathered(begins: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row after row of a ragged table (row k is flat[begins[k]:begins[k + 1]]), and where each begins (and the last ends)."""
    sizes = (begins[1:] - begins[:-1])[rows]
    ends = np.cumsum(sizes)
    at = np.repeat((begins[:-1][rows] - ends + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], np.concatenate([[0], ends])


def _put_together(texts: dict, lists: list[dict]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of a chunk's documents: which, their ids and where each one's begin (and the last one's end)."""
    lists = sorted(lists, key=lambda x: x["place"])
    if [(x["place"], len(x["sizes"])) for x in lists] != sorted(texts["lists"]):
        raise RuntimeError("the lists of units are not those of this chunk; its task gave other rows when it was run again")
    by_place = {x["place"]: x for x in lists}
    lists = [by_place[place] for place, _ in texts["lists"]]
    sizes = np.concatenate([*(x["sizes"] for x in lists), [len(x) for x in texts["long"].values()], []]).astype(np.int64)
    flat = np.concatenate([*(x["flat"] for x in lists), *texts["long"].values(), []]).astype("<u4")
    place_of = np.empty(len(sizes), np.int64)  # where in these a unit's number is
    place_of[np.concatenate([_from_planes(texts["numbers"]), list(texts["long"]), []]).astype(np.int64)] = np.arange(len(sizes))
    unit_begins = np.concatenate([[0], np.cumsum(sizes)])
    flat, begins = _gathered(unit_begins, flat, place_of[_old_ones(_from_planes(texts["units"]))])
    begins = begins[np.concatenate([[0], np.cumsum(_from_planes(texts["begins"]))])]
    indexes, ends = _old_ones(_from_planes(texts["words"])), np.cumsum(texts["counts"])
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + 500_000, "right")))
        ids, word_begins = _gathered(begins, flat, indexes[done : ends[last - 1]])
        yield slice(first, last), ids, word_begins[np.concatenate([[done], ends[first:last]]) - done]
        first = last


def _assembled(documents: DataFrame, path: str, schema: str, finish: Callable[[dict, slice, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """doc_id, n_words and the columns that finish() makes of a chunk's texts, a run of them, their ids and where those begin."""
    spark = documents.sparkSession
    partitions = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.pmod(F.hash("id"), F.lit(partitions))  # the places of lists: one for each partition
    places = [r["id"] for r in spark.range(-32 * partitions, 0).groupBy(held).agg(F.max("id").alias("id")).collect()]
    chunks = _chunks(documents_of(documents), path, sorted(places)).repartition(partitions, "place")

    def only(which: str) -> DataFrame:
        """Rows of chunks. The condition names all columns and isn't pushed down, so that one exchange, and one reading of the texts, serves all."""
        return chunks.filter(F.expr(f"if(spark_partition_id() >= 0, {which}, home is null and units is null and texts is null)"))

    listed = only("place < 0").select("place", "home", F.posexplode_outer(F.split("units", " ")).alias("at", "unit"))
    distinct = listed.groupBy("place", "unit").agg(F.collect_list(F.struct("home", "at")).alias("homes"))
    back = folded(spark, distinct, path).select("place", "ids", F.explode("homes").alias("h")).select("place", "h.home", "h.at", "ids")
    ordered = back.groupBy("place", "home").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("rows"))
    packed = ordered.select("home", F.struct("place", F.expr("transform(rows, r -> cast(size(r.ids) as smallint))").alias("sizes"), F.expr("flatten(transform(rows, r -> r.ids))").alias("flat")).alias("list"))
    lists = packed.withColumnRenamed("home", "place").repartition(partitions, "place").groupBy("place").agg(F.collect_list("list").alias("lists"))
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, found in zip(batch.column(0), batch.column(1), strict=True):
                texts = pickle.loads(zstd.ZstdDecompressor().decompress(packed.as_py()))
                parts = found.values or ()
                lists = [{"place": x["place"].as_py(), "sizes": x["sizes"].values.to_numpy(False), "flat": x["flat"].values.to_numpy(False)} for x in parts]
                for rows, ids, begins in _put_together(texts, lists):
                    own = [pa.array(texts["doc_ids"][rows], pa.int64()), pa.array(texts["counts"][rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own, *finish(texts, rows, ids, begins)], names)

    whole = only("place >= 0").select("place", "texts").join(lists, "place", "left").select("texts", "lists")
    return whole.mapInArrow(run, schema)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, ids (array of int) of every whole text.

    Null and empty texts have no words and no ids; repeated rows give repeated
    results, other columns are ignored, and an empty table gives no rows. Texts
    of any length are read whole. Equal scores merge leftmost first."""

    def finish(texts: dict, rows: slice, ids: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))]

    return _assembled(documents, path, "doc_id long, n_words long, ids array<int>", finish)


@lru_cache(maxsize=2)
def _decoded(path: str) -> pa.Array:
    """The bytes of every id; control and unknown ids have none."""
    model = load(path)
    out = [b""] * model.library.vocab_size()
    for b, i in model.bytes.items():
        out[i] = bytes([b])
    for p, (i, _) in model.pieces.items():
        out[i] = p.replace(SPACE, " ").encode()
    return pa.array(out, pa.large_binary())


def _bytes_of(path: str, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of consecutive runs of ids, by an equi-join of ids to the piece table in Arrow."""
    found = _decoded(path).take(pa.array(ids))
    places = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(found.buffers()[2]) if len(ids) else memoryview(b"")
    at = places[ends].tolist()
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text, ids outside the vocabulary nothing."""

    def make():
        size = load(path).library.vocab_size()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [None if x is None else [i for i in x if i is not None and 0 <= i < size] for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x or ()) for x in rows)])
            flat = np.array([i for x in rows for i in x or ()], np.int64)
            texts = [None if x is None else b.decode("utf-8", "replace").removeprefix(" ") for x, b in zip(rows, _bytes_of(path, flat, ends), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return run

    return by_batch(encoded.select("doc_id", "ids"), "doc_id long, text string", make)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_pieces, ids_crc32, same: encoded and decoded again; `same` if that gives the text back
    (by its length and crc32).

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers.
    Null texts count as empty; repeated rows give repeated results, other
    columns are ignored, and an empty table gives no rows."""

    def finish(texts: dict, rows: slice, ids: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
        back = [b.removeprefix(b" ") for b in _bytes_of(path, ids.astype(np.int64), begins)]
        same = [(len(b), zlib.crc32(b)) == x for b, x in zip(back, zip(texts["bytes"][rows].tolist(), texts["crcs"][rows].tolist(), strict=True), strict=True)]
        raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * begins).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
        return [pa.array(np.diff(begins), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]

    return _assembled(documents, path, "doc_id long, n_words long, n_pieces long, ids_crc32 long, same boolean", finish)
