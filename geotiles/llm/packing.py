"""Best-fit packing of pieces into sequences of a fixed number of tokens.

Only lengths decide a packing, so the pieces' small rows, not their ids, are
dealt by a hash into shards of about ``SHARD_PIECES`` pieces whatever the
input's size, and every shard is packed by one task in bounded memory.

* ``best_two_fit``: fill a bin greedily with the largest piece that fits, then
  try to replace its smallest piece by two unpacked ones that fit the widened
  gap more tightly.
* ``best_fit_decreasing``: take pieces from the longest on and put each into
  the bin with the least room that holds it; a segment tree over the possible
  rooms finds that bin in log(sequence) steps.

Defined cases: an empty table packs into nothing; null texts are empty ones,
whose end id alone is packed; repeated rows are packed each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import materialize, table
from geotiles.llm.tokens import SEQUENCE, pieces

#: Pieces that one task packs, about.
SHARD_PIECES = 50_000
#: Bytes of text whose ids one task packs and writes, about.
SHARD_BYTES = 8_000_000


class _Lengths:
    """Unpacked pieces by length: which lengths are left, and the pieces of each."""

    def __init__(self, lengths: np.ndarray, room: int) -> None:
        order = np.argsort(lengths, kind="stable")
        self.stacks: list[list[int]] = [[] for _ in range(room + 1)]
        for i, n in zip(order[::-1].tolist(), lengths[order[::-1]].tolist(), strict=True):
            self.stacks[n].append(i)
        self.left = [n for n in range(room + 1) if self.stacks[n]]

    def largest(self, most: int) -> int:
        """The largest length of at most ``most``, or 0."""
        k = bisect_left(self.left, most + 1)
        return self.left[k - 1] if k else 0

    def take(self, n: int) -> int:
        i = self.stacks[n].pop()
        if not self.stacks[n]:
            del self.left[bisect_left(self.left, n)]
        return i

    def put(self, n: int, i: int) -> None:
        if not self.stacks[n]:
            self.left.insert(bisect_left(self.left, n), n)
        self.stacks[n].append(i)

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two lengths whose sum is the largest of at most ``room``, if that exceeds ``more_than``."""
        left, best, found = self.left, more_than, None
        low, high = 0, bisect_left(left, room) - 1
        while low <= high and best < room:
            total = left[low] + left[high]
            if total > room:
                high -= 1
            else:
                if total > best and (low < high or len(self.stacks[left[low]]) > 1):
                    best, found = total, (left[high], left[low])
                low += 1
        return found


def best_two_fit(lengths: np.ndarray, room: int = SEQUENCE) -> list[list[int]]:
    """Bins of positions in ``lengths``; every position is in exactly one."""
    rest, bins = _Lengths(np.asarray(lengths), room), []
    while rest.left:
        members, held, gap = [], [], room
        while n := rest.largest(gap):
            members.append(rest.take(n))
            held.append(n)
            gap -= n
        if gap and len(members) > 1:  # the smallest was the last to come
            small, i = held[-1], members[-1]
            if pair := rest.two(gap + small, small):
                members.pop()
                members += [rest.take(n) for n in pair]
                rest.put(small, i)
        bins.append(members)
    return bins


class CapacityTree:
    """Counts open bins by the room they have left, in a segment tree over 0..room."""

    def __init__(self, room: int) -> None:
        self.size = 1 << room.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        k = self.size + room
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        k = self.size + need
        if self.count[k]:
            return need
        while k > 1:  # climb until a right sibling holds bins, then go down to its leftmost
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, room: int = SEQUENCE) -> list[list[int]]:
    """Bins of positions in ``lengths``, longest pieces first, each into the tightest bin."""
    lengths = np.asarray(lengths)
    tree, bins, by_room = CapacityTree(room), [], [[] for _ in range(room + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.least(n)
        if found is None:
            found, k = room, len(bins)
            bins.append([])
        else:
            k = by_room[found].pop()
            tree.add(found, -1)
        bins[k].append(i)
        if found > n:
            by_room[found - n].append(k)
            tree.add(found - n, 1)
    return bins


def _sequences(shard: pa.Table, method: Callable[[np.ndarray, int], list[list[int]]], sequence: int) -> tuple[pa.Table, np.ndarray, list[list[int]]]:
    """A shard's pieces in a fixed order, their lengths, and the sequences as positions."""
    shard = shard.sort_by([("length", "descending"), ("row", "ascending")])
    lengths = shard.column("length").to_numpy()
    return shard, lengths, method(lengths, sequence)


def pack(cut: DataFrame, method: Callable[[np.ndarray, int], list[list[int]]] = best_two_fit, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give pieces (``doc_id, piece, start, length, ids_crc32, row``) their ``sequence_id`` and ``offset``.

    ``cut`` is read twice, so it should be written down: it is counted first.
    """
    shards = max(1, -(-cut.count() // shard_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(shard: pa.Table) -> pa.Table:
        base = shard.column("shard")[0].as_py() << 32
        shard, lengths, bins = _sequences(shard, method, sequence)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = base + k, at
                at += int(lengths[i])
        return shard.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def matrices(cut: DataFrame, shards: int, method: Callable[[np.ndarray, int], list[list[int]]] = best_fit_decreasing, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """Pack pieces that carry ``ids`` and write one row per sequence: the binary output.

    ``ids`` (``sequence`` numbers, padded), ``cu_seqlens`` (the segments'
    cumulative lengths from 0, 32 bit), ``positions`` (back to 0 at every
    segment and on padding), ``doc_ids`` and ``pieces``.  Numbers are
    little-endian and unsigned; ``ids`` and ``positions`` have 16 bits where
    that holds them, else 32, as ``id_bits`` and ``position_bits`` say.
    """
    place_kind = "<u2" if sequence <= 1 << 16 else "<u4"

    def run(shard: pa.Table) -> pa.Table:
        base = shard.column("shard")[0].as_py() << 32
        shard, lengths, bins = _sequences(shard, method, sequence)
        data, docs, numbers = (shard.column(c).to_pylist() for c in ("ids", "doc_id", "piece"))
        width = len(data[0]) // int(lengths[0])
        kind = f"<u{width}"
        steps = np.arange(sequence, dtype=place_kind)
        out: dict[str, list] = {k: [] for k in ("sequence_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "pieces")}
        for k, members in enumerate(bins):
            used = lengths[members]
            row = np.full(sequence, pad_id, dtype=kind)
            row[: used.sum()] = np.frombuffer(b"".join([data[i] for i in members]), dtype=kind)
            place = np.concatenate([*(steps[:n] for n in used), np.zeros(sequence - used.sum(), place_kind)])
            for name, value in zip(out, (base + k, int(used.sum()), row.tobytes(), np.cumsum([0, *used]).astype("<u4").tobytes(), place.tobytes(), [docs[i] for i in members], [numbers[i] for i in members]), strict=True):
                out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        made = pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
        for name, bits in (("id_bits", 8 * width), ("position_bits", 8 * np.dtype(place_kind).itemsize)):
            made = made.append_column(name, pa.array(np.full(len(made), bits, np.int32)))
        return made

    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    schema = "sequence_id long, n_tokens long, ids binary, cu_seqlens binary, positions binary, doc_ids array<long>, pieces array<int>, id_bits int, position_bits int"
    return keyed.groupBy("shard").applyInArrow(run, schema)


def best_fit_pack(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place, packed best-two-fit."""
    return pack(materialize(pieces(documents, path)), best_two_fit)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def token_output(documents: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed id matrices of all documents, best-fit-decreasing."""
    size = documents.agg(F.sum(F.octet_length("text") + 1)).collect()[0][0] or 1
    return matrices(pieces(documents, path, ids=True), -(-size // shard_bytes))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed sequence: ids, cumulative segment lengths, position resets, doc ids."""
    return token_output(table(spark, sf_dir, "documents"))
