"""Exact Jaccard self-join on word n-grams, and its connected classes.

Documents are rows and n-grams columns of a sparse 0/1 matrix A; the overlaps
of all pairs are the product of A with its transpose.  Only the part of that
product that can hold a link is computed:

1. Equal rows are one row, a node.
2. Two linked sets share at least t * size n-grams of either.  Each row shows its lowest
   hashes, a few more than it may miss; of these so many must be held by another
   row too (``Bound.shown``, ``Bound.needed``).  Rows that cannot link leave here, and only the
   rest, some fifth of all, has its whole row of A written.
3. Columns are ordered by how many rows hold them, rarest first.  A row offers the
   first size - ceil(t * size) + 1 of its columns, the first
   size - ceil(2 t / (1 + t) * size) + 1 of them as the smaller set of a pair.  A linked pair
   meets in a column that the smaller set offers as the smaller one.
4. Of every column the row with the fewest rarer n-grams is the centre.  Rows are joined with the
   centres that they meet, if sizes and places leave room for the wanted overlap, in
   blocks of one centre times up to ``BLOCK_ROWS`` others.  A block's product is
   accumulated over slices of its columns; pairs below the size-derived bound go.
5. Connected components follow.  Columns whose rows ended in several
   components are cut into runs of about ``RUN_ROWS`` rows of like size, one packed row
   each, and runs are compared by parity sketches: the number of bits
   in which two sketches differ never exceeds the number of n-grams in which the
   sets do, so what it rules out is rightly out.  What is left is multiplied.

The result is exact (but for equal 64-bit hashes of different n-grams).  No
cap applies to any column: frequent ones are cut into runs, and hot ones are
split by adaptive execution, as both sides of each join are read from tables.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; texts with fewer words than n have one n-gram, the whole; repeated
rows are one class; a null doc_id takes part, and its class takes the least
other id; extra columns are ignored, whatever their names; an empty table gives
an empty result.  Ties between columns and centres are broken by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotiles.llm.common import discard, materialize, table, unused
from geotiles.llm.components import components
from geotiles.llm.words import POWERS, hash_words, mix, shingles, slices

#: Rows of a block besides the one they are multiplied with.
BLOCK_ROWS = 63
#: Elements of a block's sets, about, from which it is cut smaller.
BLOCK_ELEMENTS = 1 << 21
#: Rows of a run.
RUN_ROWS = 256
#: Columns whose overlaps are accumulated at once.
COLUMN_SLICE = 1 << 15
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Offers (16 bytes each) that a task holds before it sends them.
HELD_OFFERS = 1 << 22


@dataclass(frozen=True)
class Bound:
    """Jaccard similarity of at least ``num / den``; all in whole numbers, of scalars or arrays."""

    num: int
    den: int

    def overlap(self, n):
        """What a set of ``n`` elements shares at least with any that it links."""
        return -(-self.num * n // self.den)

    def links(self, a, b, overlap):
        return self.den * overlap >= self.num * (a + b - overlap)

    def differ(self, a, b):
        """Elements in which linked sets of these sizes may differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def shown(self, n):
        """Lowest hashes that a set of ``n`` elements shows: all but overlap(n), and 1 + n / 10 more."""
        return np.minimum(n, n - self.overlap(n) + 1 + n // 10)

    def needed(self, n):
        """How many of the hashes that it shows a set shares at least with any that it links.

        Of ``overlap`` common elements, either set hides no more than
        overlap(own size) - 1 - (own size) / 10; the partner has overlap(n) elements at least.
        """
        return 1 + self.overlap(n) // 10

    def offers(self, size: str = "size") -> str:
        """SQL: columns that a row offers."""
        return f"({size} - ceil({self.num}L * {size} / {self.den}) + 1)"

    def offers_as_smaller(self, size: str = "size") -> str:
        """SQL: columns that a row offers as the smaller set of a pair."""
        return f"({size} - ceil({2 * self.num}L * {size} / {self.den + self.num}) + 1)"

    def sketch_bits(self, n):
        """Bits of a set's sketch: a power of two, about 16 times the elements in which it may differ from others."""
        wanted = np.maximum(16 * self.differ(n, n), 256)
        return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: its first row, and rows, shingles, sizes and set hashes of its texts."""
    for a, b in slices(texts):
        hashes, counts = hash_words(texts.slice(a, b - a), POWERS)
        rows, values = shingles(hashes, counts, n)
        sizes = np.bincount(rows, minlength=b - a)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
        ends = np.cumsum(sizes)
        yield a, rows, values, sizes, mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64))


def _texts(documents: DataFrame, column: str = "text") -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))


def classes(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; ``node`` hashes the set and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, sizes, node in _sets(batch.column("text"), n):
                ids = batch.column("doc_id").slice(a, len(sizes))
                yield pa.record_batch([ids, pa.array(sizes.astype(np.int64)), pa.array(node.view(np.int64), mask=sizes == 0)], names=["doc_id", "n_shingles", "node"])

    return _texts(documents).mapInArrow(run, "doc_id long, n_shingles long, node long")


#: Kinds of rows that ``shows`` makes: a hash of one row of the task, one that several rows of it show, and (odd) a row's tally.
_SINGLE, _SHARED = 0, 2


def shows(documents: DataFrame, n: int, bound: Bound) -> DataFrame:
    """(key, node, n): the hashes that rows show, and their tallies.

    A hash that several rows of a task show is sent once, however many they are, as the rows'
    tallies already count it; so a hash that a third of all rows show comes once from each
    task.  A tally is what a row shares within the task less what it needs, twice, and one; its
    key is its own.
    """

    def sent(nodes: list, keys: list, known: list, needs: list) -> Iterator[pa.RecordBatch]:
        known, needs = np.concatenate(known), np.concatenate(needs)
        at, key = np.concatenate(nodes), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        alone = first.copy()
        alone[:-1] &= first[1:]
        tally = np.bincount(at[~alone], minlength=len(known)) - needs
        own = mix(known ^ np.uint64(0x9FB21C651E98DF25))
        key = np.concatenate([key[first], own]).view(np.int64)
        node = np.concatenate([known[at[first]], known]).view(np.int64)
        kind = np.concatenate([np.where(alone[first], _SINGLE, _SHARED), 2 * tally + 1]).astype(np.int32)
        for low in range(0, len(key), 1 << 16):
            k = slice(low, low + (1 << 16))
            yield pa.record_batch([pa.array(key[k]), pa.array(node[k]), pa.array(kind[k])], names=["key", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, nodes, keys, known, needs = 0, [], [], [], []
        for batch in batches:
            for _, rows, values, sizes, node in _sets(batch.column("text"), n):
                fresh = np.zeros(len(sizes), bool)
                for i, x in enumerate(node.tolist()):
                    if sizes[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                place = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
                keep = place < np.where(fresh, bound.shown(sizes), 0)[rows]
                number = np.cumsum(fresh) - 1 + sum(map(len, known))
                nodes.append(number[rows[keep]])
                keys.append(values[keep])
                known.append(node[fresh])
                needs.append(bound.needed(sizes[fresh]))
                held += int(keep.sum())
                if held > HELD_OFFERS:
                    yield from sent(nodes, keys, known, needs)
                    seen.clear()
                    held, nodes, keys, known, needs = 0, [], [], [], []
        if held:
            yield from sent(nodes, keys, known, needs)

    return _texts(documents).mapInArrow(run, "key long, node long, n int")


def may_link(shown: DataFrame) -> DataFrame:
    """(node) of the rows that share as many of the hashes they show as a link needs."""
    per_key = Window.partitionBy("key")
    marked = shown.select("node", "n", (F.min("node").over(per_key) != F.max("node").over(per_key)).alias("met"), F.max(F.col("n") == _SHARED).over(per_key).alias("shared"))
    tally = F.when(F.expr("n & 1 = 1"), F.shiftright("n", 1)).otherwise(F.lit(1))
    counted = marked.where(f"n & 1 = 1 OR n = {_SINGLE} AND (met OR shared)").select("node", tally.cast("long").alias("x"))
    return counted.groupBy("node").agg(F.sum("x").alias("x")).where("x >= 0").select("node")


def _texts_of(documents: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose id is that of one row of each node.

    The ids are broadcast if there are few, and joined by a shuffle otherwise.
    """
    wanted = materialize(nodes.join(ids, "node").select("doc_id").distinct())
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return _texts(documents).alias("d").join(side.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")


def node_sets(documents: DataFrame, ids: DataFrame, nodes: DataFrame, n: int, bound: Bound) -> DataFrame:
    """(node, size, set, sketch) for ``nodes``; bit h of a sketch tells whether the elements of hash h are odd in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, values, sizes, node in _sets(batch.column("text"), n):
                sets = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values.view(np.int64))
                bits = bound.sketch_bits(sizes)
                ends = np.cumsum(bits)
                at = (ends - bits)[rows] + (values & (bits - 1).astype(np.uint64)[rows]).astype(np.int64)
                packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8))
                sketch = pa.array([packed[(b - k) // 8 : b // 8].tobytes() for b, k in zip(ends.tolist(), bits.tolist(), strict=True)], pa.binary())
                yield pa.record_batch([pa.array(node.view(np.int64)), pa.array(sizes.astype(np.int64)), sets, sketch], names=["node", "size", "set", "sketch"])

    # rows of one id may have different texts, and copies of a text the same node
    made = _texts_of(documents, ids, nodes).mapInArrow(run, "node long, size long, set array<long>, sketch binary")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def offers(sets: DataFrame, bound: Bound) -> DataFrame:
    """(gram, node, size, place, smaller): columns that rows offer, of those that two rows or more hold.

    ``place`` counts from 1 in the order of rarity; what only one row holds comes first and is offered by none.
    """
    cells = sets.select("node", "size", F.explode("set").alias("gram"))
    counts = materialize(cells.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"))
    per_node = Window.partitionBy("node")
    ranked = cells.join(counts, "gram").select("gram", "node", "size", F.row_number().over(per_node.orderBy("held", "gram")).alias("k"), F.count("*").over(per_node).alias("known"))
    placed = ranked.select("gram", "node", "size", (F.col("size") - F.col("known") + F.col("k")).alias("place")).where(f"place <= {bound.offers()}")
    out = materialize(placed.withColumn("smaller", F.expr(f"place <= {bound.offers_as_smaller()}")))
    discard(counts)
    return out


def _with_centres(offered: DataFrame, bound: Bound) -> DataFrame:
    """(node, other, size): rows and the centres that they meet and may link."""
    least = offered.where("smaller").groupBy("gram").agg(F.min(F.struct("place", "node", "size")).alias("c"))
    centres = materialize(least.select("gram", F.col("c.node").alias("other"), F.col("c.size").alias("o_size"), F.col("c.place").alias("o_place")))
    room = f"{bound.den + bound.num} * (least(place, o_place) + least(size - place, o_size - o_place)) >= {bound.num} * (size + o_size)"
    return offered.join(centres, "gram").where(f"node <> other AND {room}").select("node", "other", "size").distinct()


def _blocks(pairs: DataFrame) -> DataFrame:
    """(block, node): one centre and up to about ``BLOCK_ROWS`` of its rows, dealt by hash."""
    cut = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_ELEMENTS)).alias("blocks")
    per_node = materialize(pairs.groupBy("other").agg(cut))
    dealt = pairs.join(per_node, "other").select("node", "other", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("k"))
    members = dealt.select(F.xxhash64("other", "k").alias("block"), "node")
    return members.union(dealt.select(F.xxhash64("other", "k").alias("block"), F.col("other").alias("node")).distinct())


def _product(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Overlaps of all pairs of a block's rows, accumulated over slices of its columns."""
    columns, at = np.unique(values, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    used = np.bincount(at, minlength=len(columns))
    shared = used[at] > 1  # a column of one row adds to no pair
    at, rows = at[shared], rows[shared]
    at = np.cumsum(np.append(0, np.diff(at) != 0)) if len(at) else at
    out = np.zeros((count, count), np.float64)
    last = int(at[-1]) + 1 if len(at) else 0
    step = max(1 << 10, COLUMN_SLICE * BLOCK_ROWS // max(count, BLOCK_ROWS))
    for low in range(0, last, step):
        a, b = np.searchsorted(at, [low, low + step])
        dense = np.zeros((count, min(step, last - low)), np.float32)
        dense[rows[a:b], at[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes of their ``set`` columns, and all values."""
    sets = block.column("set").combine_chunks()
    offsets = sets.offsets.to_numpy()
    return block.column("node").to_numpy(), np.diff(offsets), sets.values.to_numpy()[offsets[0] : offsets[-1]]


def _block_links(block: pa.Table, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block's rows, as a forest: no more than its rows less one."""
    nodes, sizes, values = _sides(block)
    overlap = _product(np.repeat(np.arange(len(nodes)), sizes), values, len(nodes))
    i, j = np.triu_indices(len(nodes), 1)
    linked = bound.links(sizes[i], sizes[j], overlap[i, j])
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep.append((x, y))
    pairs = np.array(keep, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def multiply(blocks: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """Links (a, b) inside blocks: rows (block, node) and the nodes' sets (node, set)."""

    def run(block: pa.Table) -> pa.Table:
        a, b = _block_links(block, bound)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return blocks.join(sets.select("node", "set"), "node").groupBy("block").applyInArrow(run, "a long, b long").distinct()


def _run_pairs(rest: DataFrame, bound: Bound) -> tuple[DataFrame, DataFrame]:
    """Runs (run, nodes), and pairs of runs (a, b) in which rows of two components may link.

    Rows of a column are dealt into runs of about ``RUN_ROWS`` by size level and hash; linked
    sets are of one level or of two that follow each other.  Equal runs of
    several columns are one, and so are their pairs.
    """
    step = float(np.log(bound.den / bound.num)) + 1e-6
    sized = rest.withColumn("level", F.floor(F.log("size") / step))
    counts = materialize(sized.groupBy("gram", "level").agg(F.ceil(F.count("*") / RUN_ROWS).alias("runs")))
    dealt = sized.join(counts, ["gram", "level"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("runs")))
    held = dealt.groupBy("gram", "level", "k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("smaller").alias("smaller"), F.sort_array(F.collect_set("node")).alias("nodes"))
    runs = materialize(held.withColumn("run", F.xxhash64("nodes")))
    named = runs.select("gram", "level", "k", "low", "high", "smaller", "run")
    a, b = named.alias("a"), named.alias("b")
    near = F.expr("a.gram = b.gram AND (a.level = b.level AND a.k <= b.k OR a.level + 1 = b.level) AND (a.smaller OR b.smaller)")
    apart = F.expr("a.low <> a.high OR b.low <> b.high OR a.low <> b.low")
    pairs = a.join(b, near).where(apart).select(F.col("a.run").alias("a"), F.col("b.run").alias("b")).distinct()
    return runs.select("run", "nodes").dropDuplicates(["run"]), pairs


def _fold(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` bytes; wider ones are folded, which keeps parities."""
    out = np.empty((len(sketches), width), np.uint8)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _near(a: pa.Table, b: pa.Table, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``a`` and of ``b`` may link one of the other side in another component, as far as sizes and sketches tell."""
    (size, part, sketch), (o_size, o_part, o_sketch) = ((t.column("size").to_numpy(), t.column("component").to_numpy(), t.column("sketch").to_pylist()) for t in (a, b))
    width, o_width = np.array([len(x) for x in sketch]), np.array([len(x) for x in o_sketch])
    keep, o_keep = np.zeros(len(size), bool), np.zeros(len(o_size), bool)
    for i in range(len(size)):
        far = (np.abs(o_size - size[i]) > bound.differ(size[i], o_size)) | (o_part == part[i])
        for w in np.unique(o_width[~far]).tolist():
            at = np.flatnonzero(~far & (o_width == w))
            both = min(w, int(width[i]))  # a pair is compared at the width of its narrower sketch
            apart = np.bitwise_count(_fold([o_sketch[j] for j in at], both) ^ _fold([sketch[i]], both)).sum(axis=1, dtype=np.int64)
            met = at[apart <= bound.differ(size[i], o_size[at])]
            keep[i] |= len(met) > 0
            o_keep[met] = True
    return keep, o_keep


def possible(runs: DataFrame, pairs: DataFrame, known: DataFrame, bound: Bound) -> DataFrame:
    """(block, node): of each pair of runs the rows that may link across components.

    ``known`` has (node, size, component, sketch).
    """
    rows = runs.select("run", F.explode("nodes").alias("node")).join(known, "node")
    packed = materialize(rows.groupBy("run").agg(F.collect_list(F.struct("node", "size", "component", "sketch")).alias("rows")))
    sides = pairs.select(F.xxhash64("a", "b").alias("block"), F.explode(F.array_distinct(F.array("a", "b"))).alias("run"))

    def run(group: pa.Table) -> pa.Table:
        held = [pa.Table.from_struct_array(x.values) for x in group.column("rows").combine_chunks()]
        chosen = []
        if held:
            a, b = held[0], held[-1]
            chosen = [t.column("node").to_numpy()[keep] for t, keep in zip((a, b), _near(a, b, bound), strict=True)]
        node = np.unique(np.concatenate([np.empty(0, np.int64), *chosen]))
        return pa.table({"block": pa.array(np.full(len(node), group.column("block")[0].as_py() if held else 0, np.int64)), "node": pa.array(node)})

    return sides.join(packed, "run").groupBy("block").applyInArrow(run, "block long, node long")


def join_classes(documents: DataFrame, n: int, bound: Bound) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row; see the module's text."""
    rows = materialize(classes(documents, n))
    ids = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    may = materialize(may_link(shows(documents, n, bound)))
    sets = materialize(node_sets(documents, ids, may, n, bound))
    discard(may)
    offered = offers(sets, bound)
    links = materialize(multiply(_blocks(materialize(_with_centres(offered, bound))), sets, bound))
    labels = materialize(components(links))

    # columns that rows of several components offer
    marked = materialize(offered.join(labels, "node", "left").select("gram", "node", "size", "smaller", F.coalesce("component", "node").alias("component")))
    judged = marked.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("smaller").alias("smaller"))
    several = materialize(judged.where("low <> high AND smaller").select("gram"))
    rest = materialize(marked.join(several, "gram", "left_semi"))
    if not rest.isEmpty():
        runs, pairs = _run_pairs(rest, bound)
        known = rest.select("node", "size", "component").distinct().join(sets.select("node", "sketch"), "node")
        blocks = materialize(possible(runs, pairs, known, bound))
        more = materialize(multiply(blocks, sets, bound))
        if not more.isEmpty():
            labels = materialize(components(links.union(more)))
    discard(sets, offered, marked, rest)
    return _named(rows, ids, labels)


def _named(rows: DataFrame, ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the least doc_id of its component; one without a set is alone."""
    marked = ids.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = marked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(marked.join(least, "component").select("node", "component_id"))
    worded = rows.where("node IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", "node", "component_id")
    return worded.union(rows.where("node IS NULL").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents"), 3, Bound(90, 100)).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, n: int, bound: Bound) -> DataFrame:
    """``documents`` with one row of each class: the least doc_id, then the first by a hash of the row.

    Rows without words are in no class and stay.  Null ids come last.  Further
    columns may have any names.
    """
    names = documents.columns
    key, want, digest, rank = unused(names, "id", "node", "digest", "rank")
    judged = join_classes(documents, n, bound)
    # a class keeps the least id; its node is that of the row with it, the least of several
    first = judged.where("node IS NOT NULL").groupBy("component_id").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("w"))
    stay = first.select(F.col("w.doc_id").alias(key), F.col("w.node").alias(want)).union(judged.where("node IS NULL").select("doc_id", "node")).distinct()
    # ids that repeat need a look at the text; all others are settled by the id
    rows = documents.withColumn(digest, F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    joined = rows.join(materialize(stay), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    found = _matching(joined, want, n)
    first = Window.partitionBy("doc_id", want).orderBy(digest)
    worded = found.where(F.col(want).isNotNull()).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return worded.select(*[F.col(f"`{c}`") for c in names]).union(found.where(F.col(want).isNull()).select(*[F.col(f"`{c}`") for c in names]))


def _matching(joined: DataFrame, want: str, n: int) -> DataFrame:
    """Rows whose own node is the one in the column ``want``."""
    schema, at = joined.schema, joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, sizes, node in _sets(batch.column(at.index("text")), n):
                part = batch.slice(a, len(sizes))
                own = pa.array(node.view(np.int64), mask=sizes == 0)
                same = [x == y for x, y in zip(own.to_pylist(), part.column(at.index(want)).to_pylist(), strict=True)]
                yield part.filter(pa.array(same, pa.bool_()))

    return joined.mapInArrow(run, schema)


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM t WHERE len(words) >= 3),
s AS (SELECT DISTINCT rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle FROM g
      UNION ALL SELECT rid, array_to_string(words, ' ') FROM t WHERE len(words) BETWEEN 1 AND 2),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(rid, other) AS (SELECT rid, rid FROM t UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.other)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(u.doc_id) AS component_id
FROM t JOIN r USING (rid) JOIN t u ON u.rid = r.other LEFT JOIN n ON n.rid = t.rid GROUP BY t.rid, t.doc_id
"""
