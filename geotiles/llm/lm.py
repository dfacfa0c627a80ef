"""Smoothed bigram model as a weighted backoff automaton, learned and applied at any size.

The automaton has a state for every word of the training texts, one for the
start of a text, and a root.  A state's arcs are the bigrams seen ``min_count``
times or more, in the registered query all of them, with the discounted
probability plus the share of the lower order; its failure arc leads to the root
and weighs what the discounts and any rarer bigrams left over, so every state's
probabilities sum to one.  The root
has an arc for every word: the add-half unigram.  Scoring reads a text once from
left to right, carries the state, and takes the failure arc where a word has no
arc.

Neither the vocabulary nor the arcs are ever in one place:

1. Every task writes its texts as blocks of word numbers, with the block's
   sorted words and bigrams and their training counts.
2. Blocks send their bigrams, packed as bytes, to hash ranges; each range adds
   the counts up and answers every block with the counts, in the order asked.
   It also sends each state's kept mass to the words' ranges.
3. The same for words, whose ranges answer with counts and kept masses.
4. Each block gets its answers and runs the automaton's part it needs.

Every bigram that a task asks for travels once, with a count for the whole
block, so frequent ones weigh no more than rare ones: a range gets at most one
entry a block for each.  Counts cover all training texts.

Words are told apart by 64-bit hashes, bigrams by 96 bits.

Defined cases: a null text is empty, and its only token is the end; repeated
rows are scored each and count each in training; without training texts N and V
are 0 and every token has probability one in the base model; extra columns are
ignored.  A text whose words a block cannot hold beside others has its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import materialize, table
from geotiles.llm.words import POWERS, hash_words, mix, slices

#: Bigrams seen less often back off where a caller does not say; the registered query keeps them all.
MIN_COUNT = 2
DISCOUNT = 0.75
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Tokens whose bigrams one hash range handles, about.
RANGE_TOKENS = 1_500_000
#: Tasks of a step at most; beyond that a task handles several ranges or blocks, one after the other.
MOST_TASKS = 100_000
#: Hashes of the end and of the start of a text, which no word has by more than chance.
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number: most counts are small."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype=kind)


#: Bits of a hash that travel with a bigram: 48 of the state and 48 of the word.
MASK = np.uint64((1 << 48) - 1)


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each hash."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 1 (null: the id is an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def encoded(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: (block, doc_ids, held_out, lengths, words, codes, n, tokens).

    ``words`` are the sorted distinct word hashes of the block with the end,
    ``codes`` the texts' tokens as places in them, each text with its end;
    ``n`` the words' training counts.  All little-endian; all but ``words``, which
    no method shrinks, are compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(batch.column("text"), block_bytes):
                part = batch.slice(a, b - a)
                hashes, counts = hash_words(part.column("text"), POWERS)
                lengths = counts + 1
                ends = np.cumsum(lengths)
                tokens = np.empty(int(ends[-1]), np.uint64)
                is_end = np.zeros(len(tokens), bool)
                is_end[ends - 1] = True
                tokens[is_end], tokens[~is_end] = END, hashes
                words, codes = np.unique(tokens, return_inverse=True)
                trained = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), lengths)
                n = np.bincount(codes[trained], minlength=len(words))
                yield pa.record_batch(
                    [pa.array([block], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                     *(pa.array([x], pa.binary()) for x in (_pack(lengths.astype("<u4")), words.astype("<u8").tobytes(), _pack(codes.astype("<u4")), _pack(n.astype("<u4")))),
                     pa.array([len(tokens)], pa.int64())],
                    names=["block", "doc_ids", "held_out", "lengths", "words", "codes", "n", "tokens"],
                )
                block += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, held_out array<boolean>, lengths binary, words binary, codes binary, n binary, tokens long")


def _bigrams(lengths: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token's bigram as state * size + word, where state ``size`` is the start; and each text's first token."""
    first = np.cumsum(lengths) - lengths
    state = np.empty(len(codes), np.int64)
    state[1:] = codes[:-1]
    state[first] = size
    return state * np.int64(size) + codes, first


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _pair_keys(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of state and word of bigrams given as places."""
    size = len(words)
    states = np.append(words, START)
    return states[pairs // size], words[pairs % size]


def _range_of_pairs(state: np.ndarray, word: np.ndarray, ranges: int) -> np.ndarray:
    return _ranges(mix(state + mix(word)), ranges)


def _dealt(rows: DataFrame, key: str, ranges: int) -> DataFrame:
    """Rows by key, in as many partitions as there are ranges, so that what a task reads does not grow with the table."""
    return rows.repartition(min(ranges, MOST_TASKS), key)


def _of(row: dict, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name], dtype=kind) if name == "words" else _unpack(row[name], kind)


def ask_bigrams(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, states, words, counts): the block's distinct bigrams of a range, by place, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, words, codes = _of(row, "lengths", "<u4").astype(np.int64), _of(row, "words", "<u8"), _of(row, "codes", "<u4").astype(np.int64)
                pairs, _ = _bigrams(lengths, codes, len(words))
                distinct, at = np.unique(pairs, return_inverse=True)
                trained = np.repeat(~np.array(row["held_out"], bool), lengths)
                n = np.bincount(at[trained], minlength=len(distinct))
                state, word = _pair_keys(words, distinct)
                to = _range_of_pairs(state, word, ranges)
                order = np.argsort(to, kind="stable")  # within a range by state and word, as places are
                edges = np.searchsorted(to[order], np.arange(ranges + 1))
                out: dict[str, list] = {"range": [], "block": [], "states": [], "runs": [], "words": [], "counts": []}
                for r in range(ranges):
                    k = order[edges[r] : edges[r + 1]]
                    if len(k):
                        s = state[k]
                        new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                        for name, value in (("range", r), ("block", row["block"]), ("states", _six(s[new])), ("runs", _pack(np.diff(np.append(new, len(k))).astype("<u4"))), ("words", _six(word[k])), ("counts", _pack(n[k].astype("<u4")))):
                            out[name].append(value)
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
                for a in range(0, len(out["range"]), 64):
                    yield pa.record_batch([pa.array(v[a : a + 64], t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return blocks.select("block", "held_out", "lengths", "words", "codes").mapInArrow(run, "range int, block long, states binary, runs binary, words binary, counts binary")


def _totals(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, place of each key among the distinct ones, and their summed counts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place, np.bincount(place, weights=counts, minlength=int(new.sum())).astype(np.int64)


def answer_bigrams(asked: DataFrame, ranges: int, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> DataFrame:
    """(kind, to, part, data): counts of kept bigrams for each block, and the states' kept mass.

    kind 0: to a block, from range ``part``, the totals in the order asked (0: not kept).
    kind 1: of state ``to``, the sum of its kept bigrams' discounted counts, in ``mass``.
    """

    def run(asked: pa.Table) -> pa.Table:
        part = asked.column("range")[0].as_py()
        blocks = asked.column("block").to_pylist()
        raw = {c: asked.column(c).to_pylist() for c in ("states", "runs", "words", "counts")}
        plain = lambda c: np.concatenate([_from_six(x) for x in raw[c]])
        packed = lambda c: [_unpack(x, "<u4") for x in raw[c]]
        each = packed("counts")
        state, word, counts = np.repeat(plain("states"), np.concatenate(packed("runs"))), plain("words"), np.concatenate(each)
        at, place, total = _totals((state, word), counts)
        kept = np.where(total >= min_count, total, 0)
        edges = np.cumsum([0, *map(len, each)])
        answer = kept[place].astype("<u4")
        of, mass = state[at][kept > 0], (kept[kept > 0] - discount)
        states, where = np.unique(of, return_inverse=True)
        mass = np.bincount(where, weights=mass, minlength=len(states))
        n, m = len(blocks), len(states)
        return pa.table({
            "kind": pa.array([0] * n + [1] * m, pa.int32()),
            "to": pa.array(np.concatenate([np.array(blocks, np.int64), states.view(np.int64)])),
            "part": pa.array(np.full(n + m, part, np.int32)),
            "data": pa.array([_pack(answer[edges[i] : edges[i + 1]]) for i in range(n)] + [None] * m, pa.binary()),
            "mass": pa.array(np.concatenate([np.zeros(n), mass])),
        })

    return _dealt(asked, "range", ranges).groupBy("range").applyInArrow(run, "kind int, to long, part int, data binary, mass double")


def ask_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, words, counts) of each block's distinct words, the start among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = _of(row, "words", "<u8"), _of(row, "n", "<u4")
                starts = int((~np.array(row["held_out"], bool)).sum())
                words, n = np.append(words, START), np.append(n, starts)
                to = _ranges(mix(words & MASK), ranges)  # as a state's mass is sent
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(ranges + 1))
                used = [r for r in range(ranges) if edges[r] < edges[r + 1]]
                cut = [order[edges[r] : edges[r + 1]] for r in used]
                asked = pa.array([words[k].tobytes() for k in cut], pa.binary()), pa.array([_pack(n[k].astype("<u4")) for k in cut], pa.binary())
                yield pa.record_batch([pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.int64()), *asked], names=["range", "block", "words", "counts"])

    return blocks.select("block", "held_out", "words", "n").mapInArrow(run, "range int, block long, words binary, counts binary")


def answer_words(asked: DataFrame, mass: DataFrame, ranges: int) -> DataFrame:
    """(block, part, counts, mass, tokens, types): answers to blocks, and with block -1 what the range holds in all."""

    def run(key: tuple, asked: pa.Table, mass: pa.Table) -> pa.Table:
        blocks = asked.column("block").to_pylist()
        words = [np.frombuffer(x, "<u8") for x in asked.column("words").to_pylist()]
        every = np.concatenate([np.empty(0, np.uint64), *words])
        counts = np.concatenate([np.empty(0, np.uint32), *(_unpack(x, "<u4") for x in asked.column("counts").to_pylist())])
        at, place, total = _totals((every,), counts)
        distinct = every[at]
        held = np.zeros(len(distinct))
        if len(mass):
            state = mass.column("to").to_numpy().view(np.uint64)
            order = np.argsort(state)
            k = order[np.minimum(np.searchsorted(state[order], distinct & MASK), len(state) - 1)]
            held = np.where(state[k] == distinct & MASK, mass.column("mass").to_numpy()[k], 0.0)
        real = distinct != START
        edges = np.cumsum([0, *map(len, words)])
        data = [(_pack(total[place[a:b]].astype("<u8")), _pack(held[place[a:b]].astype("<f8"))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        n = len(blocks) + 1
        return pa.table({
            "block": pa.array([*blocks, -1], pa.int64()), "part": pa.array([key[0].as_py()] * n, pa.int32()),
            "counts": pa.array([*(d[0] for d in data), None], pa.binary()), "mass": pa.array([*(d[1] for d in data), None], pa.binary()),
            "tokens": pa.array([0] * (n - 1) + [int(total[real].sum())], pa.int64()), "types": pa.array([0] * (n - 1) + [int((total[real] > 0).sum())], pa.int64()),
        })

    schema = "block long, part int, counts binary, mass binary, tokens long, types long"
    return _dealt(asked, "range", ranges).groupBy("range").cogroup(_dealt(mass, "range", ranges).groupBy("range")).applyInArrow(run, schema)


class Automaton:
    """The part of the backoff automaton that one block's texts can reach.

    States are places in the block's words, the start is the last one, and
    ``root`` is the state of words that training never saw.
    """

    def __init__(self, counts: np.ndarray, mass: np.ndarray, arcs: np.ndarray, arc_counts: np.ndarray, tokens: int, types: int, discount: float) -> None:
        size = len(counts) - 1
        self.known = counts > 0
        self.word = np.log10((counts[:size] + 0.5) / (tokens + 0.5 * (types + 1)))  # the root's arcs
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail = np.where(self.known, np.log10(np.where(self.known, 1 - mass / np.maximum(counts, 1), 1)), 0.0)
            state, word = arcs // size, arcs % size
            left = 1 - mass[state] / np.maximum(counts[state], 1)
            p = np.maximum(arc_counts - discount, 0) / np.maximum(counts[state], 1) + left * 10 ** self.word[word]
            self.arc = np.where(arc_counts > 0, np.log10(p), np.nan)  # nan: no arc

    def weights(self, state: np.ndarray, word: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Log probability of each step: its arc, or the failure arc and then the root's."""
        direct = self.arc[arc]
        return np.where(np.isnan(direct), self.fail[state] + self.word[word], direct)


def score(blocks: DataFrame, bigram_answers: DataFrame, word_answers: DataFrame, ranges: int, tokens: int, types: int, discount: float = DISCOUNT) -> DataFrame:
    """Scores of every text, from its block and the answers to it."""

    def run(key: tuple, block: pa.Table, pairs: pa.Table, words: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lengths, vocabulary, codes = _of(row, "lengths", "<u4").astype(np.int64), _of(row, "words", "<u8"), _of(row, "codes", "<u4").astype(np.int64)
        size = len(vocabulary)

        def answers(t: pa.Table, column: str, kind: str, to: np.ndarray) -> np.ndarray:
            got = dict(zip(t.column("part").to_pylist(), t.column(column).to_pylist(), strict=True))
            out = np.empty(len(to), dtype=kind)
            order = np.argsort(to, kind="stable")
            out[order] = np.concatenate([_unpack(got[r], kind) for r in np.unique(to).tolist()])
            return out

        with_start = np.append(vocabulary, START)
        to = _ranges(mix(with_start & MASK), ranges)
        counts, mass = answers(words, "counts", "<u8", to).astype(np.float64), answers(words, "mass", "<f8", to)
        steps, first = _bigrams(lengths, codes, size)
        arcs, at = np.unique(steps, return_inverse=True)
        arc_counts = answers(pairs, "data", "<u4", _range_of_pairs(*_pair_keys(vocabulary, arcs), ranges)).astype(np.float64)
        model = Automaton(counts, mass, arcs, arc_counts, tokens, types, discount)
        weight = model.weights(steps // size, codes, at)
        total = lambda x: np.add.reduceat(x, first)
        n = len(lengths)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(lengths),
            "n_known": pa.array(total(model.known[codes].astype(np.int64))), "train_tokens": pa.array(np.full(n, tokens, np.int64)),
            "base_score": pa.array(total(model.word[codes])), "score": pa.array(total(weight)),
        })

    # Spark cogroups two sides, so the two kinds of answers travel as one
    both = bigram_answers.select(F.col("to").alias("block"), "part", "data", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("mass")).union(
        word_answers.select("block", "part", F.lit(None).cast("binary"), "counts", "mass")
    )

    def split(key: tuple, block: pa.Table, both: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        return run(key, block, both.filter(pc.is_valid(both.column("data"))), both.filter(pc.is_valid(both.column("counts"))))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    blocks = blocks.select("block", "doc_ids", "held_out", "lengths", "words", "codes")
    # a range has the tokens of two or three full blocks
    return _dealt(blocks, "block", ranges).groupBy("block").cogroup(_dealt(both, "block", ranges).groupBy("block")).applyInArrow(split, schema)


def lm_scores(documents: DataFrame, min_count: int = MIN_COUNT, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Train on the texts that are not held out and score all of them."""
    blocks = materialize(encoded(documents, block_bytes))
    tokens = blocks.agg(F.sum("tokens")).collect()[0][0] or 1
    ranges = max(1, -(-tokens // range_tokens))
    found = materialize(answer_bigrams(ask_bigrams(blocks, ranges), ranges, min_count, discount))
    # a state's mass comes in parts, one a range at most
    mass = found.where("kind = 1").groupBy("to").agg(F.sum("mass").alias("mass"))
    mass = mass.mapInArrow(_with_range(ranges), "to long, mass double, range int")
    words = materialize(answer_words(ask_words(blocks, ranges), mass, ranges))
    whole = words.where("block = -1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).collect()[0]
    return score(blocks, found.where("kind = 0"), words.where("block >= 0"), ranges, whole["n"] or 0, whole["v"] or 0, discount)


def _with_range(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = _ranges(mix(batch.column("to").to_numpy().view(np.uint64)), ranges)
            yield batch.append_column("range", pa.array(to.astype(np.int32)))

    return run


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; every bigram of the training texts has its arc, single ones too."""
    return lm_scores(table(spark, sf_dir, "documents"), min_count=1)
