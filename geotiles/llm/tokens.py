"""Token ids of texts, cut into pieces that fit a sequence.

White space never joins two tokens of ``word_bpe_49k.json`` and its
normaliser keeps words apart, so a text's ids are its words' ids in order.
Each worker therefore runs the tokenizer once per distinct word and joins the
ids as bytes.  The table of words is a cache: it is emptied when it holds
``CACHE_WORDS`` entries, which changes no result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a sequence holds.
SEQUENCE = 4096
#: Appended to every document.
END_ID = 1
CACHE_WORDS = 600_000
#: Texts handled at once hold about so many characters; a longer one is handled alone.
CHUNK_CHARS = 2_000_000
#: Words of letters that the tokenizer sees as one line.
LINE_WORDS = 500
#: Words of ASCII and Latin-1 letters, which no normaliser joins with what follows.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Marks that end a word, of which no special token has one at its end.
_MARKS = b",.;:!?$%&*#"


def _head(word: bytes) -> int:
    """Length of a word without the marks after its last ASCII or Latin-1 letter; 0 if it does not end so."""
    n = len(word.rstrip(_MARKS))
    if n == len(word):
        return 0
    c = word[n - 1 : n]
    return n if c.isalpha() or word[n - 2 : n - 1] == b"\xc3" and c not in (b"\x97", b"\xb7") else 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, so ASCII capitals are lowered first, unless a
    combining mark is there, which could compose with the one case and not the
    other.  Marks after a word's last letter are a token run of their
    own, so such a word's ids are those of both parts.  A word of letters alone is
    one run, and only its last token has the mark of a word's end; so many are
    tokenized as one line and cut at the marks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this process, which the tasks of a reused worker share."""
        held = sys.__dict__.setdefault("_geotiles_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        ending = {w: n for w in words if (n := _head(w))}
        plain = words.difference(ending) | {x for w, n in ending.items() for x in (w[:n], w[n:])}.difference(known)
        runs = [w for w in plain if _LETTERS.fullmatch(w)]
        alone = list(plain.difference(runs))
        lines = [runs[k : k + LINE_WORDS] for k in range(0, len(runs), LINE_WORDS)]
        for k in range(0, len(lines), 20):
            some = lines[k : k + 20]
            for line, ids in zip(some, self._ids([b" ".join(x) for x in some]), strict=True):
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) != len(line) or cuts[-1] != 4 * len(ids):  # not a vocabulary that marks the ends
                    alone += line
                    continue
                data = ids.tobytes()
                known.update((w, data[low:high]) for w, low, high in zip(line, [0, *cuts], cuts))
        for k in range(0, len(alone), 10_000):
            some = alone[k : k + 10_000]
            known.update((w, ids.tobytes()) for w, ids in zip(some, self._ids(some), strict=True))
        known.update((w, known[w[:n]] + known[w[n:]]) for w, n in ending.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        split = [(d if b"\xcc" in d or b"\xcd" in d else d.lower()).split() for d in data]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self._learn(set().union(*split).difference(self.known))
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in split]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > CHUNK_CHARS:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def pieces(documents: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Every document's ids, the end id last, cut where they exceed a sequence.

    ``documents`` has ``doc_id`` and ``text`` (null: empty, so one piece that
    holds the end id alone); other columns are ignored.  A row per piece:
    ``doc_id, piece, start, length, ids_crc32``, with ``ids`` the ids
    themselves as ``ids`` (binary, little-endian, unsigned, of 16 bits if the
    vocabulary allows it and 32 otherwise), and ``row``, a number that differs
    between all pieces, repeated ones too.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.of(path)
        end, width = np.asarray([end_id], dtype="<u4").tobytes(), 4 * sequence
        for batch in batches:
            for a, b in _chunks(batch, "text"):
                part = batch.slice(a, b - a)
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "row": [], "ids": []}
                for doc, data in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), width)):
                        cut = data[at : at + width]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(at // 4)
                        out["length"].append(len(cut) // 4)
                        out["ids_crc32"].append(zlib.crc32(cut))
                        out["row"].append(row)
                        row += 1
                        if ids:
                            out["ids"].append(cut if encoder.width == 4 else np.frombuffer(cut, "<u4").astype("<u2").tobytes())
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "row": pa.int64(), "ids": pa.binary()}
                names = [n for n in kinds if ids or n != "ids"]
                yield pa.record_batch([pa.array(out[n], kinds[n]) for n in names], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + (", ids binary" if ids else "")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)
