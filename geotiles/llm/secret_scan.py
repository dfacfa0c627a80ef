"""Find secrets by fixed patterns and by the likelihood of their format.

Base patterns (assignments, access keys, long hex runs) always give spans.
Beyond them, every run of token characters in every text is a candidate.
Labelled credentials are turned into a prefix tree whose statistically
compatible states are merged, lowest first, under Hoeffding's bound; the merged
tree is a probabilistic automaton per credential kind.  The same is done for
what token characters ordinarily hold: the corpus's candidates outside base
spans, beside generated words.  A candidate becomes a span of kind ``format``
when the best credential automaton explains it better than the ordinary one by
``MARGIN`` nats a character, whatever its characters.

Training takes, per kind, the ``TRAIN_ROWS`` base values with the lowest hash
(a documented bound on labelled rows), besides exemplars generated from public
credential formats; and the ``TRAIN_ROWS`` distinct candidates without a label
with the lowest hash.  Values of over ``TRAIN_CHARS`` characters train nothing, as no
credential format is that long; they are scored like all others.  Everything else
looks at all texts.

Characters are seen by class, but for prefixes that many of a kind's values share
("ghp_", "AKIA"): each is one symbol of its own, so that the grammar holds it
literally.

Defined cases: a null text is empty and has no spans; very long texts are
scanned whole; repeated rows each give their row; spans of several kinds that start
together come in the order of ``KINDS``; equal hashes are ordered by value; an empty table gives an empty
result and automata from the generated exemplars alone; extra columns are
ignored by the digest and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import discard, materialize, table

#: Labelled values of each kind that train its automaton.
TRAIN_ROWS = 1500
#: Confidence of the merging test.
ALPHA = 0.05
#: Nats a character by which a credential automaton must beat the ordinary one.
MARGIN = 0.7
#: Shortest candidate.
SHORTEST = 12
#: Longest value that trains an automaton.
TRAIN_CHARS = 200
#: A prefix is literal that this share of a kind's values has, and this many of them.
LITERAL_SHARE, LITERAL_ROWS = 0.05, 8

KINDS = ("assign", "access", "hex", "format")

_KEY = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all base matches, in order.

    Runs of one class are maximal, so asking for the least length in the
    pattern drops the same runs as testing it afterwards.  An assignment whose
    value is too short is dropped without a retry, as it consumes its text.
    """
    out = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "key" in lower:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def symbol(c: str) -> str:
    """A character as the automata see it: its class."""
    if c.isdigit():
        return "0"
    if c in "abcdef":
        return "a"
    if c.islower():
        return "k"
    if c in "ABCDEF":
        return "A"
    if c.isupper():
        return "K"
    return c


_SYMBOLS = {c: symbol(c) for c in string.ascii_letters + string.digits + "+/_.=-"}
_ALPHABET = sorted(set(_SYMBOLS.values()))
_END = ""


@dataclass
class Automaton:
    """Arcs by state and symbol, with log probabilities; the empty symbol ends a word."""

    arcs: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    floor: float = math.log(1e-4)
    literals: tuple[str, ...] = ()

    def score(self, word: str) -> float:
        """Log likelihood; a symbol without an arc costs the floor and leads where it would lead from the start.

        So one odd place in a word costs once and not at every symbol that follows.
        """
        state, total = 0, 0.0
        for symbol in symbols(word, self.literals):
            arc = self.arcs[state].get(symbol)
            if arc is None:
                state, total = self.arcs[0].get(symbol, (0, 0.0))[0], total + self.floor
            else:
                state, total = arc[0], total + arc[1]
        arc = self.arcs[state].get(_END)
        return total + (arc[1] if arc else self.floor)


def symbols(word: str, literals: tuple[str, ...]) -> list[str]:
    """A word as the automata see it: one of the literal prefixes, if it has one, and classes of characters."""
    head = next((x for x in literals if word.startswith(x)), "")
    return [head, *(_SYMBOLS.get(c, c) for c in word[len(head) :])] if head else [_SYMBOLS.get(c, c) for c in word]


def shared_prefixes(words: Sequence[str]) -> tuple[str, ...]:
    """Prefixes of two to eight characters that many words have, each as long as nearly all of them agree; longest first."""
    counts = Counter(word[:k] for word in words for k in range(2, 9) if len(word) >= k)
    most = {x: n for x, n in counts.items() if n >= max(LITERAL_ROWS, LITERAL_SHARE * len(words))}
    ends = [x for x in most if not any(len(y) == len(x) + 1 and y.startswith(x) and n >= 0.9 * most[x] for y, n in most.items())]
    return tuple(sorted(ends, key=lambda x: (-len(x), x)))


def infer(words: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the words' prefix tree, in order of breadth.

    Two states are compatible when the frequencies of each symbol, and of
    ending, differ by less than Hoeffding's bound, for them and for all pairs of
    states that their merger would fold together.
    """
    nexts: list[dict[str, int]] = [{}]
    counts: list[Counter[str]] = [Counter()]
    literals = shared_prefixes(words)
    for word in words:
        state = 0
        for s in symbols(word, literals):
            counts[state][s] += 1
            if s not in nexts[state]:
                nexts[state][s] = len(nexts)
                nexts.append({})
                counts.append(Counter())
            state = nexts[state][s]
        counts[state][_END] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo, steps = [(a, b)], 0
        while todo:
            x, y = todo.pop()
            n, m = counts[x].total(), counts[y].total()
            if n and m:
                most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if any(abs(counts[x][s] / n - counts[y][s] / m) > most for s in counts[x].keys() | counts[y].keys()):
                    return False
            todo += [(nexts[x][s], nexts[y][s]) for s in nexts[x].keys() & nexts[y].keys() if nexts[x][s] != nexts[y][s]]
            steps += 1
            if steps > 100_000:  # the red part has cycles; a fold this long never ends
                return False
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            counts[x].update(counts[y])
            for s, z in nexts[y].items():
                if s in nexts[x]:
                    todo.append((nexts[x][s], z))
                else:
                    nexts[x][s] = z

    red, blue = [0], list(nexts[0].items())
    blue = [(0, s) for s, _ in sorted(blue)]
    while blue:
        parent, s = blue.pop(0)
        state = nexts[parent][s]
        if state in red:
            continue
        for r in red:
            if alike(r, state):
                nexts[parent][s] = r
                fold(r, state)
                break
        else:
            red.append(state)
        known = set(red)
        blue = [(r, x) for r in red for x in sorted(nexts[r]) if nexts[r][x] not in known]
    number = {r: i for i, r in enumerate(red)}
    out = Automaton(literals=literals)
    for r in red:
        n = counts[r].total() + 0.5 * (len(_ALPHABET) + 1)
        arcs = {s: (number[z], math.log((counts[r][s] + 0.5) / n)) for s, z in nexts[r].items()}
        out.arcs.append(arcs | {_END: (0, math.log((counts[r][_END] + 0.5) / n))})
    return out


def exemplars(n: int = 300, seed: int = 4) -> dict[str, list[str]]:
    """Labelled credentials made from public formats, the same on every run."""
    rng = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    draw = lambda chars, k: "".join(rng.choices(chars, k=k))
    return {
        "prefixed": [rng.choice(("ghp_", "gho_", "sk_live_", "pk_live_", "npm_", "glpat-", "xoxb-", "AIza", "sk-")) + draw(alnum, rng.choice((24, 36, 40))) for _ in range(n)],
        "base64": [draw(b64, k := rng.choice((32, 40, 43, 64, 86))) + "=" * (-k % 4) for _ in range(n)],
        "jwt_part": ["eyJ" + draw(alnum + "-_", rng.choice((33, 60, 90))) for _ in range(n)],
        "upper": ["AKIA" + draw(string.ascii_uppercase + string.digits, 16) for _ in range(n)],
        "hex": [draw("0123456789abcdef", rng.choice((20, 32, 40, 64))) for _ in range(n)],
    }


def ordinary(n: int = 3000, seed: int = 5) -> list[str]:
    """Words, compounds, numbers and paths: what token characters usually hold."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in "aeiou"] + ["th", "an", "er", "tion", "ing", "ent", "ou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 5)))
    kinds = (
        lambda: word() + word() + word(),
        lambda: word().capitalize() + word() + word(),
        lambda: (word() + word()).upper(),
        lambda: rng.choice("-_/").join(word() for _ in range(rng.randint(3, 6))),
        lambda: word().capitalize() + word().capitalize() + word().capitalize(),
        lambda: rng.choice("=-_+") * rng.randint(16, 60),
        lambda: "".join(rng.choices(string.digits, k=rng.randint(16, 24))),
        lambda: "-".join("".join(rng.choices(string.digits, k=rng.randint(2, 4))) for _ in range(5)),
        lambda: rng.choice("-_/").join([word(), "".join(rng.choices(string.digits, k=rng.randint(1, 4))), word(), word()]),
        lambda: "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
        lambda: f"{rng.randint(1970, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}-{rng.randint(0, 59):02}-{rng.randint(0, 59):02}Z" + rng.choice(("", f"-{word()}")),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4))) + "".join(rng.choices(string.digits, k=rng.choice((1, 2, 4)))),
    )
    return [rng.choice(kinds)() for _ in range(n)]


@dataclass
class Model:
    credentials: dict[str, Automaton]
    plain: Automaton
    margin: float = MARGIN

    def is_secret(self, word: str) -> bool:
        best = max(a.score(word) for a in self.credentials.values())
        return best - self.plain.score(word) > self.margin * len(word)


def labelled(documents: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` distinct base values of each kind, and candidates outside them as kind ``format``: those with the lowest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for start, end in free(text, base):
                        kinds.append(KINDS[3])
                        values.append(text[start:end])
                    for start, kind, end in base:
                        value = text[start:end]
                        kinds.append(KINDS[kind])
                        values.append(ASSIGN.match(value)[1] if kind == 0 else value)
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    found = documents.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string").where(F.length("value") <= TRAIN_CHARS).distinct()
    found = materialize(found)  # read once for each kind
    out = []
    for kind in KINDS:  # four bounded top-k jobs' worth of rows, no group in one task
        out += found.where(F.col("kind") == kind).select("kind", "value").orderBy(F.xxhash64("value"), "value").limit(rows).collect()
    discard(found)
    return [(r["kind"], r["value"]) for r in out]


def train(values: Iterable[tuple[str, str]]) -> Model:
    by: dict[str, list[str]] = exemplars()
    plain = ordinary()
    for kind, value in values:
        if kind == KINDS[3]:
            plain.append(value)
        else:
            by.setdefault(f"corpus_{kind}", []).append(value)
    return Model({kind: infer(words) for kind, words in by.items()}, infer(plain))


def free(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of the candidates that overlap no base span."""
    taken = sorted((s, e) for s, _, e in base)
    k = 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < m.end() and taken[j][1] <= m.start():
            j += 1
        if j == len(taken) or taken[j][0] >= m.end():
            yield m.start(), m.end()


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those of the method never overlap a base one."""
    base = base_spans(text)
    extra = [(start, 3, end) for start, end in free(text, base) if model.is_secret(text[start:end])]
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans, redacted columns' spans) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the model, bounded by the training bounds, travels inside by value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = all_spans(text or "", model)
                n = Counter(k for _, k, _ in spans)
                rows.append((doc, n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redact(documents: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``documents`` with every secret replaced by ``<kind>``; overlapping spans are replaced as one."""
    at = documents.columns.index(column)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        spans = all_spans(text, model)[1]
        k = 0
        while k < len(spans):
            start, kind, end = spans[k]
            while k + 1 < len(spans) and spans[k + 1][0] < end:
                k += 1
                end = max(end, spans[k][2])
            out += [text[done:start], f"<{KINDS[kind]}>"]
            done = end
            k += 1
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return documents.mapInArrow(run, documents.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan(documents, train(labelled(documents)))
