"""Find personal data by weak supervision, with DataFrame functions alone.

Base patterns (email, ip, card, phone) with their checks always give spans.
A looser pattern proposes further candidates: phone numbers without a plus,
addresses written with "(at)" and "(dot)", social security numbers and IBANs.
Four labelers vote on every candidate of either kind, each yes (1), no (-1) or
nothing (0): the strict pattern, a gazetteer (domains, area codes, issuers,
countries), the words before it, and its borders.  All candidates of all texts
are counted by kind and votes, which gives a table of at most
``len(KINDS) * 3**4`` rows whatever the input; on that table
expectation-maximisation estimates each labeler's reliability for each kind, and its
posteriors train a logistic span classifier.  The classifier is applied as a
column expression and decides about the candidates beyond the base spans.

Positions are code points.  They come from the lengths of the matches and of
the gaps between them, so no text is cut at a position.  The patterns are the
plain ones with possessive repeats and a look-behind, which match the same
spans in linear time and without recursion.

Defined cases: a null text is empty and has no spans; repeated rows each give
their row; very long texts are scanned whole; spans that start together come in the order
of ``KINDS``; a candidate as likely as not is not added; an empty table gives an empty
result; extra columns stay, but for those named base, extra or added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import let, materialize, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LABELERS = ("strict", "gazetteer", "context", "border")

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base patterns.
LOOSE = (
    r"(?<![A-Za-z0-9.+-])(?:"
    r"\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
    r"|[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,5}"
    r")(?![A-Za-z0-9]|-[0-9])"
)
#: Domains' last parts, which the gazetteer knows.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl|example|test"
#: Countries that issue IBANs, which the gazetteer knows.
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE"
#: Words before a candidate that speak for its kind, in the languages of the corpus.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|from|client)\b",
    "card": r"(?i)\b(card|visa|credit|payment|paid|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|fax|mobile|cell|appelez|telefon|llame)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b",
}
#: Words before a candidate that speak against any kind.
AGAINST = r"(?i)\b(version|build|isbn|issn|order|ticket|part|serial|release)\W*$"
CONTEXT_CHARS = 40
#: Shares of the votes no, nothing and yes that each labeler is expected to give to true candidates and to false ones.
EXPECTED = {
    "strict": ((0.05, 0.45, 0.5), (0.3, 0.45, 0.25)),
    "gazetteer": ((0.05, 0.05, 0.9), (0.5, 0.05, 0.45)),
    "context": ((0.005, 0.595, 0.4), (0.45, 0.5, 0.05)),
    "border": ((0.05, 0.15, 0.8), (0.3, 0.2, 0.5)),
}
#: Step of the classifier's descent; its curvature is at most (1 + labelers) / 4, so this converges.
STEP = 1.0
#: Weight of the expected votes beside those seen; below 1 the rounds drift to calling all candidates true.
ANCHOR = 2.0
#: Matches of a text whose positions are summed up at once.
CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass Luhn's check; the doubled digit's own digits are summed."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check of a base match; its failures are dropped without a retry."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _gazetteer(kind: Column, m: Column) -> Column:
    digits = _digits(m)
    vote = lambda c: F.when(c, 1).otherwise(-1)
    national = F.right(digits, F.lit(10))
    return (
        F.when(kind == "email", vote(F.lower(m).rlike(rf"\b(?:{DOMAINS})$")))
        .when(kind == "ip", vote(F.regexp_extract(m, "^[0-9]+", 0).rlike("^0*(?:22[0-3]|2[01][0-9]|1[0-9][0-9]|[1-9][0-9]?)$")))
        .when(kind == "card", vote(digits.rlike("^[3-6]")))
        .when(kind == "phone", vote(national.rlike("^[2-9]")))
        .when(kind == "ssn", vote(~digits.rlike("^(?:000|666|9)|^...00|0000$")))
        .otherwise(vote(F.left(m, F.lit(2)).rlike(f"^(?:{IBAN_COUNTRIES})$")))
    )


def _context(kind: Column, left: Column) -> Column:
    out = F.when(left.rlike(AGAINST), -1)
    for name, pattern in CONTEXT.items():
        out = out.when((kind == name) & left.rlike(pattern), 1)
    return out.otherwise(0)


def _border(m: Column, left: Column, right: Column) -> Column:
    return F.when(left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]"), -1).when((left == "") | left.rlike(r"\s$"), 1).otherwise(0)


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, m, left, right>>, null where there is none.

    ``left`` and ``right`` are the ends of the gaps around a match.  A text's n matches take
    about n * (CHUNK + n / CHUNK**2) steps.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.right(g, F.lit(CONTEXT_CHARS)).alias("left"), F.length(g).alias("gap"), F.length(m).alias("n")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    kind = "array<struct<start:bigint,end:bigint,m:string,left:string>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["m"].alias("m"), p["left"].alias("left"))
        return F.struct((start + p["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # appending to an array copies it, so positions run through chunks, and through each chunk from its own start
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
    length = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda acc, p: acc + p["gap"] + p["n"])
    begins = lambda cs: F.aggregate(cs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, c: F.struct((acc["at"] + length(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    run = lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    spans = let(chunks, lambda cs: F.flatten(F.zip_with(cs, begins(cs), run)))
    after = F.transform(spans, lambda s, i: F.struct(s["start"], s["end"], s["m"], s["left"], F.left(F.get(gaps, i + 1), F.lit(2)).alias("right")))
    return F.when(text.rlike(pattern), after)


def candidates(documents: DataFrame, column: str = "text") -> DataFrame:
    """``base`` and ``extra`` candidates per row, as array<struct<start, kind, end, valid, votes>>.

    Columns of ``documents`` named base, extra or added are left out; all others stay, whatever their names.
    """
    names = [c for c in documents.columns if c.lower() not in ("base", "extra", "added")]
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_or_empty(column).alias("_t"))
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("loose", LOOSE)):
        inner = inner.withColumn(f"_{kind}", matches(F.col("_t"), pattern))

    def judged(s: Column, kind: Column, ok: Column) -> Column:
        strict = F.when(ok, 1).when(ok.isNull(), 0).otherwise(-1)
        votes = [strict, _gazetteer(kind, s["m"]), _context(kind, s["left"]), _border(s["m"], s["left"], s["right"])]
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), ok.alias("valid"), F.array(*[v.cast("int") for v in votes]).alias("votes"))

    empty = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,valid:boolean,votes:array<int>>>")

    def checked(k: str) -> Column:
        return F.coalesce(F.transform(f"_{k}", lambda s: judged(s, F.lit(k), F.coalesce(valid(k, s["m"]), F.lit(False)))), empty)

    base = [checked(k) for k in KINDS[:4]]

    def loose(s: Column) -> Column:
        m = s["m"]
        kind = F.when(m.rlike(r"(?i)[(\[]at[)\]]"), "email").when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(m.rlike("^[0-9]{3}-[0-9]{2}-"), "ssn").otherwise("phone")
        strict = F.when(kind == "iban", F.length(F.regexp_replace(m, " ", "")).between(15, 34)).when(kind == "email", F.lower(m).rlike(rf"\b(?:{DOMAINS})$"))  # nothing to check in the others
        return judged(s, kind, strict)

    extra = F.coalesce(F.transform("_loose", loose), empty)
    return inner.select("_row.*", F.concat(*base).alias("base"), extra.alias("extra"))


@dataclass(frozen=True)
class Classifier:
    """Logistic weights by kind: a bias, and one weight for each labeler's vote no, nothing or yes."""

    bias: dict[str, float]
    votes: dict[str, tuple[tuple[float, float, float], ...]]
    reliabilities: dict[str, tuple[float, ...]]

    def log_odds(self, kind: Column, votes: Column) -> Column:
        flat = {k: [self.bias[k], *(x for w in self.votes[k] for x in w)] for k in KINDS}
        weights = F.element_at(F.create_map(*[x for k in KINDS for x in (F.lit(k), F.array(*[F.lit(v) for v in flat[k]]))]), kind)
        out = F.get(weights, F.lit(0))
        for i in range(len(LABELERS)):
            out = out + F.get(weights, F.get(votes, F.lit(i)) + (2 + 3 * i))
        return out


def fit(rows: Sequence[Row], rounds: int = 60) -> Classifier:
    """Estimate reliabilities by expectation-maximisation and fit the classifier to its posteriors.

    ``rows`` have ``kind, votes, n``: the bounded table of vote patterns.
    A labeler's votes depend on the kind and the truth alone.  ``EXPECTED`` votes count
    for ``ANCHOR`` times as many candidates as a kind has, so that labelers keep their meaning where
    nearly all candidates are true, or false.
    """
    bias, weights, reliable = dict.fromkeys(KINDS, 0.0), {}, {}
    for kind in KINDS:
        data = [(tuple(r["votes"]), float(r["n"])) for r in rows if r["kind"] == kind]
        total = sum(n for _, n in data) or 1.0
        expected = [[[ANCHOR * total * share for share in votes] for votes in EXPECTED[name]] for name in LABELERS]  # weight of each vote if true, if false
        prior, seen, posterior = 0.7, expected, []
        for _ in range(rounds):
            posterior = []
            for votes, _n in data:
                yes, no = math.log(prior), math.log(1 - prior)
                for i, v in enumerate(votes):
                    yes += math.log(seen[i][0][v + 1] / sum(seen[i][0]))
                    no += math.log(seen[i][1][v + 1] / sum(seen[i][1]))
                posterior.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
            seen = [[list(x) for x in both] for both in expected]
            true = 0.0
            for (votes, n), p in zip(data, posterior, strict=True):
                true += n * p
                for i, v in enumerate(votes):
                    seen[i][0][v + 1] += n * p
                    seen[i][1][v + 1] += n * (1 - p)
            prior = min(0.99, max(0.01, (1.4 + true) / (2 + total)))
        w = [[0.0, 0.0, 0.0] for _ in LABELERS]
        for _ in range(1500 if data else 0):
            g_bias, g_w = 0.0, [[0.0, 0.0, 0.0] for _ in LABELERS]
            for (votes, n), p in zip(data, posterior, strict=True):
                z = bias[kind] + sum(w[i][v + 1] for i, v in enumerate(votes))
                off = n / total * (1 / (1 + math.exp(max(-60.0, min(60.0, -z)))) - p)
                g_bias += off
                for i, v in enumerate(votes):
                    g_w[i][v + 1] += off
            bias[kind] -= STEP * (g_bias + 1e-4 * bias[kind])
            for i in range(len(w)):
                for v in range(3):
                    w[i][v] -= STEP * (g_w[i][v] + 1e-4 * w[i][v])
        weights[kind] = tuple(tuple(x) for x in w)
        reliable[kind] = tuple(s[0][2] / sum(s[0]) for s in seen)
    return Classifier(bias, weights, reliable)


def train(found: DataFrame) -> Classifier:
    """Count all candidates by kind and votes, and fit."""
    each = found.select(F.explode(F.concat("base", "extra")).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    return fit(each.collect())  # at most len(KINDS) * 3 ** len(LABELERS) rows


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def resolve(found: DataFrame, classifier: Classifier) -> DataFrame:
    """Replace the candidates by ``base`` spans that hold and ``added`` spans of the method.

    An added span overlaps no base span.
    """
    kept = found.withColumn("base", F.filter("base", lambda s: s["valid"]))
    accepted = lambda s: classifier.log_odds(s["kind"], s["votes"]) > 0
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return kept.withColumn("added", F.filter("extra", lambda s: clear(s) & accepted(s))).drop("extra")


def detect(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` without the text, with ``base`` and ``added`` spans; trains on all of them."""
    found = materialize(candidates(documents, column).drop(column))
    return resolve(found, train(found))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans")
    )
