"""Rule-based quality filter, run as a short-circuit cascade.

Every rule is a boolean expression over text measures that is true when the
text fails.  A bounded sample, dealt over the whole table, tells how long each rule
takes and how many texts it rejects; the cascade then asks the rules in the order of
rejections per cost, and a text that fails one rule never evaluates the measures that
only later rules need.  Only the order depends on the sample: which texts are kept never
does.  ``digest`` asks in the same order; its five base measures are wanted of
every text, and the measures of the other rules only of texts that no rule before rejects.

Defined cases: a null text is an empty one and has no words, so it fails the
word count; rows are never merged, so repeated rows each get their result; very long
texts are measured whole; rules that reject equally often a second keep their order; an
empty table gives an empty result; all other columns are kept unless they are
named like a result column, which replaces them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import SPACE_CLASS, SPACES, table

#: Rows, about, of the sample that fixes the order of the rules.
SAMPLE_ROWS = 500
#: Longest text of the sample, in bytes.
SAMPLE_BYTES = 50_000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _words(df: DataFrame, run: Column) -> DataFrame:
    """``_words``: the words as an array; with them ``n_words``."""
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    df = df.withColumn("_words", F.when(run, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+", -1))))
    return df.withColumn("n_words", F.when(run, F.size("_words").cast("long")))


def _word_chars(df: DataFrame, run: Column) -> DataFrame:
    """Code points inside words."""
    return df.withColumn("word_chars", F.when(run, F.length(F.translate(F.col("_text"), SPACES, "")).cast("long")))


def _n_symbols(df: DataFrame, run: Column) -> DataFrame:
    without = F.translate(F.col("_text"), SYMBOLS, "")
    return df.withColumn("n_symbols", F.when(run, (F.length("_text") - F.length(without)).cast("long")))


def _n_dup_lines(df: DataFrame, run: Column) -> DataFrame:
    """Lines with a word that equal an earlier line; with them ``n_lines``, blank ones included."""
    df = df.withColumn("_lines", F.when(run, F.split("_text", "\n", -1))).withColumn("n_lines", F.size("_lines").cast("long"))
    df = df.withColumn("_lines", F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")


def _n_repeat_words(df: DataFrame, run: Column) -> DataFrame:
    """Words covered by three-word windows that occur at least twice in the text.

    Windows are sorted as longs: the high bits hold the window's hash and the
    low bits its position, so equal windows become neighbours in n log n steps
    without a shuffle.  That leaves 50 bits of the hash: two different windows of one such
    text agree with a probability of at most 2**-50 a pair.  From 2**14 words on, hash and
    position stay apart, with all 64 bits.
    Each step is a column of its own, which keeps the sort in generated code.
    """
    small, low = F.col("n_words") < (1 << 14), F.lit((1 << 14) - 1).cast("long")
    df = df.withColumn("_hashes", F.when(run & (F.col("n_words") >= 4), F.transform("_words", lambda w: F.xxhash64(w))))
    window = lambda i: F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    starts = F.sequence(F.lit(0), F.size("_hashes") - 3)
    df = df.withColumn("_packed", F.when(small & F.col("_hashes").isNotNull(), F.transform(starts, lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))))
    df = df.withColumn("_apart", F.when(~small & F.col("_hashes").isNotNull(), F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.cast("long").alias("i")))))
    df = df.withColumn("_packed", F.sort_array("_packed")).withColumn("_apart", F.sort_array("_apart"))
    equal = lambda a, b: F.coalesce(a.bitwiseXOR(b) <= low, F.lit(False)) & F.coalesce(a.bitwiseXOR(b) >= 0, F.lit(False))
    packed = F.filter("_packed", lambda x, j: equal(x, F.get("_packed", j + 1)) | equal(x, F.get("_packed", j - 1)))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_apart", j)["h"], F.lit(False))
    apart = F.filter("_apart", lambda x, j: same(x, j + 1) | same(x, j - 1))
    df = df.withColumn("_packed", packed).withColumn("_apart", apart)
    at = F.coalesce(F.transform("_packed", lambda x: x.bitwiseAND(low)), F.transform("_apart", lambda x: x["i"]))
    df = df.withColumn("_at", F.sort_array(at))
    # each start covers three words, less what the start before it has covered
    gaps = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.when(run, F.coalesce(gaps, F.lit(0).cast("long")))).drop("_hashes", "_packed", "_apart", "_at")


def _n_alpha_words(df: DataFrame, run: Column) -> DataFrame:
    """Words with a letter."""
    return df.withColumn("n_alpha_words", F.when(run, F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long")))


def _lines_like(name: str, pattern: str) -> Callable[[DataFrame, Column], DataFrame]:
    def add(df: DataFrame, run: Column) -> DataFrame:
        return df.withColumn(name, F.when(run, F.size(F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(pattern))).cast("long")))

    return add


ELLIPSIS_LINE = r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"
BULLET_LINE = r"^[\x20\x09-\x0D]*[•‣▪●*-][\x20\x09]"

#: How each measure is added; ``run`` says for which rows it is wanted at all.
MEASURES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": _words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_alpha_words": _n_alpha_words,
    "n_ellipsis_lines": _lines_like("n_ellipsis_lines", ELLIPSIS_LINE),
    "n_bullet_lines": _lines_like("n_bullet_lines", BULLET_LINE),
}
#: What the digest wants of every text.
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``needs`` names the measures; ``fails`` is SQL over them, true when a text is rejected."""

    name: str
    needs: tuple[str, ...]
    fails: str


#: The standing rules; few_words and repeat_words are the base rules of the digest.
RULES: tuple[Rule, ...] = (
    Rule("long_words", ("n_words", "word_chars"), "word_chars > 15 * n_words"),
    Rule("short_words", ("n_words", "word_chars"), "10 * word_chars < 15 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", ("n_dup_lines",), "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeat_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("alpha_words", ("n_words", "n_alpha_words"), "10 * n_alpha_words < 8 * n_words"),
    Rule("ellipsis_lines", ("n_dup_lines", "n_ellipsis_lines"), "n_ellipsis_lines >= 5 AND 10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("bullet_lines", ("n_dup_lines", "n_bullet_lines"), "n_bullet_lines >= 5 AND 10 * n_bullet_lines > 9 * n_lines"),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def _ask(df: DataFrame, rules: Sequence[Rule], always: Sequence[str] = ()) -> DataFrame:
    """``_failed``: the first rule that rejects.  But for those that are wanted ``always``, later measures are skipped for rejected rows."""
    have: set[str] = set()
    df = df.withColumn("_failed", F.lit(None).cast("string"))
    for rule in rules:
        for name in rule.needs:
            if name not in have:
                df, _ = MEASURES[name](df, F.lit(True) if name in always else F.col("_failed").isNull()), have.add(name)
        df = df.withColumn("_failed", F.coalesce("_failed", F.when(F.expr(rule.fails), F.lit(rule.name))))
    return df


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Seconds and share of rejections of each rule alone on a sample of about ``rows`` rows, at most twice as many.

    Every row of the table is as likely to be in the sample; texts of over
    ``SAMPLE_BYTES`` bytes are left out, so the driver holds a bounded amount.
    """
    text, many = F.coalesce(F.col(column), F.lit("")), df.count()
    drawn = df.select(text.alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    drawn = drawn.sample(min(1.0, rows / many), seed=6) if many > rows else drawn
    sample = df.sparkSession.createDataFrame(drawn.limit(2 * rows).collect(), "_text string").repartition(1)
    sample.agg(F.sum(F.length("_text"))).collect()  # starts what must be started before the clock runs
    out = []
    for rule in rules:
        asked = _ask(sample, [rule])
        began = time.perf_counter()
        row = asked.agg(F.count("*").alias("n"), F.count("_failed").alias("bad")).collect()[0]
        out.append(Estimate(rule.name, time.perf_counter() - began, row["bad"] / max(1, row["n"])))
    return out


def order(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Rules by rejections per second, most first; ties keep the given order."""
    by = {e.name: e.rejected / max(e.seconds, 1e-9) for e in estimates}
    return sorted(rules, key=lambda r: -by[r.name])


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``kept`` and ``failed_rule``, the first rule of the chosen order that rejects (null: none)."""
    chosen = order(rules, estimate(df, rules, column, sample_rows))
    # the caller's columns travel inside one struct, so that no name can clash with a measure's
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("kept", "failed_rule")]).alias("_row"), F.coalesce(F.col(column), F.lit("")).alias("_text"))
    # a filter on the verdict must not be pushed below the steps, where each would be
    # written out once for every use: it depends on a column that forbids that
    asked = _ask(inner, chosen).withColumn("_order", F.monotonically_increasing_id())
    return asked.select("_row.*", F.col("_failed").alias("failed_rule"), (F.col("_failed").isNull() & (F.col("_order") >= 0)).alias("kept"))


def digest(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All base measures of every text, and the cascade's verdict."""
    chosen = order(rules, estimate(documents, rules))
    inner = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    measured = _ask(inner, chosen, BASE_MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("_failed").isNull()).alias("kept")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             string_split(text, chr(10)) AS lines FROM t),
m AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, words,
             len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha,
             len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•‣▪●*-][\x20\x09]')))::BIGINT AS n_bullet,
             list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM w),
d AS (SELECT *, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines FROM m),
g AS (SELECT rid, unnest(range(1, n_words - 1)) AS i, words FROM d WHERE n_words >= 4),
h AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM h) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_alpha, n_ellipsis, n_bullet, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars > 15 * n_words OR 10 * word_chars < 15 * n_words
         OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
         OR 10 * n_alpha < 8 * n_words OR n_ellipsis >= 5 AND 10 * n_ellipsis > 3 * n_lines OR n_bullet >= 5 AND 10 * n_bullet > 9 * n_lines) AS kept
FROM b
"""
