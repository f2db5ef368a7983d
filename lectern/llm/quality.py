"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule rejects a document by one expression over its text and words. In one pass over a sample a clock is read before and after each
rule, which gives each rule's cost and which rules reject each row. The rule with most rejections per second comes
first; the next one is chosen by what the rows that are left say, and so on, so that costly rules see only what cheap ones let pass.
Rules stand in one CASE, of which later branches aren't evaluated. The order never changes the verdict, since a document is kept if no rule rejects it.

Defined results: a null text is an empty text; an empty text has no words and fails ``too_short``;
repeated rows are judged one by one; an empty table gives an empty table and the rules in listed order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "A-Z"
#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def letters(text: Column, chars: str) -> Column:
    """How many characters of a text are in a class of a regular expression."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return letters(text, SYMBOLS)


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_in(ws: Column, size: int = 3) -> Column:
    """Words that lie in a window of `size` words found twice or more in the array of words ws.

    Windows are compared by 64-bit hash; two different windows of one text meet with a chance of about 2^-64. Only where some are equal are they
    sorted with their places.
    """
    places = lambda w: F.sequence(F.lit(0), F.size(w) - size)
    hashes = lambda w: F.transform(places(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    keyed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    covered = lambda r: F.aggregate(F.transform(r, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(r, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b)
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keyed(h), lambda s: let(starts(s), covered)))
    return let(ws, lambda w: F.when(F.size(w) > size, let(hashes(w), counted)).otherwise(F.lit(0))).cast("long")


@dataclass(frozen=True)
class Rule:
    """rejects: from a text column and its words to a boolean."""

    name: str
    rejects: Callable[[Column, Column], Column]


# Fixed limits of the rules; shares are written as products of whole numbers.
RULES = (
    Rule("too_short", lambda t, w: F.size(w) < 50),
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w)),
    Rule("repeated_lines", lambda t, w: let(lines(t), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))),
    Rule("word_length", lambda t, w: let(word_chars(w), lambda n: (n < 2 * F.size(w)) | (n > 15 * F.size(w)))),
    Rule("shouting", lambda t, w: 10 * letters(t, CAPITALS) > 3 * word_chars(w)),
    Rule("repeated_words", lambda t, w: 100 * repeated_in(w) > 50 * F.size(w)),
)


@dataclass(frozen=True)
class Estimates:
    """seconds: what each rule costs on the sample; rows: how many rows each set of rejecting rules has."""

    seconds: dict[str, float]
    rows: dict[frozenset[str], int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Estimates:
    """Cost of each rule, and which rules reject, on a sample of about sample_rows rows."""
    n = docs.count()
    if not n:
        return Estimates({r.name: 0.0 for r in rules}, {})
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    sample = docs.select(text.alias("text")).sample(min(1.0, sample_rows / n), seed=7)
    sample = written(sample.withColumn("ws", words(F.col("text"))), "quality-sample")
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    fields = [clock().alias("t0")]
    for k, r in enumerate(rules):
        fields += [r.rejects(sample["text"], sample["ws"]).alias(f"r{k}"), clock().alias(f"t{k + 1}")]
    # Behind inline() the struct is made as it stands, field by field.
    timed = sample.select(F.inline(F.array(F.struct(*fields))))
    took = [F.sum(F.col(f"t{k + 1}") - F.col(f"t{k}")).alias(f"s{k}") for k in range(len(rules))]
    sets = timed.groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count("*").alias("n"), *took).collect()  # 2 ** rules rows at most
    rows = {frozenset(r.name for k, r in enumerate(rules) if x[f"r{k}"]): x["n"] for x in sets}
    return Estimates({r.name: sum(x[f"s{k}"] for x in sets) / 1e9 for k, r in enumerate(rules)}, rows)


def ordered(found: Estimates, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Each time the rule with most rejections per second among the rows left. Costs count in powers of two from a millisecond on; ties as listed."""
    cost = {name: 2 ** math.ceil(math.log2(max(s, 1e-3) * 1e3)) for name, s in found.seconds.items()}
    left, out, rows = list(rules), [], dict(found.rows)
    while left:
        rate = lambda r: sum(n for names, n in rows.items() if r.name in names) / cost.get(r.name, 1)
        best = max(left, key=rate)
        out.append(best)
        left.remove(best)
        rows = {names: n for names, n in rows.items() if best.name not in names}
    return out


def cascade(text: Column, ws: Column, rules: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects, else null; later rules aren't evaluated."""
    first, *rest = rules
    case = F.when(first.rejects(text, ws), F.lit(first.name))
    for r in rest:
        case = case.when(r.rejects(text, ws), F.lit(r.name))
    return case


def verdict(text: Column, rules: list[Rule]) -> Column:
    """The cascade over a text, which is split into words once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(words(text), lambda ws: cascade(text, ws, rules))


def filter_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows that no rule rejects, with all their columns."""
    order = ordered(estimate(docs, rules, text_col), rules)
    return docs.filter(verdict(docs[text_col], order).isNull())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of each text, and the cascade's verdict.

    base_failed: under 50 words, or over half of the words repeat; kept: not base_failed and rejected by no rule. Rules that the counts don't
    settle are evaluated in the cascade's order, and only for rows that are left.
    """
    order = ordered(estimate(docs, RULES, text_col))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    counts = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), word_chars(ws).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), repeated_in(ws).alias("n_repeat_words")))
    n = lambda c, name: c[name]
    known = {
        "too_short": lambda c: n(c, "n_words") < 50,
        "symbols": lambda c: 10 * n(c, "n_symbols") > n(c, "n_words"),
        "word_length": lambda c: (n(c, "word_chars") < 2 * n(c, "n_words")) | (n(c, "word_chars") > 15 * n(c, "n_words")),
        "repeated_words": lambda c: 100 * n(c, "n_repeat_words") > 50 * n(c, "n_words"),
        "repeated_lines": lambda c: (n(c, "n_dup_lines") > 0) & (10 * n(c, "n_dup_lines") > 3 * n_lines(text)),
        "shouting": lambda c: 10 * letters(text, CAPITALS) > 3 * n(c, "word_chars"),
    }

    def judged(c: Column) -> Column:
        failed = known["too_short"](c) | known["repeated_words"](c)
        case = F.when(failed, F.lit(False))
        for r in order:
            case = case.when(known[r.name](c), F.lit(False))
        return F.struct(*[n(c, x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), case.otherwise(F.lit(True)).alias("kept"))

    return rows.select("doc_id", F.inline(F.array(let(counts, judged))))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v ON v.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * caps > 3 * word_chars) AS kept
FROM m
"""
