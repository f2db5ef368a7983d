"""Scalar functions over transcript text, as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of retrieval normalisation, replaced one after another wherever they stand.
SEARCH_REPLACEMENTS = (
    ("ব্যাঙ্ক", "ব্যাংক"),
    ("ব্যাংকিং", "ব্যাংক"),
    ("রেমিটেন্স", "রেমিট্যান্স"),
    ("রেমিটেন্যান্স", "রেমিট্যান্স"),
    ("banking sector", "ব্যাংক খাত"),
    ("bank sector", "ব্যাংক খাত"),
    ("banking", "ব্যাংক"),
    ("remittances", "remittance"),
    ("remittance", "রেমিট্যান্স"),
    ("central bank", "বাংলাদেশ ব্যাংক"),
    ("inflation", "মূল্যস্ফীতি"),
    ("imports", "আমদানি"),
    ("import", "আমদানি"),
    ("exports", "রপ্তানি"),
    ("export", "রপ্তানি"),
)
# Fixed value: dependent signs with which no whole word begins.
DEPENDENT_SIGNS = "ািীুূৃেৈোৌ্ৗ়"
# Fixed value: characters that a transcript must not hide.
HIDDEN = r"[​-‏‪-‮⁠-⁯﻿]"
# Fixed value: programmes told by their titles, first match wins.
PROGRAMMES = ("atn business", "business talk", "money talks", "business times", "star biz", "stream talk", "the business review", "30 minutes", "muktobak", "business & finance")
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
# Fixed value: characters that noise puts in.
NOISE = "অআইঈউঊএঐওঔকখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহ"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x).casefold())


def _beyond_ascii(c: Column) -> Column:
    """The text if it has other characters than ASCII, else null: only such texts go to Python."""
    return F.when(F.length(c) != F.octet_length(c), c)


def nfc(c: Column) -> Column:
    """Unicode normal form C; Spark has no such function."""
    return F.coalesce(_nfc(_beyond_ascii(c)), c)


def nfc_casefold(c: Column) -> Column:
    return F.coalesce(_nfc_casefold(_beyond_ascii(c)), F.lower(c))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit("")))).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normalize_text(c: Column) -> Column:
    """For retrieval: composed, case-folded, replacements, and only letters, digits and underscores."""
    out = nfc_casefold(F.coalesce(c, F.lit("")))
    for source, target in SEARCH_REPLACEMENTS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return collapse(F.regexp_replace(out, r"[^\p{L}\p{N}_ঀ-৿]+", " "))


def normalize_draft(c: Column) -> Column:
    """For transcripts: composed, no hidden characters, single spaces."""
    return collapse(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), HIDDEN, ""))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, BANGLA_DIGITS, "0123456789")


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS under an hour; negative ones are 0."""
    s = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    short = F.format_string("%02d:%02d", F.expr("0") + F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600).cast("long")), short)).otherwise(short)


def safe_double(c: Column, default: float = 0.0) -> Column:
    """A finite number or the default."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf"))), F.lit(default)).otherwise(x)


def speaker_label(speaker: Column) -> Column:
    return F.when(speaker < 0, "Unassigned").otherwise(F.concat(F.lit("Speaker "), speaker.cast("string")))


def longest_run(ts: Column) -> Column:
    """Most equal neighbours in an array of tokens."""
    start = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("r"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x.eqNullSafe(a["p"]), a["r"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("p"), run.alias("r"), F.greatest(a["m"], run).alias("m"))

    return F.aggregate(ts, start, step, lambda a: a["m"]).cast("long")


def unique_share(ts: Column) -> Column:
    """Distinct tokens by tokens; 1 for none."""
    return F.when(F.size(ts) > 0, F.size(F.array_distinct(ts)) / F.size(ts)).otherwise(F.lit(1.0))


def is_loop(ts: Column) -> Column:
    """A token four times in a row, or 20 words and more of which under 35 % are distinct."""
    return (longest_run(ts) >= 4) | ((F.size(ts) >= 20) & (unique_share(ts) < 0.35))


def collapse_loops(ts: Column) -> Column:
    """At most two equal neighbours are kept."""
    return F.filter(ts, lambda x, i: ~((i >= 2) & F.coalesce((x == F.get(ts, i - 1)) & (x == F.get(ts, i - 2)), F.lit(False))))


def leading_truncated(c: Column) -> Column:
    return c.rlike(f"^[{DEPENDENT_SIGNS}]")


def drop_leading_fragment(c: Column) -> Column:
    """Without the first word if it begins with a dependent sign."""
    return F.when(leading_truncated(c), F.ltrim(F.regexp_replace(c, r"^\S+", ""))).otherwise(c)


def programme_key(title: Column) -> Column:
    low = F.lower(title)
    rest = F.substring(F.regexp_replace(low, r"[^a-zঀ-৿]+", ""), 1, 24)
    out = F.when(rest == "", "unknown").otherwise(rest)
    for name in reversed(PROGRAMMES):
        out = F.when(low.contains(name), name).otherwise(out)
    return out


def turn_bucket(n: Column) -> Column:
    return F.when(n <= 4, "1-4 turns").when(n <= 12, "5-12 turns").otherwise("13+ turns")


def duration_flag(seconds: Column) -> Column:
    """rejected, short, ok or long."""
    return F.when((seconds < 600) | (seconds > 5400), "rejected").when(seconds < 1800, "short").when(seconds > 3600, "long").otherwise("ok")


def time_range(start: Column, end: Column) -> Column:
    """start–end as timestamps."""
    return F.concat(format_timestamp(start), F.lit("–"), format_timestamp(end))


# Words of file names that say what an episode has.
REMOTE_WORDS = ("remote", "guest", "嘉宾", "অতিথি")
MARKET_WORDS = ("market", "trade", "investment", "share", "stock", "বাজার", "বিনিয়োগ")


def filename_metadata(stem: Column) -> Column:
    """(programme, has_remote_guest, covers_market_news) from a file's name: words between _, - and white space; a leading number is cut."""
    words = F.filter(F.split(stem, r"[_\-\s]+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    numbered = F.get(words, F.lit(0)).rlike("^[0-9]+$") & (F.size(words) > 1)
    has = lambda names: F.arrays_overlap(low, F.array(*[F.lit(n) for n in names]))
    programme = F.when(numbered, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(stem)
    return F.struct(programme.alias("programme"), has(REMOTE_WORDS).alias("has_remote_guest"), has(MARKET_WORDS).alias("covers_market_news"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(c: Column, query: str, variants: dict[str, str] | None = None) -> Column:
    """Escaped text with the query's tokens and their other spellings marked, longest first, any case."""
    import re

    found = {t for t in query.split() if len(t) > 1}
    found |= {o for w, o in (variants or {}).items() if w in found}
    found = sorted(found, key=lambda t: (-len(t), t))
    out = html_escape(c)
    return F.regexp_replace(out, "(?i)(" + "|".join(map(re.escape, found)) + ")", "<mark>$1</mark>") if found else out


def preview(c: Column, most: int = 220) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def stance_label(polar_share: Column, score: Column, floor: float = 0.15, band: float = 0.34) -> Column:
    """Neutral if few turns are polar, mixed near zero, else by sign."""
    return F.when(polar_share < floor, "neutral").when(F.abs(score) < band, "mixed").when(score > 0, "positive").otherwise("negative")


def direction(label: Column) -> Column:
    return F.when(label == "neutral", "neither").when(label == "mixed", "both").otherwise(label)


def contribution_state(audio: Column, bundles: Column, episodes: Column) -> Column:
    found = F.when(bundles > 0, "Searchable").otherwise("Searchable (no bundle)")
    return F.when(episodes > 0, found).when(bundles > 0, "Bundle present, no fused transcripts").when(audio > 0, "Source audio only, pipeline not run").otherwise("Folder empty")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Of an array of doubles."""
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(xs: Column) -> Column:
    """Place of the first greatest element, from 0."""
    return F.array_position(xs, F.array_max(xs)) - 1


def decode_multilabel(p: Column, threshold: float) -> Column:
    """Chosen places of an array of probabilities, two (positive, negative) for each target.

    Of each target the likelier polarity if it reaches the threshold (ties: the first); if none does, the greatest of all.
    """
    place = F.sequence(F.lit(0), F.size(p) - 1)
    mate = lambda i: F.when(i % 2 == 0, i + 1).otherwise(i - 1)
    better = lambda i: (F.get(p, i) > F.get(p, mate(i))) | ((F.get(p, i) == F.get(p, mate(i))) & (i % 2 == 0))
    fired = F.filter(place, lambda i: (F.get(p, i) >= threshold) & better(i))
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(argmax(p).cast("int")))


def mean_confidence(words: Column) -> Column:
    """Mean of the finite `prob` of an array of words; null without any."""
    good = F.filter(F.transform(words, lambda w: w["prob"]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, b: a + b) / F.size(good))


def segment_confidence(words: Column, confidence: Column) -> Column:
    return F.coalesce(mean_confidence(words), confidence, F.lit(1.0))


def build_input(text: Column, previous: Column, role: Column, mode: str) -> Column:
    """(head, text) for a pair classifier in one of four modes."""
    has = F.coalesce(previous, F.lit("")) != ""
    heads = {"plain": F.lit(None).cast("string"), "role_turn": role, "context": F.when(has, collapse(previous)).otherwise(role), "role_context": F.when(has, F.concat_ws(" ", role, collapse(previous))).otherwise(role)}
    return F.struct(heads[mode].alias("head"), collapse(text).alias("text"))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; an empty reference costs 1 unless the hypothesis is empty too."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


#: Letters that stand for the words of two texts while they are compared.
ALPHABET = "".join(map(chr, [*range(0x3400, 0xA000), *range(0xAC00, 0xD7A4)]))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance over words: each distinct word becomes a letter, so that the distance of strings serves. At most as many distinct words as ALPHABET has letters."""
    x, y = tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit("")))

    def spelt(p: Column) -> Column:
        many = F.size(p["names"]) > len(ALPHABET)
        letters = lambda ts: F.array_join(F.transform(ts, lambda w: F.substring(F.lit(ALPHABET), F.array_position(p["names"], w).cast("int"), F.lit(1))), "")
        return F.when(many, F.raise_error("too many distinct words").cast("int")).otherwise(F.levenshtein(letters(p["x"]), letters(p["y"])))

    pair = F.struct(x.alias("x"), y.alias("y"), F.array_union(x, y).alias("names"))
    return F.transform(F.array(pair), spelt)[0].cast("long")


def wer(reference: Column, hypothesis: Column, capped: bool = True) -> Column:
    """Word error rate, at most 1 if capped; an empty reference costs 1 unless the hypothesis is empty too."""
    n = word_count(reference)
    rate = token_distance(reference, hypothesis) / n
    return F.when(n == 0, F.when(word_count(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), rate) if capped else rate)


def edit_rate(a: Column, b: Column) -> Column:
    """Edit distance by the longer text's words; 0 for two empty ones, 1 if only the first is empty."""
    n, m = word_count(a), word_count(b)
    return F.when(n == 0, F.when(m == 0, 0.0).otherwise(1.0)).otherwise(token_distance(a, b) / F.greatest(n, m))


def encode_pair(surfaces: Column, text: Column) -> Column:
    """Distinct surfaces in order, then the text, between bars."""
    return F.concat(F.array_join(F.array_distinct(surfaces), " "), F.lit(" ‖ "), text)


def inject_noise(ts: Column, key: Column, percent: int | Column, seed: int = 0) -> Column:
    """Tokens of which about `percent` in 100 lose, swap, repeat or change a character, told by a hash of key, place and seed.

    A random generator's sequence would depend on how rows are dealt; the hash gives every row the same noise wherever it is made.
    """
    number = lambda i, what: F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(str(seed)), F.lit(what)).cast("binary")), 1, 7), 16, 10).cast("long")

    def change(x: Column, i: Column) -> Column:
        at = (number(i, "place") % F.length(x) + 1).cast("int")  # of the character, from 1
        head, tail = F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.length(x))
        own = F.substring(x, at, F.lit(1))
        swapped = F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), own, F.substring(tail, F.lit(2), F.length(x)))
        new = F.substring(F.lit(NOISE), (number(i, "new") % len(NOISE) + 1).cast("int"), F.lit(1))
        kind = number(i, "kind") % 4
        made = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, swapped).when(kind == 2, F.concat(head, own, own, tail)).otherwise(F.concat(head, new, tail))
        return F.when(number(i, "hit") % 100 < percent, made).otherwise(x)

    return F.transform(ts, change)
