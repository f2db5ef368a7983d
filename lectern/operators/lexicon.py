"""Lexicon operators: entity restoration, target mentions and scored pairs."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
WINDOW, DECISION = 12, 0.55  # fixed values: tokens between cue and mention, least score of a polar pair
NEGATORS = frozenset({"না", "নয়", "নেই", "নাই", "নাহ", "কখনো"})  # fixed values


#: Up to so many aliases are replaced by expressions of their own; more by one automaton for all. Both do the same.
FEW = 8


def word_border(alias: str) -> str:
    return f"(?<![{WORD}]){re.escape(alias)}(?![{WORD}])"


def restore_entities(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Whole-word aliases to their canonical names, longest alias first, later ones on what earlier ones made; ASCII ones in any case. An empty alias is none."""
    aliases = [a for a in aliases if a[0]]
    if len(aliases) > FEW:
        held = Aliases(aliases)

        @F.pandas_udf("string")
        def restored(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else held.restore(t))

        return restored(text)
    for alias, name in sorted(aliases, key=lambda a: -len(a[0])):
        flag = "(?i)" if alias.isascii() else ""
        text = F.regexp_replace(text, flag + word_border(alias), name.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def restored_hits(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Aliases that occur as whole words, in their order."""
    if len(aliases) > FEW:
        held = Aliases(aliases)

        @F.pandas_udf("array<string>")
        def hits(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [] if t is None else held.hits(t))

        return hits(text)
    found = [F.when(text.rlike(("(?i)" if a.isascii() else "") + word_border(a)), F.lit(a)) for a, _ in aliases]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Aliases:
    """Aliases and their names behind one Aho-Corasick automaton: a text is read once, however many aliases there are.

    The rule stays one after another, longest alias first: of the aliases that stand in a text the first is replaced, and only then, as
    the replacement may have made or broken others, the text is read again for those that come later. Texts without an alias are read once.
    """

    def __init__(self, aliases: list[tuple[str, str]]):
        self.given = [a for a, _ in aliases]
        self.ordered = sorted(aliases, key=lambda a: -len(a[0]))
        self.folded = [a.translate(ASCII_LOWER) if a.isascii() else None for a, _ in self.ordered]
        self.automata: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "automata": None}  # each worker builds its own

    def built(self) -> tuple:
        """Automata of aliases in any case and of those as they stand, each from a text to the first that has it."""
        if self.automata is None:
            import ahocorasick

            any_case, exact = {}, {}
            for k, (alias, _) in enumerate(self.ordered):
                (exact if self.folded[k] is None else any_case).setdefault(self.folded[k] or alias, []).append(k)
            made = []
            for words in (any_case, exact):
                automaton = ahocorasick.Automaton()
                for word, own in words.items():
                    if word:
                        automaton.add_word(word, (len(word), own))
                automaton.make_automaton()
                made.append(automaton if len(automaton) else None)
            self.automata = tuple(made)
        return self.automata

    def present(self, text: str) -> set[int]:
        """Aliases that stand in a text as whole words, by their places in the order."""
        found: set[int] = set()
        for automaton, read in zip(self.built(), (text.translate(ASCII_LOWER), text), strict=True):
            for end, (size, own) in automaton.iter(read) if automaton is not None else ():
                a, b = end - size + 1, end + 1
                if not (a and is_word(text[a - 1])) and not (b < len(text) and is_word(text[b])):
                    found.update(own)
        return found

    def replaced(self, text: str, k: int) -> str:
        """The text with alias k, wherever it is a whole word, from left to right."""
        alias, name = self.folded[k] or self.ordered[k][0], self.ordered[k][1]
        read = text.translate(ASCII_LOWER) if self.folded[k] is not None else text
        out, at, a = [], 0, read.find(alias)
        while a >= 0:
            b = a + len(alias)
            if not (a and is_word(text[a - 1])) and not (b < len(text) and is_word(text[b])):
                out += [text[at:a], name]
                at, a = b, read.find(alias, b)
            else:
                a = read.find(alias, a + 1)
        return "".join([*out, text[at:]])

    def restore(self, text: str) -> str:
        done = -1
        while True:
            left = [k for k in self.present(text) if k > done]
            if not left:
                return text
            done = min(left)
            text = self.replaced(text, done)

    def hits(self, text: str) -> list[str]:
        found = {self.ordered[k][0] for k in self.present(text)}
        return [a for a in self.given if a in found]


class Beginnings:
    """Which of many stems a token begins with, by their numbers."""

    def __init__(self, stems: list[str]):
        self.by: dict[str, list[int]] = {}
        for k, s in enumerate(stems):
            self.by.setdefault(s, []).append(k)
        self.sizes = sorted({len(s) for s in stems})

    def of(self, token: str) -> list[int]:
        found = [k for n in self.sizes if n <= len(token) for k in self.by.get(token[:n], ())]
        return sorted(found)


class Lexicon:
    """Targets (canonical, stems, exclude, orientation) and cues (stem, kind, polarity, weight, negatable, exclude), made ready for scanning.

    A token is looked up by its beginnings of the lengths that stems have, so that a text costs the same however many stems there are; everything else is
    decided on the few tokens that begin with one.
    """

    def __init__(self, targets: list[dict], cues: list[dict]):
        self.orientation = {t["canonical"]: t.get("orientation", 0) for t in targets}
        stems = sorted(((s, t) for t in targets for s in t["stems"]), key=lambda x: -len(x[0]))
        self.stems = [(re.compile(r"\s+".join(map(re.escape, s.split())) + r"\S*"), t["canonical"], tuple(t.get("exclude", ()))) for s, t in stems]
        self.first = Beginnings([s.split()[0] for s, _ in stems])
        self.cues = cues
        self.cue = Beginnings([c["stem"] for c in cues])

    def mentions(self, text: str) -> list[tuple[str, str, int, int]]:
        """(canonical, surface, start, end) in characters, in order of their starts.

        Longer stems come first; a mention that lies inside one that is there already is none, one that only overlaps it is. A stem's
        exclusions are beginnings of words that it doesn't mean.
        """
        places: list[tuple[int, int]] = []
        for m in re.finditer(r"\S+", text):
            places += [(k, m.start()) for k in self.first.of(m.group())]
        spans, out, last = [], [], {}
        for k, start in sorted(places):
            pattern, name, exclude = self.stems[k]
            m = pattern.match(text, start) if start >= last.get(k, 0) else None
            if m is None:
                continue
            last[k] = m.end()
            inside = any(a <= m.start() and m.end() <= b for a, b in spans)
            word = m.group()
            other = any(word.startswith(x) and not re.search(r"\s", word[len(x) :]) for x in exclude)
            if not inside and not other:
                spans.append(m.span())
                out.append((name, word, *m.span()))
        return sorted(out, key=lambda x: x[2])

    def score(self, text: str, orientation: int, starts: list[int]) -> float:
        """Sum of cues within WINDOW tokens of the tokens in which mentions begin (starts, in characters).

        Of a token's cues the first one counts that has no exclusion and, for a direction, whose target has an orientation, which it is multiplied
        by. A negator among the next three tokens turns the sign of what can be negated; distance weakens.
        """
        if not self.cues or not starts:
            return 0.0
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        begins = [a for a, _ in tokens]
        at = sorted({bisect_right(begins, s) - 1 for s in starts})
        total = 0.0
        for i, (begin, end) in enumerate(tokens):
            token = text[begin:end]
            mine = self.cue.of(token)
            if not mine:
                continue
            k = bisect_right(at, i)
            distance = min(abs(i - t) for t in at[max(0, k - 1) : k + 1])
            if distance > WINDOW:
                continue
            fits = (c for c in map(self.cues.__getitem__, mine) if not any(token.startswith(x) for x in c.get("exclude", ())) and (c["kind"] != "direction" or orientation))
            cue = next(fits, None)
            if cue is None:
                continue
            value = cue["polarity"] * cue["weight"] * (orientation if cue["kind"] == "direction" else 1)
            if cue.get("negatable", True) and any(text[a:b] in NEGATORS for a, b in tokens[i + 1 : i + 4]):
                value = -value
            total += value / (1 + distance / 4)
        return total


def verdict(score: Column) -> Column:
    return F.when(score >= DECISION, "positive").when(score <= -DECISION, "negative").otherwise("non_evaluative")


def target_pairs(rows: DataFrame, key: str, text: str, targets: list[dict], cues: list[dict]) -> DataFrame:
    """key, target, n_mentions, score and verdict for each target that a text mentions. Lexicons are short lists; each text is read by itself.

    Only texts in which some stem stands go to Python.
    """
    lexicon = Lexicon(targets, cues)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                by: dict[str, list[int]] = {}
                for name, _, a, _b in lexicon.mentions(t):
                    by.setdefault(name, []).append(a)
                out += [(k, n, len(m), lexicon.score(t, lexicon.orientation[n], m)) for n, m in by.items()]
            yield pd.DataFrame(out, columns=[key, "target", "n_mentions", "score"])

    kind = rows.schema[key].dataType.simpleString()
    stems = {s.split()[0] for t in targets for s in t["stems"]}
    # A few stems are looked for before texts leave the JVM.
    may = reduce(lambda a, b: a | b, [F.col(text).contains(s) for s in sorted(stems)], F.lit(False)) if len(stems) <= FEW else F.col(text).isNotNull()
    return rows.select(key, text).filter(may).mapInPandas(run, f"{key} {kind}, target string, n_mentions long, score double").withColumn("verdict", verdict(F.col("score")))
