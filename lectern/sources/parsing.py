"""Contents of single files, as rows: what the readers and the data source share."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

#: Encodings that a text is tried in; bytes that none fits are replaced.
ENCODINGS = ("utf-8-sig", "utf-16")


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text of a file: a mark says UTF-16, else UTF-8 with or without a mark, else the next encoding that fits."""
    order = ("utf-16", *encodings) if content[:2] in (b"\xff\xfe", b"\xfe\xff") else encodings
    for name in order:
        if name == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def records(text: str) -> Iterator[list[str]]:
    """Records of CSV, whose quoted fields may have commas, quotes and line breaks; empty lines are none."""
    csv.field_size_limit(1 << 30)
    return (row for row in csv.reader(io.StringIO(text, newline="")) if row)


def article(text: str) -> tuple[str, str]:
    """(title, text) of a CSV file with an article: its first row, and of its columns the first whose name has title, and news, body or article."""
    rows = records(text)
    names = [n.strip().lower() for n in next(rows, [])]
    values = next(rows, [])
    at = lambda *words: next((values[k] if k < len(values) else "" for k, n in enumerate(names) if any(w in n for w in words)), "")
    return at("title"), at("news", "body", "article")


def stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])


def rttm(text: str) -> Iterator[tuple[str, float | None, float | None, str]]:
    """(episode, start, end, label) of SPEAKER lines with eight fields or more; numbers that can't be read are null."""

    def number(x: str) -> float | None:
        try:
            return float(x)
        except ValueError:
            return None

    for line in text.splitlines():
        f = line.split()
        if len(f) >= 8 and f[0] == "SPEAKER":
            start, length = number(f[3]), number(f[4])
            yield f[1], start, None if start is None or length is None else start + length, f[7]


def document(text: str) -> dict | None:
    """A JSON object, or None where the text is none."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None
