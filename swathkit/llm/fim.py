"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut at two unit boundaries (lines, words or characters) into prefix, middle and suffix, which change places around
three marks. Units are counted in one pass over the UTF-8 bytes, a chunk at a time; every ``every`` units the byte and
code-point offsets are recorded. A cut is found by binary search among these checkpoints and a short rescan from the one
before it, so the index of a text of n units has n / ``every`` entries, and no list of units is ever made.

No shuffle, no state between rows: a lost executor's rows are simply cut again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVERY = 256
CHUNK = 1 << 16
FLUSH_BYTES = 8 << 20
MARKS = ("<P>", "<S>", "<M>")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _starts(a: np.ndarray, before: int | None, unit: str) -> np.ndarray:
    """Where in the bytes ``a`` a unit starts; ``before`` is the byte in front of them (None: the text starts here)."""
    if unit == "char":
        return (a & 0xC0) != 0x80
    mark = np.empty(len(a), bool)
    if unit == "line":  # a line ends after its newline
        mark[1:] = a[:-1] == 10
        mark[0] = before is None or before == 10
    elif unit == "word":  # a word takes the white space after it; that in front of the first word is a unit of its own
        space = _SPACE[a]
        mark[1:] = space[:-1] & ~space[1:]
        mark[0] = before is None or (_SPACE[before] and not space[0])
    else:
        raise ValueError(f"unknown unit: {unit}")
    return mark


class Checkpoints:
    """Offsets of every ``every``-th unit of a text: ``units``, ``bytes`` and ``chars`` ascend together; the last entry is the text's end."""

    def __init__(self, text: bytes, unit: str = "line", every: int = EVERY, chunk: int = CHUNK):
        self.text, self.unit, self.chunk = text, unit, chunk
        self.units, self.bytes, self.chars = [0], [0], [0]
        units = chars = 0
        for at in range(0, len(text), chunk):
            a = np.frombuffer(text, np.uint8, min(chunk, len(text) - at), at)
            where = np.flatnonzero(_starts(a, text[at - 1] if at else None, unit))
            told = np.arange(-units % every, len(where), every)
            if len(told):
                points = np.cumsum((a & 0xC0) != 0x80)
                for k in told:
                    place = int(where[k])
                    if at + place:
                        self.units.append(units + int(k))
                        self.bytes.append(at + place)
                        self.chars.append(chars + (int(points[place - 1]) if place else 0))
                chars += int(points[-1])
            else:
                chars += int(np.count_nonzero((a & 0xC0) != 0x80))
            units += len(where)
        self.n, self.n_chars = units, chars
        self.units.append(units)
        self.bytes.append(len(text))
        self.chars.append(chars)

    def seek(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit starts; unit ``n`` starts at the end of the text."""
        if not 0 <= unit <= self.n:
            raise ValueError(f"unit {unit} of {self.n}")
        k = bisect_right(self.units, unit) - 1
        if self.units[k] == unit:
            return self.bytes[k], self.chars[k]
        left, at, chars = unit - self.units[k], self.bytes[k], self.chars[k]
        fresh = True  # the checkpoint's own unit starts here and isn't one of those left
        while True:
            a = np.frombuffer(self.text, np.uint8, min(self.chunk, len(self.text) - at), at)
            starts = _starts(a, self.text[at - 1] if at else None, self.unit)
            if fresh:
                starts[0] = fresh = False
            where = np.flatnonzero(starts)
            if len(where) >= left:
                place = int(where[left - 1])
                return at + place, chars + int(np.count_nonzero((a[:place] & 0xC0) != 0x80))
            left -= len(where)
            chars += int(np.count_nonzero((a & 0xC0) != 0x80))
            at += len(a)


def draws(seed: int | str, doc_id) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``, as unsigned numbers; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _check_marks(marks: tuple[str, str, str]) -> None:
    for a in marks:
        for b in marks:
            if not a or (a is not b and (a in b or b in a)) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("marks must not overlap one another")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", seed: int | str = 7, fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS, every: int = EVERY) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each row.

    The cuts are at units h1 % (n + 1) and h2 % (n + 1), with ``draws(seed, id)``. A row is plain, its text unchanged, if
    the text is empty or null, holds a mark, or isn't drawn (h3 % 100 >= ``fim_percent``); otherwise it is spm if h4 % 100
    < ``spm_percent``, else psm. Repeated rows repeat (the id decides, so they are cut alike), an empty table stays empty,
    texts of any length are cut whole, other columns are ignored.
    """
    _check_marks(marks)
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    p, s, m = (x.encode() for x in marks)

    def cut(doc_id, text: bytes) -> tuple:
        index = Checkpoints(text, unit, every)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or p in text or s in text or m in text or h3 % 100 >= fim_percent:
            return index.n, "plain", None, None, text
        first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (b0, c0), (b1, c1) = index.seek(first), index.seek(second)
        view = memoryview(text)
        if h4 % 100 < spm_percent:
            return index.n, "spm", c0, c1 - c0, b"".join((s, view[b1:], p, view[:b0], m, view[b0:b1]))
        return index.n, "psm", c0, c1 - c0, b"".join((p, view[:b0], s, view[b1:], m, view[b0:b1]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start, held, rows = 0, 0, []
            for k in range(len(batch)):
                rows.append(cut(ids[k].as_py(), texts[k].as_py() or b""))
                held += len(rows[-1][4])
                if held >= FLUSH_BYTES or k == len(batch) - 1:
                    n, form, before, middle, output = zip(*rows)
                    told = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *told], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    start, held, rows = k + 1, 0, []

    return kept.mapInArrow(batches, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS):
    """The text before the cut, from output and form alone. Pieces hold no mark, so three marks split the output."""
    _check_marks(marks)
    quoted = "|".join("".join(f"\\x{ord(c):02x}" if ord(c) < 128 else c for c in x) for x in marks)
    parts = F.split(F.col(output), quoted, 4)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
