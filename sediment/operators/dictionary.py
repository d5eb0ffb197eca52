"""Many terms looked for in one pass over a text: an Aho-Corasick automaton over Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the terms that one automaton takes; longer lists go in several passes over the texts.
MOST_CHARS = 1 << 25

HIT = "index int, term string, label string, start int, value string"


@lru_cache(maxsize=4)
def automaton(spellings: tuple[str, ...]) -> ahocorasick.Automaton:
    """Once in each Python worker for each list of terms."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, s in enumerate(spellings):
        made.add_word(s, i)
    made.make_automaton()
    return made


def in_word(c: str) -> bool:
    """A letter or a digit of any script."""
    return c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "LN"


def bounded(text: str, start: int, end: int) -> bool:
    return not (start and in_word(text[start - 1])) and not (end < len(text) and in_word(text[end]))


def passes(entries: list[tuple[str, str]], most: int = MOST_CHARS) -> list[list[tuple[int, str, str]]]:
    """The entries with their numbers, in runs of at most most characters."""
    out: list[list[tuple[int, str, str]]] = []
    size = 0
    for i, (term, label) in enumerate(entries):
        if not term:
            raise ValueError("a term is empty")
        if not out or size + len(term) > most:
            out.append([])
            size = 0
        out[-1].append((i, term, label))
        size += len(term)
    return out


def found(rows: DataFrame, text: str, entries: list[tuple[str, str]], whole_words: bool = True, once: bool = False) -> DataFrame:
    """A row for each place where a term of entries (term, label) stands in the text: the other columns of rows, and
    index (from 0 in each row, by the order of entries, then by place), term, label, start (in characters) and value as written.

    Letters A-Z count as lower-case ones in terms and texts. whole_words: no letter or digit may stand next to a
    match. Places of one term don't overlap; those of different terms may. once: only the first place of each term.
    A null or empty text has no places. The time follows the text and what is found, not the number of terms;
    columns of rows that are named as the added ones are taken over.
    """
    schema = T.StructType.fromDDL(HIT)
    rest = rows.drop(text, *schema.fieldNames())
    names, out = rest.columns, None
    spelt_as = lambda t: t.encode().lower().decode()  # noqa: E731  A-Z only
    for part in passes(entries):
        same: dict[str, list[tuple[int, str, str]]] = {}
        for e in part:
            same.setdefault(spelt_as(e[1]), []).append(e)
        spellings, meant = tuple(same), list(same.values())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(spellings)
            for b in batches:
                hits: list[tuple] = []
                of: list[int] = []
                for row, cell in enumerate(b.column("_text")):
                    if (data := cell.as_py()) is None:
                        continue
                    low, last, here = data.lower().decode(), {}, []
                    for end, k in machine.iter(low):
                        start = end + 1 - len(spellings[k])
                        if start < last.get(k, 0) or (once and k in last) or (whole_words and not bounded(low, start, end + 1)):
                            continue
                        last[k] = end + 1
                        here += [(no, term, label, start, end + 1) for no, term, label in meant[k]]
                    if here:
                        here.sort(key=lambda h: (h[0], h[3]))
                        whole = data.decode()
                        hits += [(i, term, label, start, whole[start:end]) for i, (_, term, label, start, end) in enumerate(here)]
                        of += [row] * len(here)
                if hits:
                    added = [pa.array(c, pa.int32() if f.dataType.simpleString() == "int" else pa.string()) for c, f in zip(zip(*hits), schema)]
                    kept = pa.RecordBatch.from_arrays([b.column(c) for c in names], names).take(pa.array(of)) if names else None
                    yield pa.RecordBatch.from_arrays([*(kept.columns if names else []), *added], [*names, *schema.fieldNames()])

        one = rows.select(*names, F.col(text).cast("binary").alias("_text")).mapInArrow(scan, T.StructType([*rest.schema.fields, *schema.fields]))
        out = one if out is None else out.union(one)
    return out if out is not None else rest.select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).limit(0)
