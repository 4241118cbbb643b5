"""Language identification by rank-order profiles (operator 3).

A profile is the list of the PROFILE most frequent n-grams of one to three letters, words being bounded by a space, of which an n-gram has one at most. A
language's profile is counted over all its training texts; a document's language is that whose profile is nearest by
the out-of-place distance: the sum over the document's n-grams of how far their ranks differ, PROFILE for one that the
language's profile lacks.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the language that sorts
first, ties between n-grams to the smaller code points; rows with null language are never learned from; if nothing
can be learned every text is ``und``; equal rows get equal rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
#: More languages than this are an error: their profiles, 5 kB each, are held by the driver and by every worker. (There are some 8,000.)
MOST_LANGUAGES = 20_000
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16))
    low = points < 1 << 16
    out = np.zeros(len(points), dtype=bool)
    out[low] = _LETTERS[0][points[low]]
    if not low.all():
        high = np.unique(points[~low])
        letters = np.array([chr(int(p)).isalpha() for p in high])
        out[~low] = letters[np.searchsorted(high, points[~low])]
    return out


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, 21 bits a letter; a space bounds each word and never stands inside an n-gram."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    letter = _is_letter(points)
    points[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points, letter = points[keep], letter[keep]
    two = (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    return np.concatenate([points[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1] & (letter[:-2] | letter[2:])]])


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found.sort()
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
    return found[starts], np.diff(np.append(starts, len(found)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` keys of largest count, ties by key; ``keys`` are sorted."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        sure = counts >= least
        keys, counts = keys[sure], counts[sure]
    return keys[np.argsort(-counts, kind="stable")][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) over all texts of the task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    def flush(lang: str, texts: list[str]) -> None:
        parts = held.setdefault(lang, [])
        parts.append(counted(np.concatenate([grams(t) for t in texts])))
        if len(parts) > 16:
            held[lang] = [merged(parts)]

    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            some, size = [], 0
            for t in texts:
                some.append(t)
                size += len(t)
                if size > 2_000_000:
                    flush(lang, some)
                    some, size = [], 0
            if some:
                flush(lang, some)
    for lang, parts in held.items():
        keys, counts = merged(parts)
        for i in range(0, len(keys), 10_000):
            k = keys[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(counts[i : i + 10_000].astype(np.int64))], ["lang", "gram", "n"])


def profiles(training: DataFrame) -> dict[str, list[int]]:
    """Language -> its PROFILE n-grams by rank, counted over every row of ``training`` (lang, text)."""
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    sums = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    top = sums.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= PROFILE)
    each = top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))
    found = {r[0]: list(r[1]) for r in each.limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return found


def classifier(known: dict[str, list[int]]):
    """text -> (language, score): score is one less the distance by the largest there can be.

    Profiles are held the other way round, as languages and ranks of each n-gram, so that memory is in proportion to them.
    """
    names = sorted(known)
    every = np.concatenate([np.array(known[n], dtype=np.uint64) for n in names]) if names else np.zeros(0, np.uint64)
    whose = np.repeat(np.arange(len(names)), [len(known[n]) for n in names])
    rank = np.concatenate([np.arange(len(known[n])) for n in names]) if names else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    keys, starts = np.unique(every[order], return_index=True)
    whose, rank, ends = whose[order], rank[order], np.append(starts[1:], len(every))

    def classify(text: str | None) -> tuple[str, float]:
        found = grams(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(found) or not names:
            return UNKNOWN, 0.0
        mine = ranked(*counted(found), PROFILE)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        own = np.flatnonzero(keys[at] == mine)  # ranks of the document's n-grams that some profile has
        sizes = (ends - starts)[at[own]]
        place = np.repeat(starts[at[own]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        nearer = PROFILE - np.abs(rank[place] - np.repeat(own, sizes))
        distance = PROFILE * len(mine) - np.bincount(whose[place], weights=nearer, minlength=len(names)).astype(np.int64)
        best = int(distance.argmin())
        return names[best], float(1 - distance[best] / (PROFILE * len(mine)))

    return classify


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def predict(docs: DataFrame, known: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(known)
        for batch in batches:
            rows = [classify(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3(docs: DataFrame) -> DataFrame:
    return predict(docs, profiles(docs.filter(~held_out(F.col("doc_id")))))
