"""Benchmark decontamination (operator 4), in DataFrame functions only.

The benchmark's windows of normalised words are a hash set that is broadcast, and so are the hashes of their grams of
GRAM words. A window of WINDOW words has a gram at exactly one of any STRIDE places next to each other, so a text gives
a row for each STRIDE-th place, with the gram's hash alone; rows that the set of grams holds look up the STRIDE windows
around them, which are verified word by word. Shorter items make windows of their own widths, with strides of their
own. All this happens within the scan: neither texts nor word positions are shuffled, and a row for each document and
one for each hit leave it.

A set of windows is broadcast up to PART_WINDOWS windows. A larger benchmark is cut into parts of at most as many, and
texts are scanned once for each part; only hits leave a scan, whatever the size of the benchmark.

Defined results: a null or wordless text has no words and no hits; items without text or words have
no windows; items without id are hits as others are, count as one item and are not in the list; items of equal text each count; equal documents (repeated rows) get equal rows; tables without rows give no
rows, or no hits; other columns are not read, and :func:`remove_documents` keeps them under any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
GRAM = 4
#: Windows of one broadcast set (about 300 bytes each; a window adds a gram or so, 16 bytes each).
PART_WINDOWS = 200_000
#: Windows of one item that stay together, as windows next to each other share their grams.
RUN = 4096

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words as they stand, letter case kept: ASCII digits, letters and everything beyond ASCII."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), lambda w: w != "")


def folded(word: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(word, _UPPER, _LOWER)


def windows_of(benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, run, words, h): the distinct windows of every item; an item of fewer than WINDOW words is one window."""
    words = F.transform(words_of(F.col("text")), folded)
    items = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("_w")).filter(F.size("_w") > 0)
    width = F.least(F.size("_w"), F.lit(WINDOW))
    parts = F.transform(F.sequence(F.lit(1), F.size("_w") - width + 1), lambda i: F.slice("_w", i, width))
    out = items.select("item", F.posexplode(parts).alias("_at", "words"))
    out = out.groupBy("item", "words").agg(F.min(F.expr(f"_at div {RUN}")).alias("run"))
    return out.withColumn("h", F.xxhash64("words"))


def _grams_of(width: int) -> tuple[int, int]:
    """Words of a gram of windows of ``width`` words, and how far apart the places stand at which texts are looked at."""
    gram = min(GRAM, width)
    return gram, width - gram + 1


def _gram(words: str, at: Column, width: int) -> Column:
    """Hash of the gram at the 0-based ``at``. Wider folding than the windows': more places are looked at, none is missed."""
    return F.xxhash64(F.lit(width), F.array(*[F.lower(F.get(words, at + k)) for k in range(_grams_of(width)[0])]))


def _always() -> Column:
    """The gram of a row that every text has, so that texts without hits are counted too."""
    return F.xxhash64(F.lit(0))


def _place_of(width: int):
    return lambda at: F.struct(F.lit(width).alias("width"), at.alias("at"), _gram("_w", at, width).alias("h"))


def _hits(scanned: DataFrame, windows: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """Hits of one part of the windows, and a row for each text (``first``)."""
    none = F.array().cast("array<struct<width:int,at:int,h:bigint>>")
    looked, known = [F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("at"), _always().alias("h")))], [F.array(_always())]
    for w in widths:
        gram, stride = _grams_of(w)
        places = F.sequence(F.lit(0), F.size("_w") - gram, F.lit(stride))
        looked.append(F.when(F.size("_w") >= w, F.transform(places, _place_of(w))).otherwise(none))
        parts = F.array(*[_gram("words", F.lit(i), w) for i in range(stride)])
        known.append(F.when(F.size("words") == w, parts).otherwise(F.array().cast("array<bigint>")))
    grams = windows.select(F.explode(F.concat(*known)).alias("_g")).unionByName(scanned.sparkSession.range(1).select(_always().alias("_g"))).distinct()
    rows = scanned.select(*keep, "n_words", "_w", F.explode(F.concat(*looked)).alias("_look")).select(*keep, "n_words", "_w", "_look.*")
    rows = rows.join(F.broadcast(grams), F.col("h") == F.col("_g"), "left_semi")
    stride = reduce(lambda c, w: c.when(F.col("width") == w, _grams_of(w)[1]), widths, F.when(F.col("width") == 0, 0))
    starts = F.filter(F.sequence(F.greatest(F.col("at") - stride + 1, F.lit(0)), F.col("at")), lambda i: (F.col("width") > 0) & (i + F.col("width") <= F.size("_w")))
    found = F.transform(starts, lambda i: F.struct(i.alias("at"), F.transform(F.slice("_w", i + 1, F.col("width")), folded).alias("words")))
    rows = rows.select(*keep, "n_words", "width", F.explode_outer(found).alias("_hit"))
    rows = rows.select(*keep, "n_words", (F.col("width") == 0).alias("first"), F.col("_hit.at").alias("at"), F.col("width"), F.col("_hit.words").alias("_words")).withColumn("_h", F.xxhash64("_words"))
    items = windows.groupBy(F.col("h").alias("_kh"), F.col("words").alias("_kw")).agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    joined = rows.join(F.broadcast(items), (F.col("_h") == F.col("_kh")) & (F.col("_words") == F.col("_kw")), "left")
    return joined.select(*keep, "n_words", "first", "at", "width", "items", "unnamed").filter(F.col("first") | F.col("items").isNotNull())


def hits(docs: DataFrame, windows: DataFrame, keep: list[str], part_windows: int = PART_WINDOWS) -> DataFrame:
    """A row for each verified hit (``at``: 0-based first word, ``width``, ``items``, ``unnamed``: whether one has no id), and one for each document (``first``).

    ``keep``: columns of ``docs`` to carry; ``n_words`` is added. A window that items in several parts have is a hit of each part.
    """
    widths = sorted(r[0] for r in windows.select(F.size("words")).distinct().collect())  # at most WINDOW numbers
    parts = -(-windows.count() // part_windows) or 1
    scanned = docs.select(*keep, words_of(F.col("text")).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    found = []
    for k in range(parts):
        some = windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("item", "run"), F.lit(parts)) == k)
        found.append(_hits(scanned, some, widths, keep).filter(F.lit(k == 0) | ~F.col("first")))
    return reduce(DataFrame.unionByName, found)


def spans(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """For each distinct row of ``keep``: times it occurs, n_words, n_hit, items (sorted), unnamed and spans (first word, word after the last)."""
    found = hits(docs, windows_of(benchmark), keep)
    places = found.groupBy(*keep).agg(
        F.max("n_words").alias("n_words"),
        F.count_if("first").alias("times"),
        F.sort_array(F.collect_set(F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("a"), (F.col("at") + F.col("width")).alias("b"))))).alias("_at"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.coalesce(F.max("unnamed"), F.lit(False)).alias("unnamed"),
    )
    # Sorted by start: a hit opens a new span where it starts beyond the end so far.
    empty = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(
        "_at",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["a"] <= F.get(acc, F.size(acc) - 1)["b"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(F.get(acc, F.size(acc) - 1)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = places.withColumn("spans", F.when(F.size("_at") > 0, merged).otherwise(empty)).drop("_at")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda s, x: s + x["b"] - x["a"]).cast("long"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Rows are told apart by id and text; rows that are equal in both are judged once and given back as often.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_x"), F.md5("text").alias("_y"))
    found = spans(keyed, benchmark, ["doc_id", "_x", "_y"])
    found = found.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return found.select(
        "doc_id", "n_words", "n_hit", (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "spans"
    )


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).drop("spans")


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay.

    Only ids and text digests of contaminated rows are moved, to drop them by an anti join.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_x"), F.md5("text").alias("_y"))
    bad = spans(keyed, benchmark, ["doc_id", "_x", "_y"]).filter(contaminated()).select(F.col("doc_id").alias("_id"), "_x", "_y")
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row")["text"]
    on = F.col("row")["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_x")) & F.md5(text).eqNullSafe(F.col("_y"))
    return rows.join(bad, on, "left_anti").select("row.*")


#: DuckDB: the rows of op4.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), 13) AS k, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM i),
j AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) AS ks),
h AS (SELECT DISTINCT r, p, k, item_id FROM (SELECT r, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM j) AS dw JOIN win USING (k, g)),
c AS (SELECT r, count(DISTINCT p + q) AS n_hit FROM (SELECT r, p, unnest(range(k)) AS q FROM h) AS x GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) AS y GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
