"""Quality rules with adaptive thresholds (operator 8), in DataFrame functions only.

Each text is measured in its own row. Fixed cutoffs are replaced by fences that come from mergeable quantile
sketches per language and source. A sketch counts rows in bins of relative width: a value of LEAST or more is
put in a bin that is at most 1/32 of the value wide, smaller ones in the bin 0. So a quantile has a relative error of
1/32 at most (or is below LEAST), a sketch has at most 2,000 bins however many rows it stands for, two sketches merge by adding counts, and
the result does not depend on the order of rows or on how they were dealt out.

A fence stands beyond a quantile of the group's own sketch by a factor. Nothing else bounds it: there is no least or
greatest fence, and values have no upper limit. A quantile counts where BEYOND rows or more lie past it. Other groups are judged by their
language, then by the whole table, and both bound the fences of larger groups, so that junk of one source does not
raise its own. Junk that is more than a quarter of its language and of the whole table alike is not told from the rest.

Defined results: a null text has no words; null ``lang`` and ``source`` form groups of their own; equal rows get equal
verdicts; a table without rows gives none; other columns of the input are kept, under any names, and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stored

#: The least value that has a bin of its own; shares are in ten thousandths, so half a hundredth. Bits of a bin's place between powers of two.
LEAST, BITS = 50, 5
#: Measure -> (quantile in hundredths, factor in tenths, whether low values are rejected too, at the opposite quantile).
#: Symbols and word lengths part junk from prose by themselves: beyond the upper quartile. Repeated lines and words are
#: common in good texts, so that only the last hundredth tells how far they go.
MEASURES = {"symbols": (75, 13, False), "dup_lines": (99, 30, False), "repeats": (99, 30, False), "word_length": (75, 13, True)}
#: Rows that must lie past a quantile.
BEYOND = 10
#: Groups whose fences are broadcast (about 100 bytes each); more are joined by a shuffle that Spark can split.
BROADCAST_GROUPS = 200_000
#: The longest text in words whose windows are sorted as packed numbers (48 bits of hash, 16 bits of position).
PACKED_WORDS = 65536


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words of ``_words`` in 3-word windows that are found twice or more.

    Windows are hashed, sorted with their positions, and neighbours of equal hash are compared as words. Each step is
    a column that later ones refer to more than once, so that none is evaluated again for every element.
    """
    word = lambda i: F.get("_words", i)
    same = lambda a, b: (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
    n = F.size("_words")
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_hashes", F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(none))
    df = df.withColumn("_twins", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    df = df.withColumns({
        "_packed": F.when(F.col("_twins") & (n <= PACKED_WORDS), F.sort_array(F.transform("_hashes", lambda h, i: F.shiftleft(h, 16).bitwiseOR(i.cast("long"))))).otherwise(none),
        "_wide": F.when(F.col("_twins") & (n > PACKED_WORDS), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })

    def hits(ordered: str, key, at) -> Column:
        """Positions of the windows that equal a neighbour in ``ordered``."""

        def twin(x: Column, i: Column) -> Column:
            other = F.when(i >= 0, F.get(ordered, i))
            return F.coalesce((key(x) == key(other)) & same(at(x), at(other)), F.lit(False))

        return F.transform(F.filter(ordered, lambda x, i: twin(x, i - 1) | twin(x, i + 1)), at)

    df = df.withColumn("_places", F.when(F.size("_packed") > 0, hits("_packed", lambda x: F.shiftright(x, 16), lambda x: x.bitwiseAND(F.lit(PACKED_WORDS - 1)).cast("int"))).otherwise(hits("_wide", lambda x: x["h"], lambda x: x["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.array(p, p + 1, p + 2)))))
    return df.withColumn("n_repeat_words", F.when(F.col("_twins"), covered).otherwise(0).cast("long")).drop("_hashes", "_twins", "_packed", "_wide", "_places")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
    })
    out = _with_repeated_words(out)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_words", "_lines")


def _valued(measured: DataFrame) -> DataFrame:
    """The measures as integers, in integer arithmetic, so that every engine gets the same: shares in ten thousandths, a mean word length in thousandths of a character."""
    return measured.withColumns({
        "symbols": F.expr("(10000 * n_symbols) div greatest(word_chars, 1)"),
        "dup_lines": F.expr("(10000 * n_dup_lines) div greatest(_n_lines, 1)"),
        "repeats": F.expr("(10000 * n_repeat_words) div greatest(n_words, 1)"),
        "word_length": F.expr("(1000 * word_chars) div greatest(n_words, 1)"),
    }).drop("_n_lines")


def bin_of(value: Column) -> Column:
    """0 below LEAST; else the place of the highest bit and the BITS bits after it. Bins are in the order of values."""
    top = F.length(F.bin(value)) - 1
    return F.when(value < LEAST, 0).otherwise(top * (1 << BITS) + F.call_function("shiftright", value, top - BITS).cast("int").bitwiseAND(F.lit((1 << BITS) - 1))).cast("int")


def _edge(bin_: Column, upper: bool) -> Column:
    """The largest or least value of a bin."""
    top, low = F.shiftright(bin_, BITS), bin_.bitwiseAND(F.lit((1 << BITS) - 1))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), top - BITS)
    return F.when(bin_ == 0, F.lit(LEAST - 1 if upper else 0)).otherwise((low + (1 << BITS) + (1 if upper else 0)) * width - (1 if upper else 0)).cast("bigint")


def sketches(valued: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """A row for each group, measure and bin in use, with its count.

    Sketches of two tables merge by union and a sum of ``n``.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(F.col(k)).alias("bin")) for k in MEASURES]))
    return valued.select(*by, pairs.alias("_p")).groupBy(*by, F.col("_p.measure").alias("measure"), F.col("_p.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _own_fences(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """For each group of ``by``: ``<measure>_hi``, ``<measure>_lo`` and ``<measure>_enough``, whether its quantiles count."""
    group = Window.partitionBy(*by, "measure")
    merged = sketch.groupBy(*by, "measure", F.col("bin").alias("_bin")).agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("_upto", F.sum("n").over(group.orderBy("_bin"))).withColumn("_rows", F.sum("n").over(group))
    columns = []
    for name, (level, factor, low) in MEASURES.items():
        mine = F.col("measure") == name
        at = lambda q, upper: F.min(F.when(mine & (F.col("_upto") * 100 >= F.col("_rows") * q), _edge(F.col("_bin"), upper)))  # noqa: B023, E731
        columns.append(F.floor(at(level, True) * factor / 10).cast("bigint").alias(f"{name}_hi"))
        columns.append((F.ceil(at(100 - level, False) * 10 / factor) if low else F.lit(0)).cast("bigint").alias(f"{name}_lo"))
        columns.append((F.max(F.when(mine, F.col("_rows"))) * (100 - level) >= 100 * BEYOND).alias(f"{name}_enough"))
    return ranked.groupBy(*by).agg(*columns)


def fences(sketch: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """For each group: the values ``<measure>_lo`` and ``<measure>_hi`` outside which a row is rejected, and ``<measure>_from``: keys of the pool that set them.

    A group whose quantile does not count takes the fence of the least pool where it does (the whole table's counts
    always), and no group's are wider than its pools'. Word lengths are held by the language only, since languages differ in them.
    """
    out = _own_fences(sketch, by)
    limits = [f"{m}_{e}" for m in MEASURES for e in ("hi", "lo", "enough")]
    out = out.select(*by, *limits, *[F.lit(len(by)).alias(f"{m}_from") for m in MEASURES])
    pools = [_own_fences(sketch, by[:k]).select(*[F.col(c).alias(f"_in_{c}") for c in (*by[:k], *limits)]) for k in range(len(by))]
    for k in reversed(range(len(by))):
        if k:
            on = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in by[:k]]
            out = out.join(pools[k], on, "left")
        else:
            whole = pools[0].first()  # one row of a dozen numbers, or none
            out = out.withColumns({c: F.lit(whole[c] if whole else None).cast(kind) for c, kind in pools[0].dtypes})
        held = []
        for name, (_, _, low) in MEASURES.items():
            enough, sure = F.col(f"{name}_enough"), F.col(f"_in_{name}_enough") | F.lit(k == 0)
            for end, nearer in (("hi", F.least), ("lo", F.greatest)):
                own, wide = F.col(f"{name}_{end}"), F.col(f"_in_{name}_{end}")
                both = own if low and k == 0 else nearer(own, wide)
                held.append(F.when(~enough, wide).when(sure, both).otherwise(own).alias(f"{name}_{end}"))
            held.append((enough | sure).alias(f"{name}_enough"))
            held.append(F.when(enough, F.col(f"{name}_from")).otherwise(F.lit(k)).alias(f"{name}_from"))
        out = out.select(*by, *held)
    return out.drop(*[f"{m}_enough" for m in MEASURES])


def verdicts(valued: DataFrame, limits: DataFrame, at: str, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``valued`` with kept: base rules passed, and every measure within the fences of the row's group.

    ``limits`` has a row for each group and is written at ``at``. Up to BROADCAST_GROUPS rows of it are broadcast; more
    are joined by an ordinary equi-join, of which Spark splits the partition of a hot group.
    """
    limits = stored(limits.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"{m}_{e}" for m in MEASURES for e in ("hi", "lo")]), at)
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    kept = ~F.col("base_failed")
    for name in MEASURES:
        kept = kept & (F.col(name) <= F.col(f"{name}_hi")) & (F.col(name) >= F.col(f"{name}_lo"))
    few = limits.count() <= BROADCAST_GROUPS
    return valued.join(F.broadcast(limits) if few else limits, on, "left").withColumn("kept", F.coalesce(kept, F.lit(False))).drop(*limits.columns)


def measures_of(docs: DataFrame, at: str) -> DataFrame:
    """The measures of every row, without texts, written at ``at``: they are read for sketches and verdicts."""
    return stored(_valued(measure(docs.select("doc_id", "text", "lang", "source"))).drop("text"), at)


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected rows; all columns stay, whatever their names.

    Texts are measured once: rows that pass the base rules are written with their measures, and read again for the verdict.
    """
    at = shared_dir(docs.sparkSession)
    row = docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("_row"))
    valued = _valued(measure(row)).withColumn("_row", F.when(~F.col("base_failed"), F.col("_row"))).drop("text")
    valued = stored(valued, f"{at}/measures")
    return verdicts(valued, fences(sketches(valued)), f"{at}/fences").filter("kept").select("_row.*")


def op8(docs: DataFrame) -> DataFrame:
    at = shared_dir(docs.sparkSession)
    valued = measures_of(docs, f"{at}/measures")
    return verdicts(valued, fences(sketches(valued)), f"{at}/fences").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB: the rows of op8. The n-th least bin of a group stands for its quantile; `v` are the measures, `k` their number.
ORACLE = """
WITH w AS (
  SELECT rowid AS r, doc_id, text, lang, source,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
t AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS k(k) GROUP BY r),
m AS (
  SELECT w.doc_id, w.r, lang, source, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT r, lang, source, unnest([1, 2, 3, 4]) AS k, unnest([10000 * n_symbols // greatest(word_chars, 1), 10000 * n_dup_lines // greatest(n_lines, 1),
    10000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)]) AS v FROM b),
e AS (SELECT *, length(bin(v)) - 1 AS e FROM v),
s AS (SELECT r, lang, source, k, v, CASE WHEN v < 50 THEN 0 ELSE e * 32 + ((v >> greatest(e - 5, 0)::INT) & 31) END AS bin FROM e),
p(k, level, factor) AS (VALUES (1, 75, 13), (2, 99, 30), (3, 99, 30), (4, 75, 13)),
a AS (
  SELECT 2 AS z, lang, source, k, bin FROM s UNION ALL SELECT 1, lang, NULL, k, bin FROM s UNION ALL SELECT 0, NULL, NULL, k, bin FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY z, lang, source, k ORDER BY bin) AS no, count(*) OVER (PARTITION BY z, lang, source, k) AS n FROM a),
q AS (
  SELECT z, lang, source, k, any_value(n) AS n, max(bin) FILTER (no = (n * level + 99) // 100) AS up, max(bin) FILTER (no = (n * (100 - level) + 99) // 100) AS down, any_value(factor) AS factor,
    any_value(n) * (100 - any_value(level)) >= 1000 AS enough
  FROM o JOIN p USING (k) GROUP BY z, lang, source, k),
f AS (
  SELECT z, lang, source, k, enough, CASE WHEN up = 0 THEN 49 ELSE ((up % 32 + 33) << greatest(up // 32 - 5, 0)::INT) - 1 END * factor // 10 AS hi,
    CASE WHEN k < 4 THEN 0 WHEN down = 0 THEN 0 ELSE (((down % 32 + 32) << greatest(down // 32 - 5, 0)::INT) * 10 + factor - 1) // factor END AS lo FROM q),
l AS (
  SELECT x.lang, x.k, CASE WHEN NOT x.enough THEN y.hi WHEN x.k = 4 THEN x.hi ELSE least(x.hi, y.hi) END AS hi, CASE WHEN NOT x.enough THEN y.lo WHEN x.k = 4 THEN x.lo ELSE greatest(x.lo, y.lo) END AS lo
  FROM f x JOIN f y ON x.z = 1 AND y.z = 0 AND x.k = y.k),
g AS (
  SELECT x.lang, x.source, x.k, CASE WHEN x.enough THEN least(x.hi, l.hi) ELSE l.hi END AS hi, CASE WHEN x.enough THEN greatest(x.lo, l.lo) ELSE l.lo END AS lo
  FROM f x JOIN l ON x.z = 2 AND x.k = l.k AND x.lang IS NOT DISTINCT FROM l.lang),
i AS (
  SELECT s.r, bool_and(s.v BETWEEN g.lo AND g.hi) AS inside FROM s JOIN g ON s.k = g.k AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source GROUP BY s.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM b JOIN i USING (r)
"""
