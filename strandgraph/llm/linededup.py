"""Repeated runs of lines, found with a suffix array over line ids.

Each document is its sequence of lines that hold a word; lines that occur more
than once, told apart by two 64-bit hashes, are numbered.  Ranks of all suffixes by their first 1, 2, 4, ... lines come from
prefix doubling: pairs of ranks 2^k lines apart are sorted over all partitions
and numbered in order; suffixes whose prefix occurs once drop out.  Suffixes
that share their first L lines are an interval of the suffix array whose longest
common prefix is L or more; the interval is named by the two ranks of 2^k lines,
2^k <= L < 2^(k+1), that cover those lines.  For each line the shortest run that
begins there, and the shortest that ends there, with ``min_words`` words are
looked up in this way.  All their copies but the first in order of document and
line are deleted, and their union is exactly the union of all maximal repeated
runs of ``min_words`` words or more, without their first copies.

All is DataFrame operations; line numbers count from 0.

Defined results: null texts stay null and empty ones empty; lines without a word
belong to no run, but go where the lines with words on both sides of them go; a document all of whose
lines are deleted stays, with an empty text; rows with the same ``doc_id`` and
text are one document and get the same edit; documents of equal ``doc_id`` are
ordered by the hash of their text, null ids first; other columns stay as they
are, but ``n_chars``, where there is one, counts the characters left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.storage import Scratch

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["d", "th"]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + n) not in taken) for n in names]


def _lines(docs: DataFrame) -> DataFrame:
    """``(d, th, p, i, h, h2, w)``: document, place among its lines with words, line number, hashes of the line, words."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    src = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.filter(numbered, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    out = src.select("d", "th", F.posexplode("lines").alias("p", "s"))
    return out.select("d", "th", "p", "s.i", F.xxhash64("s.x").alias("h"), F.xxhash64(F.lit(1), "s.x").alias("h2"), F.regexp_count(F.col("s.x"), F.lit(_WORD)).alias("w"))


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """``(d, th, s, e, bs, be)``: for each line the shortest runs of repeated lines from it and up to it with ``min_words`` words.

    ``s`` and ``e`` bound the run's places (``e`` beyond the last), ``bs`` and ``be`` are its first and last line numbers.
    """
    by = Window.partitionBy(*_KEY).orderBy("p")
    a = active.withColumn("g", F.col("p") - F.row_number().over(by))  # one value for each stretch of neighbours
    stretch = Window.partitionBy(*_KEY, "g").orderBy("p")
    a = a.withColumn("after", F.sum("w").over(stretch)).withColumn("before", F.col("after") - F.col("w"))
    a = a.withColumn("pi", F.lag("i").over(stretch)).withColumn("end", F.lead("p").over(stretch).isNull())

    def mark(kind: int, key: Column, p: Column, i: Column, pi: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), p.alias("p"), i.alias("i"), pi.alias("pi"))

    p, i, pi, none = F.col("p"), F.col("i"), F.col("pi"), F.lit(None).cast("int")
    rows = [mark(0, F.col("before"), p, i, pi), mark(1, F.col("before") + min_words, p, i, pi), mark(2, F.col("after") - min_words, p, i, pi)]
    closing = F.when(F.col("end"), F.array(mark(0, F.col("after"), p + 1, none, i))).otherwise(F.array().cast("array<struct<kind:int,key:bigint,p:int,i:int,pi:int>>"))
    marks = a.select(*_KEY, "g", F.explode(F.concat(F.array(*rows), closing)).alias("m")).select(*_KEY, "g", "m.*")
    point = F.when(F.col("kind") == 0, F.struct("p", "i", "pi"))
    group = Window.partitionBy(*_KEY, "g")
    # boundaries are kind 0 and stand before questions of the same key in either direction
    up = group.orderBy(F.col("key"), F.col("kind")).rowsBetween(Window.unboundedPreceding, 0)
    down = group.orderBy(F.col("key").desc(), F.col("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("lo", F.max(point).over(up)).withColumn("hi", F.min(point).over(down))
    ahead = found.filter("kind = 1 and hi is not null").select(*_KEY, F.col("p").alias("s"), F.col("hi.p").alias("e"), F.col("i").alias("bs"), F.col("hi.pi").alias("be"))
    back = found.filter("kind = 2 and lo is not null").select(*_KEY, F.col("lo.p").alias("s"), (F.col("p") + 1).alias("e"), F.col("lo.i").alias("bs"), F.col("i").alias("be"))
    return ahead.unionByName(back).distinct()


def _double(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Ranks by ``2 * step`` lines from those by ``step`` lines, ``(d, th, p, r)``; prefixes that occur once drop out."""
    ahead = Window.partitionBy(*_KEY).orderBy("p").rangeBetween(step, step)
    pairs = scratch.write(level.withColumn("r2", F.max("r").over(ahead)).filter("r2 is not null"), compact=True)
    many = pairs.groupBy("r", "r2").count().filter("count > 1").select("r", "r2")
    ranked = scratch.write(many.orderBy("r", "r2").withColumn("rank", F.monotonically_increasing_id()), compact=True)
    out = scratch.write(pairs.join(ranked, ["r", "r2"]).select(*_KEY, "p", F.col("rank").alias("r")), compact=True)
    scratch.drop(pairs, ranked)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(d, th, runs)``: per document (id, text hash) the line ranges to delete, as ``array<struct<b,e>>``, ends included."""
    scratch = scratch or Scratch(docs.sparkSession)
    lines = _lines(docs)
    often = lines.groupBy("h", "h2").count().filter("count > 1").select("h", "h2", F.monotonically_increasing_id().alias("line"))
    often = scratch.write(often, compact=True)
    active = lines.join(often, ["h", "h2"]).select(*_KEY, "p", "i", "line", "w").dropDuplicates([*_KEY, "p"])
    active = scratch.write(active, compact=True)
    scratch.drop(often)
    windows = scratch.write(_windows(active, min_words), compact=True)
    longest = windows.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    level = active.select(*_KEY, "p", F.col("line").alias("r"))
    levels, k = level.withColumn("k", F.lit(0)), 0
    while 2 << k <= longest:
        level = _double(level, 1 << k, scratch)
        k += 1
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))
        if level.isEmpty():
            break
    n = F.col("e") - F.col("s")
    named = windows.withColumn("k", F.length(F.bin(n)) - 1)
    named = named.withColumn("z", F.expr("cast(e - shiftleft(1, k) as int)"))

    def rank(of: DataFrame, at: str, name: str) -> DataFrame:
        side = levels.select(F.col("d").alias("d_"), F.col("th").alias("th_"), F.col("k").alias("k_"), F.col("p").alias("p_"), F.col("r").alias(name))
        same = F.col("d").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("th_")) & (F.col("k") == F.col("k_")) & (F.col(at) == F.col("p_"))
        return of.join(side, same).drop("d_", "th_", "k_", "p_")

    named = rank(rank(named, "s", "ra"), "z", "rb")
    named = scratch.write(named.select(*_KEY, "s", "e", "bs", "be", n.alias("n"), "ra", "rb"), compact=True)
    scratch.keep_only(named)
    place = F.struct("d", "th", "s")
    first = scratch.write(named.groupBy("n", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), compact=True)
    later = named.join(first, ["n", "ra", "rb"]).filter(~place.eqNullSafe(F.col("first")))
    order = Window.partitionBy(*_KEY).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    later = later.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*_KEY, "island").agg(F.min("bs").alias("b"), F.max("be").alias("e"))
    return runs.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, runs_as: str | None = None) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``; ``runs_as`` names a column for the deleted line ranges."""
    cols, scratch = docs.columns, Scratch(docs.sparkSession)
    d, th, gone = unused(cols, "d", "th", "runs")
    src = docs.withColumn("text", F.col("text").cast("string"))
    runs = repeated_runs(src.select("doc_id", "text"), min_words, scratch)
    found = scratch.write(runs.select(F.col("d").alias(d), F.col("th").alias(th), F.col("runs").alias(gone)), compact=True)
    scratch.keep_only(found)
    # always a merge join: the table of runs grows with the corpus
    out = src.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(th)), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.exists(gone, lambda r: (i >= r["b"]) & (i <= r["e"])))
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*cols, *([F.col(gone).alias(runs_as)] if runs_as else []))
