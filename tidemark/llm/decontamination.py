"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

DataFrame functions alone. A text's words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are
lower-cased; its shingles are runs of five words (an item of fewer words is one shingle
of all of them). An item of n words is held against windows of n words. The similarity
of window and item is weighted by how often each shingle occurs: the sum of the smaller
counts over the sum of the larger, and 0.8 or more is a leak.

Fingerprinting. Windows and items get 64-bit SimHash fingerprints, and RADIUS + 1 blocks
of their bits are an index: two fingerprints within RADIUS have a block in common, so all
pairs of equal n within it meet. RADIUS lies four standard deviations beyond the expected
distance at similarity 0.8. Pairs of window and item come from this index alone, and are
then verified exactly.

Windows. Not every window of every size needs a fingerprint. Call a place of a document
an anchor of size n if the shingle there occurs in any item of n words. A similarity of t
leaves at least t / (1 + t) of the shingles of item and window, added up, in both, so a
window that is like any item of its size holds as many anchors. A best one begins with an
anchor or ends with one: between those places the number of shared shingles doesn't rise.
Such windows of every size that an item has are fingerprinted, and no others. Which items
a window may hold is not looked at here.

Benchmark tables are broadcast while their shingles are BROADCAST_ROWS at most, else
joined by shuffle.

Nulls and odd input: texts or items that are null or without words match nothing. A
document shorter than an item is one window. Rows that share a doc_id are each looked
into, and the best window of the doc_id counts. Rows with a null id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import Workspace, prepare

WIDTH, PERCENT, RADIUS = 5, 80, 21
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.split(F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(" \t\n\x0b\x0c\r")), "[ \\t\\n\\x0B\\f\\r]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, given as hashes; no run if there are fewer."""
    n = F.size(words) - (width - 1)
    each = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]))
    return F.slice(each, F.lit(1), F.greatest(n, F.lit(0)))


def placed_grams(words: Column, width: int) -> Column:
    """Structs (width, at, h) of all runs of ``width`` words."""
    return F.transform(grams(words, width), lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("at"), h.alias("h")))


def simhash(values: Column) -> Column:
    """64 bits, each the majority of the values' bits."""

    def bit(total: Column, b: Column) -> Column:
        ones = F.aggregate(values, F.lit(0), lambda s, h: s + F.getbit(h, b))
        return total.bitwiseOR(F.when(2 * ones > F.size(values), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def bit_blocks(fingerprint: Column, n: int) -> Column:
    """The n blocks of a fingerprint, as structs of number and bits."""
    edges = [64 * k // n for k in range(n + 1)]
    part = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("no"), part(a, b).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def common(a: Column, b: Column) -> Column:
    """The size of the intersection of two arrays as bags."""
    times = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def _least_shared(n: Column, held: Column) -> Column:
    """Shingles of an item's n that any window of similarity PERCENT has, in a document of ``held``, in whole numbers."""
    return F.ceil(PERCENT * (n + F.least(n, held)) / (100.0 + PERCENT) - 1e-9)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, window_start and n_words (in words), hamming, similarity: each document's best window for each item it holds."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "decontamination")
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n", F.size("words")).withColumn("width", F.least("n", F.lit(WIDTH)))
    own = F.lit(None).cast("array<long>")
    for width in range(1, WIDTH + 1):
        own = F.when(F.col("width") == width, grams(F.col("words"), width)).otherwise(own)
    items = work.save(items.withColumn("grams", own).withColumn("print", simhash(F.col("grams"))).select("item_id", "n", "width", "grams", "print"), "items")
    wanted = work.save(items.select("n", "width", F.explode("grams").alias("h")).distinct(), "wanted")
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]
    small = wanted.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("tag"), word_hashes(F.col("text")).alias("words")).withColumn("held", F.size("words"))
    shown = [placed_grams(F.col("words"), w) for w in widths]
    # ``held`` is there before the explosion, else each of its rows would carry all words.
    each = hashed.select("doc_id", "tag", "held", F.inline(F.flatten(F.array(*shown)))) if widths else None
    if each is None:
        return spark.createDataFrame([], "doc_id long, item_id long, window_start int, n_words int, hamming int, similarity double")
    hits = each.join(near(wanted), ["width", "h"])
    found = hits.groupBy("doc_id", "tag", "n", "width").agg(F.max("held").alias("held"), F.array_sort(F.collect_set("at")).alias("at"))
    full = F.col("n") - F.col("width") + 1  # shingles of an item of n words
    least = _least_shared(full, F.col("held") - F.col("width") + 1).cast("int")
    found = found.withColumns({"full": full, "least": least}).where(F.size("at") >= F.col("least"))
    begin = F.filter("at", lambda x, i: F.get("at", i + F.col("least") - 1) < x + F.col("full"))
    end = F.filter("at", lambda x, i: F.get("at", i - F.col("least") + 1) > x - F.col("full"))
    top = F.greatest(F.lit(0), F.col("held") - F.col("n"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), top)
    starts = F.array_distinct(F.concat(F.transform(begin, clamp), F.transform(end, lambda x: clamp(x - F.col("full") + 1))))
    found = work.save(found.select("doc_id", "tag", "n", "width", starts.alias("starts")).where(F.size("starts") > 0), "found")

    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    texts = tagged.join(found.select("doc_id", "tag").distinct(), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    texts = work.save(texts.select("doc_id", "tag", word_hashes(F.col("text")).alias("words")), "texts")
    cut = F.transform("starts", lambda x: F.struct(x.alias("start"), F.slice("words", x + 1, F.col("n")).alias("cut")))
    windows = found.join(texts, ["doc_id", "tag"]).select("doc_id", "tag", "n", "width", F.inline(cut))
    shown = F.lit(None).cast("array<long>")
    for w in widths:
        shown = F.when(F.col("width") == w, grams(F.col("cut"), w)).otherwise(shown)
    windows = windows.withColumn("grams", shown).select("doc_id", "tag", "n", "start", "grams", simhash(F.col("grams")).alias("print"))
    windows = work.save(windows, "windows")

    by_block = items.select("item_id", "n", F.col("print").alias("item_print"), F.inline(bit_blocks(F.col("print"), RADIUS + 1)))
    met = windows.select("doc_id", "tag", "n", "start", "print", F.inline(bit_blocks(F.col("print"), RADIUS + 1))).join(near(by_block), ["n", "no", "bits"])
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    met = met.withColumn("hamming", close).where(F.col("hamming") <= RADIUS).select("doc_id", "tag", "n", "start", "item_id", "hamming").distinct()
    both = windows.join(met, ["doc_id", "tag", "n", "start"]).join(near(items.select("item_id", F.col("grams").alias("item_grams"))), "item_id")
    both = both.withColumn("both", common(F.col("grams"), F.col("item_grams"))).withColumn("all", F.size("grams") + F.size("item_grams") - F.col("both"))
    both = both.where(100 * F.col("both") >= PERCENT * F.col("all"))
    best = F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"), (-F.col("hamming")).alias("hamming")))
    out = both.groupBy("doc_id", "item_id", "n").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.start")).cast("int").alias("window_start"), F.col("n").alias("n_words"), (-F.col("b.hamming")).cast("int").alias("hamming"), F.round("b.similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item leaks."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
