"""Benchmark decontamination by SimHash over item-sized windows. DataFrame and SQL functions only.

Five-word shingles of texts and items are 64-bit hashes. Wherever a text shares a shingle with an item, the
text's window of the item's size at that alignment is cut out; windows that share nothing have similarity 0 and
need no fingerprint, so nothing is lost. Each window and item gets a 64-bit SimHash of its shingles, weighted by
their occurrences. A multi-index finds the items within ``RADIUS`` bits of a window: fingerprints are cut into
``BLOCKS`` blocks, and by the pigeonhole principle two fingerprints within the radius have a block that differs in at
most ``BLOCK_RADIUS`` bits; item blocks are stored with all such neighbours and looked up by equality. Survivors are
verified by the exact weighted Jaccard similarity of the shingles (sum of minima over sum of maxima of the counts).

At similarity 0.75 the expected distance is 11 bits with a deviation of 3, so the radius of 23 lies four deviations
out; equal windows have distance 0.

The texts' shingles are met with the benchmark's as rows of two numbers: inside the scan while the benchmark's shingles are
few enough to be broadcast (counted first), else by a shuffle. Texts that share one are read again for their windows.

Items of fewer than five words are one shingle of all their words and are looked for in the texts' windows of that many
words; similarity is 1 or 0 there. Null and empty texts and items match nothing. Very long texts: windows are cut out
of ``CHUNK`` neighbouring ones together, so a text is never copied for each of its windows. Ties: of equally similar windows
the first counts. Rows with null ids are one id; repeated rows of an id give one row per (doc_id, item_id), the best
window. Extra columns play no part. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, only, selected, staged

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS = 8
BLOCK_BITS = 8
BLOCK_RADIUS = 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Places of the benchmark's shingles, and texts with their windows, that are broadcast; beyond, they are shuffled.
BROADCAST_PLACES = 1_000_000
BROADCAST_TEXTS = 50_000
#: Windows of a text that are cut out together.
CHUNK = 256
#: Items whose multi-index (37 x 8 rows an item) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ITEMS = 4_000


def folded_words(text: Column) -> Column:
    """Lower-case words between the six white-space characters."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The hashes of all windows of ``size`` words in order; null for texts of fewer words."""

    def of(words: Column) -> Column:
        hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))
        return F.when(F.size(words) >= size, F.slice(hashes, F.lit(1), F.size(words) - (size - 1)))

    return let(folded_words(text), of)


def simhash(hashes: str) -> Column:
    """Bit b is set if more shingle occurrences have bit b than lack it."""
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> if(aggregate({hashes}, 0L, (n, x) -> n + (shiftrightunsigned(x, b) & 1L) * 2L - 1L) > 0L, shiftleft(1L, b), 0L)), 0L, (m, y) -> m | y)"
    )


def neighbours(bits: int = BLOCK_BITS, radius: int = BLOCK_RADIUS) -> list[int]:
    """All masks of a block with at most ``radius`` bits set."""
    return [m for m in range(1 << bits) if m.bit_count() <= radius]


def block_values(fingerprint: str) -> Column:
    """(block, value) of a fingerprint's blocks."""
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> named_struct('block', b, 'value', cast(shiftrightunsigned({fingerprint}, b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L as int)))")


def weighted_similarity(left: str, right: str) -> Column:
    """Sum of minima over sum of maxima of the occurrence counts of two shingle lists."""
    common = F.expr(
        f"if(size(array_distinct({left})) = size({left}) and size(array_distinct({right})) = size({right}), size(array_intersect({left}, {right})), "
        f"aggregate(array_intersect({left}, {right}), 0, (n, s) -> n + least(size(filter({left}, x -> x = s)), size(filter({right}, x -> x = s)))))"
    )
    return let(common, lambda c: c / (F.size(left) + F.size(right) - c))


def item_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, grams, n_grams, fingerprint) of the items that have a shingle."""
    items = only(benchmark, item_id=item_col, text=text_col).select("item_id", shingles(F.col("text")).alias("grams")).where("grams is not null")
    return items.select("item_id", "grams", F.size("grams").alias("n_grams"), simhash("grams").alias("fingerprint"))


def short_item_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, gram) of the items of one word to four: one shingle of all their words."""
    items = only(benchmark, item_id=item_col, text=text_col).select("item_id", folded_words(F.col("text")).alias("words")).where(f"size(words) between 1 and {SHINGLE - 1}")
    return items.select("item_id", F.size("words").alias("size"), F.xxhash64(*[F.get("words", F.lit(k)) for k in range(SHINGLE - 1)]).alias("gram"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _met(texts: DataFrame, grams: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, n, p, and the columns of ``grams``): the places of some shingles in the texts. n: the text's shingles;
    mark: a hash of the text, which tells texts of one id apart."""
    hashed = texts.select("doc_id", F.xxhash64("text").alias("mark"), shingles(F.col("text"), size).alias("hs")).where("hs is not null")
    each = hashed.select("doc_id", "mark", F.size("hs").alias("n"), F.posexplode("hs").alias("p", "gram"))
    return each.join(_small(grams, BROADCAST_PLACES), "gram")


def short_contaminations(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """Rows like those of ``contaminations``: the first place of each short item in each text; None without such items."""
    found = None
    for size in sorted(r["size"] for r in items.select("size").distinct().collect()):  # 1 to 4
        own = items.where(F.col("size") == size).select("item_id", "gram")
        hits = _met(texts, own.select("gram").distinct(), size).groupBy("doc_id", "gram").agg(F.min("p").cast("long").alias("start"))
        part = hits.join(own, "gram").groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.lit(size).cast("long").alias("n_words"), F.lit(0).cast("long").alias("hamming"), F.lit(1.0).alias("similarity"))
        found = part if found is None else found.union(part)
    return found


def windows(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start, n_grams, own): distinct item-sized windows that share a shingle with an item of that size.

    n_grams is the item's size; ``own`` are the window's shingles (fewer at a text's edge).
    """
    places = staged(items.select("n_grams", F.posexplode("grams").alias("q", "gram")).distinct(), "item-shingles")
    first = F.greatest(F.col("p") - F.col("q"), F.lit(0))
    last = F.least(F.col("p") - F.col("q") + F.col("n_grams"), F.col("n"))
    met = _met(texts, places).select("doc_id", "mark", F.struct(first.alias("start"), last.alias("end"), "n_grams").alias("w")).distinct()
    found = staged(met.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("w")).alias("windows")), "windows")
    wanted = _small(found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "windows"), BROADCAST_TEXTS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    again = texts.withColumn("mark", F.xxhash64("text")).join(wanted, same).select("doc_id", shingles(F.col("text")).alias("hs"), "windows")
    chunk = f"slice(windows, k * {CHUNK} + 1, {CHUNK})"
    cut = again.select("doc_id", F.explode(F.expr(f"transform(sequence(0, int((size(windows) - 1) / {CHUNK})), k -> named_struct('some', {chunk}, 'base', {chunk}[0].start, 'part', slice(hs, {chunk}[0].start + 1, array_max(transform({chunk}, w -> w.end)) - {chunk}[0].start)))")).alias("c"))
    each = cut.select("doc_id", F.explode(F.expr("transform(c.some, w -> named_struct('start', w.start, 'n_grams', w.n_grams, 'own', slice(c.part, w.start - c.base + 1, w.end - w.start)))")).alias("x"))
    return each.select("doc_id", "x.start", "x.n_grams", "x.own").dropDuplicates(["doc_id", "start", "n_grams", "own"])


def contaminations(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): the best window of each text for each item it leaks."""
    items = staged(item_table(benchmark, item_col, item_text_col), "items")
    n_items = items.count()
    small = F.broadcast if n_items <= BROADCAST_ITEMS else (lambda x: x)
    prints = windows(only(df, doc_id=id_col, text=text_col), items).withColumn("print", simhash("own"))
    masks = F.array(*[F.lit(m) for m in neighbours()])
    index = (
        items.select("item_id", "n_grams", "fingerprint", F.explode(block_values("fingerprint")).alias("b"))
        .select("item_id", "n_grams", "fingerprint", F.col("b.block").alias("block"), F.col("b.value").alias("at"), F.explode(masks).alias("mask"))
        .select("item_id", "n_grams", "fingerprint", "block", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))
    )
    probes = prints.select("*", F.explode(block_values("print")).alias("b")).select("doc_id", "start", "n_grams", "own", "print", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))
    near = probes.join(small(index), ["n_grams", "block", "value"]).where(distance <= RADIUS).select("doc_id", "item_id", "start", "own", distance.alias("hamming")).dropDuplicates(["doc_id", "item_id", "start", "own"])
    scored = near.join(small(items.select("item_id", "grams")), "item_id").withColumn("similarity", weighted_similarity("own", "grams"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("before"), (F.size("own") + SHINGLE - 1).alias("n_words"), F.col("hamming")))
    found = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(best.alias("w"))
    found = found.select("doc_id", "item_id", (-F.col("w.before")).cast("long").alias("start"), F.col("w.n_words").cast("long").alias("n_words"), F.col("w.hamming").cast("long").alias("hamming"), F.col("w.similarity").alias("similarity"))
    short = short_contaminations(only(df, doc_id=id_col, text=text_col), staged(short_item_table(benchmark, item_col, item_text_col), "short-items"))
    return found if short is None else found.union(short)


def decontaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose id leaks no item. The leaking ids are broadcast after they were counted, else shuffled."""
    return selected(df, contaminations(df, benchmark, id_col=id_col, **options).withColumnRenamed("doc_id", id_col), id_col, "left_anti")
