"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the tokens of a window and ignore the others, so a
window still has the same hash when an ignored token was replaced.  The hashes
of all windows of the test items and of all windows of the training texts are
joined.  Around every hit the two texts are laid side by side, and the item
counts as leaked where enough tokens agree: most of the item, or nearly all of
a stretch of ``STRETCH`` tokens.  An item of fewer than ``WHOLE_BELOW`` words
must stand there whole: a few common words in a row are in any text.

No such place is without a hit, so the result is what that rule says for items
of any length.  Where 60% of an item agree, some five tokens in a row hold
three that do: if neither the blocks of five nor the r tokens behind the last
of q blocks had three, at most 2q + min(r, 2) would agree, fewer than the
3q + 0.6r of the rule for q >= 1, or r = 4 alone.  The masks are all ways to choose
three of five tokens; items of two or three words need two, those of one word
one.  Eleven tokens of thirteen hold three of five all the more.

Texts are searched in pieces, and a hit takes along the tokens beside its item
only, so memory follows an item's length times a piece's hits, not a text's
length times its hits.

Everything is built-in column expressions.  The test items' hashes are
broadcast while the items have at most ``BROADCAST_WORDS`` words in all;
beyond that the hashes are joined by shuffle and the pieces met again by
``doc_id`` and place, with the same result.

Results for odd input: a null or empty text holds no item; an item without
words is in no text; rows without ``doc_id`` or ``item_id`` are skipped; repeated rows give one result per
document and item; items with equal texts are all reported; empty tables give
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import table
from jobmix.llm.quality import let

# Positions of a window that count ("1") and that may differ ("0").
MASKS = ("111", "1011", "1101", "10011", "10101", "11001", "11", "101", "1")
# The item is leaked if this share of its tokens agrees, or so many tokens of a stretch.
MIN_SHARE, STRETCH, MIN_IN_STRETCH = 0.6, 13, 11
# Shorter items need all of their tokens.
WHOLE_BELOW = 8
BROADCAST_WORDS = 200_000
# Texts are searched in pieces of so many words, or of the longest item's.
PIECE = 1024
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), lambda w: w != "")


def hashed(words: Column) -> Column:
    """64-bit hashes of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def weight(tokens: Column) -> Column:
    """How many tokens the masks of an item select: as many as any leak of it has close together."""
    return F.when(F.size(tokens) == 1, 1).when(F.size(tokens) < 4, 2).otherwise(3)


def pieces(docs: DataFrame, reach: int) -> DataFrame:
    """``doc_id``, ``start`` and ``t``: the texts cut into pieces, each with the ``reach`` tokens before and behind it.

    ``first`` and ``last`` are the places in ``t`` of the piece's own tokens.
    """
    step = max(PIECE, reach)

    def cut(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.struct(
            i.alias("at"), F.slice(words, F.greatest(i - reach, F.lit(0)) + 1,
                                   F.least(i, F.lit(reach)) + step + reach).alias("words")))
    cut_up = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.explode(let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, cut(w)))).alias("p"))
    first = F.least(F.col("p.at"), F.lit(reach))
    # Words are hashed here, not before the cut: Spark compiles no function of elements, and where one stands, rows
    # go on singly.  Compiled code keeps all that it makes of one row, here of a piece, before it hands it on.
    return cut_up.select("doc_id", (F.col("p.at") - first).alias("start"), first.alias("first"),
                         (F.least(first + step, F.size("p.words")) - 1).alias("last"),
                         hashed(F.col("p.words")).alias("t"))


def windows(tokens: DataFrame, masks: list[str]) -> DataFrame:
    """``tokens`` (``t``, ``first``, ``last`` and others) with a row for each place ``at`` and mask: ``mask``, ``seed``.

    A seed is the hash of the tokens that a mask selects in the window at a
    place.  Little code per row: a method over 8,000 bytes is not compiled.
    """
    near = tokens.select("*", F.explode(F.sequence("first", "last")).alias("at"))
    seeds = F.array(*[F.when(F.col("at") + len(m) <= F.size("t"), F.xxhash64(F.lit(i), *[
        F.get("t", F.col("at") + k) for k, c in enumerate(m) if c == "1"])) for i, m in enumerate(masks)])
    return near.select(*tokens.columns, "at", F.posexplode(seeds).alias("mask", "seed")).where("seed is not null")


def before(t: Column, at: Column) -> Column:
    """The token before a place; null at the first."""
    return F.get(t, at - 1)


def beside(t: Column, shift: Column, n_item: Column) -> list[Column]:
    """``part``, the tokens beside an item whose first token is at ``shift``, and how many of the item come before them."""
    cut_off = F.greatest(-shift, F.lit(0))
    return [F.slice(t, F.greatest(shift, F.lit(0)) + 1, n_item - cut_off).alias("part"), cut_off.alias("cut_off")]


def agreement(t: Column, item: Column, shift: Column) -> Column:
    """Laid side by side with the item's first token at ``shift``: tokens that agree, and most in a stretch."""
    flags = F.transform(item, lambda x, i: F.when(F.get(t, shift + i) == x, 1).otherwise(0))

    def measure(f: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(f) - STRETCH + 1, F.lit(1)))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
        in_stretch = F.array_max(F.transform(starts, lambda i: total(F.slice(f, i, STRETCH))))
        # Most hits are by chance and need no stretch.
        return let(total(f), lambda n: F.struct(
            n.alias("agree"), F.when(n >= MIN_IN_STRETCH, in_stretch).otherwise(n).alias("in_stretch")))
    return let(flags, measure)


def contaminated(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document and leaked item.

    ``doc_id, item_id, n_agree`` (most tokens that agree), ``n_item`` (tokens
    of the item), ``share`` and ``first_word`` (where the item begins in the
    document, counted in words; negative if its beginning is cut off).
    """
    tests = (items.where("item_id is not null")
             .select(F.col("item_id").cast("bigint").alias("item_id"), hashed(words_of(F.col("text"))).alias("t"))
             .where(F.size("t") > 0).distinct())
    n_words, longest, weights = tests.agg(F.sum(F.size("t")), F.max(F.size("t")),
                                          F.collect_set(weight(F.col("t")))).first()
    # Only the masks that some item needs are laid over the documents.
    masks = [m for m in MASKS if m.count("1") in (weights or [3])]
    chosen = F.get(F.array(*[F.lit(m.count("1")) for m in masks]), F.col("mask")) == weight(F.col("t"))
    places = tests.withColumns({"first": F.lit(0), "last": F.size("t") - 1})
    seeds = windows(places, masks).where(chosen).select(
        "item_id", "seed", F.col("at").alias("item_at"), F.size("t").alias("n_item"),
        before(F.col("t"), F.col("at")).alias("item_before"))
    whole = tests.select("item_id", F.col("t").alias("item"))
    t = pieces(docs, max(longest or 0, *map(len, MASKS)))
    shift, n_item = F.col("at") - F.col("item_at"), F.col("n_item")
    # What goes on from here has an item's length, not a text's.
    if (n_words or 0) <= broadcast_words:
        # Only the first hits of a row of hits are laid side by side.  Where the tokens before agree too, there is a
        # hit one place before: that token, the hit's first and, of three, its second are what some mask selects.
        hits = (windows(t, masks).join(F.broadcast(seeds), "seed")
                .where(F.coalesce(before(F.col("t"), F.col("at")) != F.col("item_before"), F.lit(True)))
                .select("doc_id", "item_id", (F.col("start") + shift).alias("shift"), *beside(F.col("t"), shift, n_item))
                .join(F.broadcast(whole), "item_id"))
    else:
        hits = (windows(t, masks).select("doc_id", "start", "at", "seed").join(seeds, "seed")
                .select("doc_id", "start", "item_id", n_item, shift.alias("near")).distinct()
                .join(t, ["doc_id", "start"])
                .select("doc_id", "item_id", (F.col("start") + F.col("near")).alias("shift"),
                        *beside(F.col("t"), F.col("near"), n_item))
                .join(whole, "item_id"))
    laid = hits.select("doc_id", "item_id", "shift", F.size("item").alias("n_item"),
                       agreement(F.col("part"), F.col("item"), -F.col("cut_off")).alias("a"))
    needed = F.when(F.col("n_item") < WHOLE_BELOW, F.col("n_item")).otherwise(MIN_SHARE * F.col("n_item"))
    leaked = laid.where((F.col("a.agree") >= needed)
                        | (F.col("a.in_stretch") >= MIN_IN_STRETCH))
    best = F.max(F.struct(F.col("a.agree").alias("agree"), (-F.col("shift")).alias("back")))
    return (leaked.groupBy("doc_id", "item_id").agg(F.max("n_item").cast("bigint").alias("n_item"), best.alias("b"))
            .select("doc_id", "item_id", F.col("b.agree").cast("bigint").alias("n_agree"), "n_item",
                    (F.col("b.agree") / F.col("n_item")).alias("share"),
                    (-F.col("b.back")).cast("bigint").alias("first_word")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
