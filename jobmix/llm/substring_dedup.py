"""Substring dedup by fixed-block anchors: long passages that stand anywhere else go.

A passage is repeated if a window of ``WINDOW`` words starts in two places.

*Anchors.*  Each document is cut into non-overlapping blocks of ``BLOCK``
words, the references.  Any window holds a whole block of its own document, as
``2 BLOCK - 1 <= WINDOW``; so of two equal windows, each meets a block of the
other's document with one of its own rolling windows of ``BLOCK`` words.  All
rolling windows are probes against the index of the blocks' hashes, dealt to
parts by hash.

*Extension.*  A hit says that ``BLOCK`` words may be repeated.  Around each
hit, all placements of ``WINDOW`` words that hold it are compared, by 64 bits of
hash and the part's number, with those around all other hits.  What agrees
with another place is repeated; its overlapping windows make up the maximal
repeats, which are cut.

*Sizes.*  Tasks work on batches of about ``BATCH_WORDS`` words.  Within one, a hash
is sent once: what a batch repeats it knows by itself, and others only need
to learn that it is there.  So a passage in a third of all documents sends
one entry for each batch, not one for each place, and no pairs are made.
Entries are packed (hash and place, 6 or 10 bytes); answers are places.
Only texts with hits are read for the extension, only those with repeats are
cut; they meet their spans by a broadcast while these are small (checked), else
by a shuffle.

Results for odd input: a null or empty text has no words, is kept as it is and
has the hash of an empty text; a text of fewer words than a window loses
nothing; rows that repeat, with or without the same ``doc_id``, are documents
of their own, so their long texts go; rows without ``doc_id`` take part and
come back; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import arrow_schema, map_batches, materialize, table

WINDOW = 35
# Twice this, less one, is the window: a window holds a block wherever it starts.
BLOCK = (WINDOW + 1) // 2
BATCH_WORDS = 1_000_000
# Words for each part that hashes are dealt to.
PART_WORDS = 1_500_000
# Spans of at most this many bytes are broadcast.
BROADCAST_BYTES = 32 << 20

KEY = {"doc_id": pa.int64(), "text_id": pa.int64()}
# An entry row: hashes of a batch for a part, by place; a batch's own row has its documents and known places.
ENTRIES = arrow_schema({
    "part": pa.int64(), "batch": pa.int64(), "hashes": pa.binary(), "places": pa.binary(), "kinds": pa.binary(),
    "ids": pa.binary(), "starts": pa.binary()})
SPANS = arrow_schema({**KEY, "spans": pa.binary(), "n": pa.int64()})
PROFILE = arrow_schema({**KEY, "n_words": pa.int64(), "whole": pa.string()})
CUT = arrow_schema({**KEY, "n_removed": pa.int64(), "kept": pa.string()})
# What an entry is: a probe wants an answer; a reference answers others.
PROBE, REFERENCE = 1, 2
NO_ID = -2 ** 63
SECOND = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words; remembers those of at most ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` words, put together from powers of two."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found, have, power, step = None, 0, mix(words + np.uint64(1)), 1
    while True:
        if width & step:
            if found is None:
                found, have = power, step
            else:
                m = len(words) - have - step + 1
                found = mix(found[:m] * np.uint64(0x9E3779B97F4A7C15) + power[have:have + m] + np.uint64(step))
                have += step
        if have == width:
            return found[:n]
        m = len(power) - step
        power = mix(power[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + power[step:step + m])
        step *= 2


def joined_spans(starts: np.ndarray, width: int) -> np.ndarray:
    """Ascending, apart ``(start, stop)`` pairs that cover windows of ``width`` at sorted ``starts``."""
    if not len(starts):
        return np.empty((0, 2), np.uint32)
    breaks = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.r_[0, breaks + 1]]
    last = starts[np.r_[breaks, len(starts) - 1]] + width
    return np.stack([first, last], 1).astype(np.uint32)


class Batch:
    """Windows of several documents, sent by their hashes.

    A place is the number of a window's first word in the batch.  ``deal``
    chooses the part and ``hash_bytes`` of ``hashes`` tell a part's windows apart.
    """

    def __init__(self, number: int, parts: int, hash_bytes: int):
        self.number, self.parts, self.hash_bytes = number, parts, hash_bytes
        self.words = 0
        self.ids: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.deal: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []

    def add(self, doc_id: int | None, text_id: int, n_words: int, at: np.ndarray, hashes: np.ndarray,
            deal: np.ndarray, kinds: np.ndarray) -> None:
        """A document's windows that start at its words ``at``."""
        if len(at):
            self.ids.append((NO_ID if doc_id is None else doc_id, text_id))
            self.starts.append(self.words)
            self.hashes.append(hashes)
            self.deal.append(deal)
            self.places.append(at + self.words)
            self.kinds.append(kinds)
            self.words += n_words

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.hashes:
            return
        hashes, deal, places, kinds = (np.concatenate(x) for x in (self.hashes, self.deal, self.places, self.kinds))
        order = np.argsort(hashes, kind="stable")
        hashes, deal, places, kinds = hashes[order], deal[order], places[order], kinds[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(hashes)])
        again = np.repeat(sizes > 1, sizes)
        # Several places are known to be repeated: they need no answer, but others may.
        kind = np.bitwise_or.reduceat(kinds, first) & np.where(sizes > 1, REFERENCE, PROBE | REFERENCE).astype(np.uint8)
        sent = kind > 0
        hashes, kind, at = hashes[first][sent], kind[sent], places[first][sent]
        part = (deal[first][sent] % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((at, part))
        part, hashes, kind, at = part[order], hashes[order], kind[order], at[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        rows = [(self.number % self.parts, self.number, None, places[again].astype(np.uint32).tobytes(), None,
                 np.array(self.ids, np.int64).tobytes(), np.array(self.starts, np.uint32).tobytes())]
        for lo, hi in zip(cut, np.r_[cut[1:], len(part)]):
            own = hashes[lo:hi].view(np.uint8).reshape(-1, 8)[:, :self.hash_bytes]
            rows.append((int(part[lo]), self.number, own.tobytes(), gaps(at[lo:hi]), kind[lo:hi].tobytes(), None, None))
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows[i:i + 64]], f.type) for k, f in enumerate(ENTRIES)], schema=ENTRIES)


def gaps(places: np.ndarray) -> bytes:
    """Ascending places as differences of two bytes; a full one adds to the next."""
    wide = np.diff(places, prepend=0).astype(np.int64)
    full, rest = wide // 65535, wide % 65535
    out = np.full(len(wide) + int(full.sum()), 65535, np.uint16)
    out[np.cumsum(full + 1) - 1] = rest
    return out.tobytes()


def ungapped(data: bytes) -> np.ndarray:
    wide = np.frombuffer(data, np.uint16).astype(np.int64)
    return np.cumsum(wide)[wide != 65535]


def slices(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


def batch_number(k: int) -> int:
    """A number for the ``k``-th batch of this task that no other batch has."""
    return (TaskContext.get().partitionId() << 32) + k


def entries(texts: DataFrame, parts: int) -> DataFrame:
    """Rolling windows of ``BLOCK`` words of ``doc_id, text_id, text``; those at multiples of it are references, too.

    Four bytes of hash and the part's number find hits; a chance hit costs a comparison.
    """
    def run(batches):
        known, k = WordHashes(), 0
        batch = Batch(batch_number(k), parts, 4)
        for rows in slices(batches):
            for doc_id, text_id, text in zip(*rows):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                hashes = rolling(known.of(words), BLOCK)
                kinds = np.full(len(hashes), PROBE, np.uint8)
                kinds[::BLOCK] = PROBE | REFERENCE
                batch.add(doc_id, text_id, len(words), np.arange(len(hashes)), hashes, hashes >> np.uint64(32), kinds)
                if batch.words >= BATCH_WORDS:
                    yield from batch.rows()
                    k += 1
                    batch = Batch(batch_number(k), parts, 4)
        yield from batch.rows()
    return map_batches(texts, run, ENTRIES)


def extended(hits: DataFrame, parts: int) -> DataFrame:
    """Windows of ``WINDOW`` words that hold a hit of ``doc_id, text_id, text, spans``.

    Parts are dealt by a second hash: what tells windows apart grows with the number of parts.
    """
    def run(batches):
        known, k = WordHashes(), 0
        batch = Batch(batch_number(k), parts, 8)
        for rows in slices(batches):
            for doc_id, text_id, text, own in zip(*rows):
                words = words_of(text)
                near = np.zeros(len(words) + 1, np.int64)
                for start, stop in np.frombuffer(own, np.uint32).reshape(-1, 2).tolist():
                    # Hits start at start to stop - BLOCK; windows that hold one, up to WINDOW - BLOCK words before.
                    near[max(start - (WINDOW - BLOCK), 0)] += 1
                    near[min(stop - BLOCK + 1, len(words))] -= 1
                at = np.flatnonzero(np.cumsum(near[:max(len(words) - WINDOW + 1, 0)]) > 0)
                hashed = known.of(words)
                batch.add(doc_id, text_id, len(words), at, rolling(hashed, WINDOW)[at],
                          rolling(hashed ^ SECOND, WINDOW)[at], np.full(len(at), PROBE | REFERENCE, np.uint8))
                if batch.words >= BATCH_WORDS:
                    yield from batch.rows()
                    k += 1
                    batch = Batch(batch_number(k), parts, 8)
        yield from batch.rows()
    return map_batches(hits, run, ENTRIES)


def answers(entries: DataFrame, hash_bytes: int) -> DataFrame:
    """Entry rows of each batch whose ``places`` are those that another place repeats.

    A part's hashes meet in one task: about ``PART_WORDS``, and of one hash at
    most an entry a batch.
    """
    def answered(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        wide = [np.zeros((len(h[3]), 8), np.uint8) for h in held]
        for w, h in zip(wide, held):
            w[:, :hash_bytes] = np.frombuffer(h[1], np.uint8).reshape(-1, hash_bytes)
        hashes = [w.view(np.uint64).ravel() for w in wide]
        kinds = [np.frombuffer(h[3], np.uint8) for h in held]
        references = np.concatenate([h[k & REFERENCE > 0] for h, k in zip(hashes, kinds)])
        index, n = np.unique(references, return_counts=True)
        if not len(index):
            return
        for (number, _, places, _), own, kind in zip(held, hashes, kinds):
            asks = kind & PROBE > 0
            at = ungapped(places)[asks]
            own, kind = own[asks], kind[asks]
            slot = np.minimum(np.searchsorted(index, own), len(index) - 1)
            # A probe that is a reference itself needs another one.
            hit = (index[slot] == own) & (n[slot] > (kind & REFERENCE > 0))
            if hit.any():
                yield row(number, at[hit].astype(np.uint32).tobytes(), None, None)

    def row(number, places, ids, starts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((number, places, ids, starts), schema)], schema=schema)

    schema = arrow_schema({"batch": pa.int64(), "places": pa.binary(), "ids": pa.binary(), "starts": pa.binary()})

    def run(batches):
        at, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, hashes, places, kinds, ids, starts = (c[i].as_py() for c in batch.columns)
                if ids is not None:
                    yield row(number, places, ids, starts)
                    continue
                if part != at and held:
                    yield from answered(held)
                    held = []
                at = part
                held.append((number, hashes, places, kinds))
        if held:
            yield from answered(held)

    return map_batches(entries.repartition("part").sortWithinPartitions("part"), run, schema)


def spans_of(answered: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_id, spans, n``: what the answered places of each document cover, and their number."""
    def of_batch(places: list[bytes], ids: bytes, starts: bytes):
        at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places]))
        first = np.frombuffer(starts, np.uint32)
        cuts = np.searchsorted(at, np.r_[first[1:], np.iinfo(np.uint32).max])
        low = 0
        for (doc_id, text_id), begin, high in zip(np.frombuffer(ids, np.int64).reshape(-1, 2).tolist(),
                                                  first.tolist(), cuts.tolist()):
            if high > low:
                spans = joined_spans(at[low:high] - np.uint32(begin), width).tobytes()
                yield None if doc_id == NO_ID else doc_id, text_id, spans, int(high - low)
            low = high

    def run(batches):
        number, places, ids, starts = None, [], None, None

        def done():
            rows = list(of_batch(places, ids, starts)) if ids is not None else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SPANS)], schema=SPANS)

        for batch in batches:
            for i in range(batch.num_rows):
                own, more, its_ids, its_starts = (c[i].as_py() for c in batch.columns)
                if own != number:
                    yield from done()
                    number, places, ids, starts = own, [], None, None
                places.append(more)
                if its_ids is not None:
                    ids, starts = its_ids, its_starts
        yield from done()

    return map_batches(answered.repartition("batch").sortWithinPartitions("batch"), run, SPANS)


def profiles(texts: DataFrame) -> DataFrame:
    """Each row's key, number of words, and the hash of its words joined by blanks."""
    def run(batches):
        for ids, text_ids, many in slices(batches):
            words = [words_of(t) for t in many]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(text_ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())], schema=PROFILE)
    return map_batches(texts, run, PROFILE)


def with_spans(texts: DataFrame, spans: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, text_id, text, spans`` of the texts that have spans.

    ``spans`` repeats a key where rows do; all windows of such rows are repeated, so one's spans are as good as another's.
    """
    one = (spans.groupBy("doc_id", "text_id").agg(F.max("spans").alias("spans"))
           .select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "spans"))
    if (spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0) <= most:
        one = F.broadcast(one)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text_id"))
    return texts.join(one, same).select("doc_id", "text_id", "text", "spans")


def cut(spans: DataFrame) -> DataFrame:
    """Key, words removed and the hash of the words kept, of ``doc_id, text_id, text, spans``."""
    def run(batches):
        for slice_ in slices(batches):
            rows = []
            for doc_id, text_id, text, span in zip(*slice_):
                words, kept, gone, at = words_of(text), [], 0, 0
                for start, stop in np.frombuffer(span, np.uint32).reshape(-1, 2).tolist():
                    kept.extend(words[at:start])
                    gone, at = gone + stop - start, stop
                kept.extend(words[at:])
                rows.append((doc_id, text_id, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(CUT)], schema=CUT)
    return map_batches(spans, run, CUT)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, text``: rows that agree in the first two are alike throughout."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_id"), text.alias("text"))


def repeats(texts: DataFrame, n_words: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, text_id, spans, n``: the words of each text (see :func:`keyed`) that a repeated window covers.

    ``spans`` holds ascending pairs (start, stop) of 32-bit numbers.  The rows must come in the same order when
    they are read again, as those of a table do.
    """
    found = entries(texts, max(1, n_words // PART_WORDS))
    hits = materialize(spans_of(answers(found, 4), BLOCK))
    windows = hits.agg(F.sum("n")).first()[0] or 0
    around = extended(with_spans(texts, hits, broadcast_bytes), max(1, windows // PART_WORDS))
    return materialize(spans_of(answers(around, 8), WINDOW))


def dedup_substrings(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row: words that repeated windows cover are removed."""
    texts = keyed(docs)
    profile = materialize(profiles(texts))
    n_words = profile.agg(F.sum("n_words")).first()[0] or 0
    spans = repeats(texts, n_words, broadcast_bytes)
    removed = cut(with_spans(texts, spans, broadcast_bytes)).groupBy("doc_id", "text_id").agg(
        F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    removed = removed.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_id", "_text_id")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text_id"))
    return profile.join(removed, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
