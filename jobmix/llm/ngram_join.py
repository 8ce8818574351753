"""N-gram Jaccard join by PartEnum signatures, with the components of its links.

Two documents link when the Jaccard similarity of their sets of word 5-grams
is at least 3/4.  That bounds the number of 5-grams in just one of two sets
of sizes x and y by (x + y) / 7.

*Signatures.*  Sets are banded by size, powers of two; a band is one instance
and so is each border between bands, for the sets on both sides of it that
may still be similar.  An instance has a bound ``k`` on the differences of
its pairs.  Hashing deals the 5-grams to ``n1`` partitions, and those of each
partition to ``n2`` parts.  As ``k`` differences cannot spoil every
partition with more than ``k2`` each, similar sets agree on some partition but
for ``k2`` of its parts; so the hash of every choice of ``n2 - k2`` parts is a
signature, and similar sets share one.  Choices without any 5-gram are left
out, and ``n1`` is large enough to make up for that; a set with too many of
them has signatures for these, too, so no pair is lost.

*Fewer signatures.*  There are more partitions with 5-grams than differences
can spoil, so similar sets share several signatures.  In one order of all
signatures the first shared one stands near the front, and a set keeps only as
many as may stand up to there.  Those that are frequent in a sample come last, so a
passage that many texts share makes a large group only of sets that hold little else.

*Candidates.*  Signatures are packed, dealt to parts of bounded size and
sorted there.  Every group gives a star: its first set with each other one.
Groups of up to ``SMALL_GROUP`` sets also give their other pairs, which are only
compared if the stars have left them in different components.  Candidates
whose counts by hash bucket already differ too much are dropped - the
difference of the counts is a lower bound of the difference of the sets: first
by 96 buckets, then by about as many as a set has 5-grams, half a byte each -
and the others compared exactly.

*The rest of large groups* (copies, or a passage that many texts share).  Sets of a large group that the stars have put
into one component need no more pairs.  All sets of groups that still hold
several components are signed again, now with the signatures of all large groups
last; and those of groups that even then hold several are joined exactly by prefix filtering: in one order for all sets,
here with frequent 5-grams last, two similar sets share one of their first
5-grams.  Only pairs from different components are compared.

Results for odd input: texts without words (null, empty, white space) have
the empty set, link with nothing, and are their own component; rows without
``doc_id`` are left out; rows with the same ``doc_id`` give a row each, and
one component if their texts link or are equal; equal sets always share a
component; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import ASCII_LOWER, arrow_schema, map_batches, materialize, scratch_path, table

SHINGLE = 5
# Linked: SIMILAR_OF * intersection >= SIMILAR * union, in hundredths.
SIMILAR, SIMILAR_OF = 75, 100
SMALL_GROUP = 32
# Buckets of the counts by which candidates are dropped.
BUCKETS = 96
# Identifiers of at most this many sets are broadcast (16 bytes each).
BROADCAST_SETS = 500_000
# The prefix filter's order is taken from this many sets, and puts at most so many 5-grams last.
ORDER_SAMPLE, ORDER_GRAMS = 20_000, 100_000
# The signatures' order is taken from about this many documents, and puts at most so many signatures last.
SIG_SAMPLE, SIG_FREQUENT = 5_000, 100_000
# First shared 5-grams of a set by which a pair found before is known.
EARLY = 8
# Signatures go to Spark in batches of about this many rows.
BATCH_ROWS = 500_000

PROFILE = {"doc_id": pa.int64(), "set_id": pa.int64(), "size": pa.int64(), "counts": pa.binary(), "fine": pa.binary()}
# 5-grams for each part that signatures are dealt to (some two million signatures), and bytes of text for each 5-gram.
PART_GRAMS, GRAM_BYTES = 4_000_000, 6
# A part's signatures are sorted in so many slices (a power of two), one after the other.
SLICES = 8
# Bytes of a signature that tell it from others of its part.
SIG_BYTES = 5
HEADS = arrow_schema({"sig": pa.int64(), "set_id": pa.int64(), "place": pa.int32()})
# Kinds of rows: an edge of a star, another pair of a small group, a member of a large one, a document's profile.
STAR, PAIR, MEMBER, DOCUMENT = 0, 1, 2, 3
PACKED = arrow_schema({"part": pa.int64(), "sigs": pa.binary(), "places": pa.binary(), "names": pa.binary(), **PROFILE})
GROUPS = arrow_schema({"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), **PROFILE})
# Profiles travel with the signatures, spread over this many parts below zero.
PROFILE_PARTS = 4096
# Pairs that a task collects before it passes them on.
PAIR_ROWS = 200_000
SHORT = arrow_schema({"set_id": pa.int64(), "short": pa.binary()})


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of the distinct 5-grams of texts; remembers hashes of words."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def grams(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of each text; the hashing of 5-grams runs over all texts at once."""
        words = [(t or "").encode().translate(ASCII_LOWER).split() for t in texts]
        widths = [min(SHINGLE, len(w)) for w in words]
        # A text's words, then as many zeros as keep its windows inside its own part.
        parts = [x for w in words for x in (self._hashes(w), _PAD)]
        flat = np.concatenate(parts) if parts else _PAD
        n = len(flat) - SHINGLE + 1
        out = np.full(max(n, 0), np.uint64(SHINGLE))
        for i in range(SHINGLE):
            out = mix(out + flat[i:i + n] + np.uint64(i + 1))
        sets, at = [], 0
        for w, width in zip(words, widths):
            # A text of fewer words is one shingle, its window filled up with zeros.
            sets.append(np.unique(out[at:at + len(w) - width + 1]) if w else np.empty(0, np.uint64))
            at += len(w) + SHINGLE - 1
        return sets


# Zeros after a text's words.
_PAD = np.zeros(SHINGLE - 1, np.uint64)


def set_id(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def counts(grams: np.ndarray) -> bytes:
    """How many 5-grams fall into each of ``BUCKETS`` buckets, up to 255."""
    return np.minimum(np.bincount((grams % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS),
                      255).astype(np.uint8).tobytes()


def fine_counts(grams: np.ndarray) -> bytes:
    """Counts, up to 15, in about as many buckets as there are 5-grams; two in a byte."""
    buckets = max(64, 1 << (max(len(grams), 1) - 1).bit_length())
    found = np.minimum(np.bincount((grams & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 15)
    return (found[::2] | found[1::2] << 4).astype(np.uint8).tobytes()


def fine_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the difference of two sets; the finer counts are folded to the other's buckets."""
    def wide(data: bytes) -> np.ndarray:
        packed = np.frombuffer(data, np.uint8)
        return np.stack([packed & 15, packed >> 4], 1).ravel().astype(np.int16)

    a, b = wide(x), wide(y)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        # Of clipped counts, the clipped sum is that of the counts.
        a = np.minimum(a[:len(a) // 2] + a[len(a) // 2:], 15)
    return int(np.abs(a - b).sum())


def most_differences(x: int, y: int) -> int:
    """Most 5-grams in just one of two similar sets of these sizes."""
    return (x + y) * (SIMILAR_OF - SIMILAR) // (SIMILAR_OF + SIMILAR)


class Instance:
    """Partitions for the sets of one band, or of one border between bands."""

    def __init__(self, number: int, top: int, largest: int):
        """``top``: the largest first size; ``largest``: the largest second one."""
        self.number, self.largest = number, largest
        k = most_differences(top, largest)
        self.k2, self.n2 = (1, 3) if largest <= 64 else (0, 1)
        spoiled = k // (self.k2 + 1)
        self.n1 = spoiled + 1 + ceil(0.035 * largest / (self.k2 + 1) + 3 * sqrt(0.014 * largest)) + self.k2
        self.choices = list(combinations(range(self.n2), self.n2 - self.k2))

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """Signatures of one set."""
        size = len(grams)
        place = mix(grams + np.uint64(self.number + 1)) % np.uint64(self.n1 * self.n2)
        at = place.astype(np.int64)
        # Sums of hashes: exact in 64-bit arithmetic, whatever the order.
        order = np.argsort(at, kind="stable")
        sums = np.zeros(self.n1 * self.n2, np.uint64)
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        sums[at[order][starts]] = np.add.reduceat(mix(grams[order] + np.uint64(0x5851F42D4C957F2D)), starts)
        parts = sums.reshape(self.n1, self.n2)
        used = np.bincount(at, minlength=self.n1 * self.n2).reshape(self.n1, self.n2)
        cells = np.arange(self.n1, dtype=np.uint64)
        found, kept = [], []
        for c, choice in enumerate(self.choices):
            total = np.zeros(self.n1, np.uint64)
            for j in choice:
                total = mix(total + parts[:, j] + np.uint64(j + 1))
            found.append(mix(total + mix((np.uint64(self.number) << np.uint64(40))
                                         + (cells << np.uint64(8)) + np.uint64(c))))
            kept.append(used[:, choice].sum(1) > 0)
        if self.deficient(size, int(np.logical_and.reduce(kept).sum())):
            return np.concatenate(found)
        return np.concatenate([f[k] for f, k in zip(found, kept)])

    def spoiled(self, size: int) -> int:
        """Most partitions on which a set of this size and a similar one disagree."""
        return most_differences(size, min(self.largest, size * SIMILAR_OF // SIMILAR)) // (self.k2 + 1)

    def deficient(self, size: int, full: int) -> bool:
        """Whether ``full`` partitions without an empty choice are too few to be sure of a shared one."""
        return full <= self.spoiled(size)

    def first_signatures(self, grams: np.ndarray, order: Order) -> np.ndarray:
        """The signatures of one set that may be the first which it shares with a similar one.

        Similar sets share a signature of each partition that has no empty
        choice and is not spoiled; so the first shared one has at least as
        many less one behind it.  A deficient set keeps all: its signatures of
        empty choices need not be shared.
        """
        found = self.signatures(grams)
        place = mix(grams + np.uint64(self.number + 1)) % np.uint64(self.n1 * self.n2)
        used = np.bincount(place.astype(np.int64), minlength=self.n1 * self.n2).reshape(self.n1, self.n2)
        full = int(np.logical_and.reduce([used[:, c].sum(1) > 0 for c in self.choices]).sum())
        if self.deficient(len(grams), full):
            return found
        keep = len(found) - (full - self.spoiled(len(grams))) + 1
        return found[np.argsort(order.keys(found))[:keep]]


def named(sigs: np.ndarray, parts: int) -> np.ndarray:
    """Names of signatures as their groups have them: unique over all parts but for chance."""
    # The low bits deal the parts; some of the others tell signatures of a part apart.
    own = sigs // np.uint64(parts) & np.uint64((1 << 8 * SIG_BYTES) - 1)
    return mix(own + (sigs % np.uint64(parts) << np.uint64(8 * SIG_BYTES)))


class Order:
    """One order of all signatures: by their hash, with ``frequent`` ones last, the most frequent at the end."""

    def __init__(self, frequent: dict[int, int], parts: int):
        """``frequent``: names of signatures, as signed numbers, and about how many sets have them."""
        rows = sorted((name % 2**64, n) for name, n in frequent.items())
        self.late = np.array([name for name, _ in rows], np.uint64)
        self.rank = np.array([min(n.bit_length(), 15) for _, n in rows], np.uint64)
        self.parts = parts

    def keys(self, sigs: np.ndarray) -> np.ndarray:
        """Numbers by which signatures are sorted; equal only for equal signatures, but for chance."""
        keys = sigs >> np.uint64(4)
        if len(self.late):
            names = named(sigs, self.parts)
            at = np.minimum(np.searchsorted(self.late, names), len(self.late) - 1)
            keys |= np.where(self.late[at] == names, self.rank[at], np.uint64(0)) << np.uint64(60)
        return keys


def instances_of(size: int, made: dict[int, Instance]) -> list[Instance]:
    """The instances that a set of this size belongs to."""
    band = max(size - 1, 0).bit_length()
    top = 1 << band
    wanted = [(2 * band, top, top)]
    if size * SIMILAR_OF >= top * SIMILAR:
        wanted.append((2 * band + 1, top, top * SIMILAR_OF // SIMILAR))
    if band and size <= (top // 2) * SIMILAR_OF // SIMILAR:
        wanted.append((2 * band - 1, top // 2, (top // 2) * SIMILAR_OF // SIMILAR))
    for number, first, second in wanted:
        if number not in made:
            made[number] = Instance(number, first, second)
    return [made[w[0]] for w in wanted]


def _texts(batches, size: int = 256):
    """Columns of slices of batches, as lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from Parquet in the shared folder, a few columns of it at a time."""
    path = scratch_path(df.sparkSession, "ngram-join")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _batch(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch with these columns; the others of the schema are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema],
                                      schema=schema)


def _profile_batch(ids: list, names: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """Documents with the identifier and size of their sets, and counts by few and by many buckets."""
    return _batch(PACKED, {
        "part": pa.array([-1 - n % PROFILE_PARTS for n in names], pa.int64()),
        "doc_id": pa.array(ids, pa.int64()), "set_id": pa.array(names, pa.int64()),
        "size": pa.array([len(g) for g in grams], pa.int64()), "counts": pa.array([counts(g) for g in grams], pa.binary()),
        "fine": pa.array([fine_counts(g) for g in grams], pa.binary())})


def whole_signatures(grams: list[np.ndarray], own: list[Instance]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many sets with an instance each whose partitions have one part; and whose they are."""
    sizes = np.array([len(g) for g in grams])
    cells = np.array([i.n1 for i in own])
    number = np.array([i.number for i in own], np.uint64)
    owner = np.repeat(np.arange(len(grams)), sizes)
    flat = np.concatenate(grams)
    place = (mix(flat + number[owner] + np.uint64(1)) % cells.astype(np.uint64)[owner]).astype(np.int64)
    first = np.cumsum(cells) - cells
    at = first[owner] + place
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    starts = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    sums = np.add.reduceat(mix(flat[order] + np.uint64(0x5851F42D4C957F2D)), starts)
    cell = sorted_at[starts]
    whose = owner[order][starts]
    found = mix(mix(sums + np.uint64(1)) + mix((number[whose] << np.uint64(40))
                                               + ((cell - first[whose]).astype(np.uint64) << np.uint64(8))))
    return found, whose


def first_of_each(found: np.ndarray, whose: np.ndarray, keep: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Of the signatures ``found`` of every set the first ``keep[whose]`` in this order; and whose they are."""
    at = np.argsort(order.keys(found))
    # A stable sort of 16-bit numbers takes linear time.
    at = at[np.argsort(whose[at].astype(np.uint16 if len(keep) <= 1 << 16 else np.int64), kind="stable")]
    found, whose = found[at], whose[at]
    starts = np.searchsorted(whose, np.arange(len(keep)))
    kept = np.arange(len(whose)) - starts[whose] < keep[whose]
    return found[kept], whose[kept]


def frequent_signatures(docs: DataFrame, rows: int, parts: int, sample: int = SIG_SAMPLE,
                        most: int = SIG_FREQUENT) -> dict[int, int]:
    """Names of signatures that are frequent in a sample of ``docs`` (with so many rows), at most ``most``.

    They only come last in the order of the signatures, and no pair is lost
    in any order; so a bounded sample will do.  With each about how many
    documents of all have it.
    """
    schema = arrow_schema({"sig": pa.int64()})

    def run(batches):
        shingler, made, seen = Shingler(), {}, set()
        for _, texts in _texts(batches):
            found = [np.empty(0, np.uint64)]
            for grams in shingler.grams(texts):
                # Copies count once in a task.
                if len(grams) and (own := set_id(grams)) not in seen:
                    seen.add(own)
                    found.extend(i.signatures(grams) for i in instances_of(len(grams), made))
            yield pa.RecordBatch.from_arrays([pa.array(named(np.concatenate(found), parts).view(np.int64))], schema=schema)

    each = max(1, rows // sample)
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(each)) == 0)
    found = (map_batches(part, run, schema).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
             .orderBy(F.desc("n"), "sig").limit(most).collect())
    return {r["sig"]: r["n"] * each for r in found}


def large_groups(members: DataFrame, most: int = SIG_FREQUENT) -> dict[int, int]:
    """Names of the signatures of the largest groups, at most ``most``, and how many sets have them."""
    found = members.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a").limit(most).collect()
    return {r["a"]: r["n"] for r in found}


def signatures(docs: DataFrame, parts: int, frequent: dict[int, int], profiles: bool = True) -> DataFrame:
    """Signatures of the sets of ``docs`` (``doc_id, text``), packed by part; and, if wanted, the documents' profiles.

    Of a set's signatures only those that may be the first which it shares with
    a similar set, in one order that has the ``frequent`` ones last.

    A row holds a task's signatures of one part (of ``parts``, dealt by the
    signature): ``sigs`` by set, and a bit for each that tells whether it is
    of the next one of ``names``.  Packed, a signature moves as five bytes and
    a bit.  Equal sets of a batch count once.  A document's row has a part
    below zero.
    """
    order = Order(frequent, parts)

    def run(batches):
        shingler, made = Shingler(), {}
        sigs, owners, names, rows = [], [], [], 0

        def flush():
            yield from _packed(np.concatenate(sigs), np.concatenate(owners), np.array(names, np.int64), parts)

        for ids, texts in _texts(batches):
            many, instances, whose = [], [], []
            seen = set()
            sets = shingler.grams(texts)
            set_ids = [set_id(g) for g in sets]
            if profiles:
                yield _profile_batch(ids, set_ids, sets)
            for grams, own in zip(sets, set_ids):
                if not len(grams) or own in seen:
                    continue
                seen.add(own)
                names.append(own)
                for instance in instances_of(len(grams), made):
                    if instance.n2 == 1:
                        many.append(grams)
                        instances.append(instance)
                        whose.append(len(names) - 1)
                    else:
                        sigs.append(instance.first_signatures(grams, order))
                        owners.append(np.full(len(sigs[-1]), len(names) - 1, np.uint32))
                        rows += len(sigs[-1])
            if many:
                found, who = whole_signatures(many, instances)
                used = np.bincount(who, minlength=len(many))
                keep = np.array([i.spoiled(len(g)) + 1 for i, g in zip(instances, many)])
                for i in np.flatnonzero(used < keep):
                    # Too many empty partitions: signatures for these, too, and all of them.
                    extra = instances[i].signatures(many[i])
                    sigs.append(extra)
                    owners.append(np.full(len(extra), whose[i], np.uint32))
                    rows += len(extra)
                    keep[i] = 0
                found, who = first_of_each(found, who, keep, order)
                sigs.append(found)
                owners.append(np.array(whose, np.uint32)[who])
                rows += len(found)
            if rows >= BATCH_ROWS:
                yield from flush()
                sigs, owners, names, rows = [], [], [], 0
        if rows:
            yield from flush()
    return map_batches(docs, run, PACKED)


def _packed(sigs: np.ndarray, owners: np.ndarray, names: np.ndarray, parts: int):
    """Record batches of packed signatures, a row for each part."""
    part = (sigs % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((owners, part))
    part, sigs, owners = part[order], sigs[order], owners[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = []
    for start, stop in zip(starts, np.r_[starts[1:], len(part)]):
        whose = owners[start:stop]
        new = np.r_[False, whose[1:] != whose[:-1]]
        own = sigs[start:stop] // np.uint64(parts)
        rows.append((int(part[start]), own.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes(),
                     np.packbits(new).tobytes(), names[whose[np.r_[True, new[1:]]]].tobytes()))
        if len(rows) == 256:
            yield _packed_batch(rows)
            rows = []
    if rows:
        yield _packed_batch(rows)


def _packed_batch(rows) -> pa.RecordBatch:
    return _batch(PACKED, {f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(PACKED)[:4])})


def _unpacked(sigs: bytes, places: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(sigs) // SIG_BYTES, 8), np.uint8)
    wide[:, :SIG_BYTES] = np.frombuffer(sigs, np.uint8).reshape(-1, SIG_BYTES)
    place = np.cumsum(np.unpackbits(np.frombuffer(places, np.uint8), count=len(wide)), dtype=np.int64)
    return wide.view(np.int64).ravel(), np.frombuffer(names, np.int64)[place]


def _group_batch(kinds: dict[int, list[np.ndarray]]) -> pa.RecordBatch | None:
    found = {}
    for kind, rows in kinds.items():
        rows = [r for r in rows if len(r)]
        if rows:
            both = np.concatenate(rows)
            found[kind] = both if kind == MEMBER else np.unique(both, axis=0)
    if not found:
        return None
    both = np.concatenate(list(found.values()))
    kind = np.repeat(np.array(list(found), np.int32), [len(r) for r in found.values()])
    return _batch(GROUPS, {"kind": pa.array(kind), "a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})


def group_pairs(sigs: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """Candidate pairs ``(a, b)``, a < b, of sets that share a signature; large groups' members; and documents.

    ``kind`` says which: for a ``MEMBER``, ``a`` is the signature and ``b`` the
    set; a ``DOCUMENT`` is passed on.  A slice of a part is sorted at a time; a part is of bounded size,
    but for a signature that very many sets share (20 bytes for each of them).
    """
    def run(batches):
        at, held = None, []
        for batch in batches:
            documents = batch.filter(pa.array(batch.column(0).to_numpy() < 0))
            if documents.num_rows:
                yield _batch(GROUPS, {"kind": pa.array(np.full(documents.num_rows, DOCUMENT, np.int32)),
                                      **{c: documents.column(c) for c in PROFILE}})
            for row in range(documents.num_rows, batch.num_rows):
                part, *packed = (c[row].as_py() for c in batch.columns[:4])
                if part != at and held:
                    yield from _groups(at, held, small_group)
                    held = []
                at = part
                held.append(_unpacked(*packed))
        if held:
            yield from _groups(at, held, small_group)

    # Documents come first: their parts are below zero.
    return map_batches(sigs.repartition("part").sortWithinPartitions("part"), run, GROUPS)


def _groups(part: int, held: list, small_group: int):
    """Pairs and members of one part's groups, sorted a slice at a time."""
    for n in range(SLICES):
        chosen = [(sig[at], own[at]) for sig, own in held for at in [sig & (SLICES - 1) == n]]
        yield from _slice_groups(part, *(np.concatenate([c[i] for c in chosen]) for i in (0, 1)), small_group)


def _slice_groups(part: int, sig: np.ndarray, own: np.ndarray, small_group: int):
    if not len(sig):
        return
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]
    sig, own = sig[new], own[new]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[starts, len(sig)])
    # As in named().
    name = mix(sig.view(np.uint64) + (np.uint64(part) << np.uint64(8 * SIG_BYTES))).view(np.int64)
    if (out := _group_batch(_emit(name, own, starts, sizes, small_group))) is not None:
        for at in range(0, out.num_rows, 100_000):
            yield out.slice(at, 100_000)


def _emit(sig, own, starts, sizes, small_group) -> dict[int, list[np.ndarray]]:
    """Stars, the other pairs of small groups, and members of large ones."""
    kinds: dict[int, list[np.ndarray]] = {STAR: [], PAIR: [], MEMBER: []}
    for size in range(2, small_group + 1):
        at = starts[sizes == size]
        if len(at):
            for i, j in combinations(range(size), 2):
                kinds[PAIR if i else STAR].append(np.stack([own[at + i], own[at + j]], 1))
    for start, size in zip(starts[sizes > small_group], sizes[sizes > small_group]):
        group = own[start:start + size]
        kinds[STAR].append(np.stack([np.full(size - 1, group[0]), group[1:]], 1))
        kinds[MEMBER].append(np.stack([np.full(size, sig[start]), group], 1))
    return kinds


def near_counts(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with ``doc_a, doc_b``, without those whose sizes or counts differ too much."""
    a = nodes.select(F.col("set_id").alias("a"), F.col("doc").alias("doc_a"), F.col("size").alias("size_a"),
                     F.col("counts").alias("counts_a"))
    b = nodes.select(F.col("set_id").alias("b"), F.col("doc").alias("doc_b"), F.col("size").alias("size_b"),
                     F.col("counts").alias("counts_b"))
    schema = arrow_schema({"a": pa.int64(), "b": pa.int64(), "doc_a": pa.int64(), "doc_b": pa.int64()})

    def run(batches):
        for batch in batches:
            size_a, size_b = (batch.column(i).to_numpy() for i in (4, 5))
            most = (size_a + size_b) * (SIMILAR_OF - SIMILAR) // (SIMILAR_OF + SIMILAR)
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8)
                    .reshape(-1, BUCKETS).astype(np.int16) for i in (6, 7))
            keep = np.abs(x - y).sum(1) <= most
            if keep.any():
                yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    joined = (pairs.join(a, "a").join(b, "b")
              .where(f"{SIMILAR_OF} * least(size_a, size_b) >= {SIMILAR} * greatest(size_a, size_b)"))
    return map_batches(joined.select("a", "b", "doc_a", "doc_b", "size_a", "size_b", "counts_a", "counts_b"),
                       run, schema)


def near_fine(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """``pairs`` (of :func:`near_counts`) without those whose fine counts differ too much."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    fine = materialize(profile.select("set_id", "size", "fine").join(wanted, "set_id", "left_semi")
                       .groupBy("set_id").agg(F.first("size").alias("size"), F.first("fine").alias("fine")))
    a = fine.select(F.col("set_id").alias("a"), F.col("size").alias("size_a"), F.col("fine").alias("fine_a"))
    b = fine.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), F.col("fine").alias("fine_b"))
    schema = arrow_schema({"a": pa.int64(), "b": pa.int64(), "doc_a": pa.int64(), "doc_b": pa.int64()})

    def run(batches):
        for batch in batches:
            keep = [fine_difference(x.as_py(), y.as_py()) <= most_differences(p.as_py(), q.as_py())
                    for p, q, x, y in zip(*(batch.column(i) for i in (4, 5, 6, 7)))]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(a, "a").join(b, "b")
    return map_batches(joined.select("a", "b", "doc_a", "doc_b", "size_a", "size_b", "fine_a", "fine_b"), run, schema)


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``wanted`` (a distinct column ``doc``).

    Broadcasts the names while they are few enough; else texts are shuffled.
    """
    if wanted.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs["doc_id"] == wanted["doc"], "left_semi")


def short_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id, short``: 40 bits of each 5-gram's hash, enough to compare two sets."""
    def run(batches):
        shingler = Shingler()
        for _, texts in _texts(batches):
            grams = shingler.grams(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(g) for g in grams], pa.int64()),
                 pa.array([g.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes() for g in grams], pa.binary())],
                schema=SHORT)
    # Rows may repeat a doc_id, and a document its text.
    return map_batches(_chosen(docs, wanted), run, SHORT)


def _long(short: bytes) -> np.ndarray:
    wide = np.zeros((len(short) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(short, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets."""
    schema = arrow_schema({"a": pa.int64(), "b": pa.int64()})

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _long(x.as_py()), _long(y.as_py())
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                keep.append(SIMILAR_OF * common >= SIMILAR * (both - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.select("a", "b")
            .join(sets.select(F.col("set_id").alias("a"), F.col("short").alias("short_a")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("short").alias("short_b")), "b"))
    return map_batches(both.select("a", "b", "short_a", "short_b"), run, schema).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``links`` (``a, b``).

    Alternates large and small stars: every node hands its larger, then its
    smaller neighbours to the smallest node it knows, until nothing changes.
    A node's smallest neighbour is partially aggregated, so a node with very
    many links is no bottleneck.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
                         ).first()
        if not seen["n"] or (seen["n"], seen["h"]) == before:
            break
        before = (seen["n"], seen["h"])
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Every edge now goes from a larger node u to a smaller one v.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"))
        edges = materialize(small.where("x <> y").union(least.select("u", "m")).toDF("u", "v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are in different components so far."""
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("component_a"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("component_b"))
    return (pairs.join(of_a, "a", "left").join(of_b, "b", "left")
            .where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b"))


def crowded(members: DataFrame, found: DataFrame) -> DataFrame:
    """``set_id, component`` of the sets in large groups that hold more than one component."""
    labelled = members.join(found, F.col("b") == F.col("node"), "left").select(
        F.col("a").alias("sig"), F.col("b").alias("set_id"), F.coalesce("component", "b").alias("component"))
    mixed = (labelled.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"))
             .where("least < most").select("sig"))
    return labelled.join(mixed, "sig").select("set_id", "component").distinct()


def frequent_grams(docs: DataFrame, wanted: DataFrame, sample: int = ORDER_SAMPLE, most: int = ORDER_GRAMS) -> list[int]:
    """5-grams that are frequent in a sample of the wanted sets, at most ``most``.

    They only come last in the order of the prefix filter, which is exact in
    any order; so a bounded sample will do.
    """
    def run(batches):
        shingler = Shingler()
        for _, texts in _texts(batches):
            many = shingler.grams(texts)
            flat = np.concatenate(many) if many else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], schema=arrow_schema({"gram": pa.int64()}))

    part = wanted.orderBy(F.xxhash64("doc")).limit(sample)
    rows = (map_batches(_chosen(docs, part), run, arrow_schema({"gram": pa.int64()}))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
            .orderBy(F.desc("n"), "gram").limit(most).collect())
    return [r["gram"] for r in rows]


def prefixes(docs: DataFrame, wanted: DataFrame, last: list[int]) -> DataFrame:
    """``sig, set_id, place``: the first ``size - need + 1`` 5-grams of the set of every wanted document.

    ``need`` is the least intersection with a similar set.  The order is by a
    hash, with the 5-grams of ``last`` after all others.  Two similar sets
    have one of their first 5-grams in common.
    """
    late = np.sort(np.array(last, np.int64).view(np.uint64))

    def run(batches):
        shingler = Shingler()
        for _, texts in _texts(batches):
            heads, owners, places = [], [], []
            for grams in shingler.grams(texts):
                size = len(grams)
                if not size:
                    continue
                rank = mix(grams + np.uint64(99)) >> np.uint64(1)
                if len(late):
                    at = np.minimum(np.searchsorted(late, grams), len(late) - 1)
                    rank[late[at] == grams] |= np.uint64(1 << 63)
                first = size - -(-size * SIMILAR // SIMILAR_OF) + 1
                at = np.argpartition(rank, first - 1)[:first]
                # Ties of the order are broken by the 5-gram, the same way for all sets.
                heads.append(grams[at[np.lexsort((grams[at], rank[at]))]])
                owners.append(np.full(first, set_id(grams), np.int64))
                places.append(np.arange(first, dtype=np.int32))
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)),
                                                  pa.array(np.concatenate(owners)),
                                                  pa.array(np.concatenate(places))], schema=HEADS)
    return map_batches(_chosen(docs, wanted), run, HEADS)


def shared_only(heads: DataFrame) -> DataFrame:
    """Rows of ``sig, set_id, place`` whose signature another set has, too; a stream of sorted rows."""
    def run(batches):
        held = None  # the last row, while it is alone with its signature
        ended = None  # the signature of the last row
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            sig = columns[0]
            keep = np.zeros(len(sig), bool)
            same = sig[1:] == sig[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if held is None and ended is not None:
                keep |= sig == ended
            held = None if keep[-1] else [c[-1:] for c in columns]
            ended = sig[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], schema=HEADS)
    return map_batches(heads.repartition("sig").sortWithinPartitions("sig"), run, HEADS)


def near_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets of different components that share a signature and have near counts.

    ``rows``: ``sig, set_id, component, size, place, counts, early``.  Sorted rows
    are a stream; new rows of a signature are compared with those held of it.
    What stands before the first 5-gram that two sets share is in one of them
    only; so a pair whose places here already make too many differences
    either is none or has shared an earlier 5-gram, and is found there.  A pair
    that has one of the 5-grams ``early`` in both sets in common before this one is found there, too.
    """
    schema = arrow_schema({"a": pa.int64(), "b": pa.int64()})

    def near(x, y):
        """Row numbers of x and y that may be similar."""
        found = []
        step = max(1, 50_000 // max(len(y[0]), 1))
        for at in range(0, len(x[0]), step):
            own, comp, size, place, cnt, early = (c[at:at + step] for c in x)
            most = (size[:, None] + y[2][None]) * (SIMILAR_OF - SIMILAR) // (SIMILAR_OF + SIMILAR)
            ok = ((comp[:, None] != y[1][None]) & (place[:, None] + y[3][None] <= most)
                  & (SIMILAR_OF * np.minimum(size[:, None], y[2][None])
                     >= SIMILAR * np.maximum(size[:, None], y[2][None])))
            i, j = np.nonzero(ok)
            ok = np.abs(cnt[i] - y[4][j]).sum(1) <= most[i, j]
            i, j = i[ok], j[ok]
            e = early[i][:, :, None]
            ok = ~((e == y[5][j][:, None]) & (e != 0)).any((1, 2))
            p, q = own[i[ok]], y[0][j[ok]]
            if len(p):
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
        return found

    def before(sig, early):
        """Those of the early 5-grams that stand before a row's own one; else zeros."""
        out = np.zeros((len(sig), EARLY), np.int64)
        for row, (own, grams) in enumerate(zip(sig.tolist(), early)):
            grams = grams[:grams.index(own)] if own in grams else grams
            out[row, :len(grams)] = grams
        return out

    def flushed(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=schema)

    def run(batches):
        at, held, found = None, None, []
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sig = part.column(0).to_numpy()
                cols = [part.column(i).to_numpy() for i in (1, 2, 3, 4)]
                cols.append(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8)
                            .reshape(-1, BUCKETS).astype(np.int16))
                cols.append(before(sig, part.column(6).to_pylist()))
                starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
                for start, stop in zip(starts, np.r_[starts[1:], len(sig)]):
                    new = [c[start:stop] for c in cols]
                    if sig[start] == at:
                        found.extend(near(new, held))
                        found.extend(near(new, new))
                        held = [np.concatenate(h) for h in zip(held, new)]
                    else:
                        at, held = sig[start], new
                        if stop - start > 1:
                            found.extend(near(new, new))
                if sum(map(len, found)) >= PAIR_ROWS:
                    yield flushed(found)
                    found = []
        if found:
            yield flushed(found)
    dealt = (rows.select("sig", "set_id", "component", "size", "place", "counts", "early")
             .repartition("sig").sortWithinPartitions("sig"))
    return map_batches(dealt, run, schema).distinct()


def prefix_pairs(docs: DataFrame, wanted: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` of different components by exact prefix filtering.

    Only 5-grams that several components share are joined to the counts.
    """
    heads = stored(shared_only(prefixes(docs, wanted, frequent_grams(docs, wanted))).join(labels, "set_id"))
    mixed = (heads.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"))
             .where("least < most").select("sig"))
    shared = heads.join(mixed, "sig", "left_semi")
    early = shared.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("place", "sig"))), 1, EARLY)["sig"].alias("early"))
    known = nodes.select("set_id", "size", "counts").join(early, "set_id")
    return near_pairs(shared.join(known, "set_id"))


def linked(docs: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` with a ``doc_id``."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                    F.col("text").cast("string").alias("text"))
    size, rows = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = size or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // (GRAM_BYTES * PART_GRAMS))
    frequent = frequent_signatures(texts, rows, parts)
    groups = stored(group_pairs(signatures(texts, parts, frequent), small_group))
    profile = groups.where(F.col("kind") == DOCUMENT).select(*PROFILE)
    nodes = profile.where("size > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc"), F.max("size").alias("size"), F.first("counts").alias("counts"))

    def links_of(pairs: DataFrame) -> DataFrame:
        near = materialize(near_fine(materialize(near_counts(pairs, nodes)), profile))
        wanted = near.select(F.col("doc_a").alias("doc")).union(near.select("doc_b")).distinct()
        return materialize(verified(near, short_sets(texts, wanted)))

    def of_kind(groups: DataFrame, *kinds: int) -> DataFrame:
        return groups.where(F.col("kind").isin(*kinds)).select("a", "b")

    def with_links(links: DataFrame, found: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links and components with those of more candidates."""
        more = links_of(pairs)
        if more.isEmpty():
            return links, found
        links = links.union(more)
        return links, components(links)

    def chosen(rest: DataFrame) -> DataFrame:
        return materialize(nodes.join(rest, "set_id", "left_semi").select("doc"))

    links = links_of(of_kind(groups, STAR).distinct())
    found = components(links)
    pairs = of_kind(groups, PAIR)
    rest = materialize(crowded(of_kind(groups, MEMBER), found))
    signed_again = not rest.isEmpty()
    if signed_again:
        # Pairs that no group compares are of these; they are signed again, with the signatures of all large groups last.
        for name, n in large_groups(of_kind(groups, MEMBER)).items():
            frequent[name] = max(n, frequent.get(name, 0))
        again = stored(group_pairs(signatures(_chosen(texts, chosen(rest)), parts, frequent, profiles=False), small_group))
        pairs = pairs.union(of_kind(again, STAR, PAIR))
    links, found = with_links(links, found, apart(pairs.distinct(), found))
    if signed_again:
        rest = materialize(crowded(of_kind(again, MEMBER), found))
        if not rest.isEmpty():
            links, found = with_links(links, found, prefix_pairs(texts, chosen(rest), rest, nodes))
    # Components of sets by their smallest document; unlinked sets are their own.
    labelled = nodes.select("set_id", "doc").join(found, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "doc", F.coalesce("component", "set_id").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    final = labelled.join(least, "component").select("set_id", "component_id")
    return profile.join(final, "set_id", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
