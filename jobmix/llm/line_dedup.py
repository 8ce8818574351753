"""Line dedup: a sharded minimal perfect hash over distinct lines, probed by the documents.

1. Every document gives each of its distinct long lines once, as a 128-bit
   hash of the line's key; a partially aggregated count makes of them the
   distinct lines, with their number of documents and largest ``doc_id``.
2. All distinct lines are dealt to shards of bounded size.  Each shard becomes
   one row: a minimal perfect hash (levels of bit arrays; a key's rank among
   the set bits is its slot) and, by slot, arrays of fingerprints, counts and
   holders.  A key that is not in the shard fails the fingerprint.
3. The documents' line hashes are dealt to the shards and read their count and
   holder from the arrays of the one shard at hand; lines are never joined to
   lines.  A shard that more lines ask than an even share (one holding a line
   of a third of all documents, say) is laid out in as many copies as it has
   shares, and a document picks a copy.
4. What must go comes back as a list of hashes per document.

A document is a row.  Results for odd input: a null or empty text is one
empty line; lines whose key is shorter than ``min_chars`` code points always
stay; a row without ``doc_id`` is counted as a document but loses no line and
holds none; of rows with the same ``doc_id`` all lose or all keep a line; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmix.llm.common import ASCII_LOWER, arrow_schema, map_batches, materialize, table

EDGE = b" \t\n\x0b\x0c\r"
# Keys in a shard: about half a megabyte of arrays.
SHARD_KEYS = 20_000
# Bits of a level for each key that is left; levels after which the rest (keys of one mix) is a plain list.
GAMMA = 2.0
LEVELS = 64
# At most this many shards have copies: a share is at least this part of all lines that ask.
MAX_HOT = 65_536

LINE_SCHEMA = arrow_schema({"k1": pa.int64(), "k2": pa.int64(), "doc_id": pa.int64()})
SHARD_SCHEMA = arrow_schema({"shard": pa.int64(), "arrays": pa.binary()})
DROP_SCHEMA = arrow_schema({"doc_id": pa.int64(), "k1": pa.int64()})


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is shorter than ``min_chars`` code points."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().translate(ASCII_LOWER).split(b"\n"):
        key = line.strip(EDGE)
        # A code point has at most 4 bytes.
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        keys.append(key if long else None)
    return keys


def hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes of keys as rows of two int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``k1, k2, doc_id``: each distinct long line of each document once."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, ids = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {k for k in line_keys(text, min_chars) if k is not None}
                    keys.extend(own)
                    ids.extend([doc_id] * len(own))
                if keys:
                    h = hashes(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], schema=LINE_SCHEMA)
    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run,
                       LINE_SCHEMA)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mixing of keys, another one for each level."""
    step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = x.view(np.uint64) + step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LineTable:
    """Minimal perfect hash of 128-bit keys with arrays of fingerprints, counts and holders.

    On each level the keys that are left are thrown at ``GAMMA`` bits each;
    a key that meets no other sets its bit, the others go on to the next
    level.  A key's slot is the number of set bits before its own.  Keys that
    are alike in what is mixed never part; after ``LEVELS`` levels the rest
    gets the last slots, by key.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = np.ascontiguousarray(keys[:, 0] ^ keys[:, 1]), 0
        who = np.arange(len(keys))
        while len(left) and len(self.levels) < LEVELS:
            size = 64 * max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = (_mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = base + np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.levels.append((size, words, ranks[:-1]))
            base = int(ranks[-1])
            left, who = left[~alone[at]], who[~alone[at]]
        self.rest = {tuple(k): base + i for i, k in enumerate(keys[who].tolist())}
        slot = self._slots(keys)
        self.fingerprint = np.empty(len(keys), np.int64)
        self.count = np.empty(len(keys), np.int64)
        self.holder = np.empty(len(keys), np.int64)
        self.fingerprint[slot], self.count[slot], self.holder[slot] = keys[:, 1], counts, holders

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit set."""
        slot = np.full(len(keys), -1, np.int64)
        left, who = np.ascontiguousarray(keys[:, 0] ^ keys[:, 1]), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _mix(left, level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot[who[found]] = (ranks[word] + np.bitwise_count(below))[found]
            left, who = left[~found], who[~found]
        if self.rest:
            slot[who] = [self.rest.get(tuple(k), -1) for k in keys[who].tolist()]
        return slot

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key the number of documents and the largest ``doc_id``; 0 where the key is not in."""
        count, holder = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.fingerprint):
            slot = self._slots(keys)
            known = slot >= 0
            known[known] = self.fingerprint[slot[known]] == keys[known, 1]
            count[known], holder[known] = self.count[slot[known]], self.holder[slot[known]]
        return count, holder


def distinct_lines(lines: DataFrame) -> DataFrame:
    """``k1, k2, n_docs, holder`` of every line; the holder is the smallest integer where no document has an id."""
    return lines.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.max("doc_id"), F.lit(np.iinfo(np.int64).min)).alias("holder"))


def hot_shards(distinct: DataFrame, n_shards: int, share: int) -> DataFrame:
    """``shard, copies`` of the shards that more than ``share`` lines ask.

    ``share`` must be at least a ``MAX_HOT``-th of all lines, so there are no
    more than ``MAX_HOT`` rows.
    """
    asked = distinct.groupBy(F.pmod("k1", F.lit(n_shards)).alias("shard")).agg(F.sum("n_docs").alias("asked"))
    return asked.where(F.col("asked") > share).select("shard", F.ceil(F.col("asked") / share).alias("copies"))


def build_shards(distinct: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays per shard of about ``SHARD_KEYS`` keys."""
    def build(part: pa.Table) -> pa.Table:
        cols = {c: part.column(c).to_numpy() for c in ("k1", "k2", "n_docs", "holder")}
        made = LineTable(np.stack([cols["k1"], cols["k2"]], 1), cols["n_docs"], cols["holder"])
        return pa.table([pa.array([part.column("shard")[0].as_py()], pa.int64()),
                         pa.array([pickle.dumps(made)], pa.binary())], schema=SHARD_SCHEMA)
    keyed = distinct.withColumn("shard", F.pmod("k1", F.lit(n_shards)))
    return keyed.groupBy("shard").applyInArrow(build, "shard bigint, arrays binary")


def probe(lines: DataFrame, shards: DataFrame, n_shards: int, hot: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id, k1`` of the lines that go: in ``min_docs`` documents or more, one of them with a larger id.

    Arrays and lines of a (shard, copy) meet in one partition, the arrays
    first; a task holds the arrays of one shard at a time.  ``hot`` is
    broadcast: at most ``MAX_HOT`` pairs of numbers.
    """
    hot = F.broadcast(hot)
    copies = F.coalesce("copies", F.lit(1).cast("bigint"))
    laid = shards.join(hot, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy"),
        F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"),
        F.lit(None).cast("bigint").alias("doc_id"), "arrays")
    asked = (lines.where("doc_id is not null").withColumn("shard", F.pmod("k1", F.lit(n_shards)).cast("bigint"))
             .join(hot, "shard", "left")
             .select("shard", F.pmod(F.xxhash64("doc_id"), copies).alias("copy"),
                     "k1", "k2", "doc_id", F.lit(None).cast("binary").alias("arrays")))

    def run(batches):
        at, arrays = None, None
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            blobs = batch.column(5)
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)])
            for start, stop in zip(starts, np.r_[starts[1:], len(place)]):
                if at != (here := tuple(place[start])):
                    at, arrays = here, None
                if blobs[start].is_valid:
                    arrays = pickle.loads(blobs[start].as_py())
                    start += 1
                if arrays is None or start == stop:
                    continue
                part = batch.slice(start, stop - start)
                k1, k2, ids = (part.column(i).to_numpy() for i in (2, 3, 4))
                n_docs, holder = arrays.lookup(np.stack([k1, k2], 1))
                go = (n_docs >= min_docs) & (ids < holder)
                if go.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[go]), pa.array(k1[go])], schema=DROP_SCHEMA)

    together = (laid.unionByName(asked).repartition("shard", "copy")
                .sortWithinPartitions("shard", "copy", F.col("arrays").isNull()))
    return map_batches(together, run, DROP_SCHEMA)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and ``n_lines``, ``n_dropped`` added.

    Columns of ``docs`` with these two names are replaced.  The texts are
    shuffled once, by ``doc_id``, to meet the list of their dropped lines.
    """
    lines = document_lines(docs, min_chars)
    distinct = materialize(distinct_lines(lines))
    size = distinct.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("asked")).first()
    n_shards = max(1, -(-size["keys"] // shard_keys))
    hot = hot_shards(distinct, n_shards, max(2 * shard_keys, -(-size["asked"] // MAX_HOT)))
    gone_id, gone_lines, made_cut = (free_name(docs, x) for x in ("_gone_id", "_gone", "_cut"))
    gone = (probe(lines, build_shards(distinct, n_shards), n_shards, hot, min_docs)
            .groupBy(F.col("doc_id").alias(gone_id)).agg(F.collect_set("k1").alias(gone_lines)))

    @F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                                T.StructField("text", T.StringType())]))
    def cut(texts, gone):
        import pandas as pd
        out = []
        for text, ids in zip(texts, gone):
            text = text or ""
            lines = text.split("\n")
            if ids is None or len(ids) == 0:
                out.append((len(lines), 0, text))
                continue
            ids = set(ids)
            keys = line_keys(text, min_chars)
            long = [i for i, k in enumerate(keys) if k is not None]
            drop = {i for i, h in zip(long, hashes([keys[i] for i in long])[:, 0].tolist()) if h in ids}
            out.append((len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])

    joined = docs.join(gone, docs["doc_id"].cast("bigint") == gone[gone_id], "left")
    made = joined.withColumn(made_cut, cut(docs["text"].cast("string"), gone[gone_lines]))
    kept = [docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return made.select(*kept, *(F.col(made_cut)[c].alias(c) for c in ("text", "n_lines", "n_dropped")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# A line is dropped where its key is long, in three documents or more, and held by a larger doc_id.
OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
        FROM documents)),
held AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, (h.holder IS NOT NULL AND h.holder <> l.doc_id) AS gone
  FROM lines l LEFT JOIN held h ON h.key = l.key AND length(l.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
