"""Merkle dataset manifest: trees of hashes over documents, and a recursive climb that checks each leaf.

*Building.*  Leaves are hashed where the rows are read.  A range partitioning
by source and ``doc_id`` numbers them over the whole table; every later
position follows by arithmetic.  Sixteen consecutive nodes become their
parent, level by level, in each source; then the subroots in the same way.

*Stored levels.*  Each inner node is one row: its ``id``, its ``parent`` and
its place ``pos`` there, its ``hash``, and the hashes of its children (the
``run``).  A node above many leaves would be a hot key of the climb, so the rows
are laid out once for each block of ``BLOCK`` leaves below them: about 53
bytes a leaf however high the tree.

*Climb.*  A recursive query starts at every leaf and joins the row of its
parent, until a node has none: the leaf's hash replaces its place in the run,
the run's hash is what goes on, and the run and the place left out of it
are appended to the leaf's path - its siblings.  Paths hold references, as 15
hashes a level would be stored again at every step; a last join by block puts
in the siblings and hashes them.

Results for odd input: a null source is a source of its own, before all
others; rows without ``doc_id`` come first in their source and are never
tampered with; rows with the same ``doc_id`` are leaves of their own, ordered by
their hashes; an empty table gives an empty result, one row is its own root;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmix.llm.common import materialize, scratch_path, table

FANOUT = 16
# Leaves of a source whose climbs share a copy of the rows above them: two levels.
BLOCK = FANOUT ** 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Documents whose crc32 this divides are tampered with.
TAMPERED = 5
# An id is the number of a node's first leaf, times this, plus its level; the
# nodes over the subroots take that of their first source, from level TOP on.
LEVELS, TOP = 64, 32
# A block's copies are made in two steps of at most this many rows each.
CHUNK = 4096
NODES = "id bigint, parent bigint, pos int, hash binary, run binary, is_subroot boolean"


def field_text(name: str) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(**replaced: Column) -> Column:
    """The hash of a document's fields, in hex."""
    return F.sha2(F.concat(*[replaced.get(c, field_text(c)) for c in FIELDS]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_hash() -> Column:
    """The leaf of a document's tampered version; of the others the leaf itself."""
    text = lower_ascii(F.col("text").cast("string"))
    changed = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    return F.when(hit, leaf_hash(text=changed)).otherwise(F.col("leaf"))


def run_hash(run: Column) -> Column:
    """The hash of a run: of its hashes as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(run)), 256))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``: its rows counted from 0 in this order, ``_part``: the range each came from.

    Only one row for each range meets in a task.
    """
    at = F.monotonically_increasing_id()
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                        .select("*", F.spark_partition_id().alias("_part"),
                                at.bitwiseAND(F.lit(2 ** 33 - 1)).alias("_at")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    # A row for each partition: a number that Spark's own planning bounds.
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return dealt.join(starts, "_part").withColumn("number", F.col("_before") + F.col("_at")).drop("_at", "_before")


def leaves_and_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their place in their source; and the sources, ranked.

    A source's first leaf and size come from counts by range and source, and
    go back to the leaves by both: a hot source is spread over its ranges.
    """
    hashed = (docs.select(*[F.col(c) for c in FIELDS])
              .withColumn("leaf", leaf_hash()).withColumn("tampered", tampered_hash())
              .select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered"),
                      F.monotonically_increasing_id().alias("_row")))
    # The last key only splits repeated rows; their leaves are equal.
    leaves = materialize(numbered(hashed, "source", "doc_id", "leaf", "_row").drop("_row"))
    spans = leaves.groupBy("_part", "source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    by_source = spans.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    sources = materialize(numbered(by_source, "first").drop("_part").withColumnRenamed("number", "rank"))
    known = spans.select("_part", F.col("source").alias("_source")).join(
        sources, F.col("_source").eqNullSafe(F.col("source"))).select("_part", "_source", "first", "n", "rank")
    placed = leaves.join(known, (leaves["_part"] == known["_part"]) & F.col("source").eqNullSafe(F.col("_source")))
    return (materialize(placed.select("doc_id", "leaf", "tampered", "first", "n", "rank",
                                      (F.col("number") - F.col("first")).alias("idx"))), sources)


def div(x: Column | str, y: int) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(y)).cast("bigint")


def parent_of(level: int, several: bool) -> tuple[Column, Column]:
    """``parent`` and ``pos`` of a source's node (columns ``first, rank, idx, n``) on a level.

    ``n`` nodes of the source are on its level; ``several``: there is more than one source.
    """
    inner = F.col("n") > 1
    up = (F.col("first") + div("idx", FANOUT) * FANOUT ** (level + 1)) * LEVELS + level + 1
    top = F.lit(None) if not several else div("rank", FANOUT) * FANOUT * LEVELS + TOP + 1
    return (F.when(inner, up).otherwise(top).cast("bigint"),
            F.when(inner, F.col("idx") % FANOUT).otherwise(F.col("rank") % FANOUT).cast("int"))


def joined_runs(nodes: DataFrame, keys: list[str], also: list[Column]) -> DataFrame:
    """Nodes (``idx, hash``) in runs of ``FANOUT``: the parents, with ``run`` and ``hash``."""
    up = nodes.withColumn("up", div("idx", FANOUT)).groupBy(*keys, "up").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.hex("hash").alias("hash")))).alias("kids"), *also)
    run = F.unhex(F.array_join(F.transform("kids", lambda k: k["hash"]), ""))
    return up.withColumn("run", run).withColumn("hash", run_hash(F.col("run"))).drop("kids").withColumnRenamed(
        "up", "idx")


def build(leaves: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Writes the inner nodes, laid out by block, below ``path``; returns them.

    One row for each inner node and each block of leaves below it: ``block``
    and the columns of ``NODES``.
    """
    spark = leaves.sparkSession
    stats = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n")).first()
    several = stats["sources"] > 1
    last_block = div(F.col("total") - 1, BLOCK)

    def laid_out(nodes: DataFrame) -> DataFrame:
        """Rows for blocks ``lo`` to ``hi`` of the source that starts at ``first``."""
        chunks = nodes.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(CHUNK).cast("bigint"))))
        return (chunks.repartition("first", "lo")
                .withColumn("b", F.explode(F.sequence("lo", F.least(F.col("lo") + CHUNK - 1, "hi"))))
                .select((F.col("first") + F.col("b") * BLOCK).alias("block"), "id", "parent", "pos", "hash", "run",
                        "is_subroot"))

    def store(nodes: DataFrame) -> None:
        laid_out(nodes).write.mode("append").parquet(path)

    spark.createDataFrame([], f"block bigint, {NODES}").write.parquet(path)
    level, most = 0, stats["n"] or 0
    nodes = leaves.select("first", "rank", "idx", F.col("n").alias("total"), "n", F.col("leaf").alias("hash"))
    subroots = nodes.where("n = 1").select("first", "rank", "total", "hash")
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        parents = joined_runs(nodes.where("n > 1"), ["first", "rank", "total"], [F.max("n").alias("n")])
        nodes = materialize(parents.withColumn("n", div(F.col("n") + FANOUT - 1, FANOUT)))
        parent, pos = parent_of(level, several)
        width = FANOUT ** level
        store(nodes.select(
            "first", "run", "hash", parent.alias("parent"), pos.alias("pos"),
            ((F.col("first") + F.col("idx") * width) * LEVELS + level).alias("id"),
            (F.col("n") == 1).alias("is_subroot"),
            div(F.col("idx") * width, BLOCK).alias("lo"),
            F.least(div(F.col("idx") * width + width - 1, BLOCK), last_block).alias("hi")))
        subroots = subroots.union(nodes.where("n = 1").select("first", "rank", "total", "hash"))
        nodes = nodes.select("first", "rank", "idx", "total", "n", "hash")

    subroots = materialize(subroots)
    nodes, most, level = subroots.select(F.col("rank").alias("idx"), "hash"), stats["sources"], TOP
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        nodes = materialize(joined_runs(nodes, [], []))
        width = FANOUT ** (level - TOP)
        parent = F.lit(None) if most == 1 else div("idx", FANOUT) * FANOUT * width * LEVELS + level + 1
        # Every source below the node takes its row for all its blocks.
        low = nodes.select("*", (F.col("idx") * width).alias("r"),
                           F.least(F.col("idx") * width + width - 1, F.lit(stats["sources"] - 1)).alias("r_hi"))
        chunks = low.withColumn("r", F.explode(F.sequence("r", "r_hi", F.lit(CHUNK).cast("bigint"))))
        ranks = chunks.repartition("r").withColumn(
            "rank", F.explode(F.sequence("r", F.least(F.col("r") + CHUNK - 1, "r_hi"))))
        store(ranks.join(subroots.select("rank", "first", "total"), "rank").select(
            "first", "run", "hash", parent.cast("bigint").alias("parent"), (F.col("idx") % FANOUT).cast("int").alias("pos"),
            (F.col("idx") * width * LEVELS + level).alias("id"), F.lit(False).alias("is_subroot"),
            F.lit(0).cast("bigint").alias("lo"), last_block.alias("hi")))
    return spark.read.parquet(path)


CLIMB = """
WITH RECURSIVE climb(block, leaf_id, parent, pos, folded, subroot, root, path) AS (
    SELECT block, leaf_id, parent, pos, tampered, subroot, leaf, array() :: array<struct<id: bigint, pos: int>>
    FROM {leaves}
    UNION ALL
    SELECT c.block, c.leaf_id, n.parent, n.pos,
           unhex(sha2(lower(hex(overlay(n.run PLACING c.folded FROM c.pos * 32 + 1 FOR 32))), 256)),
           CASE WHEN n.is_subroot THEN n.hash ELSE c.subroot END,
           n.hash,
           array_append(c.path, named_struct('id', n.id, 'pos', c.pos))
    FROM climb c JOIN {nodes} n ON c.block = n.block AND c.parent = n.id
)
SELECT block, leaf_id, folded, subroot, root, path FROM climb WHERE parent IS NULL
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every leaf's way to the root: ``leaf_id, block, folded, subroot, root, path``.

    ``leaves``: ``block, leaf_id, parent, pos, leaf, tampered, subroot``.
    Spark's limit on the rows of a recursive query is for runaway recursion; this
    one ends with the tree, so it is lifted while the query runs.
    """
    spark = leaves.sparkSession
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        return materialize(spark.sql(CLIMB, leaves=leaves, nodes=nodes))
    finally:
        spark.conf.set(setting, before)


def manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, subroot and root, the hash of its proof, and what its tampered version folds to.

    Hashes are lower-case hex.
    """
    spark = docs.sparkSession
    leaves, sources = leaves_and_sources(docs)
    nodes = build(leaves, sources, scratch_path(spark, "merkle-nodes"))
    several = sources.limit(2).count() > 1
    parent, pos = parent_of(0, several)
    starts = leaves.select(
        (F.col("first") + div("idx", BLOCK) * BLOCK).alias("block"), (F.col("first") + F.col("idx")).alias("leaf_id"),
        parent.alias("parent"), pos.alias("pos"), "doc_id", "leaf", "tampered",
        F.when(F.col("n") == 1, F.col("leaf")).alias("subroot"))
    ways = climb(starts.drop("doc_id"), nodes)
    # At most sixteen rows of each block's first level, and one of each level above.
    runs = nodes.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("id", "run"))).alias("runs"))
    siblings = F.transform("path", lambda p: F.lower(F.hex(F.overlay(
        F.col("runs")[p["id"]], F.lit(b""), p["pos"] * 32 + 1, F.lit(32)))))
    proof = F.sha2(F.array_join(siblings, ""), 256)
    found = ways.join(runs, "block", "left").select(
        "leaf_id", "folded", "subroot", "root", proof.alias("proof_sha256"))
    text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return starts.drop("subroot").join(found, "leaf_id").select(
        "doc_id", *text, "proof_sha256", F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHANGED = "sha256(" + " || ".join(_FIELD.format(_LOWER if c == "text" else c) for c in FIELDS) + ")"

OP13_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashed AS (
    SELECT source, doc_id, {_LEAF} AS leaf,
           CASE WHEN xor(list_reduce(
                    list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 5 = 0
                THEN {_CHANGED} ELSE {_LEAF} END AS tampered
    FROM documents, crc
), leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n
    FROM hashed
), levels AS (
    SELECT tree, 0 AS level, idx, n, leaf AS hash FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
    FROM levels WHERE n > 1 GROUP BY tree, level, idx // 16
), subroots AS (
    SELECT tree, hash, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
    SELECT 0 AS level, tree AS idx, n, hash FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY level, idx // 16
), runs AS (
    SELECT tree, level, idx // 16 AS up, list(hash ORDER BY idx) AS run FROM levels WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT -1, level, idx // 16, list(hash ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL
), climb AS (
    SELECT tree, tree AS own, idx AS leaf_idx, 0 AS level, idx, n, tampered AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, own, leaf_idx, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
           CASE WHEN c.n > 1 THEN c.idx // 16 ELSE c.own END,
           CASE WHEN c.n > 1 THEN (c.n + 15) // 16 ELSE (SELECT count(*) FROM subroots) END,
           CASE WHEN c.n > 1 THEN sha256(array_to_string(list_concat(
               list_concat(r.run[1:c.idx % 16], [folded]), r.run[c.idx % 16 + 2:]), '')) ELSE folded END,
           CASE WHEN c.n > 1 THEN proof || array_to_string(list_concat(
               r.run[1:c.idx % 16], r.run[c.idx % 16 + 2:]), '') ELSE proof END
    FROM climb c LEFT JOIN runs r ON c.n > 1 AND r.tree = c.tree AND r.level = c.level AND r.up = c.idx // 16
    WHERE c.n > 1 OR c.tree >= 0
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256,
       c.folded AS folded_root, c.folded = t.hash AS verified
FROM leaves l JOIN subroots s USING (tree), (SELECT hash FROM tops WHERE n = 1) t, climb c
WHERE c.own = l.tree AND c.leaf_idx = l.idx AND c.tree = -1 AND c.n = 1
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
