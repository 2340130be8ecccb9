"""Prefix trie of conversations by a splitter skeleton.

Conversations are paths of turn names.  Paths are cut into segments of at most ``TURNS`` turns; a segment's context is the
name of the node that it starts from, so no row grows with a conversation.  Segments are range-partitioned by (context, turn
names).  The skeleton is the trie of the splitter paths: a node that is no prefix of a splitter has its whole subtree
between two splitters, so the sorted shard of that range finishes it.  Skeleton nodes get a part from each shard, and parts
are added up by node name.  A path that is so frequent that several splitters equal it lies in the skeleton as a whole, and
its copies are spread over the shards between those splitters.

Sums over subtrees need the deeper segments too.  The smallest member of a node owns it; a conversation owns its nodes from
some depth on.  A first walk finds the owners.  In a second walk each conversation brings to every node of its path
the turns below that it shares (those above its own nodes), and its leaf if it owns one, so subtree sums are sums over members.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, numbered, stored, table
from .tokens import batches, forget

#: Turns of a segment; bytes of a name.
TURNS, NAME = 64, 16
#: Segments of a shard, most shards, sampled paths for each splitter.  The driver sorts SAMPLES * MOST_SHARDS paths of at
#: most (TURNS + 1) * NAME bytes, and MOST_SHARDS of them are broadcast (4.3 MB).
PER_SHARD, MOST_SHARDS, SAMPLES = 5_000, 4096, 8
#: Rows of a conversation that follow one row of its plan in a join.
PIECE = 65_536
ROOT = bytes(NAME)
NOTHING = hashlib.sha256(b"").hexdigest()

_PACKED = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("length", pa.int64()), ("digest", pa.binary()),
                     ("names", pa.binary()), ("sizes", pa.list_(pa.int64()))])
_CHAIN = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("context", pa.binary())])
_PLACED = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("length", pa.int64()), ("key", pa.binary()),
                     ("sizes", pa.list_(pa.int64())), ("shard", pa.int32()), ("skeleton", pa.int32()), ("ends_at", pa.binary())])
_NODES = pa.schema([("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("reduce", pa.bool_()), ("skeleton", pa.bool_()),
                    ("counted", pa.bool_()), ("under", pa.bool_()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_PIECES = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("text", pa.string())])
_ENDS = pa.schema([("name", pa.binary()), ("found", pa.string())])


def ddl(schema: pa.Schema) -> str:
    own = {"int64": "long", "int32": "int", "bool": "boolean", "binary": "binary", "string": "string"}
    return ", ".join(f"{f.name} {own.get(str(f.type), 'array<long>')}" for f in schema)


def short(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:NAME]


def turn_name(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of role and text; the role's length keeps them apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, size) of conversations (conv_id, turn, role, text): turns in order from 1, null turns first.

    Null roles and texts are empty.  Equal turn numbers are ordered by turn name; repeated rows follow each other.  Rows
    without conv_id belong to no conversation and are left out.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_name(F.col("role"), F.col("text")).alias("name"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    out = numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("name")], "pos", "trie-turns")
    return out.select("conv_id", (F.col("pos") + 1).alias("pos"), "name", "size")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their group: (turns, lengths).

    The first h turns of conversation c - c % group (all if it has fewer, none if it is absent) replace c's own first h,
    h = crc32(c as text) % most.  lengths (conv_id, length) has a row for every conversation, turnless ones too.
    """
    counts = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    c = F.col("conv_id")
    first = F.when(c % group == 0, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % most)
    plan = counts.select("conv_id", "n", first.alias("h"), (c - c % group).alias("lender"))
    lenders = counts.select(c.alias("lender"), F.col("n").alias("m"))
    plan = stored(plan.join(lenders, "lender", "left").select(
        "conv_id", "n", "h", "lender", F.least("h", F.coalesce("m", F.lit(0))).alias("taken")), "trie-plan")
    pieces = plan.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    own = turns.withColumn("piece", F.floor((F.col("pos") - 1) / PIECE)).join(pieces, ["conv_id", "piece"])
    own = own.filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "size")
    borrowers = plan.filter("h > 0").select(c.alias("borrower"), "h", "lender")
    lent = turns.filter(F.col("pos") < most).join(borrowers, F.col("conv_id") == F.col("lender")).filter("pos <= h")
    lent = lent.select(F.col("borrower").alias("conv_id"), "pos", "name", "size")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return own.union(lent), lengths


def segments(turns: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(conv_id, seg, length, key, sizes): segments of at most ``size`` turns; key: context and turn names.

    A conversation without turns is one empty segment.  The contexts of a long conversation follow from each other; one
    task reads one digest for each of its segments, as a stream.
    """
    cut = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "size"))).alias("turns"))
    cut = cut.join(lengths, "conv_id").select("conv_id", "seg", "length", F.col("turns.name").alias("names"), F.col("turns.size").alias("sizes"))
    none = lengths.filter("length = 0").select("conv_id", F.lit(0).cast("long"), "length", F.array().cast("array<binary>"), F.array().cast("array<long>"))

    def pack(batch: pa.RecordBatch) -> Iterator[list]:
        for conv, seg, length, names, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            joined = b"".join(names)
            yield [conv, seg, length, short(joined), joined, sizes]

    def chain(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, context = None, ROOT

        def follow(batch: pa.RecordBatch) -> Iterator[list]:
            nonlocal current, context
            for conv, seg, digest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv != current:
                    current, context = conv, ROOT
                yield [conv, seg, context]
                context = short(context + digest)

        yield from batches(follow, _CHAIN)(source)

    packed = stored(cut.union(none).mapInArrow(batches(pack, _PACKED), ddl(_PACKED)), "trie-packed")
    chained = packed.filter(F.col("length") > size).select("conv_id", "seg", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    contexts = chained.mapInArrow(chain, ddl(_CHAIN))
    joined = packed.join(contexts, ["conv_id", "seg"], "left")
    return stored(joined.select("conv_id", "seg", "length", F.concat(F.coalesce("context", F.lit(ROOT)), "names").alias("key"), "sizes"), "trie-segments")


def splitters(items: DataFrame, per_shard: int) -> list[bytes]:
    """Evenly spaced paths of a sorted sample; a path that is frequent enough comes several times."""
    n = items.count()
    shards = min(MOST_SHARDS, -(-n // per_shard))
    if shards < 2:
        return []
    place = F.shiftrightunsigned(F.xxhash64("conv_id", "seg", F.lit("sample")), 11) / float(1 << 53)
    paths = sorted(bytes(r["key"]) for r in items.filter(place < shards * SAMPLES / n).select("key").toLocalIterator())
    return paths[SAMPLES - 1::SAMPLES]


def alike(a: bytes, b: bytes) -> int:
    """How many names two paths have in common at their start."""
    n = min(len(a), len(b)) // NAME
    for i in range(n):
        if a[i * NAME:(i + 1) * NAME] != b[i * NAME:(i + 1) * NAME]:
            return i
    return n


def place(items: DataFrame, paths: list[bytes], size: int) -> DataFrame:
    """Items with their shard, the depth down to which their path lies in the skeleton (-1: nowhere), and, for a
    conversation that ends in the skeleton, the name of that node.

    An item between two splitters has its skeleton nodes in common with one of these two.  An item equal to some
    splitters goes to any shard between them, by a hash: all its nodes are in the skeleton.
    """
    shared = items.sparkSession.sparkContext.broadcast(paths)

    def put(batch: pa.RecordBatch) -> Iterator[list]:
        own = shared.value
        for conv, seg, length, key, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            shard, after = bisect_left(own, key), bisect_right(own, key)
            skeleton = max((alike(key, x) for x in own[max(0, shard - 1):shard + 1]), default=0) - 1
            if after > shard:
                shard += hash((conv, seg)) % (after - shard + 1)
            ends = skeleton >= len(key) // NAME - 1 and seg * size + len(key) // NAME - 1 == length
            yield [conv, seg, length, key, sizes, shard, skeleton, name_of(key) if ends else None]

    placed = items.mapInArrow(batches(put, _PLACED), ddl(_PLACED))
    return stored(placed, "trie-placed")


def name_of(key: bytes) -> bytes:
    """The name of the node at the end of a segment's path; the same as the context of the segment after a full one."""
    return short(key[:NAME] + short(key[NAME:])) if len(key) > NAME else key


class _Walk:
    """The open nodes of one shard, from the context down, and the rows of those that are closed."""

    def __init__(self, size: int) -> None:
        self.size, self.open, self.before, self.rows = size, [], b"", []

    def close(self) -> None:
        node = self.open.pop()
        j, parent = len(self.open), self.open[-1] if self.open else None
        if parent:
            parent["n"] += node["n"]
            parent["conv"] = node["conv"] if parent["conv"] is None else min(parent["conv"], node["conv"])
            parent["leaves"] += node["leaves"]
            parent["saved"] += node["saved"]
            parent["children"] += not node["shared"]
        deep = j == 0 and node["seg"] > 0  # the same node as the end of the segment above, which counts its members
        self.rows.append([
            node["name"], parent["name"] if parent else None, node["seg"] * self.size + j, node["shared"] or j == self.size or deep,
            node["shared"], node["shared"] and j > 0, bool(parent and parent["shared"]), None if deep else node["conv"],
            *((0, node["children"], 0, 0) if deep else (node["n"], node["children"], node["leaves"], node["saved"])),
            node["ends"].hexdigest() if node["ends"] else None])

    def add(self, conv: int, seg: int, length: int, key: bytes, sizes: list[int], skeleton: int, top: int, leaf: int, after: int) -> None:
        m = len(key) // NAME - 1
        same = len(self.open) if key == self.before else alike(key, self.before)
        while len(self.open) > same:
            self.close()
        for j in range(len(self.open), m + 1):
            if j == 0:
                hashed, name = hashlib.sha256(), key[:NAME]
            else:
                hashed = self.open[-1]["hash"].copy()
                hashed.update(key[j * NAME:(j + 1) * NAME])
                name = short(key[:NAME] + hashed.digest()[:NAME])
            self.open.append({"name": name, "hash": hashed, "seg": seg, "shared": j <= skeleton, "n": 0, "conv": None,
                              "children": 0, "leaves": 0, "saved": 0, "ends": None})
        node = self.open[m]
        node["n"] += 1
        node["conv"] = conv if node["conv"] is None else min(node["conv"], conv)
        node["leaves"] += leaf
        node["saved"] += after
        for j in range(1, min(m, top - 1 - seg * self.size) + 1):
            self.open[j]["saved"] += sizes[j - 1]
        if seg * self.size + m == length and not node["shared"]:
            if node["ends"] is None:
                node["ends"] = hashlib.sha256(str(conv).encode())
            else:
                node["ends"].update(b",%d" % conv)
        self.before = key


def walk(items: DataFrame, shards: int, size: int) -> DataFrame:
    """Nodes of each sorted shard, finished ones and parts (``reduce``).  Memory: one path and one batch."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = _Walk(size)
        for batch in source:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own.add(*row)
                if len(own.rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own.rows, strict=True), _NODES, strict=True)], schema=_NODES)
                    own.rows = []
        while own.open:
            own.close()
        if own.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own.rows, strict=True), _NODES, strict=True)], schema=_NODES)

    sorted_ = items.repartitionById(shards, "shard").sortWithinPartitions("key", "conv_id")
    sorted_ = sorted_.select("conv_id", "seg", "length", "key", "sizes", "skeleton", "top", "leaf", "after")
    return stored(sorted_.mapInArrow(run, ddl(_NODES)), "trie-nodes")


def reduced(parts: DataFrame) -> DataFrame:
    """One row per node: local ones as they are, parts added up; skeleton children are counted from their own rows."""
    shared = parts.filter("reduce").groupBy("name").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "reduce", "skeleton", "counted", "under")), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))
    shared = stored(shared, "trie-shared")
    children = shared.filter("counted").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("more"))
    shared = shared.join(children, F.col("name") == F.col("of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    return stored(parts.filter("NOT reduce").unionByName(shared.drop("of", "more")), "trie-reduced")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(name, found): SHA-256 of the conv_ids that end at a skeleton node, ascending and comma-joined.

    Ranges of (name, conv_id) are joined into pieces of some kilobytes in parallel.  A hash is a chain, so one task reads
    a node's pieces, as a stream in order.
    """
    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def cut(batch: pa.RecordBatch) -> Iterator[list]:
            nonlocal name, held
            for x, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (x != name or len(held) >= 400):
                    yield [name, held[0], ",".join(map(str, held))]
                    held = []
                name = x
                held.append(conv)

        yield from batches(cut, _PIECES, 1000)(source)
        if held:
            yield pa.record_batch([[name], [held[0]], [",".join(map(str, held))]], schema=_PIECES)

    def chain(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None

        def add(batch: pa.RecordBatch) -> Iterator[list]:
            nonlocal name, h
            for x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x == name:
                    h.update(b"," + text.encode())
                    continue
                if h:
                    yield [name, h.hexdigest()]
                name, h = x, hashlib.sha256(text.encode())

        yield from batches(add, _ENDS)(source)
        if h:
            yield pa.record_batch([[name], [h.hexdigest()]], schema=_ENDS)

    cut = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, ddl(_PIECES))
    return cut.repartition("name").sortWithinPartitions("name", "first").select("name", "text").mapInArrow(chain, ddl(_ENDS))


def trie(turns: DataFrame, lengths: DataFrame, size: int = TURNS, per_shard: int = PER_SHARD) -> DataFrame:
    """The nodes of the prefix trie of paths.

    turns (conv_id, pos, name, size): pos counts from 1 without gaps; lengths (conv_id, length): every conversation, with
    its number of turns, maybe none.  A node: conv_id (smallest member), depth, parent_conv_id (null: root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (sum over its subtree of (n_convs - 1) * size of the
    last turn), ends_sha256 (of the ids of members that end there, ascending, comma-joined).
    Without conversations there are no nodes.
    """
    items = segments(turns, lengths, size)
    paths = splitters(items, per_shard)
    placed, shards = place(items, paths, size), len(paths) + 1
    nothing = (F.lit(0).cast("long").alias(x) for x in ("top", "leaf", "after"))
    owners = reduced(walk(placed.select("*", *nothing), shards, size))
    own = owners.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    known = placed.join(own, "conv_id", "left").withColumn("top", F.coalesce("top", F.col("length") + 1)).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    kept = F.greatest(F.lit(0), F.least(F.size("sizes"), F.col("top") - 1 - F.col("seg") * size)).cast("int")
    shared = F.aggregate(F.slice("sizes", F.lit(1), kept), F.lit(0).cast("long"), lambda a, b: a + b)
    below = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    long = known.filter(F.col("length") > size).withColumn("after", F.coalesce(F.sum(shared).over(below), F.lit(0)))
    known = known.filter(F.col("length") <= size).withColumn("after", F.lit(0).cast("long")).unionByName(long)
    nodes = reduced(walk(known, shards, size))
    parents = owners.select(F.col("name").alias("of"), F.col("conv_id").alias("parent_conv_id"), "skeleton")
    # At most one row for each depth of each splitter.
    few = F.broadcast(parents.filter("skeleton").drop("skeleton"))
    out = nodes.filter("under").join(few, F.col("parent") == F.col("of"), "left")
    out = out.unionByName(nodes.filter("NOT under").join(parents.drop("skeleton"), F.col("parent") == F.col("of"), "left"))
    found = end_hashes(placed.filter("ends_at IS NOT NULL").select(F.col("ends_at").alias("name"), "conv_id"))
    out = out.join(found, "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("found", "ends", F.lit(NOTHING)).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered(table(spark, sf_dir, "conversations"))))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS name, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {crc32_sql("conv_id::VARCHAR")} % 9 END AS h
  FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, c.h, least(c.h, coalesce(l.n, 0)) AS taken, c.conv_id - c.conv_id % 5 AS lender FROM c LEFT JOIN c l ON l.conv_id = c.conv_id - c.conv_id % 5),
r AS (
  SELECT conv_id, pos - h + taken AS pos, name, size FROM t JOIN p USING (conv_id) WHERE pos > h
  UNION ALL SELECT p.conv_id, pos, name, size FROM t JOIN p ON t.conv_id = p.lender WHERE pos <= h),
w AS (SELECT p.conv_id, coalesce(list(name ORDER BY pos) FILTER (name IS NOT NULL), []) AS path, coalesce(list(size ORDER BY pos) FILTER (name IS NOT NULL), []) AS sizes
  FROM p LEFT JOIN r USING (conv_id) GROUP BY p.conv_id),
x AS (SELECT conv_id, path, sizes, unnest(range(len(path) + 1)) AS depth FROM w),
n AS (
  SELECT path[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
    count(DISTINCT path[depth + 1]) FILTER (len(path) > depth) AS n_children,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM x GROUP BY 1, 2),
s AS (
  SELECT a.prefix, a.depth, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.size)::BIGINT AS saved_tokens
  FROM n a JOIN (SELECT *, unnest(range(depth + 1)) AS above FROM n) d ON d.above = a.depth AND d.prefix[:a.depth] = a.prefix GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (prefix, depth) LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.prefix = n.prefix[:n.depth - 1]
"""
