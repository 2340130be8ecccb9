"""Merkle manifest of a dataset as postorder append logs.

A tree of arity 3 over n leaves is written in completion order: a node follows its last child.  Aligned builders each
take ``BLOCK`` = 3^LEVELS consecutive nodes, finish the subtree above them and append its nodes to their run of the log; the tops
of the blocks are the leaves of the next tier, so each tier is a log of its own and a row never holds more than one block.
The position of node i of a level follows from the sizes of the subtrees before it, without any index, so a proof reads
the siblings at computed positions of a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, numbered, stored, table
from .tokens import batches

ARITY, LEVELS = 3, 5
BLOCK = ARITY ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_RUNS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("run", pa.list_(pa.binary())), ("top", pa.binary())])
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATHS = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", _STEP)])
_PATH = "array<struct<before string, after string>>"
_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


_PROVED = "proof_sha256 string, folded_root string"


def counts(n: int) -> list[int]:
    """Nodes of each level of a tree over n leaves, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def position(level: int, i: int, n: int) -> int:
    """Place in the log, from 0, of node i of a level in a tree over n leaves.

    The node is complete with leaf e = min((i + 1) * 3^level, n).  Before the end of the tree, e leaves complete e // 3^j nodes of
    level j, and of those that are complete with leaf e the higher ones come later.  With the last leaf the last node
    of each level follows, from the lowest level to the root, after all others.
    """
    e = (i + 1) * ARITY ** level
    if e < n:
        before, j, span = 0, 0, 1
        while span <= e:
            before += e // span - (j > level and e % span == 0)
            j, span = j + 1, span * ARITY
        return before - 1
    return sum(x - 1 for x in counts(n)) + level


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(leaves: list[str], first: int, n: int) -> list[str]:
    """The run of one builder in completion order.  leaves: consecutive nodes from ``first`` (aligned) on of a tree over n.

    The builder of a tree's only block goes up to the root, any other one LEVELS levels.
    """
    most = LEVELS if n > BLOCK else len(counts(n)) - 1
    run: list[str] = []
    held: list[list[str]] = [[] for _ in range(most + 1)]

    def append(level: int, node: str) -> None:
        run.append(node)
        held[level].append(node)
        if level < most and len(held[level]) == ARITY:
            done, held[level] = held[level], []
            append(level + 1, digest(*done))

    for x in leaves:
        append(0, x)
    for level in range(most):  # the last runs of the tree may be shorter
        if held[level]:
            done, held[level] = held[level], []
            append(level + 1, digest(*done))
    return run


def siblings(run: list[str], start: int, i: int, n: int) -> list[tuple[str, str]]:
    """For each level of a run, from node i of its lowest: digests left and right of the path's node, joined."""
    levels = counts(n)
    path = []
    for level in range(min(LEVELS, len(levels) - 1) if n > BLOCK else len(levels) - 1):
        lead = i - i % ARITY
        group = [run[position(level, x, n) - start] for x in range(lead, min(lead + ARITY, levels[level]))]
        path.append(("".join(group[:i - lead]), "".join(group[i - lead + 1:])))
        i //= ARITY
    return path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before, node, after)
    return node


@dataclass
class Forest:
    """Trees over nodes (tree, place, node), the runs of each tier, and each tree's root (tree, n, root)."""

    tiers: list[DataFrame]
    roots: DataFrame


def forest(nodes: DataFrame, label: str) -> Forest:
    """Builds all trees tier by tier; place counts from 0 within a tree; node: a digest as 32 bytes."""
    sizes = stored(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{label}-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    tiers = []

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for tree, block, n, members in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            own = build([x["node"].hex() for x in members], block * BLOCK, n)
            yield [tree, block, n, position(0, block * BLOCK, n), [bytes.fromhex(x) for x in own], bytes.fromhex(own[-1])]

    while True:
        blocks = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("members"))
        rows = blocks.join(sizes, "tree").select("tree", "block", "n", "members")
        done = stored(rows.mapInArrow(batches(run, _RUNS, 500), "tree string, block long, n long, first long, run array<binary>, top binary"), f"{label}-log")
        tiers.append(done)
        if most <= BLOCK:
            break
        # A tree that is complete stays as it is, a tree of one node.
        nodes = done.select("tree", F.col("block").alias("place"), F.col("top").alias("node"))
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / BLOCK))
        most = -(-most // BLOCK)
    final = tiers[-1].select("tree", "top")
    whole = tiers[0].groupBy("tree").agg(F.max("n").alias("n"))
    return Forest(tiers, stored(whole.join(final, "tree").select("tree", "n", F.col("top").alias("root")), f"{label}-roots"))


def extended(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, place, path) of the nodes of a tier: their steps within their block, then those from its top (tree, block, above)."""
    def extend(batch: pa.RecordBatch) -> Iterator[list]:
        for tree, block, n, first, run, path in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            digests = [x.hex() for x in run]
            for i in range(block * BLOCK, min(n, (block + 1) * BLOCK)):
                yield [tree, i, [{"before": a, "after": b} for a, b in siblings(digests, first, i, n)] + path]

    rows = tier.join(above, ["tree", "block"]).select("tree", "block", "n", "first", "run", "above")
    return stored(rows.mapInArrow(batches(extend, _PATHS, 500), f"tree string, place long, path {_PATH}"), "manifest-paths")


def tops(built: Forest, above: DataFrame) -> DataFrame:
    """(tree, block, above): the path from the top of each block of the first tier to the end of ``above`` (tree, path).

    Works from the last tier down: the siblings of a tier's nodes lie in its runs.
    """
    out = built.tiers[-1].select("tree", "block").join(above.select("tree", F.col("path").alias("above")), "tree")
    for tier in reversed(built.tiers[1:]):
        out = extended(tier, out).select("tree", F.col("place").alias("block"), F.col("path").alias("above"))
    return out


def field(x: Column) -> Column:
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in COLUMNS)), 256))


def tree_name(source: Column) -> Column:
    """A name that is never null and sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of each row of docs (doc_id, source, lang, n_chars, text), and what its proof folds to.

    * A leaf is the SHA-256 of the five fields, each ``-`` for null, else its bytes' number, ``:`` and its value.  Other columns take no part.
    * The leaves of a source ascend by doc_id, null first; of equal ids by digest; repeated rows follow each other.  Null is
      a source of its own, the first.  Sources are leaves of the last tree.
    * ``tampered``: the text to verify; null keeps the row as it is.  The path is of the untampered rows.
    * An empty table gives no rows.
    """
    text = F.col("text")
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf_of(tampered))
    slim = docs.select(tree_name(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(text).alias("node"), other.alias("other"))
    leaves = stored(numbered(slim, "tree", [F.col("doc_id").asc_nulls_first(), F.col("node")], "place", "manifest-rows"), "manifest-leaves")
    own = forest(leaves.select("tree", "place", "node"), "manifest")
    subroots = own.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    subroots = stored(numbered(subroots, "tree", [F.col("source")], "place", "manifest-sources"), "manifest-subroots")
    top = forest(subroots.select("tree", "place", "node"), "manifest-top")
    root = top.roots.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, leaf string, subroot string, root string, {_PROVED}, verified boolean")
    root = root["root"].hex()
    none = F.array().cast(_PATH)
    ends = extended(top.tiers[0], tops(top, top.roots.select("tree", none.alias("path"))))
    above = subroots.join(ends, ["tree", "place"]).select(F.col("source").alias("tree"), "path")
    upper = tops(own, above).join(own.roots.select("tree", "root"), "tree")
    groups = leaves.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.collect_list(F.struct("place", "doc_id", "node", "other")).alias("members"))
    rows = own.tiers[0].join(groups, ["tree", "block"]).join(upper, ["tree", "block"]).select("n", "first", "run", "members", "above", "root")

    def prove(batch: pa.RecordBatch) -> Iterator[list]:
        for n, first, run, members, path, subroot in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            digests = [x.hex() for x in run]
            rest = [(x["before"], x["after"]) for x in path]
            for m in members:
                whole = siblings(digests, first, m["place"], n) + rest
                node = m["node"].hex()
                folded = fold(node if m["other"] is None else m["other"].hex(), whole)
                yield [m["doc_id"], node, subroot.hex(), digest(*(x for step in whole for x in step)), folded]

    found = rows.mapInArrow(batches(prove, _PROOFS), f"doc_id long, leaf string, subroot string, {_PROVED}")
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return proofs(docs, cut)


def _oracle(levels: int = 13, top_levels: int = 9) -> str:
    """SQL for up to 3^levels documents of a source and 3^top_levels sources: a level is a grouped query."""
    def fields(text: str) -> str:
        each = [text if c == "text" else f"{c}::VARCHAR" for c in COLUMNS]
        return " || ".join(f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')" for x in each)

    def climb(name: str, most: int) -> list[str]:
        out = []
        for k in range(most):
            out.append(f"""{name}s{k} AS (
  SELECT tree, i, n, coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node) OVER w, '') AS before, coalesce(lead(node) OVER w, '') || coalesce(lead(node, 2) OVER w, '') AS after
  FROM {name}{k} WINDOW w AS (PARTITION BY tree, i // 3 ORDER BY i))""")
            out.append(f"""{name}{k + 1} AS (
  SELECT tree, i // 3 AS i, CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node, (n + 2) // 3 AS n
  FROM {name}{k} GROUP BY tree, n, i // 3)""")
        return out

    def folds(docs: str, name: str, most: int) -> list[str]:
        return [f"""{docs}{k + 1} AS (
  SELECT d.* EXCLUDE (i, folded, proof), d.i // 3 AS i, CASE WHEN s.n = 1 THEN folded ELSE sha256(before || folded || after) END AS folded, proof || before || after AS proof
  FROM {docs}{k} d JOIN {name}s{k} s ON d.tree = s.tree AND d.i = s.i)""" for k in range(most)]

    cut = "CASE WHEN " + crc32_sql("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    parts = [f"""r AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({fields('text')}) AS leaf, sha256({fields(f'({cut})')}) AS folded FROM documents)""",
             "d0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM r)",
             "t0 AS (SELECT tree, i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM d0)", *climb("t", levels),
             f"u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, node, count(*) OVER () AS n, tree AS source FROM t{levels})", *climb("u", top_levels),
             *folds("d", "t", levels),
             f"e0 AS (SELECT doc_id, leaf, '' AS tree, u0.i, folded, proof, u0.node AS subroot FROM d{levels} d JOIN u0 ON d.tree = u0.source)", *folds("e", "u", top_levels)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.node AS verified FROM e{top_levels} CROSS JOIN u{top_levels} u"""


ORACLE = _oracle()
