"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots.

Rows are dealt to parts by ranges of (group, key), so a part holds a stretch of leaves and a leaf's
place in its group follows from counts per part. Every digest is an event: it goes to its parent, a
partial parent gathers the digests of its children by their place, and when it has as many as the
group's size says it will get, it becomes an event of its own. A group's root goes on as a leaf of the
tree over groups, so one rule leads from leaves to the root. What is still partial when a part ends
(the edges of its stretch, a few nodes a level) is the part's frontier; frontiers of neighbouring
parts meet in the next round, until the root is left.

Proofs go the other way: the root's is empty, and the tasks of a round build the same parents again,
hand each node its siblings and the proof of its parent, and pass the proofs of their own events on to
the round before. Leaves get theirs in the last step and are folded back to the root there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_remainder, written

ARITY = 3
#: Leaves of a part, on average, at most: what a task holds at once on the way back.
PART_ROWS = 1 << 16
#: Parts whose frontiers meet in one task of the next round.
FAN = 64
#: The group number of the tree over groups.
TOP = -1

EVENT = "part int, g long, level int, idx long, size long, digest string"
STEP = "array<struct<at:int,others:array<string>>>"
PROOF = f"part int, g long, level int, idx long, path {STEP}, root string"
LEAF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _height(size: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Shape:
    """Where nodes stand. A node is (group, level, index); a group's root is leaf ``group`` of the tree over groups."""

    def __init__(self, groups: int):
        self.heights: dict[int, int] = {}
        self.sizes = {TOP: groups}

    def node(self, g: int, level: int, idx: int, size: int) -> tuple[int, int, int]:
        if g != TOP and g not in self.sizes:
            self.sizes[g] = size
        return self._settled(g, level, idx)

    def height(self, g: int) -> int:
        if g not in self.heights:
            self.heights[g] = _height(self.sizes[g])
        return self.heights[g]

    def _settled(self, g: int, level: int, idx: int) -> tuple[int, int, int]:
        return (TOP, 0, g) if g != TOP and level == self.height(g) else (g, level, idx)

    def parent(self, node: tuple[int, int, int]) -> tuple[tuple[int, int, int], int, int] | None:
        """(parent, the node's place in it, how many children it has); none for the root."""
        g, level, idx = node
        if level == self.height(g):
            return None
        width = self.sizes[g]
        for _ in range(level):
            width = -(-width // ARITY)
        first = idx - idx % ARITY
        return self._settled(g, level + 1, idx // ARITY), idx - first, min(ARITY, width - first)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_EVENT = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
_STEP = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
_PROOF = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", _STEP), ("root", pa.string())])
_LEAF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def frontier(events: DataFrame, groups: int) -> DataFrame:
    """The nodes that the tasks' ``events`` leave without a whole parent, per part; the root, once it is found, is one of them."""

    def run(batches):
        shape, partial, roots = Shape(groups), {}, []
        for batch in batches:
            for part, g, level, idx, size, digest in _rows(batch, *_EVENT.names):
                node = shape.node(g, level, idx, size)
                while True:
                    up = shape.parent(node)
                    if up is None:
                        roots.append((part, *node, groups, digest))
                        break
                    parent, place, arity = up
                    held = partial.setdefault((part, parent), {})
                    held[place] = (digest, node)
                    if len(held) < arity:
                        break
                    del partial[(part, parent)]
                    digest, node = _hash([held[k][0] for k in range(arity)]), parent
        left = [(part, *node, shape.sizes[node[0]], digest) for (part, _), held in partial.items() for digest, node in held.values()]
        yield from _batches(roots + left, _EVENT)

    return events.select(*_EVENT.names).mapInArrow(run, EVENT)


class Descent:
    """The parents that a part's events make below the nodes whose proofs are known, and the proofs of all of these."""

    def __init__(self, groups: int):
        self.shape = Shape(groups)
        self.outer: dict[tuple, tuple[list, str]] = {}
        self.digest: dict[tuple, str] = {}
        self.above: dict[tuple, tuple[tuple, int]] = {}
        self.below: dict[tuple, dict[int, str]] = {}
        self.known: dict[tuple, tuple[list, str | None, str]] = {}

    def event(self, g: int, level: int, idx: int, size: int, digest: str) -> tuple:
        first = node = self.shape.node(g, level, idx, size)
        while True:
            self.digest[node] = digest
            if node in self.outer:
                return first
            parent, place, arity = self.shape.parent(node)
            self.above[node] = parent, place
            held = self.below.setdefault(parent, {})
            held[place] = digest
            if len(held) < arity:
                return first
            digest, node = _hash([held[k] for k in range(arity)]), parent

    def proof(self, node: tuple) -> tuple[list, str | None, str]:
        """(path, the group's root, the root): siblings by level from the node up; the second is null above groups."""
        if node not in self.known:
            if node in self.outer:
                path, root = self.outer[node]
                own = None
                if node[0] != TOP:
                    own = folded(self.digest[node], path[: self.shape.height(node[0]) - node[1]])
            else:
                parent, place = self.above[node]
                rest, own, root = self.proof(parent)
                held = self.below[parent]
                path = [(place, [held[k] for k in range(len(held)) if k != place]), *rest]
            if node[:2] == (TOP, 0):
                own = self.digest[node]
            self.known[node] = path, own, root
        return self.known[node]


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """What a digest and the siblings on its way up come to."""
    for at, others in path:
        digest = _hash([*others[:at], digest, *others[at:]])
    return digest


def _descend(events: DataFrame, proofs: DataFrame, parts: int, groups: int, more: dict[str, str], give, schema: pa.Schema, ddl: str) -> DataFrame:
    """``give(descent, node, row)`` for each event, part by part, once the part's proofs and events are known.

    ``more`` names further columns of the events and their types.
    """
    names = ["g", "level", "idx", "size", "digest", *more]
    told = proofs.select("part", F.lit(0).alias("kind"), "g", "level", "idx", "path", "root", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    asked = events.select("part", F.lit(1).alias("kind"), "g", "level", "idx", F.lit(None).cast(STEP).alias("path"), F.lit(None).cast("string").alias("root"), "size", "digest", *more)

    def run(batches):
        part, descent, waiting = None, None, []

        def out():
            # roots of groups hang from the tree over groups, so all events come before the first proof
            placed = [(descent.event(*row[:5]), row) for row in waiting]
            yield from _batches([give(descent, part, node, row) for node, row in placed], schema)

        for batch in batches:
            for own, kind, path, root, *row in _rows(batch, "part", "kind", "path", "root", *names):
                if own != part:
                    if descent:
                        yield from out()
                    part, descent, waiting = own, Descent(groups), []
                if kind == 0:
                    descent.outer[tuple(row[:3])] = [(s["at"], s["others"]) for s in path], root
                else:
                    waiting.append(row)
        if descent:
            yield from out()

    return told.unionByName(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(run, ddl)


def _to_proof(descent: Descent, part: int, node: tuple, row: list) -> tuple:
    path, _, root = descent.proof(node)
    return (part, *node, [{"at": at, "others": others} for at, others in path], root)


def _to_leaf(descent: Descent, part: int, node: tuple, row: list) -> tuple:
    digest, tampered, doc_id = row[4:7]
    path, own, root = descent.proof(node)
    again = folded(tampered, path)
    return doc_id, digest, own, root, _hash([d for _, others in path for d in others]), again, again == root


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each '-' if null, else its UTF-8 length, ':' and itself."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def leaves(docs: DataFrame, changed: Column, when: Column) -> DataFrame:
    """(doc_id, source, digest, tampered, row) of ``docs``: the leaf of each row, and of the same row with the text ``changed`` where ``when`` holds."""
    field = lambda text: leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    digest = field(F.col("text"))
    # a text that does not change is not hashed twice
    tampered = F.when(when & ~changed.eqNullSafe(F.col("text")), field(changed)).otherwise(digest)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest.alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, parts: int, group: str, *order: str) -> tuple[DataFrame, int]:
    """(``rows`` with part, g, idx and size; the number of groups).

    Parts are ranges of (group, order), so a large group spreads over many. ``at`` counts rows within a
    part; counts per (group, part) turn it into ``idx``, the place in the group, and groups are
    numbered in their order by where they begin.
    """
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("at", 33).cast("int")), "dealt")
    spans = written(dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "spans")
    groups = spans.groupBy(group).agg(F.min("part").alias("part"), F.min("first").alias("first"), F.sum("n").alias("size"))
    # parts are so few that one task can add them up: a row each
    starts = groups.groupBy("part").agg(F.count(F.lit(1)).alias("starts"))
    starts = starts.select("part", (F.sum("starts").over(Window.orderBy("part")) - F.col("starts")).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    groups = written(groups.join(starts, "part").select(F.col(group).alias("_group"), number.alias("g"), "size"), "groups")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(group, "part", (before - F.col("first")).alias("shift"))
    spans = spans.join(groups, F.col(group).eqNullSafe(F.col("_group"))).select("_group", F.col("part").alias("_part"), "shift", "g", "size")
    out = dealt.join(spans, F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")))
    return out.select(*rows.columns, "part", "g", F.lit(0).alias("level"), (F.col("at") + F.col("shift")).alias("idx"), "size"), groups.count()


def manifest(docs: DataFrame, changed: Column | None = None, when: Column | None = None, part_rows: int = PART_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Per source, leaves ascend by doc_id, a null one first; rows that repeat a doc_id ascend by their
    digest. Sources ascend by their UTF-8 bytes, a null one first. A group of one leaf is its own root,
    and so is a single group. ``folded_root`` is what the leaf of the row comes to with the siblings of
    its proof, after ``changed`` took the place of its text in rows that meet ``when`` (as the default:
    line feeds deleted, where the crc32 of the doc_id is even; a null doc_id counts as the empty text).
    Null and empty fields differ ('-' and '0:'); texts of any length are hashed whole; further columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    changed = F.replace("text", F.lit("\n"), F.lit("")) if changed is None else changed
    when = crc_remainder(2) == 0 if when is None else when
    rows = written(leaves(docs, changed, when), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // part_rows + 1)
    events, groups = placed(rows, parts, "source", "doc_id", "digest", "row")
    if not groups:
        return spark.createDataFrame([], LEAF)
    events = written(events.drop("row", "source"), "events")
    parts = 1 + events.agg(F.max("part")).first()[0]  # a cluster may deal more ranges than asked

    rounds = [(events, written(frontier(events, groups), "frontier"), parts)]
    while True:
        met = rounds[-1][1].withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        parts = -(-parts // fan)
        found = written(frontier(met.repartitionById(parts, F.col("part")), groups), "frontier")
        rounds.append((met, found, parts))
        if parts == 1:
            break
    proofs = rounds[-1][1].select("part", "g", "level", "idx", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    for (met, _, parts), (_, below, under) in zip(rounds[:0:-1], rounds[-2::-1]):
        # proofs of this round's events, under the numbers of the parts that they came from
        told = _descend(met, proofs, parts, groups, {}, _to_proof, _PROOF, PROOF).drop("part")
        proofs = written(told.join(below.select("part", "g", "level", "idx"), ["g", "level", "idx"]), "proofs")
    return _descend(events, proofs, rounds[0][2], groups, {"tampered": "string", "doc_id": "long"}, _to_leaf, _LEAF, LEAF)
