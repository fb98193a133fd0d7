"""Phrases whose words occur together more often than their parts foretell, with exact counts.

Counting every phrase would shuffle the corpus several times over, so candidates come first. Pass one
adds up a count-min sketch of all two-word phrases; pass two one of the longer phrases all of whose
two-word parts may be frequent; pass three reads the texts again and counts the phrases whose upper
bounds reach the threshold. A sketch only ever counts too much, so none is missed, and false
candidates are thrown out by the exact counts.

Pass three takes the texts in stretches of a bounded size and names the candidates that a stretch
holds. Each of their words becomes one character, every other word and every edge of a piece becomes
the delimiter, and an Aho-Corasick automaton over these characters counts all matches, overlapping
ones too. No match can cross a delimiter or begin within a word. A stretch with more candidates than a
shard is matched shard by shard; the number of candidates of the whole corpus bounds nothing and costs
no further pass. Counts are summed over tasks; thresholds, scores and ranks follow.
"""

from __future__ import annotations

import collections
import operator
import uuid
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, text_bytes, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases of a shard of a stretch: its automaton stays small, and its words (five times as many at most) are fewer than there are characters.
SHARD = 200_000
#: Counters of a sketch's row: one for so many bytes of text, a power of two within these bounds. The
#: heavy ones are broadcast as bits, two rows of 32 MB at most; beyond that the bounds get looser and
#: more false candidates reach the exact counts.
BYTES_A_COUNTER, FEWEST, MOST = 64, 1 << 16, 1 << 28
#: Counters of a block, the unit in which sketches are summed.
BLOCK = 1 << 16
#: Slots that a task gathers before it sums them.
FLUSH = 1 << 22
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Chunks of a stretch, the text that is matched at once.
LOT = 8

#: Ends of pieces become a byte that UTF-8 never has, tabs become spaces, A-Z become a-z.
EDGE = b"\xff"
_CUTS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_CUTS + b"\t" + bytes(range(65, 91)), EDGE * len(_CUTS) + b" " + bytes(range(97, 123)))

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            one = np.ones(1, np.uint64)
            self.up, self.down = (np.cumprod(np.concatenate([one, np.full(size - 1, x)]), dtype=np.uint64) for x in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Words:
    """The words of plain bytes: where they begin and end, their piece and their 64-bit hashes."""

    def __init__(self, text: bytes, salt: int = 0):
        self.text = text
        parts, at = [], 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            if end < len(text):  # cut behind a word
                cut = max(text.rfind(b" ", at, end), text.rfind(EDGE, at, end))
                if cut < 0:
                    found = [x for x in (text.find(b" ", end), text.find(EDGE, end)) if x >= 0]
                    cut = min(found, default=len(text) - 1)
                end = cut + 1
            parts.append(self._part(at, end, salt))
            at = end
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
        self.begin, self.end, self.piece, self.hash = columns

    def _part(self, at: int, end: int, salt: int):
        data = np.frombuffer(self.text, np.uint8, end - at, at)
        edge = data == EDGE[0]
        word = ~edge & (data != 32)
        steps = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        begin, stop = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        # pieces only need to differ where neighbours do, so they are named by the place of the edge before them
        last = np.maximum.accumulate(np.where(edge, np.arange(at, end), -1))
        piece = last[begin]
        if len(piece) and at:
            before = self.text.rfind(EDGE, 0, at)
            piece = np.where(piece < 0, before, piece)
        up, down = _POWERS.of(len(data))
        if not len(begin):
            return begin, stop, piece, np.empty(0, np.uint64)
        total = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * word * up, begin)
        return begin + at, stop + at, piece, _mixed((total * down[begin]) ^ np.uint64(salt))

    def grams(self, longest: int, gate=None):
        """(n, positions, hashes) of the phrases of two words and more within pieces; with ``gate`` (hashes of two words to bool) the longer ones all of whose pairs pass."""
        ok, h, pair = np.ones(len(self.hash), bool), self.hash, None
        for n in range(2, longest + 1):
            if len(h) < 2:
                return
            ok = ok[:-1] & (self.piece[n - 1 :] == self.piece[n - 2 : -1])
            h = h[:-1] * _STEP + self.hash[n - 1 :]
            if n > 2 and pair is not None:
                ok = ok & pair[n - 2 :]
            at = np.flatnonzero(ok)
            found = _mixed(h[at] + np.uint64(n))
            yield n, at, found
            if n == 2 and gate is not None:
                pair = np.zeros(len(h), bool)
                pair[at] = gate(found)
                ok = pair


class Bits:
    """The counters of a sketch that reached the threshold, as bits."""

    def __init__(self, width: int, blocks: dict[int, bytes]):
        self.width, self.blocks = width, blocks
        self.bits = None

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.zeros(max(2 * self.width // 8, BLOCK // 8), np.uint8)
            for block, data in self.blocks.items():
                self.bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(data, np.uint8)
        out = np.ones(len(hashes), bool)
        for slot in slots(hashes, self.width):
            out &= (self.bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0
        return out

    def __reduce__(self):
        return Bits, (self.width, self.blocks)


def slots(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The counters of each hash, one in either row."""
    low = np.uint64(width - 1)
    return [(hashes & low).astype(np.uint32), ((hashes >> np.uint64(32)) & low).astype(np.uint32) + np.uint32(width)]


def _langs(batch: pa.RecordBatch) -> dict[str, bytes]:
    """The batch's plain texts by language, pieces apart."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, []).append(text)
    return {lang: EDGE.join(texts).translate(_PLAIN) for lang, texts in found.items()}


def _salt(lang: str) -> int:
    return int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, lang).bytes[:8], "big")


def texts_of(docs: DataFrame) -> DataFrame:
    """(lang, text) with null languages as 'und' and null texts empty, as bytes."""
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("text"))


def sketch(texts: DataFrame, width: int, least: int, longest: int, gate: Bits | None = None) -> Bits:
    """The heavy counters of a count-min sketch of the two-word phrases, or with ``gate`` of the longer ones.

    Tasks send sums of the counters they met, in blocks, no count above the threshold; blocks are
    summed where they meet.
    """
    sent = spark_broadcast(texts, gate)
    kind = np.min_scalar_type(least)

    def flushed(gathered):
        slot, n = np.unique(np.concatenate(gathered), return_counts=True)
        n = np.minimum(n, least).astype(kind)
        cut = np.flatnonzero(np.diff(slot // BLOCK)) + 1
        inner = (slot % BLOCK).astype(np.uint16)
        ids = slot[np.concatenate([[0], cut])] // BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array([x.tobytes() for x in np.split(c, cut)], pa.binary()) for c in (inner, n))], ["block", "slots", "counts"])

    def run(batches):
        gathered, size = [], 0
        bits = sent.value if sent else None
        for batch in batches:
            for lang, text in _langs(batch).items():
                for n, _, hashes in Words(text, _salt(lang)).grams(longest if bits else 2, bits.passes if bits else None):
                    if n == 2 and bits:
                        continue
                    for slot in slots(hashes, width):
                        # a long text's slots are summed piece by piece, too
                        for k in range(0, len(slot), FLUSH):
                            gathered.append(slot[k : k + FLUSH])
                            size += len(gathered[-1])
                            if size >= FLUSH:
                                yield from flushed(gathered)
                                gathered, size = [], 0
        if size:
            yield from flushed(gathered)

    def added(batches):
        block, total = None, None

        def out():
            heavy = np.packbits(total >= least, bitorder="little")
            if heavy.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([heavy.tobytes()], pa.binary())})

        for batch in batches:
            for own, slot, n in zip(*(batch.column(c).to_pylist() for c in ("block", "slots", "counts"))):
                if own != block:
                    if total is not None:
                        yield from out()
                    block, total = own, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(slot, np.uint16)] += np.frombuffer(n, kind)
        if total is not None:
            yield from out()

    parts = texts.mapInArrow(run, "block int, slots binary, counts binary")
    heavy = parts.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, bits binary")
    return Bits(width, {r.block: bytes(r.bits) for r in heavy.collect()})  # 64 MB at most


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value) if value is not None else None


def tally(text: bytes, lang: str, pairs: Bits, longer: Bits, longest: int, shard: int = SHARD) -> tuple[int, collections.Counter]:
    """The number of words of plain ``text``, and exact counts of its words and of its phrases whose upper bounds reach the threshold.

    Each word of a shard's phrases becomes one character, other words and edges the guard, and an
    automaton over these characters counts all matches.
    """
    words = Words(text, _salt(lang))
    tokens = text.replace(EDGE, b" ").split()
    counts = collections.Counter(tokens)
    number = {w: k for k, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    begins, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, at, hashes in words.grams(longest, pairs.passes):
        keep = np.flatnonzero((pairs if n == 2 else longer).passes(hashes))
        order = keep[np.argsort(hashes[keep])]
        at, hashes = at[order], hashes[order]
        new = np.ones(len(at), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for k in range(n):  # hashes only bring equal phrases together; their words tell them apart
            own = ids[at + k]
            new[1:] |= own[1:] != own[:-1]
        begins.append(at[new])
        sizes.append(np.full(len(begins[-1]), n))
    begin, size = np.concatenate(begins), np.concatenate(sizes)
    edges = np.zeros(len(ids), np.int64)
    edges[1:] = words.piece[1:] != words.piece[:-1]
    place = np.arange(len(ids)) + np.cumsum(edges)
    for low in range(0, len(begin), shard):
        i, n = begin[low : low + shard], size[low : low + shard]
        ends = np.cumsum(n)
        own = ids[np.repeat(i - (ends - n), n) + np.arange(ends[-1])]
        used = np.unique(own)
        points = np.zeros(len(number), np.uint32)  # 0 is the guard
        points[used] = np.arange(1, len(used) + 1)
        points[points >= 0xD800] += 0x800  # around the surrogates
        keys = points[own].astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
        for k, (x, y) in enumerate(zip((ends - n).tolist(), ends.tolist())):
            automaton.add_word(keys[x:y], k)
        automaton.make_automaton()
        coded = np.zeros(place[-1] + 1, "<u4")
        coded[place] = points[ids]
        hits = np.fromiter(map(operator.itemgetter(1), automaton.iter(coded.tobytes().decode("utf-32-le"))), np.int64)
        for x, y, c in zip(i.tolist(), (i + n).tolist(), np.bincount(hits, minlength=len(i)).tolist()):
            if c:
                counts[b" ".join(tokens[x:y])] = c
    return len(tokens), counts


def counted(texts: DataFrame, pairs: Bits, longer: Bits, longest: int, least: int, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n, total): the words and the candidate phrases that occur ``least`` times or more, with exact counts; rows without a phrase have a task's number of words.

    One pass over the texts: whatever a stretch of text does not hold counts nothing there, so a
    stretch is only matched against its own candidates. A task's counts are summed, travel in packs of a
    bucket and are added up where the buckets meet.
    """
    first, second = spark_broadcast(texts, pairs), spark_broadcast(texts, longer)
    buckets = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packs(lang, sums):
        by: dict[int, tuple[list, list]] = {}
        for p, c in sums.items():
            names, numbers = by.setdefault(zlib.crc32(p) % buckets, ([], []))
            names.append(p)
            numbers.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([lang] * len(by), pa.string()), pa.array([EDGE.join(x) for x, _ in by.values()], pa.binary()), pa.array([np.array(c, np.int64).tobytes() for _, c in by.values()], pa.binary()), pa.nulls(len(by), pa.int64())], ["bucket", "lang", "pack", "counts", "total"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sums: dict[str, collections.Counter] = {}
        totals: dict[str, int] = {}

        def taken(lang):
            text, at = EDGE.join(held.pop(lang)), 0
            while at < len(text):  # stretches of whole pieces
                cut = text.find(EDGE, at + LOT * CHUNK)
                end = len(text) if cut < 0 else cut + 1
                n, counts = tally(text[at:end], lang, first.value, second.value, longest, shard)
                totals[lang] = totals.get(lang, 0) + n
                sums.setdefault(lang, collections.Counter()).update(counts)
                at = end
                if len(sums[lang]) > 1 << 18:
                    yield from packs(lang, sums.pop(lang))

        for batch in batches:
            for lang, text in _langs(batch).items():
                held.setdefault(lang, []).append(text)
            size = {lang: sum(map(len, x)) for lang, x in held.items()}
            every = sum(size.values()) >= 4 * LOT * CHUNK
            for lang, n in size.items():
                if every or n >= LOT * CHUNK:
                    yield from taken(lang)
        for lang in list(held):
            yield from taken(lang)
        for lang, counts in sums.items():
            yield from packs(lang, counts)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([k % buckets for k in range(len(totals))], pa.int32()), pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.binary()), pa.nulls(len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], ["bucket", "lang", "pack", "counts", "total"])

    def added(batches):
        at, sums = None, {}

        def out():
            every = [(p, c) for p, c in sums.items() if c >= least]
            for k in range(0, len(every), 1 << 16):
                part = every[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(part), pa.string()), pa.array([p.decode() for p, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64()), pa.nulls(len(part), pa.int64())], ["lang", "phrase", "n", "total"])

        for batch in batches:
            for bucket, lang, pack, counts, total in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "pack", "counts", "total"))):
                if pack is None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["lang", "phrase", "n", "total"])
                    continue
                if (bucket, lang) != at:
                    yield from out()
                    at, sums = (bucket, lang), {}
                for p, c in zip(pack.split(EDGE), np.frombuffer(counts, np.int64).tolist()):
                    sums[p] = sums.get(p, 0) + c
        yield from out()

    packed = texts.mapInArrow(run, "bucket int, lang string, pack binary, counts binary, total long")
    return packed.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(added, "lang string, phrase string, n long, total long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = 100, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text): each language's ``top`` phrases.

    Words are what spaces and tabs part within pieces; pieces end at .,;:!? and line ends; A-Z are
    lower-cased. A phrase of 2 to ``longest`` words counts with ``least`` occurrences or more (``a``). Of
    its cuts in two the one with the lowest floor(1000 a n / (l r)) counts, ties to the earliest cut; l
    and r are the parts' occurrences, n the language's words. Phrases within a longer one that has
    ``covered`` per cent of their occurrences go. Ties in score go to the larger a, then to the smaller
    phrase. Null languages are 'und', null texts empty; rows that repeat count again; texts of any
    length count whole; further columns are ignored; without phrases the result is empty.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = texts_of(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST, max(FEWEST, 1 << (size // BYTES_A_COUNTER).bit_length()))
    pairs = sketch(texts, width, least, longest)
    longer = sketch(texts, width, least, longest, pairs)
    named = written(counted(texts, pairs, longer, longest, least, shard), "counts")
    totals = named.where("phrase is null").groupBy("lang").agg(F.sum("total").alias("n"))
    # words of a phrase that counts occur as often at least, so what is rarer has been left behind
    found = named.where("phrase is not null").select("lang", "phrase", "n", F.split("phrase", " ").alias("w"))

    phrases = found.where(F.size("w") > 1).select("lang", "phrase", "w", F.col("n").alias("a"))
    inner = "flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))"
    inside = phrases.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(F.expr(inner))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < covered * F.col("a"))).drop("above")

    cuts = kept.select("lang", "phrase", "w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("one"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("two"))
    one, two = found.select("lang", F.col("phrase").alias("one"), F.col("n").alias("l")), found.select("lang", F.col("phrase").alias("two"), F.col("n").alias("r"))
    cuts = cuts.join(one, ["lang", "one"]).join(two, ["lang", "two"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
