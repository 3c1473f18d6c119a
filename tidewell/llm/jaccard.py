"""Operator 9: documents linked by the Jaccard similarity of their word shingles, with signature trees.

1. Every text becomes a set of shingle hashes; equal sets are one node with one key.
2. Partners are proposed by parts of sets: the hashes are dealt into k parts by their value, with
   k over the largest difference that a linked pair of this size may have, so that at least one
   part is the same in both. Parts are compared by hash; nothing is lost, whatever the texts are.
3. The sets that share a part form a group around their smallest key. Within a group, signature
   trees hold OR-combined bitmaps and size ranges of the sets below a node; pairs of nodes are
   walked down together and dropped when their largest possible overlap is too small, or when
   all sets below are in one component already. What is left is verified on the sets.
4. Components of the verified links.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewell.llm.components import components
from tidewell.llm.workers import ROWS, BoundedCache, kept, map_texts
from tidewell.session import materialize

#: Sizes within this factor are dealt into equally many parts.
SPAN = 1.6
#: Sets and hashes of a group that one task holds; larger groups are cut into blocks that meet in pairs.
BLOCK_SETS = 4096
BLOCK_HASHES = 2_000_000
FANOUT = 16
#: Words of the bitmaps that pairs of nodes are compared by at once; each comparison holds a few arrays of them.
PAIR_WORDS = 1 << 19
#: Nodes that need text are sent to all tasks up to this many; more are joined by a shuffle.
BROADCAST_IDS = 500_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def salt(number: int) -> np.uint64:
    return np.uint64((number + 1) * int(M1) % 2**64)


def shingles(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle.

    A-Z in lower case; words are cut at blank, tab and line signs (0x09-0x0D).
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    wide = min(width, len(found))
    n = len(codes) - wide + 1
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = mix(out * M1 + codes[i:i + n])
    return np.unique(out)


def _words() -> BoundedCache:
    return kept(("hashes",), lambda: BoundedCache(xxhash.xxh3_64_intdigest, 200_000))


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


@cache
def spans(p: int, q: int, top: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, parts, empty parts left out) up to size ``top``, for a similarity of p / q.

    Sets of a and b hashes with that similarity differ in at most (a + b)(q - p) / (q + p). With
    that many parts, one more, and one more for each empty part that may be left out, at least
    one part that holds something is the same in both. A set with more empty parts than usual
    sends those as well, and so does every partner that agrees with it on nothing else.
    """
    out, low = [], 1
    while low <= top:
        high = max(low, int(low * SPAN))
        differ = (high + high * q // p) * (q - p) // (q + p)
        spare = 0
        while differ:
            parts = differ + 1 + spare
            mean = parts * np.exp(-low / parts)
            term = total = float(np.exp(-mean))
            for i in range(1, spare + 1):
                term *= mean / i
                total += term
            if 1 - total < 1e-6 or spare > differ:
                break
            spare += 1
        out.append((low, high, differ + 1 + spare, spare))
        low = high + 1
    return out


def signatures(hashes: np.ndarray, p: int, q: int) -> np.ndarray:
    """Hashes of the parts of a set, for its own range of sizes and those of smaller partners."""
    n, found = len(hashes), []
    table = spans(p, q, 1 << max(4, n.bit_length()))
    least = -(-n * p // q)
    for number, (low, high, parts, spare) in enumerate(table):
        if high < least or low > n:
            continue
        own = mix(hashes + salt(number))
        part = (own >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        total, held = np.add.reduceat(mix(own[order] ^ M3), start), part[start]
        if parts - len(held) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), held)
            total, held = np.concatenate([total, np.zeros(len(empty), np.uint64)]), np.concatenate([held, empty])
        found.append(mix(total + M1 * mix(held + salt(~number))))
    return np.concatenate(found)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        parent = self.parent
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        self.parent = parent
        return parent


class SignatureTree:
    """Levels of nodes over sets (positions ``first`` and on): OR and AND of their bitmaps, and their size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int, first: int) -> None:
        self.first = first
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(7)) % np.uint64(bits)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.levels = [(maps, maps, sizes, sizes)]
        while len(self.levels[-1][2]) > FANOUT:
            union, common, low, high = self.levels[-1]
            start = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(union, start), np.bitwise_and.reduceat(common, start),
                                np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)))

    def single_roots(self, roots: np.ndarray) -> list[np.ndarray]:
        """By level: the component of all sets below a node, or -1."""
        out = [roots[self.first:self.first + len(self.levels[0][2])]]
        low = high = out[0]
        for level in self.levels[1:]:
            start = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            assert len(low) == len(level[2])
            out.append(np.where(low == high, low, -1))
        return out


def _possible(a, b, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether nodes ``i`` of level a and ``j`` of level b can hold a linked pair, by sizes and largest overlap."""
    (or_a, and_a, low_a, high_a), (or_b, and_b, low_b, high_b) = a, b
    ok = (high_a[i] * q >= low_b[j] * p) & (high_b[j] * q >= low_a[i] * p)
    out = np.zeros(len(i), bool)
    i, j, at = i[ok], j[ok], np.flatnonzero(ok)
    # Bits that all sets of one node have and none of the other: as many hashes at least are not shared.
    lost_a = np.bitwise_count(and_a[i] & ~or_b[j]).sum(1, dtype=np.int64)
    lost_b = np.bitwise_count(and_b[j] & ~or_a[i]).sum(1, dtype=np.int64)
    overlap = np.minimum(high_a[i] - lost_a, high_b[j] - lost_b)
    # A pair of sizes x, y needs overlap >= p (x + y) / (p + q); x and y are at least low, and at least the overlap.
    out[at] = overlap * (p + q) >= p * (low_a[i] + low_b[j])
    return out


def tree_links(blocks: list[list[np.ndarray]], p: int, q: int, hub: int | None = None) -> list[tuple[int, int]]:
    """Links that join the components of the sets: within one block, or between two.

    Positions count through both blocks. Only links that join two components are returned; sets
    that are in one component already are not compared again.
    """
    sets = [s for block in blocks for s in block]
    forest, links = Forest(len(sets)), []

    def verify(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        if forest.find(i) == forest.find(j):
            return
        shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
        if shared * q >= p * (len(a) + len(b) - shared) and forest.union(i, j):
            links.append((i, j))

    if hub is not None:
        for i in range(len(sets)):
            verify(i, hub)
    largest = max(map(len, sets), default=1)
    bits = 64 * min(256, max(2, 1 << (-(-2 * largest // 64) - 1).bit_length()))
    trees, first = [], 0
    for block in blocks:
        trees.append(SignatureTree(block, bits, first))
        first += len(block)
    a, b = trees[0], trees[-1]
    same = len(trees) == 1
    if len(a.levels) < len(b.levels):
        a, b = b, a
    step = max(256, PAIR_WORDS // (bits // 64))
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][2])), np.arange(len(b.levels[-1][2])), indexing="ij"))
    if same:
        i, j = i[i <= j], j[i <= j]
    stack = [(top_a, top_b, i[k:k + step], j[k:k + step]) for k in range(0, len(i), step)]
    while stack:
        la, lb, i, j = stack.pop()
        roots = forest.roots()
        root_a, root_b = a.single_roots(roots)[la][i], b.single_roots(roots)[lb][j]
        open_ = (root_a < 0) | (root_a != root_b)
        i, j = i[open_], j[open_]
        fine = _possible(a.levels[la], b.levels[lb], i, j, p, q)
        i, j = i[fine], j[fine]
        if not len(i):
            continue
        if not la and not lb:
            for x, y in zip((i + a.first).tolist(), (j + b.first).tolist(), strict=True):
                if x != y:
                    verify(x, y)
            continue
        # The side with more levels left goes down, or both.
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        if down_a:
            child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i, j, la = child, np.repeat(j, FANOUT), la - 1
        if down_b:
            child = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            j, i, lb = child, np.repeat(i, FANOUT), lb - 1
        there = (i < len(a.levels[la][2])) & (j < len(b.levels[lb][2]))
        if same:
            there &= i <= j
        i, j = i[there], j[there]
        stack += [(la, lb, i[k:k + step], j[k:k + step]) for k in range(0, len(i), step)]
    return links


def sets_of(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``doc_id, n_shingles, key, short``: a row for each row; the key is that of the set, null for an empty one."""
    def step():
        words = _words()

        def work(columns, texts):
            sizes, keys = [], []
            for t in texts:
                own = shingles(t, width, words)
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                words.trim()
            short = [short_key(k) if k else None for k in keys]
            yield [*columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(short, pa.int64())]

        return work

    return map_texts(docs, [doc_id], text, StructType([StructField("n_shingles", LongType()), StructField("key", BinaryType()), StructField("short", LongType())]), step)


def proposals(docs: DataFrame, text: str, width: int, p: int, q: int) -> DataFrame:
    """``a, b``: short keys of sets that share a part with others, and the smallest short key of all sets with this part.

    So all sets with a part are in the group of one hub, whatever batch or task they come from.
    Each task first joins the sets of a batch that share a part into a sub-group. Of a sub-group
    only the smallest key meets those of other batches, so a part that many documents share
    reaches one task once a batch; the others ask for their sub-group's hub afterwards, a batch
    at a time. None is left out: a set that links to its hub here can still be the only partner
    of a set elsewhere. A short key is the first half of a key: should two sets have one, both
    are looked at. The exchange is sorted, and read as a stream.
    """
    rows = docs.select(F.col(text).cast("string").alias("t"))

    def send(batches):
        words, seen, number = _words(), set(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                found, keys = [], []
                number += 1
                for t in batch.column(0).slice(at, 2048).to_pylist():
                    own = shingles(t, width, words)
                    words.trim()
                    if not len(own):
                        continue
                    key = short_key(set_key(own))
                    if key not in seen:
                        seen.add(key)
                        found.append(signatures(own, p, q))
                        keys.append(key)
                if len(seen) > 200_000:
                    seen.clear()
                if not found:
                    continue
                sign = np.concatenate(found).view(np.int64)
                key = np.repeat(np.array(keys, np.int64), list(map(len, found)))
                order = np.lexsort((key, sign))
                sign, key = sign[order], key[order]
                new = np.r_[True, sign[1:] != sign[:-1]]
                hub = key[np.maximum.accumulate(np.where(new, np.arange(len(sign)), 0))]
                # Sub-groups of two and more have a number. Their smallest key travels by the part, the others by the number.
                sub = mix(sign.view(np.uint64) + M1 * mix(salt(task) ^ np.uint64(number))).view(np.int64)
                smallest = key == hub
                run = np.flatnonzero(new)
                shared = np.logical_or.reduceat(~smallest, run)[np.cumsum(new) - 1]
                # Rows of a set side by side take less room in the exchange, which sorts them anyway.
                order = np.argsort(key, kind="stable")
                sign, sub, key, smallest, shared = (x[order] for x in (sign, sub, key, smallest, shared))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(smallest, sign, sub)), pa.array(key), pa.array(np.where(shared, sub, 0))], names=["s", "k", "g"])

    def meet(batches):
        """``a, b, g``: a pair; with a null ``b``, one that asks for the hub of ``g``; with a null ``a``, the hub of ``g``."""
        last_sign, last_hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sign, key, group = (c.to_numpy() for c in batch.columns)
            new = np.r_[True, sign[1:] != sign[:-1]]
            smallest = key[np.maximum.accumulate(np.where(new, np.arange(len(sign)), 0))]
            if last_sign is not None and sign[0] == last_sign:
                run = len(sign) if new[1:].sum() == 0 else int(np.flatnonzero(new[1:])[0]) + 1
                smallest = smallest.copy()
                smallest[:run] = last_hub
            last_sign, last_hub = sign[-1], smallest[-1]
            asks = sign == group
            names = ~asks & (group != 0)
            pairs = np.unique(np.stack([key, smallest], 1)[(key != smallest) & ~asks], axis=0)
            a = pa.array(np.r_[pairs[:, 0], key[asks], key[names]], mask=np.r_[np.zeros(len(pairs) + asks.sum(), bool), np.ones(names.sum(), bool)])
            b = pa.array(np.r_[pairs[:, 1], key[asks], smallest[names]], mask=np.r_[np.zeros(len(pairs), bool), np.ones(asks.sum(), bool), np.zeros(names.sum(), bool)])
            g = pa.array(np.r_[np.zeros(len(pairs), np.int64), group[asks], group[names]])
            if len(g):
                yield pa.RecordBatch.from_arrays([a, b, g], names=["a", "b", "g"])

    sent = rows.mapInArrow(send, "s long, k long, g long")
    met = materialize(sent.repartition("s").sortWithinPartitions("s", "k").mapInArrow(meet, "a long, b long, g long"), "met")
    asked = met.filter(F.col("b").isNull()).select("a", "g").join(met.filter(F.col("a").isNull()).select("b", "g"), "g")
    pairs = met.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    return pairs.unionByName(asked.select("a", "b")).filter("a != b").distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, p: int = 9, q: int = 10,
                       block_sets: int = BLOCK_SETS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """``doc_id, n_shingles long, component_id`` of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of distinct ``width``-word
    shingles is at least p / q; texts with fewer words are one shingle. ``component_id`` is the
    smallest id that links lead to. Null texts and texts without words are empty and linked with
    nothing. Repeated rows are documents each. A row with a null id takes part; its component is
    named by the others', or null. An empty table gives no rows.
    """
    found = materialize(sets_of(docs, doc_id, text, width), "sets")
    nodes = materialize(found.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(doc_id).alias("least"), F.max("n_shingles").alias("n"), F.first("short").alias("short")), "nodes")
    pairs = materialize(proposals(docs, text, width, p, q), "proposals")
    members = pairs.select(F.col("b").alias("hub"), F.col("a").alias("short")).unionByName(
        pairs.select(F.col("b").alias("hub"), F.col("b").alias("short"))).distinct()
    members = materialize(members.join(nodes, "short").select("hub", "short", "key", "least", "n"), "members")
    links = _links(members, docs, doc_id, text, width, p, q, block_sets, block_hashes)
    roots = components(links)
    # Names of the components: the smallest id of all their sets.
    named = nodes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key")
    names = named.groupBy("root").agg(F.min("least").alias("name"))
    joined = named.join(names, "root").select(F.col("key").alias("own"), "name")
    alone = nodes.select(F.col("key").alias("one"), "least")
    by_key = alone.join(joined, F.col("one") == F.col("own"), "left").select("one", F.coalesce("name", "least").alias("component_id"))
    return found.join(by_key, F.col("key") == F.col("one"), "left").select(
        doc_id, "n_shingles", F.when(F.col("key").isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"))


def _links(members: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, p: int, q: int, block_sets: int, block_hashes: int) -> DataFrame:
    """``a, b``: keys of linked sets, enough to join the components of every group."""
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / block_sets), F.ceil(F.col("w") / block_hashes)).cast("int").alias("blocks")
    placed = members.join(sizes.select("hub", blocks), "hub").select(
        "hub", "key", "least", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
        (F.col("short") == F.col("hub")).alias("is_hub"))
    # Of every set one document's text; ids may be null or met with other texts, so the keys are compared again.
    wanted = placed.select(F.col("least").alias("i")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t"))
    texts = texts.join(F.broadcast(wanted.withColumnRenamed("i", "w")) if few else wanted.withColumnRenamed("i", "w"),
                       texts["i"].eqNullSafe(F.col("w")), "left_semi")

    def keyed(batches):
        words, squeeze = _words(), zstandard.ZstdCompressor(level=3)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            for t in batch.column(0).to_pylist():
                own = shingles(t, width, words)
                words.trim()
                if len(own):
                    out.append((set_key(own), squeeze.compress(t.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([t for _, t in out], pa.binary())], names=["k", "t"])

    # Texts travel compressed; sorted hashes of their shingles would take more room.
    by_key = texts.select("t").mapInArrow(keyed, "k binary, t binary").groupBy("k").agg(F.min("t").alias("t"))
    # A block meets itself and every other block of its group; the hub goes to all of them.
    one = F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    sent = placed.withColumn("block", F.explode(one)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "hub", "key", "is_hub", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    full = sent.join(by_key, F.col("key") == F.col("k")).select("hub", "x", "y", "block", "is_hub", "key", "t")

    def link(group: pa.Table) -> pa.Table:
        rows = group.select(["key", "block", "is_hub", "t"]).to_pylist()
        words, own, spread = _words(), {}, zstandard.ZstdDecompressor()
        for r in rows:
            if r["key"] not in own:
                text = spread.decompress(r["t"]).decode("utf-8", "surrogatepass")
                own[r["key"]] = r["block"], r["is_hub"], shingles(text, width, words)
            words.trim()
        numbers = sorted({b for b, _, _ in own.values()})
        blocks, keys = [], []
        for number in numbers:
            # Neighbours in this order are likely alike, which keeps the nodes of the tree narrow.
            part = sorted((int(s[0]), len(s), k) for k, (b, _, s) in own.items() if b == number)
            blocks.append([own[k][2] for _, _, k in part])
            keys += [k for _, _, k in part]
        hub = next((i for i, k in enumerate(keys) if own[k][1]), None)
        found = tree_links(blocks, p, q, hub)
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})

    return full.groupBy("hub", "x", "y").applyInArrow(link, "a binary, b binary")
