"""N-gram Jaccard join: exact links between shingle sets, and the components they form.

1. Sets. A text's words make its set of k-word shingles, as 64-bit hashes. Texts of equal sets are one
   node from here on; the join is between different sets.
2. Clusters. Sets of similarity t differ in at most d = (1-t)/(1+t) * (a+b) shingles. The hash range is cut
   into K > d parts, so a linked pair agrees wholly on some part. A node's signatures are the digests of
   its parts, K following from its size range; nodes that share one, directly or over others, are a
   cluster. A passage or word that many texts share makes few: a whole part must agree. Parts of one or two
   shingles still join clusters over passages that many texts share, the larger the more texts there are; so all
   are divided by prefixes: linked sets of n shingles share one of their n - ceil(t * n) + 1 rarest, rarity being
   counted within clusters. Each node is in one of what is left at most, so its set is shipped once.
3. Signature trees. Each cluster is joined by a tree over its members, ordered by size, that holds OR-combined
   bitmaps of shingles and size ranges: a dual traversal drops pairs of tree nodes whose greatest possible
   overlap is too small, and what is left is verified exactly, likely pairs first, until all that links is
   joined. A cluster of more than a block's members or shingles is cut into blocks by size: trees inside each
   block first, then of neighbouring blocks; if it is still in several components, members outside the
   largest one are searched in each block whose summary (the tree's root) allows a link.
4. Components by repeated min-label contraction; copies get their node's component.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected
from ..plans.storage import discard
from .bpe import Memo
from .common import map_texts, table, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Growth of size ranges, bitmap words, and what a block of a tree holds at most on average: members, shingles.
RANGE, BITS, BLOCK, BLOCK_SHINGLES = 1.3, 16, 512, 1 << 20
#: Pairs of tree nodes whose bitmaps a traversal compares at a time: 128 bytes a side each.
PORTION = 1 << 14
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, k: int):
        self.k, self.held = k, Memo(100_000)

    def _word(self, word: bytes) -> int:
        h = self.held.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            self.held.put(word, h)
        return h

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; fewer than k words make one shingle, no word an empty set."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        young, word = self.held.young, self._word
        h = np.array([young.get(w) or word(w) for w in words], np.uint64)
        n = max(len(words) - self.k + 1, 1)
        out = np.full(n, len(words) if len(words) < self.k else self.k, np.uint64)
        for j in range(min(self.k, len(words))):
            out = mix(out * MIX[0] + h[j : j + n])
        return np.unique(out)


def difference(t: tuple[int, int], total: int) -> int:
    """The most shingles in which linked sets of this total size differ: total - 2 * ceil(t / (1+t) * total),
    for t = p/q in whole numbers."""
    p, q = t
    return total - 2 * -(-p * total // (p + q))


def size_ranges(n: int, t: tuple[int, int]) -> list[int]:
    """The size ranges in which a set of n takes part: its own as the smaller, and those whose sets it
    may be the larger partner of."""
    p, q = t
    own = _range_of(n)
    low = -(-n * p // q)
    return list(range(_range_of(low), own + 1))


def _range_of(n: int) -> int:
    return int(math.log(n) / math.log(RANGE) + 1e-9)


@functools.cache
def plan(r: int, t: tuple[int, int]) -> tuple[int, int, int]:
    """(d, parts, empty parts allowed) of size range r: d is the most that linked sets of it differ in; the parts
    exceed d by one and by the empty parts allowed, so that some part agrees and is not empty."""
    p, q = t
    low, top = RANGE**r, math.ceil(RANGE ** (r + 1))
    total = top + top * q // p
    d = max(difference(t, total), difference(t, total - 1))
    k = d + 2
    for _ in range(4):
        empty = k * math.exp(-low / k)
        spare = math.ceil(empty + 4 * math.sqrt(empty))
        k = d + 1 + spare
    return d, k, spare


def signatures(hashes: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """A set's signatures: digests of its parts that aren't empty; of a small set, which may differ by two
    shingles at most, digests of the whole and of what one or two shingles less leave."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    mixed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for r in size_ranges(n, t):
        d, k, spare = plan(r, t)
        salt = np.uint64((2 * r + 1) * int(MIX[0]) & (1 << 64) - 1)
        if d <= 2:
            whole = mixed.sum(dtype=np.uint64)
            less = [np.array([whole]), whole - mixed]
            if d == 2:
                i, j = np.triu_indices(n, 1)
                less.append(whole - mixed[i] - mixed[j])
            out.append(mix(np.concatenate(less) + salt))
            continue
        part = ((hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sums = np.add.reduceat(mixed, starts)
        out.append(mix(mix(sums + part[starts].astype(np.uint64)) + salt))
        if k - len(starts) > spare:
            # So many empty parts that a partner may agree on these alone: such sets form a group.
            out.append(mix(np.array([r], np.uint64) + MIX[1]))
    return np.unique(np.concatenate(out))


def bitmap(hashes: np.ndarray) -> list[int]:
    words = np.zeros(BITS, np.uint64)
    at = (hashes & np.uint64(BITS * 64 - 1)).astype(np.int64)
    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return words.view(np.int64).tolist()


def profiles(docs: DataFrame, keep: list[str], k: int, t: tuple[int, int], text: str = "text") -> DataFrame:
    """``keep`` with n_shingles, node (a digest of the set; null for an empty one), check (a second one),
    and the set's signatures. Of rows of one node that a task meets the first alone has signatures, mostly:
    many copies give few."""

    def make():
        own, met = Shingler(k), Memo(50_000)

        def run(texts):
            rows = []
            for text in texts:
                h = own.sets(text)
                if len(h):
                    node, check = int(mix(h).sum(dtype=np.uint64)), int(mix(h + MIX[2]).sum(dtype=np.uint64))
                    again = met.get(node)
                    met.put(node, True)
                    rows.append((len(h), _signed(node), _signed(check), [] if again else signatures(h, t).view(np.int64)))
                else:
                    rows.append((0, None, None, []))
            return list(zip(*rows, strict=True))

        return run

    return map_texts(docs, keep, text, "n_shingles long, node long, check long, signatures array<long>", make)


def prefixes(sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(sig, node): of each set of n shingles those of its n - ceil(t * n) + 1 rarest that other sets hold, too. Any
    two sets that link share one, since they have t * n of the larger's n in common. ``sets``: node, n_shingles, shingles.

    A shingle counts by its upper 40 bits. Any order that all sets share would do; this one is by the rows of
    a batch in which the shingle lies. The first and the last of a batch, which may go on in another, are the most
    frequent ones: what lies in several batches is one of these in each."""
    p, q = t

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node = (batch.column(i).to_numpy() for i in (0, 1))
            begins = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            length = np.diff(np.append(begins, len(sig)))
            held = length.astype(np.int32)
            held[[0, -1]] = np.iinfo(np.int32).max
            held = np.repeat(held, length)
            own = held > 1
            yield pa.RecordBatch.from_arrays([pa.array(sig[own]), pa.array(node[own]), pa.array(held[own])], names=["sig", "node", "held"])

    marks = sets.select(F.explode("shingles").alias("_x"), "node").select(F.shiftright("_x", 24).alias("sig"), "node")
    shared = marks.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, node long, held int")
    rows = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "sig"))).alias("_s")).join(sets.select("node", "n_shingles").distinct(), "node")
    # Shingles that no other set holds are the rarest.
    left = F.expr(f"cast(size(_s) - ({p} * n_shingles + {q - 1}) div {q} + 1 as int)")
    return rows.filter(left > 0).select("node", F.explode(F.slice("_s", F.lit(1), left)).alias("_s")).select("_s.sig", "node")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_sets(docs: DataFrame, keep: list[str], k: int, text: str = "text") -> DataFrame:
    """``keep`` with the shingles and bitmap of the texts; of equal sets that a task meets the first alone is
    there, mostly."""

    def make():
        own, met = Shingler(k), Memo(50_000)

        def run(texts):
            out = []
            for x in texts:
                h = own.sets(x)
                node = int(mix(h).sum(dtype=np.uint64))
                again = met.get(node)
                met.put(node, True)
                out.append((None, None) if again else (h.view(np.int64), bitmap(h)))
            return list(zip(*out, strict=True))

        return run

    return map_texts(docs, keep, text, "shingles array<long>, bits array<long>", make).filter("shingles is not null")


def meetings(marks: DataFrame, chain: bool = False) -> DataFrame:
    """(sig, a, b): pairs of nodes that hold one signature, enough to join all of its nodes; ``marks``: sig, node.

    Rows are dealt in the order of both, so a signature that very many nodes hold lies in many tasks; each
    task links a signature's first node there with the others (or, as a ``chain``, each with the next), and
    what stands at tasks' ends is linked afterwards."""

    def run(batches):
        first = last = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node = (batch.column(i).to_numpy() for i in (0, 1))
            first = (sig[0], node[0]) if first is None else first
            if last is not None:
                sig, node = np.append(last[0], sig), np.append(last[1], node)
            begins = np.append(True, sig[1:] != sig[:-1])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))
            heads = node[at]
            if head is not None:
                heads[at == 0] = head  # the signature of the batch before goes on
            last, head = (sig[-1], node[-1]), heads[-1]
            near = node[:-1] if chain else heads[1:]
            own = np.flatnonzero(~begins[1:] & (node[1:] != near))
            yield pa.RecordBatch.from_arrays([pa.array(sig[1:][own]), pa.array(near[own]), pa.array(node[1:][own])], names=["sig", "a", "b"])
        if first is not None:
            ends = [np.array([x[i] for x in (first, last)]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.nulls(2, pa.int64())], names=["sig", "a", "b"])

    dealt = marks.select("sig", "node").repartitionByRange("sig", "node").sortWithinPartitions("sig", "node")
    found = written(dealt.mapInArrow(run, "sig long, a long, b long"), "meetings")
    ends = found.filter("b is null").select("sig", F.col("a").alias("b")).distinct()
    across = ends.join(ends.groupBy("sig").agg(F.min("b").alias("a")), "sig").filter("a <> b").select("sig", "a", "b")
    return found.filter("b is not null").unionByName(across)


class Tree:
    """A binary tree over members ordered by size. Each level has, for its nodes, the least and greatest
    size, the OR of bitmaps, the component (if one), whether there are several, and the fewest bits."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.drop_duplicates("node").sort_values(["n_shingles", "node"])
        self.node = frame["node"].to_numpy()
        self.size = frame["n_shingles"].to_numpy()
        self.root = frame["root"].to_numpy()
        self.shingles = frame["shingles"].to_list()
        bits = np.array(frame["bits"].tolist(), np.int64).view(np.uint64).reshape(len(frame), -1)
        width = 1 << max(len(frame) - 1, 0).bit_length()
        self.levels = [self._padded(width, bits)]
        while len(self.levels[-1][0]) > 1:
            low, high, union, same, mixed, bits = self.levels[-1]
            self.levels.append((
                np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), union[::2] | union[1::2],
                np.where(high[1::2] > 0, np.where(same[::2] == same[1::2], same[::2], 0), same[::2]),
                mixed[::2] | mixed[1::2] | ((high[1::2] > 0) & (same[::2] != same[1::2])),
                np.minimum(bits[::2], bits[1::2]),
            ))

    def _padded(self, width: int, bits: np.ndarray):
        n, big = len(self.size), np.iinfo(np.int64).max
        low, high = np.full(width, big), np.zeros(width, np.int64)
        union, same = np.zeros((width, bits.shape[1]), np.uint64), np.zeros(width, np.int64)
        low[:n], high[:n], union[:n], same[:n] = self.size, self.size, bits, self.root
        least = np.full(width, big)
        least[:n] = np.bitwise_count(bits).sum(1)
        return low, high, union, same, np.zeros(width, bool), least


def dual_traversal(x: Tree, y: Tree, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Members (i of x, j of y) of different components whose sizes and bitmaps allow a link.

    A pair of tree nodes is dropped if even its best sizes can't link, if all its members are in one
    component, or if too many bits that one side's members must set are missing in the other."""
    p, q = t
    depth = max(len(x.levels), len(y.levels)) - 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    waiting = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > PORTION:
            # The first portion goes down to the leaves before the next one begins.
            waiting += [(level, i[k : k + PORTION], j[k : k + PORTION]) for k in range(0, len(i), PORTION)][::-1]
            continue
        lx, ly = x.levels[min(level, len(x.levels) - 1)], y.levels[min(level, len(y.levels) - 1)]
        can = (lx[1][i] > 0) & (ly[1][j] > 0)
        can &= (q * lx[1][i] >= p * ly[0][j]) & (q * ly[1][j] >= p * lx[0][i])
        can &= lx[4][i] | ly[4][j] | (lx[3][i] != ly[3][j])
        i, j = i[can], j[can]
        if not len(i):
            continue
        if level == 0:
            # Leaves: bits set in one alone are shingles of one alone.
            alone = np.bitwise_count(lx[2][i] ^ ly[2][j]).sum(1)
            total = lx[0][i] + ly[0][j]
            can = alone <= total - 2 * -(-p * total // (p + q))
            found.append((i[can], j[can]))
            continue
        # Inner nodes: a member sets some least number of bits; those beyond the bits common to both
        # unions belong to shingles that the other side lacks.
        common = np.bitwise_count(lx[2][i] & ly[2][j]).sum(1)
        most = np.minimum(lx[1][i] - np.maximum(lx[5][i] - common, 0), ly[1][j] - np.maximum(ly[5][j] - common, 0))
        can = (p + q) * most >= p * (lx[0][i] + ly[0][j])
        i, j = i[can], j[can]
        step_x, step_y = level <= len(x.levels) - 1, level <= len(y.levels) - 1
        i = np.repeat(i, 4) * 2 + np.tile([0, 0, 1, 1], len(i)) if step_x else np.repeat(i, 4)
        j = np.repeat(j, 4) * 2 + np.tile([0, 1, 0, 1], len(j)) if step_y else np.repeat(j, 4)
        if len(i) and not (step_x and step_y):
            i, j = np.unique(np.stack([i, j]), axis=1)
        waiting.append((level - 1, i, j))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _tree_links(t: tuple[int, int]):
    """Verified links between different components among the members of one block or two, enough to join
    what they join: a pair whose ends are together already is passed over, likely pairs come first."""
    p, q = t

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = frame["side"].to_numpy()
        x = Tree(frame[sides == 0] if (sides == 0).any() else frame)
        y = x if not (sides == 1).any() else Tree(frame[sides == 1])
        i, j = dual_traversal(x, y, t)
        cuts = range(0, len(i), PORTION)
        apart = [np.bitwise_count(x.levels[0][2][i[c : c + PORTION]] ^ y.levels[0][2][j[c : c + PORTION]]).sum(1) for c in cuts]
        apart = np.concatenate([np.zeros(0, np.uint64), *apart])
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        out = []
        for k in np.argsort(apart, kind="stable").tolist():
            a, b = find(int(x.root[i[k]])), find(int(y.root[j[k]]))
            if a == b:
                continue
            one, other = x.shingles[i[k]], y.shingles[j[k]]
            both = len(np.intersect1d(one, other, assume_unique=True))
            if q * both >= p * (len(one) + len(other) - both):
                parent[a] = b
                out.append((x.node[i[k]], y.node[j[k]]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def linked(docs: DataFrame, id_col: str, k: int, t: tuple[int, int], text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): _id, _hash (of the text), n_shingles and node of each row, and for each node its root (that of
    its component), the least id in the component and _first, the row (whether its id is null, _id, _hash)
    that comes first in it."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).withColumn("_hash", F.xxhash64("_t"))
    profiled = written(profiles(base, ["_id", "_hash"], k, t, "_t"), "profiles")
    rows = written(profiled.drop("signatures"), "rows")
    # Copies become one node here, before anything is compared; each node keeps one row's place.
    nodes = written(rows.filter("node is not null").groupBy("node").agg(
        F.min("check").alias("_c"), F.max("check").alias("_d"), F.min("n_shingles").alias("n_shingles"),
        F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")).alias("_first"),
    ), "nodes")
    if nodes.filter("_c <> _d").limit(1).count():
        raise ValueError("two sets share a 64-bit digest; change the constants in MIX")
    met = meetings(profiled.select(F.explode("signatures").alias("sig"), "node"))
    discard(profiled)
    clusters = connected(met.select("a", "b"))
    wanted = written(clusters.select("node").join(nodes.select("node", "_first"), "node"), "wanted")
    few = wanted.count() <= 400_000  # 44 bytes each: what is broadcast stays under 18 MB
    keyed = wanted.select("node", F.col("_first._id").alias("_i"), F.col("_first._hash").alias("_h"))
    texts = base.join(F.broadcast(keyed) if few else keyed, base["_id"].eqNullSafe(keyed["_i"]) & (base["_hash"] == keyed["_h"]))
    sets = written(shingle_sets(texts.select("node", "_t"), ["node"], k, "_t").withColumn("n_shingles", F.size("shingles").cast("long")), "sets")
    finer = connected(meetings(prefixes(sets, t)).select("a", "b")).withColumnRenamed("root", "cluster")
    finer = written(placed(finer.join(nodes.select("node", "n_shingles"), "node")).select("node", "cluster", "block"), "finer")
    few = finer.count() <= 1_000_000  # 24 bytes each
    sets = sets.join(F.broadcast(finer) if few else finer, "node")
    many = finer.filter("block <> 0")

    alone = sets.withColumns({"root": F.col("node"), "side": F.lit(0)})
    # A search takes far more time than its rows' bytes tell, so tasks aren't merged by these.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = written(alone.repartition(tasks, "cluster", "block").groupBy("cluster", "block").applyInPandas(_tree_links(t), "a long, b long"), "links")
    roots = connected(links)
    for neighbours in (True, False) if many.limit(1).count() else ():
        # Clusters of several blocks: neighbouring ones first; what is still apart is searched in full.
        pairs = _across(sets, many, roots, t, neighbours).repartition(tasks, "cluster", "bx", "by")
        more = written(pairs.groupBy("cluster", "bx", "by").applyInPandas(_tree_links(t), "a long, b long"), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = connected(links)
    labels = nodes.select("node", "_first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Most nodes are alone: only the others' components are gathered.
    shared = labels.groupBy("root").agg(F.min("_first").alias("_first"))
    return rows, written(labels.select("node", "root").join(shared, "root"), "labels")


def placed(members: DataFrame) -> DataFrame:
    """``members`` (cluster, node, n_shingles) with block: 0 where a cluster fits one, else size range << 32 | number,
    from 1 << 32 on, with so many numbers in a range that BLOCK and BLOCK_SHINGLES hold on average."""
    whole = members.groupBy("cluster").agg(F.count("*").alias("_m"), F.sum("n_shingles").alias("_s"))
    large = whole.filter((F.col("_m") > BLOCK) | (F.col("_s") > BLOCK_SHINGLES)).select("cluster")
    level = (F.floor(F.log("n_shingles") / math.log(1.1)) + 1).cast("long")
    ranges = members.join(large, "cluster", "left_semi").groupBy("cluster", level.alias("_r")).agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("_k")
    )
    out = members.withColumn("_r", level).join(ranges, ["cluster", "_r"], "left")
    number = F.shiftleft("_r", 32) + F.pmod(F.xxhash64("node"), F.col("_k"))
    return out.withColumn("block", F.coalesce(number, F.lit(0).cast("long"))).drop("_r", "_k")


def _across(sets: DataFrame, many: DataFrame, roots: DataFrame, t: tuple[int, int], neighbours: bool) -> DataFrame:
    """Members that may link across blocks, in clusters that aren't one component yet: pairs of neighbouring blocks, or
    blocks with those members outside the largest component that the root of the block's tree allows."""
    p, q = t
    here = many.select("cluster", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = here.groupBy("cluster").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y").select("cluster")
    own = sets.filter("block <> 0").join(apart, "cluster", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = ["node", "root", "n_shingles", "bits", "shingles"]
    if neighbours:
        blocks = own.select(F.col("cluster").alias("sig"), F.col("block").alias("node")).distinct()
        pairs = meetings(blocks, chain=True).select(F.col("sig").alias("cluster"), F.least("a", "b").alias("bx"), F.greatest("a", "b").alias("by"))
        pairs = written(pairs.distinct(), "pairs")
        sides = pairs.select("cluster", "bx", "by", F.col("bx").alias("block"), F.lit(0).alias("side")).unionByName(pairs.select("cluster", "bx", "by", F.col("by").alias("block"), F.lit(1).alias("side")))
        return own.join(sides, ["cluster", "block"]).select("cluster", "bx", "by", "side", *held)
    # Two members of a cluster's largest component needn't meet: those outside it are taken to all blocks.
    largest = own.groupBy("cluster", "root").agg(F.count("*").alias("_n")).groupBy("cluster").agg(F.max_by("root", F.struct("_n", "root")).alias("_top"))
    some = own.join(largest, "cluster").filter("root <> _top").select("cluster", *held)
    parts = some.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("_k"))
    tops = own.groupBy("cluster", F.col("block").alias("bx")).agg(
        F.min("n_shingles").alias("_low"), F.max("n_shingles").alias("_high"), F.array(*[F.bit_or(F.get("bits", i)) for i in range(BITS)]).alias("_union")
    )
    tops = written(tops, "tops")
    ones = F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))
    common = F.aggregate(F.zip_with("bits", "_union", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, c: n + c)
    n = F.col("n_shingles")
    most = F.least(n - F.greatest(ones - common, F.lit(0)), F.col("_high"))
    can = (q * F.col("_high") >= p * n) & (q * n >= p * F.col("_low")) & ((p + q) * most >= p * (n + F.col("_low")))
    asked = some.join(parts, "cluster").withColumn("by", F.pmod(F.xxhash64("node"), F.col("_k")))
    asked = asked.join(tops, "cluster").filter(can).select("cluster", "bx", "by", F.lit(1).alias("side"), *held)
    met = written(asked.select("cluster", "bx", "by").distinct(), "pairs").withColumnRenamed("bx", "block")
    return own.join(met, ["cluster", "block"]).select("cluster", F.col("block").alias("bx"), "by", F.lit(0).alias("side"), *held).unionByName(asked)


def link_components(docs: DataFrame, id_col: str = "doc_id", k: int = 3, t: tuple[int, int] = (9, 10), text: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id of each row: the least id that links reach, its own included.

    Rows without words have an empty set and are linked with nothing. A null id takes part in links but
    names no component: component_id is null only where no id in it is known. Rows of one id with
    different texts are nodes of their own. Empty tables give an empty result; other columns aren't read.
    """
    rows, nodes = linked(docs, id_col, k, t, text)
    some = rows.filter("node is not null").select("_id", "n_shingles", "node").join(nodes.select("node", F.col("_first._id").alias("component_id")), "node")
    none = rows.filter("node is null").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return some.select("_id", "n_shingles", "component_id").unionByName(none).withColumnRenamed("_id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", k: int = 5, t: tuple[int, int] = (4, 5), text: str = "text") -> DataFrame:
    """``docs``, all its columns, with one row of each component: that of the least id (null ids last), of its
    rows the one of the least text hash, and of rows that share id and text the one of the least hash.

    Rows without words, null texts among them, are linked with nothing and all stay. Other rows of a kept row's
    id stay or go by their own texts."""
    rows, nodes = linked(docs, id_col, k, t, text)
    some = rows.filter("node is not null").groupBy("_id", "_hash", "node").agg(F.count("*").alias("_n"))
    some = some.join(nodes.select("node", F.col("_first._id").alias("_i"), F.col("_first._hash").alias("_h")), "node")
    kept = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    fate = written(some.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), kept.alias("_kept"), "_n").filter("not _kept or _n > 1"), "fates")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), F.xxhash64(docs[text]).alias("_hash"))
    few = fate.count() <= 1_000_000  # 24 bytes each: what is broadcast stays under 24 MB
    fate = F.broadcast(fate) if few else fate
    on = whole["_id"].eqNullSafe(fate["_i"]) & (whole["_hash"] == fate["_h"])
    out = whole.join(fate, on, "left_anti").select("_row")
    again = fate.filter("_kept")
    if again.limit(1).count():
        plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        more = whole.join(again, on).groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64(*[F.col("_row")[c] for c in plain])).alias("_row"))
        out = out.unionByName(more.select("_row"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL: dict[str, str] = {}
