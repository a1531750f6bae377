"""Exact Jaccard self-join of documents on word shingles, with signature trees.

1. A scan gives each document its set's size and digest, and keys: the hash range of shingles is
   cut into m parts and a key is the hash of all the set's shingles in one part. Two sets that
   reach the threshold differ in at most d shingles, so with m > d parts some part is equal in
   both; m and d follow from the band of sizes. Parts may be empty: m has some parts to spare,
   and a set with more empty parts than that has keys for its empty parts too. So no link is lost.
   A task sends a key once that several of its documents have, however many these are.
2. Documents with the same set become one class, represented by its least id. Keys that several
   classes share make blocks; blocks with the same classes count once. Only documents in blocks
   get their sets, in a second scan that a Bloom filter of bounded size guides; no text is shuffled.
3. Each block is joined with itself by a dual traversal of its signature tree: a node holds the OR
   of the bitmaps below it, the least number of bits and the range of sizes; pairs of nodes whose
   largest possible overlap can't reach the threshold are not entered. A block gives a spanning
   forest of its plausible pairs, not the pairs.
4. Connected plausible pairs are clusters; a cluster's sets are compared exactly, by inverted lists,
   until no two classes that are still apart can be linked. Its links form a spanning forest too.
5. Components of the links, with the classes' members, are the result.

Blocks and clusters are packed into tasks by size. One that is too large for a task is cut into
parts that are joined each for itself; then one member of each tree of each part stands for it, until
that joins no more; what is still apart from the largest tree is at last compared with all parts. So
the rows that go to tasks grow with a cluster's size, not its square, unless much of it stays apart.

Null and empty texts have the empty set, which is linked with nothing, not even with other empty
sets; an empty table gives no rows. Texts of any length are taken whole, a long one as a batch of its
own. Rows with a null id have a null component and link with nothing. Rows that share an id all take
the least of their components. Columns other than doc_id and text are not looked at, whatever their
names. Hashes of shingles have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import packing
from vertexloom.llm.components import Forest, components
from vertexloom.llm.packing import Words, mix
from vertexloom.llm.prefilter import maybe
from vertexloom.llm.workspace import Workspace

#: Keys of a shard, signature bytes and shingles of sets that are compared in one task.
SHARD_KEYS, TASK_BYTES, CLUSTER_SHINGLES = 1_000_000, 4 << 20, 256_000
#: Children of a tree's node; bytes of bitmaps that are compared at once.
FANOUT, SLICE_BYTES = 16, 1 << 20
#: Pairs of nodes that are compared, and entered, at once.
PAIRS_AT_ONCE = 512


class Rule:
    """When den * |intersection| >= num * |union|, and the bands of set sizes."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        lo, self.lo, self.hi = 1, [], []
        while lo <= largest:
            hi = max(lo, -(-lo * max(3 * num, 2 * den) // (2 * num)) - 1)
            self.lo.append(lo)
            self.hi.append(hi)
            lo = hi + 1
        self.lo, self.hi = np.array(self.lo, np.int64), np.array(self.hi, np.int64)
        #: The largest size that can be linked with a size of each band, and the parts of each band.
        self.reach = self.hi * den // num
        differ = (self.hi + self.reach) * (den - num) // (den + num)
        self.spare = np.where(differ > 0, differ // 16 + 1, 0)
        self.parts = np.where(differ > 0, differ + 1 + self.spare, 0)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, side="right") - 1

    def needed(self, total: np.ndarray) -> np.ndarray:
        """The least overlap of two sets whose sizes add up to ``total``."""
        return -(-total * self.num // (self.num + self.den))

    def linked(self, overlap, total):
        return (self.num + self.den) * overlap >= self.num * total


def _keys(sets: np.ndarray, cuts: np.ndarray, docs: np.ndarray, band: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the documents ``docs`` under the parts of ``band``, and whose they are."""
    m = rule.parts[band]
    docs, band, m = docs[m > 0], band[m > 0], m[m > 0]
    if not len(docs):
        return np.zeros(0, np.uint64), docs
    base = np.cumsum(m) - m
    sizes = cuts[docs + 1] - cuts[docs]
    own = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cuts[docs], sizes)
    token = sets[at]
    part = ((token >> np.uint64(32)) * m[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    group = base[own] + part
    first = np.flatnonzero(np.diff(group, prepend=-1))
    content = np.add.reduceat(mix(token), first)
    group, of = group[first], own[first]
    empty = m - np.bincount(of, minlength=len(docs))
    sparse = empty > rule.spare[band]
    vacant = np.ones(m.sum(), bool)
    vacant[group] = False
    whose = np.repeat(np.arange(len(docs)), m)
    free = np.flatnonzero(vacant & sparse[whose])
    group, of, content = np.append(group, free), np.append(of, whose[free]), np.append(content, np.zeros(len(free), np.uint64))
    place = (band[of] << 32) + group - base[of]
    return mix(content ^ mix(place.astype(np.uint64))), docs[of]


SCANNED = "doc_id long, n_shingles long, digest binary, key long, shard long, keys binary, owners binary"


def scan(docs: DataFrame, shingle: int, rule: Rule, shards: int) -> DataFrame:
    """Rows of three kinds: (doc_id, n_shingles, digest) for each document; packed keys by shard; and
    (key, doc_id) for keys that the task has met in several documents, which go to their shard only once."""
    arrow = pa.schema({"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "key": pa.int64(), "shard": pa.int64(), "keys": pa.binary(), "owners": pa.binary()})

    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in arrow}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for chunk in packing.chunks(batches, 1):
            ids = chunk.column(0).to_pylist()
            words = Words(packing.text_bytes(chunk.column(1)), lower=True)
            sets, cuts = packing.distinct_sets(*words.shingles(shingle), len(ids))
            n = np.diff(cuts)
            digest = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield out(len(ids), doc_id=ids, n_shingles=n, digest=digest)
            # Of equal sets in the chunk the least id sends the keys.
            best: dict[bytes, int] = {}
            for i in (i for i in range(len(ids)) if n[i] and ids[i] is not None):
                j = best.setdefault(digest[i], i)
                if ids[i] < ids[j]:
                    best[digest[i]] = i
            some = np.array(sorted(best.values()), np.int64)
            band = rule.band(n[some])
            low = np.flatnonzero((band > 0) & (n[some] <= rule.reach[band - 1]))
            sent = [_keys(sets, cuts, some, band, rule), _keys(sets, cuts, some[low], band[low] - 1, rule)]
            key, of = (np.concatenate(x) for x in zip(*sent))
            # 48 bits suffice: a false match costs time, not a result.
            key &= ~np.uint64(0xFFFF)
            owner = np.array([-1 if i is None else i for i in ids], np.int64)[of]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            each, first, count = np.unique(key, return_index=True, return_counts=True)
            met = np.isin(each, known, assume_unique=True)
            here = np.repeat(met | (count > 1), count)
            yield out(int(here.sum()), doc_id=owner[here], key=packing.signed(key[here]))
            each, owner, count = each[~met], owner[first[~met]], count[~met]
            known = np.union1d(known, each[count > 1])
            rows = [(s, packing.pack_sorted(each[a]), packing.pack(owner[a])) for s, a in packing.by_shard(each, shards)]
            yield out(len(rows), shard=[r[0] for r in rows], keys=[r[1] for r in rows], owners=[r[2] for r in rows])

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def _shared(group: pa.Table) -> pa.Table:
    """The keys of a shard that several tasks or chunks have, and who sent them."""
    key = np.concatenate([packing.unpack_sorted(x) for x in group["keys"].to_pylist()])
    owner = np.concatenate([packing.unpack(x, "<i8") for x in group["owners"].to_pylist()])
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    several = same[:-1] | same[1:]
    return pa.table({"key": packing.signed(key[several]), "doc_id": owner[several]})


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """About as many bits as shingles, 128 at least; a power of two, so that halves can be folded."""
    bits = max(128, 1 << int(len(tokens) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(mix(tokens) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width, as rows of 64-bit words."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(x.reshape(-1, width), axis=0) for x in maps]).view(np.uint64)


class SignatureTree:
    """Nodes by level, leaves first: OR of bitmaps, least number of bits, range of sizes, children."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, known: np.ndarray):
        """``known``: the tree that each member is in at the beginning; nodes have the range of these too."""
        order = np.lexsort((*maps.T[:4], sizes))
        self.order = order
        ors, bits = maps[order], np.bitwise_count(maps[order]).sum(1, dtype=np.int64)
        low = high = sizes[order]
        least = most = known[order]
        self.levels, self.trees = [(ors, bits, low, high)], [(least, most)]
        while len(ors) > 1:
            first = np.arange(0, len(ors), FANOUT)
            ors, bits = np.bitwise_or.reduceat(ors, first, axis=0), np.minimum.reduceat(bits, first)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            self.levels.append((ors, bits, low, high))
            self.trees.append((least, most))

    def plausible(self, rule: Rule, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """Whether some set below node a may reach the threshold with one below node b."""
        ors, bits, low, high = self.levels[level]
        common = np.empty(len(a), np.int64)
        at_once = max(1, SLICE_BYTES // (ors.shape[1] * 8))
        for s in range(0, len(a), at_once):
            common[s : s + at_once] = np.bitwise_count(ors[a[s : s + at_once]] & ors[b[s : s + at_once]]).sum(1, dtype=np.int64)
        ok = (low[a] * rule.num <= high[b] * rule.den) & (low[b] * rule.num <= high[a] * rule.den)
        # A set of size x that has y as partner lacks at most x - needed(x + y) of its shingles there.
        for p, q in ((a, b), (b, a)):
            lack = np.maximum(high[p] - rule.needed(high[p] + np.maximum(low[q], high[p] * rule.num // rule.den)), 0) + 1
            ok &= bits[p] - common <= lack
        return ok

    def _regroup(self, root: np.ndarray) -> None:
        """The ranges of trees below nodes, when the members in order are in the trees ``root``."""
        least = most = root
        for level in range(len(self.levels)):
            self.trees[level] = (least, most)
            first = np.arange(0, len(least), FANOUT)
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)

    def pairs(self, rule: Rule, forest: Forest) -> Iterator[tuple[int, int]]:
        """The plausible pairs of members that are still apart, by a dual traversal from the root;
        node pairs whose members are all in one tree of ``forest`` by now are not entered. Node pairs
        wait unexpanded, so that those in memory are as many as a few expansions give, not as there are."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        parts = forest.parts
        while stack and forest.parts > 1:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                stack.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
                a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
            if forest.parts < parts:
                parts = forest.parts
                self._regroup(forest.roots()[self.order])
            least, most = self.trees[level]
            apart = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
            a, b = a[apart], b[apart]
            ok = self.plausible(rule, a, b, level) | (a == b)
            a, b = a[ok], b[ok]
            if level == 0:
                for i, j in zip(self.order[a].tolist(), self.order[b].tolist()):
                    if i != j and forest.find(i) != forest.find(j):
                        yield i, j
                continue
            width = len(self.levels[level - 1][0])
            x = (a[:, None] * FANOUT + np.arange(FANOUT)).repeat(FANOUT, 1).ravel()
            y = np.tile(b[:, None] * FANOUT + np.arange(FANOUT), FANOUT).ravel()
            keep = (x < width) & (y < width) & (x <= y)
            stack.append((level - 1, x[keep], y[keep]))


class _Members:
    """The members of a block within the forest of all ids of a task."""

    def __init__(self, forest: Forest, at: np.ndarray):
        self.forest, self.at = forest, at.tolist()
        self.parts = len({forest.find(i) for i in self.at})

    def find(self, i: int) -> int:
        return self.forest.find(self.at[i])

    def union(self, i: int, j: int) -> None:
        self.parts -= self.forest.union(self.at[i], self.at[j])

    def roots(self) -> np.ndarray:
        return self.forest.roots()[self.at]


def _known_trees(group: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, Forest]:
    """The ids of a task, the place of each row's among them, and the trees that they are in already."""
    ids, at, place = np.unique(group["id"].to_numpy()[order], return_index=True, return_inverse=True)
    _, first, tree = np.unique(group["component"].to_numpy()[order][at], return_index=True, return_inverse=True)
    forest = Forest(len(ids))
    forest.up = first[tree]
    return ids, place, forest


def _star_links(ids: np.ndarray, forest: Forest) -> pa.Table:
    """A link from each id to the least one of its tree: the same links from whichever task."""
    roots = forest.roots()
    apart = np.flatnonzero(roots != np.arange(len(ids)))
    return pa.table({"a": ids[apart], "b": ids[roots[apart]]})


def _blocks_of(group: pa.Table) -> tuple[np.ndarray, list[int]]:
    """The rows of a task in the order of their blocks, and where each begins (and the end)."""
    key = group["block"].to_numpy()
    order = np.argsort(key, kind="stable")
    return order, [0, *(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]


def _plausible_links(rule: Rule):
    """Plausible pairs; one forest for all blocks of the task, as connected ones need no second link."""

    def run(group: pa.Table) -> pa.Table:
        order, cut = _blocks_of(group)
        ids, place, forest = _known_trees(group, order)
        sizes = group["n_shingles"].to_numpy()[order]
        maps = group["bitmap"].take(pa.array(order)).to_pylist()
        for a, b in zip(cut, cut[1:]):
            members = _Members(forest, place[a:b])
            if members.parts > 1:
                known = np.array([members.find(i) for i in range(b - a)])
                tree = SignatureTree(_folded([np.frombuffer(m, np.uint8) for m in maps[a:b]]), sizes[a:b], known)
                for i, j in tree.pairs(rule, members):
                    members.union(i, j)
        return _star_links(ids, forest)

    return run


def _overlap_links(forest: Forest, at: list[int], sets: list[np.ndarray], rule: Rule) -> None:
    """Join in ``forest`` all places of ``at`` whose sets exact links connect, by inverted lists. Of two
    sets in different trees one at least is not in the largest tree, so its members look for none."""
    n, root = len(sets), [forest.find(i) for i in at]
    trees, tree, count = np.unique(root, return_inverse=True, return_counts=True)
    parts = len(trees)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    ends = np.flatnonzero(np.append(flat[order][1:] != flat[order][:-1], True)) + 1
    begin = np.concatenate([[0], ends[:-1]])
    listed = owner[order]
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.repeat(np.arange(len(ends)), ends - begin)
    first = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(tree != count.argmax()).tolist():
        if parts == 1:
            break
        mine = rank[first[i] : first[i] + sizes[i]]
        count = ends[mine] - begin[mine]
        where = np.arange(count.sum()) + np.repeat(begin[mine] - (np.cumsum(count) - count), count)
        overlap = np.bincount(listed[where], minlength=n)
        for j in np.flatnonzero(rule.linked(overlap, sizes + sizes[i])).tolist():
            parts -= forest.union(at[i], at[j])


def _exact_links(rule: Rule):
    def run(group: pa.Table) -> pa.Table:
        order, cut = _blocks_of(group)
        ids, place, forest = _known_trees(group, order)
        packed = group["tokens"].take(pa.array(order)).to_pylist()
        for a, b in zip(cut, cut[1:]):
            _overlap_links(forest, place[a:b].tolist(), [packing.unpack_sorted(s) for s in packed[a:b]], rule)
        return _star_links(ids, forest)

    return run


LINK = "a long, b long"


def _spanning_links(work: Workspace, name: str, rows: DataFrame, sets: DataFrame, compare, limit: int) -> DataFrame:
    """Links that connect within each block of ``rows`` (block, id, weight) what ``compare`` connects, given
    the rows of ``sets`` (id, ...). A task has blocks of about ``limit`` in weight, or a part of one."""

    def met(placed: DataFrame, step: str) -> DataFrame:
        full = placed.select("task", "block", "id", "component").join(sets, "id")
        return work.save(full.groupBy("task").applyInArrow(compare, LINK), f"{name}-{step}")

    def in_parts(some: DataFrame) -> tuple[DataFrame, int]:
        """The task of each row: a block's own, or that of its part; and the most parts of a block."""
        totals = some.groupBy("block").agg(F.sum("weight").alias("total")).withColumn("grid", F.ceil(F.col("total") / F.lit(float(limit))).cast("int"))
        volume, grid = totals.agg(F.sum("total"), F.max("grid")).first()
        part = F.concat_ws("-", "block", F.pmod(F.xxhash64(F.lit(step), F.col("id")), F.col("grid")))
        shared = F.pmod(F.xxhash64("block"), F.lit(int((volume or 0) // limit) + 1)).cast("string")
        return some.join(totals, "block").withColumn("task", F.when(F.col("grid") > 1, part).otherwise(shared)), grid or 0

    step = 0
    placed, grid = in_parts(rows.withColumn("component", F.col("id")))
    links = met(placed, "0")
    if grid <= 1:
        return links
    large = work.save(placed.filter("grid > 1").select("block", "id", "weight"), f"{name}-large")
    before = None
    while True:
        known = work.save(components(links), f"{name}-known{step}")
        now = large.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        trees = now.groupBy("block", "component").agg(F.min(F.struct("id", "weight")).alias("first"), F.count("*").alias("n"))
        apart = trees.groupBy("block").agg(F.count("*").alias("trees"), F.max_by("component", F.struct("n", "component")).alias("giant")).filter("trees > 1")
        trees = work.save(trees.join(apart, "block").select("block", "component", "first.id", "first.weight", "giant"), f"{name}-trees{step}")
        left = trees.count()
        if not left:
            return links
        if before is not None and left > before // 2:
            break
        before, step = left, step + 1
        links = links.unionByName(met(in_parts(trees.select("block", "id", "weight", "component"))[0], str(step)))
    # What is not in the largest tree meets all parts; the members of that one need not meet each other.
    rest = F.col("component") != F.col("giant")
    now = work.save(now.join(trees.select("block", "giant").distinct(), "block").withColumn("rest", rest), f"{name}-now")
    half = F.lit(limit / 2)
    sums = now.groupBy("block").agg(F.ceil(F.sum(F.when(F.col("rest"), F.col("weight")).otherwise(0)) / half).cast("int").alias("r"), F.ceil(F.sum(F.when(F.col("rest"), 0).otherwise(F.col("weight"))) / half).cast("int").alias("g"))
    hashed = F.xxhash64(F.lit("part"), F.col("id"))
    placed = now.join(sums, "block").withColumn("own", F.when(F.col("rest"), F.pmod(hashed, F.col("r"))).otherwise(F.col("r") + F.pmod(hashed, F.col("g"))))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("r") + F.col("g") - 1).otherwise(F.col("r") - 1))))
    placed = placed.withColumn("task", F.concat_ws("-", "block", F.least("own", "other"), F.greatest("own", "other")))
    return links.unionByName(met(placed, "rest"))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """The set and the bitmap of each document."""
    arrow = pa.schema({"id": pa.int64(), "n_shingles": pa.int64(), "bitmap": pa.binary(), "tokens": pa.binary()})

    def run(chunk: pa.RecordBatch) -> Iterator[dict]:
        words = Words(packing.text_bytes(chunk.column(1)), lower=True)
        sets, cuts = packing.distinct_sets(*words.shingles(shingle), chunk.num_rows)
        each = [sets[a:b] for a, b in zip(cuts, cuts[1:])]
        yield {"id": chunk.column(0), "n_shingles": np.diff(cuts), "bitmap": [bitmap(s).tobytes() for s in each], "tokens": [packing.pack_sorted(s) for s in each]}

    return docs.select("doc_id", "text").mapInArrow(packing.map_chunks(run, 1, arrow), "id long, n_shingles long, bitmap binary, tokens binary")


def join(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the least id that links of
    Jaccard num / den or more reach."""
    rule, work = Rule(num, den), Workspace(docs.sparkSession, "jaccard")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About a shingle for 6 bytes, and a key for 4 * (1 - threshold) / (1 + threshold) shingles.
    shards = max(1, round(size / 6 * 4 * (den - num) / (den + num) / SHARD_KEYS))
    scanned = work.save(scan(docs, shingle, rule, shards), "scanned")
    rows = scanned.filter("digest is not null").select("doc_id", "n_shingles", "digest")
    filled = rows.filter("doc_id is not null and n_shingles > 0")
    # Written, so that both sides of the next join are plain exchanges, of which large ones can be split.
    least = work.save(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    members = work.save(filled.join(least, "digest").select("doc_id", "rep", "n_shingles").distinct(), "members")

    shared = scanned.filter("shard is not null").groupBy("shard").applyInArrow(_shared, "key long, doc_id long")
    shared = shared.unionByName(scanned.filter("key is not null").select("key", "doc_id"))
    owners = shared.distinct().join(members, "doc_id").select("key", "rep", "n_shingles").distinct()
    owners = work.save(owners, "owners")
    blocks = owners.groupBy("key").agg(F.count_distinct("rep").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("rep"))).alias("y"))
    chosen = blocks.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    owners = work.save(owners.join(chosen, "key", "left_semi"), "blocks")

    wanted = work.save(owners.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    near = maybe(docs.select("doc_id", "text"), "doc_id", wanted, wanted.count(), "wanted").filter("wanted")
    sets = work.save(_sets(near, shingle), "sets")
    in_blocks = owners.select(F.col("key").alias("block"), F.col("rep").alias("id"), (F.col("n_shingles") / 8 + 64).alias("weight"))
    plausible = _spanning_links(work, "plausible", in_blocks, sets.select("id", "n_shingles", "bitmap"), _plausible_links(rule), TASK_BYTES)
    clusters = work.save(components(plausible), "clusters")

    sizes = members.filter("doc_id = rep").groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n_shingles"))
    in_clusters = clusters.join(sizes, "id").select(F.col("component").alias("block"), "id", F.col("n_shingles").cast("double").alias("weight"))
    links = _spanning_links(work, "exact", in_clusters, sets.select("id", "tokens"), _exact_links(rule), CLUSTER_SHINGLES)
    linked = work.save(components(links), "linked")

    found = members.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return rows.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
