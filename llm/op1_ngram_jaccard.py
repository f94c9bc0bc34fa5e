"""N-gram Jaccard join by a prefix-tree join.

1. Each document's set of word n-grams is hashed; equal sets form a class of
   which the least id goes on.
2. The document frequency of every n-gram over the classes is counted exactly
   (packed exchange), which fixes the global order: rarest first, then by hash.
   An n-gram of one class only can't be shared, so just its number is kept.
3. Two sets within the threshold share one of their first ``n - needed + 1``
   n-grams. Classes are grouped by these rare n-grams, where their sizes are near
   enough, into candidate clusters; most documents share none and leave here.
4. In a cluster the ordered sets are stored in a trie. Each set traverses it
   towards the sets that share one of its rare n-grams: sets with a common start
   share one partial overlap, and a subtree is left as soon as overlap and
   remaining lengths can't reach the bound, or it holds no such set that isn't
   already connected to the probe.
5. A cluster larger than ``block_bytes`` is dealt over blocks: first each block
   is joined with itself and the cluster's root, then every class outside the
   largest component so far is sent, in blocks, to all blocks. No link between
   components is lost, and no task holds more than two blocks.

Links are decided on whole sets in integers; equality of n-grams is that of 64-bit
hashes (56 bits of hash and the frequency within a cluster). Documents without
words or text have an empty set, no links and their own id as component; rows
with a null id have a null component. An id is one node: where rows repeat an id
with different sets, the classes of those are connected through it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import components, kernel, packed, shared, worker

PROFILE = "doc_id long, src int, n_shingles long, f1 long, f2 long"
SETS = "rep long, n long, prefix array<long>, tokens binary"
_SETS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_sets(w: kernel.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and their bounds. Shorter documents are one shingle."""
    lengths = np.diff(w.bounds)
    at = kernel.window_starts(w.bounds, size)
    hashes = kernel.windows(w.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - size + 1))
    for k in range(1, size):
        short = np.flatnonzero(lengths == k)
        if len(short):
            hashes = np.concatenate((hashes, kernel.mix(kernel.windows(w.hash, k)[w.bounds[short]] + np.uint64(k))))
            doc = np.concatenate((doc, short))
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(lengths) < 1 << 16 else doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], np.searchsorted(doc[first], np.arange(len(lengths) + 1))


def _marks(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set."""
    out = []
    for seed in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernel.mix(hashes ^ np.uint64(seed)), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, its batch, the size of its set and two marks of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, w in kernel.each_slice(batch.column("text"), fold=True):
                hashes, bounds = shingle_sets(w, size)
                rows.append((np.diff(bounds), *_marks(hashes, bounds)))
            n, f1, f2 = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("src"), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2)], names=["doc_id", "src", "n_shingles", "f1", "f2"])

    return shared.batched(docs).mapInArrow(worker.trimmed(run), PROFILE)


def _chosen(table: pa.Table, size: int, classes: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids, sets and bounds of the documents of a batch that stand for their class."""
    want = set(zip(classes.column("rep").to_pylist(), classes.column("f1").to_pylist(), strict=True))
    table = packed.sorted_batch(table)
    ids, out, lengths, at = table.column("doc_id").to_pylist(), [], [], []
    for a, b, w in kernel.each_slice(table.column("text"), fold=True):
        hashes, bounds = shingle_sets(w, size)
        f1, _ = _marks(hashes, bounds)
        for i, mark in enumerate(f1.tolist()):
            if (ids[a + i], mark) in want:
                want.discard((ids[a + i], mark))
                at.append(ids[a + i])
                out.append(hashes[bounds[i] : bounds[i + 1]])
                lengths.append(len(out[-1]))
    return at, np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def _key(hashes: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Global order as a number: frequency (above 127 its logarithm), then hash."""
    rank = np.where(df < 128, df, 120 + np.log2(np.maximum(df, 1)).astype(np.int64)).astype(np.uint64)
    return (rank << np.uint64(56)) | (hashes >> np.uint64(8))


def candidate_sets(docs: DataFrame, profile: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Classes that share a rare enough n-gram with another: their shared n-grams in global order, and those to be grouped by."""
    buckets = shared.partitions(docs.sparkSession)
    batches = shared.batched(docs)
    classes = profile.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "src")).alias("r")).select("r.src", F.col("r.doc_id").alias("rep"), "f1")

    def send(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        _, hashes, _ = _chosen(table, size, own)
        worker.trim()
        return packed.ask(key[0].as_py(), hashes.astype(np.uint32), hashes, buckets)

    def order(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        kind = np.asarray(answer.column("kind"))
        ids, hashes, bounds = _chosen(table, size, answer.filter(pa.array(kind == 0)))
        worker.trim()
        df = packed.answered(answer.filter(pa.array(kind == 1)), hashes, buckets).astype(np.int64)
        out: tuple[list, ...] = ([], [], [], [])
        for rep, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            shared_at = np.flatnonzero(df[a:b]) + a
            prefix = n - -(-num * n // den) + 1 - (n - len(shared_at))
            if prefix > 0:
                keys = np.sort(_key(hashes[shared_at], df[shared_at]))
                for to, x in zip(out, (rep, n, keys[:prefix].view(np.int64), keys.tobytes()), strict=True):
                    to.append(x)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SETS, strict=True)], schema=_SETS)

    asked = batches.groupBy("src").cogroup(classes.groupBy("src")).applyInArrow(send, packed.ASKED)
    counted = packed.answers(asked, np.uint32)
    none = F.lit(None)
    both = classes.select("src", F.lit(0).alias("kind"), "rep", "f1", none.cast("int").alias("bucket"), none.cast("binary").alias("at"), none.cast("binary").alias("n")).unionAll(
        counted.select("src", F.lit(1).alias("kind"), none.cast("long").alias("rep"), none.cast("long").alias("f1"), "bucket", "at", "n")
    )
    return batches.groupBy("src").cogroup(both.groupBy("src")).applyInArrow(order, SETS)


class SetTrie:
    """Ordered sets in a compressed trie; ``links`` yields a spanning set of links between them.

    sets: ascending keys of each; sizes: their sizes with the n-grams that no other set has. Nodes are arrays, level by level and from left to
    right, so the node of a set in a level is found by the first set below each.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], num: int, den: int) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order, self.sizes = order, np.array([sizes[i] for i in order], np.int64)
        self.num, self.den = num, den
        lengths = [len(sets[i]) for i in order]
        keys, codes = np.unique(np.concatenate([*(sets[i] for i in order), np.zeros(0, np.uint64)]), return_inverse=True)
        self.sets = np.split(codes, np.cumsum(lengths)[:-1]) if order else []
        self.own = np.zeros(len(keys), bool)  # n-grams of the set that traverses
        self.label, self.members = np.arange(len(sets)), {i: [i] for i in range(len(sets))}
        self._build()
        self._index()

    def _connect(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if len(self.members[a]) > len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(a)
        self.label[moved] = b
        self.members[b].extend(moved)

    def _index(self) -> None:
        """Of each rare n-gram by which sets are to be found, the sets in order."""
        heads = [s[: max(0, len(s) + 1 - -(-self.num * n // self.den))] for s, n in zip(self.sets, self.sizes.tolist(), strict=True)]
        lengths = np.array([len(h) for h in heads], np.int64)
        keys = np.concatenate([*heads, np.zeros(0, np.int64)])
        self.bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        order = np.argsort(keys, kind="stable")
        self.sharing = np.repeat(np.arange(len(heads)), lengths)[order]
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))
        first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        self.begin, self.end = np.repeat(first, size), np.repeat(first + size, size)

    def _near(self, p: int, before: bool) -> np.ndarray:
        """Sets of a possible size that share enough rare n-grams with set p and aren't connected to it; before: only those that come first.

        What two sets share is among their rare n-grams or among what follows those of one, which is less than a set has to share at least.
        """
        at = self.place[self.bounds[p] : self.bounds[p + 1]]
        to = at if before else self.end[at]
        found = [self.sharing[a:b] for a, b in zip(self.begin[at].tolist(), to.tolist(), strict=True) if a < b]
        if not found:
            return np.zeros(0, np.int64)
        found, shared = np.unique(np.concatenate(found), return_counts=True)
        n, many = self.sizes[p], self.sizes[found]
        most = shared + -(-self.num * np.maximum(many, n) // self.den) - 1
        good = (self.den * np.minimum(many, n) >= self.num * np.maximum(many, n)) & ((self.num + self.den) * most >= self.num * (n + many))
        return found[good & (self.label[found] != self.label[p])]

    def _build(self) -> None:
        """Of each level of nodes: the first and last set below each, its part of those sets, their least and greatest size and the most that is left of one below it."""
        self.depth = np.zeros(len(self.sets), np.int64)  # the level in which a set ends
        common = [0]
        for s, t in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(s), len(t))
            differ = np.flatnonzero(s[:k] != t[:k])
            common.append(int(differ[0]) if len(differ) else k)
        path: list[list] = []  # nodes on the way to the set before: first set, beginning and end of the part, nodes below
        top: list[tuple] = []

        def close(to: int, last: int) -> None:
            """Ends the nodes that begin at ``to`` or later."""
            while path and path[-1][1] >= to:
                first, begin, end, under = path.pop()
                (path[-1][3] if path else top).append((first, last, begin, end, under))

        for i, s in enumerate(self.sets):
            c = common[i]
            close(c, i - 1)
            if path and path[-1][2] > c:  # splits the part of the last open node
                first, begin, end, under = path.pop()
                path.append([first, begin, c, [(first, i - 1, c, end, under)]])
            if len(s) > c:
                path.append([i, c, len(s), []])
        close(0, len(self.sets) - 1)
        self.levels: list[tuple[np.ndarray, ...]] = []
        size = np.array([len(x) for x in self.sets], np.int64)
        level, d = top, 0
        while level:
            first, last, begin, end = (np.array([n[k] for n in level], np.int64) for k in range(4))
            parts = [self.sets[f][x:y] for f, x, y in zip(first.tolist(), begin.tolist(), end.tolist(), strict=True)]
            within = np.stack((first, last + 1), 1).ravel()
            pick = lambda f, v, edge: f.reduceat(np.append(v, edge), within)[::2]
            least, most, longest = pick(np.minimum, self.sizes, 0), pick(np.maximum, self.sizes, 0), pick(np.maximum, size, 0) - end
            self.levels.append((first, last, np.concatenate(parts), np.concatenate(([0], np.cumsum(end - begin))), least, most, longest))
            d += 1
            held = np.flatnonzero(size[first] == end)  # sets that end in these nodes are the first below them, with their copies
            for f, e, l in zip(first[held].tolist(), end[held].tolist(), last[held].tolist(), strict=True):
                while f <= l and size[f] == e:
                    self.depth[f] = d
                    f += 1
            level = [x for n in level for x in n[4]]

    def links(self, probes: set[int] | None = None) -> Iterator[tuple[int, int]]:
        """Links as pairs of indices into the sets given, enough of them to connect all that links connect.

        probes: if given, only pairs with one of these indices count.
        """
        num, den = self.num, self.den
        asked = range(len(self.sets)) if probes is None else [i for i, j in enumerate(self.order) if j in probes]
        for p in asked:
            near = self._near(p, probes is None)
            if not len(near):
                continue
            own, n = self.sets[p], int(self.sizes[p])
            self.own[own] = True
            overlap = np.zeros(len(near), np.int64)
            for d, (first, last, parts, bounds, least, most, longest) in enumerate(self.levels, 1):
                at = np.searchsorted(first, near, side="right") - 1
                new = np.concatenate(([True], at[1:] != at[:-1]))
                nodes, of = at[new], np.cumsum(new) - 1
                size = bounds[nodes + 1] - bounds[nodes]
                begin = np.cumsum(size) - size
                part = parts[np.arange(int(size.sum())) + np.repeat(bounds[nodes] - begin, size)]
                overlap += np.add.reduceat(self.own[part].astype(np.int64), begin)[of]
                left = len(own) - np.searchsorted(own, part[begin + size - 1], side="right")
                most_left = np.minimum(longest[nodes], left)[of] + overlap
                good = (num + den) * most_left >= num * (n + np.maximum(least[nodes], -(-num * n // den)))[of]
                good &= ((den * np.minimum(n, most[nodes]) >= num * n) & (num * least[nodes] <= den * n))[of]
                ended = self.depth[near] == d
                for i in near[ended & good & ((num + den) * overlap >= num * (n + self.sizes[near]))].tolist():
                    if self.label[i] != self.label[p]:
                        yield self.order[p], self.order[i]
                        self._connect(p, i)
                good &= ~ended & (self.label[near] != self.label[p])
                near, overlap = near[good], overlap[good]
                if not len(near):
                    break
            self.own[own] = False


def _read(table: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    return table.column("rep").to_pylist(), table.column("n").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]


def _linker(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids, sizes, sets = _read(table)
        asked = table.column("asked").to_pylist() if "asked" in table.column_names else None
        probes = {i for i, x in enumerate(asked) if x} if asked is not None else None
        found = list(SetTrie(sets, sizes, num, den).links(probes))
        if len(ids) > 1000:
            worker.trim()
        return pa.Table.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], schema=_LINKS)

    return run


def links(sets: DataFrame, num: int, den: int, block_bytes: int) -> DataFrame:
    """(u, v) between classes: links enough to connect all that links connect."""
    # sizes that can link are in one class of sizes or in two that follow each other; classes are a little wider than that takes, for rounding
    step = math.log(den / num) * 1.001 if num < den else 1e-12
    sized = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long").alias("sized")
    post = sets.select("rep", sized, F.explode("prefix").alias("key"))
    roots = post.groupBy("key", "sized").agg(F.min("rep").alias("root"), F.count("*").alias("c"))
    near = post.join(roots.filter("c > 1"), ["key", "sized"]).filter("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    above = roots.select("key", (F.col("sized") - 1).alias("sized"), F.col("root").alias("v"))
    near = near.unionByName(roots.join(above, ["key", "sized"]).select(F.col("root").alias("u"), "v"))
    cluster = components.components(near)
    placed = shared.written(sets.join(cluster.withColumnRenamed("id", "rep"), "rep").select("component", "rep", "n", "tokens"))
    mass = placed.groupBy("component").agg(F.sum(F.length("tokens") + 64).alias("b"), F.count("*").alias("c")).filter("c > 1").withColumn("k", F.ceil(F.col("b") / block_bytes).cast("int"))
    mass = shared.written(mass)
    link = _linker(num, den)
    out = placed.join(mass.filter("k = 1").select("component"), "component", "left_semi").groupBy("component").applyInArrow(link, "u long, v long")
    if mass.filter("k > 1").isEmpty():
        return out
    large = placed.join(mass.filter("k > 1").select("component", "k"), "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block")
    roots = large.filter("rep = component").select(*[c for c in large.columns if c != "block"], everywhere)
    first = shared.written(large.filter("rep <> component").unionByName(roots).groupBy("component", "block").applyInArrow(link, "u long, v long"))
    known = components.components(first).select(F.col("id").alias("rep"), F.col("component").alias("part"))
    labelled = large.join(known, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    main = labelled.groupBy("component", "part").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    rest = labelled.join(main, "component").filter("part <> main").drop("main", "part").withColumn("asked", F.lit(True))
    deal = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("k")).cast("int").alias("deal")
    probes = rest.select(*[c for c in rest.columns if c != "block"], deal, everywhere)
    deals = rest.select("component", deal).distinct()
    there = large.withColumn("asked", F.lit(False)).join(deals, "component").select(*probes.columns)
    second = probes.unionByName(there).groupBy("component", "block", "deal").applyInArrow(link, "u long, v long")
    return out.unionAll(first).unionAll(second)


def repeated(profile: DataFrame) -> DataFrame:
    """Ids of rows with different sets."""
    marks = [f(c).alias(f"{name}_{c}") for c in ("f1", "f2") for name, f in (("least", F.min), ("most", F.max))]
    ids = profile.filter("doc_id is not null").groupBy("doc_id").agg(*marks)
    return ids.filter("least_f1 <> most_f1 or least_f2 <> most_f2").select("doc_id")


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; sets link when den * intersection >= num * union."""
    profile = shared.written(profiles(docs, size))
    sets = shared.written(candidate_sets(docs, profile, size, num, den), codec="lz4")
    classes = profile.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    edges = links(sets, num, den, block_bytes)
    again = shared.written(repeated(profile))
    several = not again.isEmpty()
    if several:
        own = profile.join(again, "doc_id", "left_semi").select("doc_id", "n_shingles", "f1", "f2").distinct()
        edges = edges.unionAll(own.join(classes, ["n_shingles", "f1", "f2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    found = components.components(edges).select(F.col("id").alias("rep"), "component")
    moved = classes.join(found, "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = profile.join(moved, ["n_shingles", "f1", "f2"], "left")
    if several:  # rows without words, whose id others have as well
        nodes = again.join(found, F.col("doc_id") == F.col("rep")).select(F.col("doc_id").alias("rep"), F.col("component").alias("own"))
        out = out.join(nodes, F.col("doc_id") == F.col("rep"), "left").withColumn("component_id", F.coalesce("component_id", "own", "doc_id"))
        return out.select("doc_id", "n_shingles", "component_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]], size: int = 3, num: int = 90, den: int = 100) -> list[tuple[int | None, int, int | None]]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    import re

    fold = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent: dict[int, int] = {i: i for i, _ in rows if i is not None}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    inverted: dict[tuple, list[int]] = {}
    for j, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(j)
    for j, s in enumerate(sets):
        if rows[j][0] is None or not s:
            continue
        count: dict[int, int] = {}
        for x in s:
            for k in inverted[x]:
                if k < j:
                    count[k] = count.get(k, 0) + 1
        for k, c in count.items():
            if rows[k][0] is not None and den * c >= num * (len(s) + len(sets[k]) - c):
                a, b = find(rows[j][0]), find(rows[k][0])
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None and s else i if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]
