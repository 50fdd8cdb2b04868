"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (64-bit hashes; a shorter text is one shingle). Texts with equal sets form one node, so copies cost a count and no
pairs. Every node is signed at the full depth: in each of TREES trees its path is DEPTH labels. The paths are sorted by tree and label, over all machines,
which makes each tree a prefix trie laid out in order: a row's longest common prefix with the row before it says at which depth it joins a run, and it is
linked to that run's first node (a star, never all pairs). The join begins at the full depth and shortens the prefixes by what it finds: the similarities of
the links verified so far, each weighed by the chance that the trees had to find it, estimate the recall at every depth, and the longest depth that
reaches the target is taken (one imagined link at the threshold keeps the estimate modest where little was found). That never goes below the depth
at which the trees find a pair at the threshold with the target probability.

Nodes that runs link are a cluster. A cluster of more than WHOLE_BLOCKS blocks is parted first without loss: two sets at the threshold must share one of the
rarest few shingles of each, so only nodes connected by those stay together, and common passages alone hold nothing together. Each part is verified
exactly: it is dealt into blocks of bounded size, each pair of blocks is one task's work, and what leaves a task is a count for each node and a spanning
forest of the links, never the links themselves. Classes are the connected components of the verified links.

Result: a row for each document with class_id (the least doc_id of its class) and n_links (the other documents, copies included, at the threshold or above).
Documents without words (null, empty, signs only) are similar to nothing, not even to each other: class_id is their own id and n_links 0. Ties cannot
occur. Repeated rows count as copies. Null ids keep null if their class has no other. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, join_facts, key_bitmap, mix64, staged, with_maybe, words_of

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 7, 0.9999
#: Bins of similarity between the threshold and 1; documents with a shingle from which on it isn't rare; sets of equal texts that are sent to all, at most.
BINS, COMMON, HOT_SETS = 20, 16, 10_000
#: Nodes and shingles in a block of a cluster, at most (in expectation); blocks up to which a cluster is compared whole rather than parted first.
BLOCK_NODES, BLOCK_SHINGLES, WHOLE_BLOCKS = 128, 400_000, 16

#: Odd multipliers for a shingle's words and for a prefix's labels.
_POWERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    """Word to 64-bit hash, computed once for each worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _Hashes()


def shingles_of(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(_word_hashes) > 300_000:
        _word_hashes.clear()
    h = np.array(list(map(_word_hashes.__getitem__, words)), np.uint64)
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc += h[i : i + n] * _POWERS[i]
    return np.unique(mix64(acc))


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That some tree has both of a pair on one path of this depth."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, full: int = DEPTH) -> int:
    """The depth below which no join has to go: the longest at which a pair at the threshold is found with probability `recall`."""
    return next((d for d in range(full, 1, -1) if chance(threshold, d, trees) >= recall), 1)


def shortened(found: dict[int, int], depth: int, recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES) -> int:
    """The longest depth up to `depth` whose estimated recall is enough; found: links in each bin of similarity, at `depth`.

    Each bin counts at its lower end, and one more link at the threshold is taken for granted.
    """
    ends = [threshold + (1 - threshold) * k / BINS for k in range(BINS + 1)]
    there = [found.get(k, 0) / chance(x, depth, trees) + (k == 0) for k, x in enumerate(ends)]
    return next((d for d in range(depth, 1, -1) if sum(n * chance(x, d, trees) for n, x in zip(there, ends, strict=True)) >= recall * sum(there)), 1)


class Signer:
    """Signatures of shingle sets: `trees` paths of `depth` labels, a label being 16 bits of the least of a * x + b (32 bits) over the set.

    Products go to one buffer that is kept, some hundred shingles at a time: fresh arrays of this size would cost more than the sums.
    """

    def __init__(self, trees: int, depth: int, rows: int = 256):
        n = trees * depth
        seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
        self.a, self.b = seeds[:n] | np.uint32(1), seeds[n:]
        self.buffer, self.least = np.empty((rows, n), np.uint32), np.empty(n, np.uint32)

    def sign(self, shingles: np.ndarray) -> bytes:
        """The paths one after the other, labels with the high byte first, so that paths sort as bytes."""
        x, rows = shingles.astype(np.uint32), len(self.buffer)
        self.least.fill(0xFFFFFFFF)
        for i in range(0, len(x), rows):
            part = x[i : i + rows]
            out = self.buffer[: len(part)]
            np.multiply(part[:, None], self.a, out=out)
            np.add(out, self.b, out=out)
            np.minimum(self.least, out.min(axis=0), out=self.least)
        return self.least.astype(">u2").tobytes()


def _set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, trees: int, depth: int, k: int = SHINGLE) -> DataFrame:
    """doc_id, row key, set id (null without words) with its first half, size and signature of each row, written once."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        last: dict[bytes, bytes] = {}
        signer = Signer(trees, depth)
        for b in batches:
            sets, short, size, signed = [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingles_of(t, k)
                if not len(s):
                    sets.append(None), short.append(None), size.append(0), signed.append(None)
                    continue
                i = _set_id(s)
                if i not in last:
                    if len(last) > 5000:
                        last.clear()
                    last[i] = signer.sign(s)
                sets.append(i), short.append(int.from_bytes(i[:8], "little", signed=True)), size.append(len(s)), signed.append(last[i])
            facts = [pa.array(sets, pa.binary()), pa.array(short, pa.int64()), pa.array(size, pa.int32()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *facts], ["doc_id", "row_a", "row_b", "node", "short", "size", "signature"])

    schema = f"doc_id {id_type}, row_a long, row_b long, node binary, short long, size int, signature binary"
    return staged(with_row_key(docs).mapInArrow(run, schema), "signatures")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading labels are equal, row by row."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def forest(nodes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, level): every path that shares at least `least` labels with the one before it in its sorted tree, linked at that level to its run's first.

    Nodes that share a prefix of some length in a tree are connected by links of that level or more, and by no others.
    """
    size = 2 * depth
    paths = nodes.select("short", F.explode(F.expr(f"transform(sequence(0, {trees - 1}), t -> named_struct('tree', t, 'path', substr(signature, t * {size} + 1, {size})))")).alias("p"))
    order = ["tree", "path", "short"]
    ordered = paths.select("p.tree", "p.path", "short").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, first, last, heads = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, depth)
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            shared = np.zeros(n, np.int64)
            shared[1:] = np.where(tree[1:] == tree[:-1], common_prefix(labels[1:], labels[:-1]), 0)
            if last is None:
                first, heads = (tree[0], labels[0], node[0]), np.full(depth + 1, node[0])
            elif last[0] == tree[0]:
                shared[0] = common_prefix(labels[:1], last[1][None, :])[0]
            head = np.empty(n, np.int64)
            for level in range(least, depth + 1):
                begun = np.maximum.accumulate(np.where(shared < level, np.arange(n), -1))
                of = np.where(begun >= 0, node[begun], heads[level])
                head = np.where(shared == level, of, head)
                heads[level] = of[-1]
            last = (tree[-1], labels[-1].copy(), node[-1])
            joins = (shared >= least) & (head != node)
            if joins.any():
                none = pa.nulls(int(joins.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(head[joins]), pa.array(node[joins]), pa.array(shared[joins], pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if first is not None:
            ends = [first, last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(e[2]) for e in ends], pa.int64()), pa.nulls(2, pa.int64()), pa.array([0, 1], pa.int32()), pa.array([part] * 2, pa.int64()), pa.array([int(e[0]) for e in ends], pa.int32()), pa.array([e[1].tobytes() for e in ends], pa.binary())], names
            )

    names = ["a", "b", "level", "part", "tree", "path"]
    found = staged(ordered.mapInArrow(run, "a long, b long, level int, part long, tree int, path binary"), "forest")
    # A run may go on in the next partition: two rows for each partition, its first and its last, tell.
    borders = sorted((r.part, r.level, r.tree, r.path, r.a) for r in found.where("part is not null").collect())
    joined = []
    for (_, end, tree, path, node), (_, _, next_tree, next_path, next_node) in zip(borders, borders[1:], strict=False):
        if end == 1 and tree == next_tree:
            level = int(common_prefix(*(np.frombuffer(x, ">u2")[None, :] for x in (path, next_path)))[0])
            if level >= least and node != next_node:
                joined.append((node, next_node, level))
    edges = found.where("part is null").select("a", "b", "level")
    return edges.unionByName(nodes.sparkSession.createDataFrame(joined, "a long, b long, level int")) if joined else edges


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, row_a, row_b, text: a row's key is two hashes of its id and text, so copies under different ids have different ones."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row_b"), "text")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): the least node of each connected component, by hooking and pointer jumping on tables."""
    work = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = work.select(F.col("a").alias("node")).union(work.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not work.isEmpty():
        # Each root hooks to its least neighbour, if that is less; then paths are halved until all lead to an end.
        jump = staged(work.groupBy("b").agg(F.min("a").alias("up")), f"{name}-hooks")
        while True:
            further = jump.select(F.col("b").alias("m"), F.col("up").alias("upper"))
            jump = staged(jump.join(further, F.col("up") == F.col("m"), "left").select("b", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), f"{name}-jumps")
            more = not jump.where("moved").isEmpty()
            jump = jump.drop("moved")
            if not more:
                break
        labels = staged(labels.join(jump, labels.root == jump.b, "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
        end = lambda c: jump.select(F.col("b").alias(f"from_{c}"), F.col("up").alias(f"to_{c}"))  # noqa: E731, B023
        moved = work.join(end("a"), F.col("a") == F.col("from_a"), "left").join(end("b"), F.col("b") == F.col("from_b"), "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        work = staged(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-rest")
    return labels


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
    """Pairs (i in left, j in right) of sets at the threshold or above, and their similarities.

    Shingles that stand in one set only add to no intersection; the others become columns of a matrix, in slices, and products count the common ones.
    """
    size = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    n_columns = int((times > 1).sum())
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    cuts = np.searchsorted(column, np.arange(0, n_columns + width, width))
    for k in range(len(cuts) - 1):
        m = np.zeros((len(sets), width), np.float32)
        m[owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * width] = 1
        common += m[left] @ m[right].T
    total = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero((common >= threshold * total - 1e-6) & (left[:, None] != right[None, :]))
    return i, j, common[i, j] / total[i, j]


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """From members (cluster, x, y, side, node, copies, shingles): (node, null, links, null), links counting documents, (node, other, 0, null) for
    spanning edges, and (null, null, pairs, bin) with the number of linked nodes in each bin of similarity."""

    def run(key, table):
        nodes, side, copies = table["node"].to_pylist(), table["side"].to_numpy(), table["copies"].to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in table["shingles"].to_pylist()]
        left = np.flatnonzero(side == 0)
        right = left if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)
        links, pairs = np.zeros(len(nodes), np.int64), np.zeros(BINS + 1, np.int64)
        up = list(range(len(nodes)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        edges = []
        if len(left) and len(right):
            i, j, similar = _links(sets, left, right, threshold)
            same = right is left
            np.add.at(links, left[i], copies[right[j]])
            if not same:
                np.add.at(links, right[j], copies[left[i]])
            once = i < j if same else np.ones(len(i), bool)
            bins = np.clip((similar - threshold) / (1 - threshold) * BINS, 0, BINS).astype(np.int64)
            pairs += np.bincount(bins[once], minlength=BINS + 1)
            for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
                if (x := top(a)) != (y := top(b)):
                    up[x] = y
                    edges.append((a, b))
        kept, filled = np.flatnonzero(links), np.flatnonzero(pairs)
        return pa.table(
            {
                "node": pa.array([nodes[i] for i in kept] + [nodes[a] for a, _ in edges] + [None] * len(filled), pa.binary()),
                "other": pa.array([None] * len(kept) + [nodes[b] for _, b in edges] + [None] * len(filled), pa.binary()),
                "links": pa.array(links[kept].tolist() + [0] * len(edges) + pairs[filled].tolist(), pa.int64()),
                "bin": pa.array([None] * (len(kept) + len(edges)) + filled.tolist(), pa.int32()),
            }
        )

    return members.groupBy("cluster", "x", "y").applyInArrow(run, "node binary, other binary, links long, bin int")


def with_blocks(placed: DataFrame) -> DataFrame:
    """placed (root, node, short, size, copies) with the number of blocks of its cluster."""
    blocks = placed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return placed.join(blocks, "root")


def rarest(shingles: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles of which a set at the threshold must have one: as many as it can lack and one more, those that aren't common first, then by value."""
    n = len(shingles) - int(np.ceil(threshold * len(shingles) - 1e-6)) + 1
    return shingles[np.lexsort((shingles, _in(common, shingles)))[:n]]


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1


def parted(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """large (root, node, short, ...) with the roots of the parts that share rarest shingles; nodes that share none have no link and go."""
    members = large.select("root", "short", "node").join(sets, "node").select("root", "short", "shingles")
    counted = staged(members.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "met-shingles")
    sc = large.sparkSession.sparkContext
    # Full bitmaps would only make the order poorer and the keys more.
    met = sc.broadcast(key_bitmap(counted, "shingle", "met-twice").array())
    common = sc.broadcast(key_bitmap(counted.where(F.col("n") >= COMMON), "shingle", "common-shingles").array())

    def run(batches):
        for b in batches:
            kept = []
            for s in b.column(2).to_pylist():
                found = rarest(np.asarray(s, np.int64).view(np.uint64), common.value, threshold)
                kept.append(found[_in(met.value, found) > 0].view(np.int64))  # what no other set has links nothing
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.list_(pa.int64()))], ["root", "short", "shingles"])

    keys = staged(members.mapInArrow(run, "root long, short long, shingles array<long>"), "rarest").select("root", "short", F.explode("shingles").alias("shingle"))
    stars = keys.groupBy("root", "shingle").agg(F.min("short").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = keys.join(stars, ["root", "shingle"]).where("short <> centre").select(F.col("centre").alias("a"), F.col("short").alias("b"))
    parts = components(edges, "parts").select(F.col("node").alias("short"), F.col("root").alias("part"))
    return large.join(parts, "short").withColumn("root", F.col("part")).drop("part", "blocks")


def cluster_links(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """What verified() gives for the clusters of placed, with `root`, the cluster as it came."""
    sized = staged(with_blocks(placed), "sized")
    large = sized.where(F.col("blocks") > WHOLE_BLOCKS)
    dealt = sized
    if not large.isEmpty():
        dealt = staged(sized.where(F.col("blocks") <= WHOLE_BLOCKS).unionByName(with_blocks(parted(large, sets, threshold))), "parted")
    # Block b meets every block from itself on: as side 0 the later ones, as side 1 the earlier ones.
    meets = F.expr("concat(transform(sequence(block, blocks - 1), y -> named_struct('x', block, 'y', y, 'side', 0)), filter(transform(sequence(0, block), x -> named_struct('x', x, 'y', block, 'side', 1)), m -> m.x < block))")
    dealt = dealt.select("root", "node", "copies", "blocks").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = sets.join(dealt.hint("merge"), "node").select(F.col("root").alias("cluster"), F.explode(meets).alias("m"), "node", "copies", "shingles")
    return staged(verified(members.select("cluster", "m.x", "m.y", "m.side", "node", "copies", "shingles"), threshold), "links")


def found_again(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles): each node's first row found by its key, the set id confirming it; only texts whose key may be wanted move."""
    wanted = nodes.select(F.col("first.a").alias("row_a"), F.col("first.b").alias("row_b"), F.col("node").alias("wanted"))
    may = with_maybe(with_row_key(docs), "row_a", key_bitmap(wanted, "row_a", "wanted-keys")).where("_maybe")
    once = may.groupBy("row_a", "row_b").agg(F.first("text").alias("text"))  # repeated rows have one key
    texts = once.join(wanted.hint("merge"), ["row_a", "row_b"]).select("wanted", "text")

    def again(batches):
        for b in batches:
            keep, sets = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles_of(text, k)
                if len(s) and _set_id(s) == node:
                    keep.append(node), sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return staged(texts.mapInArrow(again, "node binary, shingles array<long>"), "sets")


def classified(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, full_depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, row_a, row_b, class_id, n_links and the class's first row (first.id, first.a, first.b) for each row of docs."""
    docs = docs.select("doc_id", "text")
    rows = signatures(docs, trees, full_depth, k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_a").alias("a"), F.col("row_b").alias("b")))
    of_set = [F.count("*").alias("copies"), first.alias("first"), *(F.first(c).alias(c) for c in ("short", "size", "signature"))]
    nodes = staged(rows.where("node is not null").groupBy("node").agg(*of_set), "nodes")
    # Half of a set id names a node here: should two agree, their clusters are one, and verification still parts them.
    trie = staged(forest(nodes, trees, full_depth, depth_for(recall, threshold, trees, full_depth)), "trie")
    near = trie.select(F.col("a").alias("short")).union(trie.select("b")).distinct()
    # What grows with the documents is joined by sorting at any size (merge), so that a plan that holds on small tables is the one of large tables.
    own = staged(nodes.select("short", "node", "size", "copies", "first").join(near.hint("merge"), "short"), "cluster-nodes")
    sets = found_again(docs, own, k)
    depth, links, old = full_depth, None, None
    while True:
        clusters = components(trie.where(F.col("level") >= depth).select("a", "b"), f"clusters-{depth}").withColumnRenamed("node", "short")
        placed = staged(clusters.join(own.drop("first").hint("merge"), "short"), "placed")
        sizes = placed.groupBy("root").agg(F.count("*").alias("n"))
        if old is None:
            links = cluster_links(placed, sets, threshold)
        else:  # clusters only grow, so one with its root and size is as it was, and so are its links
            same = old.join(sizes, ["root", "n"]).select("root")
            kept = before.join(same, "root", "left_semi").select("node")
            apart = links.where("bin is null").join(kept, "node", "left_semi")
            links = staged(apart.unionByName(cluster_links(placed.join(same, "root", "left_anti"), sets, threshold).where("bin is null")), "all-links")
            break
        found = {r.bin: r.n for r in links.where("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect()}
        if (shorter := shortened(found, depth, recall, threshold, trees)) == depth:
            break
        depth, old, before = shorter, sizes, placed
    counts = links.where("bin is null and other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "classes")
    firsts = classes.join(own.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("class_first"))
    linked = staged(classes.join(firsts, "root").join(counts, "node").select("node", "class_first", "links"), "linked")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    facts = nodes.select("node", "copies", "first").join(linked.hint("merge"), "node", "left").select("node", "copies", n_links, F.coalesce("class_first", "first").alias("first"))
    found = join_facts(rows.select("doc_id", "row_a", "row_b", "node"), facts, "node", "copies", HOT_SETS)
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id")
    return found.select("doc_id", "row_a", "row_b", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first")


def similar_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs."""
    return classified(docs, **how).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with the first row of each class (by id, null ids last); rows that are similar to none stay."""
    found = staged(classified(docs, **how).where("n_links > 0").select("row_a", "row_b", (F.col("row_a").eqNullSafe(F.col("first.a")) & F.col("row_b").eqNullSafe(F.col("first.b"))).alias("stays")), "classified")
    whole = F.struct(*(f"`{c}`" for c in docs.columns)).alias("whole")  # so no name of docs can clash
    keyed = docs.select(whole, F.xxhash64("doc_id", "text").alias("_row_a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_row_b"))
    gone = staged(found.where("not stays").select(F.col("row_a").alias("_row_a"), F.col("row_b").alias("_row_b")).distinct(), "gone")
    marked = with_maybe(keyed, "_row_a", key_bitmap(gone, "_row_a", "gone-keys"))
    left = marked.where("not _maybe").unionByName(marked.where("_maybe").join(gone, ["_row_a", "_row_b"], "left_anti"))
    repeated = staged(found.where("stays").groupBy(F.col("row_a").alias("_row_a"), F.col("row_b").alias("_row_b")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if not repeated.isEmpty():  # rows that repeat id and text: one of each is left
        once = left.join(repeated, ["_row_a", "_row_b"], "left_semi").dropDuplicates(["_row_a", "_row_b"])
        left = left.join(repeated, ["_row_a", "_row_b"], "left_anti").unionByName(once)
    return left.select("whole.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir))
