"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of a partition's documents of about SHARD_WORDS words, as word numbers. Words that no benchmark text has can't lie in an occurrence, so
its text is reduced, without loss, to the stretches of benchmark words that are long enough for a window. Over it stand the Burrows-Wheeler transform from
a suffix array, a wavelet matrix of bit vectors that answers ranks, and every SAMPLE_EVERYth suffix position; the suffix array itself isn't kept. All test
windows are searched backwards at once; their occurrences are located by walking to a sampled position, and become removal spans, which are merged for
each document.

Null and empty texts have no words, spans or items. A benchmark row without words (null, empty) has no window. Repeated rows and null ids keep their rows; a
benchmark item without an id counts as the empty id; an empty table of documents gives no rows, and an empty benchmark no spans. Other columns are
handed on as they are, also those that have the name of an added one, which then has underscores behind its name.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, fresh, staged, words_of

#: Words in a window; words of documents in a shard; benchmark words in a block that is broadcast (larger benchmarks take more passes).
WINDOW, SHARD_WORDS, BLOCK_WORDS, SAMPLE_EVERY = 13, 2_000_000, 500_000, 4


class Bits:
    """A bit vector with ranks: words of 64 bits and a count of ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        packed = np.zeros(8 * n, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits.astype(bool), bitorder="little")
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    def rank(self, end: np.ndarray) -> np.ndarray:
        """How many ones stand before end, elementwise."""
        at = end >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks and values of numbers below 2**bits: a bit vector for each bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol stands before end, elementwise."""
        lo, hi = np.zeros_like(end), end.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def value(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one, before = ones.get(at), ones.rank(at)
            out = out * 2 + one
            at = np.where(one, zeros + before, at - before)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ends as soon as all suffixes differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(text[order][1:] != text[order][:-1])))
    step = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        step *= 2
    return order


class FMIndex:
    """Over numbers from 1 on; a 0 ends each stretch. No pattern holds 0, so no occurrence crosses a stretch's end."""

    def __init__(self, text: np.ndarray, vocabulary: int, every: int = SAMPLE_EVERY):
        n = len(text)
        ends = text == 0
        n_ends = int(ends.sum())
        distinct = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + n_ends)  # each end differs, so a common prefix is within a stretch
        sa = suffix_array(distinct)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=vocabulary + 1))))
        self.tree = WaveletMatrix(text[sa - 1].astype(np.int64), max(1, int(vocabulary).bit_length()))
        first = np.concatenate(([True], ends[:-1]))  # a walk must not pass a stretch's start
        sampled = ((sa % every) == 0) | first[sa]
        self.sampled, self.position = Bits(sampled), sa[sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that begin with each pattern (patterns: one length)."""
        last = patterns[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            live = lo < hi
            lo = np.where(live, self.before[c] + self.tree.rank(c, lo), 0)
            hi = np.where(live, self.before[c] + self.tree.rank(c, hi), 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled.get(at[open_])
            hit = open_[done]
            out[hit] = self.position[self.sampled.rank(at[hit])] + steps[hit]
            open_ = open_[~done]
            c = self.tree.value(at[open_])
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
        return out


class Windows:
    """A block's windows as word numbers, by length, each with the items that have it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(k) for k in owners}):
            keys = sorted(k for k in owners if len(k) == n)
            self.by_length[n] = (np.array(keys, np.int64), [sorted(owners[k]) for k in keys])
        self.shortest = min(self.by_length, default=0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers, 0 for those that no item has."""
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))


def search_shard(texts: list[np.ndarray], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each document (its words' numbers): its words that are hit, its merged spans (from, to) in words, and the items whose windows occur."""
    n_docs = len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    if not windows.shortest or not sizes.sum():
        return [0] * n_docs, spans, items
    ids = np.zeros(int(sizes.sum()) + n_docs, np.int64)  # a 0 after each document
    starts = np.cumsum(sizes + 1) - sizes - 1
    for s, w in zip(starts.tolist(), texts, strict=True):
        ids[s : s + len(w)] = w
    edge = np.diff(np.concatenate(([0], (ids != 0).astype(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = hi - lo >= windows.shortest
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return [0] * n_docs, spans, items
    length = hi - lo + 1  # with the 0 that ends it
    source = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    index = FMIndex(ids[source], len(windows.number))
    delta = np.zeros(len(ids) + 1, np.int64)
    for n, (patterns, owners) in windows.by_length.items():
        a, b = index.ranges(patterns)
        found = np.maximum(b - a, 0)
        which = np.repeat(np.arange(len(patterns)), found)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + a[which]
        at = source[index.locate(rows)]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + n, -1)
        pairs = np.unique(np.column_stack((np.searchsorted(starts, at, "right") - 1, which)), axis=0)
        for d, w in pairs.tolist():
            items[d].update(owners[w])
    hit = np.cumsum(delta[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(starts, lo, "right") - 1
    for d, x, y in zip(doc.tolist(), (lo - starts[doc]).tolist(), (hi - starts[doc]).tolist(), strict=True):
        spans[d].append((x, y))
    return [sum(y - x for x, y in s) for s in spans], spans, items


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """The benchmark in blocks of about block_words words, each collected only when its turn comes.

    Items that are longer than a tenth of a block come in pieces which share window - 1 words, so that no window is lost and no item fills a block; equal rows count once.
    """
    upper = "".join(map(chr, range(65, 91)))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    piece = max(block_words // 10, 2 * window)
    table = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).distinct()
    starts = F.sequence(F.lit(1), F.size("words") - (window - 1), F.lit(piece - window + 1))
    pieces = F.when(F.size("words") > piece, F.transform(starts, lambda i: F.slice("words", i, piece))).otherwise(F.array("words"))
    table = table.select("item", F.explode(pieces).alias("words")).select("item", F.size("words").alias("n"), F.array_join("words", " ").alias("text"))
    blocks = max(1, -(-(table.agg(F.sum("n")).first()[0] or 0) // block_words))
    if blocks > 1:
        table = staged(table, "benchmark-pieces")
    for k in range(blocks):
        yield [(r.item, r.text) for r in table.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]


#: What find_spans adds.
ADDED = ("n_words", "n_hit", "items", "spans")


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of docs with n_words, n_hit, items and spans (word offsets) behind its own columns; fresh(docs.columns, *ADDED) gives their names."""
    sc = docs.sparkSession.sparkContext
    n_words, n_hit, items, spans, row, more_items, more_spans = fresh(docs.columns, *ADDED, "_row", "_items", "_spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(rows: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
        block = sc.broadcast(Windows(texts, window))  # at most block_words words or so
        at, names = rows.columns.index("text"), [*rows.columns, n_words, n_hit, items, spans]

        def run(batches):
            held, shard, total = [], [], 0

            def flush():
                hits, found, owners = search_shard(shard, block.value)
                i = 0
                for b in held:
                    j = i + len(b)
                    counts = [pa.array([len(w) for w in shard[i:j]], pa.int64()), pa.array(hits[i:j], pa.int64()), pa.array([sorted(x) for x in owners[i:j]], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns, *counts, pa.array([[{"start": x, "end": y} for x, y in s] for s in found[i:j]], span)], names)
                    i = j

            for b in batches:
                held.append(b)
                for t in b.column(at).to_pylist():
                    shard.append(block.value.numbers(words_of(t)))
                    total += len(shard[-1])
                if total >= shard_words:
                    yield from flush()
                    held, shard, total = [], [], 0
            yield from flush()

        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
        return rows.mapInArrow(run, ", ".join([*own, f"{n_words} long, {n_hit} long, {items} array<string>, {spans} array<struct<start:long,end:long>>"]))

    blocks = benchmark_blocks(benchmark, block_words, window)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return search(docs, first)
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    out = search(rows, first)
    no_items, no_spans = F.array().cast("array<string>"), F.expr("cast(array() as array<struct<start:long,end:long>>)")
    while second is not None:  # each further block adds its spans and items to the rows, in one more pass
        found = search(rows, second).where(F.col(n_hit) > 0).select(F.col(row), F.col(items).alias(more_items), F.col(spans).alias(more_spans))
        out = out.join(staged(found, "decontamination-block"), row, "left")
        out = out.withColumn(items, F.array_sort(F.array_union(items, F.coalesce(more_items, no_items)))).withColumn(spans, F.concat(spans, F.coalesce(more_spans, no_spans))).drop(more_items, more_spans)
        second = next(blocks, None)
    merged = F.expr(f"""aggregate(array_sort({spans}), cast(array() as array<struct<start:long,end:long>>), (acc, s) -> case
        when size(acc) > 0 and element_at(acc, -1).end >= s.start
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
        else concat(acc, array(named_struct('start', s.start, 'end', s.end))) end)""")
    whole = out.withColumn(spans, merged).withColumn(n_hit, F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.end - s.start)"))
    return whole.select(*(f"`{c}`" for c in docs.columns), n_words, n_hit, items, spans)


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> F.Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that benchmark windows contaminate."""
    n_words, n_hit, items, spans = fresh(docs.columns, *ADDED)
    return find_spans(docs, benchmark).where(~contaminated(n_words, n_hit)).drop(n_words, n_hit, items, spans)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, contaminated().alias("contaminated"))
