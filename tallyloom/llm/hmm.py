"""Scores of a hidden Markov language model, trained by Baum-Welch over all training documents.

Symbols are the corpus's most frequent words (each its own), buckets for all other words, and the end. A state emits a symbol; a word in a bucket is then
drawn by its smoothed share of the bucket's training tokens. Every round gathers the expected counts of all training documents, partition by partition
with the scaled forward-backward recursion, in doubles, merges them in a tree of tasks in the order of the partitions, and gives the next model. Training
ends when a round has raised the log-likelihood by less than GAIN of itself, or after ROUNDS rounds. A text's score is the exact log10 probability by
the scaled forward recursion, times its bucketed words' shares. So the scores follow from the table's rows alone (another partitioning changes the order
of additions, far behind the sixth place).

Word counts, and so c, N and V of the base score, come from all training documents. The FREQUENT most common words (a fixed number) go to all workers; the
others, a small part of the tokens, are joined with their counts. A text of any length is recursed over in segments: only the states at their borders
are kept, and a segment's own are computed again when its turn comes on the way back.

Training rows are those whose crc32(doc_id as text) mod 5 isn't 1. Null and empty texts are the end alone. Repeated rows train and are scored as often as
they stand; null ids have the remainder 0. An empty table gives no rows. Without training rows all counts are 0 and both scores come from the smoothing
alone. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import fold_of, staged

#: Words that every worker holds; symbols among them; buckets for the rest; states; blobs that a task merges.
FREQUENT, SYMBOLS, BUCKETS, STATES, FAN_IN = 150_000, 20_000, 64, 8, 16
#: Rounds at most; the least relative gain of the log-likelihood that is worth another round.
ROUNDS, GAIN = 8, 1e-3
#: Tokens that are recursed over together, and that keep their states; times between two scalings (their product stays far within a double).
BATCH_TOKENS, SCALE_EVERY = 200_000, 8
#: Added to expected counts of transitions and of symbols.
SMOOTH = (0.1, 0.01)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered; words are what stands between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket_of(word: bytes) -> int:
    """By the word's last two bytes, which tell the language."""
    return zlib.crc32(word[-2:]) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training rows, written once."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_of(t))
            if len(counts) > 400_000:
                yield flush(counts)
                counts = Counter()
        if counts:
            yield flush(counts)

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return staged(docs.where("trains").select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


class Vocabulary:
    """What all workers know: the frequent words' counts and symbols, and the buckets' sizes; FREQUENT words at most.

    The arrays are by a word's number in `index`; their last entry, which -1 finds too, is for the words that aren't in it.
    """

    def __init__(self, frequent: list[tuple[str, int]], total: int, distinct: int, ends: int, bucket_tokens: np.ndarray, bucket_types: np.ndarray):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.log_den = math.log10(total + 0.5 * (distinct + 1))
        words = [w.encode("utf-8", "surrogatepass") for w, _ in frequent]
        self.index = {w: i for i, w in enumerate(words)}
        self.n_own = min(SYMBOLS, len(words))
        self.end = self.n_own + BUCKETS
        self.size = self.end + 1
        self.log_bucket = np.log10(bucket_tokens + 0.5 * (bucket_types + 1))
        self.own_counts = np.array([c for _, c in frequent[: self.n_own]], float)
        bucket = np.array([bucket_of(w) for w in words[self.n_own :]], np.int64)
        self.symbol = np.concatenate((np.arange(self.n_own), self.n_own + bucket, [0])).astype("<u2")
        self.log_count = np.append(np.log10(np.array([c for _, c in frequent], float) + 0.5), 0.0)
        self.log_share = np.zeros(len(words) + 1)
        self.log_share[self.n_own : -1] = self.log_count[self.n_own : -1] - self.log_bucket[bucket]
        self.log_end = math.log10(ends + 0.5)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes], float, float]:
        """The symbols with the end, the words that aren't frequent, and the sums of the others' logs of counts and of shares."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        ids = np.append(self.symbol[at], self.end).astype("<u2")
        rare = np.flatnonzero(at < 0)
        others = [words[i] for i in rare.tolist()]
        share = float(self.log_share[at].sum())
        if others:
            buckets = np.array([bucket_of(w) for w in others])
            ids[rare] = self.n_own + buckets
            share -= float(self.log_bucket[buckets].sum())
        return ids, others, float(self.log_count[at].sum()) + self.log_end, share


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the counted words and the number of training documents."""
    # A histogram over classes of counts (some thousand at most) gives the least class of which all words fit; ordering all words isn't needed.
    size_class = F.floor(F.log2("c") * 64)
    sizes = sorted(((r.k, r.n) for r in counts.groupBy(size_class.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for k, n in sizes:
        if held + n > FREQUENT:
            break
        least, held = k, held + n
    frequent = [] if least is None else sorted(((r.word, r.c) for r in counts.where(size_class >= least).collect()), key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
    rest = counts
    if frequent:
        word, c = frequent[:SYMBOLS][-1]
        rest = counts.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > word)))

    def buckets(batches):
        tokens, types = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            k = np.array([bucket_of(w.encode("utf-8", "surrogatepass")) for w in b.column(0).to_pylist()], np.int64)
            if len(k):
                tokens += np.bincount(k, b.column(1).to_numpy(), BUCKETS).astype(np.int64)
                types += np.bincount(k, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(tokens), pa.array(types)], ["k", "tokens", "types"])

    sums = rest.mapInArrow(buckets, "k long, tokens long, types long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toPandas().set_index("k").reindex(range(BUCKETS), fill_value=0)
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    return Vocabulary(frequent, (whole.n or 0) + ends, whole.v + (1 if ends else 0), ends, sums.tokens.to_numpy(float), sums.types.to_numpy(float))


class Model:
    """start (S), move (S, S) and emit (S, symbols), all in doubles."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(v: Vocabulary, states: int = STATES) -> Model:
        """Near uniform moves; emissions are the corpus's, tilted by fixed random numbers so that the states can part."""
        share = np.concatenate((v.own_counts + 0.5, 10**v.log_bucket, [v.ends + 0.5]))
        tilt = np.random.default_rng(17).random((states, v.size)) + 0.5
        emit = share * tilt
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def from_counts(start, move, emit, share) -> Model:
        start, move, emit = start + SMOOTH[0], move + SMOOTH[0], emit + SMOOTH[1] * share * emit.shape[1]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def length_batches(lengths: np.ndarray, tokens: int = BATCH_TOKENS):
    """Row numbers, longest first, so that rows of like length go together; about `tokens` tokens with padding in each."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, tokens // max(1, int(lengths[order[i]])))
        yield order[i : i + n]
        i += n


class Rows:
    """Sequences (longest first) time by time: `flat` has the symbols of time 0, then of time 1, and so on; at[t] is where time t begins."""

    def __init__(self, seqs: list[np.ndarray]):
        lengths = np.array([len(s) for s in seqs])
        self.n, steps = len(seqs), int(lengths[0])
        self.live = np.searchsorted(-lengths, -np.arange(steps), "left")  # how many still run at each time
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        self.ends = self.at[lengths - 1] + np.arange(self.n)  # where each row's last token stands
        self.flat, self.row = np.empty(int(self.at[-1]), "<u2"), np.empty(int(self.at[-1]), np.int64)
        for k, s in enumerate(seqs):
            places = self.at[: len(s)] + k
            self.flat[places], self.row[places] = s, k

    def segments(self, tokens: int) -> list[tuple[int, int]]:
        """Spans of times of about so many tokens."""
        cuts = [0, *(np.flatnonzero(np.diff((self.at[1:] - 1) // tokens)) + 1).tolist(), len(self.live)]
        return list(zip(cuts, cuts[1:], strict=False))


def forward(m: Model, by_symbol: np.ndarray, rows: Rows, span: tuple[int, int], a: np.ndarray | None):
    """Scaled forward recursion over a span of times from the states `a` before it: emissions, scaled states, scales, and the states at the end.

    Every SCALE_EVERYth time is scaled to the sum 1; the scales of the others are 1.
    """
    at = (rows.at[span[0] : span[1] + 1] - rows.at[span[0]]).tolist()
    emitted = by_symbol[rows.flat[rows.at[span[0]] : rows.at[span[1]]]]
    states, scales, ones = np.empty_like(emitted), np.ones(len(emitted)), np.ones(len(m.start))
    for t, (x, y) in enumerate(zip(at, at[1:], strict=False), span[0] + 1):
        part = states[x:y]
        if a is None:
            part[:] = m.start
        else:
            np.dot(a[: y - x], m.move, out=part)
        part *= emitted[x:y]
        if t % SCALE_EVERY == 0:
            part /= np.dot(part, ones, out=scales[x:y])[:, None]
        a = part
    return emitted, states, scales, a


def likelihoods(m: Model, by_symbol: np.ndarray, seqs: list[np.ndarray], tokens: int = BATCH_TOKENS) -> np.ndarray:
    """The log10 probability of each sequence (longest first)."""
    rows, a = Rows(seqs), None
    log = np.zeros(rows.n)
    for span in rows.segments(tokens):
        _, states, scales, a = forward(m, by_symbol, rows, span, a)
        lo, hi = rows.at[span[0]], rows.at[span[1]]
        log += np.bincount(rows.row[lo:hi], np.log10(scales), rows.n)
        ending = (rows.ends >= lo) & (rows.ends < hi)
        log[ending] += np.log10(states[rows.ends[ending] - lo].sum(1))
    return log


def expected(m: Model, by_symbol: np.ndarray, seqs: list[np.ndarray], start, move, emit, tokens: int = BATCH_TOKENS) -> float:
    """Adds the expected counts of some sequences (longest first) to start, move and emit (symbols, states); gives their log10 likelihood."""
    rows = Rows(seqs)
    spans, borders, a, log = rows.segments(tokens), [], None, 0.0
    for span in spans[:-1]:
        borders.append(a)
        a = forward(m, by_symbol, rows, span, a)[3].copy()
    borders.append(a)
    n_states, later = len(m.start), None
    back = np.ascontiguousarray(m.move.T)
    for span in reversed(spans):
        before = borders.pop()
        emitted, states, scales, _ = forward(m, by_symbol, rows, span, before)
        lo, hi = int(rows.at[span[0]]), int(rows.at[span[1]])
        at = (rows.at[span[0] : span[1] + 1] - lo).tolist()
        ends = rows.ends[(rows.ends >= lo) & (rows.ends < hi)] - lo
        last = states[ends].sum(1)
        log += float(np.log10(scales).sum() + np.log10(last).sum())
        beta = np.empty((len(emitted), n_states))
        beta[ends] = 1 / last[:, None]
        for t in range(SCALE_EVERY - 1 - span[0] % SCALE_EVERY, len(at) - 1, SCALE_EVERY):
            emitted[at[t] : at[t + 1]] /= scales[at[t] : at[t + 1], None]
        if later is not None:
            beta[at[-2] : at[-2] + len(later)] = later
        for t in range(len(at) - 2, 0, -1):
            x, y = at[t], at[t + 1]
            emitted[x:y] *= beta[x:y]
            np.dot(emitted[x:y], back, out=beta[at[t - 1] : at[t - 1] + y - x])
        emitted[: at[1]] *= beta[: at[1]]
        later = emitted[: at[1]] @ back
        gamma = np.multiply(states, beta, out=beta)
        if before is None:
            start += gamma[: at[1]].sum(0)
        else:
            move += before[: at[1]].T @ emitted[: at[1]] * m.move
        # What stands a time before each token: as far from its time's beginning, one time earlier.
        t = np.repeat(np.arange(1, len(at) - 1), np.diff(at)[1:])
        earlier = np.arange(at[1], hi - lo) - np.array(at)[t] + np.array(at)[t - 1]
        move += states[earlier].T @ emitted[at[1] :] * m.move
        place = rows.flat[lo:hi].astype(np.int64)[:, None] * n_states + np.arange(n_states)
        emit += np.bincount(place.ravel(), gamma.ravel(), emit.size).reshape(emit.shape)
    return log


def train(sequences: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Baum-Welch over all sequences: `ids` (packed symbols)."""
    sc = sequences.sparkSession.sparkContext
    m = Model.first(v, states)
    base, size, before = m.emit.mean(0), v.size, None
    sequences = sequences.select("ids")
    tasks = sequences.rdd.getNumPartitions()
    for _ in range(rounds):
        given = sc.broadcast(m)  # of fixed size: states and symbols are parameters

        def run(batches, given=given):
            m = given.value
            by_symbol = np.ascontiguousarray(m.emit.T)
            start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
            seen = False
            for seqs in gathered(batches, 0):
                seen = True
                for rows in length_batches(np.array([len(s) for s in seqs])):
                    log += expected(m, by_symbol, [seqs[i] for i in rows], start, move, emit)
            if seen:
                yield _blob(TaskContext.get().partitionId(), np.concatenate(([log], start, move.ravel(), emit.ravel())))

        level, n = sequences.mapInArrow(run, _BLOB), max(1, tasks)
        while True:  # by one level at least and down to one task: the driver gets one sum at any size
            n = -(-n // FAN_IN)
            level = level.repartition(n, F.expr(f"part div {FAN_IN}")).mapInArrow(merged, _BLOB)
            if n == 1:
                break
        total = np.zeros(1 + states + states * states + states * size)
        for r in sorted(level.collect(), key=lambda r: r.part):
            total += np.frombuffer(zlib.decompress(r.blob))
        given.unpersist()
        log, start, move, emit = total[0], total[1 : states + 1], total[states + 1 : states + 1 + states * states], total[states + 1 + states * states :]
        m = Model.from_counts(start, move.reshape(states, states), emit.reshape(size, states).T, base)
        if before is not None and log - before < gain * abs(before):
            break
        before = log
    return m


_BLOB = "part long, blob binary"


def _blob(part: int, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(numbers.tobytes(), 1)], pa.binary())], ["part", "blob"])


def merged(batches):
    """The sums of each FAN_IN parts, added in their order."""
    groups: dict[int, list] = {}
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            groups.setdefault(p // FAN_IN, []).append((p, blob))
    for group in sorted(groups):
        total = 0.0
        for _, blob in sorted(groups[group]):
            total = total + np.frombuffer(zlib.decompress(blob))
        yield _blob(group, total)


def gathered(batches, column: int, most: int = 4_000_000):
    """Sequences of packed symbols, some million tokens at a time, so that rows of like length meet."""
    seqs, n = [], 0
    for b in batches:
        for x in b.column(column).to_pylist():
            seqs.append(np.frombuffer(x, "<u2"))
            n += len(seqs[-1])
            if n >= most:
                yield seqs
                seqs, n = [], 0
    if seqs:
        yield seqs


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (fold_of(F.col("doc_id")) % 5 == 1).alias("held_out")).withColumn("trains", ~F.col("held_out"))
    counts = word_counts(rows)
    v = vocabulary(counts, rows.where("trains").count())
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(v)  # FREQUENT words at most

    def encode(batches):
        v = known.value
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            keys, ids, n_tokens, n_known, base, share, rare = [], [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                symbols, others, logs, shares = v.encode(words)
                ids.append(symbols.tobytes()), base.append(logs), share.append(shares)
                n_tokens.append(len(words) + 1)
                n_known.append(len(words) - len(others) + (1 if v.ends else 0))
                rare.append([w.decode("utf-8", "surrogatepass") for w in others])
                keys.append((part << 40) | row)
                row += 1
            longs, doubles = [pa.array(x, pa.int64()) for x in (n_tokens, n_known)], [pa.array(x, pa.float64()) for x in (base, share)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), *longs, *doubles, pa.array(rare, pa.list_(pa.string()))], names)

    names = ["doc_id", "held_out", "row", "ids", "n_tokens", "n_known", "base", "share", "rare"]
    facts = f"doc_id {id_type}, held_out boolean, row long, n_tokens long, n_known long, base double, share double"
    coded = staged(rows.select("doc_id", "held_out", "text").mapInArrow(encode, f"doc_id {id_type}, held_out boolean, row long, ids binary, n_tokens long, n_known long, base double, share double, rare array<string>"), "coded")
    model = sc.broadcast(train(coded.where("not held_out"), v))

    def run(batches):
        m = model.value
        by_symbol = np.ascontiguousarray(m.emit.T)
        held: list = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            seqs = [np.frombuffer(x, "<u2") for x in table["ids"].to_pylist()]
            out = np.zeros(len(seqs))
            for rows in length_batches(np.array([len(s) for s in seqs])):
                out[rows] = likelihoods(m, by_symbol, [seqs[i] for i in rows])
            return table.drop_columns(["ids"]).append_column("log", pa.array(out)).to_batches()

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > 8_000_000:
                yield from flush()
                held = []
        if held and sum(map(len, held)):
            yield from flush()

    # Rare words meet their counts; a sum for each document comes back.
    words = coded.select("row", F.explode("rare").alias("word"))
    sums = words.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum((F.coalesce("c", F.lit(0)) > 0).cast("long")).alias("met"))
    logs = coded.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base", "share", "ids").mapInArrow(run, f"{facts}, log double")
    extra = F.coalesce("logs", F.lit(0.0))
    return logs.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(v.log_den)).alias("base_score"), (F.col("log") + F.col("share") + extra).alias("score"),
    )


def op6_hmm(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
