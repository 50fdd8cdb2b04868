"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text, over a closed vocabulary and one symbol for all other words and for a text's beginning. Both back
off to one shared Kneser-Ney model of the pooled counts: absolute discounting, with continuation counts below. An expression (a word, or a word after
another) whose counts in the classes don't differ beyond chance is rare: both models take its shared estimate. Of the others each model has its own
discounted estimate with the shared backoff, as a factor of the shared one (of a pair's and its word's the factor that tells the classes further apart),
and after every word the probabilities are scaled to the sum 1. A text's log-likelihood under each model, of all its words, is divided by its length;
the difference of the two goes through a logistic curve, fitted to training rows that the counts haven't seen, to a score from 0 to 1. A text counts an
expression once in training, so a refrain within one text is no evidence of a class.

Labels are read only from rows whose crc32(doc_id as text) mod 5 isn't 0; of each class at most about SAMPLE rows, drawn by a hash of the id, are
trained on (the documented bound of the fitted model; every document is scored in whole). Rows without a label, an id or a document don't train, nor do
labels other than 0 and 1; a document labelled twice is toxic if any label says so; of texts with equal sets of shingles one trains, with its own label
(a toxic one, if there is one). A FITS-th of these texts, by a hash of the set, fit the curve after the others were counted; then all are counted for the
models that score. Null and empty texts, and all texts where there is nothing to learn from, score the base rate of the training labels (0.0 without labels). Repeated rows and null ids are scored as
they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, fold_of, staged, words_of
from tallyloom.llm.jaccard import _set_id, shingles_of

#: Labelled rows of each class that train, at most (in expectation); every FITS-th of them fits the curve.
SAMPLE, FITS = 12_000, 5
#: Words in the vocabulary and pairs in the shared model, at most; texts that a word and a pair must have been in.
VOCABULARY, PAIRS, WORD_COUNT, PAIR_COUNT = 60_000, 400_000, 3, 4
#: The discount, and the G statistic (one degree of freedom) from which a difference is beyond chance.
DISCOUNT, EVIDENCE = 0.75, 20.0
#: Weight of the whole difference before any row has fitted the curve, and how firmly that curve is held to.
SLOPE, RIDGE = 2.0, 1.0


def _columns(rows: DataFrame, *order: str) -> dict[str, np.ndarray]:
    """A bounded table's columns, in the given order of its rows: as Arrow columns, since rows as objects would take the driver many times their bytes."""
    table = rows.toArrow()
    if order:
        table = table.sort_by([(c, "ascending") for c in order])
    return {c: table.column(c).to_numpy() for c in table.column_names}


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(toxic, text, fits) of the sampled labelled rows, once for each text, and the share of toxic ones among all training labels."""
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) % 5 != 0)
    known = labelled.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, sample / n))).otherwise(share)
    # At most about 2 * sample ids of 12 bytes: a fixed bound, whatever the input.
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")

    def sets(batches):
        for b in batches:
            ids = [_set_id(shingles_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *b.columns], ["set_id", "toxic", "text"])

    known_sets = joined.select("toxic", "text").mapInArrow(sets, "set_id binary, toxic int, text string")
    kept = known_sets.groupBy("set_id").agg(F.min(F.struct((-F.col("toxic")).alias("minus"), "text")).alias("r"))
    fits = F.pmod(F.xxhash64("set_id"), F.lit(FITS)) == 0
    return kept.select((-F.col("r.minus")).alias("toxic"), "r.text", fits.alias("fits")), (sizes.get(1, 0) / total if total else 0.0)


def _counted(rows: DataFrame, keys, kind: pa.DataType, name: str) -> DataFrame:
    """(key, tox, ord): how many toxic and ordinary rows have each key of the list that keys(words) gives."""

    def run(batches):
        for b in batches:
            by = (Counter(), Counter())
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[toxic].update(keys(words_of(text)))
            for c in (0, 1):
                if by[c]:
                    n = pa.array(list(by[c].values()), pa.int64())
                    zero = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(by[c]), kind), n if c else zero, zero if c else n], ["key", "tox", "ord"])

    counted = rows.select("toxic", "text").mapInArrow(run, f"key {name}, tox long, ord long")
    return counted.groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def evidence(a, b, na, nb):
    """The G statistic of counts a of na and b of nb against one common rate."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    rate = (a + b) / np.maximum(na + nb, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / (rate * na)), 0) + np.where(b > 0, b * np.log(b / (rate * nb)), 0))


def discounted(n, total, types, below):
    """Kneser-Ney: the discounted share of n, and what the discounts of all types leave to the distribution below; below itself where nothing was seen."""
    n, total = np.asarray(n, float), np.asarray(total, float)
    return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * np.asarray(types) * below) / np.maximum(total, 1), below)


class Numbers:
    """Words as numbers; 0 is for all other words and for a text's beginning."""

    def __init__(self, words: list[str]):
        self.number = {w.encode(): i + 1 for i, w in enumerate(words)}
        self.size = len(words) + 1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """head * size + word for each word."""
        return np.concatenate(([0], numbers[:-1])) * self.size + numbers if len(numbers) else numbers


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys, -1 where they aren't in it."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Models:
    """Both models; at most VOCABULARY words, PAIRS pairs of the shared model and the pairs with evidence.

    words (cont, tox, ord) and heads (tox, ord, t_tox, t_ord) are by number: continuations of a word, texts that have it, texts that go on after it and
    their different next words. shared_pairs: keys and pooled counts; telling: keys, tox and ord of the pairs with evidence. Keys ascend.
    """

    def __init__(self, numbers: Numbers, words: dict, heads: dict, shared_pairs: tuple, telling: tuple):
        self.numbers, size = numbers, numbers.size
        cont, both = words["cont"].astype(float), {c: words[c].astype(float) for c in ("tox", "ord")}
        self.below = cont / max(1.0, cont.sum())
        self.keys, n = np.asarray(shared_pairs[0], np.int64), np.asarray(shared_pairs[1], float)
        total = heads["tox"] + heads["ord"]
        self.pair = (n - DISCOUNT) / total[self.keys // size]
        self.left = 1 - np.bincount(self.keys // size, self.pair, size)  # what each head leaves to the continuations
        # Words with evidence: their factors.
        pooled = both["tox"] + both["ord"]
        sums = {c: both[c].sum() for c in both}
        self.sure = (evidence(both["tox"], both["ord"], sums["tox"], sums["ord"]) >= EVIDENCE) & (self.below > 0)
        self.sure[0] = False
        whole = discounted(pooled, pooled.sum(), (pooled > 0).sum(), self.below)
        of_word = {c: discounted(both[c], sums[c], (both[c] > 0).sum(), self.below) for c in both}
        with np.errstate(divide="ignore", invalid="ignore"):
            word_factor = {c: np.where(self.sure, of_word[c] / whole, 1.0) for c in both}
        # Pairs with evidence: the pair's factors, or its word's if those tell the classes further apart.
        self.telling = np.asarray(telling[0], np.int64)
        h, w = self.telling // size, self.telling % size
        shared = self.shared(self.telling)
        pair_factor = {}
        for c, count in (("tox", telling[1]), ("ord", telling[2])):
            below = np.where(self.sure[w], of_word[c][w], self.below[w])
            pair_factor[c] = discounted(count, heads[c][h], heads[f"t_{c}"][h], below) / shared
        apart = lambda f: np.abs(np.log(f["tox"]) - np.log(f["ord"]))
        of_its_word = {c: word_factor[c][w] for c in both}
        better = apart(pair_factor) >= apart(of_its_word)
        self.log_word, self.log_pair, self.log_scale = {}, {}, {}
        own = self.sure[self.keys % size]
        for c in both:
            f, g = word_factor[c], np.where(better, pair_factor[c], of_its_word[c])
            # After each head the factors times the shared estimates have this sum.
            scale = 1 + self.left * ((f - 1) * self.below).sum()
            scale += np.bincount(self.keys[own] // size, (f[self.keys[own] % size] - 1) * self.pair[own], size)
            scale += np.bincount(h, (g - f[w]) * shared, size)
            self.log_word[c], self.log_pair[c], self.log_scale[c] = np.log(f), np.log(g), np.log(scale)

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """The shared model's probability of each pair's word after its head."""
        at = _find(self.keys, keys)
        return np.where(at >= 0, self.pair[at] if len(self.pair) else 0.0, 0.0) + self.left[keys // self.numbers.size] * self.below[keys % self.numbers.size]

    def log_likelihoods(self, words: list[bytes]) -> tuple[float, float]:
        """log P(text | toxic) and log P(text | ordinary), each divided by the number of words."""
        keys = self.numbers.pairs(self.numbers.of(words))
        h, w, at = keys // self.numbers.size, keys % self.numbers.size, _find(self.telling, keys)
        common = np.log(np.maximum(self.shared(keys), 1e-300)).sum()
        out = []
        for c in ("tox", "ord"):
            factor = np.where(at >= 0, self.log_pair[c][at] if len(self.telling) else 0.0, self.log_word[c][w])
            out.append(float((common + (factor - self.log_scale[c][h]).sum()) / len(keys)))
        return out[0], out[1]


def train_models(rows: DataFrame) -> Models | None:
    """Models from the counted rows (toxic, text); None where they have too little."""
    words = _counted(rows, lambda w: [x.decode("utf-8", "surrogatepass") for x in set(w)], pa.string(), "string")
    top = words.where(F.col("tox") + F.col("ord") >= WORD_COUNT).orderBy((F.col("tox") + F.col("ord")).desc(), "key").limit(VOCABULARY).select("key").toArrow()
    numbers = Numbers(top.column("key").to_pylist())
    known = rows.sparkSession.sparkContext.broadcast(numbers)  # VOCABULARY words at most
    size = numbers.size
    pairs = staged(_counted(rows, lambda w: np.unique(known.value.pairs(known.value.of(w))).tolist(), pa.int64(), "long"), "toxic-pairs")
    types = lambda c: F.sum((F.col(c) > 0).cast("long"))
    both = [F.sum("tox").alias("tox"), F.sum("ord").alias("ord")]
    after = _columns(pairs.groupBy(F.expr(f"key % {size}").alias("w")).agg(F.count("*").alias("cont"), *both))
    heads = staged(pairs.groupBy(F.expr(f"key div {size}").alias("h")).agg(*both, types("tox").alias("t_tox"), types("ord").alias("t_ord")), "toxic-heads")
    before = _columns(heads)
    if not after["tox"].sum() or not after["ord"].sum():
        return None
    n = F.col("tox") + F.col("ord")
    most = _columns(pairs.where(n >= PAIR_COUNT).orderBy(n.desc(), "key").limit(PAIRS).select("key", n.alias("n")), "key")
    # The G statistic in SQL, so that only pairs with evidence come to the driver; heads are as many as words at most.
    g = lambda a, na: f"case when {a} > 0 then {a} * ln({a} * (na + nb) / (cast(tox + ord as double) * {na})) else 0 end"
    of_heads = F.broadcast(heads.select("h", F.col("tox").alias("na"), F.col("ord").alias("nb")))
    candidates = pairs.where(n >= PAIR_COUNT).where(f"key div {size} > 0 and key % {size} > 0").withColumn("h", F.expr(f"key div {size}")).join(of_heads, "h")
    telling = _columns(candidates.where(f"na > 0 and nb > 0 and 2 * ({g('tox', 'na')} + {g('ord', 'nb')}) >= {EVIDENCE}").select("key", "tox", "ord"), "key")

    def by_number(table, key: str, columns: list[str]) -> dict:
        out = {c: np.zeros(size) for c in columns}
        for c in columns:
            out[c][table[key].astype(np.int64)] = table[c]
        return out

    return Models(numbers, by_number(after, "w", ["cont", "tox", "ord"]), by_number(before, "h", ["tox", "ord", "t_tox", "t_ord"]), tuple(most.values()), tuple(telling.values()))


def features(difference: float, n: int) -> tuple[float, float, float]:
    """Of the length-normalised difference: itself, per root of the length, and the whole difference bounded."""
    long = max(n, 20)
    whole = difference * n
    return 100.0 * whole / long, whole / long**0.5, max(-20.0, min(20.0, whole)) / 5


def fit_curve(rows: DataFrame, models, base: float) -> tuple[float, ...]:
    """Intercept and weights, none below 0, of the logistic curve over the features, by ridge Newton steps from the curve without rows.

    Classes are weighed to the base rate.
    """

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                w = words_of(text)
                tox, ordinary = models.value.log_likelihoods(w) if w else (0.0, 0.0)
                out.append(features(tox - ordinary, len(w)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in (zip(*out, strict=True) if out else ((), (), ())))], ["toxic", "a", "b", "c"])

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, a double, b double, c double")  # 2 * SAMPLE rows at most
    got = _columns(got, "toxic", "a", "b", "c")
    y = got["toxic"].astype(float)
    beta = np.array([log(max(base, 1e-6) / max(1 - base, 1e-6)), 0.0, 0.0, SLOPE])
    if len(y) == 0 or y.min() == y.max():
        return tuple(beta.tolist())
    centre, ridge, floor = beta.copy(), np.full(4, RIDGE), np.array([-np.inf, 0, 0, 0])
    x = np.column_stack([np.ones(len(y)), got["a"], got["b"], got["c"]])
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * (beta - centre)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        before, beta = beta, np.maximum(beta + np.clip(step, -3, 3), floor)
        if np.abs(beta - before).max() < 1e-8:
            break
    return tuple(beta.tolist())


class Scorer:
    """A text's score and its two length-normalised log-likelihoods."""

    def __init__(self, models: Models | None, beta: tuple[float, ...], base: float):
        self.models, self.beta, self.base = models, beta, base

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        words = words_of(text)
        if not words or self.models is None:
            return self.base, 0.0, 0.0
        tox, ordinary = self.models.log_likelihoods(words)
        z = self.beta[0] + sum(k * v for k, v in zip(self.beta[1:], features(tox - ordinary, len(words)), strict=True))
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z))))), tox, ordinary


def trained_scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The broadcast Scorer that docs and labels give."""
    rows, base = training_rows(docs, labels, sample)
    rows = staged(rows, "toxic-rows")
    sc = docs.sparkSession.sparkContext
    counted = train_models(rows.where("not fits"))
    if counted is None:
        return sc.broadcast(Scorer(None, (), base))
    beta = fit_curve(rows.where("fits"), sc.broadcast(counted), base)
    return sc.broadcast(Scorer(train_models(rows), beta, base))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, log_toxic and log_ordinary (length-normalised log-likelihoods), for each row of docs."""
    scorer = trained_scorer(docs, labels, sample)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "score", "predicted", "log_toxic", "log_ordinary"]

    def run(batches):
        for b in batches:
            got = [scorer.value(t) for t in b.column(2).to_pylist()]
            score, tox, ordinary = zip(*got, strict=True) if got else ((), (), ())
            doubles = [pa.array(x, pa.float64()) for x in (score, tox, ordinary)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), doubles[0], pa.array([int(s >= 0.5) for s in score], pa.int32()), *doubles[1:]], names)

    rows = docs.select("doc_id", (fold_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, log_toxic double, log_ordinary double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is 0.5 or more: the text is scored in the same scan, so no row has to be found again by its id."""
    scorer = trained_scorer(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([scorer.value(t)[0] < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels_of(spark, sf_dir))
