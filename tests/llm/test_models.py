import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import hmm, toxicity


def model(states=2, symbols=3):
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))))


def paths(m, s):
    """Each path of states with its probability together with the symbols."""
    for path in itertools.product(range(len(m.start)), repeat=len(s)):
        yield path, m.start[path[0]] * m.emit[path[0], s[0]] * math.prod(m.move[a, b] * m.emit[b, x] for a, b, x in zip(path, path[1:], s[1:], strict=False))


@pytest.mark.parametrize("tokens", [1, 3, 100])
def test_forward_equals_the_sum_over_all_paths(tokens):
    m = model()
    seqs = [np.array([0, 1, 2, 2, 0]), np.array([1, 0]), np.array([2])]
    got = hmm.likelihoods(m, np.ascontiguousarray(m.emit.T), seqs, tokens)
    assert got == pytest.approx([math.log10(sum(p for _, p in paths(m, s))) for s in seqs])


@pytest.mark.parametrize("tokens", [1, 3, 100])
def test_expected_counts_equal_the_sum_over_all_paths(tokens):
    m, seqs = model(), [np.array([0, 2, 1, 1, 0]), np.array([2, 2, 1]), np.array([1])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    log = hmm.expected(m, np.ascontiguousarray(m.emit.T), seqs, start, move, emit, tokens)
    w_start, w_move, w_emit, w_log = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for s in seqs:
        total = sum(p for _, p in paths(m, s))
        w_log += math.log10(total)
        for path, p in paths(m, s):
            w_start[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                w_move[a, b] += p / total
            for a, x in zip(path, s, strict=True):
                w_emit[x, a] += p / total
    assert log == pytest.approx(w_log)
    for got, want in ((start, w_start), (move, w_move), (emit, w_emit)):
        assert np.allclose(got, want)


def brute_scores(rows, symbols):
    """Each row's score by plain loops: counts, symbols, Baum-Welch of one sequence and one time after the other, and the forward sum."""
    import zlib

    trains = [(zlib.crc32(str(d).encode()) if d is not None else 0) % 5 != 1 for d, _ in rows]
    texts = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for words, t in zip(texts, trains, strict=True) if t for w in words)
    own = sorted(counts, key=lambda w: (-counts[w], w))[:symbols]
    bucket = lambda w: zlib.crc32(w[-2:]) % hmm.BUCKETS
    tokens, types = [0] * hmm.BUCKETS, [0] * hmm.BUCKETS
    for w in counts.keys() - set(own):
        tokens[bucket(w)] += counts[w]
        types[bucket(w)] += 1
    mass = [n + 0.5 * (k + 1) for n, k in zip(tokens, types, strict=True)]
    seqs = [[*(own.index(w) if w in own else len(own) + bucket(w) for w in words), len(own) + hmm.BUCKETS] for words in texts]
    size, n = len(own) + hmm.BUCKETS + 1, hmm.STATES
    share = np.array([*(counts[w] + 0.5 for w in own), *mass, sum(trains) + 0.5])
    emit = share * (np.random.default_rng(17).random((n, size)) + 0.5)
    emit /= emit.sum(1, keepdims=True)
    base, start, move, last = emit.mean(0), np.full(n, 1 / n), np.full((n, n), 0.2 / n) + 0.8 * np.eye(n), None
    for _ in range(hmm.ROUNDS):
        c_start, c_move, c_emit, log = np.full(n, hmm.SMOOTH[0]), np.full((n, n), hmm.SMOOTH[0]), np.tile(hmm.SMOOTH[1] * size * base, (n, 1)), 0.0
        for s in (s for s, t in zip(seqs, trains, strict=True) if t):
            f = [start * emit[:, s[0]]]
            for x in s[1:]:
                f.append(f[-1] / f[-1].sum() @ move * emit[:, x])
            log += sum(math.log10(x.sum()) for x in f)
            b = [np.ones(n)]
            for x in reversed(s[1:]):
                y = move @ (emit[:, x] * b[0])
                b.insert(0, y / y.sum())
            post = [x * y / (x @ y) for x, y in zip(f, b, strict=True)]
            c_start += post[0]
            for t, x in enumerate(s):
                c_emit[:, x] += post[t]
                if t:
                    pair = f[t - 1][:, None] * move * (emit[:, x] * b[t])[None, :]
                    c_move += pair / pair.sum()
        start, move, emit = c_start / c_start.sum(), c_move / c_move.sum(1, keepdims=True), c_emit / c_emit.sum(1, keepdims=True)
        if last is not None and log - last < hmm.GAIN * abs(last):
            break
        last = log
    out = []
    for s, words in zip(seqs, texts, strict=True):
        a, log = start * emit[:, s[0]], 0.0
        for x in s[1:]:
            log += math.log10(a.sum())
            a = a / a.sum() @ move * emit[:, x]
        out.append(log + math.log10(a.sum()) + sum(math.log10((counts[w] + 0.5) / mass[bucket(w)]) for w in words if w not in own))
    return out


@pytest.mark.parametrize("frequent", [150_000, 40])
def test_scores_equal_brute_force_at_any_partitioning(spark, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "SYMBOLS", 25)
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{min(int(rng.zipf(1.4)), 300)}" for k in range(int(rng.integers(0, 60))))) for i in range(60)] + [(None, "Alone there"), (3, None), (4, "")]
    want = sorted(zip([i or 0 for i, _ in rows], brute_scores(rows, 25), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        got = sorted((r.doc_id or 0, r.score) for r in hmm.score_texts(df.repartition(parts)).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-6)


def test_base_score_equals_brute_force(spark, odd, nothing):
    rows = odd.selectExpr("doc_id", "text", "part").collect()
    import zlib

    trains = lambda d: (zlib.crc32(str(d).encode()) if d is not None else 0) % 5 != 1
    counts: dict = {}
    for r in rows:
        if trains(r.doc_id):
            for w in [*hmm.words_of(r.text), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((len(w := [*hmm.words_of(r.text), None]), sum(x in counts for x in w), total, round(sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for r in rows)
    got = hmm.score_texts(odd).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_texts(nothing).collect() == []


def test_hmm_beats_the_base_on_held_out_text(spark, tiny):
    from tallyloom.llm.common import documents

    got = hmm.score_texts(documents(spark, tiny)).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def corpus(spark):
    rng = np.random.default_rng(7)
    common = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, 40))
        toxic = i % 5 == 0
        if toxic:
            words[int(rng.integers(40))] = rng.choice(["scoundrel", "villain"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got.score.between(0, 1).all()


def test_toxicity_of_odd_rows_and_without_labels(spark, odd, nothing):
    docs, labels = corpus(spark)
    more = docs.unionByName(odd.select("doc_id", "text"))
    got = toxicity.score_toxicity(more, labels.union(spark.createDataFrame([(None, 1), (7777, None)], "doc_id long, toxic int")))
    assert got.count() == 611 and got.where("score is null or predicted is null").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(odd, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(nothing, labels).collect() == []
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def brute_models(rows):
    """P(word | head) under both models and the texts' log-likelihoods, with dictionaries and sums over the whole vocabulary."""
    D = toxicity.DISCOUNT
    sets = [(t, set(hmm.words_of(x))) for t, x in rows]
    seen = Counter(w for _, ws in sets for w in ws)
    vocabulary = {w for w, n in seen.items() if n >= toxicity.WORD_COUNT}
    coded = [(t, [w if w in vocabulary else None for w in hmm.words_of(x)]) for t, x in rows]
    pairs = Counter((t, *p) for t, ws in coded for p in set(zip([None, *ws], ws, strict=False)))
    n = lambda c, h, w: sum(pairs[t, h, w] for t in ((1, 0) if c is None else (c,)))
    every = sorted({(h or b"", w or b"") for _, h, w in pairs})
    every = [(h or None, w or None) for h, w in every]
    symbols = sorted({w for _, w in every}, key=lambda w: w or b"")
    heads = {h for h, _ in every}
    below = {w: sum(1 for _, x in every if x == w) / len(every) for w in symbols}
    total = {(c, h): sum(n(c, h, w) for w in symbols) for c in (0, 1, None) for h in [*heads, *symbols]}
    types = {(c, h): sum(n(c, h, w) > 0 for w in symbols) for c in (0, 1) for h in heads}
    word = {(c, w): sum(n(c, h, w) for h in heads) for c in (0, 1, None) for w in symbols}
    size = {c: sum(word[c, w] for w in symbols) for c in (0, 1, None)}

    def shared(h, w):
        kept = [x for x in symbols if n(None, h, x) >= toxicity.PAIR_COUNT]
        whole = max(total[None, h], 1)
        left = 1 - sum(n(None, h, x) - D for x in kept) / whole
        return (n(None, h, w) - D) / whole * (w in kept) + left * below[w]

    def kn(count, whole, kinds, rest):
        return (max(count - D, 0) + D * kinds * rest) / whole if whole else rest

    def tells(a, b, na, nb):
        rate = (a + b) / max(na + nb, 1)
        return 2 * sum(x * math.log(x / (rate * m)) for x, m in ((a, na), (b, nb)) if x) >= toxicity.EVIDENCE

    own = {(c, w): kn(word[c, w], size[c], sum(word[c, x] > 0 for x in symbols), below[w]) for c in (0, 1, None) for w in symbols}
    sure = {w for w in symbols if w is not None and tells(word[1, w], word[0, w], size[1], size[0])}
    of_word = {(c, w): own[c, w] / own[None, w] if w in sure else 1.0 for c in (0, 1) for w in symbols}
    p = {}
    for h in heads:
        factors = {}
        for w in symbols:
            f = {c: of_word[c, w] for c in (0, 1)}
            if h is not None and w is not None and n(None, h, w) >= toxicity.PAIR_COUNT and total[1, h] and total[0, h] and tells(n(1, h, w), n(0, h, w), total[1, h], total[0, h]):
                g = {c: kn(n(c, h, w), total[c, h], types[c, h], own[c, w] if w in sure else below[w]) / shared(h, w) for c in (0, 1)}
                if abs(math.log(g[1] / g[0])) >= abs(math.log(f[1] / f[0])):
                    f = g
            factors[w] = f
        for c in (0, 1):
            whole = sum(factors[w][c] * shared(h, w) for w in symbols)
            for w in symbols:
                p[c, h, w] = factors[w][c] * shared(h, w) / whole
    logs = [tuple(sum(math.log(p[c, h, w]) for h, w in zip([None, *ws], ws, strict=False)) / len(ws) for c in (1, 0)) for _, ws in coded]
    return vocabulary, heads, p, logs, sure


def test_both_models_equal_brute_force_and_sum_to_one(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(160):
        toxic = i % 4 == 0
        words = [f"w{int(k)}" for k in rng.zipf(1.6, 25) if k < 40]
        at = int(rng.integers(len(words)))
        words[at : at + 1] = ["vile", str(rng.choice(["toad", "w1"]))] if toxic else ["kind", str(rng.choice(["toad", "w1"]))] if i % 3 else ["toad"]
        rows.append((int(toxic), " ".join(words)))
    vocabulary, heads, p, logs, sure = brute_models(rows)
    assert {b"vile", b"kind"} <= sure and len(sure) < 8
    models = toxicity.train_models(spark.createDataFrame(rows, "toxic int, text string").repartition(3))
    assert set(models.numbers.number) == vocabulary and len(models.telling) > 0
    assert np.allclose([models.log_likelihoods(hmm.words_of(t)) for _, t in rows], logs)
    name = {i: w for w, i in models.numbers.number.items()}
    size = models.numbers.size
    for h in range(size):
        keys = h * size + np.arange(size)
        at = toxicity._find(models.telling, keys)
        for c, one in ((1, "tox"), (0, "ord")):
            factor = np.where(at >= 0, models.log_pair[one][at], models.log_word[one])
            got = models.shared(keys) * np.exp(factor - models.log_scale[one][h])
            assert got.sum() == pytest.approx(1)
            if name.get(h) in heads:
                assert got == pytest.approx([p[c, name.get(h), name.get(w)] for w in range(size)])


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs, labels = corpus(spark)
    one, seven = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs.repartition(n), labels).collect()) for n in (1, 7))
    assert [d for d, _ in one] == [d for d, _ in seven] and [x for _, x in one] == pytest.approx([x for _, x in seven])


def test_only_equal_sets_are_one_training_row_with_its_own_label(spark):
    passage = " ".join(f"common{k}" for k in range(200))
    own = [" ".join(f"own{i}x{k}" for k in range(30)) for i in range(60)]
    rows = [(i, f"{passage} {own[i]}") for i in range(60)] + [(100 + i, f"{own[i]} and then") for i in range(60)] + [(200 + i, f"{own[i].upper()} AND then") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels.union(spark.createDataFrame([(0, 2), (1, -1), (2, None)], "doc_id long, toxic int"))  # no labels
    got = [(r.toxic, r.text) for r in toxicity.training_rows(docs, labels)[0].collect()]
    trains = {r.doc_id for r in labels.where(toxicity.fold_of(toxicity.F.col("doc_id")) % 5 != 0).collect()}
    want = {}
    for i, t in rows:
        if i in trains:
            want.setdefault(t.lower(), []).append((-int(i % 3 == 0), t))
    assert sorted(got) == sorted((-c, t) for c, t in map(min, want.values()))
