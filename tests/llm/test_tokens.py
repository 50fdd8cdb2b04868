import zlib

import numpy as np

from tallyloom.llm import packing, token_counts
from tallyloom.llm.tokens import IdCache, LengthCache, tokenizer

HARD = ["a <|endoftext|> b", "a<|endoftext|>  b", "x\x1cy  z q\tfoo\n\n bar\n baz \nq \n", "I'll  don't\n's é ́a", "", "  ", "\n", " a", "\0 a b", "日本 語", "a \n", "\na", "<|STARTOFTEXT|> a", "İx ΣΑΣ", "ab, cd.. ef., gh_, i. \n. j", "ßtraße ŉ ǆ ª µ º aº éx ÀÉ œuvre", "x" * 5000]


def test_units_give_the_librarys_ids():
    c, t = IdCache("word_bpe_49k.json", 20), tokenizer("word_bpe_49k.json")
    for _ in range(2):
        for text, ids in zip(HARD, c.encode(HARD), strict=True):
            assert np.frombuffer(ids, c.kind).tolist() == t.encode(text, add_special_tokens=False).ids


def test_two_tiers_give_the_librarys_counts():
    t = tokenizer("byte_bpe_50k.json")
    for frequent in ({}, {" b": 1, "a": 1}):
        assert LengthCache("byte_bpe_50k.json", frequent).counts(HARD) == [len(t.encode(x, add_special_tokens=False).ids) for x in HARD]


def test_counts_of_odd_rows(spark, odd, nothing):
    t = tokenizer("byte_bpe_50k.json")
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd).collect())
    texts = [r.text or "" for r in odd.collect()]
    want = sorted((len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for x in texts)
    assert got == want
    assert token_counts.count_tokens(nothing).collect() == []


def test_packing_is_gapless_and_whole(spark, odd, nothing):
    t = tokenizer("word_bpe_49k.json")
    pieces = packing.pack(odd, length=64).collect()
    by_seq: dict = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for k, ps in by_seq.items():
        ps.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in ps]).tolist()
        assert [p.offset for p in ps] == [0, *ends[:-1]] and (ends[-1] == 64 or k == max(by_seq))
    want = sorted(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect())
    joined, got = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        joined += np.frombuffer(p.ids, f"<u{p.width}").tolist()
        if p.start + p.length == p.doc_tokens:
            got.append(tuple(joined))
            joined = []
    assert sorted(got) == want
    assert packing.op1_packing(nothing).collect() == []


def test_digest_of_pieces(spark, odd):
    for p in packing.digests(packing.pack(odd.where("doc_id = 6"))).collect():
        ids = tokenizer("word_bpe_49k.json").encode("one two", add_special_tokens=False).ids + [2]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_documents_equal_the_library(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    t = tokenizer("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.op4_token_counts(docs.repartition(5)).collect()}
    assert got == {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}
    t, pieces = tokenizer("word_bpe_49k.json"), {}
    for p in packing.op1_packing(docs.repartition(5)).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert pieces.keys() == texts.keys()
    for i, x in texts.items():
        ids, at = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)


def test_texts_without_blanks_are_kept_nowhere():
    rnd = np.random.default_rng(1)
    texts = ["".join(chr(0x4E00 + int(x)) for x in rnd.integers(0, 3000, 5000)) for _ in range(40)] + ["A1" * 500_000, "z" * 65, "z" * 64]
    ids, t = IdCache("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    ids.known.clear()
    ids.known[""] = b""
    assert [len(x) // np.dtype(ids.kind).itemsize for x in ids.encode(texts[:3])] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts[:3]]
    ids.encode(texts)
    assert sum(len(u) + len(v) for u, v in ids.known.items()) < 2000
    lengths, t = LengthCache("byte_bpe_50k.json", {}), tokenizer("byte_bpe_50k.json")
    lengths.own.clear()
    assert lengths.counts(texts[-4:]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts[-4:]]
    assert sum(map(len, lengths.own)) < 2000


def test_long_units_are_in_no_table(spark):
    docs = spark.createDataFrame([(i, "q" * 70_000 + " common " + "é" * 65) for i in range(20)], "doc_id long, text string").repartition(4)
    table = token_counts.frequent_units(docs, "byte_bpe_50k.json")
    assert set(table) == {" common"}
