import hashlib
import itertools
import random
import zlib

import pytest

from tallyloom.llm import media


def test_chunks_are_the_payload_and_shared_passages_give_equal_chunks():
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(40_000))
    a, b = (media.chunks_of(media.payload_of(p + passage)[0]) for p in ("", "another start " * 9))
    assert b"".join(a) == media.payload_of(passage)[0]
    assert len(set(a) & set(b)) >= len(a) - 3
    assert all(len(c) <= media.MOST for c in a)


def test_rolling_hash_by_doubling_is_the_gear_recurrence():
    data = bytes(random.Random(1).randrange(256) for _ in range(4000))
    h, want = 0, []
    for i, x in enumerate(data):
        h = (2 * h + int(media._GEAR[x])) & 0xFFFF
        if h >> (16 - media.CUT_BITS) == 0:
            want.append(i + 1)
    ends, last = [], 0
    for p in want:
        if p - last >= media.LEAST:
            ends.append(p)
            last = p
    assert media.cuts_of(data)[:-1] == [e for e in ends if e < len(data)]


def brute(text):
    """What the contract asks of a text, from one payload and its cuts."""
    p, n = media.payload_of(text)
    chunks, at = [], 0
    for e in media.cuts_of(p):
        chunks.append(p[at:e])
        at = e
    form = b"TLMC" + len(chunks).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") + c for c in chunks)
    hist = [sum(1 for x in p if x >> 4 == k) for k in range(16)]
    steps = sum(abs(a - b) for a, b in itertools.pairwise(p))
    feature = f"chunks={len(chunks)};n={len(p)};sum={sum(p)};sq={sum(x * x for x in p)};steps={steps};hist=" + ",".join(map(str, hist))
    return n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_results_equal_brute_force(spark, tiny, odd, nothing):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(30_000))
    mixed = spark.createDataFrame([(i, f"{'own ' * (i % 3 * 300)}{i}{passage}") for i in range(12)], "doc_id long, text string").repartition(5)
    for docs in (odd, mixed, spark.read.parquet(f"{tiny}/documents.parquet")):
        got = sorted((r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in media.op3_media(docs).collect())
        assert got == sorted((r.doc_id or 0, *brute(r.text)) for r in docs.collect())
    assert media.op3_media(nothing).collect() == []


def test_a_chunk_is_stored_once(spark, odd):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(30_000))
    docs = spark.createDataFrame([(i, passage) for i in range(16)], "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(8)
    stored = media.store(docs)
    digests = [c.digest for r in stored.documents.collect() for c in r.own] + [r.digest for r in stored.chunks.collect()]
    assert len(digests) == len(set(digests)) == len({media.digest_of(c) for r in docs.collect() for c in media.chunks_of(media.payload_of(r.text)[0])})


def test_damage_is_found():
    chunk = b"x" * 576
    with pytest.raises(ValueError, match="missing from the media store"):
        media._facts(media.header_of(1), [media.digest_of(chunk)], {media.digest_of(chunk): media.stored_chunk(b"y")})
