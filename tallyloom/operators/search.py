"""Full-text search over an inverted index kept as a table.

Records are sorted by id over all machines, and a task numbers its own in blocks of BLOCK; what it writes is a row for each term of a block: the records' places as differences, how often
each has the term, and where, as differences again. So a common term is as many rows as there are blocks, no term is gathered anywhere, and a block's order
is the ids' order. Tags (paths, kinds, scopes) are terms with a prefix of their own. The table is laid out by a hash of the term, so a search reads only
the folders of its terms; it never sees a text. It evaluates each block for itself, and only the records of the page that is shown are fetched.

Null texts, tags and lists have no terms; null ids come first. Repeated ids are records of their own. An empty table has no blocks and no matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of a block; folders that terms are dealt into; words after which a block closes with fewer records.
BLOCK, FOLDERS, WORDS = 1024, 16, 1 << 22
#: The term that stands in every record; what is put before a tag.
ALL, TAG = "", "\x01"

_WORDS = re.compile(r"\w+")

Clause = tuple[bool, tuple[str, ...]]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORDS.findall((text or "").lower().replace("_", " "))


def web_query(query: str) -> list[list[Clause]]:
    """A web-style query as alternatives of clauses that must all hold: (wanted, words in a row). `or` stands between alternatives and binds less than words side by side;
    quotes hold words together, as a sign between letters does; a minus before a word or a quote asks for its absence. What has no word is passed over."""
    out: list[list[Clause]] = [[]]
    for part in re.findall(r'-?"[^"]*"?|\S+', query):
        if part.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        words = tuple(words_of(part))
        if words:
            out[-1].append((not part.startswith("-"), words))
    return [c for c in out if c]


def _folder(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(FOLDERS)).cast("int")


def _differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of lists that stand one after the other, each as its first value and the steps to the others."""
    steps = np.diff(values, prepend=0)
    steps[starts] = values[starts]
    return steps


def _postings(codes: np.ndarray, docs: np.ndarray, places: np.ndarray, n_terms: int) -> list[pa.Array]:
    """docs, counts and places of terms 0, 1, ... from the block's words in order of records and places: all lists at once, as parts of three buffers."""
    by = np.argsort(codes, kind="stable")
    codes, docs, places = codes[by], docs[by], places[by]
    new_term = np.diff(codes, prepend=-1) != 0
    pairs = np.flatnonzero(new_term | (np.diff(docs, prepend=-1) != 0))  # where a record's places of a term begin
    per_pair = np.diff(pairs, append=len(codes))
    first_pairs = np.flatnonzero(new_term[pairs])
    pairs_of, words_of_term = np.bincount(codes[pairs], minlength=n_terms), np.bincount(codes, minlength=n_terms)

    def lists(values: np.ndarray, kind: str, lengths: np.ndarray) -> pa.Array:
        data = values.astype(kind)
        offsets = np.concatenate(([0], np.cumsum(lengths))) * data.itemsize
        return pa.BinaryArray.from_buffers(pa.binary(), n_terms, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

    return [lists(_differences(docs[pairs], first_pairs), "<u2", pairs_of), lists(per_pair, "<u4", pairs_of), lists(_differences(places, pairs), "<u4", words_of_term)]


def _restored(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What _differences was given, flat."""
    sums = np.cumsum(steps)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    return sums - np.repeat(sums[starts] - steps[starts], counts)


def write_index(records: DataFrame, root: str, key: str, text: str, tags: str | None = None, size: int = BLOCK) -> None:
    """Writes the index of records to a new folder. tags: a column of strings (array), each with a prefix that says of what kind it is. size: records of a block."""
    id_type = dict(records.dtypes)[key]
    tag_column = F.coalesce(F.col(tags).cast("array<string>"), F.array().cast("array<string>")) if tags else F.array().cast("array<string>")
    ordered = records.select(F.col(key).alias("id"), F.col(text).alias("text"), tag_column.alias("tags")).repartitionByRange("id").sortWithinPartitions("id")

    names = ["term", "block", "docs", "counts", "places", "ids"]

    def rows(block: int, ids: list, vocabulary: dict[str, int], found: list[np.ndarray], at: list[np.ndarray], kind: pa.DataType):
        every = np.ones(len(ids), "<u2")
        every[0] = 0
        nothing = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([ALL]), pa.array([block], pa.int64()), pa.array([every.tobytes()], pa.binary()), nothing, nothing, pa.array([ids], pa.list_(kind))], names)
        terms = sorted(vocabulary)
        if not terms:
            return
        rank = np.empty(len(terms), np.int64)
        rank[[vocabulary[t] for t in terms]] = np.arange(len(terms))
        docs = np.repeat(np.arange(len(ids)), [len(x) for x in found])
        lists = _postings(rank[np.concatenate(found)], docs, np.concatenate(at), len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(len(terms), block, np.int64)), *lists, pa.nulls(len(terms), pa.list_(kind))], names)

    def run(batches):
        block, kind, vocabulary, ids, found, at, words = TaskContext.get().partitionId() << 32, None, defaultdict(count().__next__), [], [], [], 0
        for b in batches:
            kind = b.schema.field(0).type
            for i, t, tag in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                own = words_of(t)
                tagged = {TAG + x for x in tag if x is not None}
                ids.append(i)
                found.append(np.fromiter(map(vocabulary.__getitem__, chain(own, tagged)), np.int64, len(own) + len(tagged)))
                at.append(np.concatenate((np.arange(len(own)), np.zeros(len(tagged), np.int64))))
                words += len(own)
                if len(ids) == size or words >= WORDS:
                    yield from rows(block, ids, vocabulary, found, at, kind)
                    block, vocabulary, ids, found, at, words = block + 1, defaultdict(count().__next__), [], [], [], 0
        if ids:
            yield from rows(block, ids, vocabulary, found, at, kind)

    schema = f"term string, block long, docs binary, counts binary, places binary, ids array<{id_type}>"
    ordered.mapInArrow(run, schema).withColumn("folder", _folder(F.col("term"))).write.partitionBy("folder").option("compression", "zstd").parquet(root)


class _Block:
    """The postings of one block that a search has asked for."""

    def __init__(self, terms: list, docs: list, counts: list, places: list):
        self.rows = {t: (np.cumsum(np.frombuffer(d, "<u2")).astype(np.int64), c, p) for t, d, c, p in zip(terms, docs, counts, places, strict=True)}
        self.nothing = np.empty(0, np.int64)

    def docs(self, term: str) -> np.ndarray:
        return self.rows[term][0] if term in self.rows else self.nothing

    def phrase(self, words: tuple[str, ...]) -> np.ndarray:
        """Records in which the words follow each other."""
        if len(words) == 1 or any(w not in self.rows for w in words):
            return self.docs(words[0]) if len(words) == 1 else self.nothing
        ends = None
        for i, w in enumerate(words):
            docs, counts, places = self.rows[w]
            n = np.frombuffer(counts, "<u4").astype(np.int64)
            at = np.repeat(docs, n) << 32 | (_restored(np.frombuffer(places, "<u4").astype(np.int64), n) - i + len(words))
            ends = at if ends is None else np.intersect1d(ends, at, assume_unique=True)
        return np.unique(ends >> 32)

    def matches(self, query: list[list[Clause]], any_of: list[list[str]]) -> np.ndarray:
        """Records for which an alternative of the query holds (any, if it has none) and that have one of each list of tags."""
        found = self.docs(ALL) if not query else self.nothing
        for clauses in query:
            wanted = [self.phrase(words) for yes, words in clauses if yes]
            held = wanted[0] if wanted else self.docs(ALL)
            for w in wanted[1:]:
                held = np.intersect1d(held, w, assume_unique=True)
            for yes, words in clauses:
                if not yes:
                    held = np.setdiff1d(held, self.phrase(words), assume_unique=True)
            found = np.union1d(found, held)
        for tags in any_of:
            has = np.unique(np.concatenate([self.docs(TAG + t) for t in tags]))
            found = np.intersect1d(found, has, assume_unique=True)
        return found


def search(spark: SparkSession, root: str, query: str, any_of: list[list[str]] | None = None) -> DataFrame:
    """(block, place) of every record that matches. any_of: of each of these lists of tags a record has to have one; empty lists ask for nothing."""
    parsed, lists = web_query(query), [x for x in any_of or [] if x]
    terms = {w for clauses in parsed for _, words in clauses for w in words} | {TAG + t for tags in lists for t in tags}
    if not parsed or any(not any(yes for yes, _ in clauses) for clauses in parsed):
        terms.add(ALL)  # where nothing is wanted, all records are to be looked at
    folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in sorted(terms)], "t string").select(_folder(F.col("t"))).collect()})
    asked = spark.read.parquet(root).where(F.col("folder").isin(folders) & F.col("term").isin(sorted(terms))).select("block", "term", "docs", "counts", "places")

    def run(key, table):
        found = _Block(*(table.column(c).to_pylist() for c in ("term", "docs", "counts", "places"))).matches(parsed, lists)
        return pa.table({"block": pa.array([key[0].as_py()] * len(found), pa.int64()), "place": pa.array(found, pa.int64())})

    return asked.groupBy("block").applyInArrow(run, "block long, place long")


def matched_page(spark: SparkSession, root: str, matches: DataFrame, offset: int, limit: int) -> DataFrame:
    """id, total and next_offset of the page's matches, in the order of ids; at most 20 of them."""
    if not 1 <= limit <= 20 or offset < 0:
        raise ValueError("limit must be 1 to 20 and offset 0 or more")
    total = matches.count()
    shown = matches.orderBy("block", "place").offset(offset).limit(limit)
    ids = spark.read.parquet(root).where((F.col("folder") == _folder(F.lit(ALL))) & (F.col("term") == ALL)).select("block", "ids")
    named = ids.join(F.broadcast(shown), "block").select(F.expr("element_at(ids, cast(place + 1 as int))").alias("id"))  # a page has 20 rows at most
    return named.withColumns({"total": F.lit(total).cast("long"), "next_offset": F.lit(offset + limit if offset + limit < total else None).cast("long")})
