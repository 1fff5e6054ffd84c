"""Target-distribution importance resampling: draws documents by how much likelier their words and word pairs are in a target than in the corpus.

Features are runs of one and two words, hashed by CRC-32 into buckets. The vocabulary has a head and a tail. The head is broadcast: the frequent words with their exact CRC
states (after the word, and after the word and a space, from which a pair's CRC continues) and the frequent pairs with their buckets, found by one probe of a table. Features of
the tail take their CRC directly. Both ways give the same bucket, so what is in the head decides the speed only; every feature of every document enters the exact bucket totals.
"""
import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.operators.ranking import positions

#: A-Z to a-z; every byte outside of 0-9, a-z and 0x80-0xFF to a space.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
CHUNK = 1 << 18


def words_of(text) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _chunks(texts):
    """(first row, words, ends) of consecutive texts with about CHUNK words; `ends` are the places behind each text's last word."""
    first, words, ends = 0, [], []
    for row, text in enumerate(texts):
        words += words_of(text)
        ends.append(len(words))
        if len(words) >= CHUNK:
            yield first, words, np.array(ends)
            first, words, ends = row + 1, [], []
    if ends:
        yield first, words, np.array(ends)


def _firsts(n, ends):
    """Places of the words that another word of the same text follows."""
    followed = np.ones(n, bool)
    followed[ends[ends > 0] - 1] = False
    return np.flatnonzero(followed)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _count(longest):
    """Counts of words, and of the pairs that make up at least a 65536th of a chunk's: candidates for the head, of at most `longest` bytes."""
    def run(batches):
        for batch in batches:
            for _, words, ends in _chunks(batch.column(0).to_pylist()):
                number = _Numbers()
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                names = [w if len(w) <= longest else None for w in number]
                n = np.bincount(ids, minlength=len(names))
                at = _firsts(len(ids), ends)
                code, times = np.unique(ids[at] * len(names) + ids[at + 1], return_counts=True)
                code, times = (x[times >= max(2, len(at) >> 16)] for x in (code, times))
                one = [i for i, w in enumerate(names) if w is not None]
                two = [(names[c // len(names)], names[c % len(names)], t) for c, t in zip(code.tolist(), times.tolist())]
                two = [p for p in two if p[0] is not None and p[1] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in one] + [p[0] for p in two], pa.binary()), pa.array([None] * len(one) + [p[1] for p in two], pa.binary()),
                                                  pa.array(n[one].tolist() + [p[2] for p in two], pa.int64())], ["word", "after", "n"])
    return run


class Head:
    """Frequent words with their CRC states, and a table of frequent pairs, which keeps the more frequent one where two want the same slot."""

    def __init__(self, words, pairs, buckets: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.buckets = buckets
        self.state = np.array([zlib.crc32(w) for w in words] or [0], np.int64)
        self.spaced = np.array([zlib.crc32(w + b" ") for w in words] or [0], np.int64)
        self.size = max(len(words), 1)
        self.bits = max(4, int(max(len(pairs), 1)).bit_length() + 2)
        self.codes, self.found = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for a, b in reversed(pairs):
            if a in self.number and b in self.number:
                code = np.int64(self.number[a] * self.size + self.number[b])
                slot = self._slot(code)
                self.codes[slot], self.found[slot] = code, zlib.crc32(a + b" " + b) % buckets

    def _slot(self, code):
        return (code * np.int64(0x9E3779B1) >> np.int64(7)) & np.int64((1 << self.bits) - 1)

    def features(self, words, ends):
        """(bucket of every word, places of the words that start a pair, bucket of every pair)."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        tail = np.flatnonzero(ids < 0)
        state = self.state[ids]
        state[tail] = [zlib.crc32(words[i]) for i in tail.tolist()]
        at = _firsts(len(words), ends)
        a, b = ids[at], ids[at + 1]
        code = a * self.size + b
        slot = self._slot(code)
        known = (a >= 0) & (b >= 0) & (self.codes[slot] == code)
        pair = self.found[slot]
        left = np.flatnonzero(~known)
        spaced = self.spaced[a[left]]
        new = np.flatnonzero(a[left] < 0)
        spaced[new] = [zlib.crc32(b" ", s) for s in state[at[left[new]]].tolist()]
        pair[left] = [zlib.crc32(words[i + 1], s) % self.buckets for i, s in zip(at[left].tolist(), spaced.tolist())]
        return state % self.buckets, at, pair


def _texts(df):
    return df.select(F.col("text").cast("binary").alias("text"))


def head_of(docs: DataFrame, buckets: int, share: int = 1 << 17, longest: int = 64) -> Head:
    """The head of a corpus: words, and pairs of words, of at most `longest` bytes that make up one in `share` of all of them. There can be no more than `share` of each, whatever the corpus."""
    counted = saved(_texts(docs).mapInArrow(_count(longest), "word binary, after binary, n long").groupBy("word", "after").agg(F.sum("n").alias("n")))
    total = counted.filter("after is null").agg(F.sum("n")).first()[0] or 0
    found = [(-r["n"], bytes(r["word"]), r["after"] and bytes(r["after"])) for r in counted.filter(F.col("n") * share >= total).collect()]
    found.sort(key=lambda x: (x[0], x[1], x[2] or b""))
    return Head([w for _, w, after in found if after is None], [(w, after) for _, w, after in found if after is not None], buckets)


def _totals(head):
    def run(batches):
        total = np.zeros(head.buckets, np.int64)
        for batch in batches:
            for _, words, ends in _chunks(batch.column(0).to_pylist()):
                one, _, two = head.features(words, ends)
                total += np.bincount(one, minlength=head.buckets) + np.bincount(two, minlength=head.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])
    return run


def bucket_totals(docs: DataFrame, head: Head) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that holds any. A task sums its own before the shuffle."""
    return _texts(docs).mapInArrow(_totals(head), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict, target: dict, buckets: int) -> np.ndarray:
    """Per bucket, floor(1000 ln) of the target's smoothed share over the corpus's, from counts per bucket."""
    s, t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], np.int64)


def _weigh(head, gain):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, words, ends in _chunks(texts):
                one, at, two = head.features(words, ends)
                each = gain[one]
                each[at] += gain[two]
                run_sum = np.concatenate([[0], np.cumsum(each)])
                begins = np.concatenate([[0], ends[:-1]])
                n = ends - begins
                rows = slice(first, first + len(ends))
                n_words[rows], n_features[rows] = n, np.maximum(2 * n - 1, 0)
                weight[rows] = (run_sum[ends] - run_sum[begins]) // np.maximum(2 * n - 1, 1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])
    return run


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10000, share: int = 1 << 17) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per row of `docs`; weight is the floored mean gain of its features (none: 0).

    Words are compared with A-Z lower-cased. Null and empty texts have no features; null ids and repeated rows are kept; other columns are ignored; an empty target or corpus
    counts no features. Collected to the driver are only `buckets` totals of each table and the head.
    """
    head = head_of(docs, buckets, share)
    corpus, wanted = ({r["bucket"]: r["n"] for r in bucket_totals(df, head).collect()} for df in (docs, target))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_weigh(head, gains(corpus, wanted, buckets)), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10000, **head) -> DataFrame:
    """doc_id, n_features, weight, score, rank, drawn: every document, and which ones a draw of `percent` percent without replacement takes.

    A score is the weight plus 1000 times Gumbel noise from the seeded hash of the id, so the highest scores are a draw by weight; ties go to the smaller id (null last). Documents
    under `least_words` words are never drawn and their rank is null, as for the others that are not drawn. A null id hashes as an empty one. Rows that share an id share their noise.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = saved(importance(docs, target, buckets, **head).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = positions(rows.filter(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")])
    rank = F.when(F.col("position") < F.floor(F.col("group_n") * percent / 100), F.col("position") + 1).cast("long").alias("rank")
    cols = ["doc_id", "n_features", "weight", "score"]
    out = able.select(*cols, rank).unionByName(rows.filter(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank")))
    return out.withColumn("drawn", F.col("rank").isNotNull())
