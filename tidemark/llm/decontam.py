"""Benchmark decontamination: windows of a document within edit distance of a benchmark item.

Words are compared, A-Z lower-cased and without ASCII punctuation; an item of n words allows floor(0.2 n) word edits (a similarity of 0.8), items of under six words none.

Candidates come from an LSH over CGK random walks. A walk over a window of words repeats a word or goes on to the next by a random bit of (walk, step, word), so that after an edit the walks
of two windows can fall into step again and their Hamming distance follows the edit distance. An item is entered by windows from several of its words on (anchors, the rarer ones first),
each under several independent walks; a key is the anchor and the words a walk shows at sampled steps, all of them before the window's end. A document's windows start where a word is an
anchor of some item, and meet item keys by equality. Every candidate is decided by the exact edit distance between the item and the region it points to (a bit-parallel automaton).

`anchors`, `tables` and `sampled` are set for a recall of at least 0.95 at the limit of edits for items of any length (measured in the tests); copies without edits are always found. With
`exact` an index of three-word runs takes the place of the LSH, which by the pigeonhole principle misses nothing.
"""
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.operators.ranking import positions

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RUN = 3


def words_of(text: bytes) -> list[bytes]:
    return (text or b"").translate(LOWER, PUNCTUATION).split()


def allowed(n: int, similarity: float = 0.8) -> int:
    """Word edits an item of n words allows."""
    return int(n * (1 - similarity) + 1e-9) if n >= 6 else 0


def best_distance(item: list, region: list) -> int:
    """Least edit distance between the item and any run of the region's words (Myers' bit-vector search, any length)."""
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    peq: dict = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score = full, 0, n
    best = n
    for w in region:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


class Runs:
    """Exact candidates: an item within its distance keeps three words in a row (all its words, if it has fewer) unedited."""

    def __init__(self, items, size):
        self.size = size
        runs = {}
        for i, (_, w, _) in enumerate(items):
            width = min(RUN, len(w))
            for o in range(len(w) - width + 1):
                runs.setdefault(self._code(*(w[o:o + width] + [0] * (RUN - width))), []).append((i, o))
        self.runs = runs
        self.codes = {k: np.array(sorted(c for c in runs if self._width(c) == k), np.int64) for k in (1, 2, 3)}

    def _code(self, a, b=0, c=0):
        return (a * self.size + b) * self.size + c

    def _width(self, code):
        return 3 if code % self.size else 2 if code // self.size % self.size else 1

    def candidates(self, numbers):
        """(row, item, start of the item in the row) as a dict without values."""
        asked = {}
        for row, ids in enumerate(numbers):
            for width in (1, 2, 3):
                codes = self.codes[width]
                if not len(codes) or len(ids) < width:
                    continue
                part = [ids[k:len(ids) - width + 1 + k] for k in range(width)] + [0] * (RUN - width)
                live = np.flatnonzero(np.logical_and.reduce([p > 0 for p in part[:width]]))
                if not len(live):
                    continue
                code = (part[0] * self.size + part[1]) * self.size + part[2]
                code = code[live]
                found = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
                for p, c in zip(live[found].tolist(), code[found].tolist()):
                    for item, offset in self.runs[c]:
                        asked[row, item, p - offset] = None
        return asked


class Walks:
    """LSH candidates: sampled steps of CGK walks from anchor words on. A class of windows (`REACH` words) has its own steps, as many as twice its words, the walk's expected length."""

    REACH = (6, 4, 1)  # the longest that is left from the anchor to the item's end; 1 for items of a word or the last resort

    def __init__(self, items, size, anchors=8, tables=8, sampled=3, seed=7):
        rng = np.random.default_rng(seed)
        most = 2 * max(self.REACH)
        self.bits = np.stack([rng.integers(0, 2, size, dtype=np.int64) for _ in range(tables * most)]).reshape(tables, most, size)
        self.steps = {c: [sorted(rng.choice(np.arange(1, 2 * reach), min(sampled, 2 * reach - 1), replace=False).tolist()) for _ in range(tables)] for c, reach in enumerate(self.REACH)}
        self.tables = tables
        self.starts = np.zeros((len(self.REACH), size), bool)  # per class, the words that windows start with
        counts = np.bincount(np.concatenate([np.array(w, np.int64) for _, w, _ in items]), minlength=size) if items else np.zeros(size)
        entries = {c: [] for c in range(len(self.REACH))}
        for i, (_, w, edits) in enumerate(items):
            longest = next(r for r in self.REACH if r <= len(w))
            places = range(len(w) - (4 if len(w) >= 6 else longest) + 1)
            chosen = sorted(places, key=lambda j: (counts[w[j]], w.index(w[j]) != j, (j * 7919 + i) % 101))[:anchors if edits else 1]
            for j in chosen:
                c = next(k for k, r in enumerate(self.REACH) if r <= len(w) - j)
                entries[c].append((i, j))
                self.starts[c, w[j]] = True
        self.found = {}
        for c, members in entries.items():
            if not members:
                continue
            reach = self.REACH[c]
            flat = np.concatenate([np.array(items[i][1][j:j + reach] + [0] * (reach + 1), np.int64) for i, j in members])
            at = np.arange(len(members)) * (2 * reach + 1)
            for t in range(tables):
                keys = self._keys(flat, at, c, t)
                order = np.argsort(keys, kind="stable")
                self.found[c, t] = keys[order], [members[k] for k in order.tolist()]

    def _keys(self, flat, at, c, t):
        """The key of the walk t from every place in `at`."""
        key, begin = flat[at] + 1, 0
        for step in self.steps[c][t]:
            for k in range(begin, step):
                at = at + self.bits[t, k][flat[at]]
            key = (key * np.int64(0x9E3779B1) + flat[at] + 1) * np.int64(0x2545F491) + (key >> np.int64(29))
            begin = step
        return key

    def candidates(self, numbers):
        """(row, item, start of the item in the row) as a dict without values."""
        gap = np.zeros(2 * max(self.REACH) + 1, np.int64)
        flat = np.concatenate([part for ids in numbers for part in (ids, gap)]) if numbers else gap
        begins = np.cumsum([0] + [len(ids) + len(gap) for ids in numbers])
        asked = {}
        for c in range(len(self.REACH)):
            at = np.flatnonzero(self.starts[c][flat])
            at = at[flat[at] > 0]
            if not len(at):
                continue
            for t in range(self.tables):
                keys, members = self.found[c, t]
                mine = self._keys(flat, at, c, t)
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(high > low)
                rows = np.searchsorted(begins, at[hit], "right") - 1
                for p, row, a, b in zip(at[hit].tolist(), rows.tolist(), low[hit].tolist(), high[hit].tolist()):
                    for item, j in members[a:b]:
                        asked[row, item, p - int(begins[row]) - j] = None
        return asked


class Index:
    """The items of one block: word numbers, and either way to their candidates."""

    def __init__(self, items, similarity=0.8, exact=False, **walks):
        self.words, self.items = {}, []
        for item_id, text in items:
            w = words_of(text)
            if w:
                self.items.append((item_id, [self.words.setdefault(x, len(self.words) + 1) for x in w], allowed(len(w), similarity)))
        size = len(self.words) + 2
        self.finder = Runs(self.items, size) if exact else Walks(self.items, size, **walks)

    def matches(self, texts):
        """(row of `texts`, item number, least distance) of every item found within its distance, from the texts' words."""
        get, out = self.words.get, {}
        for first in range(0, len(texts), 256):
            numbers = [np.array([get(w, 0) for w in words_of(text)], np.int64) for text in texts[first:first + 256]]
            for r, i, a in self.finder.candidates(numbers):
                _, w, most = self.items[i]
                if out.get((first + r, i), most + 1) > 0:
                    d = best_distance(w, numbers[r][max(0, a - most):max(0, a + len(w) + most)].tolist())
                    if d <= most:
                        out[first + r, i] = min(d, out.get((first + r, i), d))
        return [(r, i, d) for (r, i), d in out.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_items: int = 5000, exact: bool = False) -> DataFrame:
    """doc_id, item_id, distance: the items that a document holds within their distance, with the least distance (words) found.

    Items are numbered inside Spark and taken in blocks of `block_items` rows, one after the other, each against all documents; the driver and a task hold one block, however long the
    benchmark is, and what a block finds is written before the next one is read. Items without an id are numbered like any other. Null and empty texts and items match nothing; items that repeat are each reported; rows
    without an id are reported under null; repeated rows give repeated rows. `exact` searches by runs of three words instead of by walks.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    schema, found = "doc_id long, item_id long, distance int", []
    count, blocks = _blocks(benchmark, block_items)
    for block in blocks:
        part = source.mapInArrow(_search(block, similarity, exact), schema)
        found.append(part if count == 1 else saved(part))
    return reduce(DataFrame.unionByName, found) if found else source.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance")).limit(0)


def _search(block, similarity, exact):
    def run(batches):
        index = Index(block, similarity, exact)
        for batch in batches:
            if not index.items:
                continue
            ids = batch.column(0).to_pylist()
            found = index.matches(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _, _ in found], pa.int64()), pa.array([index.items[i][0] for _, i, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int32())], ["doc_id", "item_id", "distance"])
    return run


def _blocks(benchmark, block_items):
    """How many blocks of items there are, and the items (item_id, text) block by block, by their number in the order of id and text; a block is read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    numbered = saved(positions(items, [F.asc_nulls_last("item_id"), F.asc("text")]).select("position", "item_id", "text"))
    last = numbered.agg(F.max("position")).first()[0]
    bounds = range(0, 0 if last is None else last + 1, block_items)
    return len(bounds), ([(r["item_id"], bytes(r["text"])) for r in numbered.filter(F.col("position").between(low, low + block_items - 1)).orderBy("position").collect()] for low in bounds)


def _clean(block, similarity, exact, at):
    """Keeps the rows whose text (column number `at`) holds no item of the block."""
    def run(batches):
        index = Index(block, similarity, exact)
        for batch in batches:
            texts = batch.column(at)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()) if not pa.types.is_null(texts.type) else texts
            keep = np.ones(batch.num_rows, bool)
            if index.items:
                keep[[r for r, _, _ in index.matches(texts.to_pylist())]] = False
            yield batch.filter(pa.array(keep))
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_items: int = 5000, exact: bool = False) -> DataFrame:
    """The rows of `docs` that hold no benchmark item. Each row is judged by its own text, whether it has an id, shares one, or has none.

    Of a benchmark of several blocks, what passes one block is written before the next is read.
    """
    out = docs
    count, blocks = _blocks(benchmark, block_items)
    for number, block in enumerate(blocks, 1):
        out = out.mapInArrow(_clean(block, similarity, exact, docs.columns.index("text")), docs.schema)
        out = out if number == count else saved(out)
    return out
