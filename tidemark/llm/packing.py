"""Best-fit packing of token sequences, after a reduction by dominance.

Tokens are counted in tasks; what packing decides depends only on how many pieces there are of each length. That histogram has no more entries than the capacity, however many
documents there are, and the plan is made on it: Martello and Toth's reduction fixes sets of one to three pieces that dominate every other set with the same longest piece, all
equal sets at once, and best-fit decreasing packs the rest, run by run. The plan says for a range of places among the pieces of one length which sequences they go to. Pieces are
numbered within their length by Spark (range partition, prefix counts), and each finds its range by binary search.
"""
import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.operators.ranking import positions

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


def encoder(vocabulary: str = None, ranks: str = None):
    """text -> ids of the vocabulary, as by its tokenizer without added special tokens.

    The same merges, read from the rank file, run in a library some four times as fast; it takes the ids of special tokens that stand in a text, as the tokenizer does. A text it
    refuses (a run too long for its pattern) goes to the tokenizer itself. Paths are those of `public_tokenizers` unless given.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)
    slow = []

    def encode(text):
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY)))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
    return encode


def _cut(capacity, end, with_ids, paths):
    def run(batches):
        encode = encoder(*paths)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                begin, stop, piece = 0, len(ids) % capacity or capacity, 0
                while begin < len(ids):
                    raw = ids[begin:stop].tobytes()
                    for column, value in zip(out, (doc_id, piece, begin, len(raw) // 4, zlib.crc32(raw), raw)):
                        column.append(value)
                    begin, stop, piece = stop, stop + capacity, piece + 1
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns if with_ids else columns[:5], names if with_ids else names[:5])
    return run


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, with_ids: bool = False, paths=(None, None)) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, 32-bit little-endian): every document's tokens with the id `end` after them, cut into pieces of at most `capacity`.

    Only documents longer than that are cut, and then only the first piece is shorter. Null texts count as empty: one piece, the end alone. Null and repeated ids are kept.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_cut(capacity, end, with_ids, paths), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class _Stock:
    """How many pieces are left of each length."""

    def __init__(self, counts):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, size, n):
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size], self.sizes[bisect.bisect_left(self.sizes, size)]

    def smallest(self, above=0, without=()):
        """The lengths over `above` in ascending order, each as often as it is left, less those in `without`."""
        for size in self.sizes[bisect.bisect_right(self.sizes, above):]:
            yield from [size] * min(3, self.left[size] - without.count(size))

    def largest(self, room, without=()):
        """The largest length up to `room` that is left after `without`, or None."""
        at = bisect.bisect_right(self.sizes, room)
        while at:
            at -= 1
            if self.left[self.sizes[at]] > without.count(self.sizes[at]):
                return self.sizes[at]
        return None


def _sum_of_least(stock, n, above, without):
    found = []
    for size in stock.smallest(above, without):
        found.append(size)
        if len(found) == n:
            return sum(found)
    return None


def _best_pair(stock, room, without):
    """The largest sum of two lengths within `room`, or 0."""
    left = [(s, stock.left[s] - without.count(s)) for s in stock.sizes if s <= room and stock.left[s] > without.count(s)]
    best, low, high = 0, 0, len(left) - 1
    while low <= high:
        total = left[low][0] + left[high][0]
        if total > room:
            high -= 1
            continue
        if low < high or left[low][1] > 1:
            best = max(best, total)
        low += 1
    return best


def dominant_set(stock: _Stock, longest: int, capacity: int):
    """A set of one to three lengths with `longest` in it that dominates every other feasible set with it (each piece of the other fits in one of its pieces), or None."""
    mine, room = (longest,), capacity - longest
    least = _sum_of_least(stock, 1, 0, mine)
    if least is None or least > room:
        return mine
    mate = stock.largest(room, mine)
    two = _sum_of_least(stock, 2, 0, mine)
    if mate == room or two is None or two > room:
        return (longest, mate)
    three = _sum_of_least(stock, 3, 0, mine)
    if three is not None and three <= room:
        return None
    if mate >= _best_pair(stock, room, mine):
        return (longest, mate)
    third = stock.largest(room - mate, (longest, mate))
    if third is not None:
        other = _sum_of_least(stock, 2, third, mine)
        if other is None or other > room:
            return (longest, mate, third)
    return None


def fixed_sets(stock: _Stock, capacity: int) -> list:
    """(times, set): all sets the reduction fixes, taken from `stock`. A set that dominates stays so while its lengths last, so all its copies are fixed at once."""
    out, moved = [], True
    while moved:
        moved = False
        for longest in reversed(list(stock.sizes)):
            while longest in stock.left and (found := dominant_set(stock, longest, capacity)):
                times = min(stock.left[s] // found.count(s) for s in found)
                for s in found:
                    stock.take(s, times)
                out.append((times, found))
                moved = True
    return out


def plan(counts: dict, capacity: int) -> list:
    """Records (length, first, number, sequence, per_sequence, offset), from the number of pieces of each length up to `capacity`.

    The pieces of that length at places first .. first + number - 1 go to the sequences from `sequence` on, `per_sequence` to each, the first of them at `offset` in its sequence.
    A length is met by runs of equal sequences, so there are at most a few records for each pair of a length and a room that is left: bounded by the capacity alone.
    """
    stock, out, used, sequence = _Stock(counts), [], dict.fromkeys(counts, 0), 0
    for times, found in fixed_sets(stock, capacity):
        offset = 0
        for size in sorted(set(found), reverse=True):
            each = found.count(size)
            out.append((size, used[size], times * each, sequence, each, offset))
            used[size] += times * each
            offset += each * size
        sequence += times
    rooms = {}
    for size in reversed(stock.sizes):
        left = stock.left[size]
        for room in sorted(r for r in rooms if r >= size):
            if not left:
                break
            each = room // size
            for first, n in rooms.pop(room):
                take = min(left, n * each)
                full, more = divmod(take, each)
                if take:
                    out.append((size, used[size], take, first, each, capacity - room))
                    used[size] += take
                    left -= take
                for begin, number, after in ((first, full, room - each * size), (first + full, int(more > 0), room - more * size), (first + full + (more > 0), n - full - (more > 0), room)):
                    if number and after:
                        rooms.setdefault(after, []).append((begin, number))
        if left:
            each = capacity // size
            full, more = divmod(left, each)
            out.append((size, used[size], left, sequence, each, 0))
            used[size] += left
            for begin, number, after in ((sequence, full, capacity - each * size), (sequence + full, int(more > 0), capacity - more * size)):
                if number and after:
                    rooms.setdefault(after, []).append((begin, number))
            sequence += full + (more > 0)
    return out


def _place(records, capacity):
    size, first, _, sequence, each, offset = np.array(sorted(records), np.int64).reshape(-1, 6).T
    span = int((first.max() if len(first) else 0) + 1)

    def run(batches):
        for batch in batches:
            length, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            found = np.searchsorted(size * span + first, length * span + np.minimum(at, span - 1), side="right") - 1
            i = at - first[found]
            columns = dict(zip(batch.schema.names, batch.columns)) | {"sequence_id": pa.array(sequence[found] + i // each[found], pa.int64()), "offset": pa.array(offset[found] + i % each[found] * length, pa.int64())}
            del columns["position"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, with_ids: bool = False, paths=(None, None)) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset: sequences of at most `capacity` tokens, gapless from 0, as few as the reduction and best fit find.

    Same rows, same packing, up to the exchange of pieces of equal length whose document, place and content agree. Null texts are one piece of the end alone; null and repeated ids
    are kept; an empty table gives no rows; other columns are ignored. The driver holds the counts by length and the plan only.
    """
    cut = saved(pieces(docs, capacity, end, with_ids, paths))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = positions(cut, [F.asc_nulls_last("doc_id"), F.asc("piece"), F.asc("start"), F.asc("ids_crc32")], ["length"]).drop("group_n")
    rest = [c for c in cut.columns if c != "length"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select("length", *rest).schema) + ", sequence_id long, offset long"
    return placed.select("length", "position", *rest).mapInArrow(_place(plan(counts, capacity), capacity), schema).select(*cut.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of int), pieces: the packed token sequences themselves, from `pack(..., with_ids=True)`. A group holds one sequence."""
    digits = lambda i, byte: F.substring(F.hex("ids"), i * 8 + 2 * byte + 1, F.lit(2))
    ids = F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), lambda i: F.conv(F.concat(*[digits(i, byte) for byte in (3, 2, 1, 0)]), 16, 10).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col("doc_id"), F.col("piece"), ids.alias("ids"))))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces"))
