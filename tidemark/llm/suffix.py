"""Repeated substrings of at least `LENGTH` bytes, by hash-compared suffix sorting around sampled anchors.

Prefix polynomial hashes (mod 2^64) give every byte string's hash in constant time. Of the `GRAM`-byte strings that start in a `LENGTH`-byte window, the one with the least
hash is its anchor; equal windows have equal anchors in equal places, so a repeated window always shows as a repeated anchor. Per anchor, occurrences with the same
surroundings form one class, found by grouping on the anchor's hash and a BLAKE2b digest of the surrounding bytes (combined before the shuffle), so that no collision
of the polynomial hash joins what differs: a class of two occurrences is repeated in full. Only anchors with several
classes need comparison: the classes' suffixes and reversed prefixes from the anchor are sorted by a mergesort whose comparisons find the common extension by binary
search over prefix hashes, common extensions of neighbours are verified byte by byte, and a window is repeated if another class agrees with it on both sides.

An anchor with more than `split_at` classes is dealt again by halves of its window offsets, keyed by the bytes that all windows of the half share, down to single
windows, which are grouped by their bytes; so no task holds an unbounded group and nothing is left out.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved

LENGTH, GRAM, PIECE, CHUNK = 200, 64, 1 << 19, 1 << 12
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


class Powers:
    """Powers of the base and its inverse, grown as needed and kept by the worker."""
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n):
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(BASE, size), _powers(INVERSE, size)
        return cls.up, cls.down


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i]: sum of (byte + 1) * base^j over the first i bytes."""
    up, _ = Powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    h[1:] = data
    h[1:] += np.uint64(1)
    h[1:] *= up[:len(data)]
    return np.cumsum(h, out=h)


def _spread(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def anchors(texts, length=LENGTH, gram=GRAM, piece=PIECE):
    """Of texts (number, bytes): arrays (number, place, gram hash, digest of the surroundings) of all anchors. Long texts go in overlapping pieces, short ones together."""
    out = []
    held, size = [], 0
    for number, text in texts:
        n = len(text)
        if n < length:
            continue
        for a in range(0, n - length + 1, piece):
            lo, hi = max(0, a - (length - gram)), min(n, a + piece + 2 * length)
            held.append((number, lo, text[lo:hi], a - lo, min(a + piece, n - length + 1) - lo, n))
            size += hi - lo
            if size >= piece:
                out.append(_anchors_of(held, length, gram))
                held, size = [], 0
    if held:
        out.append(_anchors_of(held, length, gram))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors_of(held, length, gram):
    wide = length - gram + 1
    raw = b"".join(x[2] for x in held)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(x[2]) for x in held])
    begin = np.cumsum(sizes) - sizes
    total = len(data)
    _, down = Powers.to(total + 1)
    h = prefix_hashes(data)
    own = (h[gram:] - h[:-gram]) * down[:total - gram + 1]
    key = np.full(-(-total // wide) * wide + wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:len(own)] = (_spread(own) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(own), dtype=np.uint64)
    blocks = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:total], ahead[wide - 1:wide - 1 + total])
    starts = np.concatenate([np.arange(b + x[3], b + x[4]) for b, x in zip(begin.tolist(), held)])
    place = np.unique((least[starts] & np.uint64(0xFFFFFF)).astype(np.int64))
    of = np.searchsorted(begin, place, "right") - 1
    left = np.maximum(place - (length - gram), begin[of])
    right = np.minimum(place + length, begin[of] + sizes[of])
    digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(left.tolist(), right.tolist())])
    around = np.frombuffer(digest, np.uint64) ^ _spread((place - left).astype(np.uint64) * np.uint64(1 << 20) + (right - place).astype(np.uint64))  # cut off by the text's ends at the same distances
    base = np.array([x[1] for x in held]) - begin
    return np.array([x[0] for x in held])[of], (place + base[of]).astype(np.int32), _spread(own[place]).view(np.int64), around.view(np.int64)


def _extension(h, down, data, i, j, most):
    """Length of the common extension of the strings at i and j, at most `most`, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = (h[i + mid] - h[i]) * down[i] == (h[j + mid] - h[j]) * down[j]
        low = np.where(same & open_, mid, low)
        high = np.where(~same & open_, mid - 1, high)


def suffix_sort(data, start, size, group_start, group_end):
    """Order inside each group of the strings data[start:start+size], by bottom-up mergesort: a string finds its place in the neighbouring run by binary search, each
    comparison by common extension. Slots are laid out group by group; returns the string in each slot."""
    n = len(start)
    h = prefix_hashes(data)
    _, down = Powers.to(len(data) + 1)
    padded = np.concatenate((data, np.zeros(1, np.uint8)))
    order, slots = np.arange(n), np.arange(n)
    width = 1
    longest = int((group_end - group_start).max()) if n else 0
    while width < longest:
        run = (slots - group_start) // width
        other = group_start + (run ^ 1) * width
        live = np.flatnonzero(other < group_end)
        x, gs = order[live], group_start[live]
        lo = other[live].copy()
        first, end = lo.copy(), np.minimum(group_end[live], lo + width)
        hi = end.copy()
        right_run = (run[live] & 1) == 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            a, b = x[open_], order[mid]
            most = np.minimum(size[a], size[b])
            same = _extension(h, down, data, start[a], start[b], most)
            ended = same == most
            ca, cb = padded[np.minimum(start[a] + same, len(data))], padded[np.minimum(start[b] + same, len(data))]
            before = np.where(ended, (size[b] < size[a]) | ((size[b] == size[a]) & right_run[open_]), cb < ca)  # the other stands before this one
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        target = gs + (run[live] & ~1) * width + (slots[live] - gs - run[live] * width) + (lo - first)
        new = order.copy()
        new[target] = x
        order = new
        width *= 2
    return order


def _sorted_sides(parts, keys, reverse):
    """Order of byte strings inside equal keys (given sorted) and the verified common extension of each with the one before it."""
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(p[::-1] for p in parts) if reverse else b"".join(parts), np.uint8)
    start = np.cumsum(size) - size
    n = len(parts)
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(firsts, n))
    gs, ge = np.repeat(firsts, counts), np.repeat(firsts + counts, counts)
    order = suffix_sort(data, start, size, gs, ge)
    wide = int(size.max()) + 1
    near = np.zeros(n, np.int64)
    wrong = False
    padded = np.concatenate((data, np.zeros(wide, np.uint8)))
    for a in range(1, n, 1 << 13):
        b = min(n, a + (1 << 13))
        x, y = order[a - 1:b - 1], order[a:b]
        span = np.arange(wide)
        differ = padded[start[x][:, None] + span] != padded[start[y][:, None] + span]
        most = np.minimum(size[x], size[y])
        differ[np.arange(b - a), most] = True
        same = differ.argmax(axis=1)
        near[a:b] = np.where(gs[a:b] == np.arange(a, b), 0, same)
        sx, sy = padded[start[x] + same], padded[start[y] + same]
        ok = np.where(same == most, size[x] <= size[y], sx < sy) | (gs[a:b] == np.arange(a, b))
        wrong |= not bool(ok.all())
    if wrong:  # two strings had equal hashes and different bytes: this chunk is ordered by its bytes
        bytes_ = [bytes(data[s:s + k]) for s, k in zip(start.tolist(), size.tolist())]
        order = np.array(sorted(range(n), key=lambda i: (gs[i], bytes_[i])))
        for a in range(1, n):
            x, y = bytes_[order[a - 1]], bytes_[order[a]]
            near[a] = 0 if gs[a] == a else next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    new_group = np.zeros(n, bool)
    new_group[firsts] = True
    return order, near, new_group, size


def repeated_offsets(keys, left, right, low, high, length=LENGTH):
    """A boolean table (class, offset): whether the window that starts `offset` bytes before the anchor agrees with that of another class of the same key."""
    n = len(keys)
    out = np.zeros((n, int(high.max()) + 1 if n else 0), bool)
    if n < 2:
        return out
    ro, rnear, rnew, rsize = _sorted_sides(right, keys, False)
    lo_, lnear, lnew, lsize = _sorted_sides(left, keys, True)
    rclass, lclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        able = (lsize >= o) & (rsize >= length - o) & (low <= o) & (o <= high)
        if able.sum() < 2:
            continue
        rclass[ro] = np.cumsum(rnew | (rnear < length - o))
        lclass[lo_] = np.cumsum(lnew | (lnear < o))
        at = np.flatnonzero(able)
        both = rclass[at] * (n + 1) + lclass[at]
        by = np.argsort(both, kind="stable")
        s = both[by]
        twin = np.zeros(len(s), bool)
        twin[1:] |= s[1:] == s[:-1]
        twin[:-1] |= s[1:] == s[:-1]
        out[at[by[twin]], o] = True
    return out


def _slices(batches, rows=1 << 10):
    """The batches in short pieces, so that a worker turns few rows at a time into Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _anchor_rows(batches):
    for batch in _slices(batches):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        number, place, gram, around = anchors(enumerate(t or b"" for t in batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(keys[number], pa.int64()), pa.array(place, pa.int32()), pa.array(gram, pa.int64()), pa.array(around, pa.int64())], ["rk", "place", "gram", "around"])


def _snippets(batches):
    for batch in _slices(batches):
        cols = [[] for _ in range(4)]
        for text, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in need:
                p = x["place"]
                for c, v in zip(cols, (x["gram"], x["around"], text[max(0, p - (LENGTH - GRAM)):p], text[p:p + LENGTH])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["gram", "around", "before", "after"])


SNIPPET = ["key", "gram", "around", "low", "high", "before", "after"]


def _compare(batches):
    """Partitions sorted by key; whole keys are compared together, as many as make `CHUNK` rows, since a row of a chunk takes some kilobytes of arrays."""
    held = {c: [] for c in SNIPPET}

    def flush(n):
        part = {c: v[:n] for c, v in held.items()}
        for c in SNIPPET:
            held[c] = held[c][n:]
        found = repeated_offsets(np.array(part["key"], np.int64), part["before"], part["after"], np.array(part["low"]), np.array(part["high"]))
        some = np.flatnonzero(found.any(axis=1)) if found.size else []
        masks = [np.packbits(found[i], bitorder="little").tobytes() for i in some]
        return pa.RecordBatch.from_arrays([pa.array([part["gram"][i] for i in some], pa.int64()), pa.array([part["around"][i] for i in some], pa.int64()), pa.array(masks, pa.binary())], ["gram", "around", "mask"])

    for batch in _slices(batches):
        for c in SNIPPET:
            held[c] += batch.column(batch.schema.get_field_index(c)).to_pylist()
        if len(held["key"]) >= CHUNK:
            last = held["key"][-1]
            n = len(held["key"])
            while n and held["key"][n - 1] == last:
                n -= 1
            if n:
                yield flush(n)
    if held["key"]:
        yield flush(len(held["key"]))


def _settle(snippets: DataFrame, split_at: int) -> DataFrame:
    """(gram, around, mask) of the windows that two classes share."""
    most = LENGTH - GRAM
    rows = snippets.select(F.col("gram").alias("key"), "gram", "around", F.lit(0).alias("low"), F.lit(most).alias("high"), "before", "after")
    hot = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split_at))
    schema = "gram long, around long, mask binary"
    compare = lambda df: df.select(*SNIPPET).repartition("key").sortWithinPartitions("key").mapInArrow(_compare, schema)
    out = compare(rows.join(hot, "key", "left_anti"))
    rows = rows.join(hot, "key", "left_semi")
    while not hot.isEmpty():
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("high").alias("h")))
        rows = rows.select("gram", "around", "before", "after", F.explode(halves).alias("_r")).select("gram", "around", "before", "after", F.col("_r.l").alias("low"), F.col("_r.h").alias("high"))
        able = (F.length("before") >= F.col("low")) & (F.length("after") >= LENGTH - F.col("high"))
        shared = F.concat(F.expr("substring(before, length(before) - low + 1, low)"), F.expr(f"substring(after, 1, {LENGTH} - high)"))
        rows = saved(rows.filter(able).withColumn("key", F.xxhash64("gram", "low", "high", shared)))
        counts = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.first("low").alias("_l"), F.first("high").alias("_h")).filter("_n > 1"))
        alone = F.col("_l") == F.col("_h")
        single = rows.join(counts.filter(alone).select("key"), "key", "left_semi").select("gram", "around", "low")
        out = out.unionByName(single.mapInArrow(_one_bit, schema))
        out = out.unionByName(compare(rows.join(counts.filter(~alone & (F.col("_n") <= split_at)).select("key"), "key", "left_semi")))
        hot = counts.filter(~alone & (F.col("_n") > split_at)).select("key")
        rows = rows.join(hot, "key", "left_semi")
    return out


def _one_bit(batches):
    for batch in batches:
        masks = [b"\0" * (o >> 3) + bytes([1 << (o & 7)]) for o in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], ["gram", "around", "mask"])


def covered(n: int, marks) -> np.ndarray:
    """Which of n bytes lie in a marked window; a mark is (place, mask), no mask meaning all windows around the place."""
    step = np.zeros(n + 1, np.int64)
    for place, mask in marks:
        if mask is None:
            a, b = max(0, place - (LENGTH - GRAM)), min(place, n - LENGTH)
            if a <= b:
                step[a] += 1
                step[b + LENGTH] -= 1
        else:
            at = place - np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little"))
            np.add.at(step, at, 1)
            np.add.at(step, at + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def _finish(batches):
    for batch in _slices(batches):
        cols = [[] for _ in range(4)]
        for text, marks, rows in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            text = text or b""
            n = len(text)
            if rows > 1 and n >= LENGTH:
                gone = np.ones(n, bool)
            else:
                gone = covered(n, [(m["place"], m["mask"]) for m in marks or ()])
            removed = int(gone.sum())
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()) if n else 0
            left = text if not removed else np.frombuffer(text, np.uint8)[~gone].tobytes()
            for c, v in zip(cols, (n, removed, spans, hashlib.sha256(left).hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_substrings(docs: DataFrame, split_at: int = 1 << 13) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of `docs`.

    A byte goes if a 200-byte string that covers it also starts anywhere else, in the same text or another; matches never cross texts. Null counts as empty; texts under
    200 bytes lose nothing; rows that share id and text are texts of their own, hence removed whole; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    source = source.withColumn("rk", F.xxhash64("doc_id", "text"))
    found = saved(source.select("rk", "text").mapInArrow(_anchor_rows, "rk long, place int, gram long, around long"))
    spot = F.xxhash64("rk", "place")
    repeated = saved(found.groupBy("gram").agg(F.min(spot).alias("_a"), F.max(spot).alias("_b"), F.min("around").alias("_c"), F.max("around").alias("_d")).filter("_a <> _b").select("gram", (F.col("_c") == F.col("_d")).alias("one")))  # written, so that the join below can split a hot gram
    met = saved(found.join(repeated, "gram"))
    several = met.filter("not one")
    classes = saved(several.groupBy("gram", "around").agg(F.min(spot).alias("_a"), F.max(spot).alias("_b"), F.min_by("rk", spot).alias("rk"), F.min_by("place", spot).alias("place")).select("gram", "around", "rk", "place", (F.col("_a") != F.col("_b")).alias("full")))
    need = classes.groupBy("rk").agg(F.collect_list(F.struct("place", "gram", "around")).alias("need"))
    snippets = source.select("rk", "text").join(need, "rk").select("text", "need").mapInArrow(_snippets, "gram long, around long, before binary, after binary").dropDuplicates(["gram", "around"])
    masks = _settle(saved(snippets), split_at).join(classes.filter("full").select("gram", "around"), ["gram", "around"], "left_anti")
    marks = met.filter("one").select("rk", "place", F.lit(None).cast("binary").alias("mask"))
    marks = marks.unionByName(several.join(classes.filter("full").select("gram", "around"), ["gram", "around"]).select("rk", "place", F.lit(None).cast("binary").alias("mask")))
    marks = marks.unionByName(several.join(masks, ["gram", "around"]).select("rk", "place", "mask"))
    per = marks.groupBy("rk").agg(F.collect_list(F.struct("place", "mask")).alias("marks")).withColumn("rows", F.lit(1).cast("long"))
    twice = source.groupBy("rk").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").withColumn("marks", F.lit(None).cast("array<struct<place:int,mask:binary>>"))
    per = per.join(twice.select("rk"), "rk", "left_anti").unionByName(twice)
    joined = source.join(per, "rk", "left").select("doc_id", "text", "marks", F.coalesce("rows", F.lit(1)).alias("rows"))
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
