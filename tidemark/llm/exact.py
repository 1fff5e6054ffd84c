"""Exact duplicates: immutable snapshots screened by static binary-fuse filters, with byte checks of what remains.

A snapshot is a table of digests that does not change; per bucket of digests a binary-fuse filter with 8-bit fingerprints (9 bits a key in large filters, 13 at some thousand keys; three probes) is built
once. The digests of a new batch are first grouped among themselves, then screened: a negative is certainly new, a positive is joined to the exact bucket of the snapshot.
Groups of more than one row are then grouped again by their bytes.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ascii_lower, remainder, saved

KEYS_PER_FILTER = 1 << 12


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer; keys and result unsigned."""
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(h, segment, segments):
    """Three slots in consecutive segments: the first segment from the high bits, the place in each from other bits."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    return np.stack([base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(11)) & mask), base + np.uint64(2 * segment) + ((h >> np.uint64(22)) & mask)]).astype(np.int64)


def _print(h):
    return ((h >> np.uint64(24)) ^ (h >> np.uint64(57))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> dict:
    """A binary-fuse filter over distinct unsigned 64-bit keys: peeled in rounds, filled in the opposite order; another seed if peeling stalls."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    segments = max(1, int(np.ceil(max(n, 1) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) / segment)))
    for seed in range(1000):
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        order = []
        left = n
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, at = np.unique(owner[single], return_index=True)
            order.append((key, single[at]))
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            left -= len(key)
        if not left:
            table = np.zeros(size, np.uint8)
            marks = _print(h)
            for key, slot in reversed(order):
                rest = marks[key].copy()
                for row in slots[:, key]:
                    rest ^= table[row]
                table[slot] = rest ^ table[slot]
            return {"seed": seed, "segment": segment, "segments": segments, "table": table.tobytes()}
        segments += 1 + segments // 8
    raise ValueError("no peelable assignment")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """True where a key may be in the filter; never False for one that is."""
    t = np.frombuffer(table, np.uint8)
    h = _mix(keys, seed)
    a, b, c = _slots(h, segment, segments)
    return _print(h) == t[a] ^ t[b] ^ t[c]


def _digests(n_bytes):
    def run(batches):
        for batch in batches:
            sha = [hashlib.sha256((t or b"").lower()).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sha, pa.binary()), pa.array([s[:n_bytes] for s in sha], pa.binary())], ["doc_id", "fresh", "sha", "digest"])
    return run


def _keys(column):
    return np.array([int.from_bytes((d + b"\0" * 8)[:8], "little") for d in column.to_pylist()], np.uint64)


def _build(group: pa.Table) -> pa.Table:
    f = build_filter(_keys(group.column("digest")))
    return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()), **{k: pa.array([f[k]], t) for k, t in (("seed", pa.int32()), ("segment", pa.int32()), ("segments", pa.int32()), ("table", pa.binary()))}})


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    if not batch.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "maybe": pa.array([], pa.bool_())})
    hit = np.zeros(batch.num_rows, bool)
    keys = _keys(batch.column("digest"))
    for f in filters.to_pylist():
        hit |= probe_filter(keys, f["seed"], f["segment"], f["segments"], f["table"])
    return pa.table({"digest": batch.column("digest"), "maybe": pa.array(hit)})


def exact_duplicates(docs: DataFrame, fresh=None, digest_bytes: int = 32, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; `fresh` is true for rows of the new batch (by default a fourth, by id hash), false for the snapshot.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with the largest id stays. Rows without an id count in group_size
    and are never kept, keep_id being null if no row of the group has an id; they skip the byte check. Rows that share id and text are each a row of the group. An empty table gives no rows. Groups
    are decided by bytes: if a digest has several texts (`digest_bytes` can be cut to force this), its rows are grouped by text instead.
    """
    fresh = remainder("doc_id", 4) == 3 if fresh is None else fresh
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), fresh.alias("fresh"))
    rows = saved(source.mapInArrow(_digests(digest_bytes), "doc_id long, fresh boolean, sha binary, digest binary"))
    n = rows.count()
    n_buckets = max(1, -(-n // keys_per_filter))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")
    sums = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    held = saved(rows.filter("not fresh").groupBy("digest").agg(*sums).select("*", bucket))
    filters = saved(held.select("bucket", "digest").groupBy("bucket").applyInArrow(_build, "bucket long, seed int, segment int, segments int, table binary"))
    batch = saved(rows.filter("fresh").groupBy("digest").agg(*sums).select("*", bucket))
    screened = batch.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "digest binary, maybe boolean")
    maybe = screened.filter("maybe").select("digest")
    positive = batch.join(maybe, "digest", "left_semi")
    new = batch.join(maybe, "digest", "left_anti").select("digest", "keep_id", "group_size")
    b = positive.select(F.col("digest").alias("_d"), F.col("bucket").alias("_b"), F.col("keep_id").alias("_k"), F.col("group_size").alias("_n"))
    met = held.join(b, (held["digest"] == b["_d"]) & (held["bucket"] == b["_b"]), "full_outer").select(
        F.coalesce("digest", "_d").alias("digest"), F.greatest("keep_id", "_k").alias("keep_id"), (F.coalesce("group_size", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("group_size"))
    groups = saved(met.unionByName(new))
    several = rows.join(groups.filter("group_size > 1").select("digest"), "digest", "left_semi").select("doc_id").distinct()
    pairs = source.join(several, "doc_id", "left_semi").select(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"), "doc_id").withColumn("sha", F.unhex(F.sha2("body", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))
    texts = pairs.groupBy("digest", "sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clash = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    out = rows.join(groups, "digest")
    cols = ["doc_id", "sha", "keep_id", "group_size"]
    if not clash.isEmpty():  # equal digests, different bytes: these rows go by their bytes
        clash = saved(clash)
        by_bytes = texts.join(clash, "digest", "left_semi").select("sha", "keep_id", "group_size")
        out = out.join(clash, "digest", "left_anti").select(*cols).unionByName(rows.join(clash, "digest", "left_semi").select("doc_id", "sha").join(by_bytes, "sha").select(*cols))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
