"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison inside buckets, connected components.

Fingerprints within `RADIUS` bits of each other agree on two of four 16-bit pieces, so distinct fingerprints meet in six buckets of 32 equal bits. A bucket that still
holds more than `split_at` fingerprints is dealt again by three pieces of its other 32 bits, on one of which two such fingerprints also agree. In a bucket, bit planes
stand vertically: one word of a plane holds the same bit of 64 members. The distances of a query to 64 members are updated plane by plane with carry-save counters, and
a (query, word) block is abandoned once all its lanes exceed the radius. The same comparison with a wider print chooses the candidates among which documents of similarity 0.8 are verified by their shingles (`similar_documents`). A bucket emits a spanning forest of its links, never all pairs.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.operators.components import connected_components

RADIUS = 2
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the `width`-word shingles of a text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[at:at + (1 << 16)].tolist(), last[at:at + (1 << 16)].tolist())), np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def _fingerprints(batches):
    for batch in batches:
        prints = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _exceeds(counter, limit):
    """Lanes whose bit-sliced counter, lowest plane first, is over `limit`."""
    over, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for b in range(len(counter) - 1, -1, -1):
        if limit >> b & 1:
            equal &= counter[b]
        else:
            over |= equal & counter[b]
            equal &= ~counter[b]
    return over


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 19):
    """Indices (i, root) of a spanning forest of the links inside equal keys; rows are sorted by key, `prints` has one column per 64 bits."""
    prints = prints.reshape(len(keys), -1)
    n, nothing = len(keys), (np.empty(0, np.int64), np.empty(0, np.int64))
    if n < 2:
        return nothing
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, n))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return nothing
    words = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)[:-1]))
    member = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    inside = member - np.repeat(starts, sizes)
    own_word, lane = np.repeat(first_word, sizes) + inside // 64, inside % 64
    at = np.full((int(words.sum()), 64), -1, np.int64)
    at[own_word, lane] = member
    used = np.packbits(at >= 0, axis=1, bitorder="little").view(np.uint64).ravel()
    planes = []
    for column in range(prints.shape[1]):
        laid = np.zeros(at.shape, np.uint64)
        laid[own_word, lane] = prints[member, column]
        planes += [np.packbits(((laid >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1, bitorder="little").view(np.uint64).ravel() for b in range(64)]
    parent = np.arange(n)
    left = np.repeat(first_word + words, sizes) - own_word  # words from the member's own to the last of its bucket
    begin, sums = 0, np.cumsum(left)
    while begin < len(member):
        stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + chunk, "right")))
        reps = left[begin:stop]
        q = np.repeat(np.arange(begin, stop), reps)
        word = np.repeat(own_word[begin:stop], reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        low = np.where(word == own_word[q], (ALL << lane[q].astype(np.uint64)) << np.uint64(1), ALL)  # later lanes only
        far = ~(used[word] & low)
        counter = [np.zeros(len(q), np.uint64) for _ in range((radius + 4).bit_length())]
        for b, plane in enumerate(planes):
            carry = plane[word] ^ (np.uint64(0) - ((prints[member[q], b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k, held in enumerate(counter):
                counter[k], carry = held ^ carry, held & carry
            if b % 4 == 3 and len(q):
                far |= _exceeds(counter, radius)
                alive = far != ALL
                if not alive.all():
                    q, word, far, counter = q[alive], word[alive], far[alive], [c[alive] for c in counter]
        if len(q):
            near = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            row, col = np.nonzero(near)
            _unite(parent, member[q[row]], at[word[row], col])
        begin = stop
    parent = _jump(parent)
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def _jump(parent):
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent, i, j):
    while len(i):
        parent[:] = _jump(parent)
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _links(radius, names):
    """Reads a partition sorted by key (first column; the second names the row, the rest is its print), a bucket never split over two comparisons; yields edges of names, with their key under a third name."""
    def edges(keys, rows, prints):
        i, root = bucket_links(keys, prints.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[i], rows[root], keys[i])][:len(names)], names)

    def run(batches):
        held = []
        count = 0
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held.append((cols[0], cols[1], np.column_stack(cols[2:])))
            count += batch.num_rows
            if count >= 1 << 17:
                keys, rows, prints = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield edges(keys[:cut], rows[:cut], prints[:cut])
                held, count = [(keys[cut:], rows[cut:], prints[cut:])], len(keys) - cut
        if count:
            yield edges(*(np.concatenate(x) for x in zip(*held)))
    return run


def _bits(column, shift, width):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, split_at: int = 1 << 16) -> DataFrame:
    """(a, b): edges between the distinct fingerprints `fp` whose components are those of all links within the radius. No pair is left out at any bucket size."""
    fp = F.col("fp")
    piece = lambda i: _bits(fp, 16 * i, 16)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), (F.shiftleft(piece(i), 16) + piece(j)).alias("key")) for n, (i, j) in enumerate(PIECES)])).alias("_k")).select("fp", "_k.*")
    hot = keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > split_at)
    rest = F.lit(None).cast("long")
    for n, (i, j) in enumerate(PIECES):
        k, m = [x for x in range(4) if x not in (i, j)]
        rest = F.when(F.col("pair") == n, F.shiftleft(piece(k), 16) + piece(m)).otherwise(rest)
    again = F.array(*[F.struct(F.lit(n).alias("sub"), _bits(rest, s, w).alias("sub_key")) for n, (s, w) in enumerate([(0, 11), (11, 11), (22, 10)])])
    once = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_key")))
    dealt = keyed.join(hot, ["pair", "key"], "left").select("fp", "pair", "key", F.explode(F.when(F.col("held").isNull(), once).otherwise(again)).alias("_s"))
    # 35 bits of (pair, key) and the refinement above them: one exact long, so the task compares integers only
    code = F.col("pair") * F.lit(1 << 32) + F.col("key") + (F.col("_s.sub") + 1) * F.lit(1 << 36) + F.col("_s.sub_key") * F.lit(1 << 39)
    return dealt.select(code.alias("code"), "fp", F.col("fp").alias("print")).repartition("code").sortWithinPartitions("code").mapInArrow(_links(RADIUS, ["a", "b"]), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, split_at: int = 1 << 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id whose fingerprint can be reached over links of at most two differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id get the component of their fingerprint, null only if no row of it has an id.
    Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    prints = saved(fingerprints(docs, width))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(near_links(distinct.select("fp"), split_at))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = saved(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similarity of at least 0.8 over five-word shingles: candidates by wider prints in buckets of minimum hashes, verified by the shingles

LANES, MINIMA, WIDE_RADIUS = 8, 6, 136


def _turn(h, k):
    """The k-th of several independent mixings of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int):
    """XXH64 of the distinct shingles of a text, ascending."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e]) for s, e in zip(starts.tolist(), last.tolist())), np.uint64))


def wide_print(h):
    """512-bit SimHash of a set of shingles and the least of `MINIMA` mixings of its hashes; zeros for an empty set."""
    if not len(h):
        return np.zeros(LANES, np.uint64), np.zeros(MINIMA, np.uint64)
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), 1 << 14):
        lanes = np.column_stack([_turn(h[at:at + (1 << 14)], k) for k in range(LANES)])
        counts += np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64), np.array([_turn(h, LANES + k).min() for k in range(MINIMA)])


def _digest(h):
    """128 bits that name a set of shingles."""
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)


def _wide_prints(width):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", width) for t in batch.column(1).to_pylist()]
            made = [wide_print(h) for h in sets]
            digests = np.array([_digest(h) for h in sets], np.int64).reshape(-1, 2)
            prints = np.array([p for p, _ in made], np.uint64).reshape(-1, LANES).view(np.int64)
            minima = np.array([m for _, m in made], np.uint64).reshape(-1, MINIMA).view(np.int64)
            counts = np.array([len(h) for h in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(np.ascontiguousarray(c)) for c in (*digests.T, counts, *prints.T, *minima.T)], ["doc_id", *SET, "shingles", *PRINT, *LEAST])
    return run


SET, PRINT, LEAST = ["d0", "d1"], [f"p{k}" for k in range(LANES)], [f"m{k}" for k in range(MINIMA)]


def _wanted_sets(width):
    """(node, shingle_set) of the rows (node, d0, d1, text) whose text has the set that the digest names: other rows may share the id."""
    def run(batches):
        for batch in batches:
            nodes, d0, d1, texts = (c.to_pylist() for c in batch.columns)
            made = [(node, h.tobytes()) for node, a, b, t in zip(nodes, d0, d1, texts) for h in [shingle_set(t or b"", width)] if _digest(h).tolist() == [a, b]]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([h for _, h in made], pa.binary())], ["node", "shingle_set"])
    return run


def similar_links(sets: list):
    """Indices (i, j) of a spanning forest of the pairs of sets with a similarity of 0.8 or more, exactly; pairs that are already connected are not compared again."""
    m, size = len(sets), np.array([len(h) for h in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate(([0], np.cumsum(size)))
    mark, root, out = np.zeros(len(values), bool), np.arange(m), []
    for i in range(m - 1):
        later = i + 1 + np.flatnonzero(root[i + 1:] != root[i])
        later = later[(5 * np.minimum(size[later], size[i]) >= 4 * np.maximum(size[later], size[i]))]
        if not len(later):
            continue
        own = codes[begins[i]:begins[i + 1]]
        mark[own] = True
        if 8 * len(later) > m - i:  # many: one pass over all that follow
            shared = np.add.reduceat(mark[codes[begins[i + 1]:]], begins[i + 1:-1] - begins[i + 1], dtype=np.int64)[later - i - 1]
        else:
            shared = np.array([np.count_nonzero(mark[codes[begins[j]:begins[j + 1]]]) for j in later.tolist()], np.int64)
        mark[own] = False
        for j in later[9 * shared >= 4 * (size[i] + size[later])].tolist():  # shared / (sum - shared) >= 4 / 5
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _verified(batches):
    """Reads (code, node, shingle_set) sorted by code; yields the links (a, b) inside each code."""
    def edges(held):
        nodes = list(held)
        found = similar_links([np.frombuffer(h, np.uint64) for h in held.values()])
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    code, held = None, {}
    for batch in batches:
        for k, node, h in zip(*(c.to_pylist() for c in batch.columns)):
            if k != code:
                if len(held) > 1:
                    yield edges(held)
                code, held = k, {}
            held[node] = h
    if len(held) > 1:
        yield edges(held)


def _shingle_links(docs, classes, groups, width, at_most):
    """(a, b): links of similarity 0.8 or more between the members of each of the `groups` (group, node); a group of over `at_most` shingles is compared block by block."""
    about = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr("bit_xor(xxhash64(node))").alias("mix"))
    once = about.groupBy("n", "lo", "hi", "mix").agg(F.min("group").alias("group")).select("group")  # the same members met in several buckets are compared once
    members = saved(groups.join(once, "group").join(classes.select("node", "rep", *SET, "shingles"), "node"))
    large = members.groupBy("group").agg(F.sum("shingles").alias("held")).filter(F.col("held") > at_most)
    dealt = members.join(large, "group", "left").select("node", _blocks("group", "held", "node", at_most).alias("code"))
    wanted = members.select("node", F.col("rep").alias("doc_id"), *SET).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(wanted, "doc_id").select("node", *SET, "text")
    sets = texts.mapInArrow(_wanted_sets(width), "node long, shingle_set binary").dropDuplicates(["node"])
    return dealt.join(sets, "node").select("code", "node", "shingle_set").repartition("code").sortWithinPartitions("code").mapInArrow(_verified, "a long, b long")


def _blocks(key, held, member, at_most):
    """The codes under which a member of a group meets all others: the key itself, or where `held` is given the pairs of its block with each of the blocks of half of `at_most`."""
    k = F.ceil(F.col(held) * 2 / F.lit(at_most)).cast("long")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(1)), k)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.xxhash64(F.col(key), F.least(own, j), F.greatest(own, j)))
    return F.explode(F.when(F.col(held).isNull(), F.array(F.col(key))).otherwise(pairs))


def similar_documents(docs: DataFrame, width: int = 5, radius: int = WIDE_RADIUS, split_at: int = 1 << 15, at_most: int = 1 << 22) -> DataFrame:
    """(doc_id, component_id): components of documents whose distinct shingles have a similarity of 0.8 or more.

    Candidates meet in buckets of equal minimum hashes, of which six are tried: two documents of similarity 0.8 share none with probability 0.00006. In a bucket, 512-bit
    prints within the radius are candidates: at a similarity of 0.8 they differ in 78 bits on average, in 96 for four of five shingles (a standard deviation of 9), so a
    radius of 136 misses next to none. The links among connected candidates are then decided by their sets of shingles. A bucket of more than
    `split_at` distinct prints is cut into blocks, which are compared pair by pair in tasks of their own, so its size changes no result. Rows without an id are left out; texts without words are alike.
    """
    rows = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null").mapInArrow(_wide_prints(width), "doc_id long, " + ", ".join(f"{c} long" for c in [*SET, "shingles", *PRINT, *LEAST])))
    classes = saved(rows.groupBy(*SET, "shingles", *PRINT, *LEAST).agg(F.min("doc_id").alias("rep")).withColumn("node", F.xxhash64(*SET)))
    keyed = classes.filter("shingles > 0").select("node", *PRINT, *LEAST, F.posexplode(F.array(*LEAST)).alias("turn", "least")).withColumn("key", F.xxhash64("turn", "least"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > split_at)
    dealt = keyed.join(hot, "key", "left").select(_blocks("key", "held", "node", split_at).alias("code"), "node", *PRINT)
    near = saved(dealt.repartition("code").sortWithinPartitions("code").mapInArrow(_links(radius, ["a", "b", "code"]), "a long, b long, code long").withColumn("group", F.xxhash64("code", "b")))
    groups = near.select("group", F.col("a").alias("node")).unionByName(near.select("group", F.col("b").alias("node"))).distinct()
    found = connected_components(_shingle_links(docs, classes, groups, width, at_most))
    rooted = saved(classes.select(*SET, "node", "rep").join(found, "node", "left").select(*SET, "rep", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", *SET).join(rooted.join(least, "root").select(*SET, "component_id"), SET).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component of similar documents; rows without an id stay, and rows that share the smallest id all stay."""
    found = similar_documents(docs, width)
    return docs.join(found.filter("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
