"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""
import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact, langid, linededup, mixing, quality, queries, simhash, suffix, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def frame(spark, rows, columns="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, columns)


def clashing(df):
    """Extra columns named like the ones the operators use inside."""
    names = ["size", "fp", "rk", "key", "digest", "sha", "src", "target", "quota", "place", "marks", "window", "y", "held_out", "score", "_runs", "_key", "_id", "one", "n", "bad", "host"]
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


def prose(rng, n, words=("the", "of", "and", "Stone", "river", "amber", "kite", "zinc", "oak", "Lumen")):
    return " ".join(rng.choice(words) for _ in range(n))


def edge_rows():
    long = "alpha beta gamma delta " * 9000
    return [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "One two", "en", "b"), (4, "One two", "en", "b"), (5, "one TWO", "de", "b"), (6, long, "de", None), (7, long, None, "c"),
            (None, "one two", "en", "a"), (8, "3.14 !!! 42", "fr", "c"), (9, "éa\u00a0ß 漢字 \U0001f600", "fr", "a")]


@pytest.fixture(scope="module")
def edges(spark):
    return clashing(frame(spark, edge_rows())).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(frame(spark, []))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


# ---- 1: mixing

def brute_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[i] += 1
    return won


@pytest.mark.parametrize("seed", range(3))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = [([rng.choice([1, 5, 40, 300, 300, 2000]) * 1.0 for _ in range(rng.randint(1, 12))], rng.choice([0, 1, 3, 20, 77])) for _ in range(6)]
    rows = [(g, i, v, n) for g, (votes, n) in enumerate(groups) for i, v in enumerate(votes)]
    got = {(r["g"], r["i"]): r["won"] for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, v double, n long"), ["g"], "i", "v", "n").collect()}
    for g, (votes, n) in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == brute_seats(votes, n)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, weight = total - sum(3 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else rest * w[s] / weight for s in names}
        over = {s for s in names if t[s] > 3 * sizes[s] + 1e-9} - full
        if not over:
            return t
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    shares = {"tiny": 3, "b": 400, "Z": 60, "é": 150, None: 90, "small": 9}
    rows = [(i * 10 + k, prose(rng, rng.choice([0, 1, 30, 200])), "en", s) for k, (s, n) in enumerate(shares.items()) for i in range(n)]
    df = clashing(frame(spark, [(j, *r[1:]) for j, r in enumerate(rows)]))
    got = mixing.mix(df, shard_words=4000).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want, taken = brute_targets(sizes), collections.Counter()
    assert len(got) == len(rows) and any(want[s] == 3 * sizes[s] for s in want)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 8 * (2 + sizes[s] // 4000), s
    again = mixing.mix(df.repartition(7), shard_words=4000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_edges(edges, nothing):
    got = mixing.mix(edges).collect()
    assert len(got) == len(edge_rows()) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(nothing).count() == 0


# ---- 2: SimHash

def brute_print(text, width=3):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("split_at", [1 << 16, 5])
def test_fingerprint_links(spark, split_at):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(25):
            x = rng.choice(sorted(prints)) if rng.random() < 0.3 else centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), split_at)
    from tidemark.operators.components import connected_components
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components(signed, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2)
    assert {p: got.get(p, p) for p in signed} == want


def test_bucket_links_at_hot_buckets():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 3).astype(np.uint64)
    prints = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for b in base]))
    i, root = simhash.bucket_links(np.zeros(len(prints), np.int64), prints, 2, chunk=100)
    got = np.arange(len(prints))
    got[i] = root
    want = brute_components(range(len(prints)), lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b])) <= 2)
    assert [int(x) for x in got] == [want[k] for k in range(len(prints))]


@pytest.mark.parametrize("split_at", [1 << 15, 4])
def test_similar_documents_are_found(spark, split_at):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 500]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(len(words) // 70):  # an edit changes five shingles: about 0.87 of similarity
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(clashing(frame(spark, [(i, t, "en", "a") for i, t in rows])), split_at=split_at).collect()}
    plain = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    want = brute_components(range(len(rows)), lambda a, b: 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b]))
    assert got == want and sum(want[i] != i for i in want) > 50


def test_similarity_is_decided_at_its_limit(spark):
    """Pairs on both sides of 0.8, from 5 to 500 shingles; `both` shingles are shared, `one` and `two` stand on one side only."""
    word, rows, alike = (f"x{i}" for i in range(10**7)), [], {}
    take = lambda n: [next(word) for _ in range(n)]
    shapes = [(4, 1, 0), (8, 2, 0), (8, 1, 1), (20, 5, 0), (20, 3, 2), (80, 20, 0), (80, 10, 10), (400, 100, 0), (41, 9, 0), (41, 5, 4), (410, 45, 45), (39, 11, 0), (39, 6, 5), (390, 55, 55), (390, 110, 0), (3, 1, 0), (15, 2, 2), (75, 13, 12)]
    for both, one, two in shapes:
        for _ in range(15):
            common = take(both + 4)
            alike[len(rows)] = both * 5 >= (both + one + two) * 4
            rows += [(len(rows), " ".join(common + take(one)), "en", "a"), (len(rows) + 1, " ".join(common + take(two)), "en", "a")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, rows)).collect()}
    missed = [i for i, same in alike.items() if same and got[i + 1] != i]
    linked = [i for i, same in alike.items() if not same and got[i + 1] != i + 1]
    assert (len(missed), len(linked)) == (0, 0)


def test_hot_buckets_give_the_same_components(spark):
    """Pairs at 0.8 among copies of one template: the size at which a bucket is cut must not decide which are found."""
    rng, rows = random.Random(3), []
    template = [f"t{i}" for i in range(104)]
    for i in range(160):
        cut = rng.choice([0, 10, 20, 30])
        rows.append((i, " ".join(template[cut:] + [f"u{i}y{k}" for k in range(rng.choice([4, 9, 14, 20]))]), "en", "a"))
    docs = frame(spark, rows).cache()
    plain = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t, *_ in rows]
    want = brute_components(range(len(rows)), lambda a, b: 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b]))
    for split_at, at_most in ((1 << 15, 1 << 24), (4, 1 << 24), (1 << 15, 1000), (4, 1000)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, split_at=split_at, at_most=at_most).collect()}
        assert got == want, (split_at, at_most)


def test_chains_of_links_are_exact():
    rng = np.random.default_rng(5)
    sets = []
    for g in range(6):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(12):
            base = np.concatenate([base[rng.integers(0, 12):], rng.integers(0, 1 << 62, int(rng.integers(0, 12))).astype(np.uint64)])
            sets.append(np.unique(base))
    got = list(range(len(sets)))
    for i, j in simhash.similar_links(sets):
        low, high = sorted((got[i], got[j]))
        got = [low if x == high else x for x in got]
    plain = [set(h.tolist()) for h in sets]
    assert got == list(brute_components(range(len(sets)), lambda a, b: 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])).values())


def test_counters_compare_with_any_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 62, (40, 2)).astype(np.uint64)
    for k in range(1, 40):
        prints[k] = prints[k // 2] ^ np.array([sum(1 << int(b) for b in rng.choice(62, 5, replace=False)) for _ in range(2)], np.uint64)
    for radius in (0, 9, 10, 21, 30):
        i, root = simhash.bucket_links(np.zeros(40, np.int64), prints, radius, chunk=7)
        got = np.arange(40)
        got[i] = root
        want = brute_components(range(40), lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= radius)
        assert [int(x) for x in got] == [want[k] for k in range(40)]


def test_simhash_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(edge_rows())
    texts = collections.defaultdict(set)
    for i, t, *_ in edge_rows():
        texts[i].add("%016x" % brute_print(t))
    assert all(r["fingerprint"] in texts[r["doc_id"]] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 1 and by[7]["component_id"] == by[6]["component_id"] == 6 and by[5]["component_id"] == 4 and by[None]["component_id"] == 4
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([1, 4, 4, 6, 8, 9, None])


# ---- 3: toxicity

@pytest.fixture(scope="module")
def letters():
    """A character model of a few English words."""
    counts = toxicity.trigram_counts(["the idiot and the clown are stupid losers in this silly story of a moron who sees trash well and good"] * 50).astype(float).reshape(64, 64, 64)
    pair = counts.sum(axis=0) + 0.1
    pair /= pair.sum(axis=1, keepdims=True)
    return np.log((counts + 5.0 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


@pytest.mark.parametrize("written", ["1d10t", "i.d.i.o.t", "i d i o t", "idiiiiooot", "id!0t", "id-i-ot", "id*ot", "1.d.1.0.t", "i*d*i*o*t"])
def test_noisy_words_are_restored(letters, written):
    assert "idiot" in toxicity.Reader(letters).words("this " + written + " here")


@pytest.mark.parametrize("plain", ["well", "Stupid,", "story.", "(good)", "sees!!", "the***"])
def test_plain_words_stay(letters, plain):
    assert toxicity.Reader(letters).words(plain) == [re.sub(r"[\W_]", "", plain.lower())]


def test_decoding_is_the_best_path(letters):
    """Against all readings of a short token, one by one."""
    for token in ("1d10t", "cl0wn", "st.u", "l00s", "@nd"):
        best = None
        paths = [("", 0.0)]
        for options in toxicity.lattice(token):
            paths = [(t + c, v + cost) for t, v in paths for c, cost in options]
        for t, v in paths:
            a = b = 0
            for c in t:
                v += float(letters[a, b, toxicity.symbol(c)])
                a, b = b, toxicity.symbol(c)
            v += float(letters[a, b, 0])
            best = max(best or (v, t), (v, t))
        got = toxicity.decode(token, letters)
        value = max(v for t, v in [(t, sum(float(letters[x, y, z]) for x, y, z in zip([0, 0] + [toxicity.symbol(c) for c in t], [0] + [toxicity.symbol(c) for c in t], [toxicity.symbol(c) for c in t] + [0])) + v) for t, v in paths] if t == got)
        assert abs(value - best[0]) < 1e-4, (token, got, best)


def auc(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()) if len(pos) and len(neg) else 1.0


def held_out(spark, sf_dir, query, label):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and known.get(r["doc_id"]) is not None]
    return [known[r["doc_id"]] for r in held], [r["score"] for r in held], [r["predicted"] for r in held]


def test_toxicity_on_held_out_labels(spark):
    y, s, p = held_out(spark, "/root/testdata/sf0.01", "op3_toxicity", "toxic")
    assert auc(y, s) > 0.93 and np.mean(np.array(y) == np.array(p)) > 0.9


def test_toxicity_edges(spark, edges, nothing, labels):
    got = toxicity.score(edges, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.score(nothing, labels).count() == 0 and toxicity.score(edges, labels.limit(0)).count() == len(edge_rows())
    kept = toxicity.drop_toxic(edges, labels)
    assert kept.columns == edges.columns and kept.schema == edges.schema


# ---- 4: quality

def test_quality_gradient():
    rng = np.random.default_rng(1)
    x, starts, label = rng.normal(size=(9, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    m = quality.Model(5, hidden=4, gate=3)
    y, kept = m.forward(x, starts)
    g = m.gradient(label, y, kept, starts, 0.0)
    loss = lambda: -np.mean(label * np.log(m.forward(x, starts)[0]) + (1 - label) * np.log(1 - m.forward(x, starts)[0]))
    for k, p in m.p.items():
        for at in list(np.ndindex(p.shape))[:4]:
            old, eps = p[at], 1e-6
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-6, (k, at)


def test_one_bad_passage_is_found():
    """Bags of noise, of which bad ones hold one passage of another kind: attention must find it."""
    rng = np.random.default_rng(2)
    bags, y = [], []
    for i in range(400):
        b = rng.normal(size=(rng.integers(2, 10), 6))
        if i % 2:
            b[rng.integers(len(b))] += np.array([3, 0, 0, -3, 0, 0])
        bags.append(b), y.append(float(i % 2))
    m = quality.Model(6).fit(bags[:300], np.array(y[:300]))
    starts = np.cumsum([0] + [len(b) for b in bags[300:-1]])
    assert auc(y[300:], m.forward(np.concatenate(bags[300:]), starts)[0]) > 0.95


def test_quality_on_held_out_labels(spark):
    y, s, p = held_out(spark, "/root/testdata/sf0.01", "op4_quality", "quality")
    assert auc(y, s) > 0.93 and np.mean(np.array(y) == np.array(p)) > 0.9


def plain_score(text, m):
    """Encoder, gated attention and logistic unit of one text in plain loops."""
    words = (text or "").encode().split()
    seen, rows = set(), []
    for a in range(0, max(1, len(words)), quality.PASSAGE):
        part = words[a:a + quality.PASSAGE]
        if not part:
            rows.append([0.0] * quality.WIDTH)
            continue
        joined, kinds = b" ".join(part), set(part)
        kind_of = lambda c: (11 if c >= 128 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c <= 32 else
                             {"|": 4, "!": 5, ".": 6, ",": 7, **dict.fromkeys("%&*$#", 8), **dict.fromkeys("'\"()[]{}<>", 9)}.get(chr(c), 10))
        counts = collections.Counter(map(kind_of, joined))
        sizes = [len(w) for w in part]
        mean = sum(sizes) / len(sizes)
        spread = (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5
        rows.append([counts[c] / len(joined) for c in range(quality.CLASSES)] + [mean / 10, spread / 5, len(kinds) / len(part), len(kinds - seen) / len(kinds), sum(s <= 3 for s in sizes) / len(part), sum(s >= 12 for s in sizes) / len(part),
                    counts[6] / len(part), math.log(1 + len(part)) / 4, math.log(1 + len(words)) / 8])
        seen |= kinds
    p = m.p
    sigma = lambda v: 1 / (1 + math.exp(-v))
    codes, gates = [], []
    for x in rows:
        x = [(v - u) / s for v, u, s in zip(x, m.mean, m.scale)]
        e = [math.tanh(sum(v * p["W"][i][k] for i, v in enumerate(x)) + p["b"][k]) for k in range(len(p["b"]))]
        g = sum(p["w"][j] * math.tanh(sum(v * p["V"][i][j] for i, v in enumerate(e))) * sigma(sum(v * p["U"][i][j] for i, v in enumerate(e))) for j in range(len(p["w"])))
        codes.append(e), gates.append(g)
    weights = [math.exp(g - max(gates)) for g in gates]
    z = [sum(w * e[k] for w, e in zip(weights, codes)) / sum(weights) for k in range(len(codes[0]))]
    return sigma(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])


def test_quality_equals_plain_loops(spark):
    """Every document of the small table, scored by the operator and by loops over the same fitted parameters."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Ünï côdé | !!"), (-4, "a " * 64), (-5, "a " * 65)], "doc_id long, text string"))
    m = quality.fit(docs, labels, 5000, 128)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = plain_score(text, m)
        assert abs(got[i]["score"] - want) < 1e-4 and (got[i]["predicted"] == int(want >= 0.3) or abs(want - 0.3) < 1e-4), i


def test_quality_edges(edges, nothing, labels):
    got = quality.score(edges, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score(nothing, labels).count() == 0
    assert {r["score"] for r in quality.score(edges, labels.limit(0)).collect()} == {0.5}


# ---- 5: line dedup

def brute_lines(rows, min_words):
    """Kept text by (doc_id, text): every run of at least min_words words that stands earlier goes."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    seqs = [[(n, " ".join(lower(x).split())) for n, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    first, out = {}, {}
    for mark in (False, True):
        for d, seq in enumerate(seqs):
            gone = set()
            for a in range(len(seq)):
                for b in range(a, len(seq)):
                    if sum(len(x.split()) for _, x in seq[a:b + 1]) >= min_words:
                        key = tuple(x for _, x in seq[a:b + 1])
                        if not mark:
                            first.setdefault(key, (docs[d][0], seq[a][0]))
                        elif first[key] < (docs[d][0], seq[a][0]):
                            gone |= set(range(seq[a][0], seq[b][0] + 1))
            if mark:
                out[docs[d]] = "\n".join(x for n, x in enumerate(docs[d][1].split("\n")) if n not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_runs_go(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([1, 2, 3, 12])) for _ in range(9)]
    rows = [(i, "\n".join(rng.choice(pool + ["", prose(rng, 4)]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    want = brute_lines(rows, 8)
    df = clashing(frame(spark, [(i, t, "en", "a") for i, t in rows])).repartition(5)
    got = linededup.remove_repeated_lines(df, 8).collect()
    assert len(got) == len(rows) and sum(r["_n_removed"] for r in got) > 0
    for r in got:
        assert r["text"] == want[r["doc_id"], dict(rows)[r["doc_id"]]]


def test_line_dedup_edges(edges, nothing):
    got = linededup.remove_repeated_lines(edges)
    assert got.columns == edges.columns + ["_n_lines", "_n_removed"]
    rows = got.collect()
    assert len(rows) == len(edge_rows()) and {r["text"] for r in rows if r["doc_id"] in (1, 7)} == {None, ""} and [r["text"] for r in rows if r["doc_id"] is None] == ["one two"]
    assert linededup.remove_repeated_lines(nothing).count() == 0


# ---- 6: language

def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op6_language"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.97


def test_mixture_shares():
    rng = np.random.default_rng(0)
    like = rng.normal(-60, 2, (200, 3))
    like[:150, 0] += 12
    like[150:, 2] += 12
    s = langid.shares(like)
    assert abs(s[0] - 0.75) < 0.05 and s[1] == 0 and abs(s[2] - 0.25) < 0.05
    assert (langid.shares(like[:150]) == [1, 0, 0]).all()


def test_mixture_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 5))
        units = rng.normal(-40, 6, (n, k))
        share = [1 / k] * k
        for _ in range(25):
            own = []
            for u in units:
                top = max(u)
                part = [s * math.exp(v - top) for s, v in zip(share, u)]
                own.append([x / sum(part) for x in part])
            new = [sum(o[j] for o in own) / n for j in range(k)]
            settled = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
            share = new
            if settled:
                break
        value = sum(max(u) + math.log(sum(s * math.exp(v - max(u)) for s, v in zip(share, u))) for u in units)
        got, ll = langid.mixture(units)
        assert np.allclose(got, share, atol=1e-9) and abs(ll - value) < 1e-6


def test_chosen_languages_are_the_best_of_all_subsets():
    """Units of one, two or three of five languages: the set found by growing is the one with the best penalised likelihood of all."""
    rng = np.random.default_rng(6)
    for case in range(40):
        k, n = 5, int(rng.integers(12, 80))
        true = rng.choice(k, size=1 + case % 3, replace=False)
        units = rng.normal(-60, 2, (n, k))
        units[np.arange(n), true[np.arange(n) % len(true)]] += 15
        value = {}
        for size in range(1, k + 1):
            for part in itertools.combinations(range(k), size):
                value[part] = langid.mixture(units[:, list(part)])[1] - 2.0 * math.log(1 + n) * (size - 1)
        best = max(value, key=value.get)
        s = langid.shares(units)
        assert set(np.flatnonzero(s > 0)) <= set(best) and abs(s.sum() - 1) < 1e-6 and set(best) == set(true.tolist()), case
        assert int(s.argmax()) in best


def test_language_equals_a_plain_count(spark):
    """Trigram tables counted by a dictionary give the operator's predictions."""
    train = [(0, "der hund und die katze im haus", "de", "a"), (1, "the dog and the cat in the house", "en", "a"), (3, "le chien et le chat dans la maison", "fr", "a"), (4, "und der mann geht in das haus", "de", "a"), (7, "and the man goes into the house", "en", "a")]
    ask = [(100, "der mann und die katze", None, "a"), (101, "the man and the dog", None, "a"), (102, "le chat et le chien", None, "a")]
    counts = {}
    for _, text, lang, _ in train:
        for g in langid.trigrams(text.encode()).tolist():
            counts.setdefault(lang, collections.Counter())[g] += 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, ask), frame(spark, train)).collect()}
    for i, text, _, _ in ask:
        score = {x: sum(math.log((counts[x][g] + 0.5) / total[x]) for g in langid.trigrams(text.encode()).tolist()) for x in langs}
        assert got[i] == max(score, key=score.get)


def test_language_edges(edges, nothing):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(edges).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= got and all(p in ("en", "de", "fr", "und") for _, p in got)
    assert {r["lang_pred"] for r in langid.identify(frame(edges.sparkSession, [(1, "½ ² 42 _", None, "a")]), edges).collect()} == {"und"}
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edges, nothing).collect()} == {"und"}


# ---- 7: exact

def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 100, 5000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = exact.build_filter(keys)
        assert exact.probe_filter(keys, **f).all()
        others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
        assert exact.probe_filter(others, **f).mean() < 0.01 + 2 / (256 if n > 1 else 128)
        assert n < 5000 or len(f["table"]) < 1.6 * n


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t or "")] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[lower(t or "")]), i is not None and i == keep, hashlib.sha256(lower(t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_of_equal_texts(spark, digest_bytes):
    rng = random.Random(1)
    texts = [rng.choice(["Ab", "aB", "ÀB", "àb", "", "x", "y " * 9]) + str(rng.choice(["", "", 1, 2, 3])) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None)]
    got = exact.exact_duplicates(clashing(frame(spark, [(i, t, "en", "a") for i, t in rows])).repartition(5), digest_bytes=digest_bytes, keys_per_filter=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_exact_edges(edges, nothing):
    assert sorted(map(tuple, exact.exact_duplicates(edges).collect()), key=str) == brute_exact([(r[0], r[1]) for r in edge_rows()])
    assert exact.exact_duplicates(nothing).count() == 0


# ---- 8: URLs

URLS = [("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://example.com", "example.com", "", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("ftp://net/es/1", "net", "/es/1", "net/es/", "block"), ("http://a.net/ES/1", "a.net", "/ES/1", None, None),
        ("http://a.net?x/fr/", "a.net", "", None, None), ("no url", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None)]


def test_urls_and_rules(spark):
    pages = clashing(spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")).drop("host").withColumn("domain", F.lit(1))
    got = {r["page_id"]: r for r in urls.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_reputation_shrinks_to_the_level_above(spark):
    pages, bad = [], []
    for h, (host, n, y) in enumerate([("spam.bad.org", 60, 58), ("ads.bad.org", 40, 39), ("new.bad.org", 0, 0), ("a.good.org", 80, 2), ("new.good.org", 1, 1), ("b.fine.com", 90, 5)]):
        for k in range(max(n, 2)):
            pages.append((h * 100 + k, f"http://{host}/p{k}"))
            if k < n:
                bad.append((h * 100 + k, int(k < y)))
    verdicts = {r["host"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(pages + [(None, "http://new.good.org/")], "page_id long, url string"), spark.createDataFrame(bad + [(None, 1), (5, None)], "page_id long, bad int"), rules=()).collect()}
    assert verdicts == {"spam.bad.org": "block", "ads.bad.org": "block", "new.bad.org": "block", "a.good.org": "allow", "new.good.org": "allow", "b.fine.com": "allow"}


@pytest.mark.parametrize("suffixes", [urls.LONG_SUFFIXES, ["co.uk", "k12.ca.us", "ca.us"], []])
def test_registered_domains(spark, suffixes):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "", "x.y.k12.ca.us", "k12.ca.us", "z.ca.us", "www.example.com", "..", "a."]
    got = {r["host"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *[c.alias(n) for c, n in zip(urls.registered_domain(F.col("host"), suffixes), "ds")]).collect()}
    for h in hosts:
        labels = h.split(".")
        k = max([s.count(".") + 1 for s in suffixes if h == s or h.endswith("." + s)], default=1)
        assert got[h] == (".".join(labels[-k - 1:]), ".".join(labels[-k:])), h


def test_verdicts_equal_the_sql_under_long_suffixes(spark, tmp_path):
    """An unlabelled host under a bad registered domain of a two-label suffix, beside good ones under the same suffix."""
    rng = random.Random(3)
    hosts = [f"h{k}.a{a}.{s}" for k in range(4) for a in range(5) for s in ("co.uk", "com", "org.au", "uk")] + ["new.a0.co.uk", "new.a1.co.uk", "new.a0.uk"]
    pages = [(i, f"https://{h}/p") for i, h in enumerate(h for h in hosts for _ in range(6))]
    bad = {u: 0.95 if ".a0." in u else 0.05 for _, u in pages}
    labels = [(i, int(rng.random() >= bad[u]), 0) for i, u in pages if "new." not in u]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.execute(queries.SQL["op8_url_filter"])
    names = [d[0] for d in rel.description]
    want = {dict(zip(names, r))["page_id"]: tuple(dict(zip(names, r))[c] for c in ("host", "path", "rule", "verdict")) for r in rel.fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.queries()["op8_url_filter"](spark, tmp_path).collect()}
    assert got == want
    assert {v[3] for v in got.values() if v[0] == "new.a0.co.uk"} == {"block"} and {v[3] for v in got.values() if v[0] == "new.a1.co.uk"} == {"allow"}


# ---- 9: suffix dedup

def brute_bytes(texts, length=200):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, split_at", [(0, 1 << 13), (1, 1 << 13), (2, 3), (3, 2)])
def test_repeated_substrings(spark, seed, split_at):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abcde \n") for _ in range(rng.choice([90, 199, 200, 201, 260, 700]))) for _ in range(7)]
    texts = ["".join(rng.choice(blocks) if rng.random() < 0.6 else "".join(rng.choice("xyzé") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(0, 5))) for _ in range(40)] + ["ab" * 300, "q" * 450, "ab" * 120, "", "x" * 199, "x" * 200]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r[0]: tuple(r)[1:] for r in suffix.repeated_substrings(clashing(frame(spark, rows)).repartition(4), split_at).collect()}
    want = brute_bytes([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_suffix_sort_orders_and_extends():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    keys = np.sort(np.array([rng.randint(0, 5) for _ in parts]))
    order, near, _, _ = suffix._sorted_sides(parts, keys, False)
    assert [(keys[i], parts[i]) for i in order] == sorted((k, p) for k, p in zip(keys, parts))
    for k in range(1, 300):
        x, y = parts[order[k - 1]], parts[order[k]]
        if keys[order[k - 1]] == keys[order[k]]:
            assert near[k] == next((j for j, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_long_texts_in_pieces_give_the_same_anchors():
    rng = random.Random(6)
    text = bytes(rng.choice(b"abcdef") for _ in range(5000))
    whole = suffix.anchors([(0, text)])
    pieces = suffix.anchors([(0, text)], piece=333)
    rows = lambda a: {(int(p), int(g), int(c)) for _, p, g, c in zip(*a)}
    assert rows(whole) == rows(pieces)


def test_classes_of_surroundings_are_classes_of_bytes():
    """Same class if and only if the bytes around the anchor, up to the ends of the text, are the same; whatever the polynomial hash says."""
    rng = random.Random(12)
    part = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    shared = [part(450) for _ in range(4)]
    texts = [b"".join(rng.choice([part(rng.randrange(150)), rng.choice(shared)]) for _ in range(6)) for _ in range(40)] + [b"a" * 900, b"a" * 700, shared[0][:300]]
    number, place, gram, around = suffix.anchors(enumerate(texts))
    by_class, by_bytes = collections.defaultdict(set), collections.defaultdict(set)
    for i, p, g, d in zip(number.tolist(), place.tolist(), gram.tolist(), around.tolist()):
        low = max(0, p - (suffix.LENGTH - suffix.GRAM))
        seen = (texts[i][low:p], texts[i][p:p + suffix.LENGTH])
        by_class[g, d].add(seen), by_bytes[seen].add((g, d))
    assert len(by_class) == len(by_bytes) < len(place) and all(len(v) == 1 for v in [*by_class.values(), *by_bytes.values()])


def test_comparing_takes_little_memory_whatever_the_batch():
    """30,000 rows of 10,000 anchors in one batch: the same windows as compared at once, in a part of the memory."""
    rng = np.random.default_rng(5)
    rows = []
    for key in range(10_000):
        text = rng.integers(97, 123, 336).astype(np.uint8)
        for k in range(3):
            text[rng.integers(0, 136)] = 65
            rows.append((key, key, k, 0, 136, text[:136].tobytes(), text[136:].tobytes()))
    columns = list(zip(*rows))
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], suffix.SNIPPET)
    tracemalloc.start()
    got = {(g, k): mask for out in suffix._compare([batch]) for g, k, mask in zip(*(out.column(i).to_pylist() for i in range(3)))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    at = slice(0, 3000)
    whole = suffix.repeated_offsets(np.array(columns[0][at]), columns[5][at], columns[6][at], np.array(columns[3][at]), np.array(columns[4][at]))
    for (_, gram, k, *_), found in zip(rows, whole):
        bits = np.unpackbits(np.frombuffer(got.get((gram, k), b""), np.uint8), bitorder="little")
        assert set(np.flatnonzero(bits)) == set(np.flatnonzero(found))
    assert 1000 < len(got)


def test_suffix_edges(edges, nothing):
    rows = edge_rows()
    got = sorted(map(tuple, suffix.repeated_substrings(edges).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute_edges(rows))), key=str)
    assert suffix.repeated_substrings(nothing).count() == 0


def brute_edges(rows):
    """The two long texts repeat themselves: all of them goes; the others are short."""
    for r in rows:
        t = (r[1] or "").encode()
        yield (len(t), len(t), 1, hashlib.sha256(b"").hexdigest()) if len(t) >= 200 else (len(t), 0, 0, hashlib.sha256(t).hexdigest())


# ---- 10: decontamination

def edit_search(item, region):
    prev = list(range(len(item) + 1))
    best = len(item)
    for w in region:
        cur = [0]
        for i, x in enumerate(item):
            cur.append(min(prev[i] + (x != w), prev[i + 1] + 1, cur[i] + 1))
        best = min(best, cur[-1])
        prev = cur
    return best


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(200):
        item, region = [rng.randint(1, 4) for _ in range(rng.randint(1, 90))], [rng.randint(0, 4) for _ in range(rng.randint(0, 100))]
        assert decontam.best_distance(item, region) == edit_search(item, region)


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice(vocabulary)
        elif kind < 0.7:
            out.insert(at, rng.choice(vocabulary))
        else:
            del out[at]
    return out


def test_items_within_distance_are_found(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 15, 30, 60]))]) for i in range(40)]
    docs, at_limit = [], []
    for d in range(300):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 2:
            i, w = rng.choice(items)
            k = rng.randrange(len(body) + 1)
            body[k:k] = edited(rng, w, rng.randint(0, decontam.allowed(len(w)) + 2), vocabulary)
        docs.append((d, " ".join(x.upper() + "." if rng.random() < 0.2 else x for x in body)))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(clashing(frame(spark, [(d, t, "en", "a") for d, t in docs])), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), block_items=15).collect()}
    want = {}
    for d, t in docs:
        words = [x.decode() for x in decontam.words_of(t.encode())]
        for i, w in items:
            n = edit_search(w, words)
            if n <= decontam.allowed(len(w)):
                want[d, i] = n
    assert set(got) <= set(want) and len(want) > 80
    assert len(set(got) & set(want)) >= 0.97 * len(want) and all(got[k] == 0 for k in want if want[k] == 0)


def test_decontamination_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "ONE, two!"), (4, "alpha beta gamma delta alpha beta gamma delta")], "item_id long, text string")
    got = collections.Counter(map(tuple, decontam.contaminated(edges, bench).collect()))
    ids = collections.Counter(d for d, i, _ in got.elements() if i == 4)
    assert set(ids) == {6, 7} and {d for d, i, _ in got if i == 1} == {4, 5, None} and {d for d, i, _ in got if i is None} == {4, 5, None}
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(edges, bench.limit(0)).count() == 0
    kept = decontam.drop_contaminated(edges, bench)
    assert kept.columns == edges.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 8, 9}  # the row without an id holds item 1 and goes


def test_items_and_documents_without_an_id_are_all_judged(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    bench = spark.createDataFrame([(None, text(k)) for k in range(40)] + [(k, text(k)) for k in range(40, 60)], "item_id long, text string").repartition(4)
    docs = frame(spark, [(k, "before " + text(k) + " after", "en", "a") for k in range(60)] + [(None, text(3), "en", "a"), (None, text(90), "en", "b"), (5, text(91), "en", "c"), (70, text(92), "en", "d"), (None, None, "en", "e")])
    got = decontam.contaminated(docs, bench, block_items=7).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == set(range(60)) and sum(r["doc_id"] is None for r in got) == 1 and len(got) == 61
    kept = sorted((r["source"], r["doc_id"]) for r in decontam.drop_contaminated(docs, bench).collect())
    assert kept == [("b", None), ("c", 5), ("d", 70), ("e", None)]


# ---- queries

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in df.columns) for r in rel.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want
