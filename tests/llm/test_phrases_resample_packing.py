"""Phrase mining, importance resampling and packing against brute force, their edge cases, and the recall of decontamination."""
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontam, packing, phrases, queries, resample
from test_operators_llm import clashing, edge_rows, edit_search, frame, lower


@pytest.fixture(scope="module")
def edges(spark):
    return clashing(frame(spark, edge_rows())).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(frame(spark, []))


# ---- 11: phrases

def brute_phrases(rows, least, top, longest=4):
    """lang -> [(phrase, a, l, r, n, score)] by the rules, from all pieces of all texts."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in range(1, longest + 1):
                for i in range(len(w) - d + 1):
                    f[lang or "und"][tuple(w[i:i + d])] += 1
    out = {}
    for lang, counts in f.items():
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inside = lambda p, q: len(p) < len(q) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_of = []
        for p in found:
            if not any(inside(p, q) and 100 * counts[q] >= 80 * counts[p] for q in found):
                cuts = [(2000000 * counts[p] // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_of.append((" ".join(p), counts[p], counts[p[:k]], counts[p[k:]], n[lang], score))
        rows_of.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        if rows_of:
            out[lang] = rows_of[:top]
    return out


@pytest.mark.parametrize("shard_words", [50, 1 << 20])
def test_phrases_equal_brute_force(spark, shard_words):
    rng = random.Random(3)
    words = ["the", "The", "of", "new", "york", "city", "hall", "très", "漢字", "x1", "a-b", "\x00z"]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.4:
            text += " new york city hall " + " ".join(["echo"] * rng.randint(1, 9))
        rows.append((rng.choice(["en", "en", "fr", None]), rng.choice([text, text, text, None]) if rng.random() < 0.1 else text))
    df = clashing(frame(spark, [(i, t, lang, "a") for i, (lang, t) in enumerate(rows)])).repartition(4)
    got = collections.defaultdict(list)
    for r in phrases.collocations(df, least=5, top=40, shard_words=shard_words).orderBy("lang", "rank").collect():
        got[r["lang"]].append((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
        assert r["rank"] == len(got[r["lang"]])
    assert dict(got) == brute_phrases(rows, 5, 40) and max(len(p[0].split(" ")) for v in got.values() for p in v) == 4


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_shorter_phrases(spark, longest):
    rows = [(1, "a b c a b c a b c d", "en", "a"), (2, "a b, c d a b", "en", "a")]
    got, totals = phrases.frequent_phrases(frame(spark, rows), least=2, longest=longest)
    want = collections.Counter(tuple(p[i:i + d]) for p in (rows[0][1].split(), ["a", "b"], ["c", "d", "a", "b"]) for d in range(1, longest + 1) for i in range(len(p) - d + 1))
    assert {tuple(r["phrase"].split()): r["f"] for r in got.collect()} == {p: n for p, n in want.items() if n >= 2} and totals.first()["n"] == 16
    with pytest.raises(ValueError):
        phrases.frequent_phrases(frame(spark, rows), longest=5)


def test_index_extends_both_ways():
    rng = np.random.default_rng(0)
    for _ in range(150):
        symbols = int(rng.integers(1, 6))
        text = np.concatenate([[0], rng.integers(0, symbols + 1, int(rng.integers(1, 60))), [0]]).astype(np.int32)
        symbols = int(text.max())
        if set(text.tolist()) - {0} != set(range(1, symbols + 1)) or not symbols:
            continue
        t = text.tolist()
        count = {d: collections.Counter(tuple(t[i:i + d]) for i in range(len(t) - d + 1) if 0 not in t[i:i + d]) for d in (1, 2, 3, 4)}
        s = phrases.Shard(phrases.transform(text), phrases.transform(text[::-1]), symbols)
        known = np.where(rng.random(symbols) < 0.8, np.arange(symbols) + 1, 0)
        s.know(np.arange(symbols), known)
        head, tail, n = s.grow_right()
        two = list(zip(head.tolist(), tail.tolist()))
        assert dict(zip(two, n.tolist())) == {g: k for g, k in count[2].items() if known[g[0] - 1] and known[g[1] - 1]}
        known = np.where(rng.random(len(two)) < 0.8, np.arange(len(two)) + 1, 0)
        s.know(np.arange(len(two)), known)
        live = {g for g, k in zip(two, known) if k}
        head, tail, n = s.grow_right()
        three = [two[a - 1] + two[b - 1][1:] for a, b in zip(head.tolist(), tail.tolist())]
        assert dict(zip(three, n.tolist())) == {g: k for g, k in count[3].items() if g[:2] in live and g[1:] in live}
        for g, low, back, k in zip(three, s.levels[2]["low"], s.levels[2]["back"], n):
            rotations = sorted(range(len(t)), key=lambda i: (t[i:] + t[:i])[:3])
            assert sorted(s.forward.bwt[low:low + k].tolist()) == sorted(t[i - 1] for i in rotations[low:low + k]) and k == count[3][g]
        a, b, c, n = s.grow_left()
        four = [two[i - 1] + two[j - 1][1:] + two[k - 1][1:] for i, j, k in zip(a.tolist(), b.tolist(), c.tolist())]
        assert dict(zip(four, n.tolist())) == {g: k for g, k in count[4].items() if all(g[i:i + 2] in live for i in range(3))}


def test_phrase_edges(spark, edges, nothing):
    assert phrases.collocations(nothing).count() == 0 and phrases.collocations(edges.filter("text is null")).count() == 0
    got = {(r["lang"], r["phrase"]): (r["a"], r["rank"]) for r in phrases.collocations(edges).collect()}
    want = brute_phrases([(r[2], r[1]) for r in edge_rows()], 30, 2000)
    assert got == {(lang, p[0]): (p[1], i + 1) for lang, v in want.items() for i, p in enumerate(v)} and ("und", "alpha beta gamma delta") in got
    twice = {(r["lang"], r["phrase"]): r["a"] for r in phrases.collocations(edges.unionByName(edges)).collect()}
    assert all(twice[k] == 2 * a for k, (a, _) in got.items())


# ---- 12: resampling

def brute_resample(docs, target, percent=25, least_words=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    feats = lambda w: [*w, *(a + " " + b for a, b in zip(w, w[1:]))]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for text in texts for f in feats(split(text))) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for doc_id, text in docs:
        w = split(text)
        g = [gain(bucket(f)) for f in feats(w)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("share", [1, 20, 1 << 17])
def test_resampling_equals_brute_force_whatever_the_head(spark, share):
    rng = random.Random(6)
    words = ["stone", "River", "der", "die", "éa", "漢字", "a1", "x" * 90, "z-z", "q_r", "o\x7fo"]
    docs = [(rng.choice([i, i, i, 7, None]), rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    target = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(8)] + [None, ""]
    got = resample.resample(clashing(frame(spark, [(i, t, "en", "a") for i, t in docs])).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), share=share)
    rows = got.collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == brute_resample(docs, target)
    assert all(r["drawn"] == (r["rank"] is not None) for r in rows) and sum(r["drawn"] for r in rows) > 10


def test_resampling_edges(spark, edges, nothing):
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    got = sorted((tuple(r) for r in resample.resample(edges, target).drop("drawn").collect()), key=str)
    assert got == brute_resample([(r[0], r[1]) for r in edge_rows()], ["alpha beta", None])
    assert resample.resample(nothing, target).count() == 0
    assert sorted((tuple(r) for r in resample.resample(edges, target.limit(0)).drop("drawn").collect()), key=str) == brute_resample([(r[0], r[1]) for r in edge_rows()], [])


def test_head_buckets_are_exact():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdefgh\xc3\xa9") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    h = resample.Head(words[:100], [(rng.choice(words[:150]), rng.choice(words[:150])) for _ in range(400)], 10000)
    text = [rng.choice(words) for _ in range(3000)]
    ends = np.array([0, 10, 10, 700, 701, 3000])
    one, at, two = h.features(text, ends)
    assert one.tolist() == [zlib.crc32(w) % 10000 for w in text]
    pairs = [i for b, e in zip([0, *ends], ends) for i in range(b, e - 1)]
    assert at.tolist() == pairs and two.tolist() == [zlib.crc32(text[i] + b" " + text[i + 1]) % 10000 for i in pairs]


# ---- 13: packing

def fewest(items, capacity):
    """The least number of sequences, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])
    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([10, 20, 37]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=10))))
def test_fixed_sets_never_cost_a_sequence(case):
    capacity, items = case
    stock = packing._Stock(collections.Counter(items))
    fixed = packing.fixed_sets(stock, capacity)
    rest = [s for s, n in stock.left.items() for _ in range(n)]
    assert all(sum(s) <= capacity and len(s) <= 3 for _, s in fixed)
    assert sorted(rest + [x for n, s in fixed for _ in range(n) for x in s]) == sorted(items)
    assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=300))))
def test_plans_are_gapless_and_best_fit(case):
    capacity, items = case
    counts, placed = collections.Counter(items), {}
    for size, first, number, sequence, each, offset in packing.plan(counts, capacity):
        for i in range(number):
            assert (size, first + i) not in placed
            placed[size, first + i] = sequence + i // each, offset + i % each * size
    assert sorted(placed) == [(s, i) for s in sorted(counts) for i in range(counts[s])]
    held = collections.defaultdict(list)
    for (size, _), (sequence, offset) in placed.items():
        held[sequence].append((offset, size))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= capacity
    stock = packing._Stock(counts)
    bins, rooms = sum(n for n, _ in packing.fixed_sets(stock, capacity)), []
    for size in sorted((s for s, n in stock.left.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= size), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - size)
    assert len(held) == max(held) + 1 == bins + len(rooms)


def test_a_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    sizes = np.minimum(1024, rng.exponential(200, 200000).astype(int) + 1)
    counts = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)]))
    small, large = packing.plan(counts, 1024), packing.plan({s: 10**6 * n for s, n in counts.items()}, 1024)
    assert len(large) < 2 * len(small) < 10000
    used = max(s + (n - 1) // e for _, _, n, s, e, _ in small) + 1
    assert used <= -(-int(sizes.sum()) // 1024) + 2


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers_ids(tokenizer):
    encode = packing.encoder()
    rng = random.Random(0)
    pool = [chr(c) for c in (9, 10, 13, 28, 32, 32, 32, 39, 48, 65, 97, 97, 115, 116, 133, 160, 223, 769, 0x4e2d, 0x200b, 0x1f600, 0xe000, 0x10ffff)] + ["'s", "'LL", " the", "<|endoftext|>", "�", "ﬁ", "٣", "²"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "a" * 3000, " " * 3000, "<|endoftext|>"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == want.ids, text


def brute_pieces(tokenizer, docs, capacity=1024, end=2):
    out = []
    for (doc_id, text), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids, cut = [*e.ids, end], len(e.ids) + 1
        bounds = [0, *range(cut % capacity or capacity, cut + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return out


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing_is_whole_gapless_and_readable(spark, tokenizer, capacity):
    rng = random.Random(2)
    docs = [(rng.choice([i, i, 3, None]), rng.choice([None, "", "same text", " ".join(rng.choice(["stone", "river", "été", "漢字", "x"]) for _ in range(rng.randint(0, 900)))])) for i in range(120)]
    df = clashing(frame(spark, [(i, t, "en", "a") for i, t in docs])).repartition(4)
    packed = packing.pack(df, capacity, with_ids=True).cache()
    rows = packed.collect()
    want = brute_pieces(tokenizer, docs, capacity)
    plain = lambda r: tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
    assert sorted(map(plain, rows), key=str) == sorted((w[:5] for w in want), key=str)
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    whole = {}
    for s, parts in held.items():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) <= capacity
        whole[s] = [i for p in parts for i in p[2]]
    assert {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packed).collect()} == whole
    assert len(held) <= 1.1 * sum(w[3] for w in want) / capacity + 2 and sorted(sum(whole.values(), [])) == sorted(i for w in want for i in w[5])


def test_packing_edges(spark, edges, nothing, tokenizer):
    assert packing.pack(nothing).count() == 0
    got = packing.pack(edges).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted((w[:5] for w in brute_pieces(tokenizer, [(r[0], r[1]) for r in edge_rows()])), key=str)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(edges).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# ---- 10: recall of the walks

@pytest.mark.parametrize("n", [1, 3, 5, 6, 8, 10, 15, 24, 40, 59, 100, 150])
def test_recall_of_the_walks_at_the_limit(n):
    """Items at the limit of edits, edits at random or evenly spread, beside brute force; the longest item of the block must not matter."""
    rng = random.Random(n)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 4000)}"
    items = [(i, " ".join(word() for _ in range(n)).encode()) for i in range(80)] + [(999, " ".join(word() for _ in range(rng.choice([30, 200]))).encode())]
    index, missed, trials = decontam.Index(items), 0, 0
    for i, text in items[:-1]:
        for even in (True, False):
            words = text.decode().split()
            k = decontam.allowed(n)
            for e in range(k):
                at = (e * n // k + rng.randint(0, 1)) % len(words) if even else rng.randrange(len(words))
                kind = 0 if even else rng.randrange(3)
                words[at:at + (kind < 2)] = [[f"new{rng.random()}"], [], [word()]][kind]
            around = [word() for _ in range(20)]
            doc = around[:10] + words + around[10:]
            number = {w: j for j, w in enumerate({*doc, *text.decode().split()})}
            if edit_search([number[w] for w in text.decode().split()], [number[w] for w in doc]) <= k:
                trials += 1
                missed += i not in {index.items[j][0] for _, j, _ in index.matches([" ".join(doc).encode()])}
    assert trials > 100 and missed <= (0.1 if n >= 6 else 0) * trials


def test_walks_agree_with_runs_on_documents(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = [{(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, exact=exact).collect()} for exact in (False, True)]
    assert found[0] <= found[1] and len(found[0]) >= 0.95 * len(found[1]) > 0


@pytest.mark.parametrize("name", ["op11_phrases", "op12_resample"])
def test_new_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == sorted(tuple(str(dict(zip(names, r))[c]) for c in df.columns) for r in rel.fetchall())
