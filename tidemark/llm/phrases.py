"""Phrase collocation mining over FM-indexes of word ids, one per shard of documents.

A shard's words become numbers (0 stands between pieces), its suffixes and those of the reversed text are sorted as deep as the index is asked for, and what is kept is the
Burrows-Wheeler transform of both. A phrase is an interval in each. Extending it by a word to the right is a backward step in the reversed text's transform, to the left one in the
text's own; the other interval follows from the counts of the smaller words beside it, so both stay in step, and all phrases of one length are extended together.

Counts are summed across shards in three rounds: words, pairs of frequent words, and phrases of three and four words whose pairs are all frequent; nothing else can be frequent. A round sums
by one shuffle over the phrases of all shards, and what is frequent goes back to the shards that hold it by shard number. Phrases are known by exact numbers, never by a hash of their text: a
word or a pair by the first place (shard and number in the shard) that holds it, a longer phrase by the numbers of its pairs.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import saved

GAP = b"\xff"  # never a byte of UTF-8
#: A-Z to a-z, ends of pieces to GAP, tabs to spaces.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
DEPTH = 3  # suffixes are sorted by so many words; intervals are right up to this length, counts up to one word more


class _Numbers(dict):
    """Words of one language, numbered together with those of the others."""

    def __init__(self, names):
        super().__init__({GAP: 0})
        self.names = names

    def __missing__(self, word):
        self.names.append(word)
        self[word] = n = len(self.names)
        return n


def transform(text: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a text of small numbers that begins and ends with 0, its rotations sorted by DEPTH symbols."""
    base = int(text.max()) + 1
    key = text.astype(np.int64)
    for ahead in range(1, DEPTH):
        if base ** DEPTH >= 1 << 62:  # the key would not fit: number the shorter keys first
            _, key = np.unique(key, return_inverse=True)
        key = key * base + np.roll(text, -ahead)
    return np.roll(text, 1)[np.argsort(key)]


class Fm:
    """One direction: the transform, where each symbol's rotations begin, and the step of every place to the rotation that starts one symbol earlier."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt, self.base = bwt, symbols + 1
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=self.base))])
        self.step = np.empty(len(bwt), np.int64)
        self.step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))

    def extend(self, low, high):
        """All symbols before the intervals' rotations: (interval, symbol, count, low of the extended interval, smaller symbols before it in the interval), in this order."""
        n = high - low
        owner = np.repeat(np.arange(len(low)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        key, first, count = np.unique(owner * self.base + self.bwt[at], return_index=True, return_counts=True)
        owner, symbol = key // self.base, key % self.base
        before = np.cumsum(count) - count
        return owner, symbol, count, self.step[at[first]], before - (np.cumsum(n) - n)[owner]


class Shard:
    """The index of one shard, and its phrases of growing length, each with its intervals in both directions and the number the whole table gives it (0: not frequent)."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int):
        self.forward, self.backward = Fm(forward, symbols), Fm(backward, symbols)
        low, high = self.forward.begins[1:-1], self.forward.begins[2:]
        self.levels = [{"low": low, "back": low, "n": high - low, "known": np.zeros(len(low), np.int64)}]

    def know(self, places, numbers):
        known = self.levels[-1]["known"]
        known[places] = numbers

    def _place(self, level, head, word):
        """Place of the phrase head + word among those of the length `level`; `head` is a place among those one shorter. -1 if it isn't there."""
        keys = self.levels[level]["key"]
        asked = head * self.forward.base + word
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        return np.where(keys[at] == asked, at, -1) if len(keys) else np.full(len(asked), -1)

    def grow_right(self):
        """Phrases one word longer: frequent ones extended to the right, where the words but the first are frequent too. Returns the numbers of both parts and the count."""
        top = self.levels[-1]
        live = np.flatnonzero(top["known"])
        owner, word, n, back, skip = self.backward.extend(top["back"][live], top["back"][live] + top["n"][live])
        keep = word > 0
        owner, word, n, back, skip = (x[keep] for x in (owner, word, n, back, skip))
        head = live[owner]
        tail = word - 1 if len(self.levels) == 1 else self._place(len(self.levels) - 1, self.levels[-1]["tail"][head], word)
        keep = (tail >= 0) & (top["known"][tail] > 0)
        head, tail, word, n, back, skip = (x[keep] for x in (head, tail, word, n, back, skip))
        self.levels.append({"low": top["low"][head] + skip, "back": back, "n": n, "known": np.zeros(len(n), np.int64), "head": head, "tail": tail, "word": word, "key": head * self.forward.base + word})
        return top["known"][head], top["known"][tail], n

    def grow_left(self):
        """Phrases of four words: those of three, extended to the left where the new first pair is frequent. Returns the numbers of the three pairs and the count."""
        pairs, threes = self.levels[1], self.levels[2]
        owner, word, n, _, _ = self.forward.extend(threes["low"], threes["low"] + threes["n"])
        first, last = threes["head"][owner], threes["tail"][owner]
        pair = np.where(word > 0, self._place(1, np.maximum(word - 1, 0), pairs["head"][first] + 1), -1)
        keep = (pair >= 0) & (pairs["known"][pair] > 0)
        return pairs["known"][pair[keep]], pairs["known"][first[keep]], pairs["known"][last[keep]], n[keep]


def _pack(numbers):
    return pa.compress(np.ascontiguousarray(numbers, "<i4").tobytes(), codec="zstd", asbytes=True)


def _unpack(raw, length):
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 * length, codec="zstd", asbytes=True), "<i4")


_INDEX = "shard long, length long, symbols long, forward binary, backward binary, words array<binary>, counts array<long>, lang_of array<int>, langs array<string>"


def _build(shard_words):
    def index(shard, ids, names, langs, lang_of):
        text = np.array(ids, np.int32)
        counts = np.bincount(text, minlength=len(names) + 1)[1:]
        return pa.RecordBatch.from_pylist([{"shard": shard, "length": len(text), "symbols": len(names), "forward": _pack(transform(text)), "backward": _pack(transform(text[::-1])),
                                            "words": names, "counts": counts.tolist(), "lang_of": lang_of, "langs": langs}], schema)
    schema = pa.schema([("shard", pa.int64()), ("length", pa.int64()), ("symbols", pa.int64()), ("forward", pa.binary()), ("backward", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
                        ("lang_of", pa.list_(pa.int32())), ("langs", pa.list_(pa.string()))])

    def run(batches):
        from pyspark import TaskContext
        shard = (TaskContext.get().partitionId() << 12) + 1  # from 1 on, so that no place is 0
        ids, names, numbers, langs, lang_of = [0], [], {}, [], []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in numbers:
                    numbers[lang] = len(langs), _Numbers(names)
                    langs.append(lang)
                at, number = numbers[lang]
                ids += map(number.__getitem__, text.translate(PIECES).replace(GAP, b" \xff ").split())
                ids.append(0)
                lang_of += [at] * (len(names) - len(lang_of))
                if len(ids) >= shard_words:
                    if names:
                        yield index(shard, ids, names, langs, lang_of)
                    shard += 1
                    ids, names, numbers, langs, lang_of = [0], [], {}, [], []
        if names:
            yield index(shard, ids, names, langs, lang_of)
    return run


PLACES = 28  # bits of a place in its shard


def _shard(index: pa.Table, known: pa.Table) -> Shard:
    """A shard's index with the numbers of its frequent words, and of its frequent pairs if they are known."""
    row = {c: index.column(c)[0].as_py() for c in ("forward", "backward", "length", "symbols")}
    shard = Shard(_unpack(row["forward"], row["length"]), _unpack(row["backward"], row["length"]), row["symbols"])
    at, number = (known.column(c).to_numpy() for c in ("at", "number"))
    level, place = known.column("words").to_numpy(), at & ((1 << PLACES) - 1)
    shard.know(place[level == 1], number[level == 1])
    return shard, level, place, number


_PAIRS = pa.schema([("at", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64())])
_LONGER = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("third", pa.int64()), ("n", pa.int64())])


def _pairs(index: pa.Table, known: pa.Table) -> pa.Table:
    """The pairs of frequent words of one shard."""
    if not index.num_rows or not known.num_rows:
        return _PAIRS.empty_table()
    head, tail, n = _shard(index, known)[0].grow_right()
    at = (index.column("shard")[0].as_py() << PLACES) + np.arange(len(n))
    return pa.table([pa.array(x.astype(np.int64)) for x in (at, head, tail, n)], schema=_PAIRS)


def _longer(longest):
    """The phrases of three words, and of four, all of whose pairs are frequent: the numbers of their pairs and their count in the shard."""
    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        if not index.num_rows or not known.num_rows:
            return _LONGER.empty_table()
        shard, level, place, number = _shard(index, known)
        shard.grow_right()
        shard.know(place[level == 2], number[level == 2])
        first, second, n = shard.grow_right()
        parts = [pa.table([pa.array(first), pa.array(second), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64))], schema=_LONGER)]
        if longest > 3:
            parts.append(pa.table([pa.array(x.astype(np.int64)) for x in shard.grow_left()], schema=_LONGER))
        return pa.concat_tables(parts)
    return run


def _frequent(rows: DataFrame, keys, least) -> DataFrame:
    """The rows of phrases that stand `least` times in all, with that count `f` and the phrase's number, the least `at` that holds it: one shuffle, and a group has a row a shard at most."""
    w = W.partitionBy(*keys)
    return rows.withColumns({"f": F.sum("n").over(w), "number": F.min("at").over(w)}).filter(F.col("f") >= least).drop("n")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, shard_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): every phrase of 1 to `longest` words that stands at least `least` times in its language, and the number of words of each language.

    phrases: words, number (unique among those of as many words), lang, phrase, f, head and tail (numbers of the phrases without its last and its first word), heads and tails (f of its
    first and last 1, 2, ... words). `longest` is at most 4. A shard holds whole documents, about `shard_words` words; places in a shard take 28 bits, shards of a task 12.
    """
    if not 1 <= longest <= DEPTH + 1:
        raise ValueError(f"longest must be 1 to {DEPTH + 1}")
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    index = saved(source.mapInArrow(_build(shard_words), _INDEX))
    shards = max(1, index.count())
    words = index.select("shard", "langs", F.posexplode(F.arrays_zip("words", "counts", "lang_of")).alias("place", "w")).select(
        F.get("langs", F.col("w.lang_of")).alias("lang"), F.col("w.words").cast("string").alias("phrase"), (F.shiftleft("shard", PLACES) + F.col("place")).alias("at"), F.col("w.counts").alias("n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cols = ["words", "number", "lang", "phrase", "f", "head", "tail", "heads", "tails"]
    none = F.lit(None).cast("long")
    held = saved(_frequent(words, ["lang", "phrase"], least))
    ones = held.filter("at = number").select(F.lit(1).alias("words"), "number", "lang", "phrase", "f", none.alias("head"), none.alias("tail"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    if longest == 1:
        return ones, totals
    placed = lambda df, words: df.select(F.shiftright("at", PLACES).alias("shard"), F.lit(words).alias("words"), "at", "number")
    bwt = index.select("shard", "length", "symbols", "forward", "backward")
    # a partition a shard or so, on both sides
    meet = lambda known, run, schema: bwt.repartition(shards, "shard").groupBy("shard").cogroup(known.repartition(shards, "shard").groupBy("shard")).applyInArrow(run, schema)
    known = placed(held, 1)
    pairs = saved(_frequent(meet(known, _pairs, "at long, head long, tail long, n long"), ["head", "tail"], least))
    a = ones.select(F.col("number").alias("head"), "lang", F.col("phrase").alias("_first"), F.col("heads").alias("_heads"))
    b = ones.select(F.col("number").alias("tail"), F.col("phrase").alias("_last"), F.col("tails").alias("_tails"))
    longer = lambda joined, words, number: joined.select(F.lit(words).alias("words"), number.alias("number"), "lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), "f", "head", "tail",
                                                         F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"), "_last")
    twos = saved(longer(pairs.filter("at = number").join(a, "head").join(b, "tail"), 2, F.col("number")))
    every = ones.unionByName(twos.select(*cols))
    if longest == 2:
        return every, totals
    known = known.unionByName(placed(pairs, 2))
    rest = saved(meet(known, _longer(longest), "first long, second long, third long, n long").groupBy("first", "second", "third").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
                 .withColumn("number", F.monotonically_increasing_id()))
    last = twos.select(F.col("number").alias("tail"), "_last", F.col("tails").alias("_tails"))
    a = twos.select(F.col("number").alias("head"), "lang", F.col("phrase").alias("_first"), F.col("heads").alias("_heads"))
    three = rest.filter("third is null").select("number", F.col("first").alias("head"), F.col("second").alias("tail"), "f")
    threes = saved(longer(three.join(a, "head").join(last, "tail"), 3, F.col("number")))
    every = every.unionByName(threes.select(*cols))
    if longest == 3:
        return every, totals
    four = rest.filter("third is not null").withColumnsRenamed({"number": "_number", "f": "_f"})
    a = threes.select(F.col("head").alias("first"), F.col("tail").alias("second"), F.col("number").alias("head"), "lang", F.col("phrase").alias("_first"), F.col("heads").alias("_heads"))
    b = threes.select(F.col("head").alias("second"), F.col("tail").alias("third"), F.col("number").alias("tail"), "_last", F.col("tails").alias("_tails"))
    fours = longer(four.join(a, ["first", "second"]).join(b, ["second", "third"]).withColumnRenamed("_f", "f"), 4, F.col("_number"))
    return every.unionByName(fours.select(*cols)), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside_percent: int = 80, scale: int = 2000000, shard_words: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score, most_left, most_right: each language's first `top` phrases of 2 to `longest` words by score.

    a is the phrase's count. Cut after its first k words, its parts stand l and r times and the cut scores floor(scale a / (l + r)), in exact decimals; the lowest-scoring cut counts,
    the smallest k of equal ones. A phrase goes if one that holds it stands at least `inside_percent` percent as often; as counts only fall with length, the phrases one word longer on
    either side decide, whose highest counts are most_left and most_right (0: none is frequent). Null texts count as empty, null languages as `und`; an empty table gives no rows;
    ids and other columns play no part; repeated rows count each time.
    """
    phrases, totals = frequent_phrases(docs, least, longest, shard_words)
    phrases = saved(phrases)
    longer = phrases.filter("words > 2")
    zero, shorter = F.lit(0).cast("long"), (F.col("words") - 1).alias("words")
    beside = (longer.select(shorter, F.col("head").alias("number"), F.col("f").alias("right"), zero.alias("left")).unionByName(longer.select(shorter, F.col("tail").alias("number"), zero.alias("right"), F.col("f").alias("left")))
              .groupBy("words", "number").agg(F.max("left").alias("most_left"), F.max("right").alias("most_right")))
    kept = phrases.filter("words > 1").join(beside, ["words", "number"], "left").withColumns({c: F.coalesce(c, zero) for c in ("most_left", "most_right")})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = kept.filter(F.greatest(wide("most_left"), wide("most_right")) * 100 < wide("f") * inside_percent)
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(F.get("heads", k - 1).alias("l"), F.get("tails", F.col("words") - k - 1).alias("r"), k.alias("k")))
    scored = kept.withColumn("cut", F.explode(cuts)).select("number", "lang", "phrase", "words", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.k").alias("k"), "most_left", "most_right")
    scored = scored.withColumn("score", F.expr(f"(CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    least_cut = scored.groupBy("number", "lang", "phrase", "words", "a", "most_left", "most_right").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = least_cut.select("lang", "phrase", "words", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"), "most_left", "most_right")
    ranked = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score", "most_left", "most_right")
