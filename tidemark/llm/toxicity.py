"""Toxicity of deobfuscated text.

A word that is written in a noisy way (digits or signs for letters, signs or spaces between letters, letters repeated three times or more) is a lattice of characters it may
stand for. Viterbi decoding picks the path that is most probable under a character language model of three characters, counted over the whole corpus, times the channel's
probabilities of substituting, inserting and repeating. Plainly written words are their own only path. The restored words and their beginnings are then scored by a
logistic regression on labelled documents.
"""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import remainder

# Letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
# Signs that may stand between letters.
BETWEEN = set(" .-_*'~,:;/\\^`\"#=&%")
SYMBOLS = 64
# Log probabilities of the channel: a sign for a letter, any vowel under an asterisk, a sign or digit that is meant as such, one that means nothing; a separator that means
# nothing, one that separates words, one that would separate single letters; a letter of a run of three or more, or of two, that means nothing.
SUBSTITUTED, HIDDEN, SIGN, STRAY = -0.7, -2.0, -3.0, -3.0
DROPPED, SEPARATED, SPELLED = -0.7, -0.5, -4.0
STRETCHED, DOUBLED = -0.3, -8.0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){3,}(?!\S)")
RUN_AT_EDGE = re.compile(r"^([\W_])\1+|([\W_])\2+$")
TRIPLE = re.compile(r"(.)\1\1")
BEGINNINGS = (4, 5, 6)


def symbol(c: str) -> int:
    """0 for whatever separates words, 1-26 for a-z, then shared numbers for digits and other letters."""
    n = ord(c)
    if 97 <= n <= 122:
        return n - 96
    if c.isdigit():
        return 27
    return 28 + n % 36 if c.isalpha() else 0


_LOW = np.array([symbol(chr(i).lower()[0]) for i in range(0x250)], np.uint8)


def trigram_counts(texts) -> np.ndarray:
    """Counts of three symbols in a row over lower-cased texts."""
    joined = " ".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(points < 0x250, _LOW[np.minimum(points, 0x24F)], 28 + points % 36).astype(np.int64)
    return np.bincount((sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:], minlength=SYMBOLS ** 3) if len(sym) > 2 else np.zeros(SYMBOLS ** 3, np.int64)


def _count(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        sums = np.zeros(SYMBOLS ** 3, np.int64)
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 1 << 21:
                sums += trigram_counts(group)
                group, size = [], 0
        sums += trigram_counts(group) if group else 0
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first two) as an array of 64 x 64 x 64, from every text of `docs`, smoothed by the pair model; at most 64^3 sums reach the driver."""
    got = docs.filter("text is not null").select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = counts.sum(axis=0) + 0.1
    pair /= pair.sum(axis=1, keepdims=True)
    return np.log((counts + 5.0 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


def lattice(token: str):
    """For each character of a lower-cased token the list of (what it may stand for, log probability); '' stands for nothing."""
    out = []
    n = len(token)
    apart = lambda i: i < 0 or i >= n or token[i] in BETWEEN
    for i, c in enumerate(token):
        if c in BETWEEN:
            single = (apart(i - 2) and not apart(i - 1)) or (apart(i + 2) and not apart(i + 1))
            options = [(c, SPELLED if single else SEPARATED), ("", DROPPED)]
            if c == "*" and not single:
                options += [(v, HIDDEN) for v in "aeiou"]
        elif c in LEET:
            options = [(c, SIGN)]
        else:
            options = [(c, 0.0)] if c.isalnum() else [(c, SIGN)]
        options += [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        if c not in BETWEEN and not c.isalnum():
            options.append(("", STRAY))
        elif i and c.isalpha() and token[i - 1] == c:
            long = (i > 1 and token[i - 2] == c) or (i + 1 < n and token[i + 1] == c)
            options.append(("", STRETCHED if long else DOUBLED))
        out.append(options)
    return out


def decode(token: str, model) -> str:
    """The most probable reading of a noisy token; ties go to the reading first in the alphabet."""
    states = {(0, 0): (0.0, None)}  # last two symbols -> (log probability, reversed reading as a linked list)
    for options in lattice(token):
        new: dict = {}
        for (a, b), (value, path) in states.items():
            for c, cost in options:
                if c:
                    s = symbol(c)
                    key, worth, reading = (b, s), value + cost + float(model[a, b, s]), (path, c)
                else:
                    key, worth, reading = (a, b), value + cost, path
                if key not in new or worth > new[key][0] + 1e-9 or (worth > new[key][0] - 1e-9 and c and reading[1] < (new[key][1] or (None, "~"))[1]):
                    new[key] = (worth, reading)
        states = new
    best = max(states.items(), key=lambda kv: (kv[1][0] + float(model[kv[0][0], kv[0][1], 0]), kv[0]))[1][1]
    out = []
    while best:
        best, c = best
        out.append(c)
    return "".join(reversed(out))


def noisy(core: str) -> bool:
    return not core.isalpha() and any(c.isalpha() for c in core) or bool(TRIPLE.search(core))


class Reader:
    """Restores texts; readings of tokens are remembered while there are not too many."""

    def __init__(self, model, view=None, most=1 << 19):
        self.model, self.view, self.most, self.known = model, view or (lambda words: words), most, {}

    def token(self, token):
        if token not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            core = EDGE.sub("", token)
            words = []
            if core:
                whole = RUN_AT_EDGE.sub("", token).lstrip(".,;:'\"-_*#%&([{<").rstrip(".,;:?!'\"-_*#%&)]}>")
                if core.isalpha() and not noisy(core):
                    words = [core]
                if noisy(core) or (whole != core and (whole[:1] in LEET or whole[-1:] in LEET)):
                    words += re.findall(r"[^\W\d_]+", decode(whole, self.model))
                if noisy(core) and core != whole:
                    words += re.findall(r"[^\W\d_]+", decode(core, self.model))
            self.known[token] = self.view(list(dict.fromkeys(words)))
        return self.known[token]

    def words(self, text):
        """What the view makes of each distinct restored word of a text, words spelled with spaces included."""
        low = text.lower()
        seen = set(low.split())
        out = []
        for t in seen:
            out += self.token(t)
        for m in SPACED.finditer(low):
            out += self.token(m.group())
        return out


def features(words):
    """Numbers of the restored words and of their beginnings."""
    out = []
    for w in words:
        out.append(w)
        out += [w[:k] + "*" for k in BEGINNINGS if len(w) > k]
    return out


def _feature_counts(model):
    def run(batches):
        total, toxic = Counter(), Counter()
        reader = Reader(model)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(features(reader.words(text or "")))
                total.update(found)
                if label:
                    toxic.update(found)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([total[x] for x in names], pa.int64())], ["feature", "toxic", "n"])
    return run


def _design(model, place):
    def run(batches):
        reader = Reader(model, lambda words: [place[f] for f in features(words) if f in place])
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(set(reader.words(t))) for t in texts], pa.list_(pa.int32())), pa.array([float(np.log1p(len(t))) for t in texts])], ["y", "at", "size"])
    return run


def fit(sample: DataFrame, model, most_features: int = 3000) -> dict:
    """Logistic regression on the presence of the at most `most_features` features that most favour toxic documents of the sample (text, y), which bounds the model; what reaches the driver is bounded by the sample."""
    counts = sample.mapInArrow(_feature_counts(model), "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n1, n0 = sizes["t"], sizes["n"] - sizes["t"]
    if not n1 or not n0:
        return {"place": {}, "weights": np.zeros(0), "size": 0.0, "bias": float(np.log((n1 + 0.5) / (n0 + 0.5)))}
    p1, p0, p = F.col("toxic") / n1, (F.col("n") - F.col("toxic")) / n0, F.col("n") / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p + 1e-9) * (1 / n1 + 1 / n0))
    top = counts.filter("toxic >= 2").withColumn("z", z).filter("z > 2").orderBy(F.desc("z"), "feature").limit(most_features).select("feature").collect()
    place = {r["feature"]: k for k, r in enumerate(top)}
    rows = sample.mapInArrow(_design(model, place), "y int, at array<int>, size double").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    lists = rows.column("at").to_pylist()
    at = np.array([a for x in lists for a in x], np.int64)
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    size = rows.column("size").to_numpy() - 7.0
    w, c, b = np.zeros(len(place)), 0.0, float(np.log(n1 / n0))
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for t in range(1, 401):
        score = np.bincount(row, w[at], len(y)) + c * size + b
        r = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        g = np.concatenate((np.bincount(at, r[row], len(w)) + 0.3 * w, [(r * size).sum() + c, r.sum()])) / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, c, b = w - step[:-2], c - step[-2], b - step[-1]
    return {"place": place, "weights": w, "size": c, "bias": b}


def _score(model, fitted):
    def run(batches):
        place, weights = fitted["place"], fitted["weights"]
        reader = Reader(model, lambda words: [place[f] for f in features(words) if f in place])
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = sorted(set(reader.words(text)))
                s = float(weights[found].sum()) + fitted["size"] * (float(np.log1p(len(text))) - 7.0) + fitted["bias"]
                out.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, s))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """(text, y) of at most `most_rows` labelled documents, the first by hash of the id among those whose crc32 remainder by 5 is not 0."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")  # at most `most_rows` pairs of numbers are broadcast


def score(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_features: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), one row per row of `docs`.

    The language model counts every text; the classifier is fitted on at most `most_rows` labelled documents and the `most_features` features that tell most among those that stand for toxicity
    (a bound of the fit; texts are scored whole). Null and empty texts get the score of a text without
    features. With no labels, or of one class only, every score is the smoothed rate of toxic labels. Repeated labels of an id count once, toxic if any is; a null id is
    not held out (remainder 0 reads as held out only for real ids). Repeated rows give repeated rows; an empty table gives none.
    """
    from tidemark.llm.common import saved
    model = language_model(docs)
    fitted = fit(saved(labelled_sample(docs, labels, "toxic", most_rows)), model, most_features)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    return rows.mapInArrow(_score(model, fitted), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_features: int = 3000) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, each judged by its own text, with all their columns; bounds of the fit as in `score`.

    Null and empty texts are judged as texts without features, rows without an id or with a repeated one like any other; an empty table gives none.
    """
    from pyspark.sql import types as T
    from tidemark.llm.common import saved
    model = language_model(docs)
    fitted = fit(saved(labelled_sample(docs, labels, "toxic", most_rows)), model, most_features)
    schema = T.StructType(docs.schema.fields)
    return docs.mapInArrow(_keep(model, fitted), schema)


def _keep(model, fitted):
    judge = _score(model, fitted)

    def run(batches):
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            seen = pa.RecordBatch.from_arrays([ids, batch.column("text"), pa.array([False] * batch.num_rows)], ["doc_id", "text", "held_out"])
            flags = next(judge(iter([seen]))).column("predicted").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(flags == 0))
    return run
