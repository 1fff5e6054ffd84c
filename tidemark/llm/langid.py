"""Language identification as mixture inference.

Per language, counts of hashed letter trigrams over all training documents give n-gram likelihoods. A document is cut into units of `UNIT` trigrams; expectation-
maximisation over the units' likelihoods estimates the share of each language; the set of languages is the one with the best penalised likelihood, grown from the most
likely language by the share-order of the full mixture. The language with the largest share is predicted.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import remainder

BUCKETS, UNIT = 1 << 15, 24
# Letters are lower-cased where ASCII; every other ASCII byte becomes a space; bytes of other characters stay.
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the text with a space at either end, without those that hold a space in the middle."""
    b = np.frombuffer(b" " + text.translate(SPACED) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)).astype(np.int64)
    return code[b[1:-1] != 32]


def _count(batches):
    sums = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])


def fit(train: DataFrame) -> tuple[list, np.ndarray]:
    """Languages and the table (buckets, languages) of log probabilities, from every row with a text and a lang. At most languages x buckets numbers reach the driver."""
    rows = train.filter("text is not null and lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    langs = sorted(set(names.tolist()))
    table = np.full((BUCKETS, len(langs)), 0.5)
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(table, (got.column("gram").to_numpy(), np.array([place[x] for x in names], np.int64)), got.column("n").to_numpy().astype(float))
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def mixture(units: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Shares of the languages and the log likelihood, by EM over units x languages log likelihoods."""
    top = units.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(units - top, -60.0))
    share = np.full(units.shape[1], 1.0 / units.shape[1])
    for _ in range(rounds):
        own = like * share
        new = (own / own.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float((np.log((like * share).sum(axis=1)) + top[:, 0]).sum())


def shares(units: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Shares over all languages, zero outside the chosen set. A further language costs penalty * log(1 + number of units)."""
    n, k = units.shape
    alone = units.sum(axis=0)
    cost = penalty * np.log(1 + n)
    out = np.zeros(k)
    best = int(alone.argmax())
    if k == 1 or float(units.max(axis=1).sum()) - float(alone[best]) <= cost:  # no set can gain more than this
        out[best] = 1.0
        return out
    order = np.argsort(-mixture(units)[0], kind="stable")
    chosen, value = np.array([best]), float(alone[best])
    kept = np.ones(1)
    for size in range(2, k + 1):
        part, ll = mixture(units[:, order[:size]])
        if ll - (size - 1) * cost > value:
            chosen, value, kept = order[:size], ll - (size - 1) * cost, part
    out[chosen] = kept
    return out


def _predict(langs, table):
    def run(batches):
        for batch in batches:
            pred, score, mix = [], [], []
            for text in batch.column(1).to_pylist():
                codes = trigrams((text or "").encode()) if text and any(map(str.isalpha, text)) else None
                if codes is None or not langs or not len(codes):
                    pred.append("und"), score.append(0.0), mix.append("")
                    continue
                units = np.add.reduceat(table[codes], np.arange(0, len(codes), UNIT), axis=0).astype(np.float64)
                s = shares(units)
                best = int(s.argmax())
                pred.append(langs[best]), score.append(float(min(1.0, s[best])))
                mix.append(",".join(f"{langs[i]}:{s[i]:.3f}" for i in np.argsort(-s, kind="stable") if s[i] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "mixture"])
    return run


def identify(docs: DataFrame, train: DataFrame = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share), mixture (chosen languages and shares), one row per row of `docs`.

    Learnt from `train`, by default the rows whose crc32 id remainder by 4 is not 2, with their lang. Null texts and texts without a letter, and all texts if nothing
    could be learnt, are `und` with score 0. A null id counts as remainder 0. Repeated rows count as often as they stand; an empty table gives none.
    """
    train = docs.filter(remainder("doc_id", 4) != 2) if train is None else train
    langs, table = fit(train)
    rows = docs.select(F.col("doc_id").cast("long"), "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(_predict(langs, table), "doc_id long, held_out boolean, lang_pred string, score double, mixture string")
