"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded by a small network over counts of its characters and words; gated attention, learnt from
document labels only, weighs the passages; the weighted sum of the encodings is scored by a logistic unit. Fitted on a bounded sample, applied to every passage of every
text.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


from tidemark.llm.toxicity import labelled_sample

PASSAGE = 64
CLASSES = 12
# Class of each byte: lower, upper, digit, one each for space, |, !, full stop, comma, then signs % & * $ #, quotes and brackets, other signs, bytes of other characters.
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _x = chr(_c)
    _CLASS[_c] = (11 if _c >= 128 else 0 if "a" <= _x <= "z" else 1 if "A" <= _x <= "Z" else 2 if "0" <= _x <= "9" else 3 if _c <= 32 else 4 if _x == "|" else 5 if _x == "!" else 6 if _x == "."
                  else 7 if _x == "," else 8 if _x in "%&*$#" else 9 if _x in "'\"()[]{}<>" else 10)
WIDTH = CLASSES + 9


def encode_passages(text: bytes) -> np.ndarray:
    """Passages x features of a text; an empty text is one passage of zeros. Also how much of a passage is new in the document."""
    words = (text or b"").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    out = np.empty((-(-len(words) // PASSAGE), WIDTH), np.float32)
    seen: set = set()
    for k, a in enumerate(range(0, len(words), PASSAGE)):
        part = words[a:a + PASSAGE]
        n = len(part)
        joined = b" ".join(part)
        counts = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=CLASSES)
        sizes = np.fromiter(map(len, part), np.float32, n)
        kinds = set(part)
        fresh = kinds - seen
        seen |= fresh
        row = out[k]
        row[:CLASSES] = counts / max(1, len(joined))
        row[CLASSES:] = (sizes.mean() / 10, sizes.std() / 5, len(kinds) / n, len(fresh) / len(kinds), (sizes <= 3).mean(), (sizes >= 12).mean(), counts[6] / n, np.log1p(n) / 4, np.log1p(len(words)) / 8)
    return out


class Model:
    """Encoder, gated attention and logistic unit; parameters as plain arrays."""

    def __init__(self, width, hidden=16, gate=8, seed=3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x, starts):
        """x: passages of several bags one after another; starts: where each bag begins. Returns scores and what the gradient needs."""
        p = self.p
        x = (x - self.mean) / self.scale
        e = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-np.clip(e @ p["U"], -30, 30)))
        g = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(g - np.repeat(np.maximum.reduceat(g, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * e, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return y, (x, e, t, s, a, z, sizes)

    def gradient(self, label, y, kept, starts, decay):
        p, (x, e, t, s, a, z, sizes) = self.p, kept
        dl = (y - label) / len(label)
        dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
        de = a[:, None] * dz
        da = (dz * e).sum(axis=1)
        dg = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, ds = dg[:, None] * p["w"] * s * (1 - t * t), dg[:, None] * p["w"] * t * s * (1 - s)
        de += dt @ p["V"].T + ds @ p["U"].T
        dx = de * (1 - e * e)
        out = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": e.T @ dt, "U": e.T @ ds, "w": (t * s).T @ dg, "c": z.T @ dl, "d": np.array([dl.sum()])}
        return {k: g + decay * p[k] for k, g in out.items()}

    def fit(self, bags, labels, epochs=60, batch=128, rate=0.01, decay=1e-4, seed=5):
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                starts = np.cumsum([0] + [len(bags[k]) for k in part[:-1]])
                y, kept = self.forward(np.concatenate([bags[k] for k in part]), starts)
                g = self.gradient(labels[part], y, kept, starts, decay)
                step += 1
                for k in self.p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _bags(most):
    def run(batches):
        for batch in batches:
            bags = []
            for text in batch.column(0).to_pylist():
                x = encode_passages(text or b"")
                bags.append(x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.ravel().tolist() for x in bags], pa.list_(pa.float32()))], ["y", "bag"])
    return run


def fit(docs: DataFrame, labels: DataFrame, most_rows: int, most_passages: int):
    """The fitted model, or the rate of good labels where there is one class or none."""
    sample = labelled_sample(docs, labels, "quality", most_rows).select(F.col("text").cast("binary").alias("text"), "y")
    got = sample.mapInArrow(_bags(most_passages), "y int, bag array<float>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    order = np.random.default_rng(1).permutation(len(y))
    bags = [np.array(x, np.float64).reshape(-1, WIDTH) for x in got.column("bag").to_pylist()]
    by = sorted(order.tolist(), key=lambda i: (y[i], len(bags[i]), bags[i].sum()))  # the same model however the rows arrive
    return Model(WIDTH).fit([bags[i] for i in by], y[by])


def _score(model):
    def run(batches):
        for batch in batches:
            scores = []
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                bags = [encode_passages(t or b"") for t in texts[a:a + 256]]
                if isinstance(model, float):
                    scores += [model] * len(bags)
                else:
                    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
                    scores += model.forward(np.concatenate(bags).astype(np.float64), starts)[0].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.3) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, labels: DataFrame, most_rows: int = 5000, most_passages: int = 128) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), one row per row of `docs`.

    Fitted on at most `most_rows` labelled documents, of each at most `most_passages` evenly spaced passages (a bound of the fit only; scores use every passage). Null and
    empty texts are one passage of zeros. With no labels, or of one class only, every score is the smoothed rate of good labels. Repeated labels of an id count once, good
    if any is; a null id is not held out. Repeated rows give repeated rows; an empty table gives none.
    """
    model = fit(docs, labels, most_rows, most_passages)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
