"""Repeated runs of lines, found by winnowing over line hashes.

A document is its sequence of non-blank lines, compared after lower-casing A-Z and joining words by single spaces. A window is the shortest run of lines from a given
line on (or up to a given line) that holds at least `min_words` words, so one long line is a window of its own. The rightmost line with the least hash in each forward
window is its fingerprint. Equal windows have equal fingerprints, and every repeated run of at least `min_words` words contains a window, so no such run is missed.

Only fingerprints that occur twice are followed. From each, the matches are extended both ways as far as the windows around it repeat: the first occurrence of a window
by (doc_id, line) stays, every later one is marked, and the union of a document's marked windows is the set of its later repeated runs, whole.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import saved

MIN_WORDS = 30
WINDOWS = "fp long, doc_id long, text_hash long, at int, first int, last int, window binary"


def lines_of(text: bytes):
    """Non-blank lines: their place in the text, normalised bytes and numbers of words."""
    place, norm, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        w = line.lower().split()
        if w:
            place.append(i)
            norm.append(b" ".join(w))
            words.append(len(w))
    return place, norm, words


def windows_of(norm, words, min_words):
    """(fingerprint line, first, last) of every distinct window of a document."""
    ends = np.cumsum(words)
    begins = ends - words
    n = len(words)
    forward = np.searchsorted(ends, begins + min_words).tolist()  # last line of the window from i on; n if there is none
    hashes = [xxhash.xxh64_intdigest(x) for x in norm]
    out, mark = [], {}
    for i, e in enumerate(forward):
        if e >= n:
            break
        best = min(range(i, e + 1), key=lambda j: (hashes[j], -j))
        mark[i] = best
        out.append((best, i, e))
    seen = {(i, e) for _, i, e in out}
    backward = (np.searchsorted(begins, ends - min_words, "right") - 1).tolist()  # first line of the window up to p
    for p, s in enumerate(backward):
        if ends[p] >= min_words and (s, p) not in seen:
            out.append((mark[s], s, p))
    return hashes, out


def _windows(min_words):
    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for doc, text, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place, norm, words = lines_of(text or b"")
                if doc is None or sum(words) < min_words:
                    continue
                hashes, found = windows_of(norm, words, min_words)
                for best, s, e in found:
                    row = (hashes[best] - (1 << 63), doc, th, place[best], place[s], place[e], xxhash.xxh3_128_digest(b"\n".join(norm[s:e + 1])))
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["fp", "doc_id", "text_hash", "at", "first", "last", "window"])
    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): for documents with later repeated runs, the spans [first, last] of line numbers that repeat an earlier run of at least `min_words` words."""
    text = F.col("text").cast("binary")
    rows = saved(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(_windows(min_words), WINDOWS))
    place = F.xxhash64("doc_id", "at")
    twice = rows.groupBy("fp").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).filter("_a <> _b").select("fp")
    met = saved(rows.join(twice, "fp").drop("fp", "at"))
    first = saved(met.groupBy("window").agg(F.min(F.struct("doc_id", "first")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))  # written, so that the join below can split a hot window
    later = met.join(first, "window").filter(F.struct("doc_id", "first") > F.col("_first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # at most two per line of one document


COUNTS = ["_n_lines", "_n_removed"]


def _cut(columns):
    """From (doc, runs) the document's columns, `text` without its runs, and the two counts."""
    def run(batches):
        for batch in batches:
            fields = dict(zip(columns, batch.column(0).flatten()))
            out, total, removed = [], [], []
            for text, runs in zip(fields["text"].to_pylist(), batch.column(1).to_pylist()):
                lines = (text or b"").split(b"\n")
                total.append(sum(1 for x in lines if x.strip()))
                gone = np.zeros(len(lines) + 1, np.int64)
                for r in runs or ():
                    gone[r["first"]] += 1
                    gone[r["last"] + 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(sum(1 for x, g in zip(lines, gone) if g and x.strip())))
                out.append(text if not runs else b"\n".join(x for x, g in zip(lines, gone.tolist()) if not g))
            fields["text"] = pa.array(out, pa.binary())
            kept = [c for c in columns if c not in COUNTS]
            yield pa.RecordBatch.from_arrays([fields[c] for c in kept] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64())], kept + COUNTS)
    return run


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later repeated runs of lines cut out of `text`, plus `_n_lines` and `_n_removed` (non-blank lines before, and of these cut; they replace columns of these names).

    Occurrences are ordered by (doc_id, line), so the earliest stays, also inside one document. Rows that share doc_id and text count as one occurrence. Null texts and
    texts of fewer than `min_words` words pass unchanged, as do rows without an id; a text cut whole becomes empty and its row stays. An empty table gives no rows.
    """
    runs = repeated_runs(docs, min_words)
    cols = docs.columns
    doc = F.struct(*[F.col(c).cast("binary").alias(c) if c == "text" else F.col(c) for c in cols]).alias("doc")
    rows = docs.select(doc, F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("k"))
    met = rows.join(runs, (rows["i"] == runs["doc_id"]) & (rows["k"] == runs["text_hash"]), "left").select("doc", "runs")
    fields = [T.StructField(c, T.BinaryType() if c == "text" else docs.schema[c].dataType) for c in cols if c not in COUNTS]
    return met.mapInArrow(_cut(cols), T.StructType(fields + [T.StructField(c, T.LongType()) for c in COUNTS])).withColumn("text", F.col("text").cast("string"))
