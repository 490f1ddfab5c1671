"""Operator 1. Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text; the toxic compressor holds both, the ordinary
one its own and as much filler, so that ordinary matches lie equally far back and only toxic ones tell them apart. A text is cut into overlapping windows and
each is compressed with either; where the toxic dictionary saves more, the window is nearer to toxic text. How many
windows reach each of several savings, and the largest savings, go through a logistic curve whose cut was calibrated on
labelled documents that took no part in the dictionaries.

Dictionary samples: zstandard keeps the segments that recur most, which in toxic documents are the ordinary words. So the
toxic dictionary learns from words whose beginnings recur in toxic documents and are rare in others, by log-likelihood. That
choice matters: trained on whole windows of toxic text, whichever way these were chosen, the same classifier was far worse
(figures in the README).

The classifier is fitted on a bounded sample of labelled rows (SAMPLE: documents of each class, taken by hash; SAMPLE_CHARS
in all); scoring reads every whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text scores as one without a toxic window; rows of one doc_id with labels of both kinds
count as toxic; without labels of both kinds every score is 0; repeated rows score alike; very long texts are scored
whole; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, shared_dir

#: Documents of the sample, toxic and ordinary, and its characters at most.
SAMPLE, SAMPLE_CHARS = (1500, 3000), 12_000_000
WIDTH, STEP, DICTIONARY = 48, 36, 1024
#: Stands before each window and ends both dictionaries: the frame is then always shorter than stored bytes, so each match shows in the length.
LEAD = bytes(range(128, 160))
#: Zero bytes in front of both: zstandard sizes its hash tables by the dictionary, and in small ones matches get lost.
ROOM = bytes(1 << 14)
STEPS = (1, 2, 3, 4, 5, 6)
N_FEATURES = 4 + len(STEPS)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    bias: float


def windows(text: bytes) -> list[bytes]:
    text = text.lower()
    return [LEAD + text[i : i + WIDTH] for i in range(0, max(1, len(text) - WIDTH + STEP), STEP)] if text else []


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_DFAST, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary = zstandard.ZstdCompressionDict(ROOM + content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def features(text: bytes, toxic, ordinary) -> list[float]:
    cut = windows(text)
    saved = sorted((len(ordinary(w)) - len(toxic(w)) for w in cut), reverse=True) if cut else [0]
    top = (saved + [0, 0, 0])[:3]
    reach = [0] * len(STEPS)
    for s in saved:
        if s < STEPS[0]:
            break
        for k, least in enumerate(STEPS):
            reach[k] += s >= least
    return [top[0], top[1], top[2], math.log1p(len(cut)), *(math.log1p(n) for n in reach)]


def _beginnings(text: bytes) -> set[bytes]:
    words = {w.strip(b".,;:!?\"'()") for w in text.split()}
    return {w[:k] for w in words for k in range(4, 10) if len(w) >= k}


def _telling(toxic: list[bytes], ordinary: list[bytes], most: int = 300) -> set[bytes]:
    """Word beginnings that recur in toxic documents and are at least four times rarer in ordinary ones."""
    has, others = Counter(), Counter()
    for t in toxic:
        has.update(_beginnings(t))
    for t in ordinary:
        others.update(_beginnings(t))
    value = {}
    for w, n in has.items():
        ratio = n / len(toxic) / ((others[w] + 1) / max(1, len(ordinary)))
        if n >= 4 and ratio > 4 and n * math.log(ratio) > 14:
            value[w] = n * math.log(ratio)
    best = sorted(value, key=lambda w: (-value[w], w))[:most]
    best = set(best)
    root = {w: next(w[:k] for k in range(4, 10) if w[:k] in best) for w in best}
    return {w for w in best if has[w] >= 0.6 * has[root[w]]}  # as long as most places of the shortest go: no chance endings


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the content
        return b"".join(dict.fromkeys(samples))[-DICTIONARY:].ljust(8)


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model | None:
    """share: of toxic documents among all. Each list is split: most make the dictionaries, the rest calibrate."""
    toxic, ordinary = ([t.lower() for t in dict.fromkeys(x)] for x in (toxic, ordinary))
    cut = [max(1, int(0.6 * len(x))) for x in (toxic, ordinary)]
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    telling = _telling(toxic[: cut[0]], ordinary[: cut[1]])
    hits = []
    for t in toxic[: cut[0]]:
        for w in t.split():
            size = max((k for k in range(4, 10) if w[:k] in telling), default=0)
            if size:
                hits.append(b" " + w[:size] + (b" " if len(w) <= size + 1 else b""))
    samples = [a + b + c for a, b, c in zip(hits, hits[1:], hits[2:])] or [w for t in toxic[: cut[0]] for w in windows(t)][:20000]
    plain = [w[len(LEAD) :] for t in ordinary[: cut[1]] for w in windows(t)]
    plain = plain[:: max(1, len(plain) // 20000)]
    shared, own = _dictionary(plain), _dictionary(samples)
    model = Model(shared + own, shared + b"\xff" * len(own), (0.0,) * N_FEATURES, 0.0)
    one, other = compressor(model.toxic).compress, compressor(model.ordinary).compress
    held = [toxic[cut[0] :], ordinary[cut[1] :]]
    x = np.array([features(t, one, other) for part in held for t in part])
    y = np.repeat([1.0, 0.0], [len(p) for p in held])
    weight = np.where(y == 1, share / max(1, len(held[0])), (1 - share) / max(1, len(held[1])))
    weight /= weight.mean()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(N_FEATURES, 1.0), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    logit = z @ w
    order = np.argsort(-logit, kind="stable")
    true, said = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * true / (said + (weight * y).sum())
    k = int(f1.argmax())
    edge = logit[order]
    at = (edge[k] + edge[k + 1]) / 2 if k + 1 < len(edge) else edge[k] - 1
    return Model(model.toxic, model.ordinary, tuple(w[:-1] / scale), float(w[-1] - (w[:-1] * mean / scale).sum() - at))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, all_rows: bool = False) -> Model | None:
    """Fits on rows whose fold is not 0 (all_rows: on every row)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if not all_rows:
        marks = marks.where(fold(F.col("doc_id")) != 0)
    text = docs.where("text is not null and text <> ''")
    known = text.select("doc_id", F.length("text").cast("long").alias("size")).join(marks, "doc_id").withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    shared_dir(docs.sparkSession)
    known = known.checkpoint()  # ids and lengths only; the texts stay where they are
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    kind, chosen = {}, []
    for toxic, room in ((1, SAMPLE_CHARS // 3), (0, 2 * SAMPLE_CHARS // 3)):
        rows = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(SAMPLE[1 - toxic]).collect()  # ids
        for k, r in enumerate(rows):
            room -= r["size"]
            if room < 0 and k > 1:
                break
            kind[r["doc_id"]] = toxic
            chosen.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), docs.select("doc_id").schema)
    found = text.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # SAMPLE_CHARS at most, but for the first two of a class
    found = sorted((r["doc_id"], r["text"]) for r in found)
    sample = [[t.encode() for i, t in found if kind[i] == toxic] for toxic in (1, 0)]
    return fit(*sample, share=n[1] / (n[0] + n[1]))


_LOADED: dict[Model, tuple] = {}


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)"""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = compressor(model.toxic), compressor(model.ordinary)
        one, other = (c.compress for c in _LOADED[model])
        weights = np.array(model.weights)
        for batch in chunks(batches, "text"):
            x = np.array([features((t or "").encode(), one, other) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, score double")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is toxic; the score is appended to each row in place, so nothing is joined back."""
    model = train(docs, labels)
    if model is None:
        return docs
    schema, text = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = compressor(model.toxic), compressor(model.ordinary)
        one, other = (c.compress for c in _LOADED[model])
        weights = np.array(model.weights)
        for batch in chunks(batches, "text"):
            x = np.array([features((t or "").encode(), one, other) for t in batch.column(text).to_pylist()]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(x @ weights + model.bias < 0))

    return docs.mapInArrow(run, schema)
