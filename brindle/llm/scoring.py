"""Operator 2. Language-model scoring: causal self-attention in numpy on subword ids, beside a unigram base.

Texts are split into words and one end. The base counts words over all training documents; a word's subwords come from a
public tokenizer that is read, not trained. The model predicts the subword sequence: each piece from the pieces before it
in its window, by one masked self-attention layer whose attention falls off by a learned bias for each distance. Windows
overlap: WINDOW positions, of which the last STRIDE are scored with at least WINDOW - STRIDE pieces before them, so each
piece is scored once. The output is factored: a class by softmax, then the piece within its class by its share there,
counted over the whole corpus's training words; together they are a probability over all pieces. A word's first piece is
predicted from the context. What follows it is predicted by the layer too (the other pieces, and that a word begins after
them), interpolated with the word's share among the training words of that first piece, by the Good-Turing estimate of
how many tokens are new words.

How the work is laid out: documents are handled in blocks of neighbouring rows of a file; where its text lies, a block's
distinct words are counted, and these alone travel for the corpus counts and pieces, packed by block and by buckets of
words, each of which one task counts and cuts. Then text and words of each block meet in one task, which scores it: texts
cross the network once. Rows that repeat lie in as many blocks as they fill.

The attention weights start from a fit on the driver (about SAMPLE_CHARS of training documents, by hash), only so that all
tasks start alike. Then each partition of the training documents goes on from there over all its windows, once, and the
tasks' changes are averaged up a tree: a piece's rows weighted by how often a task saw the piece, the rest by windows. So
the layer learns from every training document, as the counts do.

Defined results: a null or empty text is its end alone; words no piece covers fall back to the tokenizer's byte pieces;
without training documents N is 0 and the base is uniform; repeated rows count each; very long texts are scored whole;
a row without a doc_id is scored, and it learns nothing as its fold is unknown; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, replace
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, located, ragged, split_words, staged

#: Positions of a window, how many of them it scores, and the model's width and classes.
WINDOW, STRIDE, WIDTH, CLASSES = 24, 16, 16, 112
#: Classes of several pieces, for those that begin a word and for those that don't; and classes of one piece inside words.
SHARED, INNER = 12, 16
SAMPLE_CHARS, STEPS, BATCH = 1_500_000, 500, 256
#: Bytes of text of a block, and for each bucket of words, about; what a bucket's summary counts beside pieces.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
ALL, KINDS, ONCE = -1, -2, -3
#: The pass over all training documents: its rate; bytes of text a partition holds, about, and partitions merged at once.
RATE, MERGED, FAN = 0.005, 16 << 20, 8
BY_PIECE, DENSE = ("query", "key", "value", "rest"), ("bias", "out", "out_bias")
TINY = 1e-30
#: Positions whose classes are handled at once, so that their probabilities stay in a core's cache.
SLICE = 512


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import sentencepiece

        _TOKENIZERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _TOKENIZERS[path]


@dataclass
class Attention:
    """Tables by piece: query, key, value and residual; then the output by class."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    rest: np.ndarray
    bias: np.ndarray  # by distance 0 .. WINDOW - 1
    out: np.ndarray
    out_bias: np.ndarray
    kind: np.ndarray  # class of each piece; the last piece number is the end


def initial(n_pieces: int, kind: np.ndarray, share: np.ndarray, seed: int = 0) -> Attention:
    rng = np.random.default_rng(seed)
    table = lambda scale: (rng.normal(size=(n_pieces, WIDTH)) * scale).astype(np.float32)
    return Attention(table(0.3), table(0.3), table(0.1), table(0.1), (-0.3 * np.arange(WINDOW)).astype(np.float32), (rng.normal(size=(WIDTH, CLASSES)) * 0.1).astype(np.float32), np.log(share + 1e-6).astype(np.float32), kind)


class Adam:
    """Moments of the gradients of a model, and how many steps were taken. The model's tables by piece become parts of one table, so that a piece's rows lie together."""

    def __init__(self, m: Attention):
        self.step = 0
        self.table = np.concatenate([getattr(m, c) for c in BY_PIECE], axis=1)
        for n, c in enumerate(BY_PIECE):
            setattr(m, c, self.table[:, n * WIDTH : (n + 1) * WIDTH])
        self.first = {c: np.zeros_like(getattr(m, c)) for c in DENSE} | {"table": np.zeros_like(self.table)}
        self.second = {c: np.zeros_like(getattr(m, c)) for c in DENSE} | {"table": np.zeros_like(self.table)}


@cache
def gaps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of n positions, row by row: how far the second lies before the first, below zero if behind it; and a column for each distance, 1 where a pair has it."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    return gap, (gap.reshape(-1, 1) == np.arange(WINDOW)).astype(np.float32)


def attended(m: Attention, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights and what they gather, for windows of queries, keys and values."""
    n = q.shape[1]
    gap = gaps(n)[0]
    a = np.matmul(q, turned(k))
    a *= np.float32(WIDTH**-0.5)
    risky = max(a.max(), -a.min()) + np.abs(m.bias).max() > 60
    a += np.where(gap >= 0, m.bias[np.clip(gap, 0, WINDOW - 1)], np.float32(-1e9)).astype(np.float32)
    if risky:
        np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    if risky:
        a *= (gap >= 0).astype(np.float32)
    a /= (a.reshape(-1, n) @ np.ones(n, np.float32)).reshape(*a.shape[:2], 1)
    return a, np.matmul(a, v)


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix of x transposed, as a copy: products of many small matrices are faster so."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def output_gradient(m: Attention, h: np.ndarray, target: np.ndarray, dh: np.ndarray) -> dict[str, np.ndarray]:
    """The gradients of the mean cross entropy of the classes in target: of out and out_bias, and in dh that of h. Of h only the first WIDTH columns are read.

    Rows are taken SLICE at a time, as much as a core's cache holds, and never normalised: their sums go into h and dh.
    Nor is the bias added to them: its exponentials are factors of the classes.
    """
    rows, h = len(target), h[:, :WIDTH]
    risky = np.sqrt(np.einsum("ij,ij->i", h, h).max() * (m.out**2).sum(axis=0).max()) + np.abs(m.out_bias).max() > 40
    factor = np.ones(CLASSES, np.float32) if risky else np.exp(m.out_bias)
    back, own_factor = (m.out * factor).T.copy(), factor.take(target)
    out, bias, buffer = np.zeros((WIDTH, CLASSES), np.float32), np.zeros(CLASSES, np.float32), np.empty(min(rows, SLICE) * CLASSES, np.float32)
    place = np.arange(rows) % SLICE * CLASSES + target
    for i in range(0, rows, SLICE):
        own, to = h[i : i + SLICE], dh[i : i + SLICE]
        p = buffer[: len(own) * CLASSES].reshape(-1, CLASSES)
        np.matmul(own, m.out, out=p)
        if risky:
            p += m.out_bias
            np.minimum(p, np.float32(80), out=p)
        np.exp(p, out=p)
        total = p @ factor
        share = np.float32(1 / rows) / total
        np.matmul(p, back, out=to)
        to *= share[:, None]
        buffer[place[i : i + SLICE]] -= total / own_factor[i : i + SLICE]
        out += (own * share[:, None]).T @ p
        bias += share @ p
    dh -= (np.float32(1 / rows) * m.out.T).take(target, axis=0)
    return {"out": out * factor, "out_bias": bias * factor}


def learn(m: Attention, adam: Adam, window: np.ndarray, lr: float) -> None:
    """One step on a batch of windows of piece numbers. All in single precision, in place where it can be."""
    adam.step += 1
    step, first, second = adam.step, adam.first, adam.second
    ids, target = window[:, :-1], m.kind[window[:, 1:]].ravel()
    rows, at = adam.table.reshape(-1, WIDTH), ids * len(BY_PIECE)  # a piece's rows follow each other; taken one by one, each part is contiguous
    q, k, v, rest = (rows.take(at + n, axis=0) for n in range(len(BY_PIECE)))
    a, h = attended(m, q, k, v)
    gathered = h + rest
    every = np.empty((len(BY_PIECE), *h.shape), np.float32)
    dq, dk, dv, dh = every
    grad = output_gradient(m, gathered.reshape(-1, WIDTH), target, dh.reshape(-1, WIDTH))
    da = np.matmul(dh, turned(v))
    da -= np.einsum("bij,bij->bi", dh, h)[:, :, None]  # the mean of da under a, whose weights gather h
    da *= a
    grad["bias"] = np.ones(len(da), np.float32) @ da.reshape(len(da), -1) @ gaps(ids.shape[1])[1]
    da *= np.float32(WIDTH**-0.5)
    np.matmul(da, k, out=dq)
    np.matmul(da.transpose(0, 2, 1), q, out=dk)
    np.matmul(a.transpose(0, 2, 1), dh, out=dv)
    used, every = summed_rows(ids.ravel(), every.reshape(len(BY_PIECE), -1, WIDTH))
    for c, g in grad.items():
        first[c] = 0.9 * first[c] + 0.1 * g
        second[c] = 0.99 * second[c] + 0.01 * g * g
        setattr(m, c, (getattr(m, c) - lr * (first[c] / (1 - 0.9**step)) / (np.sqrt(second[c] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    f, s = first["table"].take(used, axis=0), second["table"].take(used, axis=0)
    f *= np.float32(0.9)
    s *= np.float32(0.99)
    f += np.float32(0.1) * every
    every *= every
    every *= np.float32(0.01)
    s += every
    first["table"][used], second["table"][used] = f, s
    np.sqrt(s, out=s)
    s += np.float32(1e-8)
    f /= s
    f *= np.float32(0.3 * lr)
    adam.table[used] -= f


def summed_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and for each the sum of its rows. Rows in several parts, an array for each, give sums side by side."""
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")  # the narrow type is sorted by radix
    ranked = ids[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    number = np.diff(np.append(cuts, len(ranked)))
    rows = (np.concatenate(rows, axis=1) if rows.ndim > 2 else rows).take(order, axis=0)
    out = rows.take(cuts, axis=0)
    for k in range(1, 8):  # ids with few rows, of which there are many, at once
        own = np.flatnonzero((number > k) & (number <= 8))
        out[own] += rows.take(cuts[own] + k, axis=0)
    one, many = np.ones(number.max(initial=1), rows.dtype), np.flatnonzero(number > 8)
    for i, at, n in zip(many.tolist(), cuts[many].tolist(), number[many].tolist()):
        np.dot(one[:n], rows[at : at + n], out=out[i])
    return ranked[cuts], out


def train(m: Attention, sequences: np.ndarray, steps: int = STEPS, seed: int = 0, rate: float = 0.02) -> Attention:
    """Adam on random windows of sequences, an array of piece numbers in which texts follow each other."""
    if len(sequences) <= WINDOW + 1:
        return m
    rng = np.random.default_rng(seed)
    adam = Adam(m)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(sequences) - WINDOW, BATCH)
        learn(m, adam, sequences[at[:, None] + np.arange(WINDOW + 1)], rate * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return m


def go_over(m: Attention, adam: Adam, sequence: np.ndarray, end: int, rate: float = RATE) -> int:
    """Adam on all windows of sequence, each piece being predicted once; gives the number of windows."""
    padded = np.concatenate([np.full(max(1, WINDOW + 1 - len(sequence)), end, np.int64), sequence])
    at = np.minimum(np.arange(0, len(padded) - 1, WINDOW), len(padded) - WINDOW - 1)
    np.random.default_rng(len(at)).shuffle(at)
    for part in np.array_split(at, -(-len(at) // BATCH)):
        learn(m, adam, padded[part[:, None] + np.arange(WINDOW + 1)], rate * min(1.0, (adam.step + 1) / 20))
    return len(at)


def packed_changes(start: Attention, m: Attention, seen: np.ndarray, windows: int) -> bytes:
    """What a pass changed, times its weights, as bytes: the pieces that it saw, how often, their rows, and the rest."""
    used = np.flatnonzero(seen)
    rows = np.concatenate([getattr(m, c)[used] - getattr(start, c)[used] for c in BY_PIECE], axis=1) * seen[used, None]
    rest = np.concatenate([(getattr(m, c) - getattr(start, c)).ravel() for c in DENSE]) * windows
    head = np.array([len(used), windows], np.int64)
    return b"".join(x.tobytes() for x in (head, used.astype(np.int64), seen[used].astype(np.int64), rows.astype(np.float32), rest.astype(np.float32)))


def summed_changes(packed: list[bytes], n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(how often each piece was seen, its rows' weighted changes, the rest's, windows) over all of packed."""
    seen, rows, rest, windows = np.zeros(n_pieces, np.int64), np.zeros((n_pieces, len(BY_PIECE) * WIDTH)), 0.0, 0
    for raw in packed:
        k, n = np.frombuffer(raw, np.int64, 2)
        used, times = np.frombuffer(raw, np.int64, 2 * k, 16).reshape(2, k)
        at = 16 + 16 * int(k)
        rows[used] += np.frombuffer(raw, np.float32, int(k) * rows.shape[1], at).reshape(k, -1)
        rest = rest + np.frombuffer(raw, np.float32, -1, at + 4 * int(k) * rows.shape[1]).astype(np.float64)
        seen[used] += times
        windows += int(n)
    return seen, rows, rest, windows


def changed(start: Attention, packed: list[bytes]) -> Attention:
    """start with the weighted mean of all changes."""
    seen, rows, rest, windows = summed_changes(packed, len(start.query))
    if not windows:
        return start
    mean, at = rows / np.maximum(1, seen)[:, None], 0
    new = {c: getattr(start, c) + mean[:, k * WIDTH : (k + 1) * WIDTH].astype(np.float32) for k, c in enumerate(BY_PIECE)}
    for c in DENSE:
        old = getattr(start, c)
        new[c] = old + (rest[at : at + old.size] / windows).reshape(old.shape).astype(np.float32)
        at += old.size
    return replace(start, **new)


def over_all(texts: DataFrame, start: Attention, path: str, end: int, size: int) -> Attention:
    """The model after one pass over texts (column text): each partition's own pass from start, averaged up a tree."""
    shared = texts.sparkSession.sparkContext.broadcast(start)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = deepcopy(shared.value)
        adam, seen, windows, known = Adam(m), np.zeros(end + 1, np.int64), 0, Known(path)
        for batch in chunks(batches, "text"):
            words, per = split_words(_lowered(batch))
            coded = pc.dictionary_encode(words)
            where = known.places(coded.dictionary)[coded.indices.to_numpy()]
            sequence = _laid_out(known.ids, known.n, where, per, end)[0]
            windows += go_over(m, adam, sequence, end)
            seen += np.bincount(sequence, minlength=end + 1)
        if windows:
            raw = packed_changes(shared.value, m, seen, windows)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([raw], pa.binary())], ["part", "raw"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        seen, rows, rest, windows = summed_changes(table.column("raw").to_pylist(), end + 1)
        used = np.flatnonzero(seen)
        head = np.array([len(used), windows], np.int64)
        raw = b"".join(x.tobytes() for x in (head, used.astype(np.int64), seen[used], rows[used].astype(np.float32), rest.astype(np.float32)))
        return pa.table({"part": table.column("part").slice(0, 1), "raw": pa.array([raw], pa.binary())})

    parts = texts.mapInArrow(run, "part long, raw binary")
    groups = size // MERGED // FAN
    while groups > 1:
        parts = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).applyInArrow(lambda t: merge(t.select(["part", "raw"])), "part long, raw binary")
        groups //= FAN
    return changed(start, [r["raw"] for r in sorted(parts.collect(), key=lambda r: r["part"])])


def class_scores(m: Attention, ids: np.ndarray, bounds: np.ndarray, end: int, heads: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms, for each piece, of its class's probability and of that of all classes below heads, the ones that begin a word.

    Each follows from the pieces before it in its text and window; a text begins after an end.
    """
    n = len(ids)
    out, begins = np.zeros(n, np.float32), np.zeros(n, np.float32)
    size = np.diff(bounds)
    # inputs: each text shifted by one behind an end; windows of STRIDE new positions behind WINDOW - STRIDE earlier ones
    pad = WINDOW - STRIDE
    number = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), number)
    begin = bounds[:-1][text] + STRIDE * ragged(np.zeros(len(size), np.int64), number)
    shifted = np.concatenate([[end], ids[:-1]]) if n else ids
    if n:
        shifted[bounds[:-1][size > 0]] = end
    low, high = bounds[:-1][text], bounds[1:][text]
    span = np.arange(-pad, STRIDE)
    gap = gaps(WINDOW)[0][pad:]
    mask = np.where(gap >= 0, m.bias[np.clip(gap, 0, WINDOW - 1)], np.float32(-80)).astype(np.float32)
    query, key, value, rest = (np.ascontiguousarray(x) for x in (m.query * np.float32(WIDTH**-0.5), m.key, m.value, m.rest))
    kind, factor = m.kind[ids], np.exp(m.out_bias)  # the bias's exponentials are factors of the classes
    sides = np.stack([factor * (np.arange(CLASSES) < heads), factor * (np.arange(CLASSES) >= heads)], axis=1)
    buffer, rows = np.empty(SLICE * CLASSES, np.float32), np.arange(batch * STRIDE) % SLICE * CLASSES
    for s in range(0, len(begin), batch):
        place = begin[s : s + batch, None] + span
        x = shifted.take(place, mode="clip")
        k, v = key.take(x, axis=0), value.take(x, axis=0)
        a = np.matmul(query.take(x[:, pad:], axis=0), turned(k))
        a += mask
        np.exp(a, out=a)
        first = np.flatnonzero(place[:, 0] < low[s : s + batch])  # a text's first windows: what lies before it has no weight
        if len(first):
            a[first] *= (place[first] >= low[s : s + batch][first, None])[:, None, :]
        h = np.matmul(a, v).reshape(-1, WIDTH)
        h /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(TINY))[:, None]
        h += rest.take(x[:, pad:].ravel(), axis=0)
        to = place[:, pad:].ravel()
        good = np.flatnonzero(to < np.repeat(high[s : s + batch], STRIDE))
        if len(good) < len(to):
            to, h = to[good], h.take(good, axis=0)
        own, whole = np.empty(len(to), np.float32), np.empty((len(to), 2), np.float32)
        wanted = kind[to]
        at = rows[: len(to)] + wanted
        for i in range(0, len(to), SLICE):
            p = buffer[: min(SLICE, len(to) - i) * CLASSES].reshape(-1, CLASSES)
            np.matmul(h[i : i + SLICE], m.out, out=p)
            np.exp(p, out=p)
            np.matmul(p, sides, out=whole[i : i + SLICE])
            buffer.take(at[i : i + SLICE], out=own[i : i + SLICE], mode="clip")
        total = whole[:, 0] + whole[:, 1] + np.float32(TINY)
        out[to] = np.log(own * factor.take(wanted) / total + np.float32(TINY))
        begins[to] = np.log(whole[:, 0] / total + np.float32(TINY))
    return out, begins


def bounded(m: Attention) -> Attention:
    """The same model with attention and output so scaled that no exponential overflows: only extreme weights change."""
    big = lambda x: np.abs(x).max(initial=1e-9)
    reach = np.sqrt((m.query**2).sum(1).max() * (m.key**2).sum(1).max()) * WIDTH**-0.5 + big(m.bias)
    if reach > 60:
        m.query = (m.query * (60 / reach)).astype(np.float32)
        m.bias = (m.bias * (60 / reach)).astype(np.float32)
    room = (np.sqrt((m.value**2).sum(1).max()) + np.sqrt((m.rest**2).sum(1).max())) * np.sqrt((m.out**2).sum(0).max()) + big(m.out_bias)
    if room > 70:
        m.out, m.out_bias = (m.out * (70 / room)).astype(np.float32), (m.out_bias * (70 / room)).astype(np.float32)
    return m


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def classes(counts: np.ndarray, path: str, end: int) -> tuple[np.ndarray, int]:
    """The class of each piece, and how many classes begin a word: the most frequent pieces have one each, the others share by rank."""
    begins = np.zeros(end + 1, bool)
    begins[:end] = [tokenizer(path).id_to_piece(i).startswith("\u2581") for i in range(end)]
    begins[end] = True
    order = np.argsort(-counts, kind="stable")
    group = np.empty(end + 1, np.int64)
    at = 0
    for side in (True, False):
        own = order[begins[order] == side]
        first, rest = np.split(own, [CLASSES - 2 * SHARED - INNER if side else INNER])
        group[first] = at + np.arange(len(first))
        at += len(first)
        share = np.cumsum(counts[rest]) / max(counts[rest].sum(), 1e-9)
        group[rest] = at + np.minimum(SHARED - 1, (share * SHARED).astype(np.int64))
        at += SHARED
        if side:
            heads = at
    return group, heads


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first


def pieces_of(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    ids = tokenizer(path).encode(words, num_threads=1)
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint16, int(n.sum())), n


class Known:
    """The words that a task has met, with their pieces: ids one after another, n of each word."""

    def __init__(self, path: str):
        self.path, self.words, self.ids, self.n = path, pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words; those not met before are cut into pieces."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        if len(new):
            ids, n = pieces_of(_strings(new), self.path)
            self.words = pa.concat_arrays([self.words, new.cast(pa.string())])
            self.ids, self.n = np.concatenate([self.ids, ids.astype(np.int64)]), np.concatenate([self.n, n])
        return at


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as bytes: the first ends[0], those up to ends[1] and so on."""
    ends = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(packed: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind)


def _unjoined(joined: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in which blanks join them, in one flat array, and how many each has."""
    lists = pc.split_pattern(joined.combine_chunks().cast(pa.string()), " ")
    return pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _block_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block's rows in a piece of text, lower-cased, and how often each stands in its training
    documents. A row holds those of a block that fall into a bucket, joined by blanks, which no word has."""
    for batch in chunks(batches, "text", BLOCK_BYTES):
        words, counts = split_words(_lowered(batch))
        learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False), counts)
        coded = pc.dictionary_encode(words)
        kinds = len(coded.dictionary)
        if not kinds:
            continue
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, _strings(coded.dictionary)), np.uint64, kinds)
        blocks, own = np.unique(batch.column("block").to_numpy(), return_inverse=True)
        key = np.repeat(own, counts) * kinds + coded.indices.to_numpy()
        seen = np.bincount(key, minlength=len(blocks) * kinds)
        at = np.flatnonzero(seen)
        times = np.bincount(key[learn], minlength=len(seen))[at].astype(np.int64)
        place = (at // kinds) * buckets + (hashed % np.uint64(buckets)).astype(np.int64)[at % kinds]
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]) + 1, len(place))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), coded.dictionary.take(pa.array(at % kinds)).cast(pa.string()))
        place = place[ends - 1]
        yield pa.RecordBatch.from_arrays([pa.array(place % buckets), pa.array(blocks[place // buckets]), pc.binary_join(lists, " "), _packed(times[order], ends)], ["bucket", "block", "words", "n"])


def _lowered(docs: pa.Table | pa.RecordBatch) -> pa.Array:
    text = docs.column("text")
    return pc.ascii_lower(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)


def score_texts(docs: DataFrame, training: Column, path: str | None = None, sample_chars: int = SAMPLE_CHARS, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning from the rows where training holds."""
    path = path or default_model()
    spark = docs.sparkSession
    rows, file, pos = located(docs)
    slim = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"), F.col(file).alias("file"), F.col(pos).alias("pos"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    size, number, ends = slim.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_if("learn")).first()
    size = size or 0
    slim = slim.withColumn("block", F.xxhash64("file", F.floor(F.col("pos") / max(1, BLOCK_BYTES * number // max(1, size))))).drop("file", "pos")
    by_block = slim.groupBy("block")
    buckets = max(1, size // BUCKET_BYTES)
    words = staged(slim.select("block", "text", "learn").mapInArrow(lambda x: _block_words(x, buckets), "bucket long, block long, words string, n binary"), "block-words")

    def costed(table: pa.Table) -> pa.Table:
        """Of a bucket: the words of each block with their counts in the whole corpus and their pieces; and without a block, its pieces' counts."""
        flat, per = _unjoined(table.column("words"))
        coded = pc.dictionary_encode(flat)
        where = coded.indices.to_numpy()
        c = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(c, where, _unpacked(table.column("n"), np.int64))
        ids, n = pieces_of(_strings(coded.dictionary), path)
        times = np.bincount(ids, weights=np.repeat(c, n))
        used = np.flatnonzero(times)
        summary = np.concatenate([used, [ALL, KINDS, ONCE]]), np.concatenate([times[used], [c.sum(), (c > 0).sum(), (c == 1).sum()]]).astype(np.int64)
        ends, number = np.cumsum(per), n[where]
        pieces = ids[ragged((np.cumsum(n) - n)[where], number)]
        rows = [table.column("block").combine_chunks(), table.column("words").combine_chunks(), _packed(c[where], ends), _packed(number.astype(np.int32), ends), _packed(pieces, np.cumsum(number)[ends - 1])]
        last = [pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([summary[1].tobytes()]), pa.array([b""]), pa.array([summary[0].tobytes()])]
        return pa.table([pa.chunked_array([x, y.cast(x.type)]) for x, y in zip(rows, last)], ["block", "words", "c", "n", "ids"])

    # what a word costs is looked up once for the whole corpus
    table = staged(words.groupBy("bucket").applyInArrow(costed, "block long, words string, c binary, n binary, ids binary"), "words")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, place = np.unique(_unpacked(batch.column("ids"), np.int64), return_inverse=True)
                times = np.zeros(len(ids), np.int64)
                np.add.at(times, place, _unpacked(batch.column("c"), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times)], ["id", "n"])

    totals = {r["id"]: r["n"] for r in table.where("block is null").select("ids", "c").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # a row for each piece
    total, kinds, once = (totals.pop(k, 0) for k in (ALL, KINDS, ONCE))
    n_all, n_kinds = total + ends, kinds + (1 if ends else 0)

    size_of = tokenizer(path).get_piece_size()
    end = size_of
    counts = np.full(end + 1, 0.05)
    for i, n in totals.items():
        counts[i] += n
    counts[end] += ends
    group, heads = classes(counts, path, end)
    mass = np.bincount(group, weights=counts, minlength=CLASSES)
    within = (np.log(counts) - np.log(mass[group])).astype(np.float64)
    known_share = min(0.98, max(0.5, 1 - once / max(1, n_all)))

    share = min(1.0, sample_chars / max(1, size))
    chosen = slim.where("learn and text <> ''").where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    taken = [r["text"] for r in chosen.select(F.substring("text", 1, sample_chars).alias("text")).toLocalIterator()]
    flat, per = split_words(pc.ascii_lower(pa.array(taken, pa.string())))
    coded = pc.dictionary_encode(flat)
    ids, n = pieces_of(_strings(coded.dictionary), path)
    sequence = _laid_out(ids.astype(np.int64), n, coded.indices.to_numpy(), per, end)[0]
    start = train(initial(end + 1, group, mass / mass.sum()), sequence, steps)
    model = bounded(over_all(slim.where("learn and text <> ''").select("text"), start, path, end, size))

    found = table.where("block is not null")
    shared = spark.sparkContext.broadcast((model, within, heads, counts))  # of the vocabulary's size

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        m, inner, heads, pieces = shared.value
        text, per = split_words(_lowered(docs))
        where = pc.index_in(text, value_set=_unjoined(known.column("words"))[0]).to_numpy()
        c = _unpacked(known.column("c"), np.int64)
        flat = _unpacked(known.column("ids"), np.uint16).astype(np.int64)
        n = _unpacked(known.column("n"), np.int32).astype(np.int64)
        cost = np.log10((c + 0.5) / (n_all + 0.5 * (n_kinds + 1)))
        end_cost = np.log10((ends + 0.5) / (n_all + 0.5 * (n_kinds + 1)))
        edge = np.concatenate([[0], np.cumsum(per)])
        doc = np.repeat(np.arange(len(per)), per)
        base = np.bincount(doc, weights=cost[where], minlength=len(per)) + end_cost
        n_known = np.bincount(doc[c[where] > 0], minlength=len(per)) + (1 if ends else 0)
        score = np.zeros(len(per))
        begin = flat[np.minimum(np.cumsum(n) - n, max(0, len(flat) - 1))] if len(flat) else np.zeros(0, np.int64)
        seen = np.minimum(1.0, c / pieces[begin])  # of the training words with this first piece
        for lo, hi in _runs(per, 200_000):
            own = where[edge[lo] : edge[hi]]
            ids, bounds = _laid_out(flat, n, own, per[lo:hi], end)
            logp, begins = class_scores(m, ids, bounds, end, heads)
            logp = logp + inner[ids]
            # the tokens, words and ends, in order: where their pieces begin, and their share among the training tokens
            token = np.concatenate([[0], np.cumsum(per[lo:hi] + 1)])
            length, share = np.ones(token[-1], np.int64), np.ones(token[-1])
            is_word = np.ones(token[-1], bool)
            is_word[token[1:] - 1] = False
            length[is_word], share[is_word] = n[own], seen[own]
            first = np.cumsum(length) - length
            after = begins[np.minimum(first + length, len(ids) - 1)].astype(np.float64)
            opening = logp[first] - begins[first]
            follow = np.exp(np.maximum(np.add.reduceat(logp, first) - logp[first] + after, -700))
            whole = opening + np.log(np.where(is_word, known_share * share + (1 - known_share) * follow, 1.0))
            score[lo:hi] = np.add.reduceat(whole / np.log(10), token[:-1])
        rows = docs.num_rows
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pc.invert(docs.column("learn")), "n_tokens": pa.array(per + 1), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(rows, n_all, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _runs(per: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    part = np.cumsum(per + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(per)]
    return zip(cuts, cuts[1:])


def _laid_out(flat: np.ndarray, n: np.ndarray, where: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of texts, each followed by one end, and the bounds of the texts. where: the words' rows in flat and n."""
    counts = n[where]
    ids = flat[ragged((np.cumsum(n) - n)[where], counts)]
    edge = np.concatenate([[0], np.cumsum(per)])
    size = np.diff(np.concatenate([[0], np.cumsum(counts)])[edge])
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(bounds[-1]), end, np.int64)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), fold(F.col("doc_id")) != 1)
