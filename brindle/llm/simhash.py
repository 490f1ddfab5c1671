"""Operator 8. SimHash near-duplicates by tiled exact comparison.

Fingerprints come from word shingles; tiles of fingerprints are compared in full with numpy exclusive-or and bit counts.
A tile holds fingerprints whose four 16-bit parts have the same population counts. Two fingerprints differ in at least
the summed difference of those counts, so tile pairs for which it is beyond the radius are skipped, and none other.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; equal
fingerprints are one class; extra columns are ignored; a repeated row counts once more but changes no component; a null
doc_id has a fingerprint, and its component is the smallest id that is not null (null if there is none).

The pipeline's near_dedup stage (drop_near_copies) has settings of its own: near copies are texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Two such sets of n shingles share one of the first n // 5 + 1 of each in
any order that holds for all sets, so only sets that do are compared: no pair is lost, and unrelated texts don't meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, connected_components, documents, located, shared_dir

#: Fingerprints in one tile row, about.
TILE = 1024
#: The pipeline's stage: words of a shingle, least Jaccard similarity (4/5 in the code), bits of 128 that candidates may
#: differ in, and sets in a tile. At 0.8 the bits differ in 19 +- 4 places, those of unrelated texts in 64 +- 6.
NEAR_WIDTH, NEAR_SHARE, NEAR_RADIUS, NEAR_TILE = 5, 0.8, 40, 4096
#: Sets that share a shingle are paired at once up to so many, more are compared in tiles; entries of a bucket, about.
NEAR_FEW, NEAR_BUCKET = 16, 1 << 20
#: Rows among which frequent shingles are looked for, about, and how many are told to all tasks. They only order shingles.
NEAR_SAMPLE, NEAR_COMMON = 4000, 1 << 17


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, 42)] if words else []
    ends = list(accumulate((len(w) + 1 for w in words)))
    return [h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a bit is set where over half of the shingles' XXH64 values (seed 42) have it set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            hashes = [shingle_hashes((t or "").encode(), width) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in hashes])
            out = np.zeros(len(n), np.uint64)
            some = n > 0
            if some.any():
                flat = np.fromiter((x for xs in hashes for x in xs), np.uint64, int(n.sum()))
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                starts = (np.cumsum(n) - n)[some]
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(out.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of four counts that sum to radius at most, one of each pair of opposites."""
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def hamming_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) for all pairs of the distinct fingerprints in column fp that differ in 1 to radius bits."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    keyed = fps.select("fp").distinct().select("fp", *(part(k).cast("int").alias(f"p{k}") for k in range(4)))
    key = lambda cols: sum((c * 32**k for k, c in enumerate(cols)), F.lit(0))
    keyed = keyed.select("fp", key([F.col(f"p{k}") + 3 for k in range(4)]).alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count("*") / tile).alias("n"))  # at most 17^4 rows, so it may be broadcast
    chunked = keyed.join(F.broadcast(sizes), "tile").select("tile", "fp", F.pmod(F.xxhash64("fp"), F.col("n")).alias("chunk"))
    tiles = chunked.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps")).checkpoint()
    steps = F.array(*(F.lit(int(sum(d * 32**k for k, d in enumerate(o)))) for o in _offsets(radius)))
    left = tiles.select(F.col("tile").alias("t1"), F.col("chunk").alias("c1"), F.col("fps").alias("x"), F.explode(steps).alias("d"))
    left = left.select("t1", "c1", "x", (F.col("t1") + F.col("d")).alias("tile"))
    pairs = left.join(tiles, "tile").where((F.col("t1") != F.col("tile")) | (F.col("c1") <= F.col("chunk")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, same = [], batch.column("same").to_pylist()
            (xo, xv), (yo, yv) = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column("x"), batch.column("y")))
            for i in range(batch.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if near.any():
                    a, b = np.nonzero(near)
                    once = a < b if same[i] else a >= 0
                    found.append((x[a[once]], y[b[once]]))
            if found:
                a, b = (np.concatenate(z).view(np.int64) for z in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    same = ((F.col("t1") == F.col("tile")) & (F.col("c1") == F.col("chunk"))).alias("same")
    return pairs.select("x", F.col("fps").alias("y"), same).mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    shared_dir(docs.sparkSession)
    fps = fingerprints(docs, width).checkpoint()
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    comp = connected_components(hamming_links(fps, radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    classes = first.join(comp, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, width: int = NEAR_WIDTH) -> set[bytes]:
    words = text.lower().split()
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def wide_shingles(text: str | None) -> np.ndarray:
    """The distinct 128-bit hashes of a text's shingles, in order, as pairs of 64 bits."""
    h, words = xxhash.xxh3_128_digest, (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    raw = b"".join([h(joined[a : b - 1]) for a, b in zip([0, *ends], ends[NEAR_WIDTH - 1 :] or ends[-1:])])
    two = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    two = two[np.lexsort((two[:, 1], two[:, 0]))]
    return two[np.concatenate([[True], (two[1:] != two[:-1]).any(axis=1)])] if len(two) else two


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several rows of a sample have, by the first half of their hashes, and in how many rows."""
    share = int(min(1.0, NEAR_SAMPLE / max(1, docs.count())) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            found = [wide_shingles(t)[:, 0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("file", "pos"), F.lit(1 << 30)) <= share).select("text").mapInArrow(run, "h long")
    often = sample.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(NEAR_COMMON).collect()
    h, n = np.array([r["h"] for r in often], np.int64).view(np.uint64), np.array([r["count"] for r in often], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def wide_fingerprints(docs: DataFrame, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, file, pos, digest, n, lo, hi, prefix) of (id, file, pos, text): digest and size of the set of shingles, a SimHash
    of 128 bits of its distinct members, and the hashes of its first n // 5 + 1 members, those in common last."""
    shared = docs.sparkSession.sparkContext.broadcast(common or (np.zeros(0, np.uint64), np.zeros(0, np.int64)))  # NEAR_COMMON at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in chunks(batches, "text", 1 << 20):
            digests, sizes, prefixes, fps = [], [], [], np.zeros((batch.num_rows, 2), np.uint64)
            for i, t in enumerate(batch.column("text").to_pylist()):
                two = wide_shingles(t)
                digests.append(hashlib.blake2b(two.tobytes(), digest_size=16).digest())
                sizes.append(len(two))
                first = two[:, 0]
                if len(often):
                    at = np.minimum(np.searchsorted(often, first), len(often) - 1)
                    first = first[np.argsort(np.where(often[at] == first, times[at], 0), kind="stable")]
                prefixes.append(first[: len(two) // 5 + 1].tobytes())
                if len(two):
                    ones = np.zeros(128, np.int64)
                    for k in range(0, len(two), 4096):
                        ones += np.unpackbits(two[k : k + 4096].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
                    fps[i] = np.packbits(2 * ones > len(two)).view(np.uint64)
            lo, hi = (pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in (0, 1))
            names = ["id", "file", "pos"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lo, hi, pa.array(prefixes, pa.binary())], [*names, "digest", "n", "lo", "hi", "prefix"])

    return docs.select("id", "file", "pos", "text").mapInArrow(run, "id long, file long, pos long, digest binary, n long, lo long, hi long, prefix binary")


def sharing(sets: DataFrame, few: int = NEAR_FEW, size: int = NEAR_BUCKET) -> DataFrame:
    """(a, b, many) of sets (node, prefix): the pairs of nodes that share a hash in their prefixes, some repeatedly; where
    more than few nodes share one, it has a row for each of them instead: a names the hash, b is the node, and many holds.

    Hashes are cut to 32 bits and the bucket's number, which lets a few more sets meet. They travel packed: a row holds
    the entries of many sets that fall into a bucket.
    """
    entries = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    buckets = max(1, entries // 8 // size)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "prefix"):
            raw = batch.column("prefix")
            h = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
            node = np.repeat(batch.column("node").to_numpy(), pc.binary_length(raw).to_numpy() // 8)
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            numbers, cuts = np.unique(bucket[order], return_index=True)
            keys, nodes = h[order].astype(np.uint32), node[order]
            ends = [*cuts[1:].tolist(), len(keys)]
            # the nodes byte by byte, as their high bytes are much alike
            packed = [(keys[a:b].tobytes(), nodes[a:b].view(np.uint8).reshape(-1, 8).T.tobytes()) for a, b in zip(cuts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), *(pa.array(c, pa.binary()) for c in zip(*packed))] if packed else [pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["bucket", "keys", "nodes"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        nodes = np.concatenate([np.frombuffer(r, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for r in table.column("nodes").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        number = np.diff(np.append(first, len(keys)))
        of = np.repeat(number, number)
        x, y = keys[of > few], nodes[of > few]
        name = (np.int64(table.column("bucket")[0].as_py()) << 32) + x.astype(np.int64)
        keys, nodes = keys[(of > 1) & (of <= few)], nodes[(of > 1) & (of <= few)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, few):
            same = keys[d:] == keys[:-d]
            a.append(np.minimum(nodes[d:], nodes[:-d])[same])
            b.append(np.maximum(nodes[d:], nodes[:-d])[same])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = (a != b) & np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        a, b = a[once], b[once]
        return pa.table({"a": np.concatenate([a, name]), "b": np.concatenate([b, y]), "many": np.concatenate([np.zeros(len(a), bool), np.ones(len(y), bool)])})

    return sets.select("node", "prefix").mapInArrow(split, "bucket long, keys binary, nodes binary").groupBy("bucket").applyInArrow(meet, "a long, b long, many boolean")


def near_candidates(sets: DataFrame, radius: int = NEAR_RADIUS, tile: int = NEAR_TILE, few: int = NEAR_FEW) -> DataFrame:
    """(a, b) for all pairs of sets (node, n, lo, hi, prefix) that share a hash in their prefixes, differ in radius of 128
    bits at most and whose sizes allow NEAR_SHARE."""
    names = ("node", "n", "lo", "hi")
    slim = sets.select(*names)
    met = sharing(sets, few).checkpoint()

    def side(k: str) -> DataFrame:
        return slim.select(*(F.col(c).alias(k if c == "node" else c + k) for c in names))

    apart = F.bit_count(F.col("loa").bitwiseXOR(F.col("lob"))) + F.bit_count(F.col("hia").bitwiseXOR(F.col("hib")))
    pairs = met.where("not many").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where((apart <= radius) & (F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4)).select("a", "b")

    # many sets that share a hash: tiles of them meet, and inside, every pair is compared
    keyed = met.where("many").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct()
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("number"))
    tiles = keyed.join(sizes, "key").join(slim, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("number")).cast("int"))
    tiles = tiles.groupBy("key", "chunk").agg(F.first("number").alias("number"), *(F.collect_list(c).alias(c) for c in names)).checkpoint()
    left = tiles.select("key", F.col("chunk").alias("c1"), *(F.col(c).alias(f"{c}1") for c in names), F.explode(F.sequence("chunk", F.col("number") - 1)).alias("chunk"))
    right = tiles.select("key", "chunk", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = ([np.asarray(batch.column(c + k)[row].values) for c in names] for k in ("1", ""))
                once = batch.column("same")[row].as_py()
                for i in range(0, len(x[0]), 64):
                    node, n, lo, hi = (c[i : i + 64, None] for c in x)
                    apart = np.bitwise_count(lo.view(np.uint64) ^ y[2].view(np.uint64)) + np.bitwise_count(hi.view(np.uint64) ^ y[3].view(np.uint64))
                    a, b = np.nonzero(apart <= radius)
                    p, q = n[a, 0], y[1][b]
                    good = np.minimum(p, q) * 5 >= np.maximum(p, q) * 4
                    if once:
                        good &= a + i < b
                    if good.any():
                        p, q = node[a[good], 0], y[0][b[good]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    same = (F.col("c1") == F.col("chunk")).alias("same")
    more = left.join(right, ["key", "chunk"]).select(*(c + k for k in ("1", "") for c in names), same).mapInArrow(run, "a long, b long")
    return pairs.union(more).distinct()


def near_links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes whose texts' sets of shingles have a Jaccard similarity of NEAR_SHARE at least, counted exactly. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, set())
        for batch in batches:
            a, b, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i in range(batch.num_rows):
                x = batch.column("x")[i].as_py()
                if kept[0] != x:
                    kept = (x, shingles((x or "").encode()))
                y = shingles((batch.column("y")[i].as_py() or "").encode())
                common = len(kept[1] & y)
                good.append(5 * common >= 4 * (len(kept[1]) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(pa.array(good, pa.bool_())) for c in (a, b)], ["a", "b"])

    found = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return found.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: the smallest doc_id's, nulls last, and of rows that share it one by its place.

    Near copies share NEAR_SHARE of their sets of five-word shingles; a text of five words or fewer is one shingle, and
    texts without words are equal. A 128-bit SimHash of the sets proposes pairs among those that share a shingle of their
    prefixes, which exact Jaccard similarity then decides. Rows are told apart by their places, so rows that share an id are judged each by its own text.
    """
    shared_dir(docs.sparkSession)
    rows, file, pos = located(docs)
    texts = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(file).alias("file"), F.col(pos).alias("pos"), "text")
    marks = wide_fingerprints(texts, common_shingles(texts)).withColumn("row", F.monotonically_increasing_id()).checkpoint()  # numbers are fixed here
    best = F.struct(F.col("id").isNull().alias("unnamed"), "id", "file", "pos")
    sets = marks.groupBy("digest").agg(F.min(best).alias("best"), F.min("row").alias("node"), *(F.first(c).alias(c) for c in ("n", "lo", "hi", "prefix")))
    pairs = near_candidates(sets).checkpoint()
    sets = sets.select("digest", "best", "node").checkpoint()
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(sets.select("node", "best.file", "best.pos"), "node")
    links = near_links(texts.join(met, ["file", "pos"]).select("node", "text").checkpoint(), pairs)
    comp = connected_components(links)
    classes = sets.select("digest", "node", "best").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = classes.groupBy("component").agg(F.min("best").alias("stays"))
    gone = marks.join(classes.join(stays, "component").select("digest", "stays"), "digest").where("file <> stays.file or pos <> stays.pos")
    gone = gone.select(F.col("file").alias(file), F.col("pos").alias(pos))
    return rows.join(gone, [file, pos], "left_anti").select(*(rows[c] for c in docs.columns))
