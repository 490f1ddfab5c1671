"""Operator 5. Offset-preserving SentencePiece encoding and decoding.

The model file is read here: its pieces, and the normaliser's compiled character map, a double-array trie whose longest
prefix match gives the replacement at each place. Normalising keeps, for every byte of its output, the byte range of the
original it comes from. The piece segmentation runs on that output, by the library with its own normaliser switched off,
and each piece's byte length then projects it to a span of original bytes. No piece has a space mark after another
character, so merges never cross the start of a run of marks: the output is cut there, and each distinct segment of a
few megabytes of text is segmented once.

Defined results: a null or empty text has no ids, its spans are empty and it decodes to the empty text; a text of spaces
only is encoded as the library does it; ids outside the vocabulary are an error; very long texts are encoded whole;
repeated rows give repeated results; a null doc_id stays null; extra columns are ignored, and where they pass through, new
columns get other names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, documents, ragged

MARK = "▁"
#: Bytes of text encoded at once.
CHUNK = 6 << 20
#: The same where whole rows, spans and decoded texts go along: a worker holds about 100 times as much beside its batch.
CHUNK_OF_ROWS = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes, bytes]]:
    """(field, wire type, value, its whole encoding) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = raw[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(raw):
        begin = at
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + n]
            at += n
        yield key >> 3, kind, value, raw[begin:at]


def _message(number: int, body: bytes) -> bytes:
    head, n = bytes([number << 3 | 2]), len(body)
    while n > 127:
        head, n = head + bytes([n & 127 | 128]), n >> 7
    return head + bytes([n]) + body


class CharMap:
    """The compiled character map: byte count of a double-array trie, the trie, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n]) if n else ()
        self.targets = blob[4 + n :]

    def firsts(self) -> set[int]:
        """The bytes that a mapped prefix can begin with."""
        if not self.units:
            return set()
        root = (self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)
        return {c for c in range(1, 256) if root ^ c < len(self.units) and self.units[root ^ c] & 0x800000FF == c}

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of raw[at:], and that prefix's length."""
        if not self.units:
            return None
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.targets[found[0] : self.targets.index(b"\0", found[0])], found[1]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        raw = open(path, "rb").read()
        self.text: list[bytes] = []
        self.kind: list[int] = []
        self.user: list[bytes] = []
        norm: dict[int, int | bytes] = {}
        rest = b""
        for number, _, value, whole in _fields(raw):
            if number == 1:
                piece = {f: v for f, _, v, _ in _fields(value)}
                self.text.append(piece.get(1, b""))
                self.kind.append(piece.get(3, NORMAL))
            if number == 3:
                norm = {f: v for f, _, v, _ in _fields(value)}
            elif number != 5:  # the normalisers go; one that does nothing takes their place
                rest += whole
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.map = CharMap(norm.get(2, b""))
        self.begins: re.Pattern | bool | None = None
        self.user = sorted((t for t, k in zip(self.text, self.kind) if k == USER), key=len, reverse=True)
        idle = _message(3, _message(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=rest + idle)
        mark = MARK.encode()
        self.mark = mark if self.escape else b" "
        self.splits = not any(self.mark in t.lstrip(self.mark) for t, k in zip(self.text, self.kind) if k in (NORMAL, USER))
        self.size = np.array([1 if k == BYTE else len(t) for t, k in zip(self.text, self.kind)], np.int64)
        self.name = [str(i) for i in range(len(self.text))]
        self.byte = {i: int(t[3:5], 16) for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.out = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(mark, b" ") for t, k in zip(self.text, self.kind)]

    def _hits(self, raw: bytes) -> list[tuple[int, int, bytes]]:
        """(begin, end, replacement) of user pieces, which stay, and of the longest mapped prefixes, from left to right.

        Only places whose byte can begin one are walked; all other characters stand for themselves.
        """
        if self.begins is None:
            firsts = self.map.firsts() | {u[0] for u in self.user}
            self.begins = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in sorted(firsts)) + b"]") if firsts else False
        if not self.begins:
            return []
        found, at = [], 0
        while m := self.begins.search(raw, at):
            at = m.start()
            own = next((u for u in self.user if raw.startswith(u, at)), None)
            hit = (own, len(own)) if own else self.map.longest(raw, at)
            if hit is None:
                c = raw[at]
                at += 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                continue
            found.append((at, at + hit[1], hit[0]))
            at += hit[1]
        return found

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes and, for each, where the original range begins and ends that it comes from."""
        text = np.frombuffer(raw, np.uint8)
        lead = (text & 0xC0) != 0x80
        first = np.flatnonzero(lead)
        char = np.cumsum(lead) - 1
        begin, end = first[char], np.append(first[1:], len(text))[char]
        if hits := self._hits(raw):
            parts, at = [], 0
            for a, b, new in hits:
                parts += [(text[at:a], begin[at:a], end[at:a]), (np.frombuffer(new, np.uint8), np.full(len(new), a), np.full(len(new), b))]
                at = b
            parts.append((text[at:], begin[at:], end[at:]))
            text, begin, end = (np.concatenate(x) for x in zip(*parts))
        if self.squeeze:
            blank = text == 32
            stays = ~(blank & np.concatenate([[True], blank[:-1]]))[: len(text)]
            solid = np.flatnonzero(~blank)
            stays[solid[-1] + 1 if len(solid) else 0 :] = False
            text, begin, end = text[stays], begin[stays], end[stays]
        if self.prefix and len(text):
            text, begin, end = (np.concatenate([[x], y]).astype(y.dtype) for x, y in ((32, text), (begin[0], begin), (begin[0], end)))
        if len(self.mark) > 1:
            blank = text == 32
            wide = np.where(blank, len(self.mark), 1)
            text, begin, end, blank = (np.repeat(x, wide) for x in (text, begin, end, blank))
            text = text.copy()
            text[blank] = np.tile(np.frombuffer(self.mark, np.uint8), int(blank.sum()) // len(self.mark))
        return text.tobytes(), begin.astype(np.int64), end.astype(np.int64)

    def _segments(self, normal: str) -> list[str]:
        mark = self.mark.decode()
        if not self.splits:
            return [normal]
        if mark + mark not in normal and normal.startswith(mark):
            return [mark + w for w in normal[1:].split(mark)]
        return re.findall(f"{mark}+[^{mark}]*|[^{mark}]+", normal)

    def _ids_of(self, segments: pa.Array, front: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments (with front put before each) in one array, and how many each has."""
        coded = pc.dictionary_encode(segments)
        each = self.segmenter.encode([front + w for w in coded.dictionary.to_pylist()], num_threads=1)
        n = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(n.sum()))
        index = coded.indices.to_numpy()
        counts = n[index]
        return flat[ragged((np.cumsum(n) - n)[index], counts)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends, count by text): spans in bytes of each original text."""
        normal = [self.normalise(r.encode()) for r in pc.fill_null(texts, "").to_pylist()]
        mark = self.mark
        odd = np.array([len(n) > 0 and (not self.splits or not n.startswith(mark) or mark + mark in n) for n, _, _ in normal], bool)
        # each text is cut before its marks, all texts at once; what stands before the first mark is nothing
        lists = pc.split_pattern(pa.array([b"" if o else n for o, (n, _, _) in zip(odd, normal)], pa.binary()).cast(pa.string()), mark.decode())
        number = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.ones(int(number.sum()), bool)
        inner[np.cumsum(number) - number] = False
        ids, per = self._ids_of(pc.list_flatten(lists).filter(pa.array(inner)), mark.decode())
        at, bounds = np.concatenate([[0], np.cumsum(per)]), np.concatenate([[0], np.cumsum(number - 1)])
        counts = at[bounds[1:]] - at[bounds[:-1]]
        if odd.any():  # runs of marks are one segment
            segments = [self._segments(n.decode()) for o, (n, _, _) in zip(odd, normal) if o]
            more, per = self._ids_of(pa.array([x for each in segments for x in each], pa.string()))
            at, bounds = np.concatenate([[0], np.cumsum(per)]), np.concatenate([[0], np.cumsum([len(x) for x in segments])])
            first = np.cumsum(counts) - counts
            first[odd] = len(ids) + at[bounds[:-1]]
            counts[odd] = at[bounds[1:]] - at[bounds[:-1]]
            ids = np.concatenate([ids, more])[ragged(first, counts)]
        size = self.size[ids]
        if (np.array(self.kind)[ids] == UNKNOWN).any():
            edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
            size = np.concatenate([self._sizes(ids[i:j], n) for i, j, (n, _, _) in zip(edge, edge[1:], normal)])
        to = np.cumsum(size)
        begin, end = (np.concatenate([x[k] for x in normal] or [np.zeros(0, np.int64)]) for k in (1, 2))
        return ids, begin[to - size], end[to - 1], counts

    def _sizes(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        """Bytes of the normalised text under each id. The unknown piece has those of a run that no piece covers."""
        size = self.size[ids]
        unknown = np.flatnonzero(np.array(self.kind)[ids] == UNKNOWN)
        if not len(unknown):
            return size
        known = np.concatenate([[0], np.cumsum(size)])
        more = 0  # what the unknown pieces so far are longer than the table says
        for i in unknown.tolist():
            at = int(known[i]) + more
            stop = len(normal) if i + 1 == len(ids) else normal.index(self.text[ids[i + 1]], at + 1)
            more += stop - at - int(size[i])
            size[i] = stop - at
        return size

    def decode(self, ids: list[int]) -> str:
        """As the library: the first piece that isn't a control loses the mark of the prefix; bytes that are no text become U+FFFD each."""
        parts = [self.out[i] for i in ids]
        if self.byte and not self.byte.keys().isdisjoint(ids):
            at = 0
            while at < len(ids):
                if ids[at] not in self.byte:
                    at += 1
                    continue
                end = at
                while end < len(ids) and ids[end] in self.byte:
                    end += 1
                run = bytes(self.byte[i] for i in ids[at:end])
                parts[at] = _lenient(run)
                parts[at + 1 : end] = [b""] * (end - at - 1)
                at = end
        if self.prefix:
            k = next((k for k, i in enumerate(ids) if self.kind[i] != CONTROL), None)
            if k is not None and self.text[ids[k]].startswith(MARK.encode()) and self.kind[ids[k]] in (NORMAL, USER):
                parts[k] = parts[k][1:]
        return b"".join(parts).decode()


def _lenient(run: bytes) -> bytes:
    """run as UTF-8, each byte that begins no character replaced by U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    run[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                if at + n <= len(run):
                    out.append(run[at : at + n])
                    break
            else:
                n = 1
                out.append(b"\xef\xbf\xbd")
            at += n
        return b"".join(out)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One reading of the model a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded): token ids, original byte spans, and the text they decode to."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in chunks(batches, "text", CHUNK):
            ids, starts, ends, counts = pieces.encode(batch.column("text"))
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = ids.tolist()
            edge = bounds.to_pylist()
            decoded = [pieces.decode(lists[a:b]) for a, b in zip(edge, edge[1:])]
            arrays = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, pa.array(decoded, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes): the digests are taken where the ids are, so lists never leave the worker."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in chunks(batches, "text", CHUNK):
            ids, starts, ends, counts = pieces.encode(batch.column("text"))
            lists, edge, name = ids.tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist(), pieces.name
            length = np.concatenate([[0], np.cumsum(ends - starts)])
            sha, dec = [], []
            for a, b in zip(edge, edge[1:]):
                own = lists[a:b]
                sha.append(hashlib.sha256(",".join([name[i] for i in own]).encode()).hexdigest())
                dec.append(hashlib.sha256(pieces.decode(own).encode()).hexdigest())
            covered = length[edge[1:]] - length[edge[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(sha), pa.array(dec), pa.array(covered)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def with_tokens(docs: DataFrame, model: str | None = None, decoded: str | None = None) -> DataFrame:
    """docs with ids, starts and ends of the pieces appended, and the text they decode to if decoded names a column for it. A name that docs has already gets underscores in front."""
    path = model or default_model()
    names = docs.columns
    text = names.index("text")
    added: list[str] = []
    for name in ["ids", "starts", "ends", *([decoded] if decoded else [])]:
        while name in names or name in added:
            name = f"_{name}"
        added.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in chunks(batches, "text", CHUNK_OF_ROWS):
            ids, starts, ends, counts = pieces.encode(batch.column(text))
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
            if decoded:
                lists, edge = ids.tolist(), bounds.to_pylist()
                arrays.append(pa.array([pieces.decode(lists[a:b]) for a, b in zip(edge, edge[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *added])

    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in added[:3]] + [T.StructField(c, T.StringType()) for c in added[3:]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
