"""Operator 9. Secret scans with a recursive decoding worklist.

Every text is scanned by the base patterns. Then a worklist unwraps layers: percent-encoding, \\u and \\x escapes, base64
(either alphabet) and gzip or zlib bytes inside it. Each layer is scanned again, and its spans are mapped to code points
of the original text. A layer whose content was seen before in this document isn't entered again, so cycles end; layers
shrink or repeat, so the list runs to its fixpoint.

Decoded bytes need not be text: a byte that is no UTF-8 is one character that no pattern matches, with its own place. A
run of base64 goes on over line breaks (with blanks beside them) and is decoded at all four alignments, so neither what
stands before it nor a line's length hides it. Compressed data may begin at any byte of a run. It is unpacked as a stream
of pieces, through all members and any depth of direct nesting; a broken or cut stream counts as far as it unpacks. All
that is found in it has the range of the stream's characters. Pieces are cut where no pattern and no layer is; only an
unbroken run of over HOLD bytes inside compressed data is cut within, with an overlap of PIECE.

Defined results: a null text counts as empty, an empty one has no spans; a span that two ways find is listed once; very long
texts are scanned whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents

KINDS = ("assign", "access", "hex")
#: Explicit letter cases: a case-insensitive pattern would also match letters outside ASCII that fold into it.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
LAYER_HINT = r"%[0-9A-Fa-f]{2}|\\[ux]|(?:[A-Za-z0-9+/_-](?:[\t ]*(?:\r\n|\r|\n)[\t ]*)?){16}"

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:[\t ]*(?:\r\n|\r|\n)[\t ]*[A-Za-z0-9+/_-]+)*")
_BREAKS = re.compile(r"[\t\r\n ]+")
#: Bytes without a match have neither a secret nor a layer; over line breaks, a run may be as short as 16 characters.
_OF_USE = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-](?:(?:[\t ]*(?:\r\n|\r|\n)[\t ]*)?[A-Za-z0-9+/_-]){15}"
)
_GZIP = b"\x1f\x8b\x08"
_PACKED = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78](?=[\x00-\x1f\x40-\x5f\x80-\x9f\xc0-\xdf])")
#: What no pattern and no layer goes across: pieces of a stream are cut behind it.
_GAP = re.compile(rb"[^A-Za-z0-9+/_.=:%\\\"'\t\r\n -]")
#: Bytes that a stream is unpacked by, and that are held of a run without a gap.
PIECE, HOLD = 1 << 20, 8 << 20

Span = tuple[int, int, int]


def base_spans(text: str, assign: bool = True) -> list[Span]:
    """(start, kind, end), sorted. A run of the hex or access alphabet that is too short fails whole, so the bounded patterns find the same."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if assign else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text with, for each of its code points, the original range it comes from; a whole-range layer has one range for all."""

    def __init__(self, text: str, starts: list[int] | None, ends: list[int] | None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return a, b
        return self.starts[a], self.ends[b - 1]


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of pattern decoded in place; decode gives (character, from, to) within the match, or None."""
    out, starts, ends, at, changed = [], [], [], 0, False

    def copy(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        if not layer.whole:
            for i in range(a, b):
                s, e = layer.span(i, i + 1)
                starts.append(s)
                ends.append(e)

    for m in pattern.finditer(layer.text):
        parts = decode(m)
        if parts is None:
            continue
        copy(at, m.start())
        for char, a, b in parts:
            s, e = layer.span(m.start() + a, m.start() + b)
            out.append(char)
            starts.append(s)
            ends.append(e)
        at, changed = m.end(), True
    if not changed:
        return None
    copy(at, len(layer.text))
    return Layer("".join(out), None if layer.whole else starts, None if layer.whole else ends, layer.whole)


def _lenient(raw: bytes) -> str:
    """raw as text; each byte that is no UTF-8 is a lone surrogate of its own."""
    return raw.decode("utf-8", "surrogateescape")


def _width(c: str) -> int:
    return 1 if "\udc80" <= c <= "\udcff" else len(c.encode())


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    at, parts = 0, []
    for c in _lenient(bytes.fromhex(m.group().replace("%", ""))):
        n = 3 * _width(c)
        parts.append((c, at, at + n))
        at += n
    return parts


def _escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = int(m.group(1) or m.group(2), 16)
    return None if 0xD800 <= code < 0xE000 else [(chr(code), 0, len(m.group()))]


def _is_packed(raw: bytes) -> bool:
    m = _PACKED.match(raw)
    return bool(m) and (raw[0] == 0x1F or (raw[0] * 256 + raw[1]) % 31 == 0)


class _Stream:
    """The pieces that compressed data unpacks to, over all gzip members, as far as it is sound; end: bytes of it that belong to them."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.end = source, 0

    def __iter__(self) -> Iterator[bytes]:
        d, rest = zlib.decompressobj(47), b""
        for data in self.source:
            self.end += len(data)
            data = rest + data if rest else data
            rest = b""
            while len(data):
                if d is None:  # behind a member: the next one, or nothing that belongs to it
                    if bytes(data[:3]) != _GZIP[: len(data)]:
                        self.end -= len(data)
                        return
                    if len(data) < 3:
                        rest = data
                        break
                    d = zlib.decompressobj(47)
                before = d.copy()
                try:
                    out = d.decompress(data, PIECE)
                except zlib.error:  # what comes before the fault
                    self.end -= len(data)
                    try:
                        for k in range(len(data)):
                            if out := before.decompress(data[k : k + 1]):
                                yield out
                            self.end += 1
                    except zlib.error:
                        return
                if out:
                    yield out
                if d.eof:
                    data, d = d.unused_data, None
                else:
                    data = d.unconsumed_tail
        self.end -= len(rest)


def _cut(pieces: Iterator[bytes], digest) -> Iterator[bytes]:
    """The same bytes in stretches cut where no pattern and no layer is; an unbroken run of more than HOLD bytes, with an overlap."""
    held = b""
    for piece in pieces:
        digest.update(piece)
        held += piece
        if len(held) < PIECE:
            continue
        at = 0
        for low in (max(0, len(held) - 4096), max(0, len(held) - PIECE)):
            at = at or max((m.end() for m in _GAP.finditer(held, low)), default=0)
        if at:
            yield held[:at]
            held = held[at:]
        elif len(held) > HOLD:
            yield held
            held = held[-PIECE:]
    if held:
        yield held


def _unpacked(packed: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """Stretches of what packed unpacks to, and of what that unpacks to in turn, until it isn't compressed or repeats."""
    seen = set()
    while True:
        head, more = b"", False
        for piece in (pieces := iter(_Stream(packed()))):
            head += piece
            if more := len(head) >= HOLD:
                break
        digest = hashlib.blake2b(digest_size=16)
        yield from _cut(chain([head], pieces), digest)
        if not _is_packed(head) or digest.digest() in seen:
            return
        seen.add(digest.digest())
        packed = (lambda outer=packed: iter(_Stream(outer()))) if more else (lambda whole=head: iter([whole]))


def _packed_layers(raw: bytes, span) -> Iterator[Layer]:
    """Layers of the compressed data that begins anywhere in raw; span gives the original range of a range of bytes."""
    view, at = memoryview(raw), 0
    while m := _PACKED.search(raw, at):
        at = m.start() + 1
        if not _is_packed(raw[m.start() : m.start() + 3]):
            continue
        packed = lambda a=m.start(): (view[k : k + 65536] for k in range(a, len(raw), 65536))
        stream = _Stream(packed())
        if sum(map(len, stream)):
            at = m.start() + max(1, stream.end)
            whole = span(m.start(), at)
            for text in _unpacked(packed):
                if _OF_USE.search(text):
                    yield Layer(_lenient(text), None, None, whole)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 16:
            continue
        run, lines, sizes = m.group(), [0], [0]
        if "\n" in run or "\r" in run:  # where the lines begin, in the text and without the breaks
            for x in _BREAKS.finditer(run):
                sizes.append(sizes[-1] + x.start() - lines[-1])
                lines.append(x.end())
            run = _BREAKS.sub("", run)
            if len(run) < 16:
                continue
        run = run.replace("-", "+").replace("_", "/")

        def place(k: int) -> int:
            line = bisect_right(sizes, k) - 1
            return m.start() + lines[line] + k - sizes[line]

        for shift in range(4):
            body = run[shift : len(run) - ((len(run) - shift) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))

            def span(a: int, b: int) -> tuple[int, int]:  # byte k of the content lies in characters 4k // 3 to (4k + 7) // 3 of the code
                return layer.span(place(shift + 4 * a // 3), place(shift + min(len(body), (4 * (b - 1) + 7) // 3) - 1) + 1)

            yield from _packed_layers(raw, span)
            if not _OF_USE.search(raw):
                continue
            text = _lenient(raw)
            if layer.whole:
                yield Layer(text, None, None, layer.whole)
                continue
            starts, ends, at = [], [], 0
            for c in text:
                n = _width(c)
                s, e = span(at, at + n)
                starts.append(s)
                ends.append(e)
                at += n
            yield Layer(text, starts, ends)


def _layers(layer: Layer) -> Iterator[Layer]:
    for pattern, decode in ((_PERCENT, _percent), (_ESCAPE, _escape)):
        if new := _replaced(layer, pattern, decode):
            yield new
    yield from _base64_layers(layer)


def all_spans(text: str, base: list[Span]) -> list[Span]:
    found, seen = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = [_layers(Layer(text, None, None))]  # depth first, so that one stretch of each layer is held
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        key = hashlib.blake2b(repr((new.text, new.span(0, len(new.text)))).encode("utf-8", "surrogatepass"), digest_size=16).digest() if new.text else None
        if key is None or key in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(new.text):
            s, e = new.span(a, b)
            found.add((s, kind, e))
        work.append(_layers(new))
    return sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): comma-joined kind:start:end, in code points of the text, ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            assign = pc.match_substring_regex(texts, ASSIGN_HINT).to_pylist()
            layered = pc.match_substring_regex(texts, LAYER_HINT).to_pylist()
            base, spans = [], []
            for t, has_assign, has_layer in zip(texts.to_pylist(), assign, layered):
                b = base_spans(t, has_assign)
                base.append(listed(b))
                spans.append(listed(all_spans(t, b)) if has_layer else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.regexp_count("base", F.lit(kind + ":")).cast("long").alias(f"n_{kind}")
    return scan_secrets(documents(spark, sf_dir)).select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
