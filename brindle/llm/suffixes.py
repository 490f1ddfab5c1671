"""Operator 7. Substring deduplication with prefix-partitioned suffix trees.

A window of WINDOW words that occurs twice has in both places the same least SHINGLE-word hash, its anchor. So suffixes
are taken up only around anchors that occur twice in the corpus; the rest of the text can hold no deep node. Those
suffixes are split by variable-length prefixes: by the anchor's words alone where few places share them, by as many
further words as the window has where many do, so that each group fits in memory. In each group the suffixes are brought
into lexicographic order by doubling, and the lengths of the prefixes that neighbours share, counted word by word, give
the subtree's internal nodes with their depths; the topmost ones at least WINDOW words deep are maximal repeats, and the
places under them are marked.

Words are compared by 64-bit hashes, a window by its 35 of them. Documents are handled in blocks of about BLOCK_BYTES, so
that rows which agree are combined before any shuffle: a group with a third of all rows sends one row a block.

Defined results: a null or empty text has no words; a row without a doc_id is handled like any other; an empty table gives
no rows; a text shorter than a window loses none; overlapping places within one
document count; repeated rows make their windows repeated; extra columns are ignored; very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, ragged

WINDOW, SHINGLE = 35, 8
BLOCK_BYTES = 6 << 20
#: Places of one anchor beyond which the prefix is lengthened to the whole window.
HOT = 20_000
#: Rows a tree is built of at once, about.
GROUP_ROWS = 20_000

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words by text): polynomial hashes of all words at once from one running sum."""
    texts = pc.fill_null(texts, "")
    texts = texts if isinstance(texts, pa.Array) else texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_M, len(raw)))])
    code = (total[ends] - total[starts]) * _powers(_INVERSE, len(raw) + 1)[starts]
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return _mixed(code ^ (ends - starts).astype(np.uint64)), counts


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j in range(n):
        out = out * _M + codes[j : j + len(out)]
    return _mixed(out)


def anchors(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, first window, last window, anchor hash); places count over all texts."""
    ends = np.cumsum(counts)
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low = _grams(codes, SHINGLE)
    at = np.arange(len(low))
    width, span = 1, WINDOW - SHINGLE + 1
    while width < span:
        step = min(width, span - width)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    text = np.repeat(np.arange(len(counts)), counts)
    sound = text[:n] == text[WINDOW - 1 :]
    change = np.ones(n, bool)
    change[1:] = (at[1:n] != at[: n - 1]) | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(change & sound)
    stop = np.flatnonzero(np.concatenate([change[1:], [True]]) | ~np.concatenate([sound[1:], [False]]))
    last = stop[np.searchsorted(stop, first)]
    return text[first], first, last, low[first]


def _plain(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's anchors and how often they occur in this batch."""
    for batch in chunks(batches, "text", BLOCK_BYTES):
        codes, counts = word_codes(batch.column("text"))
        text, _, _, h = anchors(codes, counts)
        block = batch.column("block").to_numpy()[text]
        order = np.lexsort((h, block))
        h, block = h[order], block[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(h[at].view(np.int64)), pa.array(times)], ["block", "h", "n"])


def _sorted_docs(docs: pa.Table) -> pa.Table:
    """A block's rows in an order that depends on their content alone."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


_SUFFIX = "prefix long, block long, doc int, start int, n int, multi boolean, codes binary"


def _suffixes(docs: pa.Table, again: pa.Table) -> pa.Table:
    """The block's windows around repeated anchors, one row for each run of windows with one anchor; rows that agree become one."""
    out: dict[str, list] = {c.split()[0]: [] for c in _SUFFIX.split(", ")}

    def add(*row) -> None:
        for column, x in zip(out.values(), row):
            column.append(x)

    if docs.num_rows and again.num_rows:
        docs = _sorted_docs(docs)
        block = docs.column("block")[0].as_py()
        codes, counts = word_codes(_plain(docs, "text"))
        text, first, last, h = anchors(codes, counts)
        known = again.column("h").to_numpy().view(np.uint64)
        by = np.argsort(known)
        known, total = known[by], again.column("total").to_numpy()[by]
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        take = np.flatnonzero(known[k] == h)
        total = total[k]
        base = np.cumsum(counts) - counts
        seen: dict[bytes, list[int]] = {}
        lone: list[tuple[int, int]] = []  # windows that go by themselves; in seen as -1 - their place here
        for i in take.tolist():
            a, b = int(first[i]), int(last[i])
            if total[i] > HOT:
                for w in range(a, b + 1):
                    seen.setdefault(codes[w : w + WINDOW].tobytes(), []).append(-1 - len(lone))
                    lone.append((i, w))
            else:
                seen.setdefault(codes[a : b + WINDOW].tobytes(), []).append(i)
        for raw, places in seen.items():
            spots = [lone[-1 - x] if x < 0 else (x, int(first[x])) for x in places]
            hot = places[0] < 0
            n = len(raw) // 8 - WINDOW + 1
            prefix = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if hot else int(h[spots[0][0]].view(np.int64))
            many = len(spots) > 1
            for nth, (i, w) in enumerate(spots):
                if many or nth == 0:
                    t = int(text[i])
                    if nth == 0:
                        add(prefix, block, t, w - int(base[t]), n, many, raw)
                    if many:
                        add(prefix, block, t, w - int(base[t]), n, many, None)
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))})


def _ranks(codes: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words from each place of codes, ranks that are equal where the words are and in their order; places of one row.

    A text that ends sooner comes before all that go on.
    """
    ends = np.searchsorted(row, row, side="right")
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    width, longest = 1, int(np.bincount(row).max(initial=0)) if len(row) else 0
    place = np.arange(len(codes))
    while width < longest:
        last = ranks[-1]
        after = np.where(place + width < ends, last[np.minimum(place + width, len(codes) - 1)] + 1, 0)
        ranks.append(np.unique(last * (len(codes) + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return ranks


def subtree(group: np.ndarray, codes: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth): the suffixes at starts by group and words, and for each the words that it shares with the one before it.

    depth is the depth of the internal node between two neighbours, 0 at the beginning of a group. row: of each word.
    """
    ranks = _ranks(codes, row)
    ends = np.searchsorted(row, row, side="right")
    order = np.lexsort((ranks[-1][starts], group))
    at, group = starts[order], group[order]
    a, b = at[:-1].copy(), at[1:].copy()
    room = np.minimum(ends[a] - a, ends[b] - b) if len(a) else a
    depth = np.zeros(len(a), np.int64)
    most = len(codes) - 1
    for k in range(len(ranks) - 1, -1, -1):
        fits = depth + (1 << k) <= room
        same = fits & (ranks[k][np.minimum(a + depth, most)] == ranks[k][np.minimum(b + depth, most)])
        depth[same] += 1 << k
    # a rank of a text's end may stand for fewer words than its width: what is left is counted one by one
    while len(depth):
        more = (depth < room) & (ranks[0][np.minimum(a + depth, most)] == ranks[0][np.minimum(b + depth, most)])
        if not more.any():
            break
        depth[more] += 1
    depth[group[1:] != group[:-1]] = 0
    return order, np.concatenate([[0], depth])


def deep_nodes(order: np.ndarray, depth: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, depth) of the topmost internal nodes at least window words deep: ranges of order, and the words of their repeats."""
    deep = depth >= window
    begin = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]]))
    stop = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]]))
    least = np.minimum.reduceat(np.where(deep, depth, np.iinfo(np.int64).max), begin) if len(begin) else begin
    return begin - 1, stop, least


_MARKS = "block long, doc int, start int, stop int"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the subtrees of a partition whose rows are sorted by prefix; gives the ranges of windows that occur again."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ranges(block, doc, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((block, doc, start, stop), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["block", "doc", "start", "stop"])

    def solve(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        number = table.column("n").to_numpy()
        raw = _plain(table, "codes")
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False) // 8
        codes = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(number)), number)
        inner = ragged(np.zeros(len(number), np.int64), number)
        starts = (np.cumsum(size) - size)[row] + inner
        order, depth = subtree(table.column("prefix").to_numpy()[row], codes, np.repeat(np.arange(len(size)), size), starts)
        first, last, _ = deep_nodes(order, depth)
        deep = table.column("multi").to_numpy(zero_copy_only=False)[row]  # a text that one block has twice
        deep[order[ragged(first, last - first + 1)]] = True
        at = np.flatnonzero(deep)
        gap = np.ones(len(at), bool)
        gap[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
        begin, end = at[gap], at[np.append(gap[1:], True)[: len(at)]] if len(at) else at
        own = row[begin]
        place = table.column("start").to_numpy()
        whole = np.bincount(row, weights=deep, minlength=len(number)) == number
        return ranges(table.column("block").to_numpy()[own], table.column("doc").to_numpy()[own], place[own] + inner[begin], place[own] + inner[end] + 1), whole

    for batch in batches:
        done = batch.filter(pc.is_null(batch.column("codes")))
        if done.num_rows:
            start = done.column("start").to_numpy()
            yield ranges(done.column("block").to_numpy(), done.column("doc").to_numpy(), start, start + done.column("n").to_numpy())
        batch = batch.filter(pc.is_valid(batch.column("codes")))
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < GROUP_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        prefix = table.column("prefix").to_numpy()
        cut = int(np.flatnonzero(prefix == prefix[-1])[0])
        if cut:
            yield solve(table.slice(0, cut))[0]
            rest = table.slice(cut)
        else:  # one prefix: places wholly found to occur again leave one row for each text
            marks, whole = solve(table)
            yield marks
            first = np.zeros(len(prefix), bool)
            first[list({c: k for k, c in reversed(list(enumerate(table.column("codes").to_pylist())))}.values())] = True
            multi = table.column("multi").to_numpy(zero_copy_only=False) | whole
            rest = table.set_column(table.schema.get_field_index("multi"), "multi", pa.array(multi)).filter(pa.array(~whole | first))
        held, rows = rest.combine_chunks().to_batches(), (rest.num_rows if cut else 0)
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())[0]


def _kept(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Each document's words without those under marked windows."""
    docs = _sorted_docs(docs)
    doc, start, stop = (marks.column(c).to_numpy() for c in ("doc", "start", "stop"))
    order = np.argsort(doc, kind="stable")
    doc, start, stop = doc[order], start[order], stop[order]
    at = np.searchsorted(doc, np.arange(docs.num_rows + 1))
    total, gone, kept = [], [], []
    for k, t in enumerate(docs.column("text").to_pylist()):
        words = (t or "").encode().split()
        total.append(len(words))
        a, b = at[k], at[k + 1]
        if a < b:
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start[a:b], 1)
            np.add.at(cover, np.minimum(stop[a:b] + WINDOW - 1, len(words)), -1)
            stay = np.cumsum(cover)[:-1] == 0
            words = list(compress(words, stay.tolist()))
        gone.append(total[-1] - len(words))
        kept.append(b" ".join(words).decode())
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})


def drop_repeats(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text that stays, or its SHA-256 if digest is set."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    slim = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.select("block", "text").mapInArrow(_block_rows, "block long, h long, n long")
    again = found.withColumn("total", F.sum("n").over(Window.partitionBy("h"))).where("total > 1").select("block", "h", "total")
    rows = slim.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_suffixes, _SUFFIX)
    marks = rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_marks, _MARKS)

    def last(d: pa.Table, m: pa.Table) -> pa.Table:
        out = _kept(d, m)
        if digest:
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in out.column("kept").to_pylist()]
            out = out.set_column(3, "kept", pa.array(sha, pa.string()))
        return out

    return slim.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(last, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i : i + 34], ' ')) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM k WHERE n > 1),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
r AS (SELECT p.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE gone.p IS NULL) AS kept
      FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
