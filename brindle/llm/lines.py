"""Operator 6. Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines within TAU edits of each other (insertions, deletions, substitutions of code points) are near-duplicates. Each
distinct line of MIN_CHARS or more is split into TAU + 1 even segments, which are indexed by their number, the line's
length and their text; if two lines are that near, one segment of the shorter line stands unchanged in the longer one, at
a place that the multi-match-aware selection of Li et al. (2011) narrows to a few substrings a length. Lines that meet are
verified by a banded bit-parallel edit distance (Hyyro, 2003) whose state, the band's vertical differences and the
distance, is packed in one long and folded over the characters. Near-duplicates and their chains form classes; of each
class the first line by (doc_id, line number) stays.

Defined results: a null text counts as empty and has one blank line; blank lines (white space only) are never removed;
shorter lines are removed only if another is equal; rows that repeat a doc_id are handled alike, so where one keeps its
line the other does; a null doc_id comes after all others; an empty table gives none; very long lines are compared whole;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, connected_components, documents, shared_dir, staged

TAU, MIN_CHARS = 2, 24


def segment(i: Column, length: Column, tau: int) -> tuple[Column, Column]:
    """(start from 1, length) of the i-th of tau + 1 even segments; the last ones take what is over."""
    base = F.floor(length / (tau + 1)).cast("int")
    short = tau + 1 - (length - base * (tau + 1))
    start = base * (i - 1) + F.greatest(F.lit(0), i - 1 - short) + 1
    return start, base + F.when(i > short, 1).otherwise(0)


def index_places(tau: int) -> list[tuple[int, int, int]]:
    """(segment, 0, 0) for each segment, under which a line is indexed."""
    return [(i, 0, 0) for i in range(1, tau + 2)]


def probe_places(tau: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the indexed line is, shift): where a line may hold a segment of lines of len - tau .. len."""
    shifts = lambda i, delta: range(max(1 - i, delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1)
    return [(i, delta, shift) for delta in range(tau + 1) for i in range(1, tau + 2) for shift in shifts(i, delta)]


def keyed(each: DataFrame, places: list[tuple[int, int, int]], tau: int) -> DataFrame:
    """(h, k): the keys of each line's substrings at places, those outside the line left out.

    Only constants are exploded, and keys made of the rows that come out: Spark interprets what stands in a generator, and
    compiles what comes after it.
    """
    at = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("i", "delta", "shift"), p))) for p in places)))
    rows = each.select("h", "line", "len", at.alias("at")).select("h", "line", "len", "at.*")
    length = F.col("len") - F.col("delta")
    start, size = segment(F.col("i"), length, tau)
    start = start + F.col("shift")
    sound = (start >= 1) & (start + size - 1 <= F.col("len"))
    return rows.where(sound).select("h", F.xxhash64("i", length, F.col("line").substr(start, size)).alias("k"))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas are evaluated as they stand, without shared subexpressions."""
    return F.get(F.transform(F.array(value), use), 0)


def _common_prefix(x: Column, y: Column, most: Column) -> Column:
    """Code points that x and y begin with alike, most at most: by halving, so that whole prefixes are compared, not characters."""

    def half(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"] + 1, 1)
        same = F.left(x, mid) == F.left(y, mid)
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid - 1).alias("high")))

    steps = F.sequence(F.lit(0), F.length(F.bin(most.cast("long"))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.cast("int").alias("high")), half)["low"]


def _middles(x: Column, y: Column, use) -> Column:
    """use(struct of x and y) without the beginning and the end that both share, which change no distance."""

    def cut(p: Column, q: Column, then) -> Column:
        most = F.least(F.length(p), F.length(q))
        return _bound(_common_prefix(p, q, most), lambda n: then(F.substr(p, n + 1), F.substr(q, n + 1)))

    turned = lambda p, q: F.struct(F.reverse(p).alias("x"), F.reverse(q).alias("y"))
    front = cut(x, y, turned)
    return _bound(front, lambda s: _bound(cut(s["x"], s["y"], turned), use))


def edit_distance(x: Column, y: Column, tau: int) -> Column:
    """The distance of two strings whose lengths differ by tau at most, if it is tau or less; else some greater number.

    Shared ends are cut off first. Then a band of 2 tau + 1 bits slides down the diagonal of the table, x along its rows; bit
    k of column j is row j - tau + k. VP and VN hold where a cell is one more or one less than the cell above it. Once no
    cell of the band is tau or less, none to its right is, and the columns that are left are passed over.
    """
    width = 2 * tau + 1
    ones, top = (1 << width) - 1, width - 1
    shift = 8 * ((width + 7) // 8)
    start = (1 << width) - (1 << tau)

    def fold(s: Column) -> Column:
        """s: the characters a of x, those of y, and the length m of x."""

        def step(state: Column, j: Column) -> Column:
            char = F.get(s["b"], j - 1)
            eq = sum((F.when(F.get(s["a"], j - tau + k - 1) == char, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0)).cast("long")
            vp, vn, dist = state.bitwiseAND(F.lit(ones)), F.shiftright(state, shift).bitwiseAND(F.lit(ones)), F.shiftright(state, 2 * shift)

            def column(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.lit(ones) - d0.bitwiseOR(vp))
                hn = d0.bitwiseAND(vp)
                x0 = F.shiftright(d0, 1)
                new_vp, new_vn = hn.bitwiseOR(F.lit(ones) - x0.bitwiseOR(hp)), x0.bitwiseAND(hp)
                low = F.greatest(F.lit(0), F.lit(top) - (j - (s["m"] - tau)))  # the bit of the last row once the band reaches it
                bit = lambda v: F.call_function("shiftright", v, low).bitwiseAND(F.lit(1))
                down = F.lit(1) - F.shiftright(d0, top).bitwiseAND(F.lit(1))
                moved = dist + F.when(j <= s["m"] - tau, down).otherwise(bit(hp) - bit(hn))
                return new_vp + F.shiftleft(new_vn, shift) + F.shiftleft(moved, 2 * shift)

            d0 = lambda e: ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(ones))
            return F.when(dist - F.bit_count(vp) > tau, state).otherwise(_bound(_bound(eq, d0), column))

        first = F.lit(start) + F.shiftleft(F.least(s["m"], F.lit(tau)).cast("long"), 2 * shift)  # the band's lowest row, or the last one
        return F.shiftright(F.aggregate(F.sequence(F.lit(1), F.size(s["b"])), first, step), 2 * shift)

    def split(s: Column) -> Column:
        parts = F.struct(F.split(s["x"], "").alias("a"), F.split(s["y"], "").alias("b"), F.length(s["x"]).alias("m"))
        gone = F.greatest(F.length(s["x"]), F.length(s["y"]))
        return F.when(F.least(F.length(s["x"]), F.length(s["y"])) == 0, gone.cast("long")).otherwise(_bound(parts, fold))

    return _middles(x, y, split)


def digest(line: Column) -> Column:
    """16 bytes that stand for a line."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    held = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), lines)
    short = F.octet_length(F.ltrim("line", F.lit(" \t\n\v\f\r"))) <= 3  # few lines need the expression: `$` lets one line terminator follow
    return held.withColumn("key", digest(F.col("line"))).withColumn("blank", short & F.col("line").rlike(f"^{WHITESPACE}*$"))


def placed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, key) of each line of each row of docs, equal lines together; a blank line has a key of its own.

    All who read it need all its columns, so that Spark makes it once.
    """
    rows = exploded(docs.withColumn("row", F.monotonically_increasing_id()), "row")
    own = F.encode(F.concat_ws(":", "row", "line_no"), "utf-8")
    return rows.select("row", "doc_id", "line_no", F.when(F.col("blank"), own).otherwise(F.col("key")).alias("key")).repartition("key")


def edit_pairs(lines: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(x, y) for all pairs of different texts in column line, of min_chars or more, within tau edits.

    Texts cross the network once, to a partition by their hash h, where equal ones become one; rows of the segment join
    hold h alone, and the few candidates come back to the same partitions for their texts. Different texts of one hash
    stay apart.
    """
    long = lines.where(F.length("line") >= max(min_chars, tau + 1)).select("line", F.xxhash64("line").alias("h"))
    each = long.repartition("h").distinct().withColumn("len", F.length("line"))
    index, probe = keyed(each, index_places(tau), tau), keyed(each, probe_places(tau), tau).withColumnRenamed("h", "h2")
    met = index.join(probe, "k").where("h <> h2").select(F.least("h", "h2").alias("h1"), F.greatest("h", "h2").alias("h2")).distinct()
    met = met.union(each.groupBy("h").count().where("count > 1").select(F.col("h").alias("h1"), F.col("h").alias("h2")))
    side = lambda k: F.struct(F.col(f"h{k}").alias("h"), F.lit(k).alias("side"))
    ends = met.select("h1", "h2", F.explode(F.array(side(1), side(2))).alias("end")).select("h1", "h2", "end.h", "end.side")
    texts = ends.join(each.select("h", "line"), "h")
    found = texts.groupBy("h1", "h2").agg(*(F.collect_list(F.when(F.col("side") == k, F.col("line"))).alias(f"s{k}") for k in (1, 2)))
    pairs = found.select("h1", "h2", F.explode("s1").alias("x"), "s2").select("h1", "h2", "x", F.explode("s2").alias("y"))
    pairs = pairs.where("(h1 <> h2 or x < y) and abs(length(x) - length(y)) <= %d" % tau)
    return pairs.where(edit_distance(F.col("x"), F.col("y"), tau) <= tau).select("x", "y")


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, first_doc, first_line, near): for each key of placed where its class first occurs, and whether that holds other texts."""
    shared_dir(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no", "row")
    found = placed(docs).groupBy("key").agg(F.min(place).alias("place"))
    links = edit_pairs(exploded(docs).where(~F.col("blank")), tau, min_chars).select(digest(F.col("x")).alias("a"), digest(F.col("y")).alias("b")).checkpoint()
    nodes = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "lines")
    edges = links.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    classes = nodes.join(connected_components(edges), "node").select("key", "component")
    near = found.join(classes, "key").groupBy("component").agg(F.min("place").alias("first"))
    found = found.join(classes.join(near, "component").select("key", "first"), "key", "left")
    first = F.coalesce("first", "place")
    return found.select("key", first["doc_id"].alias("first_doc"), first["line_no"].alias("first_line"), F.col("first").isNotNull().alias("near"))


def marked_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, doc_id, line_no, removed, near), a row for each line of each row of docs."""
    joined = placed(docs).join(line_classes(docs, tau, min_chars), "key")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    return joined.select("row", "doc_id", "line_no", (~stays).alias("removed"), "near")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: lines, those with a near but unequal line, those removed, and the numbers of the removed ones."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    gone = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    by = marked_lines(documents(spark, sf_dir).select("doc_id", "text")).groupBy("row", "doc_id")
    by = by.agg(F.count("*").alias("n_lines"), count("near").alias("n_near"), count("removed").alias("n_removed"), gone.alias("gone"))
    return by.select("doc_id", "n_lines", "n_near", "n_removed", F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed_lines"))


def drop_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) without the removed lines."""
    rows = exploded(docs.withColumn("row", F.monotonically_increasing_id()), "row")
    joined = rows.join(line_classes(docs, tau, min_chars), "key", "left")
    stays = F.col("blank") | (F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))
    kept = F.array_sort(F.collect_list(F.when(stays, F.struct("line_no", "line"))))
    return joined.groupBy("row", "doc_id").agg(kept.alias("kept")).select("doc_id", F.array_join(F.col("kept.line"), "\n").alias("text"))
