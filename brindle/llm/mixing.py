"""Operator 4. Mixing sources to target weights by Poisson replication.

Each document's count is drawn from a Poisson distribution by inverting it at a uniform number hashed from the seed and
the doc_id. Its mean is the source's target repetition rate: the target share of the output over the source's share of
the input, both in code points, times the wanted size. Documents are exploded by their counts, and a second hash of seed,
doc_id and copy number places each copy: its leading bits name the partition, so the global shuffle needs no sampling
pass, and each partition is sorted by it.

Defined results: sources without a weight of their own (null too) form one class that takes REST; a class without text
gets rate zero; a null text counts as empty but is replicated as any; a null doc_id hashes as empty text, so such rows
share a draw, as do rows that repeat an id; an empty table gives none. The columns of docs, whatever their names, pass
through in a struct of their own. A rare source may need many copies of a row: they are exploded in ranges of SPLIT,
which are spread over all tasks first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


@dataclass(frozen=True)
class Mix:
    """weights: by source, together at most 1; the rest goes to all other sources as one class. size: wanted output over input."""

    weights: dict[str, float] = field(default_factory=lambda: {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05})
    size: float = 1.0
    seed: int = 17


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1); every engine has this hash."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Copies of a row that one task writes at once.
SPLIT = 1024


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """A count that no 52-bit uniform number falls short of, and the distribution function there and on, as far as one can lie above it.

    Their number grows with the square root of the mean.
    """
    least = max(0, math.floor(mean - 9 * math.sqrt(mean) - 60))
    steps, total, k = [], 0.0, least
    while mean > 0 and (k <= mean or 1 - total > 2.0**-52) and k < mean + 60 + 20 * math.sqrt(mean):
        total = min(1.0, total + math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)))
        steps.append(total)
        k += 1
    return least, steps


def rates(docs: DataFrame, mix: Mix) -> dict[str | None, float]:
    """The mean count of each listed source, and of all others under None. What comes to the driver is as long as the list."""
    name = F.when(F.col("source").isin(list(mix.weights)), F.col("source"))
    size = {r[0]: r[1] for r in docs.groupBy(name.alias("s")).agg(F.sum(F.length("text"))).collect()}
    total = sum(x or 0 for x in size.values())
    share = {**mix.weights, None: 1 - sum(mix.weights.values())}
    return {s: max(0.0, w) * mix.size * total / size[s] if size.get(s) else 0.0 for s, w in share.items()}


def mixed(docs: DataFrame, mix: Mix = Mix(), partitions: int | None = None) -> DataFrame:
    """(row, copy, rate, key): the rows of docs, replicated to the target weights, in an order shuffled over all partitions; copy counts from 0."""
    if any(w < 0 for w in mix.weights.values()) or sum(mix.weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be 0 or more and sum to 1 at most")
    mean = rates(docs, mix)
    table = {s: poisson_steps(m) for s, m in mean.items()}
    known = [s for s in mix.weights]

    def by_class(value) -> Column:
        out = value(None)
        for s in known:
            out = F.when(docs["source"].eqNullSafe(F.lit(s)), value(s)).otherwise(out)
        return out

    steps = by_class(lambda s: F.array(*map(F.lit, table[s][1])).cast("array<double>"))
    drawn = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), steps.alias("steps"), by_class(lambda s: F.lit(table[s][0])).alias("least"), by_class(lambda s: F.lit(mean[s])).alias("rate"), uniform(F.lit(mix.seed), docs["doc_id"]).alias("u"))
    drawn = drawn.select("row", "id", "rate", (F.col("least") + F.size(F.filter("steps", lambda c: c <= F.col("u")))).alias("n")).where("n > 0").withColumn("begin", F.lit(0))
    if max(least + len(found) for least, found in table.values()) > SPLIT:
        drawn = drawn.withColumn("begin", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SPLIT)))).repartition(F.xxhash64("id", "begin"))
    copies = drawn.select("row", "id", "rate", F.explode(F.sequence("begin", F.least(F.col("begin") + SPLIT, F.col("n")) - 1)).alias("copy"))
    copies = copies.select("row", "copy", "rate", uniform(F.lit(mix.seed + 1), F.col("id"), F.col("copy")).alias("key"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionById(n, F.floor(F.col("key") * n).cast("int")).sortWithinPartitions("key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("row.doc_id", "row.source", "row.text", F.col("copy").cast("long").alias("copy"), F.col("key").alias("shuffle_key"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """The replicated rows of docs, with its columns."""
    return mixed(docs).select("row.*")


OP4_SQL = """
WITH w(source, weight) AS (VALUES ('src0', 0.20), ('src1', 0.10), ('src2', 0.10), ('src3', 0.05), (NULL, 1 - (0.20 + 0.10 + 0.10 + 0.05))),
d AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source END AS class,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
size AS (SELECT class, sum(length(text))::DOUBLE AS n FROM d GROUP BY class),
rate AS (SELECT size.class, weight::DOUBLE * (SELECT sum(n) FROM size) / n AS mean FROM size JOIN w ON size.class IS NOT DISTINCT FROM w.source),
step AS (SELECT class, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1.0))) OVER (PARTITION BY class ORDER BY k) AS cdf
         FROM (SELECT class, mean, unnest(range(greatest(0, floor(mean - 9 * sqrt(mean) - 60))::BIGINT, ceil(mean + 60 + 20 * sqrt(mean))::BIGINT)) AS k FROM rate)),
copies AS (SELECT d.doc_id, d.source, d.text, step.k AS copy FROM d JOIN step ON d.class IS NOT DISTINCT FROM step.class AND step.cdf <= d.u
           UNION ALL SELECT d.doc_id, d.source, d.text, unnest(range(0, greatest(0, floor(mean - 9 * sqrt(mean) - 60))::BIGINT)) FROM d JOIN rate ON d.class IS NOT DISTINCT FROM rate.class)
SELECT doc_id, source, text, copy::BIGINT AS copy,
       ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""
