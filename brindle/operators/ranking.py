"""Order, vector neighbours, rank fusion and scoring profiles."""

from __future__ import annotations

import math
import re
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.analysis import normalizer
from ..plans.schema import Index, RequestError

MAX_CLAUSES, RRF_K, TEXT_RECALL = 32, 60, 1000


def clauses(text: str) -> list[str]:
    """Split at commas outside of parentheses and quotes."""
    return [c.strip() for c in re.findall(r"(?:[^,(']|\((?:[^()']|'[^']*'|\([^()]*\))*\)|'[^']*')+", text) if c.strip()]


def order_columns(index: Index, text: str | None, tie: str, scored: bool = True) -> list[Column]:
    """Sort columns, the tie breaker last. Strings put nulls first; other nulls sort as 0; points without a place are farthest."""
    out = []
    parts = clauses(text or "")
    if len(parts) > MAX_CLAUSES:
        raise RequestError("too many order clauses")
    for part in parts:
        m = re.fullmatch(r"(.*?)(?:\s+(\w+))?", part)
        body, way = (m[1], (m[2] or "").lower())
        down = way == "desc"
        if body.startswith("search.score("):
            if not re.fullmatch(r"search\.score\(\s*\)", body):
                raise RequestError("search.score takes no arguments")
            if not scored:
                raise RequestError("vector results can't be ordered by search.score()")
            out.append(F.col("score").asc() if way == "asc" else F.col("score").desc())
            continue
        g = re.fullmatch(r"geo\.distance\(\s*(?:([\w/]+)\s*,\s*geography'([^']*)'|geography'([^']*)'\s*,\s*([\w/]+))\s*\)", body)
        if g:
            path = index.need(g[1] or g[4])
            if not path.leaf.can_sort() or path.many:
                raise RequestError(f"{path.name} is not sortable")
            column = geo.distance_km(path.column(), *geo.parse_point(g[2] or g[3]))
            out.append(column.desc_nulls_first() if down else column.asc_nulls_last())
            continue
        path = index.need(body)
        if path.many or not path.leaf.can_sort() or path.leaf.item == "Edm.GeographyPoint":
            raise RequestError(f"{body} is not sortable")
        column = path.column()
        if path.leaf.item == "Edm.String":
            column = normalizer(path.leaf.normalizer)(column) if path.leaf.normalizer else column
            out.append(column.desc_nulls_last() if down else column.asc_nulls_first())
            continue
        zero = {"Edm.Boolean": F.lit(False), "Edm.DateTimeOffset": F.lit(datetime(1970, 1, 1)).cast("timestamp")}.get(path.leaf.item, F.lit(0))
        column = F.coalesce(column.cast("timestamp") if path.leaf.item == "Edm.DateTimeOffset" else column, zero)
        out.append(column.desc() if down else column.asc())
    if not parts:
        out.append(F.col("score").desc())
    return [*out, F.col(tie).asc()]


def similarity(column: Column, query: list[float], metric: str) -> Column:
    """cosine, dotProduct or euclidean in double precision, folded over the array in the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    total = lambda f: F.aggregate(F.zip_with(column, q, f), F.lit(0.0), lambda a, x: a + x)
    if metric == "euclidean":
        return F.sqrt(total(lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)))
    dot = total(lambda a, b: a.cast("double") * b)
    if metric == "dotProduct":
        return dot
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.when((norm > 0) & F.lit(length > 0), dot / (norm * F.lit(length or 1.0))).otherwise(F.lit(0.0))


def vector_score(value: Column, metric: str) -> Column:
    if metric == "dotProduct":
        score = F.lit(0.5) * (F.lit(1.0) + value / (F.lit(1.0) + F.abs(value)))
    else:
        score = F.lit(1.0) / (F.lit(1.0) + (F.lit(1.0) - value if metric == "cosine" else value))
    return F.when(F.isnan(score), 0.0).otherwise(F.least(F.lit(1.0), score))


def nearest(df: DataFrame, field, query: list[float], k: int, tie: str) -> DataFrame:
    """The k best rows by score, ties by the tie breaker: a heap in each partition, then one of their results."""
    if k < 1:
        raise RequestError("k is 1 or more")
    if field.dimensions and len(query) != field.dimensions:
        raise RequestError(f"{field.name} has {field.dimensions} dimensions")
    column = F.col(f"`{field.name}`")
    score = vector_score(similarity(column, query, field.metric), field.metric)
    return df.where(column.isNotNull()).withColumn("score", score).orderBy(F.desc("score"), F.asc(tie)).limit(k)


def fuse(arms: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, score) by reciprocal ranks. arms: (key, score, _seq), each cut to its recall already, and a weight.

    Terms and sums are single precision, added in the order of the arms; each window ranks one short list.
    """
    ranked = []
    for number, (arm, weight) in enumerate(arms):
        rank = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("_seq")))
        term = (F.lit(float(np.float32(weight))) / (F.lit(RRF_K) + rank)).cast("float")
        ranked.append(arm.select(F.col(key), F.col("_seq"), F.lit(number).alias("arm"), term.alias("term")))
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    terms = F.transform(F.array_sort(F.collect_list(F.struct("arm", "term"))), lambda x: x.getField("term"))
    total = F.aggregate(terms, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))
    return every.groupBy(key).agg(F.min("_seq").alias("_seq"), total.alias("score"))


def interpolate(t: Column, how: str, boost: float) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    rest = {"constant": F.lit(1.0), "linear": 1 - t, "quadratic": 1 - t * t, "logarithmic": 1 - F.log(1 + F.lit(math.e - 1) * t)}[how]
    return 1 + F.lit(boost - 1) * rest


_DURATION = re.compile(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def duration_ms(text: str) -> float:
    m = _DURATION.fullmatch(text)
    if not m or not any(m.groups()[1:]):
        raise RequestError(f"not a duration: {text}")
    y, mo, d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    d += 365 * y + 30 * mo
    return (-1 if m[1] else 1) * (((d * 24 + h) * 60 + mi) * 60 + s) * 1000


def function_boost(index: Index, f: dict, parameters: dict[str, str], now: datetime) -> Column:
    """The boost of one scoring function, null where it doesn't apply."""
    path, boost, how = index.need(f["fieldName"]), float(f["boost"]), f.get("interpolation", "linear")
    column, kind = path.column(), f["type"]
    many = path.many or path.leaf.collection
    if kind == "magnitude":
        m = f["magnitude"]
        start, end = float(m["boostingRangeStart"]), float(m["boostingRangeEnd"])
        value = F.array_max(column) if many else column
        t = (value - start) / (end - start)
        beyond = interpolate(F.lit(1.0), how, boost) if m.get("constantBoostBeyondRange") else F.lit(None)
        return F.when(t > 1, beyond).when(t.isNotNull(), interpolate(t, how, boost))
    if kind == "freshness":
        span = duration_ms(f["freshness"]["boostingDuration"])
        age = F.lit(now.timestamp() * 1000) - F.unix_millis(column.cast("timestamp"))
        t = age / F.lit(span)
        return F.when((t >= 0) & (t <= 1), interpolate(t, how, boost))
    if kind == "distance":
        d = f["distance"]
        if d["referencePointParameter"] not in parameters:
            raise RequestError(f"missing parameter {d['referencePointParameter']}")
        lon, lat = (float(x) for x in parameters[d["referencePointParameter"]].split(","))
        km = F.array_min(F.transform(column, lambda p: geo.distance_km(p, lon, lat))) if many else geo.distance_km(column, lon, lat)
        t = km / float(d["boostingDistance"])
        return F.when(t <= 1, interpolate(t, how, boost))
    if kind == "tag":
        name = f["tag"]["tagsParameter"]
        if name not in parameters:
            raise RequestError(f"missing parameter {name}")
        tags = parameters[name].split(",")
        held = column if many else F.array(column)
        n = F.aggregate(F.array(*map(F.lit, tags)), F.lit(0), lambda a, t: a + F.when(F.array_contains(held, t), 1).otherwise(0))
        return F.when(n > 0, interpolate(1 - F.least(n, F.lit(len(tags))) / len(tags), how, boost))
    raise RequestError(f"unknown scoring function {kind}")


def profile_multiplier(index: Index, profile: dict, parameters: dict[str, str], now: datetime) -> Column:
    boosts = F.array_compact(F.array(*(function_boost(index, f, parameters, now).cast("double") for f in profile.get("functions", ()))))
    if not profile.get("functions"):
        return F.lit(1.0)
    add = F.aggregate(boosts, F.lit(0.0), lambda a, x: a + x)
    how = profile.get("functionAggregation", "sum")
    total = {"sum": add, "average": add / F.size(boosts), "minimum": F.array_min(boosts), "maximum": F.array_max(boosts), "firstMatching": F.get(boosts, F.lit(0)), "product": F.aggregate(boosts, F.lit(1.0), lambda a, x: a * x)}[how]
    return F.when(F.size(boosts) == 0, 1.0).otherwise(total)


def applied(score: Column, multiplier: Column) -> Column:
    """The score under a profile, in single precision; what is not finite becomes the largest number."""
    most = float(np.finfo(np.float32).max)
    product = score * multiplier
    return F.when(F.isnan(product) | (F.abs(product) > most), F.lit(most)).otherwise(product).cast("float").cast("double")


def parse_parameters(values: list[str]) -> dict[str, str]:
    out = {}
    for v in values:
        name, dash, rest = v.partition("-")
        if not dash:
            raise RequestError(f"bad scoring parameter {v}")
        out[name] = rest
    return out
