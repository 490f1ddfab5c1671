"""One search request as DataFrames: the match set, its page, count and facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facets as fc
from ..operators import ranking
from ..operators.text import TextQuery, completions, fragments, marked_suggestion, parse_full, parse_simple, query_plus_text, suggest_match
from .odata import Compiler
from .schema import Field, Index, RequestError


@dataclass
class Vector:
    values: list[float]
    fields: tuple[str, ...]
    k: int = 50
    weight: float = 1.0


@dataclass
class Request:
    search: str | None = None
    filter: str | None = None
    orderby: str | None = None
    select: str | None = None
    facets: tuple[str, ...] = ()
    skip: int = 0
    top: int = 50
    mode: str = "any"
    syntax: str = "simple"
    search_fields: tuple[str, ...] | None = None
    profile: str | None = None
    parameters: tuple[str, ...] = ()
    vectors: tuple[Vector, ...] = ()
    post_filter: bool = False
    highlight: tuple[str, ...] = ()
    before: str = "<em>"
    after: str = "</em>"
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def projection(index: Index, select: str | None) -> list[Column]:
    """The selected fields, sub-fields narrowed, in the schema's order; fields that are not retrievable never come."""
    wanted = [w.strip() for w in (select or "").split(",") if w.strip()]
    paths = None if not wanted or "*" in wanted else [[f.name for f in index.need(w).fields] for w in wanted]

    def pick(f: Field, at: Column, paths: list[list[str]] | None) -> Column | None:
        if not f.retrievable:
            return None
        mine = None if paths is None else [p[1:] for p in paths if p[0] == f.name]
        if mine is not None and not mine:
            return None
        mine = None if mine is None or any(not p for p in mine) else mine
        if not f.complex or (mine is None and all(s.retrievable for s in f.fields)):
            return at

        def inner(x: Column) -> Column:
            return F.struct(*(c.alias(s.name) for s in f.fields if (c := pick(s, x.getField(s.name), mine)) is not None))

        return F.transform(at, inner) if f.collection else F.when(at.isNotNull(), inner(at))

    return [c.alias(f.name) for f in index.fields if (c := pick(f, F.col(f"`{f.name}`"), paths)) is not None]


class Search:
    """df holds the index's fields and _seq, the order of writing, which breaks every tie."""

    def __init__(self, index: Index, df: DataFrame, request: Request, synonyms: dict | None = None):
        if not 0 <= request.top <= 1000 or not 0 <= request.skip <= 100_000:
            raise RequestError("top is 0 to 1000 and skip 0 to 100,000")
        if request.mode not in ("any", "all") or request.syntax not in ("simple", "full"):
            raise RequestError("the mode is any or all, the syntax simple or full")
        self.index, self.df, self.request, self.synonyms = index, df, request, synonyms or {}
        self.facets = list({f.path.name: f for f in (fc.parse_facet(index, t) for t in request.facets)}.values())
        self.profile = None
        name = request.profile or index.default_profile
        if name:
            self.profile = next((p for n, p in index.profiles.items() if n.lower() == name.lower()), None)
            if self.profile is None:
                raise RequestError(f"unknown scoring profile {name}")

    def _ismatch(self, query: str, fields: str | None = None, syntax: str = "simple", mode: str = "any") -> Column:
        names = [f.strip() for f in fields.split(",")] if fields else None
        full = syntax == "full"
        return TextQuery(self.index, names, self.synonyms, full=full).match((parse_full if full else parse_simple)(query, mode == "all"))

    def filtered(self, df: DataFrame) -> DataFrame:
        return df.where(Compiler(self.index, self._ismatch).filter(self.request.filter)) if self.request.filter else df

    def _text(self, df: DataFrame) -> DataFrame:
        r = self.request
        if r.search in (None, "", "*", "*:*"):
            return df.withColumn("score", self._profiled(F.lit(1.0)))
        full = r.syntax == "full"
        query = TextQuery(self.index, list(r.search_fields) if r.search_fields else None, self.synonyms, (self.profile or {}).get("weights"), full)
        node = (parse_full if full else parse_simple)(r.search, r.mode == "all")
        return df.where(query.match(node)).withColumn("score", self._profiled(query.score(self.df, node, self.index.similarity)))

    def _profiled(self, score: Column) -> Column:
        if not (self.profile or {}).get("functions"):
            return score
        parameters = ranking.parse_parameters(list(self.request.parameters))
        return ranking.applied(score, ranking.profile_multiplier(self.index, self.profile, parameters, self.request.now))

    def match(self) -> DataFrame:
        """All matching rows with their score."""
        r = self.request
        if not r.vectors:
            return self._text(self.filtered(self.df))
        base = self.df if r.post_filter else self.filtered(self.df)
        arms, metrics = [], set()
        for v in r.vectors:
            if v.weight <= 0:
                raise RequestError("a weight is above 0")
            names = v.fields or tuple(f.name for f in self.index.fields if f.vector)
            for name in names:
                f = self.index.need(name).leaf
                if not f.vector:
                    raise RequestError(f"{name} holds no vectors")
                metrics.add(f.metric)
                arms.append((ranking.nearest(base, f, v.values, v.k, "_seq"), v.weight))
        if len(metrics) > 1:
            raise RequestError("the vector fields of a request have one metric")
        hybrid = r.search not in (None, "", "*", "*:*")
        if not hybrid and len(arms) == 1:
            return self.filtered(arms[0][0]) if r.post_filter else arms[0][0]
        if hybrid:
            text = self._text(base).orderBy(F.desc("score"), F.asc("_seq")).limit(ranking.TEXT_RECALL)
            arms.insert(0, (text, 1.0))
        fused = ranking.fuse([(a.select("_seq", "score", self.index.key), w) for a, w in arms], self.index.key)
        hits = self.df.join(F.broadcast(fused.select(F.col("_seq"), F.col("score"))), "_seq")  # no more rows than the arms' k and recall
        return self.filtered(hits) if r.post_filter else hits

    def page(self) -> DataFrame:
        r, marks = self.request, []
        order = ranking.order_columns(self.index, r.orderby, "_seq", not r.vectors)
        words = re_words(r.search)
        for name in r.highlight:
            name, _, most = name.partition("-")
            path = self.index.need(name.strip())
            if not path.leaf.searchable or path.leaf.item != "Edm.String" or (most and not most.isdigit()):
                raise RequestError(f"{name} can't be highlighted")
            marks.append(fragments(path, words, int(most or 5), r.before, r.after).alias(f"highlight_{path.name.replace('/', '_')}"))
        return self.match().orderBy(*order).offset(r.skip).limit(r.top).select(*projection(self.index, r.select), "score", *marks)

    def count(self) -> DataFrame:
        return self.match().agg(F.count("*").alias("count"))

    def facet(self, name: str) -> DataFrame:
        facet = next(f for f in self.facets if f.path.name.lower() == name.lower())
        return fc.facet_counts(self.match(), facet)

    def _sources(self, suggester: str) -> list[Column]:
        """The suggester's source fields as columns, narrowed by the request's search fields."""
        found = next((v for n, v in self.index.suggesters.items() if n.lower() == suggester.lower()), None)
        if found is None:
            raise RequestError(f"unknown suggester {suggester}")
        wanted = {f.lower() for f in self.request.search_fields or ()}
        if wanted - {f.lower() for f in found}:
            raise RequestError("search fields lie among the suggester's")
        return [F.concat_ws(" ", p.column()) if p.many or p.leaf.collection else p.column() for f in found if not wanted or f.lower() in wanted for p in [self.index.need(f)]]

    def suggest(self, suggester: str, text: str, fuzzy: bool = False, top: int = 5, mark: bool = False) -> DataFrame:
        """Matching rows with suggestion: the first source field that holds all terms itself, or with fuzzy the first with a text.

        mark puts the request's tags around what was typed. The request's select narrows the columns.
        """
        columns = self._sources(suggester)
        if not 1 <= top <= 100 or not 1 <= len(text) <= 100:
            raise RequestError("top is 1 to 100, and the text has 1 to 100 characters")
        first = F.coalesce(*(F.when(suggest_match([c], text, fuzzy), c) for c in columns), *(columns if fuzzy else ()))
        found = self.filtered(self.df).where(suggest_match(columns, text, fuzzy)).withColumn("suggestion", first)
        found = found.where("suggestion is not null").withColumn("score", F.lit(1.0))
        found = found.orderBy(*ranking.order_columns(self.index, self.request.orderby, "_seq")).limit(top)
        if mark:
            found = found.withColumn("suggestion", marked_suggestion(F.col("suggestion"), text, self.request.before, self.request.after))
        return found.select(*projection(self.index, self.request.select), "suggestion") if self.request.select else found

    def autocomplete(self, suggester: str, text: str, mode: str = "oneTerm", plus: bool = False) -> DataFrame:
        """(completion, n), and with plus the typed text that ends in it as query_plus_text."""
        if mode not in ("oneTerm", "twoTerms", "oneTermWithContext"):
            raise RequestError(f"unknown mode {mode}")
        found = completions(self.filtered(self.df), F.concat_ws(" \u0001 ", *self._sources(suggester)), text, mode)
        return found.withColumn("query_plus_text", query_plus_text(text, F.col("completion"))) if plus else found


def re_words(search: str | None) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", search or "") or ["\u0000"]
