"""Queries over the test tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, geo
from ..operators import facets, ranking, text, writes
from ..sources.store import Catalog
from . import render
from .schema import Field, Index
from .search import Request, Search, Vector

S, I32, I64, DBL, BOOL, DATE = "Edm.String", "Edm.Int32", "Edm.Int64", "Edm.Double", "Edm.Boolean", "Edm.DateTimeOffset"
PART = Index("part", (Field("p_partkey", I64, key=True), Field("p_name", S, searchable=True), Field("p_brand", S, facetable=True, normalizer="lowercase"), Field("p_type", S, facetable=True), Field("p_size", I32, facetable=True), Field("p_retailprice", DBL, facetable=True), Field("small", I32), Field("secret", S, retrievable=False)), suggesters={"sg": ("p_name",)})
ROOM = (Field("part", I64), Field("qty", DBL, facetable=True), Field("flag", S, facetable=True), Field("mode", S), Field("few", DBL))
ORDERS = Index("orders", (Field("o_orderkey", I64, key=True), Field("o_custkey", I64), Field("o_orderstatus", S, facetable=True), Field("o_totalprice", DBL), Field("o_orderdate", DATE, facetable=True), Field("o_orderpriority", S, facetable=True), Field("lines", "Collection(Edm.ComplexType)", fields=ROOM), Field("flags", "Collection(Edm.String)", facetable=True), Field("quantities", "Collection(Edm.Double)", facetable=True)))
CUSTOMER = Index("customer", (Field("c_custkey", I64, key=True), Field("c_name", S), Field("c_nationkey", I32, facetable=True), Field("c_acctbal", DBL), Field("c_mktsegment", S, facetable=True), Field("place", "Edm.GeographyPoint", sortable=True), Field("Address", "Edm.ComplexType", fields=(Field("Segment", S), Field("Nation", I32)))))
DOCS = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True), Field("lang", S, facetable=True), Field("source", S, facetable=True), Field("n_chars", I64, facetable=True)))
VECTORS = Index("embeddings", (Field("vec_id", I64, key=True), Field("embedding", "Collection(Edm.Single)", dimensions=64), Field("label", I32, facetable=True)))
DOTS = Index("embeddings", (Field("vec_id", I64, key=True), Field("embedding", "Collection(Edm.Single)", dimensions=64, metric="dotProduct"), Field("label", I32)))
FAR = Index("embeddings", (Field("vec_id", I64, key=True), Field("embedding", "Collection(Edm.Single)", dimensions=64, metric="euclidean"), Field("label", I32)))
NOW = datetime(2001, 1, 1, tzinfo=timezone.utc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part(spark: SparkSession, d: str) -> DataFrame:
    small = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return read(spark, d, "part").withColumns({"small": small, "secret": F.col("p_brand"), "_seq": F.col("p_partkey")})


def orders(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("mode"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("few"))
    nested = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    df = read(spark, d, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return df.withColumns({"flags": F.col("lines.flag"), "quantities": F.col("lines.qty"), "_seq": F.col("o_orderkey")})


def customer(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("c_custkey") % 11 != 0, F.struct(((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("c_custkey") * 53 % 1700) / 10.0 - 85).alias("lat")))
    address = F.struct(F.col("c_mktsegment").alias("Segment"), F.col("c_nationkey").alias("Nation"))
    return read(spark, d, "customer").withColumns({"place": place, "Address": address, "_seq": F.col("c_custkey")})


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("_seq", F.col("doc_id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").withColumn("_seq", F.col("vec_id"))


P_SQL = "(SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_size END AS small FROM part)"
C_SQL = "(SELECT *, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 END AS lon, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 53 % 1700) / 10.0::DOUBLE - 85 END AS lat FROM customer)"
KM = "CASE WHEN lat IS NOT NULL THEN (2 * 6371.0087714::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians({1})) / 2), 2) + cos(radians(lat)) * cos(radians({1})) * pow(sin((radians(lon) - radians({0})) / 2), 2))))) END"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    r = Request(filter="p_size gt 10 and p_brand ne 'Brand#1'", orderby="p_retailprice desc", facets=("p_type,sort:-count",), top=10)
    return Search(PART, part(spark, d), r).page()


def filters(table: str, index: Index, source, key: str, cases: dict[str, tuple[str, str]]) -> None:
    """One query for each case: the keys that a filter leaves, against a WHERE clause."""
    for name, (odata, where) in cases.items():
        def run(spark: SparkSession, d: str, odata: str = odata) -> DataFrame:
            return Search(index, source(spark, d), Request(filter=odata)).match().select(key)

        register(name, f"SELECT {key} FROM {table} WHERE {where}")(run)


filters(P_SQL, PART, part, "p_partkey", {
    "filter_eq": ("p_size eq 15", "p_size = 15"),
    "filter_ne": ("small ne 15", "small IS DISTINCT FROM 15"),
    "filter_range_num": ("small ge 10 and p_retailprice lt 1500.5", "small >= 10 AND p_retailprice < 1500.5"),
    "filter_range_str": ("p_name gt 'm'", "p_name > 'm'"),
    "filter_null": ("small eq null", "small IS NULL"),
    "filter_not_null": ("small ne null", "small IS NOT NULL"),
    "filter_and_or": ("p_size lt 5 or p_size gt 45 and p_type ne 'x'", "p_size < 5 OR (p_size > 45 AND p_type <> 'x')"),
    "filter_not": ("not (small gt 20)", "small <= 20 OR small IS NULL"),
    "filter_not_noparens": ("not small eq 3", "small IS DISTINCT FROM 3"),
    "filter_coerce": ("p_size eq 4.9", "p_size = 4"),
    "filter_in": ("p_brand in ('BRAND#11', 'brand#22')", "lower(p_brand) IN ('brand#11', 'brand#22')"),
    "filter_search_in": ("search.in(p_size, '1,2 3|4', ', |')", "p_size IN (1, 2, 3, 4)"),
    "filter_normalized": ("p_brand eq 'BRAND#11'", "lower(p_brand) = 'brand#11'"),
    "filter_double_eq": ("p_retailprice eq 901.0", "p_retailprice = 901.0"),
    "filter_unknown": ("nothing ne 3 and p_size eq 7", "p_size = 7"),
})
filters("(SELECT *, ARRAY(SELECT 1) AS one FROM orders)", ORDERS, orders, "o_orderkey", {
    "filter_date": ("o_orderdate ge 1998-01-01T00:00:00Z", "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "lambda_any_empty": ("lines/any()", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "lambda_any_prim": ("quantities/any(q: q gt 49 and q lt 2)", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 2)"),
    "lambda_all_prim": ("flags/all(f: f ne 'R')", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    "lambda_any_complex": ("lines/any(l: l/flag eq 'R' and l/qty gt 45)", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)"),
    "lambda_all_complex": ("lines/all(l: l/qty lt 30 or l/flag eq 'N')", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity < 30 OR l_returnflag = 'N'))"),
    "lambda_null": ("lines/any(l: l/few ne 10)", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 40 AND l_quantity <> 10)"),
    "lambda_eq_null": ("lines/any(l: l/few eq null)", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 40)"),
    "lambda_search_in": ("lines/any(l: search.in(l/flag, 'A,R'))", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))"),
    "lambda_not_any": ("not lines/any(l: l/mode eq 'F')", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')"),
    "filter_multivalue": ("lines/flag eq 'A'", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')"),
})
ORACLE_SQL.update({k: v.replace("(SELECT *, ARRAY(SELECT 1) AS one FROM orders)", "orders") for k, v in ORACLE_SQL.items()})
filters(C_SQL, CUSTOMER, customer, "c_custkey", {
    "geo_distance_filter": ("geo.distance(place, geography'POINT(10.5 45.5)') le 3000", KM.format(10.5, 45.5) + " <= 3000"),
    "geo_intersects": ("geo.intersects(place, geography'POLYGON((-30 -20, 60 -20, 60 50, -30 50, -30 -20))')", "lon >= -30 AND lon < 60 AND lat >= -20 AND lat < 50"),
    "filter_subfield": ("Address/Segment eq 'BUILDING' and Address/Nation lt 10", "c_mktsegment = 'BUILDING' AND c_nationkey < 10"),
    "filter_geo_null": ("place eq null", "lon IS NULL"),
})
NESTED = Index("orders", (Field("o_orderkey", I64, key=True), Field("lines", "Collection(Edm.ComplexType)", fields=(Field("qty", DBL), Field("marks", "Collection(Edm.String)")))))
SPOTS = Index("customer", (Field("c_custkey", I64, key=True), Field("spots", "Collection(Edm.GeographyPoint)")))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """orders whose lines have a collection of their own."""
    return orders(spark, d).withColumn("lines", F.transform("lines", lambda x: F.struct(x["qty"].alias("qty"), F.array(x["flag"], x["mode"]).alias("marks"))))


def spots(spark: SparkSession, d: str) -> DataFrame:
    """customers with their place and its mirror image over the meridian, or with none."""
    mirror = F.when(F.col("place").isNotNull(), F.struct((-F.col("place.lon")).alias("lon"), F.col("place.lat").alias("lat")))
    return customer(spark, d).withColumn("spots", F.array_compact(F.array("place", mirror)))


filters("orders", NESTED, nested, "o_orderkey", {
    "lambda_nested": ("lines/any(l: l/marks/any(m: m eq 'R') and l/qty gt 45)", "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' OR l_linestatus = 'R') AND l_quantity > 45)"),
    "lambda_nested_all": ("lines/all(l: l/marks/any(m: m eq 'O') or l/qty lt 30)", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_returnflag = 'O' OR l_linestatus = 'O' OR l_quantity < 30))"),
})
filters(C_SQL, SPOTS, spots, "c_custkey", {
    "geo_all": ("spots/all(p: geo.intersects(p, geography'POLYGON((-60 -40, 60 -40, 60 50, -60 50, -60 -40))'))", "lon IS NULL OR (lon >= -60 AND lon < 60 AND -lon >= -60 AND -lon < 60 AND lat >= -40 AND lat < 50)"),
    "geo_all_distance": ("spots/all(p: geo.distance(p, geography'POINT(0 10)') lt 9000)", "lon IS NULL OR (" + KM.format(0, 10) + " < 9000 AND " + KM.format(0, 10).replace("radians(lon)", "radians(-lon)") + " < 9000)"),
})
filters("documents", DOCS, documents, "doc_id", {
    "filter_ismatch": ("search.ismatch('from with', 'text', 'simple', 'all') and lang ne 'de'", "TRUE"),
    "filter_ismatchscoring": ("search.ismatchscoring('oder', 'text') or lang eq 'es'", "lang = 'es'"),
})
_HAS = "list_contains(list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+([''’.][\\p{{L}}\\p{{N}}_]+)*'), lambda x: x), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in analysis.STOPWORDS) + ")), '{0}')"
ORACLE_SQL["filter_ismatch"] = "SELECT doc_id FROM documents WHERE lang <> 'de' AND " + _HAS.format("from")
ORACLE_SQL["filter_ismatchscoring"] = "SELECT doc_id FROM documents WHERE lang = 'es' OR " + _HAS.format("oder")


STORED = Index("stored_part", (Field("p_partkey", I64, key=True), Field("p_name", S), Field("p_size", I32)))


def lines_of(df: DataFrame, action: str | Column, seq: str) -> DataFrame:
    """Batch items as JSON text, nulls written out."""
    body = F.struct((F.lit(action) if isinstance(action, str) else action).alias("@search.action"), *(F.col(c) for c in df.columns))
    return df.select(F.col(seq).cast("long").alias("seq"), F.to_json(body, {"ignoreNullFields": "false"}).alias("item"))


def stored_part(spark: SparkSession, d: str) -> Catalog:
    """A catalog that holds part, indexed as one batch."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="brindle-")).removeprefix("file://")
    catalog = Catalog(spark, os.path.join(root, f"catalog-{uuid.uuid4().hex}"))
    catalog.put(STORED)
    catalog.index_lines("stored_part", lines_of(read(spark, d, "part").select("p_partkey", "p_name", "p_size"), "upload", "p_partkey")).unpersist()
    return catalog


@register("scan_index", "SELECT count(*) AS n, sum(p_size)::BIGINT AS total FROM part")
def scan_index(spark, d):
    return stored_part(spark, d).read("stored_part").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


@register("get_doc", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def get_doc(spark, d):
    return stored_part(spark, d).get_doc("stored_part", "42").select("p_partkey", "p_name")


@register("doc_count", "SELECT count(*) AS n FROM part")
def doc_count(spark, d):
    return spark.createDataFrame([(stored_part(spark, d).count("stored_part"),)], "n long")


@register("write_merge_null_clears", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS p_name, p_size FROM part")
def write_merge_null_clears(spark, d):
    table = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    items = table.where("p_partkey % 5 = 0").select("p_partkey", F.lit(None).cast("string").alias("p_name"))
    return writes.apply_batch(STORED, table, writes.parse_batch(STORED, lines_of(items, "merge", "p_partkey")))


@register("batch_parse", "SELECT CASE WHEN p_partkey % 7 = 0 THEN 400 ELSE 200 END AS status_code, count(*) AS n FROM part GROUP BY 1")
def batch_parse(spark, d):
    size = F.when(F.col("p_partkey") % 7 == 0, "much").otherwise(F.col("p_size").cast("string"))
    raw = read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.format_string('{"@search.action": "upload", "p_partkey": %d, "p_size": %s}', "p_partkey", F.when(size == "much", '"much"').otherwise(size)).alias("item"))
    none = spark.createDataFrame([], STORED.spark())
    return writes.statuses(STORED, none, writes.parse_batch(STORED, raw)).groupBy("status_code").agg(F.count("*").alias("n"))


PLACES = Index("places", (Field("c_custkey", I64, key=True), Field("place", "Edm.GeographyPoint")))


@register("geo_parse", "SELECT c_custkey, lon, lat FROM (SELECT c_custkey, (c_custkey * 37 % 4000) / 10.0::DOUBLE - 200 AS lon, (c_custkey * 53 % 2000) / 10.0::DOUBLE - 100 AS lat FROM customer) WHERE abs(lon) <= 180 AND abs(lat) <= 90")
def geo_parse(spark, d):
    at = F.array((F.col("c_custkey") * 37 % 4000) / 10.0 - 200, (F.col("c_custkey") * 53 % 2000) / 10.0 - 100)
    items = read(spark, d, "customer").select("c_custkey", F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("place"))
    parsed = writes.parse_batch(PLACES, lines_of(items, "upload", "c_custkey"))
    return parsed.where("problem is null").select("doc.c_custkey", "doc.place.lon", "doc.place.lat")


@register("match_all", "SELECT p_partkey, 1.0::DOUBLE AS score FROM part")
def match_all(spark, d):
    return Search(PART, part(spark, d), Request(search="*")).match().select("p_partkey", "score")


@register("get_doc", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def get_doc(spark, d):
    return part(spark, d).where("p_partkey = 42").limit(1).select("p_partkey", "p_name")


@register("count_total", "SELECT count(*) AS count FROM part WHERE p_size > 25")
def count_total(spark, d):
    return Search(PART, part(spark, d), Request(filter="p_size gt 25", top=0)).count()


@register("select_fields", "SELECT p_partkey, p_name, 1.0::DOUBLE AS score FROM part ORDER BY p_partkey LIMIT 20")
def select_fields(spark, d):
    return Search(PART, part(spark, d), Request(select="p_partkey, P_NAME", top=20)).page()


@register("select_hidden", "SELECT p_partkey, 1.0::DOUBLE AS score FROM part ORDER BY p_partkey LIMIT 50")
def select_hidden(spark, d):
    return Search(PART, part(spark, d), Request(select="p_partkey,secret")).page()


@register("select_subfield", "SELECT c_custkey, c_mktsegment AS segment FROM customer ORDER BY c_custkey LIMIT 50")
def select_subfield(spark, d):
    return Search(CUSTOMER, customer(spark, d), Request(select="c_custkey,Address/Segment")).page().select("c_custkey", F.col("Address.Segment").alias("segment"))


@register("select_collection_subfield", "SELECT o_orderkey, (SELECT string_agg(l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS flags FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50)")
def select_collection_subfield(spark, d):
    return Search(ORDERS, orders(spark, d), Request(select="o_orderkey,lines/flag")).page().select("o_orderkey", F.nullif(F.array_join(F.array_sort("lines.flag"), ","), F.lit("")).alias("flags"))


@register("page", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20")
def page(spark, d):
    return Search(PART, part(spark, d), Request(filter="p_size gt 10", orderby="p_retailprice desc", skip=20, top=10)).page().select("p_partkey", "p_retailprice")


@register("page_top0", "SELECT p_partkey FROM part LIMIT 0")
def page_top0(spark, d):
    return Search(PART, part(spark, d), Request(top=0)).page().select("p_partkey")


@register("order_string", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_brand), p_name DESC, p_partkey) AS rank FROM part QUALIFY rank <= 50")
def order_string(spark, d):
    return ranks(Search(PART, part(spark, d), Request(orderby="p_brand, p_name desc")).page().select("p_partkey"))


def ranks(page: DataFrame) -> DataFrame:
    """The rows of a page with their places; a page has 1000 rows at most."""
    key = page.columns[0]
    listed = page.agg(F.collect_list(key).alias("keys"))
    return listed.select(F.posexplode("keys").alias("pos", key)).select(key, (F.col("pos") + 1).cast("long").alias("rank"))


@register("order_nulls", "SELECT p_partkey, row_number() OVER (ORDER BY coalesce(small, 0), p_partkey) AS rank FROM " + P_SQL + " QUALIFY rank <= 50")
def order_nulls(spark, d):
    return ranks(Search(PART, part(spark, d), Request(orderby="small asc")).page().select("p_partkey"))


@register("order_geo", "SELECT c_custkey, row_number() OVER (ORDER BY " + KM.format(10.5, 45.5) + " NULLS LAST, c_custkey) AS rank FROM " + C_SQL + " QUALIFY rank <= 50")
def order_geo(spark, d):
    return ranks(Search(CUSTOMER, customer(spark, d), Request(orderby="geo.distance(place, geography'POINT(10.5 45.5)')")).page().select("c_custkey"))


@register("geo_render", "SELECT c_custkey, 'Point' AS type, lon, lat FROM " + C_SQL + " WHERE lon IS NOT NULL")
def geo_render(spark, d):
    shown = render.rendered(CUSTOMER.need("place").leaf, F.col("place"))
    return customer(spark, d).where("place is not null").select("c_custkey", shown.alias("p")).select("c_custkey", "p.type", F.get("p.coordinates", 0).alias("lon"), F.get("p.coordinates", 1).alias("lat"))


@register("render_hits", "SELECT p_partkey::VARCHAR AS key, p_size IS NOT NULL AND p_size % 7 <> 0 AS has_small, 1.0::DOUBLE AS score FROM part WHERE p_size > 45")
def render_hits(spark, d):
    found = Search(PART, part(spark, d), Request(filter="p_size gt 45")).match().select("p_partkey", "small", "score")
    at = lambda k: F.get_json_object("hit", f"$['{k}']")
    return render.hits(PART, found).select(at("p_partkey").alias("key"), at("small").isNotNull().alias("has_small"), at("@search.score").cast("double").alias("score"))


def facet_query(name: str, index: Index, source, spec: str, sql: str, columns: tuple[str, ...] = ("value", "count"), odata: str | None = None) -> None:
    @register(name, sql)
    def run(spark, d):
        return Search(index, source(spark, d), Request(filter=odata, facets=(spec,))).facet(spec.split(",")[0]).select(*columns)


facet_query("facet_value", PART, part, "p_type", "SELECT p_type AS value, count(*) AS count FROM part WHERE p_size > 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", odata="p_size gt 5")
facet_query("facet_count", PART, part, "p_size,count:0", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1")
facet_query("facet_sort", PART, part, "p_size,sort:-value,count:5", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
facet_query("facet_normalized", PART, part, "p_brand,count:7", "SELECT lower(p_brand) AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
facet_query("facet_collection", ORDERS, orders, "flags", "SELECT l_returnflag AS value, count(DISTINCT l_orderkey) AS count FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
facet_query("facet_complex_path", ORDERS, orders, "lines/qty,count:0", "SELECT l_quantity AS value, count(DISTINCT l_orderkey) AS count FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
_BUCKETS = "SELECT s.slot, s.a AS \"from\", s.b AS \"to\", count({1}) AS count FROM (VALUES {0}) s(slot, a, b) LEFT JOIN part ON (s.a IS NULL OR {1} >= s.a) AND (s.b IS NULL OR {1} < s.b) GROUP BY ALL"
facet_query("facet_values", PART, part, "p_size,values:10|20|30", _BUCKETS.format("(0::BIGINT, NULL::DOUBLE, 10::DOUBLE), (1, 10, 20), (2, 20, 30), (3, 30, NULL)", "p_size"), ("slot", "from", "to", "count"))
facet_query("facet_interval", PART, part, "p_retailprice,interval:100", """WITH w AS (SELECT floor(min(p_retailprice) / 100) AS a, floor(max(p_retailprice) / 100) + 1 AS b FROM part),
s AS (SELECT unnest(range(0, (b - a)::BIGINT + 1)) AS slot, a, b FROM w), t AS (SELECT slot::BIGINT AS slot, CASE WHEN slot > 0 THEN (a + slot) * 100.0::DOUBLE END AS lo, CASE WHEN slot < b - a THEN (a + slot + 1) * 100.0::DOUBLE END AS hi FROM s)
SELECT slot, lo AS "from", hi AS "to", count(p_partkey) AS count FROM t LEFT JOIN part ON (lo IS NULL OR p_retailprice >= lo) AND (hi IS NULL OR p_retailprice < hi) GROUP BY ALL""", ("slot", "from", "to", "count"))


def date_facet(name: str, unit: str, start: str, step: str, spec: str = "") -> None:
    @register(name, f"""WITH k AS (SELECT {start} AS start, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(start) FROM k), (SELECT max(start) FROM k) + INTERVAL {step}, INTERVAL {step})) AS start)
SELECT strftime(s.start, '%Y-%m-%d %H:%M') AS start, coalesce(n, 0)::BIGINT AS count FROM s LEFT JOIN k ON s.start = k.start""")
    def run(spark, d):
        found = Search(ORDERS, orders(spark, d), Request(facets=(f"o_orderdate,interval:{unit}{spec}",))).facet("o_orderdate")
        return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "count")


date_facet("facet_date_interval", "month", "date_trunc('month', o_orderdate)", "1 MONTH")
date_facet("facet_date_year", "year", "date_trunc('year', o_orderdate)", "1 YEAR")
date_facet("facet_date_week", "week", "date_trunc('day', o_orderdate) - to_days(dayofweek(o_orderdate)::INTEGER)", "7 DAY")
date_facet("facet_timeoffset", "day", "date_trunc('day', o_orderdate - INTERVAL 5 HOUR) + INTERVAL 5 HOUR", "1 DAY", ",timeoffset:-05:00")


@register("facet_multi", "WITH f AS (SELECT 'p_type' AS facet, p_type AS value FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), c AS (SELECT facet, value, count(*) AS count FROM f GROUP BY 1, 2) SELECT facet, value, count, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rank FROM c QUALIFY rank <= 10")
def facet_multi(spark, d):
    return facets.multi_facet(part(spark, d), [facets.parse_facet(PART, "p_type"), facets.parse_facet(PART, "p_size")])


@register("facet_empty", "SELECT p_type AS value, count(*) AS count FROM part WHERE p_size < 0 GROUP BY 1")
def facet_empty(spark, d):
    return Search(PART, part(spark, d), Request(filter="p_size lt 0", facets=("p_type",))).facet("p_type")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def vector_query(name: str, index: Index, score: str, odata: str | None = None, post: bool = False, k: int = 20) -> None:
    where = {None: "TRUE"}.get(odata, "label = 2")
    rank = f"SELECT vec_id, label, {score} AS score FROM (SELECT e.*, q.embedding AS q FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) {'' if post else 'WHERE ' + where} ORDER BY score DESC, vec_id LIMIT {k}"

    @register(name, f"SELECT vec_id, round(score, 6) AS score FROM ({rank}) {'WHERE ' + where if post else ''}")
    def run(spark, d):
        r = Request(filter=odata, vectors=(Vector(query_vector(spark, d), ("embedding",), k),), post_filter=post)
        return Search(index, vectors(spark, d), r).match().select("vec_id", F.round("score", 6).alias("score"))


_COS = "1 / (1 + (1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])))"
_DOT = "0.5 * (1 + list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (1 + abs(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]))))"
vector_query("vector_cosine", VECTORS, _COS)
vector_query("vector_dot", DOTS, _DOT)
vector_query("vector_l2", FAR, "1 / (1 + list_distance(embedding::DOUBLE[], q::DOUBLE[]))")
vector_query("vector_prefilter", VECTORS, _COS, "label eq 2")
vector_query("vector_postfilter", VECTORS, _COS, "label eq 2", True)
vector_query("vector_k", VECTORS, _COS, k=3)


@register("vector_facet", f"SELECT label AS value, count(*) AS count FROM (SELECT e.label FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY {_COS} DESC, vec_id LIMIT 30) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def vector_facet(spark, d):
    r = Request(facets=("label",), vectors=(Vector(query_vector(spark, d), (), 30),))
    return Search(VECTORS, vectors(spark, d), r).facet("label")


HYBRID = Index("hybrid", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace"), Field("embedding", "Collection(Edm.Single)", dimensions=64)))


_HYBRID_SQL = f"""WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS tf FROM b), s AS (SELECT count(*) AS n, sum((tf > 0)::INT) AS df FROM c),
t AS (SELECT doc_id, row_number() OVER (ORDER BY sqrt(tf) * (1 + ln(s.n / (df + 1))) * (1 + ln(s.n / (df + 1))) / sqrt(c.n) DESC, doc_id) AS r FROM c, s WHERE tf > 0 QUALIFY r <= 1000),
v AS (SELECT doc_id, row_number() OVER (ORDER BY {_COS} DESC, doc_id) AS r FROM b, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) QUALIFY r <= 20)
SELECT doc_id, ((coalesce((1.0 / (60 + t.r))::FLOAT, 0::FLOAT) + coalesce((WEIGHT / (60 + v.r))::FLOAT, 0::FLOAT))::FLOAT)::DOUBLE AS score FROM t FULL JOIN v USING (doc_id)"""


def hybrid_query(name: str, weight: float, digits: int | None = 6) -> None:
    """Text and vector arms fused; without digits, the single-precision sums must agree to the last bit."""
    sql = _HYBRID_SQL.replace("WEIGHT", repr(weight))

    @register(name, f"SELECT doc_id, round(score, {digits}) AS score FROM ({sql})" if digits else sql)
    def run(spark, d):
        df = documents(spark, d).select("doc_id", "text", "_seq").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
        r = Request(search="that", vectors=(Vector(query_vector(spark, d), ("embedding",), 20, weight),))
        score = F.col("score").cast("double")
        return Search(HYBRID, df, r).match().select("doc_id", (F.round(score, digits) if digits else score).alias("score"))


hybrid_query("hybrid_rrf", 1.0)
hybrid_query("hybrid_weight", 2.5)
hybrid_query("hybrid_fused", 0.5)
hybrid_query("hybrid_float32", 1.0, None)

TWO = Index("two", (Field("vec_id", I64, key=True), Field("embedding", "Collection(Edm.Single)", dimensions=64), Field("turned", "Collection(Edm.Single)", dimensions=64)))


@register("vector_multi_field", f"""WITH e AS (SELECT vec_id, embedding, list_reverse(embedding) AS turned, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings),
a AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM e QUALIFY r <= 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS.replace("embedding", "turned")} DESC, vec_id) AS r FROM e QUALIFY r <= 20)
SELECT vec_id, round((coalesce((1.0 / (60 + a.r))::FLOAT, 0::FLOAT) + coalesce((1.0 / (60 + b.r))::FLOAT, 0::FLOAT))::DOUBLE, 6) AS score FROM a FULL JOIN b USING (vec_id)""")
def vector_multi_field(spark, d):
    df = vectors(spark, d).withColumn("turned", F.reverse("embedding"))
    found = Search(TWO, df, Request(vectors=(Vector(query_vector(spark, d), (), 20),))).match()
    return found.select("vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


def single_vector(name: str, search: str | None) -> None:
    @register(name, f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_COS} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, vec_id LIMIT 5)")
    def run(spark, d):
        r = Request(search=search, top=5, vectors=(Vector(query_vector(spark, d), ("embedding",), 20),))
        return Search(VECTORS, vectors(spark, d), r).page().select("vec_id", F.round("score", 6).alias("score"))


single_vector("vector_single", None)
single_vector("vector_wildcard", "*")


def text_query(name: str, query: str, mode: str, where: str) -> None:
    @register(name, f"WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents) SELECT doc_id FROM d WHERE {where}")
    def run(spark, d):
        index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace")))
        return Search(index, documents(spark, d), Request(search=query, mode=mode)).match().select("doc_id")


_W = "list_contains(w, '{}')".format
text_query("text_simple", "that from", "any", f"{_W('that')} OR {_W('from')}")
text_query("text_mode_all", "that from", "all", f"{_W('that')} AND {_W('from')}")
text_query("text_not", "that +-from", "any", f"{_W('that')} AND NOT {_W('from')}")
text_query("text_group", "(that | with) + was", "any", f"({_W('that')} OR {_W('with')}) AND {_W('was')}")
text_query("text_prefix", "tho*", "any", "len(list_filter(w, lambda x: starts_with(x, 'tho'))) > 0")
text_query("text_phrase", '"of the"', "any", "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")


@register("text_score", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS tf FROM d), s AS (SELECT count(*) AS n, sum((tf > 0)::INT) AS df FROM t)
SELECT doc_id, round(sqrt(tf) * pow(1 + ln(s.n / (df + 1)), 2) / sqrt(t.n), 6) AS score FROM t, s WHERE tf > 0""")
def text_score(spark, d):
    index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace")))
    return Search(index, documents(spark, d), Request(search="that")).match().select("doc_id", F.round("score", 6).alias("score"))


_SCORED = r"""WITH d AS (SELECT doc_id, n_chars, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, n_chars, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS tf FROM d), s AS (SELECT count(*) AS n, sum((tf > 0)::INT) AS df FROM t),
r AS (SELECT doc_id, n_chars, sqrt(tf) * (1 + ln(s.n / (df + 1))) * (1 + ln(s.n / (df + 1))) / sqrt(t.n) AS score FROM t, s WHERE tf > 0) """
WORDS = (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace"), Field("lang", S, searchable=True, analyzer="keyword"), Field("n_chars", I64))


def scored(name: str, sql: str, request: Request, fields: tuple[Field, ...] = WORDS[:2] + WORDS[3:], profiles: dict | None = None, digits: int = 6) -> None:
    @register(name, _SCORED + sql)
    def run(spark, d):
        index = Index("documents", fields, profiles=profiles or {}, default_profile="p" if profiles else None)
        return Search(index, documents(spark, d), request).match().select("doc_id", F.round("score", digits).alias("score"))


_LONG = {"type": "magnitude", "fieldName": "n_chars", "boost": 3, "magnitude": {"boostingRangeStart": 0, "boostingRangeEnd": 4000}}
_BOOST = "CASE WHEN n_chars > 4000 THEN 1.0 ELSE 1 + 2 * (1 - greatest(0, n_chars / 4000.0::DOUBLE)) END"
scored("score_weights", "SELECT doc_id, round(3 * score, 6) AS score FROM r", Request(search="that"), profiles={"p": {"weights": {"text": 3}}})
scored("score_apply", f"SELECT doc_id, round((score * {_BOOST})::FLOAT::DOUBLE, 4) AS score FROM r", Request(search="that"), profiles={"p": {"functions": [_LONG]}}, digits=4)
scored("score_wildcard", f"SELECT doc_id, round(({_BOOST})::FLOAT::DOUBLE, 4) AS score FROM d", Request(search="*"), profiles={"p": {"functions": [_LONG]}}, digits=4)


def ordered(name: str, orderby: str | None, way: str) -> None:
    @register(name, _SCORED + f"SELECT doc_id, row_number() OVER (ORDER BY score {way}, doc_id) AS rank FROM r QUALIFY rank <= 50")
    def run(spark, d):
        return ranks(Search(Index("documents", WORDS[:2]), documents(spark, d), Request(search="that", orderby=orderby)).page().select("doc_id"))


ordered("order_default", None, "DESC")


@register("order_score", f"SELECT doc_id, row_number() OVER (ORDER BY ({_BOOST})::FLOAT, doc_id) AS rank FROM documents QUALIFY rank <= 50")
def order_score(spark, d):
    index = Index("documents", (*WORDS[:2], WORDS[3]), profiles={"p": {"functions": [_LONG]}})
    return ranks(Search(index, documents(spark, d), Request(search="*", profile="P", orderby="search.score() asc")).page().select("doc_id"))


def fielded(name: str, request: Request, where: str) -> None:
    @register(name, f"WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_split_to_array(text, '\\s+') AS w FROM documents) SELECT doc_id FROM d WHERE {where}")
    def run(spark, d):
        return Search(Index("documents", WORDS), documents(spark, d), request).match().select("doc_id")


_LIKE = "len(list_filter(w, lambda x: regexp_matches(x, '^(?:{})$'))) > 0".format
fielded("text_multifield", Request(search="that de"), f"{_W('that')} OR {_W('de')} OR lang = 'de'")
fielded("text_searchfields", Request(search="that de", search_fields=("LANG", "nothing")), "lang = 'de'")
fielded("text_full", Request(search='(th?t OR /wa[sx]/ OR text:"of the"~2) AND NOT lang:en', syntax="full"), "(" + _LIKE("th.t") + " OR " + _LIKE("wa[sx]") + " OR len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of' AND (w[i + 1] = 'the' OR w[i + 2] = 'the' OR w[i + 3] = 'the' OR (i > 1 AND w[i - 1] = 'the')))) > 0) AND lang <> 'en'")
fielded("text_full_default", Request(search="lang:fr OR [thz TO tn]", syntax="full"), "lang = 'fr' OR len(list_filter(w, lambda x: x >= 'thz' AND x <= 'tn')) > 0")
fielded("text_regex", Request(search="/th.{2}/ -from", syntax="full"), _LIKE("th.{2}") + f" AND NOT {_W('from')}")


@register("text_empty", "SELECT doc_id FROM documents WHERE FALSE")
def text_empty(spark, d):
    return Search(DOCS, documents(spark, d), Request(search="the and")).match().select("doc_id")


@register("text_analyzer", r"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'oder')")
def text_analyzer(spark, d):
    index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="mine")), analyzers={"mine": {"tokenizer": "letter", "tokenFilters": ["lowercase"]}})
    return Search(index, documents(spark, d), Request(search="ODER")).match().select("doc_id")


@register("text_fuzzy", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: damerau_levenshtein(x, 'rign') <= 1)) > 0")
def text_fuzzy(spark, d):
    index = Index("part", (Field("p_partkey", I64, key=True), Field("p_name", S, searchable=True, analyzer="whitespace")))
    return Search(index, part(spark, d), Request(search="rign~1")).match().select("p_partkey")


@register("highlight", "SELECT p_partkey, regexp_replace(p_name, '\\b(blue|ring)\\b', '<b>\\1</b>', 'g') AS marked FROM part WHERE regexp_matches(p_name, '\\b(blue|ring)\\b')")
def highlight(spark, d):
    r = Request(search="blue ring", highlight=("p_name-2",), before="<b>", after="</b>")
    found = Search(PART, part(spark, d), r)
    marks = text.fragments(PART.need("p_name"), ["blue", "ring"], 2, r.before, r.after)
    return found.match().select("p_partkey", F.get(marks, 0).alias("marked"))


def analyzed(name: str, chain, pattern_sql: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    @register(name, f"SELECT {key}, array_to_string({pattern_sql}, '|') AS tokens FROM {table}")
    def run(spark, d):
        return read(spark, d, table).select(key, F.array_join(analysis.analyzer(chain)(F.col(column)), "|").alias("tokens"))


_STOP = "(" + ", ".join(f"'{w}'" for w in analysis.STOPWORDS) + ")"
analyzed("analyze_whitespace", "whitespace", r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')")
analyzed("analyze_simple", "simple", r"regexp_extract_all(lower(text), '\p{L}+')")
analyzed("analyze_stop", "stop", rf"list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: x NOT IN {_STOP})")
analyzed("analyze_standard", "standard", rf"list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:[''’.][\p{{L}}\p{{N}}_]+)*'), lambda x: lower(x)), lambda x: x NOT IN {_STOP})")
analyzed("analyze_pattern", "pattern", r"list_filter(list_transform(regexp_split_to_array(text, '\W+'), lambda x: lower(x)), lambda x: x <> '')")
analyzed("analyze_custom", {"charFilters": [{"name": "mapping", "mappings": ["small => tiny"]}], "tokenizer": "whitespace", "tokenFilters": ["uppercase", {"name": "length", "min": 4, "max": 9}]}, "list_filter(string_split(upper(replace(p_name, 'small', 'tiny')), ' '), lambda x: length(x) BETWEEN 4 AND 9)", "part", "p_partkey", "p_name")
analyzed("analyze_keyword", "keyword", "[p_name]", "part", "p_partkey", "p_name")
analyzed("analyze_edge_ngram", {"tokenizer": "edgeNGram"}, "[p_name[1:1], p_name[1:2]]", "part", "p_partkey", "p_name")
analyzed("analyze_ngram", {"tokenizer": "nGram"}, "list_concat(list_transform(range(1, length(p_name) + 1), lambda i: p_name[i:i]), list_transform(range(1, length(p_name)), lambda i: p_name[i:i + 1]))", "part", "p_partkey", "p_name")
analyzed("analyze_shingle", {"tokenizer": "whitespace", "tokenFilters": ["shingle"]}, "list_concat(string_split(p_name, ' '), list_transform(range(1, len(string_split(p_name, ' '))), lambda i: string_split(p_name, ' ')[i] || ' ' || string_split(p_name, ' ')[i + 1]))", "part", "p_partkey", "p_name")


@register("analyze_html_strip", r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages""")
def analyze_html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(F.regexp_replace(analysis.html_strip(F.col("html")), r"\s+", " ")).alias("plain"))


@register("normalize_lowercase", "SELECT p_partkey, lower(p_brand) AS v FROM part")
def normalize_lowercase(spark, d):
    return part(spark, d).select("p_partkey", analysis.NORMALIZERS["lowercase"](F.col("p_brand")).alias("v"))


@register("normalize_standard", "SELECT doc_id, md5(lower(strip_accents(replace(text, 'ß', 'ss')))) AS v FROM documents WHERE lang <> 'xx'")
def normalize_standard(spark, d):
    return documents(spark, d).select("doc_id", F.md5(analysis.NORMALIZERS["standard"](F.col("text"))).alias("v"))


@register("synonym_equiv", r"SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents) WHERE list_contains(w, 'that') OR list_contains(w, 'der') OR len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
def synonym_equiv(spark, d):
    index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace", synonyms=("m",))))
    return Search(index, documents(spark, d), Request(search="that"), {"m": analysis.synonym_rules("that, der, of the")}).match().select("doc_id")


@register("synonym_map", r"SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents) WHERE list_contains(w, 'der')")
def synonym_map(spark, d):
    index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace", synonyms=("m",))))
    return Search(index, documents(spark, d), Request(search="that"), {"m": analysis.synonym_rules("that => der")}).match().select("doc_id")


@register("synonym_chain", r"SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents) WHERE list_contains(w, 'der') OR list_contains(w, 'das')")
def synonym_chain(spark, d):
    index = Index("documents", (Field("doc_id", I64, key=True), Field("text", S, searchable=True, analyzer="whitespace", synonyms=("a", "b"))))
    maps = {"a": analysis.synonym_rules("that => der"), "b": analysis.synonym_rules("der, das")}
    return Search(index, documents(spark, d), Request(search="that"), maps).match().select("doc_id")


def boost_query(name: str, index: Index, source, key: str, profile: dict, parameters: tuple[str, ...], sql: str, table: str) -> None:
    @register(name, f"SELECT {key}, round({sql}, 6) AS boost FROM {table}")
    def run(spark, d):
        m = ranking.profile_multiplier(index, profile, ranking.parse_parameters(list(parameters)), NOW)
        return source(spark, d).select(key, F.round(m, 6).alias("boost"))


def _magnitude(how: str, **more) -> dict:
    return {"type": "magnitude", "fieldName": "small", "boost": 3, "interpolation": how, "magnitude": {"boostingRangeStart": 10, "boostingRangeEnd": 40, **more}}


_T = "greatest(0, (small - 10) / 30.0::DOUBLE)"
boost_query("score_magnitude", PART, part, "p_partkey", {"functions": [_magnitude("linear")]}, (), f"CASE WHEN small IS NULL OR small > 40 THEN 1.0 ELSE 1 + 2 * (1 - {_T}) END", P_SQL)
boost_query("score_interp", PART, part, "p_partkey", {"functions": [_magnitude("quadratic"), _magnitude("logarithmic")], "functionAggregation": "product"}, (), f"CASE WHEN small IS NULL OR small > 40 THEN 1.0 ELSE (1 + 2 * (1 - pow({_T}, 2))) * (1 + 2 * (1 - ln(1 + (exp(1.0) - 1) * {_T}))) END", P_SQL)
boost_query("score_agg", PART, part, "p_partkey", {"functions": [_magnitude("constant"), _magnitude("linear", constantBoostBeyondRange=True)], "functionAggregation": "average"}, (), f"CASE WHEN small IS NULL THEN 1.0 WHEN small > 40 THEN 1.0 ELSE (3 + 1 + 2 * (1 - {_T})) / 2 END", P_SQL)
boost_query("score_freshness", ORDERS, orders, "o_orderkey", {"functions": [{"type": "freshness", "fieldName": "o_orderdate", "boost": 2, "freshness": {"boostingDuration": "P365D"}}]}, (), "CASE WHEN o_orderdate BETWEEN TIMESTAMP '2000-01-02' AND TIMESTAMP '2001-01-01' THEN 2 - date_diff('millisecond', o_orderdate, TIMESTAMP '2001-01-01') / (365 * 86400000.0::DOUBLE) ELSE 1.0 END", "orders")
boost_query("score_distance", CUSTOMER, customer, "c_custkey", {"functions": [{"type": "distance", "fieldName": "place", "boost": 5, "distance": {"referencePointParameter": "here", "boostingDistance": 4000}}]}, ("here-10.5,45.5",), f"CASE WHEN {KM.format(10.5, 45.5)} <= 4000 THEN 1 + 4 * (1 - {KM.format(10.5, 45.5)} / 4000) ELSE 1.0 END", C_SQL)
boost_query("score_tag", PART, part, "p_partkey", {"functions": [{"type": "tag", "fieldName": "p_brand", "boost": 2, "tag": {"tagsParameter": "tags"}}]}, ("tags-Brand#11,Brand#22",), "CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 1.5 ELSE 1.0 END", "part")


@register("suggest", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'bl'))) > 0 ORDER BY p_partkey LIMIT 20")
def suggest(spark, d):
    return Search(PART, part(spark, d), Request()).suggest("sg", "bl", top=20).select("p_partkey")


@register("suggest_text", "SELECT p_partkey, p_name AS suggestion FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: x = 'blue')) > 0 AND len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'r'))) > 0 ORDER BY p_partkey LIMIT 100")
def suggest_text(spark, d):
    return Search(PART, part(spark, d), Request(select="p_partkey")).suggest("sg", "Blue r", top=100)


@register("suggest_top", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'r'))) > 0 AND p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def suggest_top(spark, d):
    return Search(PART, part(spark, d), Request(filter="p_size gt 20", orderby="p_retailprice desc", select="p_partkey")).suggest("SG", "r", top=7).select("p_partkey")


@register("suggest_highlight", r"SELECT p_partkey, regexp_replace(p_name, '\b(blue\b|bo)', '<b>\1</b>', 'g') AS suggestion FROM part WHERE list_contains(string_split(p_name, ' '), 'blue') AND len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'bo'))) > 0 ORDER BY p_partkey LIMIT 50")
def suggest_highlight(spark, d):
    return Search(PART, part(spark, d), Request(select="p_partkey", before="<b>", after="</b>")).suggest("sg", "blue bo", top=50, mark=True)


@register("autocomplete_context", "WITH w AS (SELECT string_split(lower(p_name), ' ') AS w FROM part), i AS (SELECT w, unnest(range(2, len(w) + 1)) AS i FROM w) SELECT w[i] AS completion, count(*) AS n, 'blue ' || w[i] AS query_plus_text FROM i WHERE starts_with(w[i], 'r') AND w[i - 1] = 'blue' GROUP BY ALL")
def autocomplete_context(spark, d):
    return Search(PART, part(spark, d), Request()).autocomplete("sg", "blue r", "oneTermWithContext", plus=True)


@register("autocomplete_one", "SELECT w AS completion, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE starts_with(w, 'b') GROUP BY 1")
def autocomplete_one(spark, d):
    return Search(PART, part(spark, d), Request()).autocomplete("sg", "b")


@register("autocomplete_two", "WITH w AS (SELECT string_split(lower(p_name), ' ') AS w FROM part), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] ELSE w[i] END AS completion, count(*) AS n FROM i WHERE starts_with(w[i], 'b') GROUP BY 1")
def autocomplete_two(spark, d):
    return Search(PART, part(spark, d), Request()).autocomplete("sg", "b", "twoTerms")


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """part, and a batch by key: uploads, merges that set and clear, deletes, and keys that aren't there; two items for some keys."""
    table = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    doc = lambda name, size: F.struct(k.alias("p_partkey"), name.cast("string").alias("p_name"), size.cast("int").alias("p_size"))
    first = table.where("p_partkey % 3 = 0").select(k.alias("seq"), F.expr("element_at(array('upload', 'merge', 'delete'), int(p_partkey / 3 % 3) + 1)").alias("action"), k.cast("string").alias("key"), doc(F.lit("first"), F.lit(None)).alias("doc"), F.array(F.lit("p_name")).alias("present"))
    second = table.where("p_partkey % 9 = 0").select((k + 10**9).alias("seq"), F.lit("mergeOrUpload").alias("action"), k.cast("string").alias("key"), doc(F.lit(None), F.lit(7)).alias("doc"), F.array(F.lit("p_size")).alias("present"))
    new = table.where("p_partkey % 10 = 1").select((k + 10**8).alias("seq"), F.lit("merge").alias("action"), (-k).cast("string").alias("key"), doc(F.lit("no"), F.lit(1)).alias("doc"), F.array(F.lit("p_size")).alias("present"))
    return table, first.union(second).union(new)


SMALL = Index("part", (Field("p_partkey", I64, key=True), Field("p_name", S), Field("p_size", I32)))
_WRITE = """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'none' ELSE ['upload', 'merge', 'delete'][(p_partkey // 3 % 3) + 1] END AS act, p_name, p_size FROM part),
b AS (SELECT p_partkey, act, act = 'delete' AS gone, CASE WHEN act IN ('upload', 'merge') THEN 'first' WHEN act = 'none' THEN p_name END AS n, CASE WHEN act IN ('merge', 'none') THEN p_size END AS s FROM a)
SELECT p_partkey, n AS p_name, CASE WHEN p_partkey % 9 = 0 THEN 7 ELSE s END AS p_size FROM b WHERE NOT gone OR p_partkey % 9 = 0"""


@register("write_sequence", _WRITE)
def write_sequence(spark, d):
    return writes.apply_batch(SMALL, *batch(spark, d))


@register("write_status", "SELECT status_code, count(*) AS n FROM (SELECT 200 AS status_code FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 200 FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 404 FROM part WHERE p_partkey % 10 = 1) GROUP BY 1")
def write_status(spark, d):
    return writes.statuses(SMALL, *batch(spark, d)).groupBy("status_code").agg(F.count("*").alias("n"))


@register("vector_validate", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN FALSE ELSE len(embedding) = 64 END AS sound FROM embeddings")
def vector_validate(spark, d):
    short = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", writes.problem(VECTORS.need("embedding").leaf, short).isNull().alias("sound"))
