import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from brindle.functions import analysis, geo
from brindle.operators import facets, ranking, text, writes
from brindle.plans import render
from brindle.plans.odata import Compiler, Parser
from brindle.plans.schema import Field, Index, RequestError
from brindle.plans.search import Request, Search, Vector
from brindle.sources.store import Catalog
from brindle.streaming.ingest import stream_items

S, I, D, B = "Edm.String", "Edm.Int32", "Edm.Double", "Edm.Boolean"
ROOM = (Field("Type", S), Field("BaseRate", D, facetable=True), Field("Smoking", B), Field("Tags", "Collection(Edm.String)"))
HOTEL = Index("hotels", (Field("Id", S, key=True), Field("Name", S, searchable=True), Field("Rating", I, facetable=True), Field("Sizes", "Collection(Edm.Int32)"), Field("Tags", "Collection(Edm.String)", facetable=True), Field("Place", "Edm.GeographyPoint", sortable=True), Field("Address", "Edm.ComplexType", fields=(Field("City", S), Field("Zip", S))), Field("Rooms", "Collection(Edm.ComplexType)", fields=ROOM)), suggesters={"sg": ("Name",)})
ROWS = [
    ("1", "Seattle Downtown inn", 5, [0, 5], ["wifi", "view"], (-122.33, 47.6), ("Seattle", "98101"), [("Deluxe", 250.0, False, ["wifi", "view"]), ("Standard", 120.0, False, ["wifi"])]),
    ("2", "Bellevue Suites", 4, [2], ["pool"], (-122.2, 47.61), ("Bellevue", None), [("Suite", 400.0, True, ["kitchen", "wifi"])]),
    ("3", "Portland Budget inn", None, [], [], None, None, [("Standard", 90.0, True, ["parking"]), ("Standard", None, False, [])]),
    ("4", None, 3, None, None, (179.9, -1.0), ("Seattle", "98999"), []),
]


@pytest.fixture(scope="module")
def hotels(spark):
    return spark.createDataFrame(ROWS, HOTEL.spark()).withColumn("_seq", F.col("Id").cast("long"))


def ids(df):
    return sorted(r["Id"] for r in df.select("Id").collect())


CASES = [
    ("Rating eq 5", "1"), ("Rating ne 5", "234"), ("not (Rating gt 3)", "34"), ("not Rating eq 3", "123"), ("Rating eq null", "3"), ("Rating eq 4.9", "2"),
    ("Sizes/any(s: s gt 1 and s lt 3)", "12"), ("Sizes/all(s: s gt 1)", "234"), ("Sizes/any()", "12"), ("Tags eq null", "34"), ("Tags/any(t: t ne 'wifi')", "234"),
    ("search.in(Rating, '3,5 x')", "14"), ("Tags/any(t: search.in(t, 'pool|view', '|'))", "12"), ("Name in ('Bellevue Suites')", "2"),
    ("Rooms/any(r: r/Type eq 'Deluxe' and r/BaseRate lt 100)", ""), ("Rooms/any(r: r/Type eq 'Standard' and r/BaseRate lt 100)", "3"), ("Rooms/all(r: r/BaseRate gt 100)", "124"),
    ("Rooms/any(r: r/BaseRate ne 90)", "12"), ("Rooms/any(r: r/BaseRate eq null)", "3"), ("Rooms/any(r: r/Tags/any(t: t eq 'wifi'))", "12"), ("Rooms/any(r: r/Smoking)", "23"), ("Rooms/any(r: 100 gt r/BaseRate)", "3"),
    ("Address/City eq 'Seattle'", "14"), ("Address eq null", "3"), ("Address/Zip eq null", "23"), ("Rooms/Type eq 'Suite'", "2"), ("unknown ne 3", "1234"), ("unknown eq 3", ""),
    ("geo.distance(Place, geography'POINT(-122.3 47.6)') lt 20", "12"), ("20 lt geo.distance(geography'POINT(-122.3 47.6)', Place)", "4"),
    ("geo.intersects(Place, geography'POLYGON((170 -10, -170 -10, -170 10, 170 10, 170 -10))')", "4"), ("search.ismatch('inn')", "13"), ("search.ismatch('inn', 'Name') and not search.ismatch('seattle')", "3"),
]


@pytest.mark.parametrize("odata,want", CASES)
def test_filter(hotels, odata, want):
    assert ids(Search(HOTEL, hotels, Request(filter=odata)).match()) == list(want)


@pytest.mark.parametrize("bad", ["Rating", "5 eq Rating", "Rating eq Sizes", "Tags/all(t: t eq 'a')", "Rating eq 'x'", "Rooms/any(r: x/Type eq 'a')", "geo.distance(Place, geography'POINT(0 0)') eq 3", "Rating gt null", "Name eq 'a' and"])
def test_bad_filters(hotels, bad):
    with pytest.raises(RequestError):
        Search(HOTEL, hotels, Request(filter=bad)).match()


def test_random_filters_follow_two_valued_logic(spark):
    rng = random.Random(3)
    index = Index("t", (Field("k", S, key=True), Field("a", I), Field("b", I)))
    rows = [(str(i), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3])) for i in range(40)]
    df = spark.createDataFrame(rows, index.spark())

    def make(depth):
        if depth == 0:
            return f"{rng.choice('ab')} {rng.choice(['eq', 'ne', 'lt', 'le', 'gt', 'ge'])} {rng.randint(1, 3)}"
        return rng.choice(["not ({0})", "({0}) and ({1})", "({0}) or ({1})"]).format(make(depth - 1), make(depth - 1))

    def test(n, row):
        if n[0] in ("and", "or"):
            return (all if n[0] == "and" else any)(test(x, row) for x in n[1:])
        if n[0] == "not":
            return not test(n[1], row)
        v, w = row[1 if n[2][1] == "a" else 2], n[3][1]
        return {"eq": v == w, "ne": v != w}[n[1]] if n[1] in ("eq", "ne") else v is not None and {"lt": v < w, "le": v <= w, "gt": v > w, "ge": v >= w}[n[1]]

    filters = [make(3) for _ in range(25)]
    found = df.select("k", *(Compiler(index).filter(f).alias(f"f{i}") for i, f in enumerate(filters))).collect()
    for r in found:
        for i, f in enumerate(filters):
            assert bool(r[f"f{i}"]) == test(Parser(f).parse(), rows[int(r["k"])]), f


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) k", "cast(id as int) a").write.parquet(str(tmp_path / "t"))
    index = Index("t", (Field("k", S, key=True), Field("a", I)))
    plan = spark.read.parquet(str(tmp_path / "t")).where(Compiler(index).filter("a ne 3 and not (a gt 7)"))._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualNullSafe(a,3))" in plan and "LessThanOrEqual(a,7)" in plan


def test_facets(hotels):
    get = lambda spec: [tuple(r)[-1] for r in Search(HOTEL, hotels, Request(facets=(spec,))).facet(spec.split(",")[0]).collect()]
    assert get("Tags,sort:value") == [1, 1, 1]
    assert get("Rating,values:4|5") == [1, 1, 1]
    assert get("Rooms/BaseRate,values:100|200") == [1, 1, 2]
    assert get("Rooms/BaseRate,interval:100") == [1, 1, 1, 0, 1, 0]
    for bad in ("Name", "Rating,count:-1", "Rating,values:2|1", "Rating,interval:day", "Rating,x:1", "Rating,interval:5,count:3"):
        with pytest.raises(RequestError):
            facets.parse_facet(HOTEL, bad)


def test_page(hotels):
    page = Search(HOTEL, hotels, Request(orderby="Rating desc", select="Id,Address/City,Rooms/Type", top=2)).page().collect()
    assert [r["Id"] for r in page] == ["1", "2"] and page[0]["Address"].asDict() == {"City": "Seattle"} and [x.asDict() for x in page[1]["Rooms"]] == [{"Type": "Suite"}]
    order = lambda o: "".join(r["Id"] for r in Search(HOTEL, hotels, Request(orderby=o)).page().collect())
    assert order("Rating") == "3421" and order("Name") == "4231" and order("Name desc") == "1324"
    assert order("geo.distance(Place, geography'POINT(-122.3 47.6)')") == "1243"
    with pytest.raises(RequestError):
        order("Tags")
    with pytest.raises(RequestError):
        Search(HOTEL, hotels, Request(top=1001))


def test_text(hotels):
    find = lambda q, mode="any": "".join(ids(Search(HOTEL, hotels, Request(search=q, mode=mode)).match()))
    assert find("inn seattle") == "13" and find("inn seattle", "all") == "1" and find('"downtown inn"') == "1" and find("inn + -seattle") == "3"
    assert find("bel*") == "2" and find("portlend~1") == "3" and find("(suites | budget) + inn") == "3" and find("*") == "1234"
    assert text.parse_simple("") is None


def test_suggest(hotels):
    s = Search(HOTEL, hotels, Request())
    assert [r["suggestion"] for r in s.suggest("sg", "down").collect()] == ["Seattle Downtown inn"]
    assert {r[0] for r in s.autocomplete("sg", "portland b", "oneTermWithContext").collect()} == {"budget"}
    assert {r[0] for r in s.autocomplete("sg", "b", "twoTerms").collect()} == {"bellevue suites", "budget inn"}


def test_vectors_and_fusion(spark):
    index = Index("v", (Field("Id", S, key=True), Field("Title", S, searchable=True), Field("E", "Collection(Edm.Single)", dimensions=3)))
    rows = [("t", "widget", [0.0, 0.0, 1.0]), ("v", "unrelated", [1.0, 0.0, 0.0]), ("b", "widget", [0.9, 0.1, 0.0]), ("f", "widget", [0.0, -1.0, 0.0]), ("n", "widget", None)]
    df = spark.createDataFrame(rows, index.spark()).withColumn("_seq", F.monotonically_increasing_id())
    hits = Search(index, df, Request(vectors=(Vector([1.0, 0.0, 0.0], ("E",), 2),))).page().collect()
    assert [(r["Id"], round(r["score"], 4)) for r in hits] == [("v", 1.0), ("b", 0.9939)]
    assert Search(index, df, Request(search="widget", vectors=(Vector([1.0, 0.0, 0.0], ("E",), 2),))).page().first()["Id"] == "b"
    one = spark.createDataFrame([("x", 1.0, 0)], "Id string, score double, _seq long")
    assert ranking.fuse([(one, 1.0), (one, 1.0)], "Id").first()["score"] == pytest.approx(0.032786883413791656, abs=0)


def test_scoring_functions(spark):
    index = Index("s", (Field("k", S, key=True), Field("r", D), Field("many", "Collection(Edm.Double)"), Field("tags", "Collection(Edm.String)"), Field("at", "Edm.DateTimeOffset")))
    df = spark.createDataFrame([("1", 1.0, [5.0, 1.0], ["a"], datetime(2024, 1, 1)), ("2", None, None, None, None)], index.spark())
    f = lambda **k: {"boost": 3, **k}
    run = lambda fs, agg="sum", p=(): [r[0] for r in df.select(ranking.profile_multiplier(index, {"functions": fs, "functionAggregation": agg}, ranking.parse_parameters(list(p)), datetime(2024, 1, 6, tzinfo=timezone.utc))).collect()]
    span = {"boostingRangeStart": 0, "boostingRangeEnd": 10}
    assert run([f(type="magnitude", fieldName="r", magnitude=span)]) == [pytest.approx(2.8), 1.0]
    assert run([f(type="magnitude", fieldName="many", magnitude=span)]) == [2.0, 1.0]
    assert run([f(type="freshness", fieldName="at", freshness={"boostingDuration": "P10D"})]) == [2.0, 1.0]
    assert run([f(type="tag", fieldName="tags", tag={"tagsParameter": "t"})], p=("t-a,b",)) == [2.0, 1.0]
    both = [f(type="magnitude", fieldName="many", magnitude=span), f(type="magnitude", fieldName="r", magnitude=span)]
    for agg, want in (("sum", 4.8), ("average", 2.4), ("minimum", 2.0), ("maximum", 2.8), ("firstMatching", 2.0), ("product", 5.6)):
        assert run(both, agg)[0] == pytest.approx(want)


def test_analysis(spark):
    one = lambda fn, t: spark.createDataFrame([(t,)], "t string").select(fn(F.col("t"))).first()[0]
    assert one(analysis.analyzer("standard"), "The Quick-Brown fox's 42") == ["quick", "brown", "fox's", "42"]
    assert one(analysis.analyzer({"tokenizer": "path_hierarchy_v2"}), "a/b/c") == ["a", "a/b", "a/b/c"]
    assert one(analysis.analyzer({"charFilters": ["html_strip"], "tokenizer": "whitespace"}), "<p>x &amp; y</p>") == ["x", "&", "y"]
    assert one(analysis.NORMALIZERS["standard"], "NEVÁDA Straße") == "nevada strasse"
    assert one(analysis.analyzer({"tokenizer": "whitespace", "tokenFilters": ["shingle"]}), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert analysis.synonym_rules("usa, united states\ndog => canine, hound") == ({"usa": {"usa", "united states"}, "united states": {"usa", "united states"}}, {"dog": {"canine", "hound"}})
    assert one(analysis.analyzer("fr.microsoft"), "The Quick fox") == ["quick", "fox"]
    for bad in ("unheard.of", {"tokenizer": "none"}, {"tokenizer": "whitespace", "tokenFilters": ["none"]}, {"tokenFilters": []}, {"tokenizer": {"name": "nGram", "minGram": 3, "maxGram": 2}}):
        with pytest.raises(RequestError):
            analysis.analyzer(bad)
    run = lambda t, *filters, tokenizer="whitespace": one(analysis.analyzer({"tokenizer": tokenizer, "tokenFilters": list(filters)}), t)
    assert run("ab abc", {"name": "edgeNGram_v2", "minGram": 2, "maxGram": 3}) == ["ab", "ab", "abc"] and run("abc", {"name": "edgeNGram_v2", "side": "back"}) == ["c", "bc"]
    assert run("a b c d", {"name": "shingle", "maxShingleSize": 3, "outputUnigrams": False, "tokenSeparator": "_"}) == ["a_b", "b_c", "c_d", "a_b_c", "b_c_d"]
    assert run("keep the dog", {"name": "keep", "keepWords": ["dog"]}) == ["dog"] and run("a bb ccc", {"name": "length", "min": 2, "max": 2}) == ["bb"] and run("a b c", {"name": "limit", "maxTokenCount": 2}) == ["a", "b"]
    assert run("the quick fox", {"name": "common_grams", "commonWords": ["the"]}) == ["the", "the_quick", "quick", "fox"]
    assert run("donaudampf", {"name": "dictionary_decompounder", "wordList": ["donau", "dampf"]}) == ["donaudampf", "dampf", "donau"]
    assert run("PowerShot500", {"name": "word_delimiter", "catenateAll": True}) == ["Power", "Shot", "500", "PowerShot500"]
    assert run("abc123", {"name": "pattern_capture", "patterns": ["[a-z]+", "[0-9]+"]}) == ["abc123", "abc", "123"]
    assert run("usa x", {"name": "synonym", "synonyms": ["usa, america"]}) == ["america", "usa", "x"] and run("ran", {"name": "stemmer_override", "rules": ["ran => run"]}) == ["run"]
    assert run("ponies running cats", "porter_stem") == ["poni", "run", "cat"] and run("ＡＢ", "cjk_width") == ["AB"]
    assert one(analysis.analyzer("ja.lucene"), "東京都 abc") == ["東京", "京都", "abc"] and one(analysis.analyzer("en.lucene"), "The running dogs") == ["run", "dog"]
    assert one(analysis.analyzer({"type": "PatternAnalyzer", "pattern": ","}), "A,b c") == ["a", "b c"] and one(analysis.analyzer({"type": "StopAnalyzer", "stopwords": ["x"]}), "the x") == ["the"]
    assert run("aaaa", tokenizer={"name": "standard_v2", "maxTokenLength": 3}) == ["aaa", "a"] and run("/a/b", tokenizer="path_hierarchy_v2") == ["/a", "/a/b"]
    assert one(analysis.analyzer({"charFilters": [{"name": "mapping", "mappings": ["& => and"]}, {"name": "pattern_replace", "pattern": "\\d", "replacement": "#"}], "tokenizer": "whitespace"}), "a & 1") == ["a", "and", "#"]
    assert one(analysis.normalizer({"tokenFilters": ["lowercase", {"name": "pattern_replace", "pattern": "-", "replacement": ""}]}), "A-B") == "ab"


def test_geo(spark):
    d = spark.createDataFrame([((179.7, 0.0),), ((-179.7, 0.0),), (None,)], "p struct<lon:double,lat:double>")
    got = [r[0] for r in d.select(geo.distance_km(F.col("p"), 180.0, 0.0)).collect()]
    assert got[0] == pytest.approx(math.radians(0.3) * geo.EARTH_KM) and got[1] == pytest.approx(got[0]) and got[2] is None
    for bad in ("POINT(0 91)", "POINT 1 2"):
        with pytest.raises(ValueError):
            geo.parse_point(bad)
    with pytest.raises(ValueError):
        geo.parse_polygon("POLYGON((0 0, 1 1, 2 2))")


def test_store_and_stream(spark, tmp_path):
    index = Index("items", (Field("id", S, key=True), Field("name", S), Field("n", I)))
    c = Catalog(spark, str(tmp_path / "root"))
    assert c.put(index) and not c.put(index) and c.names() == ["items"] and c.count("items") == 0
    got = c.index_items("items", [{"@search.action": "upload", "id": "1", "name": "a", "n": 1}, {"@search.action": "merge", "id": "1", "n": None}, {"@search.action": "merge", "id": "2", "n": 3}, {"@search.action": "mergeOrUpload", "id": "3", "n": 3}, {"@search.action": "delete", "id": "9"}, {"@search.action": "upload", "name": "x"}])
    assert [r["status_code"] for r in got] == [200, 200, 404, 200, 200, 400]
    assert sorted(tuple(r) for r in c.read("items").drop("_seq").collect()) == [("1", "a", None), ("3", None, 3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"seq": 1, "item": "{\\"@search.action\\": \\"delete\\", \\"id\\": \\"3\\"}"}\n')
    stream_items(c, "items", str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert c.count("items") == 1 and c.get_doc("items", "1").first()["name"] == "a"
    with pytest.raises(RequestError):
        c.put(Index("items", (Field("id", S, key=True),)))


def test_batches_are_checked(spark, tmp_path):
    index = Index("shops", (Field("id", S, key=True), Field("n", I), Field("at", "Edm.GeographyPoint"), Field("v", "Collection(Edm.Single)", dimensions=3), Field("Rooms", "Collection(Edm.ComplexType)", fields=(Field("r", D), Field("p", "Edm.GeographyPoint")))))
    c = Catalog(spark, str(tmp_path))
    c.put(index)
    up = lambda i, **k: {"@search.action": "upload", "id": i, **k}
    point = lambda x, y: {"type": "Point", "coordinates": [x, y]}
    got = c.index_items("shops", [up("1", n=1, at=point(5, 6), v=[1, 2, 3], Rooms=[{"r": 1.5, "p": point(1, 2)}]), up("2", n="abc"), up("3", v=[1, 2]), up("4", v=[1, None, 2]), up("5", at=point(500, 6)), up("6", at={"type": "Line"}), up("7", Rooms=[{"r": "x"}]), up("8", Rooms=[{"p": point(0, 99)}]), up("9", n=None)])
    assert [r["status_code"] for r in got] == [200, *[400] * 7, 200] and "vector" in got[2]["message"] and "GeoJSON" in got[4]["message"] and got[0]["message"] is None
    rows = {r["id"]: r for r in c.read("shops").collect()}
    assert sorted(rows) == ["1", "9"] and rows["1"]["at"].asDict() == {"lon": 5.0, "lat": 6.0} and rows["1"]["Rooms"][0]["p"].asDict() == {"lon": 1.0, "lat": 2.0}
    with pytest.raises(RequestError):
        c.index_items("shops", [up("10"), {"@search.action": "rename", "id": "1"}])
    assert c.count("shops") == 2 and c.get_doc("shops", "1").first()["n"] == 1 and c.get_doc("shops", "zz").count() == 0
    before = rows["9"]["_seq"]
    c.index_items("shops", [{"@search.action": "merge", "id": "9", "n": 4}, up("20"), up("21")])
    after = {r["id"]: r["_seq"] for r in c.read("shops").collect()}
    assert after["9"] == before and before < after["20"] < after["21"]
    results = spark.createDataFrame([(200,), (404,)], "status_code int")
    assert writes.batch_status(results).first()[0] == 207 and writes.batch_status(results.limit(1)).first()[0] == 200
    c.vacuum("shops")
    assert c.count("shops") == 4 and c.statistics("shops")["document_count"] == 4 and c.drop("shops") and not c.drop("shops") and c.names() == []


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    c = Catalog(spark, str(tmp_path))
    c.put(Index("many", (Field("id", S, key=True), Field("n", I))))
    one = lambda k: c.index_items("many", [{"@search.action": "mergeOrUpload", "id": f"w{k}", "n": k}])[0]["status_code"]
    with ThreadPoolExecutor(4) as pool:
        assert set(pool.map(one, range(8))) == {200}
    assert c.count("many") == 8 and len({r["_seq"] for r in c.read("many").collect()}) == 8


def test_definitions_are_checked(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    key = Field("id", S, key=True)
    good = Index("good", (key, Field("t", S, searchable=True, analyzer="mine", normalizer="low"), Field("n", D), Field("at", "Edm.GeographyPoint")), analyzers={"mine": {"tokenizer": "whitespace", "tokenFilters": ["lowercase"]}}, normalizers={"low": {"tokenFilters": ["lowercase"]}}, suggesters={"sg": ("t",)}, profiles={"p": {"weights": {"t": 2}, "functions": [{"type": "magnitude", "fieldName": "n", "boost": 2, "magnitude": {}}]}})
    assert c.put(good) and c.get("good").allows_change(good) and good.allows_change(c.get("good"))
    df = spark.createDataFrame([("1", "Foo_Bar Café", 1.0, None, 0), ("2", "other", 2.0, None, 1)], good.spark().add("_seq", "long"))
    find = lambda i, q, **k: ids_of(Search(i, df, Request(search=q, **k)).match())
    ids_of = lambda d: sorted(r["id"] for r in d.select("id").collect())
    assert find(good, "FOO_BAR") == ["1"] and find(good, "foo_bar café", mode="all") == ["1"] and ids_of(Search(good, df, Request(filter="t eq 'OTHER'")).match()) == ["2"]
    plain = lambda a: Index("x", (key, Field("t", S, searchable=True, analyzer=a), Field("n", D), Field("at", "Edm.GeographyPoint")))
    assert find(plain("standard"), "foo_bar") == ["1"] and find(plain("pattern"), "Café") == find(plain("standardasciifolding.lucene"), "cafe") == ["1"]
    function = lambda **k: Index("x", good.fields, profiles={"p": {"functions": [{"type": "magnitude", "fieldName": "n", "boost": 2, "magnitude": {}, **k}]}})
    bad = [
        Index("x", (key, Field("c", "Edm.ComplexType"))), Index("x", (key, Field("c", "Edm.ComplexType", fields=(Field("k", S), Field("K", S))))), Index("x", (key, Field("v", "Collection(Edm.Single)", dimensions=1))),
        Index("x", (key, Field("v", "Collection(Edm.Single)", dimensions=3, facetable=True))), Index("x", (key, Field("t", S, searchable=True, analyzer="nope"))), Index("x", (key, Field("t", S, analyzer="simple"))),
        Index("x", (key, Field("t", S, normalizer="nope"))), Index("x", (key, Field("t", S, searchable=True, synonyms=("m",)))), Index("x", (key,), default_profile="p"), Index("x", (key,), suggesters={"s": ("id",)}),
        Index("x", (key, Field("t", S, searchable=True, search_analyzer="simple"))), function(boost=1), function(fieldName="t"), function(interpolation="cubic"), function(type="tag", tag={}),
        Index("x", (key, Field("t", S, searchable=True)), profiles={"p": {"weights": {"t": 0}}}), Index("x", (key,), analyzers={"a": {"tokenizer": "nope"}}),
    ]
    for k, index in enumerate(bad):
        with pytest.raises(RequestError):
            c.put(index)
            print(k)
    assert c.put_synonyms("M", "a, b") and not c.put_synonyms("m", "a, b, c") and c.synonym_names() == ["m"] and c.get_synonyms("m")["synonyms"] == "a, b, c"
    with pytest.raises(RequestError):
        c.put_synonyms("m2", "=> b")
    assert c.put(Index("y", (key, Field("t", S, searchable=True, synonyms=("m",))))) and find(c.get("y"), "x") == [] and "a" in c.synonyms()["m"][0] and c.drop_synonyms("m") and not c.drop_synonyms("m")


def test_full_syntax(hotels):
    find = lambda q, **k: "".join(ids(Search(HOTEL, hotels, Request(search=q, syntax="full", **k)).match()))
    assert find("inn AND seattle") == "1" and find("inn OR suites") == "123" and find("inn NOT seattle") == find("inn -seattle") == find("+inn !seattle") == "3" and find("inn seattle") == "13" and find("inn seattle", mode="all") == "1"
    assert find("Name:budget") == "3" and find("s?attle") == "1" and find("*town") == "1" and find("/po.*d/") == "3" and find("[portland TO seattle]") == "13" and find("{portland TO seattle}") == ""
    assert find('"seattle inn"~1') == "1" and find('"seattle inn"') == "" and find('"inn seattle"~3') == "1" and find("budgte~1") == "3" and find("(suites OR budget) AND inn") == "3"
    assert ids(Search(HOTEL, hotels, Request(filter="search.ismatch('s?attle', 'Name', 'full', 'any')")).match()) == ["1"]
    scores = {r["Id"]: r["score"] for r in Search(HOTEL, hotels, Request(search="budget^5 downtown", syntax="full")).match().collect()}
    assert scores["3"] > scores["1"]
    for bad in ("(inn", "inn)", "Rating:5", "nope:inn"):
        with pytest.raises(RequestError):
            find(bad)
    assert "".join(ids(Search(HOTEL, hotels, Request(search='"seattle inn"~1')).match())) == "1"


def test_highlights_suggestions_and_rendering(hotels):
    r = Request(search="inn", highlight=("Name",), before="[", after="]", orderby="Id")
    marked = [x["highlight_Name"] for x in Search(HOTEL, hotels, r).page().collect()]
    assert marked == [["Seattle Downtown [inn]"], ["Portland Budget [inn]"]]
    tags = Index("hotels", tuple(Field(**{**f.__dict__, "searchable": True}) if f.name == "Tags" else f for f in HOTEL.fields))
    assert Search(tags, hotels, Request(search="wifi", highlight=("Tags-1",))).page().first()["highlight_Tags"] == ["<em>wifi</em>"]
    with pytest.raises(RequestError):
        Search(HOTEL, hotels, Request(search="inn", highlight=("Rating",))).page()
    s = Search(HOTEL, hotels, Request(before="<", after=">", select="Id"))
    assert [tuple(x) for x in s.suggest("SG", "seattle dow", mark=True).collect()] == [("1", "<Seattle> <Dow>ntown inn")] and s.suggest("sg", "seatlte dow", fuzzy=True).count() == 1
    assert {x["query_plus_text"] for x in s.autocomplete("sg", "nice b", plus=True).collect()} == {"nice bellevue", "nice budget"}
    for bad in (lambda: s.suggest("none", "a"), lambda: s.suggest("sg", "a", top=101), lambda: Search(HOTEL, hotels, Request(search_fields=("Rating",))).suggest("sg", "a"), lambda: s.autocomplete("sg", "a", "threeTerms")):
        with pytest.raises(RequestError):
            bad()
    import json

    hits = [json.loads(x["hit"]) for x in render.hits(HOTEL, Search(HOTEL, hotels, Request(orderby="Id")).page()).collect()]
    assert hits[0]["Place"] == {"type": "Point", "coordinates": [-122.33, 47.6]} and "Rating" not in hits[2] and hits[0]["@search.score"] == 1.0
    name, found = render.buckets(HOTEL, "rating", Search(HOTEL, hotels, Request(facets=("Rating,values:4",))).facet("rating"))
    assert name == "Rating" and [json.loads(x["bucket"]) for x in found.orderBy("bucket").collect()] == [{"from": 4.0, "count": 2}, {"to": 4.0, "count": 1}]
    assert render.failure(RequestError("x")) == (400, {"error": {"code": "InvalidRequest", "message": "x"}}) and render.failure(KeyError("x"))[0] == 500 and render.coverage(50) == {"@search.coverage": 100.0} and render.coverage(None) == {}
    form = dict(render.parameters({"$filter": "Rating eq 5", "facet": ["Rating"], "searchMode": "all", "$top": "3", "sessionId": "s", "queryType": "full"}))
    assert form == {"filter": "Rating eq 5", "facets": ("Rating",), "mode": "all", "top": 3, "syntax": "full"} and ids(Search(HOTEL, hotels, Request(**form)).match()) == ["1"]
    with pytest.raises(RequestError):
        dict(render.parameters({"$skip": "x"}))


def test_circles_have_boxes(spark):
    rng = random.Random(1)
    rows = [((rng.uniform(-180, 180), rng.uniform(-90, 90)),) for _ in range(3000)]
    d = spark.createDataFrame(rows, "p struct<lon:double,lat:double>")
    for lon, lat, km in ((179, 10, 900), (-179.5, -40, 700), (10, 89, 500), (20, 50, 1500)):
        inside = geo.distance_km(F.col("p"), lon, lat) <= km
        assert d.where(inside & ~geo.within_box(F.col("p"), lon, lat, km)).isEmpty() and not d.where(inside).isEmpty()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "filter_eq" in e.queries()
