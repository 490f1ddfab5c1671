import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import common, covertree, exact, lines, mixing, pieces, scoring, secrets, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count string, value string, block string, row string, key string, class string"
LONG = " ".join(f"w{i % 700}" for i in range(12_000))
TEXTS = ["a b  c", "a b c", "abc", None, "", " \t", "The Cat sat\non the mat", "x" * 5000, LONG, LONG, "token=abcdefgh", "é ü 🙂 é", "a b c d e f g", "the cat sat\non the mat"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, ["src0", None, "x"][i % 3], 1, "c", "v", "b", "r", "k", "cl") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "nameless row", None, "src0", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_the_whole_pipeline(spark, tmp_path):
    """On a small folder of tables with nulls, empty and repeated rows, clashing names, near copies; and on empty tables."""
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)]
    rows = [(i, t + (" gruzzak vlimpfe sniggork" * 3 if i % 5 == 0 else ""), "en", "src%d" % (i % 6), len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i].replace(" ", "  "), None, None, 1) for i in range(1, 30, 5)] + [(2000 + i, texts[i] + " end", None, "src0", 1) for i in range(2, 30, 5)]
    rows += [rows[1], rows[1], (None, None, None, None, None), (4000, "", None, "src1", 0), (4001, "  ", None, "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("file", "pos", "key", "digest", "_mix_n", "row", "best")})
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality long, toxic long")
    for name, n in (("full", 1 << 30), ("none", 0)):
        docs.limit(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(n).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    held, kept = spark.read.parquet(f"{tmp_path}/full/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, f"{tmp_path}/full").write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = held.collect()
    ids = {name: [r.doc_id for r in x] for name, x in kept.items()}
    assert all(held.columns[:12] == list(r.__fields__)[:12] for r in kept["mixing"])
    clean = {i for i in range(200) if i % 5}
    assert len(clean - set(ids["toxicity"])) <= 4 and len({i for i in range(0, 200, 5)} & set(ids["toxicity"])) <= 4
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept["exact_dedup"]]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept["toxicity"]})
    assert not {2000 + i for i in range(2, 30, 5)} & set(ids["near_dedup"]) and set(ids["near_dedup"]) == {i for i in ids["exact_dedup"] if i is None or i < 2000 or i >= 4000}
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and len(ids["sentencepiece"]) == len(ids["mixing"])
    assert all(r.decoded == (r.text or "") for r in kept["sentencepiece"])


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (8, 7), (7, 9)] + [(100 + i, 101 + i) for i in range(50)], "a long, b long")
    got = dict(common.connected_components(edges).collect())
    assert {k: got[k] for k in (3, 4, 5, 7, 8, 9)} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7} and {got[100 + i] for i in range(51)} == {100}


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)])
@pytest.mark.parametrize("files", [None, 1])
def test_exact(docs, digest, files):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = defaultdict(list)
    for i, t in rows:
        want[norm(t)].append((-len(t or ""), i is None, i))
    held, file, pos, found = exact.exact_groups(docs, digest, files)
    got = held.select(F.col(file).alias("file"), F.col(pos).alias("pos"), "text").join(found, ["file", "pos"]).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    for r in got:
        group = want[norm(r.text)]
        assert r.group_size == len(group) and r.keep_id == min(group, key=lambda x: (x[0], x[1], x[2] or 0))[2]
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and Counter(norm(r.text) for r in kept.collect()) == dict.fromkeys(want, 1)


def test_rows_are_located(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    docs.withColumnsRenamed({"key": "file", "row": "_metadata"}).repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    for df in (read, read.select("*"), read.union(read), docs.withColumnRenamed("key", "pos")):
        rows, file, pos = common.located(df)
        assert rows.columns == [*df.columns, file, pos] and rows.select(file, pos).distinct().count() == rows.count() == df.count()
    assert common.located(read)[0].inputFiles() == read.inputFiles() and common.located(read)[1] == "_file"
    assert exact.drop_copies(read).columns == read.columns


def test_empty_tables(empty):
    assert exact.drop_copies(empty).count() == mixing.mix_sources(empty).count() == simhash.drop_near_copies(empty).count() == 0
    assert pieces.token_digests(empty).count() == secrets.scan_secrets(empty).count() == suffixes.drop_repeats(empty).count() == 0
    assert scoring.score_texts(empty, F.lit(True)).count() == toxicity.score(empty, None).count() == lines.marked_lines(empty).count() == 0


def fingerprint(text, width):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect()}
    fp = {r.doc_id: fingerprint(r.text, 3) for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == fp
    ids = [i for i in fp if i is not None]
    want = roots(ids, [(a, b) for a in ids for b in ids if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert all(got[i][1] == want[i] for i in ids)


def test_hamming_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(6)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    for tile in (1, 1024):
        found = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, tile).collect()
        got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in found}
        assert got == {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3} and len(got) == len(found)


def test_near_copies_of_the_pipeline(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for size in (12, 40, 200, 900):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(2):
                copy = list(words)
                for _ in range(rng.randrange(1, max(2, size // 45 + 2))):
                    copy[rng.randrange(size)] = f"new{rng.randrange(99)}"
                texts.append(" ".join(copy))
    texts += ["", None, "a b", "A  b", "a c"]
    sets = [simhash.shingles((t or "").encode()) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum((fingerprint(texts[i], 3) ^ fingerprint(texts[j], 3)).bit_count() > 3 for i, j in near) > 10
    want = sorted(set(roots(range(len(texts)), near).values()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == want and len(want) < len(texts)
    few = [(3, texts[0]), (5, texts[0]), (5, texts[40]), (5, texts[40]), (None, texts[0]), (None, texts[80]), (7, None), (6, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, texts[0]), (5, texts[40]), (None, texts[80]), (6, "")], key=str)
    sets = simhash.wide_fingerprints(df.selectExpr("doc_id id", "0L file", "0L pos", "text")).withColumnRenamed("id", "node")
    assert simhash.near_candidates(sets, tile=7).count() == simhash.near_candidates(sets).count()


def test_only_sets_that_share_a_shingle_of_their_prefixes_meet(spark):
    """Of unrelated texts of like size no pairs are compared, and no near pair is lost, with or without knowledge of frequent shingles."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    legal = words(30)
    texts = [" ".join(words(rng.randrange(95, 105)) + legal * (k % 2)) for k in range(300)]
    texts += [" ".join(t.split()[:50] + ["x"] * (k % 4) + t.split()[50:]) for k, t in enumerate(texts[:40])]
    texts += [" ".join([*words(2), *legal]) for _ in range(40)] + ["", None]
    sets = [simhash.shingles((t or "").encode()) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "0L file", "id pos", "text").checkpoint()
    common = simhash.common_shingles(df)
    assert len(common[0]) >= 26 and common[1].max() >= 190
    for often in (None, common):
        found = simhash.wide_fingerprints(df, often).withColumnRenamed("id", "node").checkpoint()
        got = [{tuple(r) for r in simhash.near_candidates(found, radius=128, **more).collect()} for more in ({}, {"few": 3, "tile": 7}, {"few": 1000})]
        assert got[0] == got[1] == got[2] and near <= got[0] and len(near) > 700
    assert len(got[0]) < 3000 < len(texts) ** 2 // 20


def test_mixing(spark, docs):
    assert mixing.poisson_steps(0.0) == (0, []) and mixing.poisson_steps(700.0)[1][-1] == pytest.approx(1)
    least, steps = mixing.poisson_steps(1e6)
    middle = least + sum(c <= 0.5 for c in steps)
    assert least > 0.98e6 and len(steps) < 40_000 and abs(middle - 1e6) < 3 and steps[0] < 2**-52
    rare = spark.range(0, 3001).selectExpr("id doc_id", "if(id = 3000, 'src0', 'x') source", "repeat('t', 10) text")
    many = mixing.mixed(rare, mixing.Mix({"src0": 0.5}, 2.0)).where("row.source = 'src0'").select("copy").collect()
    assert sorted(r["copy"] for r in many) == list(range(len(many))) and abs(len(many) - 3001) < 6 * 3001**0.5
    df = spark.range(6000).selectExpr("id doc_id", "case when id < 3000 then 'src0' when id < 4500 then 'src1' end source", "'text' text")
    got = mixing.mixed(df, mixing.Mix({"src0": 0.2, "src1": 0.5}, 2.0)).groupBy("row.source").count().collect()
    share = {r["source"]: r["count"] / 12000 for r in got}
    assert share["src0"] == pytest.approx(0.2, abs=0.02) and share["src1"] == pytest.approx(0.5, abs=0.02) and share[None] == pytest.approx(0.3, abs=0.02)
    keys = [r[0] for r in mixing.mixed(df).select("key").collect()]
    assert keys == sorted(keys) and mixing.mix_sources(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mixed(df, mixing.Mix({"a": 1.5}))


def sample_texts():
    rng = random.Random(1)
    return [t or "" for t in TEXTS] + ["  ", "hello  world\n a<s>x ▁b", "\u0000a", "ﬁ é", "a▁▁ b▁"] + ["".join(rng.choice("ab  the▁é🙂\n\t<s>1") for _ in range(rng.randrange(30))) for _ in range(300)]


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own, texts = pieces.Pieces(pieces.default_model()), sample_texts()
    ids, starts, ends, counts = own.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts):
        mine = ids[at : at + n].tolist()
        assert mine == model.encode(t) and own.decode(mine) == model.decode(mine)
        if n:
            assert starts[at] == 0 and ends[at + n - 1] == len(t.encode()) and (starts[at + 1 : at + n] == ends[at : at + n - 1]).all()
        at += n
    rng = random.Random(2)
    for _ in range(500):
        some = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(6))]
        assert own.decode(some) == model.decode(some)
    got = {r.doc_id: r for r in pieces.token_digests(docs).collect()}
    for r in docs.collect():
        mine = model.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(mine) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(model.decode(mine).encode()).hexdigest()
    assert pieces.with_tokens(docs).columns == [*docs.columns, "ids", "starts", "ends"]


def test_the_pipeline_decodes(spark, docs):
    import corpus_pipeline
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = corpus_pipeline.sentencepiece(spark, docs, "").collect()
    assert len(got) == docs.count() and all(r.decoded == model.decode(r.ids) == model.decode(model.encode(r.text or "")) for r in got)
    clash = docs.withColumnsRenamed({"key": "ids", "row": "decoded"})
    assert pieces.with_tokens(clash, decoded="decoded").columns == [*clash.columns, "_ids", "starts", "ends", "_decoded"]


def test_the_pipeline_encodes_little_at_once(spark):
    """What a worker holds beside its batch: whole rows, spans and decoded texts need more room than digests."""
    import tracemalloc
    from types import SimpleNamespace

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": [" ".join(rng.choices(words, k=1500)) for _ in range(600)]})
    fake = SimpleNamespace(columns=["doc_id", "text"], schema=T.StructType.fromDDL("doc_id long, text string"), mapInArrow=lambda run, schema: run)
    run = pieces.with_tokens(fake, decoded="decoded")
    want = pieces.loaded(pieces.default_model()).encode(batch.column("text"))
    tracemalloc.start()
    rows = 0
    for out in run(iter([batch])):
        rows += out.num_rows
        assert out.column("text").equals(batch.column("text").slice(rows - out.num_rows, out.num_rows))
        assert out.column("ids").flatten().to_numpy().tolist() == want[0][want[3][: rows - out.num_rows].sum() : want[3][:rows].sum()].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 600 and batch.nbytes > 5e6 and peak < 150e6


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_character_map(rule, squeeze):
    """The walk over a real compiled map, texts and byte spans, against the library's normaliser."""
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = library.serialized_model_proto()
    own = pieces.Pieces.__new__(pieces.Pieces)
    norm = next({f: v for f, _, v, _ in pieces._fields(value)} for number, _, value, _ in pieces._fields(proto) if number == 3)
    own.prefix, own.squeeze, own.escape, own.user, own.mark, own.begins = True, squeeze, True, [], pieces.MARK.encode(), None
    own.map = pieces.CharMap(norm.get(2, b""))
    assert bool(own.map.units) == (rule != "identity")
    rng = random.Random(4)
    texts = ["", " ", "ﬁne ①②  ｱﾞ", "e\u0301 É\u200b Ⅷ", " a\u3000\u3000b ", "½ kg ㎏\tx\n"] + ["".join(rng.choice("aé ﬁ①ｱﾞe\u0301\u3000 Ⅷ½Ａ㎏\t🙂") for _ in range(rng.randrange(20))) for _ in range(300)]
    for t in texts:
        out, begin, end = own.normalise(t.encode())
        assert out.decode() == library.normalize(t), t
        assert len(begin) == len(end) == len(out) and (begin <= end).all() and (np.diff(begin) >= 0).all() and (end <= len(t.encode())).all()
        raw = t.encode()
        for a, b in zip(begin.tolist(), end.tolist()):
            raw[a:b].decode()  # whole characters
    if rule == "nmt_nfkc":
        out, begin, end = own.normalise("xﬁy".encode())
        assert out.decode() == "\u2581xfiy" and list(zip(begin, end))[3:] == [(0, 1), (1, 4), (1, 4), (4, 5)]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_lines(spark, docs):
    rng = random.Random(2)

    def change(x, k):
        x = list(x)
        for _ in range(k):
            o, i = rng.randrange(3), rng.randrange(len(x))
            x[i : i + (o > 0)] = [] if o == 1 else [rng.choice("abé")]
        return "".join(x)

    texts = sorted({change(b, rng.randrange(4)) for b in ("".join(rng.choice("abé") for _ in range(rng.randrange(26, 40))) for _ in range(30)) for _ in range(4)})
    texts = [t for t in texts if len(t) >= 24]
    df = spark.createDataFrame([(t,) for t in texts + texts[:9]], "line string")
    found = lines.edit_pairs(df).collect()
    got = {frozenset((r.x, r.y)) for r in found}
    want = {frozenset((s, t)) for s in texts for t in texts if s < t and edits(s, t) <= 2}
    assert got == want and len(got) == len(found) > 0
    few = [(k % 40, "\n".join(rng.choice(texts[:30] + ["", " ", "short"]) for _ in range(rng.randrange(4)))) for k in range(50)]  # ids repeat
    table = spark.createDataFrame(few, "doc_id long, text string")
    flat = [(i, n, x) for i, t in few for n, x in enumerate(t.split("\n"))]
    kinds = sorted({x for _, _, x in flat if x.strip()})
    root = roots(range(len(kinds)), [(i, j) for i in range(len(kinds)) for j in range(i) if min(len(kinds[i]), len(kinds[j])) >= 24 and edits(kinds[i], kinds[j]) <= 2])
    root = {x: root[k] for k, x in enumerate(kinds)}
    first = {c: min((i, n) for i, n, x in flat if root.get(x) == c) for c in set(root.values())}
    gone = Counter((i, n, bool(x.strip()) and first[root[x]] != (i, n)) for i, n, x in flat)
    assert Counter((r.doc_id, r.line_no, r.removed) for r in lines.marked_lines(table).collect()) == gone
    pairs = [(a, change(a, rng.randrange(6))) for a in texts[:60]]
    for tau in (1, 3):
        close = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= tau]
        found = spark.createDataFrame(close, "x string, y string").select(lines.edit_distance(F.col("x"), F.col("y"), tau)).collect()
        assert [min(r[0], tau + 1) for r in found] == [min(edits(*p), tau + 1) for p in close]
    rows = spark.createDataFrame([(1, "one long line that is repeated\n\nshort"), (2, "one long line that is repeatex\nshort\n"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in lines.drop_lines(rows).collect()) == [(1, "one long line that is repeated\n\nshort"), (2, ""), (3, "")]
    assert lines.marked_lines(docs).count() == sum((r.text or "").count("\n") + 1 for r in docs.collect())


def test_keys_of_lines_are_compiled_and_texts_of_one_hash_stay_apart(spark, monkeypatch):
    texts = [f"{k:02d} a line that is long enough {k * k * 7919}" for k in range(12)] + ["03 a line that is long enough 7127x", " " * 30 + "\u2028", " " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    plan = lines.edit_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    generators = [x for x in plan.splitlines() if "Generate explode" in x]
    assert generators and not any("hash" in x or "substr" in x for x in generators)
    want = {frozenset((x, y)) for x in texts for y in texts if x < y and edits(x, y) <= 2}
    hashed = F.xxhash64
    for few in (1 << 40, 4):
        monkeypatch.setattr(lines.F, "xxhash64", lambda *c, few=few: hashed(*c) if len(c) > 1 else F.pmod(hashed(*c), F.lit(few)))
        assert {frozenset((r.x, r.y)) for r in lines.edit_pairs(df).collect()} == want and len(want) > 1
    monkeypatch.undo()
    rows = spark.createDataFrame([(None, "\t\n\u2028\na line that is long enough"), (2, "\u2028\n\ta\n\ta\na line that is long enough\n\t"), (2, "\ta")], "doc_id long, text string")
    got = Counter((r.doc_id, r.line_no) for r in lines.marked_lines(rows).collect() if r.removed)
    assert got == Counter([(None, 2), (2, 1), (2, 2)])


def removed(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_subtrees_have_exact_depths():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 60, 40)
    row = np.repeat(np.arange(40), size)
    codes = rng.integers(0, 2, len(row)).astype(np.uint64)
    codes[row == 5] = codes[row == 9][0]
    group = rng.integers(0, 3, len(row))
    starts = np.arange(len(row))
    words = [tuple(codes[i : np.searchsorted(row, row[i], side="right")].tolist()) for i in starts]
    order, depth = suffixes.subtree(group, codes, row, starts)
    listed = [(group[i], words[i]) for i in order]
    assert listed == sorted(listed) and sorted(order.tolist()) == starts.tolist()
    for k in range(1, len(order)):
        (g, a), (h, b) = listed[k - 1], listed[k]
        common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert depth[k] == (common if g == h else 0)
    first, last, least = suffixes.deep_nodes(order, depth, 8)
    under = {i for a, b in zip(first, last) for i in order[a : b + 1].tolist()}
    again = Counter((group[i], w[:8]) for i, w in enumerate(words) if len(w) >= 8)
    assert under == {i for i, w in enumerate(words) if len(w) >= 8 and again[group[i], w[:8]] > 1} and (least >= 8).all()


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 5)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "b", "ccc", "é", "dd", "f" * 9])
    shared = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randrange(50))] + shared[rng.randrange(20) : rng.randrange(30, 60)] + [word() for _ in range(rng.randrange(50))]) for _ in range(40)]
    texts += ["z " * 100, "z " * 34, "\t".join(shared), None, "", LONG, LONG + " tail"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in suffixes.drop_repeats(df).collect())
    assert got == [(i, *x) for i, x in enumerate(removed(texts, 35))] and sum(x[2] for x in got)
    rows = docs.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed) for r in suffixes.drop_repeats(docs).collect())
    assert got == sorted(((r.doc_id is None, r.doc_id or 0), *x[:2]) for r, x in zip(rows, removed([r.text for r in rows], 35)))


def test_secrets():
    import base64
    import gzip

    assert secrets.listed(secrets.base_spans("PassWord: 'hunter22' toKen=abc api-key=x AKIA" + "A" * 16 + " " + "0af" * 8)) == "assign:0:19,access:41:61,hex:62:86"
    assert secrets.base_spans("ſecret=abcdefgh") == []
    plain = "token=abcdefgh12"
    for layer in (base64.b64encode(plain.encode()).decode(), base64.b64encode(gzip.compress(plain.encode())).decode(), "".join(f"%{b:02X}" for b in plain.encode()), "".join(f"\\u{ord(c):04x}" for c in plain), base64.b64encode("".join(f"%{b:02x}" for b in plain.encode()).encode()).decode()):
        text = "é " + layer + " end"
        ((a, kind, b),) = secrets.all_spans(text, [])
        assert kind == 0 and 2 <= a < b <= 2 + len(layer) and b - a >= len(layer) - 4
    assert secrets.all_spans("%25" * 30, []) == []


def hidden(text):
    return {(k, text[a:b]) for a, k, b in secrets.all_spans(text, [])}


def test_secrets_in_layers_that_are_no_plain_text():
    import base64
    import gzip

    code = lambda raw: base64.b64encode(raw).decode()
    plain = b"token=abcdefgh12"
    for odd in ("\u00a0", "\u3000", "\u200b", "\ufeff", "\f", "\0"):
        assert len(hidden(code(f"see {odd} ".encode() + plain))) == 1
    assert len(hidden(code(b"caf\xe9 " + plain + b" \xff"))) == 1
    ((kind, where),) = hidden("é " + "".join(f"%{b:02X}" for b in b"caf\xe9 " + plain))
    assert kind == 0 and where == "".join(f"%{b:02X}" for b in plain)
    filler = hashlib.sha512(b"x").digest() * 3
    for raw in (gzip.compress(filler + plain), zlib.compress(filler + plain), filler + plain):
        for width in (76, 64, 10):
            for end in ("\n", "\r\n", "\n  "):
                wrapped = end.join(code(raw)[i : i + width] for i in range(0, len(code(raw)), width))
                assert len(hidden("text before: " + wrapped + " and after")) == 1 and len(hidden("word\n" + wrapped + "\nword")) == 1
    for before in ("", "a", "ab", "abc"):
        assert len(hidden(before + code(plain))) == 1 and len(hidden(before + code(gzip.compress(filler + plain)))) == 1
    assert secrets.LAYER_HINT and pa.compute.match_substring_regex(pa.array(["dG9r\nZW49\nYWJj\nZGVm"]), secrets.LAYER_HINT).to_pylist() == [True]


def test_secrets_in_large_and_nested_streams():
    import base64
    import gzip

    code = lambda raw: base64.b64encode(raw).decode()
    plain = b"token=abcdefgh12"
    assert hidden(code(gzip.compress(b"lorem, " * 3_000_000 + plain))) and hidden(code(gzip.compress(b"a" * 20_000_000 + b" " + plain)))
    assert hidden(code(gzip.compress(b"x" * (secrets.PIECE - 8) + b", " + plain + b" ," * 9)))
    deep = plain
    for k in range(60):
        deep = gzip.compress(deep) if k % 2 else zlib.compress(deep)
    assert hidden(code(deep))
    assert hidden(code(gzip.compress(b"first ") + gzip.compress(plain))) and hidden(code(gzip.compress(b"tok") + gzip.compress(b"en=abcdefgh12")))
    assert hidden(code(gzip.compress(gzip.compress(b"lorem, " * 3_000_000 + plain)))) and hidden(code(gzip.compress(b"(S" + plain)))
    whole = gzip.compress(hashlib.sha512(b"y").digest() + plain + hashlib.sha512(b"z").digest() * 3)
    assert hidden(code(whole[:-20])) and hidden(code(whole) + " ")


def test_secrets_table(docs):
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert got[10].base == got[10].spans == "assign:0:14" and got[3].base == "" and len(got) == len(TEXTS) + 1


def brute_links(e):
    v = covertree.unit(np.array(e))
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    n = len(e)
    return s.sum(1), roots(range(n), [(i, j) for i in range(n) for j in range(n) if s[i, j]])


@pytest.mark.parametrize("block", [4096, 60])
def test_embeddings(spark, block):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    e = np.concatenate([base[rng.integers(0, 12, 200)] + rng.normal(size=(200, 8)) * rng.choice([0, 0.001, 0.1, 0.3], size=(200, 1)), rng.normal(size=(60, 8))]).astype(np.float32)
    e[:20] = e[0]
    rows = [(i, x.tolist()) for i, x in enumerate(e)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [math.nan] * 8), (905, [math.inf] * 8), (906, [1.0, 2.0]), (None, [1.0] * 8)]
    got = {r.vec_id: r for r in covertree.embedding_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), block=block).collect()}
    links, root = brute_links(e)
    assert all(got[i].n_links == links[i] and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(e)))
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)
    tie = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.19**0.5, 0.0]), (2, [0.0, 0.0, 2.0]), (3, [0.0, 0.0, 5.0]), (3, [0.0, 0.0, 5.0])]
    at = float(covertree.unit(np.array([tie[0][1]]))[0] @ covertree.unit(np.array([tie[1][1]]))[0])
    rows = covertree.embedding_groups(spark.createDataFrame(tie, "vec_id long, embedding array<double>"), cosine=at).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False)]
    assert covertree.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sha", "no"]) for _ in range(rng.randrange(1, 4)))
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [word() for _ in range(80)]
        for _ in range(4 if bad else 0):
            words[rng.randrange(80)] = rng.choice(["gruzzak", "vlimpfe", "sniggork"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.9 and got[1000] == got[1001] < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 520
    assert toxicity.train(docs, labels.where("toxic = 0")) is None


def test_scoring(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "mats", "Über", f"n{rng.randrange(300)}"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    df = spark.createDataFrame(rows + [(300, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_texts(df, F.col("doc_id") % 5 != 1, steps=60).collect()}
    words = {i: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in t.split()] for i, t in rows} | {300: []}
    c = Counter()
    for i, w in words.items():
        if i % 5 != 1:
            c.update([*w, None])
    n, kinds = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, i % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (kinds + 1))) for x in [*w, None]), abs=1e-6) and r.score < 0
    assert scoring.score_texts(docs, F.lit(False), steps=5).count() == docs.count()


def test_the_layer_learns_from_all_training_documents(spark, monkeypatch):
    seen = []
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "mats"]) for _ in range(9))) for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = scoring.changed
    monkeypatch.setattr(scoring, "changed", lambda start, packed: seen.append((scoring.summed_changes(packed, len(start.query)), len(packed))) or whole(start, packed))
    for merged in (scoring.MERGED, 1000):
        monkeypatch.setattr(scoring, "MERGED", merged)
        assert scoring.score_texts(df, F.lit(True), sample_chars=2000, steps=20).count() == 4500
    (a, _), (b, few) = seen
    assert a[0][-1] == b[0][-1] == 4500 and a[0].sum() == b[0].sum() >= 4500 * 10 and a[3] == b[3] and few < 5 * 5
    assert np.allclose(a[1], b[1], atol=1e-2) and np.abs(a[1]).max() > 0


def test_windows_score_each_piece_once_as_a_plain_model_does():
    rng = np.random.default_rng(1)
    group = np.arange(40) % scoring.CLASSES
    m = scoring.initial(40, group, np.full(scoring.CLASSES, 1 / scoring.CLASSES))
    ids, bounds = rng.integers(0, 39, 100), np.array([0, 1, 70, 100])
    got, _ = scoring.class_scores(m, ids, bounds, 39, 20)
    pad = scoring.WINDOW - scoring.STRIDE
    for a, b in zip(bounds, bounds[1:]):
        inputs = np.concatenate([[39], ids[a : b - 1]])
        for i in range(b - a):
            low = max(0, i // scoring.STRIDE * scoring.STRIDE - pad)
            seen = inputs[low : i + 1]
            w = np.exp(m.query[inputs[i]] @ m.key[seen].T * scoring.WIDTH**-0.5 + m.bias[i - np.arange(low, i + 1)])
            logits = (w @ m.value[seen] / w.sum() + m.rest[inputs[i]]) @ m.out + m.out_bias
            assert got[a + i] == pytest.approx(logits[group[ids[a + i]]] - np.log(np.exp(logits).sum()), abs=1e-3)


def test_words_of_blocks_travel_packed():
    rng = random.Random(5)
    texts = [" ".join(f"W{rng.randrange(900)}" for _ in range(rng.randrange(200))) + "\té ü" * (k % 2) for k in range(60)] + ["", " \t"]
    learn, blocks = [k % 3 > 0 for k in range(62)], [k // 25 for k in range(62)]
    batch = pa.RecordBatch.from_pydict({"block": blocks, "text": texts, "learn": learn})
    got, places, rows = defaultdict(int), defaultdict(set), 0
    for out in scoring._block_words(iter([batch, batch.slice(0, 0)]), 7):
        words, per = scoring._unjoined(pa.chunked_array([out.column("words")]))
        times = scoring._unpacked(out.column("n"), np.int64)
        where = np.repeat(np.arange(out.num_rows), per).tolist()
        for r, w, n in zip(where, words.to_pylist(), times.tolist()):
            got[out.column("block")[r].as_py(), w] += n
            places[w].add(out.column("bucket")[r].as_py())
        rows += out.num_rows
    want = Counter()
    for b, t, x in zip(blocks, texts, learn):
        want.update({(b, re.sub("[A-Z]", lambda m: m.group().lower(), w)): n * x for w, n in Counter(t.split()).items()})
    assert got == dict(want) and all(len(x) == 1 for x in places.values()) and len(set.union(*places.values())) == 7
    assert rows <= 3 * 7 < len(want) / 20


def test_a_task_cuts_each_word_once(monkeypatch):
    cut, path = [], scoring.default_model()
    plain = scoring.pieces_of
    monkeypatch.setattr(scoring, "pieces_of", lambda words, path: cut.extend(words) or plain(words, path))
    known = scoring.Known(path)
    for words in (["one", "two", "\u4e00x"], [], ["two", "three", "one"], ["three"]):
        at = known.places(pa.array(words, pa.string()))
        ids, n = plain(words, path)
        begin = np.cumsum(known.n) - known.n
        assert known.n[at].tolist() == n.tolist()
        assert [known.ids[begin[i] + k] for i in at for k in range(known.n[i])] == ids.tolist()
    assert cut == ["one", "two", "\u4e00x", "three"]
    texts = pa.RecordBatch.from_arrays([pa.array(["one two", "two three", "one three"])], ["text"])
    cut.clear()
    known = scoring.Known(path)
    monkeypatch.setattr(scoring, "Known", lambda path: known)
    runs = []
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m))), mapInArrow=lambda run, schema: runs.append(run) or SimpleNamespace(collect=lambda: []))
    end = scoring.tokenizer(path).get_piece_size()
    start = scoring.initial(end + 1, np.zeros(end + 1, np.int64), np.full(scoring.CLASSES, 1 / scoring.CLASSES))
    scoring.over_all(frame, start, path, end, 1)
    monkeypatch.setattr(scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    assert len(list(runs[0](iter([texts.slice(k, 1) for k in range(3)])))) == 1 and cut == ["one", "two", "three"]


def test_steps_follow_the_plain_gradient():
    rng = np.random.default_rng(2)
    m = scoring.initial(50, np.arange(51) % scoring.CLASSES, np.full(scoring.CLASSES, 1 / scoring.CLASSES))
    for scale in (1, 60):  # the second is beyond what needs no bound
        h = np.concatenate([rng.normal(size=(1300, scoring.WIDTH)) * scale, np.ones((1300, 1))], axis=1).astype(np.float32)
        target, dh = rng.integers(0, scoring.CLASSES, 1300), np.zeros((1300, scoring.WIDTH), np.float32)
        grad = scoring.output_gradient(m, h, target, dh)
        p = np.exp(np.minimum(h.astype(float) @ np.concatenate([m.out, m.out_bias[None]]), 80))
        p = (p / p.sum(axis=1, keepdims=True) - np.eye(scoring.CLASSES)[target]) / 1300
        assert np.allclose(grad["out"], h[:, :-1].T @ p, atol=1e-4) and np.allclose(grad["out_bias"], p.sum(axis=0), atol=1e-5) and np.allclose(dh, p @ m.out.T, atol=1e-6)
    ids, rows = rng.integers(0, 40, 500) ** 2 // 30, rng.normal(size=(500, 8)).astype(np.float32)
    used, sums = scoring.summed_rows(ids, rows)
    assert used.tolist() == sorted(set(ids.tolist())) and all(np.allclose(s, rows[ids == i].sum(axis=0), atol=1e-4) for i, s in zip(used, sums))


def test_a_step_takes_parts_that_lie_apart():
    """The output's gradient needs no column for the bias, sums of rows take parts side by side, and a whole step's gradients are those of plain loops."""
    rng = np.random.default_rng(4)
    ids, parts = rng.integers(0, 60, 700) ** 2 // 40, rng.normal(size=(3, 700, 4)).astype(np.float32)
    used, sums = scoring.summed_rows(ids, parts)
    assert used.tolist() == sorted(set(ids.tolist()))
    assert np.allclose(sums, [np.concatenate(parts[:, ids == i].sum(axis=1)) for i in used], atol=1e-4)
    for scale in (0.3, 9):  # the second is beyond what needs no bound
        m = scoring.initial(30, np.arange(30) % scoring.CLASSES, np.full(scoring.CLASSES, 1 / scoring.CLASSES))
        for c in (*scoring.BY_PIECE, "out", "out_bias", "bias"):
            setattr(m, c, (rng.normal(size=getattr(m, c).shape) * scale).astype(np.float32))
        assert (max(np.abs(m.query @ m.key.T).max() / 4, np.abs(m.rest @ m.out).max()) > 60) == (scale > 1)
        window = rng.integers(0, 30, (5, scoring.WINDOW + 1))
        table, bias, out, out_bias = (x.astype(float) for x in (np.concatenate([getattr(m, c) for c in scoring.BY_PIECE], axis=1), m.bias, m.out, m.out_bias))
        want, flat, n = np.zeros_like(table), np.zeros(scoring.WINDOW), window[:, 1:].size
        dout, dbias = np.zeros_like(out), np.zeros_like(out_bias)
        for w in window:
            q, k, v, rest = np.split(table[w[:-1]], 4, axis=1)
            for i in range(scoring.WINDOW):
                a = np.exp(np.clip(k[: i + 1] @ q[i] / 4 + bias[i::-1], -60, 60))
                a /= a.sum()
                h = a @ v[: i + 1]
                p = np.exp(np.minimum((h + rest[i]) @ out + out_bias, 80))
                p /= p.sum()
                p[m.kind[w[i + 1]]] -= 1
                dout, dbias, dh = dout + np.outer(h + rest[i], p) / n, dbias + p / n, out @ p / n
                da = a * ((v[: i + 1] - h) @ dh)
                flat[i::-1] += da
                want[w[i]] += np.concatenate([da @ k[: i + 1] / 4, np.zeros(32), dh])
                np.add.at(want, w[: i + 1], np.concatenate([np.zeros((i + 1, 16)), np.outer(da, q[i]) / 4, np.outer(a, dh), np.zeros((i + 1, 16))], axis=1))
        adam = scoring.Adam(m)
        scoring.learn(m, adam, window, 0.01)
        for got, plain in ((adam.first["table"], want), (adam.first["bias"], flat), (adam.first["out"], dout), (adam.first["out_bias"], dbias)):
            assert np.allclose(got, 0.1 * plain, atol=1e-4 * np.abs(plain).max())
        h, target, dh = rng.normal(size=(600, scoring.WIDTH)).astype(np.float32), rng.integers(0, scoring.CLASSES, 600), np.zeros((600, scoring.WIDTH), np.float32)
        longer = np.concatenate([h, np.ones((600, 1), np.float32)], axis=1)
        assert all(np.array_equal(a, b) for a, b in zip(scoring.output_gradient(m, h, target, dh).values(), scoring.output_gradient(m, longer, target, dh * 0).values()))
