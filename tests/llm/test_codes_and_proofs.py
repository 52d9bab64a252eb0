import hashlib
import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from markovine.llm import compress_quality, hash_forest, langid, merkle, pivot_topk, registry, simhash, toxicity, vector_codes
from markovine.llm._common import Scratch

# ------------------------------------------------------------------ op11


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op11_compression_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all((rows.score >= 0) & (rows.score <= 1)) and all(rows.predicted == (rows.score >= 0.7))
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.predicted.mean() >= 0.95 and bad.predicted.mean() <= 0.2


def test_sizes_by_definition():
    content = [b"spam spam buy now " * 20, b"the quiet river ran to the sea " * 20]
    c = compress_quality.Compressor([((content[0], False), (content[1], False))], 3)
    model = compress_quality.Quality(0.5, c, 0.25, 40.0)
    text = "the quiet river " * 200 + "é"
    data = text.encode()
    want = []
    for x in content:
        d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        want.append(sum(len(z.compress(data[a : a + compress_quality.PIECE])) for a in range(0, len(data), compress_quality.PIECE)))
    assert model.measure(text) == (len(data), *want)
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-0.25 - 40 * (want[0] - want[1]) / len(data))))
    assert model.score("the quiet river ran") > model.score("spam spam buy now")


def test_pieces_cover_the_text():
    data = bytes(range(256)) * 40
    assert b"".join(compress_quality.pieces(data)) == data and compress_quality.pieces(b"") == []
    some = compress_quality.spread(data, 4)
    assert len(some) == 4 and some[0] == data[:1024] and data.endswith(some[-1])


def test_curve_is_the_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    a, b = compress_quality.curve(x, y, np.ones(400))
    p = 1 / (1 + np.exp(-(a + b * x)))
    n = y.sum()
    target = np.where(y > 0, (n + 1) / (n + 2), 1 / (402 - n))
    assert abs((p - target).sum()) < 1e-3 and abs(((p - target) * x).sum()) < 1e-3
    a, b = compress_quality.curve(np.r_[np.ones(9), -np.ones(9)], np.r_[np.ones(9), np.zeros(9)], np.ones(18))
    assert math.isfinite(b) and b > 0


def test_quality_edge_cases(spark):
    good, bad = "the river runs to the sea and the hills are green {0}", "BUY!! NOW!! CHEAP!! ### {0} $$$"
    texts = [(good if k % 2 else bad).format(f"{k} ") * (1 + k % 4) for k in range(60)] + [None, "", "x" * 200_000]
    rows = [(k, t, 0.5, 1, 2) for k, t in enumerate(texts)] + [(3, texts[3], 0.5, 1, 2), (None, "the river runs", 0.1, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, `a.b` int, y int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(60, 1), (61, 0), (None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    model = compress_quality.train(docs, labels, "quality")
    got = {}
    for r in compress_quality.predict(docs, model).collect():
        assert got.setdefault(r["doc_id"], r["score"]) == r["score"] and 0 <= r["score"] <= 1
    assert len(got) == 64 and got[60] == got[61] == pytest.approx(model.share)
    assert min(got[k] for k in range(1, 60, 2)) > max(got[k] for k in range(0, 60, 2))
    kept = compress_quality.keep_good(docs, model, least=0.5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(1, 60, 2))
    assert compress_quality.predict(docs.limit(0), model).count() == 0
    for some, share in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.0)):
        one = compress_quality.train(docs, some, "quality")
        assert one.share == share and one.score("anything") == share
    assert compress_quality.train(docs.limit(0), labels, "quality").compressor is None
    # two labelled texts are too few for a trained dictionary
    few = compress_quality.train(docs, labels.where("doc_id IN (0, 1)"), "quality")
    assert few.score(texts[1]) > few.score(texts[0])


# ------------------------------------------------------------------ op12


def lloyd(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``id, label, codes, error`` with every distance computed, and the codebooks."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not rows:
        return [], []
    length = -(-max(len(r[1]) for r in rows) // parts) * parts
    x = np.array([[math.floor(scale * v) for v in r[1]] + [0] * (length - len(r[1])) for r in rows], dtype=np.int64)
    w = length // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    books = [x[first][:, p * w : (p + 1) * w].copy() for p in range(parts)]

    def assign(p):
        d = np.stack([((x[:, p * w : (p + 1) * w] - c) ** 2).sum(axis=1) for c in books[p]], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assign(p)
            for e in set(at.tolist()):
                books[p][e] = x[at == e, p * w : (p + 1) * w].sum(axis=0) // (at == e).sum()
    found = [assign(p) for p in range(parts)]
    return [(r[0], r[2], [int(a[i]) for a, _ in found], int(sum(d[i] for _, d in found))) for i, r in enumerate(rows)], [b.tolist() for b in books]


def quantised(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, id long, codes int, `a.b` int")
    with Scratch(spark, "codes") as scratch:
        got, books, scans = vector_codes.quantise(scratch, df, **options)
        return [(r["id"], r["label"], r["codes"], r["error"]) for r in got.collect()], books.entries.astype(int).tolist(), scans


@pytest.mark.parametrize("kind", ["spread", "clusters", "lattice", "odd"])
def test_codes_by_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 300
    if kind == "spread":
        x = rng.normal(size=(n, 8))
    elif kind == "clusters":
        x = rng.normal(size=(9, 8))[rng.integers(0, 9, n)] + rng.normal(scale=0.01, size=(n, 8))
    else:  # whole steps: many ties, many equal vectors
        x = rng.integers(-2, 3, (n, 8)) / 1024.0
    rows = [(int(i), v.tolist(), int(i % 3) if i % 7 else None) for i, v in enumerate(x)]
    if kind == "odd":
        rows += [(5, [1.0], 1), (5, [0.5, 0.25], 1), (5, [1.0], 1), (None, [0.1] * 7, None), (9, None, 1), (10, [None, 1.0], 1), (11, [math.nan], 1), (12, [math.inf] * 8, 1), (13, [], 2)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for entries in (1, 1000) if kind == "odd" else (16,):
        got, books, scans = quantised(spark, rows, entries=entries)
        want, wanted = lloyd(rows, entries=entries)
        assert sorted(got, key=key) == sorted(want, key=key) and books == wanted
        assert scans[0] == 4 * len(want) and len(scans) == 5
        if kind == "clusters" and entries == 16:
            assert sum(scans[2:]) < scans[0]  # bounds hold for most of them


def test_bounds_fail_strictly():
    books = vector_codes.Codebooks.of(np.array([[[0.0], [4.0]]]), np.array([[[0.0], [6.0]]]))
    # a row at 2 is as near to both entries now: whatever it had, it gets the lower one
    for held in (0, 1):
        at, up, low, scanned = vector_codes.assign(np.array([[2.0]]), 0, books, np.array([held]), np.array([2.0 if held == 0 else 4.0]), np.array([4.0 if held == 0 else 2.0]))
        assert at.tolist() == [0] and scanned == 1 and up[0] >= 2 >= low[0]


def test_codes_of_nothing_and_large_components(spark):
    assert quantised(spark, [])[0] == [] and quantised(spark, [(1, None, 1)])[0] == []
    with pytest.raises(Exception, match="too large"):
        quantised(spark, [(1, [1e12] * 8, 1)])


def test_label_sums(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 4 if i < 400 else i, i * i) for i in range(600)], "id long, label int, error long")
    for hot in (1, 4, 1024):
        got = {r["id"]: r["label_error"] for r in vector_codes.per_label(rows, hot=hot).collect()}
        sums: dict = {}
        for r in rows.collect():
            sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
        assert got == {r["id"]: sums[r["label"]] for r in rows.collect()}


def test_codes_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = lloyd(rows)
    sums: dict = {}
    for r in want:
        sums[r[1]] = sums.get(r[1], 0) + r[3]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    got = sorted(tuple(r) for r in registry.op12_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted((i, "".join(f"{c:02x}" for c in codes), e, sums[label], sha) for i, label, codes, e in want)


# ------------------------------------------------------------------ op13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    return levels


def way(levels, i, fan):
    out = []
    for nodes in levels[:-1]:
        a = i // fan * fan
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan])))
        i //= fan
    return out


def manifest(rows, fan=16):
    """``doc_id, leaf, subroot, root, proof, folded, verified`` of ``doc_id, source, lang, n_chars, text``."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, h(*map(value, r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda g: (g[0][0] is not None, g[0][0] or 0, g[1]))
        trees[s] = tree([d for _, d in groups[s]], fan)
    top = tree([trees[s][-1][0] for s in names], fan)
    az = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    out = []
    for k, s in enumerate(names):
        for i, (r, d) in enumerate(groups[s]):
            steps, acc = way(trees[s], i, fan) + way(top, k, fan), d
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                acc = h(*map(value, (*r[:4], r[4] and r[4].translate(az))))
            for a, b in steps:
                acc = h(a, acc, b)
            out.append((r[0], d, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def proofs(spark, rows, fan=16):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, i int, `a.b` int, leaf string")
    lower = merkle.leaf_digest(*(F.translate("text", registry._AZ, registry._AZ.lower()) if c == "text" else F.col(c) for c in registry._LEAF))
    with Scratch(spark, "proofs") as scratch:
        got = merkle.verify(df, registry._LEAF, "source", "doc_id", {"doc_id": F.col("doc_id")}, F.when(registry.crc_of_id("doc_id") % 5 == 0, lower), scratch, fan)
        return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("fan,sizes", [(16, (40, 17, 16, 1)), (2, (33, 1, 2, 3)), (2, (1,))])
def test_proofs_by_brute_force(spark, fan, sizes):
    rows = [(100 * g + k, f"s{g}", "en", k, f"Text {k} É") for g, n in enumerate(sizes) for k in range(n)]
    assert proofs(spark, rows, fan) == manifest(rows, fan)


def test_proofs_edge_cases(spark):
    rows = [(1, None, None, None, None), (None, None, "en", 0, ""), (None, "", "", 5, "A"), (2, "", "de", None, "B" * 100_000), (3, "s", "en", 1, "Same"), (3, "s", "en", 1, "Same"), (3, "s", "en", 1, "Other"), (-7, "ß", "fr", 3, "é1:x"), (4, "Z", "x", 1, "same")] + [(9, "many", "en", 1, "AbC")] * 40
    got = proofs(spark, rows)
    assert got == manifest(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    assert proofs(spark, []) == []


def test_steps_lead_every_leaf_to_the_root(spark):
    rows = [(k, f"s{k % 3}", "en", k, str(k)) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    with Scratch(spark, "proofs") as scratch:
        got = merkle.prove(scratch, df, ["doc_id", "text"], "source", "doc_id", fan=4)
        got = got.withColumn("folded", merkle.fold(F.col("leaf"))).collect()
    assert len(got) == 70 and len({r["root"] for r in got}) == 1 and all(r["folded"] == r["root"] for r in got)
    assert sorted((r["tree"], r["i"]) for r in got) == sorted((f"ss{g}", k) for g in range(3) for k in range(24 if g == 0 else 23))


def test_proofs_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*registry._LEAF).collect()]
    got = registry.op13_merkle_proofs(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest(rows)


# ------------------------------------------------------------------ repeated ids, odd names


def test_searches_on_repeated_ids(spark):
    """A repeated id is one candidate with its best score; repeats cost no rank."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(20, rows[20][1])] * 3 + [(7, rows[20][1]), (41, rows[3][1]), (41, (3 * x[41]).tolist()), (60, (2 * x[9]).tolist())] + [(50 + k % 5, (5 * x[k]).tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, full = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    whole = np.floor(64 * full)
    for fn, z, parts in ((pivot_topk.top_k, whole, {"segment": 16, "block": 2}), (hash_forest.search, full, {"share": 100.0, "segment": 40, "block": 2})):
        got: dict = {}
        for r in fn(df, **parts).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in (0, 20, 40, 60, 80):
            lists = []
            for at in np.flatnonzero(ids == q):
                score = {}
                for i, s in zip(ids, z @ z[at]):
                    if i != q:
                        score[int(i)] = max(score.get(int(i), -np.inf), float(s))
                top = sorted(score.items(), key=lambda k: (-k[1], k[0]))[:20]
                lists += [(k + 1, i, s) for k, (i, s) in enumerate(top)]
            own = sorted(got[q], key=lambda r: r[:2])
            want = sorted(lists, key=lambda r: r[:2])
            assert [r[:2] for r in own] == [r[:2] for r in want] and np.allclose([r[2] for r in own], [r[2] for r in want])


def test_forest_serves_small_tables(spark, monkeypatch):
    """No size is scored whole: every search goes through the trees."""
    calls = []
    kept = hash_forest.ForestPlan.strings
    monkeypatch.setattr(hash_forest.ForestPlan, "strings", lambda self, *a: calls.append(1) or kept(self, *a))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    plan = hash_forest.ForestPlan(16, float((x * x).sum(axis=1).max()), 56, 32, 0.7, 21)
    seg = hash_forest.Segment(x, np.arange(500), np.arange(501), np.zeros(500), np.zeros(500), plan.index(x))
    hits = [len(set(found.tolist()) & set(np.argsort(-(x @ q))[:21].tolist())) / 21 for q, (found, _) in zip(x[:50], plan(x[:50], seg), strict=True)]
    assert len(calls) == 2 and np.mean(hits) >= 0.9


def test_stages_keep_columns_with_dots(spark):
    text = "the river runs to the sea and the hills are green and the sky is blue today "
    rows = [(k, f"{text}{k % 3}", "en", 0.5, k) for k in range(9)] + [(9, None, None, 0.5, 9), (10, "", "en", 0.1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` double, `x``y` long")
    kept = simhash.keep_dissimilar(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [0, 9]
    assert simhash.keep_one(df).columns == df.columns
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, toxic int")
    clean = toxicity.keep_clean(df, toxicity.train(df, labels, "toxic"), below=2.0)
    assert clean.columns == df.columns and clean.count() == 11
    named = langid.keep_identified(df, langid.train(df, "lang"))
    assert named.columns == df.columns and {r[0] for r in named.collect()} == set(range(9))
