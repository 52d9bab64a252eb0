import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from markovine.llm import bpe_stream, ctw, hash_forest, html_text, langid, packing, pivot_topk, registry, simhash, token_files, toxicity  # noqa: E402

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "one", "two words", "The the of and  to.", "naïve café ΣΑΣ <|endoftext|> x", "don't we'll 12 345 --", "中文 字 ½ ²", LONG, "a" * 9_000, "one"]


def docs(spark, rows=None):
    """Texts with a clashing extra column and a repeated row."""
    rows = list(enumerate(TEXTS)) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0.5, 7) for i, t in rows], "doc_id long, text string, lang string, source string, score double, ids int")


# ------------------------------------------------------------------ op1


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "null id")]
    df = docs(spark, rows)
    got = token_files.read_ids(spark, token_files.write_ids(df, path, shard=500)).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["start"] == start
        start += len(ids)
    assert token_files.read_ids(spark, token_files.write_ids(df.limit(0), path)).count() == 0


def test_shard_random_access():
    rng = np.random.default_rng(0)
    arrays = [np.r_[rng.integers(0, 6, n), 0].astype("<u4").tobytes() for n in (0, 1, 700, 3, 4000)]
    s = token_files.Shard(token_files.Shard.pack([1, 2, None, 4, 5], arrays))
    assert len(s.rules) and len(s.seq) < s.total
    assert s.decode().tobytes() == b"".join(arrays)
    for k, a in enumerate(arrays):
        ids = np.frombuffer(a, "<u4")
        assert s.document(k).tolist() == ids.tolist()
        assert [s.token(k, p) for p in (0, len(ids) // 2, len(ids) - 1)] == [ids[0], ids[len(ids) // 2], ids[-1]]
    with pytest.raises(IndexError):
        s.token(1, 2)
    assert token_files.Shard(token_files.Shard.pack([], [])).decode().tolist() == []
    with pytest.raises(ValueError):
        token_files.Shard(b"nothing to see here")


def repeats(seq, ends):
    """The most occurrences of a pair inside documents that do not overlap."""
    counts: Counter = Counter()
    start = 0
    for end in ends:
        last: dict = {}
        for k in range(start, end - 1):
            pair = (seq[k], seq[k + 1])
            if last.get(pair, -2) < k - 1:
                counts[pair] += 1
                last[pair] = k
        start = end
    return max(counts.values(), default=0)


@pytest.mark.parametrize("kind", ["random", "runs", "copies", "words"])
def test_no_pair_repeats_after_repair(kind):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 3000):
        if kind == "random":
            ids = rng.integers(0, 7, n)
        elif kind == "runs":
            ids = np.repeat(rng.integers(0, 3, n), rng.integers(1, 9, n))[:n]
        elif kind == "copies":
            ids = np.tile(rng.integers(0, 500, max(n // 8, 1)), 8)[:n]
        else:
            ids = np.array([x for w in rng.integers(0, 40, n) for x in (w % 7, 50 + w, 9)][:n], dtype=np.int64)
        n = len(ids)
        ends = np.sort(np.append(rng.integers(0, n + 1, 5), n))
        seq, cut, rounds, base = token_files.repair(ids.astype("<u4"), ends)
        assert repeats(seq.tolist(), cut.tolist()) < 2
        rules = np.concatenate(rounds).tolist() if rounds else []

        def grow(x):
            return [x] if x < base else grow(rules[x - base][0]) + grow(rules[x - base][1])

        starts, old = [0, *cut.tolist()], [0, *ends.tolist()]
        for a, b, c, d in zip(starts, starts[1:], old, old[1:]):
            assert [y for x in seq[a:b].tolist() for y in grow(x)] == ids[c:d].tolist()


# ------------------------------------------------------------------ op2

PROSE = " ".join(["The cat is on the mat and it is in the house."] * 6)


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>home</a></nav></body></html>", ""),
        ("<article><h1>Head</h1><p>Short.<p>It is a text of the day &amp; night&#33;</article><footer>bye</footer>", "Head\nShort.\nIt is a text of the day & night!"),
        ("<main><p>A  <b>bold</b>\n word<br>next</p><script>var a='</p>';</script><style>p{}</style><!-- no --></main>", "A bold word next"),
        ("<article><p>One the of.</p><div class='ad'>Buy</div><aside>Side</aside><form>Name <input></form><section id='comments'><p>First!</p></section></article>", "One the of."),
        ("<div class='cookie-notice'>We use cookies</div><article><header><h1>Title</h1></header><p>Text.</p></article><div id='sidebar'>more</div>", "Title\nText."),
        ("<article><p>unclosed <b>bold<p>second</article>", "unclosed bold\nsecond"),
        ('<article><p>text <span class="ad">Buy now</span> end.</p>', "text end."),
        ('<article><p>text <span class="ad">Buy <span>it</span> now</span> end.</p>', "text end."),
        ('<div class="layout has-sidebar"><article><p>It is a text.</p></article></div>', "It is a text."),
        ('<div class="sidebar-right"><article><p>It is a text.</p></article></div>', "It is a text."),
        ('<section class="market-share"><p>' + PROSE + "</p></section>", PROSE),
        ('<section class="share-bar"><p>' + PROSE + "</p></section>", ""),
        ('<article><p>Body of the text.</p></article><section class="related"><article><p>Other text.</p></article></section>', "Body of the text."),
        (f"<article><p>{PROSE}</p><a href=x><div>all of it is a link of the page</div></a></article>", PROSE),
        ("<article><p>One of the.<ul><li class=ad>Buy<li>point</ul><p>Two of the.</article>", "One of the.\npoint\nTwo of the."),
        ("<article><p>One of the.</p><p>cut <b", "One of the.\ncut"),
        ("<article><p>a &lt;b&gt; &copy; &#x41;&amp;amp;</p></article>", "a <b> © A&amp;"),
        ("<p>" + "The cat is on the mat and it is in the house. " * 6 + "</p><p><a href=x>all of the links in the menu are linked</a></p>", " ".join(["The cat is on the mat and it is in the house."] * 6)),
    ],
)
def test_html(page, text):
    assert html_text.extract(page) == text


def test_second_pass_takes_the_nearest_label():
    G, B, O = html_text.GOOD, html_text.BAD, html_text.OPEN
    assert html_text.second_pass([G, O, O, B, O]) == [G, G, B, B, B]
    assert html_text.second_pass([G, O, B]) == [G, G, B]
    assert html_text.second_pass([O, O]) == [O, O] and html_text.second_pass([]) == []


def test_second_pass_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        labels = rng.integers(-1, 2, rng.integers(0, 12)).tolist()
        want = []
        for i, x in enumerate(labels):
            near = sorted((abs(i - j), -y) for j, y in enumerate(labels) if y)
            want.append(x if x or not near else -near[0][1])
        assert html_text.second_pass(labels) == want


@pytest.mark.parametrize("unit", ["<button>", "<svg>x", "<li><div>", "<b>x", "<a href=x>", '<a "', "<i><b></i>", "<ul><li></li>", "</p>", "&amp;<", "<!-", "<td><div>"])
def test_html_work_is_linear(unit):
    import time

    began = time.process_time()
    html_text.extract("<article><p>It is a text.</p>" + unit * 60_000)
    assert time.process_time() - began < 5


def by_reading(page):
    """The article of the synthetic pages by their plain markup."""
    import html as h
    import re

    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    body = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav|footer|section|div)\b.*?</\1>", " ", body, flags=re.S)
    body = re.sub(r"</?(p|h[1-6]|ul|ol|li|blockquote|pre|table|tr|td)\b[^>]*>", "\n", body)
    lines = (" ".join(h.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group().startswith("<br") else "", x)).split()) for x in body.split("\n"))
    return "\n".join(x for x in lines if x)


def test_html_query(spark, sf):
    rows = {r["page_id"]: r for r in registry.op2_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages) == 50 and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert all(rows[p["page_id"]]["text"] == by_reading(p["html"].replace("\n", " ")) for p in pages)
    odd = spark.createDataFrame([(None, "u", "<p>" + PROSE), (1, None, None), (1, None, None), (2, "v", "<article>" + f"<p>{PROSE}</p>" * 9000 + "</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_pages(odd).orderBy("page_id", "text").collect()
    assert [(r["page_id"], r["url"], r["text"]) for r in got[:3]] == [(None, "u", PROSE), (1, None, ""), (1, None, "")] and got[3]["text"].count("\n") == 8999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(empty).count() == 0


# ------------------------------------------------------------------ op3


def brute_groups(fps, ids, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return [best[find(i)] for i in range(len(fps))]


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tbrown FOX Ü jumps over the the the dog"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("bucket", [512, 3])
def test_groups_against_brute_force(spark, bucket):
    """A dense cluster, chains and exact copies; a small bucket forces refinement."""
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for _ in range(120):
        base = fps[int(rng.integers(0, len(fps) if _ % 2 else 3))]
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            base ^= 1 << int(b)
        fps.append(base - 2**64 if base >= 2**63 else base + 2**64 if base < -(2**63) else base)
    fps += [0, 0, -1]
    ids = [int(i) for i in rng.permutation(len(fps))]
    df = spark.createDataFrame(list(zip(ids, fps, strict=True)), "id long, fp long")
    g = {r["fp"]: r["component"] for r in simhash.groups(df, bucket=bucket, hot=2 if bucket == 3 else 1 << 18).collect()}
    assert [g[f] for f in fps] == brute_groups(fps, ids)


def test_near_duplicates_edge_cases(spark):
    df = docs(spark, list(enumerate(TEXTS)) + [(0, None), (None, "one")])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r["component"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component"] for r in got if r["doc_id"] in (3, 11, None)} == {3}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component"] for r in got})
    assert simhash.keep_one(df.limit(0)).count() == 0


CLASH = "id fp root n row key text_ rows none best first component mask sub value same bands bucket hashes lang_ y z place draw item at data chunk seq kind shard bin pieces tokens length cluster start".split()


def clashing(spark, rows):
    """Texts with columns named like everything that operators use inside."""
    return docs(spark, rows).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def test_names_inside_operators_do_not_clash(spark):
    df = clashing(spark, list(enumerate(TEXTS)) + [(0, None), (None, "one")])
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 0)], "doc_id long, toxic int").withColumn("y", F.lit(1)).withColumn("id", F.lit(2))
    for out in (simhash.keep_one(df), simhash.keep_dissimilar(df), langid.keep_identified(df, langid.train(df, "lang")), toxicity.keep_clean(df, toxicity.train(df, labels, "toxic"), below=1.1)):
        assert out.columns == df.columns and out.count() > 0 and out.agg(F.max("best")).first()[0] == CLASH.index("best")
    assert simhash.near_duplicates(df, hot=1).count() == langid.predict(df, langid.train(df, "lang")).count() == toxicity.predict(df, toxicity.train(df, labels, "toxic")).count() == len(TEXTS) + 2
    marked = {(r["id"], r["key"]): (r["component"], r["n"]) for r in simhash.text_components(df, hot=1).collect()}
    assert marked[11, simhash.text_key("one")] == (3, 1) and marked[0, simhash.text_key("")] == (0, 2)
    assert ctw.score(df, "doc_id < 5").count() == bpe_stream.encode_decode(df, registry.tokenizer_path("word_bpe_49k.json")).count() == len(TEXTS) + 2


def test_keep_dissimilar_reaches_the_threshold(spark):
    """No two rows of similarity 0.8 or more stay, and none goes without a copy."""
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "null id")]
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((len(rows) + 1000, " ".join(base)))
        for edits in (1, 2, 3, 6):
            own = list(base)
            for at in rng.integers(0, len(own), edits):
                own[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows) + 1000, " ".join(own)))
    df = docs(spark, rows)
    out = simhash.keep_dissimilar(df)
    assert out.columns == df.columns and simhash.keep_dissimilar(df.limit(0)).count() == 0
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len(set(kept))
    alive = [rows.index(r) for r in kept]
    for n, i in enumerate(alive):
        assert all(simhash.jaccard(sets[i], sets[j]) < 0.8 for j in alive[:n])
    for i in set(range(len(rows))) - set(alive):
        assert any(simhash.jaccard(sets[i], sets[j]) >= 0.8 for j in range(len(rows)) if j != i)
    assert {i for i, _ in kept} >= {0, 3, 4}


# ------------------------------------------------------------------ op4, op5


def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[50:120] = x[0]  # a hot vector
    x[120] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [1.0]), (404, []), (None, [1.0] * 8), (440, [float(v) for v in x[7]])]
    short = np.eye(1, 8)
    every = np.float32(np.vstack([x, short, 0 * short, x[7]])).astype(float)
    names = ("score", "rank", "id", "vec", "key", "part", "data", "major", "block", "kind", "salt", "hits")
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))), every, np.array([*range(400), 403, 404, 440])


def test_exact_top_k(spark):
    df, x, ids = vectors(spark)
    z = np.floor(64 * x).astype(int)
    got = pivot_topk.top_k(df, segment=64, block=8).orderBy("query_id", "rank").collect()
    for q in ids[ids % 20 == 0]:
        s = z @ z[np.searchsorted(ids, q)]
        want = [(int(s[i]), int(ids[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [(r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == want
    assert pivot_topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in pivot_topk.top_k(few).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def test_hash_forest_recall(spark):
    df, x, ids = vectors(spark)
    got = hash_forest.search(df, segment=300, block=8).collect()
    hits = total = 0
    live = np.any(x != 0, axis=1)
    for q in ids[(ids % 20 == 0) & live]:
        s = x @ x[np.searchsorted(ids, q)]
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q and live[i]][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(s[np.searchsorted(ids, r["vec_id"])], abs=1e-12) for r in own)
        hits += len({r["vec_id"] for r in own} & set(want))
        total += 20
    assert hits / total >= 0.9
    assert not any(r["query_id"] == 120 or r["vec_id"] in (120, 404) for r in got)


def test_hash_forest_on_clusters(spark):
    """Where vectors have near neighbours a small share of each segment is enough."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(80, 32)), 50, axis=0) + 0.15 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in hash_forest.search(df, share=0.05, segment=2000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set([i for i in np.lexsort((np.arange(4000), -(x @ x[q]))) if i != q][:20]) for q in range(0, 4000, 20)}
    assert np.mean([len(got[q] & w) / 20 for q, w in want.items()]) >= 0.9


def test_queries_over_vectors_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    z = np.floor(64 * x).astype(np.int64)
    exact, near = (sorted(map(tuple, f(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) for f in (registry.op4_pivot_topk, registry.op5_hash_forest))
    want, hits = [], 0
    for q in np.sort(ids[ids % 20 == 0]):
        at = int(np.flatnonzero(ids == q)[0])
        s, t = z @ z[at], x @ x[at]
        top = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        want += [(int(q), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(top)]
        hits += len({int(ids[i]) for i in [i for i in np.lexsort((ids, -t)) if ids[i] != q][:20]} & {v for a, _, v, _ in near if a == q})
    assert exact == want and hits >= 0.9 * len(want)


# ------------------------------------------------------------------ op6


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe_stream.encode_decode(docs(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == tk.decode(ids, skip_special_tokens=False)
    small = bpe_stream.StreamingBPE(path, chunk=16)
    rng = np.random.default_rng(0)
    for word in ("th" * 900, "ing" * 500, "aaaaab" * 300, "".join(chr(97 + c) for c in rng.integers(0, 26, 3000)), "é" * 800):
        assert small.encode(word) == tk.encode(word, add_special_tokens=False).ids
    assert 1 < small.lookahead < 10_000
    parts = ["a", "É", "e\u0301", "\u0301", " ", "  ", " \u0301", "\n", "'s", "don't", "12", "--", "Σ", "中", "<|endoftext|>", "fi"]
    for _ in range(400):  # slices of any size give the ids of the whole text
        text = "".join(rng.choice(parts, 60))
        assert [i for ids in small.stream(text, int(rng.integers(1, 30))) for i in ids] == tk.encode(text, add_special_tokens=False).ids
    assert max(map(len, small.slices("ab " * 1000, 50))) <= 53
    odd = bpe_stream.encode_decode(docs(spark, [(None, "x y"), (None, "x y"), (1, None)]), path).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in odd)[0][1] == 2 and len(odd) == 3
    assert bpe_stream.encode_decode(docs(spark).limit(0), path).count() == 0


def test_decoder_takes_any_split():
    d = bpe_stream.TextDecoder({1: "Ã", 2: "©", 3: "x"}, {c: b for b, c in enumerate(bpe_stream.byte_symbols())}, True)
    assert d.feed([1]) + d.feed([2, 3]) + d.finish() == "éx"
    assert d.feed([1]) + d.feed([3]) + d.finish() == "�x"


# ------------------------------------------------------------------ op7, op10


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.op7_language_id(spark, sf).collect()}
    rows = [(r["doc_id"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = [(i, x) for i, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.97


def test_language_id_edge_cases(spark):
    df = docs(spark)
    model = langid.train(df, "lang")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3] == ("en", 1.0)
    odd = docs(spark, [(1, "½ ² Ⅷ 12"), (None, "word"), (2, "½a")])
    assert [r["lang_pred"] for r in langid.predict(odd, model).orderBy("doc_id").collect()] == ["en", "und", "en"]
    empty = langid.train(df.limit(0), "lang")
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.keep_identified(df, model).columns == df.columns and langid.keep_identified(df.limit(0), model).count() == 0
    two = langid.LanguageModel(["a", "b"], [math.log(0.5)] * 2, (["x", "y"], np.eye(2)), (["zz", "aa"], np.array([[0, 3], [3, 0]])), (2, 1))
    assert langid.Scorer(two).predict("x")[0] == "a" and langid.Scorer(two).predict("qzzq")[0] == "b" and langid.Scorer(two).predict("x y")[0] == "a"


def test_words_are_runs_of_letters():
    import unicodedata

    draw = np.random.default_rng(6)
    chars = [chr(c) for c in (*range(0x20, 0x250), *draw.integers(0x250, 0x20000, 600).tolist()) if not 0xD800 <= c < 0xE000]
    for size in (0x230, len(chars)):
        for _ in range(300):
            text = "".join(draw.choice(chars[:size], 30))
            level = text.lower()
            want = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in level).split()
            assert langid.words_of(text) == want


def test_language_model_by_definition(spark):
    """Counts, smoothing and backoff written out for a small table."""
    rows = [(1, "a b b", "x"), (2, "b cd", "y"), (3, "ef", "y"), (4, None, "x"), (5, "zz", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang")
    assert model.langs == ["x", "y"] and model.prior.tolist() == pytest.approx([math.log(0.5)] * 2)
    n = {"a": (1, 0), "b": (2, 1), "cd": (0, 1), "ef": (0, 1)}
    for w, c in n.items():
        want = [math.log((c[i] + 0.5) / (3 + 2)) for i in range(2)]
        assert model.table[model.row[w]].tolist() == pytest.approx([v - max(want) for v in want], abs=1e-6)
    grams = Counter()
    for w, c in n.items():
        for g in {1: w, 2: [f" {w} "[i : i + 2] for i in range(len(w) + 1)], 3: [f" {w} "[i : i + 3] for i in range(len(w))], 4: [f" {w} "] if len(w) == 2 else []}.items():
            for x in g[1]:
                for i in range(2):
                    grams[x, i] += c[i] > 0
    assert set(model.gram_row) == {g for g, _ in grams}
    total = [sum(k for (_, i), k in grams.items() if i == j) for j in range(2)]
    rows = [[math.log((grams[g, i] + 0.5) / (total[i] + 0.5 * len(model.gram_row))) for i in range(2)] for g in ("c", "b")]
    want = 0.5**4 * np.mean([[v - max(r) for v in r] for r in rows], axis=0)
    assert model.backoff("qcbq").tolist() == pytest.approx(want.tolist(), abs=1e-6)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in registry.op10_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    flagged = [i for i in held if got[i]["predicted"]]
    assert np.mean([labels[i] for i in flagged]) > 0.85
    assert sum(labels[i] for i in flagged) > 0.8 * sum(labels[i] for i in held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_machine_learns_interactions():
    """Two words that only mean something together."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*(rng.integers(10, 60, 5)), *([1] if a else []), *([2] if b else [])})))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y), np.ones(len(y)), epochs=40)
    z = [m.margin([m.place[t] for t in s]) for s in ([1, 2], [1], [2])]
    assert z[0] > 1 > 0 > max(z[1:])
    v = m.factors[[m.place[1], m.place[2]]]
    by_pairs = m.bias + m.linear[[m.place[1], m.place[2]]].sum() + v[0] @ v[1]
    assert z[0] == pytest.approx(by_pairs)


def test_terms_reach_inflected_words():
    train = [("you are a scumbag", 1), ("what a scumbag he is", 1), ("a nice day", 0), ("he is a good man", 0)] * 20
    m = toxicity.fit([toxicity.slots(t, 20) for t, _ in train], np.array([float(y) for _, y in train]), np.ones(len(train)))
    assert m.score("those scumbags") > 0.5 > m.score("those good men")
    assert toxicity.terms("Scumbags ½") == {"scumbags", "^scumb", "½"} and toxicity.terms(None) == set()
    by_pairs = lambda r: m.bias + m.linear[r].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(r) for b in r[:i])
    rows = m.rows("what a good scumbag")
    assert m.margin(rows) == pytest.approx(by_pairs(rows))


def test_rare_terms_and_noise_do_not_decide():
    rng = np.random.default_rng(1)
    rows = [np.array(sorted({*rng.integers(10, 40, 4), *([1] if k % 2 else [])})) for k in range(200)]
    rows[1] = np.append(rows[1], 99)  # in one row only
    m = toxicity.fit(rows, np.arange(200) % 2.0, np.ones(200))
    assert 99 not in m.place and abs(m.linear[m.place[1]]) > 5 * np.abs(np.delete(m.linear, m.place[1])).max()


def test_machine_learns_pairs_of_neutral_terms():
    """Each of two terms is as frequent in both classes; together they tell."""
    rng = np.random.default_rng(4)

    def draw(n):
        rows, y = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            rows.append(np.array(sorted({*(rng.integers(10, 60, 5)), *([1] if a else []), *([2] if b else [])})))
            y.append(float(a == b))
        return rows, np.array(y)

    rows, y = draw(4000)
    m = toxicity.fit(rows, y, np.ones(len(y)), epochs=40)
    rows, y = draw(500)
    z = np.array([m.margin([m.place[t] for t in r.tolist()]) for r in rows])
    assert np.mean((z > 0) == y) > 0.9


def test_toxicity_edge_cases(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(df, model).collect()}
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    none = toxicity.train(df, labels.limit(0), "toxic")
    assert all(r["score"] < 1e-6 for r in toxicity.predict(df, none).collect())
    assert toxicity.keep_clean(df.limit(0), model).count() == 0


# ------------------------------------------------------------------ op8


def test_packing_by_brute_force():
    """The first compatible bin in residual order, searched naively."""
    rng = np.random.default_rng(1)
    n, cap = 300, 100
    lengths = rng.integers(0, 260, n).tolist()
    sources = [None if x == 9 else f"s{min(x, 4)}" for x in rng.integers(0, 10, n)]
    clusters = [None if x == 0 else int(x) for x in rng.integers(0, 40, n)]
    got = packing.pack_rows(list(range(n)), lengths, sources, clusters, cap)
    bins, want = [], {}
    rest = sorted(((x % cap, r) for r, x in enumerate(lengths) if x % cap or not x), key=lambda t: (-t[0], t[1]))
    for x, r in rest:
        best = None
        for b, (used, ss, cs) in enumerate(bins):
            if cap - used >= x and (sources[r] is None or sources[r] not in ss) and (clusters[r] is None or clusters[r] not in cs):
                if best is None or (cap - used, b) < (cap - bins[best][0], best):
                    best = b
        if best is None:
            best = len(bins)
            bins.append((0, set(), set()))
        used, ss, cs = bins[best]
        want[r] = (best, used)
        bins[best] = (used + x, ss | {sources[r]}, cs | {clusters[r]})
    full = sum(x // cap for x in lengths)
    last = {r: (b - full, at) for r, p, start, k, b, at in got if start + k == lengths[r] and (lengths[r] % cap or not lengths[r])}
    assert last == want
    cover = Counter()
    for r, _, _, k, _, _ in got:
        cover[r] += k
    assert all(cover[r] == x for r, x in enumerate(lengths))


@pytest.mark.parametrize("tokenizer", [None, "byte_bpe_50k.json"])
def test_sequences_hold_every_text(spark, tokenizer):
    """Pieces put together are the texts; no sequence holds a source or a cluster twice."""
    rows = [(i, t) for i, t in enumerate(TEXTS) if t != LONG] + [(50, LONG[:9000]), (3, "one"), (3, "one"), (None, "x"), (None, "x")]
    df = clashing(spark, rows).withColumn("source", F.when(F.col("doc_id") != 4, F.concat(F.lit("s"), F.pmod("doc_id", F.lit(5)))))
    clusters = simhash.text_components(df).withColumn("component", F.when(F.col("id") < 3, 1))
    path = registry.tokenizer_path(tokenizer) if tokenizer else None
    width, cap = (4, 700) if tokenizer else (1, 1000)
    files = packing.write_sequences(df, clusters=clusters, tokenizer=path, capacity=cap, shard=8)
    if tokenizer:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        coded = lambda t: np.array(tk.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    else:
        coded = lambda t: (t or "").encode()
    found, names = Counter(), set()
    docs_of: dict = {}
    for r in spark.read.parquet(files).collect():
        assert (r["shard"], r["bin"]) not in names and len(r["tokens"]) <= cap * width and len(r["tokens"]) == width * sum(p["length"] for p in r["pieces"])
        names.add((r["shard"], r["bin"]))
        ids = [p["id"] for p in r["pieces"] if p["id"] is not None]
        own = [i % 5 for i in ids if i != 4]
        assert len(own) == len(set(own)) and sum(i < 3 for i in ids) <= 1
        for p in r["pieces"]:
            docs_of.setdefault(p["id"], []).append((p["start"], bytes(r["tokens"][p["offset"] * width : (p["offset"] + p["length"]) * width])))
    for i, t in rows:
        found[i, coded(t)] += 1
    for i, parts in docs_of.items():
        whole = [t for (k, t), n in found.items() for _ in range(n) if k == i]
        if len(whole) == 1:
            assert b"".join(x for _, x in sorted(parts)) == whole[0]
        else:
            assert sorted(x for _, x in parts) == sorted(whole)
    assert set(docs_of) == {i for i, _ in rows}
    assert packing.read_pieces(spark, files, width).where("piece_length >= 0").count() == sum(map(len, docs_of.values()))
    assert packing.read_pieces(spark, packing.write_sequences(df.limit(0))).count() == 0
    # an id and text of many rows
    same = spark.range(40).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    got = packing.read_pieces(spark, packing.write_sequences(same, clusters=simhash.text_components(same), shard=10)).collect()
    assert len(got) == 40 == len({(r["shard"], r["bin"]) for r in got}) and len({r["shard"] for r in got}) > 1


def test_packing_query(spark, sf):
    """The whole table: pieces cover every text, and sequences respect both bitmaps."""
    rows = registry.op8_best_fit_packing(spark, sf).collect()
    docs_ = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    group = {r["doc_id"]: r["component_id"] for r in registry.op3_simhash(spark, sf).collect()}
    cover, used, seen = Counter(), Counter(), Counter()
    for r in rows:
        text = (docs_[r["doc_id"]]["text"] or "").encode()
        assert zlib.crc32(text[r["piece_start"] : r["piece_start"] + r["piece_length"]]) == r["piece_crc32"]
        cover[r["doc_id"]] += r["piece_length"]
        used[r["shard"], r["bin"]] += r["piece_length"]
        for what in (docs_[r["doc_id"]]["source"], group[r["doc_id"]]):
            seen[r["shard"], r["bin"], type(what), what] += what is not None
    assert all(cover[i] == len((r["text"] or "").encode()) for i, r in docs_.items()) and set(cover) == set(docs_)
    assert max(used.values()) <= 16_384 and max(seen.values()) == 1


# ------------------------------------------------------------------ op9


def test_base_score_by_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "null id")]
    df = docs(spark, rows)
    got = ctw.score(df, "doc_id % 2 = 1").collect()
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in rows if i is not None and i % 2 for w in tok(t))
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        w = tok(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert ctw.score(df.limit(0), "true").count() == 0
    blank = ctw.score(df, "doc_id < 0").collect()
    assert all(r["score"] == pytest.approx(8 * math.log10(0.5) * (len((text[r["doc_id"]] or "").encode()) + 1), rel=1e-6) for r in blank)


def tree_by_recursion(texts, depth):
    """The mixture computed node by node with dictionaries: a function of past, byte."""
    counts, children = {}, {}
    for t in texts:
        s = b"\0" * depth + t + b"\xff"
        for p in range(depth, len(s)):
            for k in range(8):
                for d in range(depth + 1):
                    key = (s[p - d : p], (s[p] >> (8 - k)) | 1 << k)
                    z = counts.setdefault(key, [0, 0])
                    z[s[p] >> (7 - k) & 1] += 1
                    if d:
                        children.setdefault((key[0][1:], key[1]), set()).add(key)
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = pe(*counts[key])
            memo[key] = own if len(key[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(map(weighted, children[key])))
        return memo[key]

    def predict(past, pre, bit, d=0):
        key = (past[len(past) - d :], pre)
        if key not in counts:
            return 0.5
        z = counts[key]
        kt = (z[bit] + 0.5) / (sum(z) + 1)
        if d == depth:
            return kt
        w = math.exp(math.log(0.5) + pe(*z) - weighted(key))
        return w * kt + (1 - w) * predict(past, pre, bit, d + 1)

    def log10(t):
        s, total = b"\0" * depth + t + b"\xff", 0.0
        for p in range(depth, len(s)):
            for k in range(8):
                total += math.log10(predict(s[p - depth : p], (s[p] >> (8 - k)) | 1 << k, s[p] >> (7 - k) & 1))
        return total

    return log10


@pytest.mark.parametrize("depth", [1, 2, 4, 5])
def test_context_tree_by_recursion(depth):
    texts = [b"abracadabra", b"abba", b"", b"the cat sat on the mat"]
    log10 = tree_by_recursion(texts, depth)
    for t in (b"abra", b"zzz", b"", b"caddy", b"the hat"):
        own, sizes = ctw.byte_strings([t], depth)
        u, n = np.unique(np.concatenate([ctw.byte_strings(texts, depth)[0], own]), return_counts=True)
        n -= np.bincount(np.searchsorted(u, own), minlength=len(u))
        logs = ctw.string_logs(u, n, depth)
        assert logs[np.searchsorted(u, own)].sum() == pytest.approx(log10(t))


def test_context_tree_query_by_recursion(spark):
    """Many chunks and buckets give what one tree gives."""
    rng = np.random.default_rng(3)
    words = ["the", "cat", "dög", "sat", "on", "mat", "xyz"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, "doc_id % 3 <> 0", chunk=500).collect()}
    log10 = tree_by_recursion([t.encode() for i, t in rows if i % 3], 5)
    assert all(got[i] == pytest.approx(log10(t.encode()), rel=1e-6) for i, t in rows)


def test_lookup_and_packing_of_strings():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    values = rng.random(len(codes)).astype("<f4")
    assert (ctw.Lookup(codes, values)(codes[::-1]) == values[::-1]).all()
    c, v = ctw.unpack_strings(ctw.pack_strings(codes, values), "<f4")
    assert (c == codes).all() and (v == values).all()
    assert len(ctw.unpack_strings(ctw.pack_strings(codes[:0], values[:0]), "<f4")[0]) == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [d.count()]
    for name, stage in cp.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(d.count())
    assert kept[0] >= kept[1] >= kept[2] > kept[3] > 0.7 * kept[0]
    assert len({hashlib.md5((r["text"] or "").encode()).hexdigest() for r in d.collect()}) == kept[3]
    packed = cp.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == kept[3]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    assert packed.agg(F.sum("piece_length")).first()[0] == sum(len(tk.encode(r["text"] or "", add_special_tokens=False).ids) for r in d.collect())
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_batches_equal_the_library():
    parts = ["a", "foo", "don", "'s", "'t", ".", ",", "12", "é", "日本", "\n", "\n\n", " ", "  ", "\t", "\x01", "\x1c", "\x85", "\xa0", "<|endoftext|>", "😀", "²", "\x00", "_", "?"]
    draw = np.random.default_rng(7)
    texts = ["".join(draw.choice(parts, draw.integers(0, 14))) for _ in range(5000)] + ["", " ", ".", "x" * 70]
    encoder = token_files.PieceEncoder(registry.tokenizer_path("byte_bpe_50k.json"))
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_batch(pa.array(texts))] == [e.ids for e in whole]
    assert encoder.encode_batch(pa.array([], pa.string())) == []
    for part in (pa.array(texts).slice(17, 400), pa.array(["", ""]), pa.array(["x"]).slice(1)):
        want = encoder.tokenizer.encode_batch(part.to_pylist(), add_special_tokens=False)
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_batch(part)] == [e.ids for e in want]
