"""Vector search, WARC bundles and main-text extraction."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import ann, html_extract, topk, warc
from lodestone.llm.common import scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def awkward_vectors(spark, n=600, dims=16, copies=150):
    """Clusters, many copies of one vector, nulls, zeros, non-finite and short vectors, repeated and null ids."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, dims))
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x.astype(np.float32))]
    rows += [(1000, None, 1), (1050, [0.0] * dims, None), (1100, [float("nan")] * dims, 1), (1150, [1.0, None], 1), (1200, [float("inf")] * dims, 1), (1250, [0.5, 0.5], 1), (1300, [], 1), (None, [1.0] * dims, 1), rows[3], rows[50]]
    return spark.createDataFrame(rows, VECTORS)


def dense(rows, dims):
    out = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        out[r.vec_id] = np.array(list(v) + [0.0] * (dims - len(v)), dtype=np.float64)
    return out


def test_topk_equals_brute_force(spark):
    vectors = awkward_vectors(spark)
    v = {k: np.floor(256 * x).astype(np.int64) for k, x in dense(vectors.collect(), 16).items()}
    got = defaultdict(list)
    for r in topk.search(vectors.withColumn("v", F.lit(1)).withColumn("list", F.lit(2)), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {k for k in v if k % 50 == 0}
    for q, found in got.items():
        assert found == sorted(((k, int(v[q] @ x)) for k, x in v.items() if k != q), key=lambda t: (-t[1], t[0]))[:5]


def test_topk_small_and_empty(spark):
    rows = spark.createDataFrame([(0, [1.0], 1), (50, [-1.0], 1), (3, [0.5], 1)], VECTORS)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 32768), (0, 2, 50, -65536), (50, 1, 3, -32768), (50, 2, 0, -65536)]
    assert topk.search(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_large_components(spark):
    """Scores are those of Python integers; what no long holds is given as its end, in the right order."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 6)) * np.where(np.arange(80) % 4 == 0, 3e6, 1.0)[:, None]
    rows = [(i, [float(c) for c in r.astype(np.float32)], 1) for i, r in enumerate(x)] + [(100, [3e6, 0.0], 1), (101, [2e6, 0.0], 1), (200, [3e9] * 4, 1), (250, [3e12, 1e-3], 1)]
    v = {i: [int(np.floor(256 * float(np.float32(c)))) for c in r] for i, r, _ in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    got = defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 200, 250}
    for q, found in got.items():
        want = sorted(((i, dot(v[q], x)) for i, x in v.items() if i != q), key=lambda t: (-t[1], t[0]))[:5]
        assert found == [(i, max(-(1 << 63), min((1 << 63) - 1, s))) for i, s in want]
    two = spark.createDataFrame([(0, [1.0], 1), (1, [3e6], 1), (2, [2e6], 1)], VECTORS)
    assert [(r.vec_id, r.score) for r in topk.search(two, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 256 * 768_000_000), (2, 256 * 512_000_000)]


def test_ann_recall_and_exact_scores(spark):
    vectors = awkward_vectors(spark)
    v = {k: x for k, x in dense(vectors.collect(), 16).items() if np.linalg.norm(x) > 0}
    got = defaultdict(list)
    for r in ann.search(vectors.withColumn("bucket", F.lit(1)), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert abs(r.score - v[r.query_id] @ v[r.vec_id]) < 1e-12
    assert set(got) == {k for k in v if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0])) and len({k for k, _ in found}) == 20
        best = sorted((k for k in v if k != q), key=lambda k: (-round(float(v[q] @ v[k]), 12), k))[:20]
        hits += len(set(best) & {k for k, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert [k for k, _ in got[20]] == [k for k in range(21) if k != 20][:20]  # copies: ties to the smaller id


def test_ann_uneven_norms_and_empty(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8) * (1 + i % 5)], 1) for i in range(300)], VECTORS)
    v = dense(rows.collect(), 8)
    got = defaultdict(set)
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, k=10).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & set(sorted((k for k in v if k != q), key=lambda k: -(v[q] @ v[k]))[:10])) for q in got)
    assert len(got) == 15 and hits / 150 >= 0.9
    assert ann.search(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_heavy_tailed_norms_and_small_tables(spark):
    """One vector of 100 times the norm, norms over many powers of two, fewer rows than k."""
    rng = np.random.default_rng(6)
    norms = np.exp(rng.standard_normal(600))
    norms[5] = 100 * norms.max()
    x = rng.standard_normal((600, 64))
    x *= (norms / np.linalg.norm(x, axis=1))[:, None]
    vectors = spark.createDataFrame([(i, [float(c) for c in r], 1) for i, r in enumerate(x.astype(np.float32))], VECTORS)
    v = dense(vectors.collect(), 64)
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 30 and all(len(set(f)) == 20 for f in got.values())
    hits = sum(len(set(got[q]) & set(sorted((k for k in v if k != q), key=lambda k: -(v[q] @ v[k]))[:20])) for q in got)
    assert hits / 600 >= 0.9
    few = ann.search(vectors.where("vec_id < 15"), F.col("vec_id") % 5 == 0)
    assert {(r.query_id, r.rank) for r in few.collect()} == {(q, i) for q in (0, 5, 10) for i in range(1, 15)}
    assert ann.search(vectors.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    tiny = spark.createDataFrame([(i, [1e-30 * (i + 1), 1e-30], 1) for i in range(6)] + [(9, [1e30, -1e30], 1)], VECTORS)
    assert ann.search(tiny, F.col("vec_id") == 0, k=3).count() == 3 and ann.search(tiny, F.col("vec_id") == 9, k=9).count() == 6


def test_warc_round_trip(spark):
    same, big = "s" * 1000, "é" * 700_000
    rows = [(1, "http://a/x y\n", same), (5, None, same), (3, "u", same), (2, "u", "short"), (9, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", same), (5, "v", same)]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc-test")
    warc.write(pages, path)
    bundles = spark.read.parquet(path)
    got = warc.read(bundles, with_payload=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = defaultdict(set)
    for r in got:
        kinds[r.page_id].add((r.record_type, r.refers_to))
    assert kinds[5] == {("response", None)} and kinds[1] == kinds[3] == kinds[None] == {("revisit", 5)}
    assert kinds[7] == {("revisit", 8)} and kinds[2] == kinds[9] == kinds[4] == {("response", None)}
    assert all(bytes(r.payload).decode() == h for r in got for i, _, h in rows if r.page_id == i == 120)
    wanted = warc.index(bundles).where("page_id in (8, 120)").select("record_id")
    assert sorted((r.page_id, len(r.payload)) for r in warc.fetch(bundles, wanted).collect()) == [(8, 1_400_000), (120, 450)]
    empty = scratch(spark, "warc-empty")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark.read.schema(warc.BUNDLE_SCHEMA).parquet(empty)).count() == 0


def test_warc_frames_decode_alone():
    import io

    import zstandard

    w = warc.BundleWriter(3)
    for i in range(50):
        w.add(f"<r{i}>", i, f"record {i} ".encode() * 2000)
    batch = w.finish("b").to_pylist()[0]
    spans = warc.frame_spans(batch["content"])
    assert len(spans) > 1
    e = batch["entries"][37]
    at, size = spans[e["frame"]]
    raw = zstandard.ZstdDecompressor().decompress(batch["content"][at : at + size])
    assert raw[e["offset"] : e["offset"] + e["length"]] == b"record 37 " * 2000
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(batch["content"]), read_across_frames=True).read()
    assert whole.startswith(b"record 0 ") and whole.endswith(b"record 49 ")  # the footer is skippable


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div>
<article><h1>The  title&nbsp;here</h1><p><b>First &amp; second<br>line &#233;<p>Third <i>para</i>graph &lt;x&gt; with quite a few words in it.</p><p> </p></article>
<section class="comments"><p>I am a comment.</p></section><footer>&copy; foot</footer></body></html"""


def test_blocks():
    found = [(b.text, b.path[-1][0]) for b in html_extract.blocks_of(PAGE)]
    assert found == [("menu one", "li"), ("menu two", "li"), ("Buy now.", "div"), ("The title here", "h1"), ("First & second line é", "p"), ("Third paragraph <x> with quite a few words in it.", "p"), ("I am a comment.", "p"), ("© foot", "footer")]
    assert html_extract.blocks_of(None) == html_extract.blocks_of("") == html_extract.blocks_of("<div") == []
    assert [b.text for b in html_extract.blocks_of("a < b <p class='x>y'>c</p> <p a=\"")] == ["a < b", "c"]


def test_blocks_of_odd_markup():
    """A trailing slash closes nothing but foreign elements; formulas are text; fallbacks of objects keep their path."""
    texts = lambda h: [b.text for b in html_extract.blocks_of(h)]
    assert texts('<p>a</p><script src="a.js"/>var x=1;</script><p>b</p>') == ["a", "b"]
    assert [b.path[0][0] for b in html_extract.blocks_of("<article data-u=/a/><p>x</p></article>")] == ["article"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>") == ["Let x=2 hold"]
    found = html_extract.blocks_of("<p>a<object>one<object>two</object>three</object></p>b")
    assert [b.text for b in found] == ["a", "one", "two", "three", "b"] and all(("object" in [t for t, _ in b.path]) == (b.text in ("one", "two", "three")) for b in found)
    assert texts("<p>a<noscript>turn it on</noscript><svg/><template><p>t</p></template>b</p>") == ["a b"]


#: Pages labelled by hand: (html, main text).  Their skeletons are neither of the table nor of the made pages.
HAND = [
    ('<body><div id="top-nav"><a href="/">Home</a> <a href="/n">News</a></div><div class="wrap"><div class="content"><h2>On rivers</h2><p>The river bends twice before it meets the sea, and the town lies in the second bend.</p><p>Boats were built here until the harbour silted up in the spring of that year.</p></div><div class="sidebar"><h4>More</h4><ul><li><a href="/x">Old maps</a></li><li><a href="/y">Tide tables</a></li></ul></div></div><div class="footer">All pages by the town archive</div></body>',
     ["On rivers", "The river bends twice before it meets the sea, and the town lies in the second bend.", "Boats were built here until the harbour silted up in the spring of that year."]),
    ('<body><header><h1>Weekly letter</h1><nav><a href="/">Start</a></nav></header><main><h1>How bread rises</h1><p>Yeast eats sugar and gives off gas, which the dough holds in small bubbles.</p><ol><li>Mix flour and water.</li><li>Wait for an hour in a warm place.</li></ol><aside class="promo"><p>Order our knives now</p></aside><p>After baking the crumb keeps the shape that the bubbles had.</p></main><section class="comments"><p>Great, thanks!</p></section><footer><p>Contact</p></footer></body>',
     ["How bread rises", "Yeast eats sugar and gives off gas, which the dough holds in small bubbles.", "Mix flour and water.", "Wait for an hour in a warm place.", "After baking the crumb keeps the shape that the bubbles had."]),
    ('<body><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Stone walls</h1><p>A dry wall has no mortar; every stone carries the next one.</p><blockquote>Two stones over one, one over two.</blockquote><div class="ad">Buy gravel today.</div><p>Frost moves such a wall but seldom breaks it.</p></article><div class="related"><ul><li><a href="/w">Hedges</a></li></ul></div><form><label>Mail</label><button>Send</button></form></body>',
     ["Stone walls", "A dry wall has no mortar; every stone carries the next one.", "Two stones over one, one over two.", "Frost moves such a wall but seldom breaks it."]),
]


def test_pages_labelled_by_hand(spark):
    """Labels of another hand than the teacher's: nearly every block of pages that training never saw."""
    pages = spark.createDataFrame([(i, "u", PAGE.replace("Third", f"Third{i}")) for i in range(20)], "page_id long, url string, html string")
    weights = html_extract.train(pages)
    rows = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(HAND)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(rows, weights).collect()}
    wrong = sum(len(set(got[i]) ^ set(want)) for i, (_, want) in enumerate(HAND))
    total = sum(len(html_extract.blocks_of(h)) for h, _ in HAND)
    assert wrong <= 0.1 * total, got


def test_long_pages_in_stretches():
    """A page of many blocks gets the chances that one pass gives, in bounded memory."""
    import time

    rng = np.random.default_rng(2)
    model = html_extract.Labeller(seed=2)
    page = [html_extract.Block((("p", ()),), f"word {rng.integers(9)} more.", 0) for _ in range(5000)]
    whole = model.chances([html_extract.vectors_of(page)])[0]
    assert np.allclose(model.long_chances(page, 700), whole, atol=1e-5)
    began = time.time()
    assert len(model.long_chances(page * 10)) == 50_000 and time.time() - began < 60


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    pages = [rng.standard_normal((n, html_extract.DIMS)).astype(np.float32) for n in (4, 2)]
    labels = [np.array([1, 0, 1, 0], dtype=np.float32), np.array([0, 1], dtype=np.float32)]
    model = html_extract.Labeller(seed=1)

    def loss():
        c = np.concatenate(model.chances(pages)).astype(np.float64)
        y = np.concatenate(labels)
        return -(y * np.log(c) + (1 - y) * np.log(1 - c)).mean()

    grad = model._gradients(pages, labels)
    for name in model.w:
        flat = model.w[name].reshape(-1)
        at = int(rng.integers(len(flat)))
        keep = flat[at]
        flat[at] = keep + 1e-2
        up = loss()
        flat[at] = keep - 1e-2
        down = loss()
        flat[at] = keep
        assert abs((up - down) / 2e-2 - grad[name].reshape(-1)[at]) < 2e-3


def test_extraction_of_pages(spark):
    rows = [(i, f"u{i}", PAGE.replace("Third", f"Third{i}"), "x") for i in range(40)] + [(100, None, None, None), (101, "u", "", "x"), (102, "u", "<nav>only a menu</nav>", "x"), (3, "again", PAGE, "x"), (103, "u", PAGE.replace("quite", "quite " * 60_000), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_extract.train(pages)
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(pages, weights).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i, f"u{i}"] == f"The title here\nFirst & second line é\nThird{i} paragraph <x> with quite a few words in it."
    assert got[100, None] == got[101, "u"] == got[102, "u"] == "" and len(got[103, "u"]) > 360_000
    assert html_extract.extract(pages.limit(0), weights).count() == 0


def test_held_out_skeletons():
    rng, xs, ys = np.random.default_rng(4), [], []
    while len(xs) < 460:
        found, y = html_extract.synthetic_page(rng)
        if len(found) == len(y) and found:
            xs.append(html_extract.vectors_of(found))
            ys.append(y)
    model = html_extract.Labeller().fit(xs[:400], ys[:400])
    right = np.concatenate([(c >= 0.5) == (y > 0.5) for c, y in zip(model.chances(xs[400:]), ys[400:], strict=True)])
    assert right.mean() > 0.97
