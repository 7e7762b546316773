"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phaseflux.llm import byte_bpe, embedding_dedup, exact_dedup, html_text, language_id, minhash_dedup, packing, quality, substring_dedup, url_filter
from phaseflux.llm.queries import RULES, vocabulary
from phaseflux.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept int, component_id string, ord string, digest string, count int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(rng.choices(words, k=40))
    out = []
    for i, x in enumerate(base):
        y = x.split()
        out += [x, x, x.upper(), " ".join(y[:-1] + ["z"]), f"{x} {shared} tail{i}"]
    out += [None, None, "", "  \n\t ", "one", "One", "a  b\nc", "a b c", "a b c ", "long " * 30_000, "'s don't é中 x", " ".join(rng.choices(words, k=20_000))]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "o", "d", 2) for i, t in rows], DOCS).repartition(3)


def reached(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_exact(spark, texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, texts), Scratch(spark)).collect()}
    assert got == want
    kept = exact_dedup.keep_exact(frame(spark, [*texts, *texts[:9], (None, "new"), (None, "new"), (None, texts[0][1])]), Scratch(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*(min(g) for g in groups.values()), None], key=str)
    assert kept.columns == frame(spark, texts).columns


def test_perfect_hash():
    for n in (1, 2, 7, 5000):
        d = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
        seeds, slots = exact_dedup.build(d)
        assert sorted(slots.tolist()) == list(range(n))
        index = {"size": n, "seeds": seeds.tobytes(), "digests": d[np.argsort(slots)].tobytes()}
        assert (exact_dedup.locate(index, d) == slots).all()
        assert (exact_dedup.locate(index, np.random.default_rng(99).integers(0, 256, (50, 32), dtype=np.uint8)) == -1).all()


def test_near(spark, texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, reached(len(sets), links), strict=True))}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_dedup(frame(spark, [*texts, (None, "x y")]), Scratch(spark), size=2).collect()}
    assert got.pop(None) == (1, None, False)
    assert got == want
    assert sorted(r.doc_id for r in minhash_dedup.keep_near(frame(spark, texts), Scratch(spark), size=2).collect()) == [i for i, x in want.items() if x[2]]


def test_near_family(spark):
    """A large family of versions, linked and just not linked, that share many buckets, beside repeated and short texts."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = []
    for _ in range(220):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 14)), replace=False):
            w[at] = f"w{rng.integers(0, 400)}"
        rows.append(" ".join(w))
    rows = list(enumerate([*rows, *rows[:5], *(f"w1 w2 w{i}" for i in range(30))]))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_dedup(frame(spark, rows), Scratch(spark), size=2).collect()}
    assert got == dict(enumerate(reached(len(sets), links)))
    # the join of open sets alone finds every link between components
    held = [(i, i, np.sort(np.array([hash(x) & (1 << 63) - 1 for x in s], np.uint64)).tobytes()) for i, s in enumerate(sets)]
    open_ = spark.createDataFrame([(i, c, bytearray(x)) for i, c, x in held], "doc_id long, component long, items binary")
    pairs = {(r.b, r.a) for r in minhash_dedup._meeting(open_, Scratch(spark), 80).collect()}
    assert set(links) <= pairs and len(pairs) < len(sets) * (len(sets) - 1) / 2


def test_substring(spark, texts):
    words = {i: (t or "").encode().split() for i, t in texts}
    first, want = {}, {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(frame(spark, texts), Scratch(spark)).collect()}
    assert got == want
    cut = {r.doc_id: r.text for r in substring_dedup.cut_spans(frame(spark, texts), Scratch(spark)).collect()}
    assert cut == {i: t if not want[i][1] else want[i][2] for i, t in texts if not want[i][1] or want[i][2]}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(b + rng.standard_normal(16) * s).tolist() for b in base for s in (0, 0, 0.05, 0.15, 0.3)]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0] * 3, [2.0] * 3, [1e200] * 16, [1.0] * 16, [1e-200] * 16, [2.0] * 16, [5e-324] * 16, [3.0] * 16]
    labels = [i % 2 for i in range(len(rows))]
    labels[4] = None
    data = [(i, v, y, 0) for i, (v, y) in enumerate(zip(rows, labels, strict=True))]
    def ok(v):
        return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if labels[i] is not None and labels[i] == labels[j] and ok(rows[i]) and ok(rows[j]) and len(rows[i]) == len(rows[j]):
                a, b = (np.array(x) / np.abs(x).max() for x in (rows[i], rows[j]))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    assert len(links) > 100
    comp = reached(len(rows), links)
    counts = np.bincount(np.array(links).ravel(), minlength=len(rows))
    frame_ = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, rank int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame_, Scratch(spark), full=20, window=8, block=16).collect()}
    assert got == {i: (counts[i], comp[i], comp[i] == i) for i in range(len(rows))}


def test_embedding_family(spark):
    """One label with more near, unequal vectors than any sorted neighbourhood, and pairs that stand alone; others beside it."""
    rng = np.random.default_rng(5)
    family = rng.standard_normal(24) + rng.standard_normal((14_000, 24)) * 0.2
    alone = rng.standard_normal((1000, 24))
    rows = np.concatenate([family, alone, alone + rng.standard_normal((1000, 24)) * 0.25])
    labels = np.where(np.arange(len(rows)) % 400 == 7, 1, 0)
    unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    counts, first = np.zeros(len(rows), np.int64), np.arange(len(rows))
    near = [np.flatnonzero((unit @ unit[i] >= 0.93) & (labels == labels[i])) for i in range(len(rows))]
    for i, x in enumerate(near):
        counts[i] = len(x) - 1
    while (new := np.array([first[x].min() for x in near])).tolist() != first.tolist():
        first = new
    assert counts.max() > 10_000 and (counts[14_000:] == 1).sum() > 1000
    frame_ = spark.createDataFrame([(i, v, int(y)) for i, (v, y) in enumerate(zip(rows.tolist(), labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame_, Scratch(spark)).collect()}
    assert got == {i: (counts[i], first[i]) for i in range(len(rows))}


def test_embedding_passes(spark):
    """A label far above the window: of the links at 0.93 to 0.95 between vectors that stand alone, hardly any is missed."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((20_000, 32))
    base /= np.sqrt((base * base).sum(1, keepdims=True))
    side = rng.standard_normal((3000, 32))
    side -= (side * base[:3000]).sum(1, keepdims=True) * base[:3000]
    side /= np.sqrt((side * side).sum(1, keepdims=True))
    cos = rng.uniform(0.9301, 0.95, 3000)[:, None]
    rows = np.concatenate([base, base[:3000] * cos + side * np.sqrt(1 - cos * cos)])
    frame_ = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame_, Scratch(spark)).collect()}
    found = sum(got[20_000 + i] == (1, i) for i in range(3000))
    assert found / 3000 > 0.995 and sum(n for n, _ in got.values()) <= 6000
    assert embedding_dedup.passes(20_000, 512, 0.93, 1e-3) > embedding_dedup.passes(2000, 512, 0.93, 1e-3) > 1


def test_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    odd = [(1000 + i, "".join(rng.choices(" \t\n'stmdlvreL9é 中,.\x85\0\U0001f600", k=rng.randint(0, 50)))) for i in range(500)] + [(2000, "ab" * 999), (2001, "<|endoftext|>")]
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.bpe_decode(byte_bpe.bpe_encode(frame(spark, texts + odd), path), path).collect()}
    assert got == {i: (model.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts + odd}
    assert got == {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.bpe_round_trip(frame(spark, texts + odd), path).collect()}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    want = {}
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in range(-(-len(ids) // 2048)):
            n = (len(ids) - 1) % 2048 + 1 if p == 0 else 2048
            want[i, p] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            at += n
    rows = packing.pack(frame(spark, texts), Scratch(spark), path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 2


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 20_000):
        sizes = np.clip(rng.lognormal(6.2, 1.1, n).astype(int), 1, 2048)
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        runs = packing.plan(counts, 2048)
        used = {}
        for k, lengths in runs:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] = used.get(x, 0) + k
        assert used == counts
        assert sum(k for k, _ in runs) <= 1.01 * sizes.sum() / 2048 + 2


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 !!", "en"), (None, "the the", "en")], "doc_id long, text string, lang string")
    got = language_id.identify(docs.select("doc_id", "text", "lang").union(extra)).join(docs.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i"), "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (10**6, 10**6 + 1)} == {10**6: ("und", 0.0), 10**6 + 1: ("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)


def test_many_languages(spark):
    """Each of 80 languages is learned, also the rarest."""
    rng = random.Random(6)
    rows = []
    for k in range(80):
        own = ["".join(rng.choices([chr(0x4E00 + 30 * k + i) for i in range(30)], k=4)) for _ in range(20)]
        rows += [(" ".join(rng.choices(own, k=12)), f"l{k}") for _ in range(60 if k < 70 else 50)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string")
    got = [(r.lang_pred, rows[r.doc_id][1]) for r in language_id.identify(docs).where("held_out").collect()]
    assert {y for _, y in got} == {f"l{k}" for k in range(80)}
    rare = [a == b for a, b in got if int(b[1:]) >= 70]
    assert sum(rare) / len(rare) > 0.9 and sum(a == b for a, b in got) / len(got) > 0.9


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs).join(labels, "doc_id").collect()
    bad = [r for r in rows if not r.quality]
    assert sum(not r.kept for r in bad) / len(bad) > 0.85
    assert sum(r.kept for r in rows if r.quality) / (len(rows) - len(bad)) > 0.99
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "fine words here, and there."), (2, "")], "doc_id long, text string")
    assert quality.score_quality(docs.select("doc_id", "text").union(odd)).where("score = 0").count() >= 3
    assert quality.keep_quality(docs).columns == docs.columns


def test_quality_of_long_text(spark):
    """Clean texts joined to one of 200,000 words are judged like the texts."""
    sf = SF.replace("0.001", "0.1")
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").select("text").collect()
    long = " ".join(" ".join(dict.fromkeys(r.text for r in good)).split()[:200_000])
    assert long.count(" ") == 199_999
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, long), (10**6 + 1, long[: len(long) // 2])], "doc_id long, text string")
    rows = [r for r in quality.score_quality(docs.union(extra)).collect() if r.doc_id >= 10**6]
    assert len(rows) == 2 and all(r.votes == "1111111" and r.posterior > 0.9 and r.kept for r in rows)
    # a short passage over and over is still bad in every window
    assert quality.Measured([b" ".join([long[:600].encode()] * 500)]).of["variety"][0] < 0.3


def test_html():
    page = '<html><head><title>t</title><style>p{}</style></head><body><header class="x">Top</header><nav><a href="/">m</a></nav><div class="cookie-notice">We use cookies</div><div id="wrap"><div class="post"><h2>Head &amp; tail</h2><p>One,\n two, <b>three</b> and a lot more text<br>here.<p>Four five six, seven &eacute;.</div><div class="comments"><p>Nice, really nice, very nice post, thanks a lot for it, indeed.</p></div></div><form><input>Send</form><script>var x="</p>";</script><footer>f</footer>'
    assert html_text.main_text(page) == "Head & tail One, two, three and a lot more text here. Four five six, seven é."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<nav>a</nav>", "<!-- <p>x</p> -->")] == [""] * 5
    assert html_text.main_text("<article><h1>T</h1><p>x</article><div class=ad>Buy, buy, buy</div>") == "T x"
    assert html_text.main_text("<div>" * 5000 + "<p>deep" + "</div>" * 5000) == "deep"


def test_html_named_layouts():
    """Layouts that are named after a part of the page keep the article; the parts themselves still go."""
    paras = [f"Paragraph {i}, which is long enough to be read as running text, has commas, and goes on for a while." for i in range(6)]
    body, want = "".join(f"<p>{x}</p>" for x in paras), " ".join(paras)
    side = '<div class="sidebar"><p>Some, other, text beside it.</p></div><div class="cookie-notice">We use cookies</div>'
    talk = '<div id="comments">' + "<p>Nice, really nice, very nice post, thanks a lot for it, indeed, once more.</p>" * 40 + "</div>"
    for name in ('class="site has-sidebar"', 'class="no-sidebar"', 'class="post social-share"', 'role="search"', 'class="overflow-hidden"', 'class="elementor-widget elementor-widget-text-editor"'):
        assert html_text.main_text(f"<body><div {name}><div>{body}</div>{side}</div>") == want, name
        assert html_text.main_text(f"<body><div {name}><div>{body}</div></div>{talk}") == want, name
    assert html_text.main_text(f'<div class="content-with-comments"><h1>Head</h1><div>{body}</div>{talk}</div>') == f"Head {want}"
    assert html_text.main_text(f"<body><form action=x><div>{body}</div><input></form>{side}") == want
    widgets = "".join(f'<div class="elementor-widget"><p>{x}</p></div>' for x in paras)
    assert html_text.main_text(f"<body><div>{widgets}</div>{side}{talk}") == want
    assert html_text.main_text(f"<body><div>{body}</div>{side}{talk}") == want
    assert html_text.main_text('<div class="widget"><p>Short.</p></div>') == "Short."


def test_html_declarations():
    for odd in ("<![foo]>", "<![ x ]>", "<![>", "<![if !IE]>", "<![endif]-->", "<![CDATA[a > b]]>", "<!x>", "<![if x>"):
        assert html_text.main_text(f"<p>One, two{odd} three</p><p>and four</p>") == "One, two three and four", odd
    assert html_text.main_text("<p>One</p><![foo") == "One"
    rng = random.Random(8)
    for _ in range(3000):  # no page ends the job
        html_text.main_text("".join(rng.choice(["<![", "<!", "<!--", "]]>", "]>", "-->", "<p>", "</", "<a", " ", "x", "CDATA[", "if", "&#", "&", ";", "<?", '"', "=", ">"]) for _ in range(12)))


def test_urls(spark):
    urls = ["http://a.example.com/en/x", "https://www.Example.com/en/?q", "http://b.net/es/1#t", "http://net/fr/", "http://x.org/", None, "no", "http://example.com", "ftp://n.com/a?b/c", "http://anet/es/"]
    rows = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(rows, RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/x", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 2: ("b.net", "/es/1", "net/es/", "block"), 3: ("net", "/fr/", "net/fr/", "block"),
        4: ("x.org", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("example.com", "", None, "allow"), 8: ("n.com", "/a", "com/", "allow"), 9: ("anet", "/es/", None, "allow"),
    }
    # a list that is too large to hand out is joined, with the same verdicts; so is a frame; null ids, repeats and a very long URL
    more = rows.union(rows).union(spark.createDataFrame([(None, "http://net/fr/" + "x" * 200_000, "r"), (None, None, "r")], rows.schema))
    want = sorted(map(str, url_filter.judge_urls(more, RULES).collect()))
    assert len(want) == 22 and sum("page_id=None" in x for x in want) == 2
    assert sorted(map(str, url_filter.judge_urls(more, RULES, most=10).collect())) == want
    odd = [*RULES, ("b.net", "es", "allow"), ("", "/", "block")]
    frame_ = spark.createDataFrame(odd, "host string, path string, verdict string")
    assert sorted(map(str, url_filter.judge_urls(more, frame_).collect())) == sorted(map(str, url_filter.judge_urls(more, odd).collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    for f in (lambda: exact_dedup.exact_dedup(docs, Scratch(spark)), lambda: exact_dedup.keep_exact(docs, Scratch(spark)), lambda: minhash_dedup.near_dedup(docs, Scratch(spark)), lambda: substring_dedup.substring_dedup(docs, Scratch(spark)), lambda: quality.score_quality(docs),
              lambda: language_id.identify(docs), lambda: packing.pack(docs, Scratch(spark), vocabulary("byte_bpe_50k.json")), lambda: byte_bpe.bpe_encode(docs, vocabulary("byte_bpe_50k.tiktoken")),
              lambda: embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), Scratch(spark)), lambda: html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
              lambda: url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES)):
        assert f().count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        out = Scratch(spark).keep(out)
        assert 0 < out.count() <= at.count()
        at = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == at.count()
