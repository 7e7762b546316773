"""Nulls, repeated rows and ids, empty and very long texts, clashing columns; operators against second implementations."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from phaseflux.llm import byte_bpe, embedding_dedup, html_text, language_id, minhash_dedup, packing, quality, substring_dedup, url_filter
from phaseflux.llm.queries import RULES, vocabulary
from phaseflux.llm.scratch import Scratch, bounded, root

SF = "/root/testdata/sf0.001"
#: Columns that operators name themselves.
CLASH = "doc_id long, text string, lang string, kept int, component_id string, ord string, copy int, spans int, names int, cls int, batch int, score int, text__ int, id__ int, gone__ int, digest__ int, keep__ int"
EXTRA = (1, "c", "o", 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", *EXTRA) for i, t in rows], CLASH).repartition(3)


@pytest.fixture(scope="module")
def odd():
    """Repeated ids with the same and with other texts, null ids, null, empty, blank and very long texts, ties."""
    rng = random.Random(9)
    base = " ".join(rng.choices([f"w{i}" for i in range(60)], k=80))
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=60_000))
    return [(1, base), (1, base), (1, base + " more"), (2, base), (None, base), (None, base), (None, "only here " + base[:200]), (3, None), (3, None), (None, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " end"), (6, long), (8, "one"), (9, "ONE")]


def test_near_of_odd_rows(spark, odd):
    rows = minhash_dedup.near_dedup(clashing(spark, odd), Scratch(spark), size=2).collect()
    assert len(rows) == len(odd)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    # ids 1 and 2 are copies, 6 and 7 near copies, 8 and 9 equal but for case; null ids are in no component
    assert got == {1: {(1, True)}, 2: {(1, False)}, None: {(None, False)}, 3: {(3, True)}, 4: {(4, True)}, 5: {(5, True)}, 6: {(6, True)}, 7: {(6, False)}, 8: {(8, True)}, 9: {(8, False)}}
    kept = minhash_dedup.keep_near(clashing(spark, odd), Scratch(spark), size=2)
    assert kept.columns == clashing(spark, odd).columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 3, None: 4, 3: 2, 4: 1, 5: 1, 6: 2, 8: 1}


def test_substring_of_odd_rows(spark, odd):
    first = {}
    words = [((1 << 63) - 1 if i is None else i, (t or "").split()) for i, t in odd]
    for i, w in words:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for (i, _), (o, w) in zip(odd, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < o:
                gone[p : p + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = substring_dedup.substring_dedup(clashing(spark, odd), Scratch(spark)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.text) for r in got))) == sorted(map(str, want))
    cut = substring_dedup.cut_spans(clashing(spark, odd), Scratch(spark))
    assert cut.columns == clashing(spark, odd).columns and cut.count() == sum(not w[2] or bool(w[3]) for w in want)


def test_substring_sources_decide(spark):
    """A span stays whole where the words at its source differ: hashes alone cut nothing."""
    own = [b"a", b"b", b"c", b"d"]
    good, bad = substring_dedup._digest(own[1:3]), substring_dedup._digest([b"x"])
    assert substring_dedup._cover(own, [{"start": 1, "end": 3, "digest": good}], False, 2) == [(1, 3)]
    assert substring_dedup._cover(own, [{"start": 1, "end": 3, "digest": bad}], False, 2) == []
    assert substring_dedup._cover(own, [{"start": 0, "end": 2, "digest": substring_dedup._digest(own[:2])}, {"start": 1, "end": 3, "digest": good}], False, 2) == [(0, 3)]


def test_tokens_of_odd_rows(spark, odd):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.tiktoken")
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = byte_bpe.bpe_round_trip(clashing(spark, odd), path).collect()
    assert sorted(str((r.doc_id, list(r.ids), bytes(r.decoded))) for r in rows) == sorted(str((i, model.encode_ordinary(t or ""), (t or "").encode())) for i, t in odd)
    path = vocabulary("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = []
    for i, t in odd:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % 2048 + 1
        for p, (a, b) in enumerate([(0, head), *((x, x + 2048) for x in range(head, len(ids), 2048))]):
            want.append((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = packing.pack(clashing(spark, odd), Scratch(spark), path).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(str, want))
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False))


def test_vectors_of_odd_rows(spark):
    one, two, three = [1.0, 0.0, 0.1], [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, one, 5), (1, one, 5), (2, two, 5), (None, one, 5), (None, one, 5), (3, three, 5), (3, two, 6), (4, two, 6), (5, None, 5), (6, one, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, unit string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame, Scratch(spark)).collect())
    # equal rows of one id are two vectors that link; id 3 has a vector in each label, so its component joins them
    assert got == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, False): 2, (3, 0, 3, True): 1, (3, 1, 3, True): 1, (4, 1, 3, False): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1})


def test_pages_against_second_reading(spark):
    """The synthetic pages' text by regular expressions: the article without its tags."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    long = "<article><p>" + "word, " * 200_000 + "</p></article>"
    extra = spark.createDataFrame([(None, None, None), (None, "u", "<p>x</p>"), (10**6, "u", long), (10**6, "u", long)], "page_id long, url string, html string")
    rows = pages.unionByName(extra).withColumns({"text": F.lit(1), "n_chars": F.lit("n"), "block": F.lit(2)})
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(rows).collect())

    def second(page):
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        body = re.sub(r"<(?:/?(?:h1|p)|br)>", " ", body)
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())

    want = Counter((r.page_id, t := second(r.html), len(t)) for r in pages.collect())
    whole = " ".join(["word,"] * 200_000)
    want += Counter({(None, "", 0): 1, (None, "x", 1): 1, (10**6, whole, len(whole)): 2})
    assert got == want


def test_layouts_keep_their_article():
    """Wrappers that are named after a part of the page: at the article, around it, and around its paragraphs."""
    paras = [f"Paragraph {i}, which is long enough to be read as running text, has commas, and goes on for a while." for i in range(6)]
    body, want = "".join(f"<p>{x}</p>" for x in paras), " ".join(paras)
    side = '<div class="sidebar"><p>Some, other, text beside it.</p></div><div class="newsletter-signup">Subscribe, now</div><nav><a href="/">Home</a></nav>'
    names = [
        "content", "no-sidebar", "has-sidebar", "content-widget", "main-content no-comments", "post social-share-enabled", "page search-results", "with-header-menu", "layout--sidebar-right", "hasSidebar", "sidebarLess", "single-post has-comments", "ad-free",
        "is-sponsored-content", "notice-board-article", "entry related-enabled", "modal-open", "overlay-none", "newsletterArticle", "subscribe-wall-off", "popup-free", "pagination-off", "breadcrumbs-on", "share-buttons-top", "cookie-ok", "hidden-nav", "search-page-body",
    ]
    for name in names:
        for shape in ('<body><div class="{0}">{1}</div>{2}', '<body><div id="{0}"><div><div>{1}</div></div></div>{2}', '<body class="{0}"><div>{1}</div>{2}', '<body><main class="{0}"><section>{1}</section></main>{2}'):
            assert html_text.main_text(shape.format(name, body, side)) == want, (name, shape)


def test_parts_beside_a_short_article_go():
    """Parts go by their names however long they are, with and without a heading, before and after the article, within a named layout or not."""
    short = ["A short paragraph of the article, that is all.", "And another one, shorter still."]
    long = "Running text beside the article, with commas, clauses, and all that makes it look like one, again and again. " * 4
    parts = [f'<div class="{x}"><p>{long}</p></div>' for x in ("sidebar", "advertisement", "newsletter", "cookie-consent", "related", "footer", "menu", "widget", "promo", "notice", "comments")]
    parts += [f"<form><p>{long}</p></form>", f'<div style="visibility: hidden"><p>{long}</p></div>', f"<aside><p>{long}</p></aside>"]
    for part in parts:
        for head in ("<h1>Title</h1>", "<h2>Title</h2>", ""):
            for many in (1, 2):
                own = head + "".join(f"<p>{x}</p>" for x in short[:many])
                want = " ".join((["Title"] if head else []) + short[:many])
                for shape in ('<div class="content">{0}</div>{1}', '{1}<div class="content">{0}</div>', "<div>{0}</div><div>{1}</div>", '<main class="content">{0}</main>{1}', "<article>{0}</article>{1}{1}"):
                    assert html_text.main_text(f"<body>{shape.format(own, part)}</body>") == want, (shape, part[:40], head, many)
                if head:
                    for name in ("layout has-sidebar", "site with-widget", "no-footer", *(["with-comments"] if "h1" in head else [])):  # discussions have lesser headings of their own
                        assert html_text.main_text(f'<body><div class="{name}"><div>{own}</div>{part}</div></body>') == want, (name, part[:40], head, many)


def test_blocks_of_a_page_builder():
    """Where heading and paragraphs each stand in a block of the same name, the name tells nothing."""
    paras = [f"Paragraph {i}, long enough to be read as running text, with commas, and going on." for i in range(4)]
    page = "".join(f'<div class="builder-widget">{x}</div>' for x in ["<h1>Head</h1>", *(f"<p>{x}</p>" for x in paras)])
    assert html_text.main_text(f'<body><div>{page}</div><div class="sidebar"><p>{paras[0] * 9}</p></div></body>') == " ".join(["Head", *paras])


def test_odd_pages_take_linear_time():
    import time

    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    odd = ["<b>x</i>", "<div><p>x, y", "<b>x", "<span class=widget>x", "<li><b>x", "<td><b></p>", "</div>x ", "<h1>x</h2>"]
    for piece in odd:
        assert took(piece * (1_000_000 // len(piece))) < 12, piece
    nested = "<p><table><td>" + "<b>" * 4000 + "<div>x</div>" * 20_000
    assert took(nested) < 3


def test_very_long_hosts(spark):
    """Hosts of very many labels, and one of a single label of 1 MB, in memory that follows their length; both ways of judging."""
    import tracemalloc

    hosts = [".".join(["a"] * 100_000), ".".join(["a"] * 100_000) + ".example.com", "x" * 1_000_000, "x" * 1_000_000 + ".example.com", "." * 50_000 + "net", "www.example.com", "aexample.com"]
    _, shape = url_filter.build(RULES)
    for host in hosts:
        tracemalloc.start()
        got = url_filter._candidates(host, "/en/x", shape)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100_000 and len(got) < 50
        every = [h for i in range(len(host)) if (h := host[i:]) and (i == 0 or host[i - 1] == ".") and len(h) <= shape.widest]
        assert {x.split(b"/")[0].rstrip(b"\0") for x in got} == {x.encode() for x in every}
    rows = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)], "page_id long, url string")
    want = [(None, "allow"), ("example.com/en/", "block"), (None, "allow"), ("example.com/en/", "block"), (None, "allow"), ("www.example.com/en/", "allow"), ("com/", "allow")]
    for most in (url_filter.MOST, 10):
        assert [(r.rule, r.verdict) for r in url_filter.judge_urls(rows, RULES, most=most).orderBy("page_id").collect()] == want


def measured(text):
    """The labellers' measures of one text, a word and a byte at a time."""
    data = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    upper, ascii_ = sum(65 <= c <= 90 for c in data), sum(65 <= c <= 90 or 97 <= c <= 122 for c in data)
    plain = set(b" \t\n\x0b\x0c\r,;:'\"()-.?!0123456789") | set(range(97, 123)) | set(range(65, 91)) | set(range(128, 256))
    seen, again = set(), 0
    for i, w in enumerate(words):
        seen = set() if i % quality.WINDOW == 0 else seen
        again += w in seen
        seen.add(w)
    n = max(len(words), 1)
    return {
        "upper": upper / max(ascii_, 1), "symbols": sum(c not in plain for c in data) / (len(data) + 1), "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "bars": sum(w == b"|" for w in words) / n,
        "variety": (len(words) - again) / n, "closed": sum(w[-1:] in b".?!" for w in words) / n, "bangs": sum(w.endswith(b"!!") for w in words) / n,
    }


def test_quality_measures_and_posterior(spark):
    rng = random.Random(3)
    texts = ["", " ", "A", "ab AB !! | x x x.", "é É #@ 12", *(" ".join(rng.choices(["Wow!!", "a.", "B", "c,", "|", "$$", "dé", "ee", "9"], k=rng.randint(1, 2500))) for _ in range(40))]
    got = quality.Measured([x.encode() for x in texts])
    for i, x in enumerate(texts):
        want = measured(x)
        assert all(math.isclose(got.of[k][i], v, abs_tol=1e-12) for k, v in want.items()), (i, {k: (got.of[k][i], v) for k, v in want.items()})
    # expectation-maximisation with plain loops over every text
    counts = {int(p): rng.randint(1, 30) for p in {sum(rng.choice((0, 1, 2, 2, 2)) * 3**k for k in range(7)) for _ in range(60)}}
    digits = {p: [p // 3**k % 3 for k in range(7)] for p in counts}
    good = {p: 0.1 if 1 in d else 0.9 for p, d in digits.items()}
    for _ in range(200):
        whole = sum(counts.values())
        prior = (sum(good[p] * n for p, n in counts.items()) + 1) / (whole + 2)
        bad = {}
        for side in (0, 1):
            for k in range(7):
                w = {v: sum((good[p] if side else 1 - good[p]) * n for p, n in counts.items() if digits[p][k] == v) + 0.5 for v in (1, 2)}
                share = w[1] / (w[1] + w[2])
                bad[side, k] = min(share, quality.FALSE) if side else max(share, quality.HIT)
        new = {}
        for p, d in digits.items():
            like = [math.prod(bad[s, k] if v == 1 else 1 - bad[s, k] if v == 2 else 1.0 for k, v in enumerate(d)) for s in (0, 1)]
            new[p] = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
        done = max(abs(new[p] - good[p]) for p in good) < 1e-9
        good = new
        if done:
            break
    got = quality.posterior(counts)
    assert all(math.isclose(got[p], good[p], rel_tol=1e-5, abs_tol=1e-9) for p in counts)


def shifted(rows):
    """The rows with ids that no document has."""
    return [(None if i is None else i + 10**6, t) for i, t in rows]


def test_quality_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = clashing(spark, shifted(odd)).unionByName(docs, allowMissingColumns=True)
    scored = quality.score_quality(rows).collect()
    assert len(scored) == rows.count()
    for i in (3, 4, 5):
        assert all(r.score == 0 and not r.kept for r in scored if r.doc_id == 10**6 + i)
    assert len({r.score for r in scored if r.doc_id == 10**6 + 6}) == 1
    kept = quality.keep_quality(rows)
    assert kept.columns == rows.columns and kept.count() == sum(r.kept for r in scored)
    assert quality.score_quality(rows.limit(0)).count() == 0


def test_language_features_and_odd_rows(spark, odd):
    text = "Ab é-1 x"
    found, ends, letters = language_id.subwords([text, None, "", "12"], 1 << 15)
    low = f" {text.lower()} "
    codes = [ord(c) + 1 if c.isalpha() else 33 for c in low]
    turn, want = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], []
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            part = low[i : i + n]
            if part[0].isalpha() if n == 1 else (part[0].isalpha() or part[1].isalpha()) if n == 2 else part[1].isalpha():
                code = (sum(c * t for c, t in zip(codes[i : i + n], turn, strict=False)) + 0x27D4EB2F * n) % 2**32
                code = (code ^ (code >> 15)) * 0x2C1B3C6D % 2**32
                want.append((code ^ (code >> 13)) % (1 << 15))
    assert sorted(found[: ends[1]].tolist()) == sorted(want) and letters.tolist() == [True, False, False, False] and len(found) == ends[1] == ends[-1]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = clashing(spark, shifted(odd)).withColumn("lang", F.lit(None).cast("string")).unionByName(docs, allowMissingColumns=True)
    got = language_id.identify(rows).collect()
    assert len(got) == rows.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (10**6 + 3, 10**6 + 4, 10**6 + 5)} == {("und", 0.0)}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 10**6 + 6}) == 1


def test_pipeline_stages_against_brute_force(spark, odd):
    """Each stage on what the one before it kept, with nulls, repeats and columns that clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = clashing(spark, shifted(odd))
    at = Scratch(spark).keep(docs.unionByName(more, allowMissingColumns=True))
    columns, keep = at.columns, Scratch(spark)
    names = ("doc_id", "text")

    def rows(frame):
        return [tuple(r) for r in frame.select(*names).collect()]

    decided = Counter((r.doc_id, r.kept) for r in quality.score_quality(at).collect())
    out = keep.keep(corpus_pipeline.filter_quality(spark, at, "x"))
    assert out.columns == columns and Counter((i, True) for i, _ in rows(out)) == Counter({k: n for k, n in decided.items() if k[1]})
    assert not any(t is None or not t.strip() for _, t in rows(out))

    before, groups = rows(out), {}
    for i, t in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), []).append(i)
    out = keep.keep(corpus_pipeline.drop_exact(spark, out, "x"))
    assert out.columns == columns
    assert Counter(i for i, _ in rows(out)) == Counter(min(g, key=lambda x: (x is None, x or 0)) for g in groups.values())

    before = rows(out)
    sets = []
    for _, t in before:
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    ids = [i for i, _ in before]
    root_ = {i: i for i in ids if i is not None}

    def top(x):
        while root_[x] != x:
            x = root_[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if None not in (ids[a], ids[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(ids[a]), top(ids[b])
                root_[max(x, y)] = min(x, y)
    out = keep.keep(corpus_pipeline.drop_near(spark, out, "x"))
    assert out.columns == columns and Counter(i for i, _ in rows(out)) == Counter(i for i in ids if i is None or top(i) == i)

    before, first = rows(out), {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in before:
        w = t.encode().split()
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(first.get(tuple(w[p : p + 13]), order(i)), order(i))
    want = []
    for i, t in before:
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < order(i):
                gone[p : p + 13] = [True] * 13
        rest = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        if not any(gone):
            want.append((i, t))
        elif rest:
            want.append((i, rest))
    out = keep.keep(corpus_pipeline.cut_repeats(spark, out, "x"))
    assert out.columns == columns and Counter(rows(out)) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in out.where("n_chars IS NOT NULL").collect())

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    packed = corpus_pipeline.pack_sequences(spark, out, "x").collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((i, n) for i, t in want for n in _lengths(len(model.encode(t, add_special_tokens=False).ids) + 1))
    full = Counter()
    for r in packed:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, at.limit(0), "y").count() == 0


def _lengths(n):
    return [(n - 1) % 2048 + 1] + [2048] * ((n - 1) // 2048)


def test_two_pipelines_keep_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    one = corpus_pipeline.drop_exact(spark, docs, "one")
    two = corpus_pipeline.drop_near(spark, docs, "two")
    assert one.count() > 0 and two.count() > 0


def test_scratch(spark):
    with Scratch(spark) as tables:
        frame = tables.keep(spark.range(100).repartition(7), rows=100)
        assert frame.count() == 100 and frame.rdd.getNumPartitions() == 1
        path = frame._kept_at
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    bounded(spark.range(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        root(Cluster)


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op2_minhash_dedup", "op8_exact_dedup", "op9_url_filter", "op10_substring_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in want.description]
    frame = __spark_entry__.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in frame.collect()) == Counter(want.fetchall())


def test_queries_against_operators(spark):
    """The thin queries of operators without SQL give a row for each row of their table, with the digests of the contract."""
    queries = __spark_entry__.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model_path = vocabulary("byte_bpe_50k.tiktoken")
    import public_tokenizers
    import tiktoken

    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(model_path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries["op4_byte_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = model.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    for name in ("op5_language_id", "op6_quality"):
        assert sorted(r.doc_id for r in queries[name](spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())
