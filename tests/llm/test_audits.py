"""Secret scan, divergence audit and centroid clustering against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseflux.llm import centroid_clustering, divergence_audit, queries, secret_scan
from phaseflux.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, spans string, term string, n int, value int, rank int, base int, tokens int, start int"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "s", "t", 1, 2, 3, 4, 5, 6) for r in rows], DOCS).repartition(3)


# ---- secrets


def plain_matches(text):
    """Fixed kinds of a text: (start, kind, end)."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def kind_of(c):
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"


def changes(s):
    return sum(kind_of(a) != kind_of(b) for a, b in zip(s, s[1:], strict=False))


def plain_random(texts, share=0.01):
    """The random spans of each text, by loops."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", lower, upper, upper + "234567", lower + digits, upper + digits, upper + lower, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + lower + digits + "+/-_"]
    tokens = [[(m.start(), m.end(), m[0].rstrip("=")) for m in re.finditer("[A-Za-z0-9+/_-]{12,}={0,2}", t)] for t in texts]
    short = [s for own in tokens for _, _, s in own if len(s) < 20]
    symbols = Counter("".join(short))
    rate = (1 + sum(map(changes, short))) / (2 + sum(len(s) - 1 for s in short))
    judged, strata = [], defaultdict(list)
    for own in tokens:
        judged.append([])
        for start, end, s in own:
            n = len(s)
            if n < 20 or set(s) <= set(digits):
                continue
            e = next(i for i, a in enumerate(alphabets) if set(s) <= set(a))
            k, v = len(alphabets[e]), [alphabets[e].index(c) for c in s]
            squares = sum(x * x for x in Counter(s).values())
            chi = max(k * squares / n - n, 0) / (k - 1)
            z = [(chi ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))]
            up = [x >= k // 2 for x in v]
            mean = 1 + 2 * sum(up) * (n - sum(up)) / n
            spread = (mean - 1) * (mean - 2) / (n - 1)
            z.append((1 + sum(a != b for a, b in zip(up, up[1:], strict=False)) - mean) / math.sqrt(spread) if spread > 0 else 99)
            bottom = n * sum(x * x for x in v) - sum(v) ** 2
            r = (n * sum(a * b for a, b in zip(v, v[1:] + v[:1], strict=True)) - sum(v) ** 2) / bottom if bottom else 1
            z.append((r + 1 / (n - 1)) * (n - 1) * math.sqrt(n - 2) / n)
            bits = 0
            if max(map(abs, z)) <= 3.29:
                q = [1 + symbols[c] for c in alphabets[e]]
                two, three = sum(x**2 for x in q) / sum(q) ** 2, sum(x**3 for x in q) / sum(q) ** 3
                pairs = n * (n - 1) / 2
                fewer = (pairs * two - (squares - n) / 2) / math.sqrt(pairs * (two - two**2) + 2 * pairs * (n - 2) * (three - two**2))
                share_ = changes(s) / (n - 1)
                tail = [1 + fewer**2 / 2 / math.log(2)] if fewer > 0 else []
                if share_ > rate:
                    tail.append((n - 1) * (share_ * math.log(share_ / rate) + ((1 - share_) * math.log((1 - share_) / (1 - rate)) if share_ < 1 else 0)) / math.log(2))
                bits = min(max(math.floor(max([0, *tail]) - 1), 0), 200)
            key = e, math.floor(2 * math.log2(n))
            judged[-1].append((start, end, key, bits))
            strata[key].append(bits)
    least = {k: min((b for b in x if len(x) * 0.5**b <= share * sum(y >= b for y in x)), default=999) for k, x in strata.items()}
    return [[(a, 3, b) for a, b, key, bits in own if bits >= least[key]] for own in judged]


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 15))) for _ in range(600)]
    any_of = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(120)]
    for i in range(0, 120, 4):
        texts[i] += f" é𝒳 {any_of(base62, rng.randint(20, 60))} 中 {any_of(base62 + '+/', 44)}== end"
    texts[1] += ' password: "hunter2!" PASSWD=abc token=api_key:"abcdefgh" ſecret=abcdefgh secret = token=12345678 API_KEY\'  =  \'x.y-z/8' + " apikey:" + any_of(base62, 30)
    texts[2] += f" AKIA{any_of('ABCDEF2345', 16)} AKIAAKIA{any_of('ABCDEF2345', 12)} AKIA123 {any_of('0123456789abcdef', 23)} {any_of('0123456789abcdef', 24)}f{any_of('0123456789abcdef', 90)}"
    texts[3] += " -------------------------------- aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 12345678901234567890123456 abcdefghijklmnopqrstuvwxyz0123456789 getUserNameFromRequestContext 550e8400-e29b-41d4-a716-446655440000 a/b/c/d/e/f/g/h/i/j/k/l"
    texts[5] = ("𝒳 token=abcdef12 " * 3000) + any_of(base62, 5000) + " tail"
    texts[6] = any_of("0123456789ABCDEF", 64) + "\n" + any_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 40) + "=="
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    return rows + [(500, None, None, None), (501, "", "en", "a"), (None, texts[2], "en", "a"), (7, texts[7], "en", "a"), (7, texts[7], "en", "a")]


def test_secrets(spark, leaky):
    got = secret_scan.scan(documents(spark, leaky), Scratch(spark)).collect()
    want = [(d, sorted([*plain_matches(t or ""), *more])) for (d, t, *_), more in zip(leaky, plain_random([t or "" for _, t, *_ in leaky]), strict=True)]
    assert sorted([(r.doc_id, [tuple(s) for s in r.spans]) for r in got], key=str) == sorted(want, key=str)
    found = [s for _, spans in want for s in spans if s[1] == 3]
    assert len(found) >= 50  # the planted strings
    texts = {d: t for d, t, *_ in leaky if d is not None}
    assert not [texts[d][a:b] for d, spans in want if d in (1, 3) for a, kind, b in spans if kind == 3 and "apikey:" + texts[d][a:b] not in texts[d]]  # nothing of what only looks odd
    assert not secret_scan.scan(documents(spark, leaky).where("false"), Scratch(spark)).collect()
    alone = secret_scan.scan(documents(spark, leaky).where("doc_id IN (500, 501)"), Scratch(spark)).collect()
    assert sorted((r.doc_id, r.spans) for r in alone) == [(500, []), (501, [])]


def test_running_sums(spark):
    rows = [(list(np.random.default_rng(n).integers(0, 9, n).tolist()),) for n in (1, 2, 255, 256, 257, 1000)]
    got = spark.createDataFrame(rows, "steps array<long>").select("steps", secret_scan._running(F.col("steps")).alias("sums")).collect()
    assert all(r.sums == np.cumsum(r.steps).tolist() for r in got)


def test_secret_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    more = plain_random([d.text or "" for d in docs])
    names = ("assign", "access", "hex", "random")
    say = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    want = set()
    for d, extra in zip(docs, more, strict=True):
        base = plain_matches(d.text or "")
        n = Counter(k for _, k, _ in base)
        want.add((d.doc_id, n[0], n[1], n[2], hashlib.sha256(say(base).encode()).hexdigest(), say([*base, *extra])))
    got = queries.queries()["op11_secret_scan"](spark, sf)
    assert {tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# ---- divergence


def plain_audit(rows, top=200):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, la, so in rows]
    out = set()
    for lang in {la for la, _, _ in docs}:
        held = Counter(x for la, _, w in docs if la == lang for x in set(w))
        kept = [x for x, n in held.items() if n >= 3]
        count = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, w in docs:
            if la == lang:
                count[s].update(x for x in w if held[x] >= 3)
        whole = sum(count.values(), Counter())
        p = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (c.total() + len(kept)) for x in kept}
        f = lambda a, b: (a - b) ** 2 // b
        of, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in of:
            pairs = [(t, sum(f(of[s][x], of[t][x]) for x in kept)) for t in of if t != s]
            terms = [(x, f(of[s][x], q[x])) for x in kept if count[s][x] and of[s][x] > q[x]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for at, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, at + 1))
    return out


def audited(frame, **more):
    rows = [tuple(r) for r in divergence_audit.audit(frame, Scratch(frame.sparkSession), **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def voices():
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "abÉçß" for b in "xyzжñ" for c in ("", "Q", "日本", "a", "b")]
    rows = []
    for i in range(150):
        own = rng.sample(words, 30)
        rows.append((i, " ".join(rng.choices(own, k=rng.randint(0, 80))) + " 12,x_y[Z`z{} \x00\x7f", rng.choice(["en", "de", None, ""]), rng.choice([None, "", "s1", "s2", "é", "z" * 40])))
    rows += [(200, None, "en", "nothing"), (201, "", "fr", "one"), (202, "once only", "fr", "two"), (3, "same same", "es", "x"), (3, "same same", "es", "x"), (None, "same", "es", "y"), (204, "word " * 300_000 + "last", "en", "s1")]
    return rows


def test_audit(spark, voices):
    frame = documents(spark, voices)
    assert audited(frame) == plain_audit(voices)
    assert audited(frame, top=3) == plain_audit(voices, 3)
    assert audited(frame.where("false")) == set()
    assert audited(frame.where("lang = 'fr'")) == {("fr", "one", "pair", "two", 0, 1), ("fr", "two", "pair", "one", 0, 1)}


def test_audit_in_small_tiles(spark, voices, monkeypatch):
    """Many blocks, chunks, stripes, parts of counts and pieces of texts give the same rows."""
    assert audited(documents(spark, voices[:150]), block=2, chunk=8, stripe=5) == plain_audit(voices[:150])
    text = "".join(random.Random(1).choices("aé ,B", k=5000)).encode()
    monkeypatch.setattr(divergence_audit, "PIECE", 50)
    pieces = list(divergence_audit._pieces(text))
    assert b"".join(pieces) == text and sum((Counter(divergence_audit._TERM.findall(x.translate(divergence_audit._LOWER))) for x in pieces), Counter()) == Counter(divergence_audit._TERM.findall(text.translate(divergence_audit._LOWER)))


def test_shares_are_exact(spark):
    rng = random.Random(2)
    cases = [(1, 1), (5, 5), (1, 10**15), (10**15, 10**15), *((t := rng.randint(1, 10**15), rng.randint(t, 9 * 10**15)) for _ in range(200))]
    want = [1 + 10**9 * a // b for a, b in cases]
    top, bottom = (np.array(x, np.int64) for x in zip(*cases, strict=True))
    assert divergence_audit._share(top, bottom).tolist() == want
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, b long")
    assert [r[0] for r in frame.orderBy("i").select(divergence_audit._share_sql("a", "b")).collect()] == want


# ---- clusters


def plain_clusters(rows, k, rounds, dims, seed=3, scale=1024):
    """(vec_id, cluster, distance) of the rows that count, the inertias and the centroids."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v], np.array(v).tobytes()) for i, v in kept]
    first = sorted(whole, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [v for _, v, _ in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), at) for at, c in enumerate(centroids)) for _, v, _ in whole]

    for _ in range(rounds):
        to = assigned()
        for at in range(len(centroids)):
            own = [v for (_, v, _), (_, c) in zip(whole, to, strict=True) if c == at]
            if own:
                centroids[at] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assigned()
    return [(i, c, d) for (i, _, _), (d, c) in zip(whole, to, strict=True)], Counter({c: sum(d for d, x in to if x == c) for c in range(len(centroids))}), centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, cluster string, data string").repartition(3)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e8, 1e30, 1e307])
def test_clusters(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=6) + 4 * (i % 3)).tolist()) for i in range(90)]
    rows[5] = (5, (rng.normal(size=6) * size).tolist())
    rows[6] = (6, [size] * 6)
    rows += [(90, None), (91, []), (92, [1.0] * 5), (93, [1.0] * 5 + [None]), (94, [math.nan] * 6), (95, [math.inf] + [0.0] * 5), (6, [size] * 6), (7, rows[8][1]), (None, [0.5] * 6), (None, [0.25] * 6), (97, [0.0] * 6)]
    want, inertia, centroids = plain_clusters(rows, 4, 3, 6)
    got = centroid_clustering.cluster(vectors(spark, rows), Scratch(spark), k=4, rounds=3, dims=6).collect()
    cut = lambda x: min(x, 2**63 - 1)
    full = [(i, c, cut(d), cut(inertia[c]), cut(inertia.total()), [str(x) for x in centroids[c]]) for i, c, d in want]
    assert sorted(map(tuple, got), key=str) == sorted(full, key=str)


def test_few_vectors(spark):
    none = centroid_clustering.cluster(vectors(spark, [(1, [1.0])]), Scratch(spark), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    same = [(i, [1.0, 2.0]) for i in range(5)]  # all distances tie: the smallest number takes all, empty centroids stay
    assert {(r.cluster, r.distance) for r in centroid_clustering.cluster(vectors(spark, same), Scratch(spark), dims=2).collect()} == {(0, 0)}


def test_guards_hold():
    """Products at the guards of magnitudes are exact."""
    rng = np.random.default_rng(3)
    exact, long = centroid_clustering._guards(64)
    for most in (exact - 1, exact, long - 1, long, 10**25):
        rows = np.array([[s * float(most) for s in rng.choice([-1, 1], 64)] for _ in range(20)])
        centroids = [[int(s) * most for s in rng.choice([-1, 1], 64)] for _ in range(3)] + [[0] * 64]
        best, distance = centroid_clustering.nearest(rows, centroids, 1)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)), at) for at, c in enumerate(centroids)) for row in rows.tolist()]
        assert list(zip(map(int, distance), best.tolist(), strict=True)) == want


@pytest.mark.parametrize("name", ["op12_divergence_audit", "op13_centroid_clustering"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
