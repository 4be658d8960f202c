"""Operators that compare documents with each other or with a benchmark, and the pipeline."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from raregram.llm import ann, decontam, minhash, suffix_dedup
from raregram.llm.components import components
from tests.llm.conftest import EDGES, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# near duplicates


def bag(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes_by_definition(docs):
    """Components of all pairs at 0.8 or more; wordless texts by their bytes."""
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [None if t is None else bag(t) for _, t in docs]
    having = defaultdict(list)
    for i, b in enumerate(bags):
        for g in b or ():
            having[g].append(i)
    seen = {}
    for i, (_, t) in enumerate(docs):
        if t is not None and not bags[i]:
            root[find(i)] = find(seen.setdefault(t, i))
        both = Counter()
        for g, n in (bags[i] or {}).items():
            for j in having[g]:
                if j < i:
                    both[j] += min(n, bags[j][g])
        for j, m in both.items():
            if m >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - m) - 1e-9:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    out = []
    for ids in groups.values():
        least = min((x for x in ids if x is not None), default=None)
        out += [(x, least if least is not None else x) for x in ids]
    return sorted(out, key=repr)


def near_texts():
    rng = random.Random(11)
    docs = []
    for g in range(6):
        base = prose(rng, 120).split()
        for k in range(25):
            w = base[:]
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"q{rng.randrange(999)}"
            docs.append((10_000 + 100 * g + k, " ".join(w)))
    w = [f"c{rng.randrange(99)}" for _ in range(60)]
    for k in range(60):  # a chain, each near the last only
        w[rng.randrange(60)] = f"d{rng.randrange(9999)}"
        docs.append((11_000 + k, " ".join(w)))
    docs += [(12_000 + k, prose(rng, 50)) for k in range(80)]
    docs += [(3000, "ab " * 100), (3001, "ab " * 104), (3002, "ab " * 200)]
    return docs


def test_near_duplicates(spark, edges, empty):
    docs = near_texts() + EDGES
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = classes_by_definition(docs)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr) == want
    kept = minhash.deduplicate(df)
    nulls = sum(t is None for _, t in docs)
    assert kept.columns == df.columns
    ids = {i: t for i, t in docs}
    classes = {c for i, c in want if i is not None and ids[i] is not None}
    assert {r["doc_id"] for r in kept.collect() if r["text"] is not None} == classes
    assert kept.where("text is null").count() == nulls and kept.count() == len(classes) + nulls
    assert minhash.near_duplicates(edges).count() == len(EDGES) and minhash.deduplicate(edges).columns == edges.columns
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for _ in range(4):
        items = rng.integers(1, 2**62, 50).astype(np.uint64)
        a, b = rng.integers(0, 12, 50), rng.integers(0, 12, 50)
        b = np.where(rng.random(50) < 0.5, a, b)
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = minhash.signatures(row, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 3000)
        assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    odd = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (1, 2, 0), (3, 3, 0), (None, 4, 0), (5, None, 0), (None, None, 0)], "u long, v long, m long")
    assert sorted(map(tuple, components(odd).collect())) == [(2, 1)]


# exact substrings


def removed_by_definition(docs, n):
    bodies = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + n] for _, b in bodies for k in range(len(b) - n + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k] += 1
                gone[min(k + n, len(b))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_texts():
    rng = random.Random(12)
    docs = [(50 + i, prose(rng, rng.randint(10, 120))) for i in range(40)]
    passage = prose(rng, 70)
    docs += [(100 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(40)]
    docs += [(200, docs[0][1]), (201, docs[3][1] + "!"), (202, "ab" * 150 + "q" + "ab" * 120), (203, "é" * 150 + passage[5:150]), (204, passage[:199]), (205, "z" * 199), (206, "z" * 200), (207, "y" * 201)]
    return docs


@pytest.mark.parametrize("options", [{}, {"crowd": 3}, {"length": 61, "gram": 17}])
def test_substrings(spark, edges, empty, options):
    docs = repeated_texts() + EDGES
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.measure(df, **options).collect()), key=repr) == removed_by_definition(docs, options.get("length", 200))
    if not options:
        assert suffix_dedup.measure(empty).count() == 0 and suffix_dedup.measure(edges).count() == len(EDGES)
        left = suffix_dedup.remove(df).collect()
        assert len(left) == len(docs) and sum(len(r["text"].encode()) for r in left) <= sum(x[1] - x[2] for x in removed_by_definition(docs, 200))


def test_suffix_order_and_stretches():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 90))
        b = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        s = b.tobytes()
        assert suffix_dedup.suffix_order(b, n + 8).tolist() == sorted(range(n), key=lambda i: s[i:])
        k = int(rng.integers(1, 12))
        c = Counter(s[i : i + k] for i in range(n - k + 1))
        ok = np.arange(n) + k <= n
        assert suffix_dedup.repeated_windows(b, ok, k).tolist() == [bool(o) and c[s[i : i + k]] > 1 for i, o in enumerate(ok)]
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offs = np.array([0, 1200, 1200, 1230, 5000])
    whole = suffix_dedup.segments(data, offs, 50, 11)
    parts = suffix_dedup.segments(data, offs, 50, 11, stretch=700)
    cover = lambda x: sorted((r, w) for r, s, n in zip(*x[:3], strict=True) for w in range(s, s + n))
    assert cover(whole) == cover(parts) == [(r, w) for r in range(4) for w in range(offs[r], offs[r + 1] - 49)]


# benchmark


def hits_by_definition(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        at = defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        for item, s in items:
            v = words(s)
            for k in range(max(1, len(v) - 7) if v else 0):
                g = v[k : k + 8]
                for p in at[g[0]]:
                    if w[p : p + len(g)] == g:
                        found.add(str(item))
                        hit |= set(range(p, p + len(g)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def test_neighbours_of_repeated_rows(spark):
    """Rows alike in id and vector count once, as queries and as neighbours."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 16))
    x[60:90] = x[60]
    once = [(i, v.tolist(), i < 3 or i == 61) for i, v in enumerate(x)]
    more = once[:2] * 2 + [once[60]] * 25
    name = "vec_id long, embedding array<double>, q boolean"
    found = {}
    for r in ann.search(spark.createDataFrame(once + more, name).repartition(3), F.col("q")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(found) == [0, 1, 2, 61]
    for i, got in found.items():
        assert sorted(k for k, _ in got) == list(range(1, 21)) and len({j for _, j in got}) == 20 and i not in {j for _, j in got}
    assert {j for _, j in found[61]} == {60, *range(62, 81)}


def test_removal_is_the_same_with_several_automata(spark, edges):
    """Spans of all automata are of the uncut text, cut once, and coverage is of their union."""
    w = [f"w{i}" for i in range(200)]
    items = [w[0:8], w[4:12], w[20:50], w[60:90], ["s1", "s2", "s3", "s4"] + w[100:150], ["x1"] * 55]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    n = [f"n{i}" for i in range(200)]
    texts = {
        1: n[:40] + w[0:12] + n[40:80],  # windows of two items that overlap
        2: n[:10] + w[20:35] + n[10:15] + w[60:75] + n[15:20],  # each item hits less than half, both together more
        3: n[:40] + w[96:100] + w[0:8] + w[100:104] + n[40:60],
        4: n[:30] + w[20:24] + w[0:8] + w[24:28] + n[30:50],  # a cut joins words to a window of another item
        5: n[:30],
    }
    rows = [(i, " ".join(t), len(" ".join(t))) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[3][1], rows[3][2]), (7, None, None)], "doc_id long, text string, n_chars long")
    one = sorted(map(tuple, decontam.remove(docs, bench).collect()), key=repr)
    assert (1, " ".join(n[:40]) + "  " + " ".join(n[40:80]), 2 + len(" ".join(n[:40])) + len(" ".join(n[40:80]))) in one
    assert sorted(r[0] for r in one if r[0]) == [1, 1, 3, 4, 5, 7]
    assert any(r[0] == 4 and all(x in r[1].split() for x in w[20:28]) for r in one)
    for size in (8, 30, 60):
        assert sorted(map(tuple, decontam.remove(docs, bench, chunk_words=size).collect()), key=repr) == one
    assert decontam.remove(edges, bench, chunk_words=60).columns == edges.columns


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, edges, empty, short):
    rng = random.Random(13)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(90, None), (91, "..."), (92, "")]
    items += [(50, items[0][1]), (51, " ".join(items[1][1].split()[:12]))]
    if short:
        items += [(60, "the of"), (61, "zebra"), (62, "a b a b a b a b a b")]
    docs = list(EDGES)
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = (items[rng.randrange(20)][1]).split()
            a = rng.randrange(len(s))
            parts += [" ".join(s[a : a + rng.randint(3, 20)]), prose(rng, rng.randint(0, 9))]
        docs.append((100 + i, " ".join(parts) + (" zebra a b a b a b a b" if i % 9 == 0 else "")))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits_by_definition(docs, items)
    assert sorted(map(tuple, decontam.measure(df, bench).collect()), key=repr) == want
    if short:
        assert sorted(map(tuple, decontam.measure(df, bench, chunk_words=60).collect()), key=repr) == want
    assert decontam.measure(empty, bench).count() == 0
    assert decontam.measure(df, bench.where("false")).agg({"n_hit": "sum"}).first()[0] == 0
    clean = decontam.remove(edges, bench)
    assert clean.columns == edges.columns
    kept = {r["doc_id"]: r["text"] for r in decontam.remove(df, bench).collect() if r["doc_id"] is not None}
    for i, n, hit, *_ in want:
        if i is not None and i >= 100:
            assert (i in kept) == (hit < 0.5 * n or n == 0)
            if i in kept:
                assert len(words(kept[i])) >= n - hit
                assert (kept[i] == dict(docs)[i]) == (hit == 0)


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[700:760] = x[3]  # a crowd of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, []), (2100, [float("inf")] + [1.0] * 15), (2120, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann.search(df, df["vec_id"] % 20 == 0, sample_rows=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    y, hit = x.astype(float), 0
    for q, list_ in got.items():
        list_.sort()
        dots = y @ y[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(dots, 10))) if i != q][:20]
        assert [r for r, *_ in list_] == list(range(1, 21))
        assert all(s == pytest.approx(dots[i], abs=1e-12) for _, i, s in list_)
        assert [(-round(s, 10), i) for _, i, s in list_] == sorted((-round(s, 10), i) for _, i, s in list_)
        hit += len({i for _, i, _ in list_} & set(order))
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert ann.search(few, few["vec_id"] % 20 == 0).count() == 4
    assert ann.search(df.where("false"), df["vec_id"] % 20 == 0).count() == 0


def test_neighbours_of_several_lengths(spark, monkeypatch):
    """Each length is searched among its own rows, in several blocks too; results are those of brute force."""
    monkeypatch.setattr(ann, "ROW_BLOCK", 64)
    rng = np.random.default_rng(12)
    lengths = [12] * 300 + [8] * 200 + [1] * 30 + [70] * 25 + [3]
    x = {i: rng.normal(size=n) for i, n in enumerate(lengths)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 5 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = want = 0
    for q in range(0, len(lengths), 5):
        near = sorted((-float(np.einsum("j,j->", x[i], x[q])), i) for i in x if i != q and lengths[i] == lengths[q])[:20]
        found = sorted(got.pop(q, []))
        assert [r for r, *_ in found] == list(range(1, len(near) + 1))
        assert all(lengths[i] == lengths[q] and s == pytest.approx(x[i] @ x[q], abs=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in near})
        want += len(near)
    assert not got and hit >= 0.9 * want


def test_probing_reaches_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (3000, 8)).astype(np.uint8)
    index = ann.Index(codes)
    for radius in (0, 3, 7, 8, 19, 27, 40, 64):
        q = rng.integers(0, 256, 8).astype(np.uint8)
        far = np.bitwise_count(codes ^ q).sum(axis=1)
        assert index.within(q, radius).tolist() == np.flatnonzero(far <= radius).tolist()


# pipeline


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline
    from raregram.llm import packing, pii, quality, word_bpe
    from tests.llm.test_rows import check_packing

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1] if outs else docs, SF_DIR).cache())
    for o in outs[:-1]:
        assert o.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outs[:-1]]
    assert np.mean([(i in texts[0]) == bool(y) for i, y in labels.items()]) > 0.95
    want = {c for _, c in classes_by_definition(sorted(texts[0].items()))}
    assert set(texts[1]) == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for i, n, hit, *_ in hits_by_definition(sorted(texts[1].items()), items):
        assert (i in texts[2]) == (n == 0 or hit < 0.5 * n)
        if i in texts[2]:
            assert (texts[2][i] == texts[1][i]) == (hit == 0)
    assert set(texts[3]) == set(texts[2])
    assert all(not pii.base_spans(t) or "[" in t for t in texts[3].values())
    assert check_packing(outs[-1].collect(), list(texts[3].items()), word_bpe.encoder()) < 0.01
    assert packing.SCHEMA == outs[-1].schema and quality.THRESHOLD == 0.3
    tokens = lambda df: df.agg({"length": "sum"}).first()[0]
    assert tokens(corpus_pipeline.run(spark, SF_DIR)) == tokens(outs[-1])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_pipeline_of_odd_rows(spark, edges, empty):
    """Every stage by itself takes nulls, blanks, copies, long texts, clashing columns, and no rows."""
    import corpus_pipeline

    odd = edges.withColumn("n_chars", F.length("text").cast("long"))
    few = empty.select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF_DIR)
        rows = out.collect()
        assert out.schema.names == odd.columns and len(rows) <= len(EDGES), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows), name
        if name in ("decontamination", "personal_data"):
            assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in EDGES), name
        for none in (empty, few):
            left = stage(spark, none, SF_DIR)
            assert left.columns == none.columns and left.count() == 0, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert {repr(r["doc_id"]) for r in pack(spark, odd, SF_DIR).collect()} == {repr(i) for i, _ in EDGES}
    assert pack(spark, empty, SF_DIR).count() == pack(spark, few, SF_DIR).count() == 0


def test_rows_are_told_apart_whatever_a_short_hash_says(spark):
    """Different texts with null ids and one 32-bit hash: both stay, and nothing of them is removed."""
    words = lambda i: F.regexp_replace(F.sha2(i.cast("string"), 512), "(.{8})", "$1 ")
    many = spark.range(200_000).select(F.concat(words(F.col("id")), words(-F.col("id") - 1)).alias("text"))
    pairs = many.withColumn("h", F.hash("text")).groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) = 2").limit(1).collect()
    assert pairs
    for p in pairs:
        a, b = p["t"]
        docs = spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string")
        assert a != b
        assert minhash.deduplicate(docs).count() == 2
        assert [r["n_removed"] for r in suffix_dedup.measure(docs).collect()] == [0, 0]


def test_many_equal_rows_of_one_id(spark):
    rng = random.Random(22)
    text, other = prose(rng, 90), prose(rng, 90)
    docs = spark.createDataFrame([(1, text)] * 3000 + [(2, other)] + [(None, text)] * 500, "doc_id long, text string").repartition(7)
    got = suffix_dedup.measure(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    size = len(text.encode())
    assert sorted(map(tuple, got), key=repr) == sorted([(1, size, 1, 3000), (2, 0, 0, 1), (None, size, 1, 500)], key=repr)
    assert sorted(r["doc_id"] for r in minhash.deduplicate(docs).collect()) == [1, 2]
    assert {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 2), (None, 1)}
