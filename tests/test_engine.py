"""Statistics, index, joins, estimates, sources and streams."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from raregram.functions.minimal import padded_words
from raregram.functions.sql import register
from raregram.operators import Frequencies, GramIndex, analyze, like, like_join, like_share, like_share_of, not_like, qgram_stat, rare_grams, rare_grams_udf
from raregram.operators.statistics import read_stats, write_stats
from raregram.options import GramOptions
from raregram.plans import catalog
from raregram.plans.access import choose, search
from raregram.sources import text_lines, write_lines
from raregram.streaming import GramIngest, stream_frequencies


def some_texts(n=120, seed=3):
    rng = random.Random(seed)
    syllables = ["in", "dex", "ing", "the", "zz", "an", "no", "ta", "tion", "x"]
    make = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = [" ".join(make() if rng.random() < 0.9 else make().upper() for _ in range(rng.randint(0, 7))) for _ in range(n)]
    return out + [None, "", "a_b 100% c\\d", "wor\u212aing \u0130n", "the, index.", "a"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(some_texts())), "row_id long, s string").cache()


def brute_stat(texts, low, high, share):
    count = {}
    for t in texts:
        for g in {w[p : p + q] for w in padded_words(t or "") for q in range(low, high + 1) for p in range(len(w) - q + 1)}:
            count[g] = count.get(g, 0) + 1
    limit = int((len(texts) - 1) * share)
    return sorted((g for g, n in count.items() if n >= limit), key=str.encode)


def test_qgram_stat(spark, docs):
    texts = some_texts()
    assert qgram_stat(docs, "s", 2, 4, 0.05).first()["grams"] == brute_stat(texts, 2, 4, 0.05)
    rows = [("a", "abc"), ("a", "abd"), ("b", None), ("b", None), (None, "xy"), ("c", "q")]
    df = spark.createDataFrame(rows, "k string, s string")
    got = {r["k"]: r["grams"] for r in qgram_stat(df, "s", 2, 3, 0.5, by=["k"]).collect()}
    assert got == {"a": brute_stat(["abc", "abd"], 2, 3, 0.5), "b": [], None: brute_stat(["xy"], 2, 3, 0.5), "c": brute_stat(["q"], 2, 3, 0.5)}
    assert qgram_stat(df.where("false"), "s", 2, 3, 0.5).first()["grams"] is None
    assert qgram_stat(df.where("k = 'b'"), "s", 2, 3, 0.5).first()["grams"] == []
    with pytest.raises(ValueError):
        qgram_stat(df, "s", 3, 2, 0.5)


def test_rollup_counts_every_gram(spark, tmp_path):
    """All grams of all words, by language and over all; not only the first three characters of a word."""
    texts = [("en", "indexing the index"), ("en", "zz Index"), ("de", "index"), ("de", None), ("fr", "")]
    spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in texts:
        for g in {w[p : p + q] for w in padded_words(t or "") for q in (2, 3, 4) for p in range(len(w) - q + 1)}:
            for key in ((k, g), (k, None), (None, None)):
                want[key] = want.get(key, 0) + 1
    got = catalog.qgram_stat_rollup(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["lang"], r["gram"]): r["df"] for r in got} == want


def test_rare_grams_paths_agree(spark, docs):
    frequent = qgram_stat(docs, "s", 2, 4, 0.2).first()["grams"]
    a = {r["row_id"]: r["grams"] for r in rare_grams(docs, "row_id", "s", GramOptions(2, 4, tuple(frequent))).collect()}
    b = {r["row_id"]: r["g"] for r in docs.select("row_id", rare_grams_udf(F.col("s"), 2, 4, frequent).alias("g")).collect()}
    assert {k: v and list(v) for k, v in b.items()} == {k: v and list(v) for k, v in a.items()}


def as_regex(pattern, fold):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i].lower() if fold else pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c.lower() if fold else c))
        i += 1
    return re.compile(out, re.DOTALL)


PATTERNS = ["%index%", "%", "", "_", "a", "%zz%", "the%", "%ing", "%in_ex%", "%a\\_b%", "%100\\%%", "%\\index%", "%, index.", "% the %", "%NOTA%", "c\\\\d", "%c\\\\d", "a_b%", "%worK%", "%rki%", "%in%"]


@pytest.mark.parametrize("options", [(2, 4, 0.1), (3, 3, None), (2, 5, None), (1, 2, 0.3)])
def test_index_answers_are_scan_answers(spark, docs, tmp_path, options):
    low, high, share = options
    frequent = tuple(qgram_stat(docs, "s", low, high, share).first()["grams"]) if share else ()
    index = GramIndex.build(docs, "row_id", "s", GramOptions(low, high, frequent)).write(str(tmp_path / "index"), 3)
    assert index.options == GramOptions(low, high, frequent)
    texts = some_texts()
    for p in PATTERNS if options == (2, 4, 0.1) else PATTERNS[::4]:
        for fold in (False, True):
            r = as_regex(p, fold)
            want = [i for i, t in enumerate(texts) if t is not None and r.fullmatch(t.lower() if fold else t)]
            got = sorted(x["row_id"] for x in index.search(docs, "row_id", "s", p, fold=fold).collect())
            assert got == want, (p, fold)
    assert index.like(docs, "row_id", "s", None).count() == 0
    assert index.like(docs, "row_id", "s", "%zz%", probe=1).count() == sum("zz" in (t or "") for t in texts)
    assert GramIndex.drop(spark, str(tmp_path / "index")) and not GramIndex.drop(spark, str(tmp_path / "index"))


def test_frequent_set_of_longer_grams_loses_no_row(spark):
    """A set that lacks the short substrings of its grams is closed by the options."""
    df = spark.createDataFrame([(i, "computing") for i in range(30)] + [(99, "omp")], "row_id long, s string")
    frequent = tuple(qgram_stat(df, "s", 3, 4, 0.05).first()["grams"])
    index = GramIndex.build(df, "row_id", "s", GramOptions(2, 4, frequent))
    assert index.like(df, "row_id", "s", "%omp%").count() == 31


def test_not_like_and_column(spark, docs):
    texts = some_texts()
    assert not_like(docs, "s", "%the%").count() == sum(t is not None and "the" not in t for t in texts)
    assert not_like(docs, "s", None).count() == 0
    got = [r[0] for r in docs.select(like(F.col("s"), "%\\the%")).collect()]
    assert got == [None if t is None else "the" in t for t in texts]
    assert docs.select(like(F.col("s"), None)).first()[0] is None


def test_like_join(spark, docs):
    patterns = spark.createDataFrame([(i, p) for i, p in enumerate(PATTERNS)] + [(99, None)], "p int, pattern string")
    index = GramIndex.build(docs, "row_id", "s", GramOptions(3, 3))
    for fold in (False, True):
        got = sorted(map(tuple, like_join(docs, "row_id", "s", patterns, "p", "pattern", index, fold).collect()))
        want = sorted((k, i) for k, p in enumerate(PATTERNS) for i, t in enumerate(some_texts()) if t is not None and as_regex(p, fold).fullmatch(t.lower() if fold else t))
        assert got == want


def test_like_join_in_several_blocks(spark, docs, monkeypatch):
    """Patterns without keys are as many as there are, in blocks; the matches are those of one block."""
    patterns = spark.createDataFrame([(i, p) for i, p in enumerate(PATTERNS)] + [(99, None)], "p int, pattern string")
    index = GramIndex.build(docs, "row_id", "s", GramOptions(3, 3))
    once = sorted(map(tuple, like_join(docs, "row_id", "s", patterns, "p", "pattern", index).collect()))
    monkeypatch.setattr(sys.modules["raregram.operators.like_join"], "BLOCK", 2)
    assert sorted(map(tuple, like_join(docs, "row_id", "s", patterns, "p", "pattern", index).collect())) == once
    assert like_join(docs, "row_id", "s", patterns.where("false"), "p", "pattern", index).count() == 0


def test_statistics_and_estimates(spark, docs, tmp_path):
    texts = some_texts()
    stats = analyze(docs, "s")
    write_stats(stats, str(tmp_path / "stats"))
    stats = read_stats(spark, str(tmp_path / "stats"))
    s = stats.summary.first()
    occ = sum(1 for t in texts for w in padded_words(t or "") for q in (1, 2, 3) for p in range(len(w) - q + 1))
    assert (s["n_rows"], s["occurrences"]) == (len(texts), occ)
    assert s["null_frac"] == pytest.approx(1 / len(texts)) and s["n_distinct"] == pytest.approx(1 / len(texts) - 1)
    f = Frequencies.of(stats)
    n = len(texts) - 1
    assert f.freq["the"] == np.float32(sum("the" in (t or "").lower() for t in texts) / n)
    assert like_share("%the%", f) == pytest.approx(float(f.freq["the"]) * n / len(texts), rel=1e-6)
    assert like_share("%THE%", f) == like_share("%the%", f)
    assert like_share("%qqq%", f) == pytest.approx(float(f.least) / 2 * n / len(texts), rel=1e-6)
    want = f.freq["ind"] * (f.of_gram("nde") / f.freq["nd"])
    assert like_share("%inde%", f) == pytest.approx(float(want) * n / len(texts), rel=1e-5)
    assert like_share("%", f) == pytest.approx(n / len(texts))
    assert (like_share(None, f), like_share("%a%", None), like_share("%a%", f, constant=False)) == (0.0, 0.05, 0.05)
    table = spark.createDataFrame([("%the%",), (None,)], "p string")
    assert [r[0] for r in table.select(like_share_of(F.col("p"), f)).collect()] == [like_share("%the%", f), 0.0]
    empty = analyze(docs.where("s is null"), "s")
    assert Frequencies.of(empty) is None
    assert tuple(empty.summary.select("null_frac", "avg_width", "n_distinct").first()) == (1.0, 0.0, 0.0)
    assert analyze(docs, "s", sample=True).summary.first()["n_rows"] > 0


def test_access_path(spark, docs):
    index = GramIndex.build(docs, "row_id", "s", GramOptions(3, 3))
    f = Frequencies.of(analyze(docs, "s"))
    assert choose(index, "%zz%", f).path == "scan"
    assert choose(index, "%the%").path == "index"
    assert choose(index, "%a%", f).path == "scan" and "no key" in str(choose(index, "%a%", f))
    for p in ("%indexing%", "%a%", "%the%"):
        assert search(index, docs, "row_id", "s", p, f).count() == sum(t is not None and as_regex(p, False).fullmatch(t) is not None for t in some_texts())


def test_lines_round_trip(spark, tmp_path):
    values = ["plain", "tab\there", "new\nline", "back\\slash", None, "", "\\N is text", "a\\tb"]
    write_lines(spark.createDataFrame([(v,) for v in values], "s string").coalesce(1), str(tmp_path / "x"))
    got = [r["s"] for r in text_lines(spark, str(tmp_path / "x")).collect()]
    assert sorted(got, key=str) == sorted(values, key=str)


def test_sql_functions(spark):
    register(spark, rare_grams="short_grams")
    r = spark.sql("select short_grams('a', 2, 2, array()) g, gram_cmp('a', 'b') c, gram_like('xab', r'%\\ab') l, gram_ilike('AB', 'a_') i, gram_like(null, '%') n").first()
    assert (list(r["g"]), r["c"], r["l"], r["i"], r["n"]) == (["$a", "a$"], -1, True, True, None)
    got = {x[0]: x[1] for x in spark.sql("select k, qgram_stat(t, 2, 3, 0.5D) from values (1, 'abc'), (1, 'abd'), (2, null) x(k, t) group by k").collect()}
    assert got[2] == [] and got[1] == brute_stat(["abc", "abd"], 2, 3, 0.5)
    assert {tuple(x) for x in spark.sql("select * from gram_stat('abab', 2, 2)").collect()} == {("$a", 1), ("ab", 1), ("ba", 1), ("b$", 1)}


def test_streams(spark, docs, tmp_path):
    src = str(tmp_path / "in")
    docs.repartition(3).write.parquet(src)
    stream = spark.readStream.schema("row_id long, s string").option("maxFilesPerTrigger", 1).parquet(src)
    q = GramIngest(str(tmp_path / "index"), "row_id", "s", GramOptions(3, 3)).start(stream, str(tmp_path / "ck"))
    q.awaitTermination(120)
    index = GramIndex.read(spark, str(tmp_path / "index"))
    assert index.like(docs, "row_id", "s", "%index%").count() == sum("index" in (t or "") for t in some_texts())
    q = stream_frequencies(spark.readStream.schema("row_id long, s string").parquet(src), "s", 3, 3).writeStream.outputMode("complete").format("memory").queryName("freqs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("freqs").where("gram = 'the'").first()["df"] == sum("the" in (t or "").lower() for t in some_texts())
