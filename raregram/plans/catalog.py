"""Queries over the driver's tables and the SQL that DuckDB answers the same with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregram.functions.patterns import keys as pattern_keys
from raregram.functions.sql import register
from raregram.functions.words import all_present, compare, gram_text, sorted_keys, words
from raregram.operators import (
    Frequencies,
    GramIndex,
    analyze,
    first_rare_grams,
    gram_frequencies,
    like_join,
    like_share,
    like_share_of,
    not_like,
    qgram_stat,
    rare_grams,
    rare_grams_udf,
    store_rows,
)
from raregram.operators.extract import word_occurrences
from raregram.operators.statistics import frequent_grams, read_stats, write_stats
from raregram.options import GramOptions
from raregram.plans.access import search as planned_search
from raregram.sources import parquet_table, scratch_dir, spread, text_lines, write_lines

Query = Callable[[SparkSession, str], DataFrame]

MIN_Q, MAX_Q, THRESHOLD = 2, 4, 0.05
#: Patterns that the estimates and the join are run for.
PATTERNS = ["%the%", "%tion%", "% of the %", "%th_re%", "%zz%", "%license%", "the%", "%xi%", "%", "%QUALITY%", "%\\_%", "a%b"]

#: U+212A lower-cases to k.
ODD_TEXTS = ["abkcd", "ab\u212acd", "abxcd", "AB\u212a", "\u212a", "k", "abk cd", "wor\u212aing", "working"]
ODD_PATTERNS = ["%ab\u212acd%", "%abkcd%", "\u212a", "k", "%\u212acd", "wor\u212aing", "%king%", "ab\u212a%"]

#: Words of a column, each padded; lower-casing comes after the words are cut out.
SQL_WORDS = "list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda w: '$' || lower(w) || '$')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(parquet_table(spark, sf_dir, "documents"))


_stored: dict[tuple, tuple[str, str]] = {}


def stored(spark: SparkSession, sf_dir: str, table: str, row: str, text: str, options: GramOptions | None = None) -> tuple[GramIndex, DataFrame]:
    """The index of a column and its table laid out by row, built once in a session and searched as stored."""
    key = (spark.sparkContext.applicationId, sf_dir, table, text, options)
    if key not in _stored:
        df = parquet_table(spark, sf_dir, table).select(row, text)
        root = f"{scratch_dir(spark)}/raregram-index-{uuid.uuid4().hex}"
        store_rows(df, row, f"{root}/rows")
        df = spread(df)
        GramIndex.build(df, row, text, options or _options(df, text)).write(f"{root}/index")
        _stored[key] = f"{root}/index", f"{root}/rows"
    index, rows = _stored[key]
    return GramIndex.read(spark, index), spark.read.parquet(rows)


def _frequent(df: DataFrame, text: str = "text") -> tuple[str, ...]:
    """The frequent grams, whose number does not grow with the rows."""
    return tuple(r["gram"] for r in frequent_grams(df, text, MIN_Q, MAX_Q, THRESHOLD).select("gram").collect())


def _options(df: DataFrame, text: str = "text") -> GramOptions:
    return GramOptions(MIN_Q, MAX_Q, _frequent(df, text))


def sql_grams(table: str, text: str, low: int, high: int, keys: str) -> str:
    """CTEs ``w`` (keys, word) and ``g`` (keys, gram) with every occurrence."""
    return f"""w AS (SELECT {keys}, unnest({SQL_WORDS.format(text=text)}) AS word FROM {table}),
g AS (SELECT {keys}, substr(word, p.p, q.q) AS gram FROM w, range(1, 200) p(p), range({low}, {high + 1}) q(q) WHERE p.p + q.q - 1 <= length(word))"""


def sql_frequent(table: str, text: str, key: str) -> str:
    """CTE ``f`` (gram) of the frequent grams after :func:`sql_grams`."""
    return f"""{sql_grams(table, text, MIN_Q, MAX_Q, key)},
f AS (SELECT gram FROM (SELECT DISTINCT {key}, gram FROM g) GROUP BY gram HAVING count(*) >= floor(((SELECT count(*) FROM {table}) - 1) * {THRESHOLD}::DOUBLE))"""


def sql_word_grams(source: str, frequent: str | None, low: int, high: int) -> str:
    """CTEs up to ``mg`` (word, e, gram): the minimal rare grams of the words of ``source``."""
    rare = f"WHERE c.gram NOT IN (SELECT gram FROM {frequent})" if frequent else ""
    return f"""dict AS (SELECT DISTINCT word FROM {source}),
c AS (SELECT word, p.p AS p, p.p + q.q - 1 AS e, substr(word, p.p, q.q) AS gram FROM dict, range(1, 200) p(p), range({low}, {high + 1}) q(q) WHERE p.p + q.q - 1 <= length(word)),
s AS (SELECT word, p, min(e) AS e FROM c {rare} GROUP BY word, p),
mg AS (SELECT word, e, substr(word, max(p), e - max(p) + 1) AS gram FROM s GROUP BY word, e)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent grams of the documents with their document frequencies."""
    return frequent_grams(_docs(spark, sf_dir), "text", MIN_Q, MAX_Q, THRESHOLD).orderBy("gram")


def words_per_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))


def qgram_df_2_4(spark, sf_dir):
    return gram_frequencies(_docs(spark, sf_dir), "text", MIN_Q, MAX_Q)


def qgram_stat_global(spark, sf_dir):
    return qgram_stat(_docs(spark, sf_dir), "text", MIN_Q, MAX_Q, THRESHOLD).select(F.array_join("grams", " ").alias("grams"))


def qgram_stat_by_lang(spark, sf_dir):
    return qgram_stat(_docs(spark, sf_dir), "text", MIN_Q, MAX_Q, THRESHOLD, by=["lang"]).select("lang", F.array_join("grams", " ").alias("grams"))


def qgram_stat_null_rows(spark, sf_dir):
    """Texts of one language replaced by null: null rows still count."""
    df = _docs(spark, sf_dir).select(F.when(F.col("lang") != "fr", F.col("text")).alias("text"))
    return frequent_grams(df, "text", MIN_Q, MAX_Q, 0.1)


def qgram_stat_rollup(spark, sf_dir):
    """Gram frequencies by language and over all."""
    counts = gram_frequencies(_docs(spark, sf_dir), "text", MIN_Q, MAX_Q, by=["lang"])
    # a row has each of its grams once, so the totals are sums of the groups' counts
    return counts.rollup("lang", "gram").agg(F.sum("df").alias("df")).where("lang is not null or gram is null")


def rare_grams_part_name(spark, sf_dir):
    df = parquet_table(spark, sf_dir, "part")
    return rare_grams(df, "p_partkey", "p_name", _options(df, "p_name")).select(F.col("row_id").alias("p_partkey"), F.array_join("grams", " ").alias("grams"))


def rare_grams_documents(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return rare_grams(df, "doc_id", "text", _options(df)).select(F.col("row_id").alias("doc_id"), F.array_join("grams", " ").alias("grams"))


def rare_grams_given(spark, sf_dir):
    """The Arrow function for a frequent set as given."""
    df = parquet_table(spark, sf_dir, "part")
    return df.select("p_partkey", F.array_join(rare_grams_udf(F.col("p_name"), MIN_Q, MAX_Q, _frequent(df, "p_name")), " ").alias("grams"))


def first_rare(spark, sf_dir):
    df = parquet_table(spark, sf_dir, "benchmark")
    words_ = word_occurrences(df, "item_id", "text").select("word").distinct()
    return first_rare_grams(words_, _options(_docs(spark, sf_dir))).select("word", F.col("p").cast("long").alias("p"), "gram")


def index_postings(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return GramIndex.build(df, "doc_id", "text", _options(df)).postings.where("gram != ''").withColumnRenamed("row_id", "doc_id")


def index_posting_lengths(spark, sf_dir):
    return index_postings(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("n"))


def index_rows_without_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(index_postings(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


def index_row_keys(spark, sf_dir):
    """Keys of one row, sorted and distinct, and whether they hold two given ones."""
    df = parquet_table(spark, sf_dir, "benchmark")
    rows = rare_grams(df, "item_id", "text", GramOptions(3, 3)).select(F.col("row_id").alias("item_id"), sorted_keys(F.col("grams")).alias("k"))
    return rows.select("item_id", F.array_join("k", " ").alias("keys"), all_present(F.col("k"), ["the", "$th"]).alias("has_the"))


def trigram_index_postings(spark, sf_dir):
    return GramIndex.build(_docs(spark, sf_dir), "doc_id", "text", GramOptions(3, 3)).postings.where("gram != ''").withColumnRenamed("row_id", "doc_id")


def _searched(pattern: str | None, fold: bool = False, escape: str = "\\", table: str = "documents", row: str = "doc_id", text: str = "text", options: GramOptions | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, df = stored(spark, sf_dir, table, row, text, options)
        return index.search(df, row, text, pattern, escape, fold).select(row)

    return run


def index_candidates(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return GramIndex.build(df, "doc_id", "text", _options(df)).candidate_counts(PATTERNS)


def _sql_candidates() -> str:
    # the keys of a pattern depend on the frequent set: those of a fragment are found as those of a word
    rows = ", ".join(f"('{p}', '{f}')" for p in PATTERNS for f in _fragments(p))
    return f"""WITH {sql_frequent("documents", "text", "doc_id")},
pat(pattern, word) AS (VALUES {rows}),
src AS (SELECT word FROM w UNION SELECT word FROM pat),
{sql_word_grams("src", "f", MIN_Q, MAX_Q)},
k AS (SELECT DISTINCT pattern, gram FROM pat JOIN mg USING (word)),
post AS (SELECT DISTINCT doc_id, gram FROM w JOIN mg USING (word)),
hit AS (SELECT pattern, doc_id, count(*) AS c FROM k JOIN post USING (gram) GROUP BY pattern, doc_id)
SELECT n.pattern, count(hit.doc_id) AS n FROM (SELECT pattern, count(*) AS c FROM k GROUP BY pattern) n LEFT JOIN hit ON hit.pattern = n.pattern AND hit.c = n.c GROUP BY n.pattern"""


def _fragments(pattern: str) -> list[str]:
    from raregram.functions.patterns import fragments

    return fragments(pattern)


def like_join_patterns(spark, sf_dir):
    df = _docs(spark, sf_dir)
    patterns = spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_id long, pattern string")
    return like_join(df, "doc_id", "text", patterns, "pattern_id", "pattern", GramIndex.build(df, "doc_id", "text", _options(df))).withColumnRenamed("row_id", "doc_id")


def ilike_join_benchmark(spark, sf_dir):
    """Documents that hold a benchmark item: one pattern of the whole text for each item."""
    df = _docs(spark, sf_dir)
    items = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("%"), F.regexp_replace("text", r"([%_\\])", r"\\$1"), F.lit("%")).alias("pattern"))
    return like_join(df, "doc_id", "text", items, "item_id", "pattern", GramIndex.build(df, "doc_id", "text", GramOptions(3, 3)), fold=True).select(F.col("pattern_id").alias("item_id"), F.col("row_id").alias("doc_id"))


def planned_like(spark, sf_dir):
    """The access path chosen by the estimate."""
    df = _docs(spark, sf_dir).select("doc_id", "text")
    index = GramIndex.build(df, "doc_id", "text", _options(df))
    return planned_search(index, df, "doc_id", "text", "%tion%", Frequencies.of(analyze(df, "text"))).select("doc_id")


def gram_text_like(spark, sf_dir):
    """A column marked as gram text behaves as text."""
    df = _docs(spark, sf_dir).select("doc_id", gram_text(F.col("text")))
    return GramIndex.build(df, "doc_id", "text", GramOptions()).like(df, "doc_id", "text", "%license%").select("doc_id")


def analyze_grams(spark, sf_dir):
    return analyze(_docs(spark, sf_dir), "text").grams.select("gram", F.round(F.col("freq").cast("double"), 6).alias("freq"))


def analyze_summary(spark, sf_dir):
    s = analyze(_docs(spark, sf_dir), "text").summary
    return s.select("n_rows", "null_frac", F.round("avg_width", 6).alias("avg_width"), "n_distinct", F.round(F.col("min_freq").cast("double"), 6).alias("min_freq"), F.round(F.col("max_freq").cast("double"), 6).alias("max_freq"), "n_grams", "occurrences")


def like_selectivity(spark, sf_dir):
    stats = Frequencies.of(analyze(_docs(spark, sf_dir), "text"))
    rows = [(p, round(like_share(p, stats), 4)) for p in ["%the%", "%tion%", "%zz%", "%", "%an%", "%a%"]]
    return spark.createDataFrame(rows, "pattern string, share double")


def gram_compare_sort(spark, sf_dir):
    df = parquet_table(spark, sf_dir, "nation").select("n_name")
    other = df.select(F.col("n_name").alias("other"))
    return df.join(other, how="cross").select("n_name", "other", compare(F.col("n_name"), F.col("other")).cast("long").alias("cmp"))


def rollup_by_role(spark, sf_dir):
    """Gram frequencies of conversation turns by role and over all, every gram of every word."""
    df = parquet_table(spark, sf_dir, "conversations")
    return gram_frequencies(df, "text", MIN_Q, MAX_Q, by=["role"]).rollup("role", "gram").agg(F.sum("df").alias("df")).where("role is not null or gram is null")


def index_probe(spark, sf_dir):
    """A search by the two rarest keys alone."""
    index, df = stored(spark, sf_dir, "documents", "doc_id", "text")
    return index.like(df, "doc_id", "text", "%quality%license%", probe=2).select("doc_id")


def index_dropped(spark, sf_dir):
    """Whether an index is there to drop, and again."""
    path = f"{scratch_dir(spark)}/raregram-index-{uuid.uuid4().hex}"
    GramIndex.build(parquet_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", GramOptions(3, 3)).write(path)
    return spark.createDataFrame([(i, GramIndex.drop(spark, path)) for i in (1, 2)], "turn long, dropped boolean")


def statistics_store(spark, sf_dir):
    """Column statistics written and read again."""
    path = f"{scratch_dir(spark)}/raregram-stats-{uuid.uuid4().hex}"
    write_stats(analyze(_docs(spark, sf_dir), "text"), path)
    return read_stats(spark, path).grams.select("gram", F.round(F.col("freq").cast("double"), 6).alias("freq"))


def like_share_table(spark, sf_dir):
    """Estimates for a column of patterns."""
    stats = Frequencies.of(analyze(_docs(spark, sf_dir), "text"))
    rows = spark.createDataFrame([(p,) for p in ("%the%", "%tion%", "%zz%", "%an%", "%a%", "%")], "pattern string")
    return rows.select("pattern", F.round(like_share_of(F.col("pattern"), stats), 4).alias("share"))


def text_lines_round_trip(spark, sf_dir):
    """Texts written as lines of the bulk format and read again."""
    path = f"{scratch_dir(spark)}/raregram-lines-{uuid.uuid4().hex}"
    write_lines(parquet_table(spark, sf_dir, "documents").select(F.col("text").alias("s")), path)
    return text_lines(spark, path)


def ilike_odd_case(spark, sf_dir):
    """Texts and patterns with letters whose lower case is an ASCII letter, by the index."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "row_id long, s string")
    index = GramIndex.build(df, "row_id", "s", GramOptions(2, 4))
    out = [index.ilike(df, "row_id", "s", p).select(F.lit(p).alias("pattern"), "row_id") for p in ODD_PATTERNS]
    joined = like_join(df, "row_id", "s", spark.createDataFrame(list(enumerate(ODD_PATTERNS)), "i long, p string"), "i", "p", index, fold=True)
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    patterns = spark.createDataFrame([(i, p) for i, p in enumerate(ODD_PATTERNS)], "pattern_id long, pattern string")
    return both.withColumn("way", F.lit("index")).unionByName(joined.join(patterns, "pattern_id").select("pattern", "row_id", F.lit("join").alias("way")))


def index_options(spark, sf_dir):
    """Options and what is said of bad ones."""
    rows = []
    for low, high in ((2, 5), (-1, 2), (2, 11), (4, 2)):
        try:
            o = GramOptions(low, high)
            rows.append((low, high, f"{o.min_q} {o.max_q} {len(o.frequent)}"))
        except ValueError as e:
            rows.append((low, high, str(e)))
    return spark.createDataFrame(rows, "minq long, maxq long, said string")


def _sql(text: str) -> Query:
    """A query by the SQL names of the functions; ``{table}`` is the Parquet file of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

    return run


def pattern_key_table(spark, sf_dir):
    """Keys of patterns under plain three-character grams."""
    rows = [(p, " ".join(pattern_keys(p, GramOptions(3, 3)))) for p in PATTERNS]
    return spark.createDataFrame(rows, "pattern string, keys string")


_LIKES: dict[str, tuple[str, bool]] = {
    "like_contains": ("%license%", False),
    "like_prefix": ("The%", False),
    "like_suffix": ("%nd.", False),
    "like_underscore": ("%th_re%", False),
    "like_multiword": ("% of the %", False),
    "like_no_keys": ("%", False),
    "ilike_contains": ("%LiCeNsE%", True),
    "ilike_multiword": ("% OF THE %", True),
}

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        words_per_doc, qgram_df_2_4, qgram_stat_global, qgram_stat_by_lang, qgram_stat_null_rows, qgram_stat_rollup, rare_grams_part_name, rare_grams_documents, rare_grams_given, first_rare, index_postings,
        index_posting_lengths, index_rows_without_keys, index_row_keys, trigram_index_postings, index_candidates, like_join_patterns, ilike_join_benchmark, planned_like, gram_text_like, analyze_grams,
        analyze_summary, like_selectivity, gram_compare_sort, pattern_key_table, rollup_by_role, index_probe, index_dropped, statistics_store, like_share_table, text_lines_round_trip,
        ilike_odd_case, index_options,
    )
}
QUERIES["frequent_grams"] = lambda spark, sf_dir: flagship(spark, sf_dir)
QUERIES |= {name: _searched(p, fold) for name, (p, fold) in _LIKES.items()}
QUERIES["like_escape"] = _searched("%/_%", escape="/", table="pages", row="page_id", text="url", options=GramOptions(3, 3))
QUERIES["ilike_escape"] = _searched("%T%!%%", fold=True, escape="!", table="pages", row="page_id", text="html", options=GramOptions(3, 3))
QUERIES["like_exact"] = _searched("NATION\\_3", table="nation", row="n_nationkey", text="n_name", options=GramOptions(3, 3))
QUERIES["like_null_pattern"] = _searched(None)
QUERIES["sql_gram_like"] = _sql(r"SELECT doc_id FROM {documents} WHERE gram_like(text, r'%\l\icense%')")
QUERIES["sql_gram_ilike"] = _sql("SELECT doc_id FROM {documents} WHERE gram_ilike(text, '%OF THE%')")
QUERIES["sql_gram_cmp"] = _sql("SELECT r_name, CAST(gram_cmp(r_name, 'ASIA') AS BIGINT) AS cmp FROM {region}")
QUERIES["sql_gram_keys"] = _sql("SELECT item_id, array_join(gram_keys(concat('%', regexp_extract(text, '[a-z]{5,}', 0), '%'), 3, 3, array()), ' ') AS keys FROM {benchmark}")
QUERIES["sql_gram_stat"] = _sql("SELECT gram, sum(df) AS df FROM {benchmark}, LATERAL gram_stat(text, 2, 3) GROUP BY gram")
QUERIES["sql_qgram_stat"] = _sql("SELECT role, array_join(qgram_stat(text, 2, 4, 0.3D), ' ') AS grams FROM {conversations} GROUP BY role")
QUERIES["not_like"] = lambda spark, sf_dir: not_like(_docs(spark, sf_dir), "text", "%the%").select("doc_id")

_F = sql_frequent("documents", "text", "doc_id")
_TOP = f"""WITH {sql_grams("documents", "text", 1, 3, "doc_id")},
t AS (SELECT count(*) AS occ FROM g), n AS (SELECT count(*) AS n_rows, count(text) AS n_text FROM documents),
d AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, gram FROM g) GROUP BY gram),
top AS (SELECT gram, df, (df / (SELECT n_text FROM n))::FLOAT AS freq FROM d WHERE df > floor(9 * (SELECT occ FROM t) / 144285) ORDER BY df DESC, gram LIMIT 1000)"""


def _like_sql(p: str, fold: bool) -> str:
    return f"SELECT doc_id FROM documents WHERE text {'ILIKE' if fold else 'LIKE'} '{p}' ESCAPE '\\'"


_PATTERN_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))
_SHARES = "least(1, greatest(0, {x}))"

ORACLES: dict[str, str] = {
    "frequent_grams": f"WITH {_F} SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, gram FROM g) WHERE gram IN (SELECT gram FROM f) GROUP BY gram",
    "words_per_doc": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n_words FROM documents",
    "qgram_df_2_4": f"WITH {sql_grams('documents', 'text', 2, 4, 'doc_id')} SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, gram FROM g) GROUP BY gram",
    "qgram_stat_global": f"WITH {_F} SELECT string_agg(gram, ' ' ORDER BY gram) AS grams FROM f",
    "qgram_stat_by_lang": f"""WITH {sql_grams('documents', 'text', 2, 4, 'doc_id, lang')},
c AS (SELECT lang, gram, count(*) AS df FROM (SELECT DISTINCT doc_id, lang, gram FROM g) GROUP BY lang, gram),
n AS (SELECT lang, count(*) AS rows FROM documents GROUP BY lang)
SELECT lang, string_agg(gram, ' ' ORDER BY gram) AS grams FROM c JOIN n USING (lang) WHERE df >= floor((rows - 1) * 0.05::DOUBLE) GROUP BY lang""",
    "qgram_stat_null_rows": f"""WITH d AS (SELECT doc_id, CASE WHEN lang != 'fr' THEN text END AS text FROM documents),
{sql_grams('d', 'text', 2, 4, 'doc_id')}
SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, gram FROM g) GROUP BY gram HAVING count(*) >= floor(((SELECT count(*) FROM d) - 1) * 0.1::DOUBLE)""",
    "qgram_stat_rollup": f"""WITH w AS (SELECT doc_id, lang, unnest({SQL_WORDS.format(text='text')}) AS word FROM documents),
o AS (SELECT DISTINCT doc_id, lang, substr(word, 1, 3) AS gram FROM w)
SELECT lang, gram, count(*) AS df FROM o GROUP BY ROLLUP (lang, gram) HAVING lang IS NOT NULL OR gram IS NULL""",
    "rare_grams_part_name": "",
    "rare_grams_documents": "",
    "rare_grams_given": "",
    "first_rare": f"""WITH {_F},
bw AS (SELECT unnest({SQL_WORDS.format(text='text')}) AS word FROM benchmark), {sql_word_grams('bw', 'f', 2, 4)} SELECT word, p, substr(word, p, e - p + 1) AS gram FROM s""",
    "index_postings": f"WITH {_F}, {sql_word_grams('w', 'f', 2, 4)} SELECT DISTINCT gram, doc_id FROM w JOIN mg USING (word)",
    "index_posting_lengths": f"WITH {_F}, {sql_word_grams('w', 'f', 2, 4)} SELECT gram, count(DISTINCT doc_id) AS n FROM w JOIN mg USING (word) GROUP BY gram",
    "index_rows_without_keys": f"WITH {_F}, {sql_word_grams('w', 'f', 2, 4)} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM w JOIN mg USING (word))",
    "index_row_keys": f"""WITH w AS (SELECT item_id, unnest({SQL_WORDS.format(text='text')}) AS word FROM benchmark),
{sql_word_grams('w', None, 3, 3)}, k AS (SELECT DISTINCT item_id, gram FROM w JOIN mg USING (word))
SELECT item_id, string_agg(gram, ' ' ORDER BY gram) AS keys, count(*) FILTER (WHERE gram IN ('the', '$th')) = 2 AS has_the FROM k GROUP BY item_id""",
    "trigram_index_postings": f"WITH w AS (SELECT doc_id, unnest({SQL_WORDS.format(text='text')}) AS word FROM documents), {sql_word_grams('w', None, 3, 3)} SELECT DISTINCT gram, doc_id FROM w JOIN mg USING (word)",
    "index_candidates": _sql_candidates(),
    "like_join_patterns": f"WITH p(pattern_id, pattern) AS (VALUES {_PATTERN_ROWS}) SELECT pattern_id::BIGINT AS pattern_id, doc_id FROM documents JOIN p ON text LIKE pattern ESCAPE '\\'",
    "ilike_join_benchmark": "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON d.text ILIKE '%' || substr(b.text, 1, 40) || '%' ESCAPE '\\'",
    "planned_like": _like_sql("%tion%", False),
    "gram_text_like": _like_sql("%license%", False),
    "analyze_grams": f"{_TOP} SELECT gram, round(freq::DOUBLE, 6) AS freq FROM top",
    "analyze_summary": f"""{_TOP} SELECT n_rows, 1 - n_text / n_rows AS null_frac, (SELECT round(avg(strlen(text)), 6) FROM documents) AS avg_width, (1 - n_text / n_rows) - 1 AS n_distinct,
(SELECT round(min(freq)::DOUBLE, 6) FROM top) AS min_freq, (SELECT round(max(freq)::DOUBLE, 6) FROM top) AS max_freq, (SELECT count(*) FROM top) AS n_grams, (SELECT occ FROM t) AS occurrences FROM n""",
    "like_selectivity": f"""{_TOP}, m AS (SELECT min(freq) / 2 AS half FROM top),
p(pattern, first, den, num) AS (VALUES ('%the%', 'the', '', ''), ('%tion%', 'tio', 'io', 'ion'), ('%zz%', 'zz', '', ''), ('%an%', 'an', '', ''), ('%a%', 'a', '', ''))
SELECT pattern, round({_SHARES.format(x='coalesce(a.freq, half) * CASE WHEN den = $$$$ THEN 1 ELSE coalesce(c.freq, half) / b.freq END')}::DOUBLE, 4) AS share
FROM p CROSS JOIN m LEFT JOIN top a ON a.gram = first LEFT JOIN top b ON b.gram = den LEFT JOIN top c ON c.gram = num UNION ALL SELECT '%', 1.0""",
    "gram_compare_sort": "SELECT a.n_name, b.n_name AS other, CASE WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name > b.n_name THEN 1 ELSE 0 END::BIGINT AS cmp FROM nation a, nation b",
    "pattern_key_table": f"""WITH pat(pattern, word) AS (VALUES {", ".join(f"('{p}', '{f}')" for p in PATTERNS for f in _fragments(p))}), {sql_word_grams('pat', None, 3, 3)},
allp(pattern) AS (VALUES {", ".join(f"('{p}')" for p in PATTERNS)})
SELECT a.pattern, coalesce(string_agg(DISTINCT gram, ' ' ORDER BY gram), '') AS keys FROM allp a LEFT JOIN pat USING (pattern) LEFT JOIN mg USING (word) GROUP BY a.pattern""",
    "like_escape": "SELECT page_id FROM pages WHERE url LIKE '%/_%' ESCAPE '/'",
    "ilike_escape": "SELECT page_id FROM pages WHERE html ILIKE '%T%!%%' ESCAPE '!'",
    "like_exact": "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION_3' AND n_name = 'NATION_3'",
    "like_null_pattern": "SELECT doc_id FROM documents WHERE text LIKE NULL",
    "rollup_by_role": f"""WITH {sql_grams('conversations', 'text', 2, 4, 'conv_id, turn, role')},
o AS (SELECT DISTINCT conv_id, turn, role, gram FROM g)
SELECT role, gram, count(*) AS df FROM o GROUP BY ROLLUP (role, gram) HAVING role IS NOT NULL OR gram IS NULL""",
    "index_probe": _like_sql("%quality%license%", False),
    "index_dropped": "SELECT * FROM (VALUES (1::BIGINT, true), (2::BIGINT, false)) v(turn, dropped)",
    "text_lines_round_trip": "SELECT text AS s FROM documents",
    "ilike_odd_case": "",
    "index_options": """SELECT * FROM (VALUES (2::BIGINT, 5::BIGINT, '2 5 0'), (-1, 2, 'value -1 out of bounds for option "minq": valid values are between "1" and "10"'),
(2, 11, 'value 11 out of bounds for option "maxq": valid values are between "1" and "10"'), (4, 2, '"minq" must not be greater than "maxq"')) v(minq, maxq, said)""",
    "sql_gram_like": _like_sql("%license%", False),
    "sql_gram_ilike": _like_sql("%of the%", True),
    "sql_gram_cmp": "SELECT r_name, (CASE WHEN r_name < 'ASIA' THEN -1 WHEN r_name > 'ASIA' THEN 1 ELSE 0 END)::BIGINT AS cmp FROM region",
    "sql_gram_keys": """WITH p AS (SELECT item_id, regexp_extract(text, '[a-z]{5,}', 0) AS s FROM benchmark),
g AS (SELECT DISTINCT item_id, substr(s, p, 3) AS gram FROM p, range(1, 100) r(p) WHERE p + 2 <= length(s))
SELECT item_id, coalesce(string_agg(gram, ' ' ORDER BY gram), '') AS keys FROM p LEFT JOIN g USING (item_id) GROUP BY item_id""",
    "sql_gram_stat": f"WITH {sql_grams('benchmark', 'text', 2, 3, 'item_id')} SELECT gram, count(DISTINCT item_id)::BIGINT AS df FROM g GROUP BY gram",
    "sql_qgram_stat": f"""WITH {sql_grams('conversations', 'text', 2, 4, 'conv_id, turn, role')},
c AS (SELECT role, gram, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, role, gram FROM g) GROUP BY role, gram),
n AS (SELECT role, count(*) AS rows FROM conversations GROUP BY role)
SELECT role, string_agg(gram, ' ' ORDER BY gram) AS grams FROM c JOIN n USING (role) WHERE df >= floor((rows - 1) * 0.3::DOUBLE) GROUP BY role""",
    "not_like": "SELECT doc_id FROM documents WHERE text NOT LIKE '%the%' ESCAPE '\\'",
}
ORACLES |= {name: _like_sql(p, fold) for name, (p, fold) in _LIKES.items()}
ORACLES["statistics_store"], ORACLES["like_share_table"] = ORACLES["analyze_grams"], ORACLES["like_selectivity"]
# U+212A is written as the k that both sides fold it to
ORACLES["ilike_odd_case"] = f"""WITH t(row_id, s) AS (VALUES {", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(ODD_TEXTS))}), p(pattern) AS (VALUES {", ".join(f"('{p}')" for p in ODD_PATTERNS)})
SELECT pattern, row_id, way FROM t, p, (VALUES ('index'), ('join')) w(way) WHERE replace(s, '\u212a', 'k') ILIKE replace(pattern, '\u212a', 'k')"""


def _ordered(table: str, key: str, text: str) -> str:
    """Grams of each row in the order of its words and their ends."""
    return f"""WITH {sql_frequent(table, text, key)}, {sql_word_grams('w', 'f', 2, 4)},
o AS (SELECT {key}, word, n FROM (SELECT {key}, unnest({SQL_WORDS.format(text=text)}) AS word, generate_subscripts({SQL_WORDS.format(text=text)}, 1) AS n FROM {table}))
SELECT t.{key}, coalesce(string_agg(mg.gram, ' ' ORDER BY o.n, mg.e), '') AS grams FROM {table} t LEFT JOIN o USING ({key}) LEFT JOIN mg USING (word) GROUP BY t.{key}"""


ORACLES["rare_grams_part_name"] = ORACLES["rare_grams_given"] = _ordered("part", "p_partkey", "p_name")
ORACLES["rare_grams_documents"] = _ordered("documents", "doc_id", "text")
