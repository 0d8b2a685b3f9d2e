"""One query per corpus operator, over whole tables, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import (
    decontaminate,
    hadamard_clusters,
    hmm,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    pii,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
    whitening,
)
from docframe.plans.ship import ship
from docframe.plans.stage import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query()
def op2_personal_data(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def count(kind: int, name: str):
        return F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("found"), True), 256).alias("base_sha256"), pii.span_list(F.col("found")).alias("spans"))


_LINES_SQL = r"""
WITH f AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM f WHERE has),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, range(3) t(o) WHERE k > 1),
gone AS (SELECT n.doc_id, n.i FROM n JOIN g USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM f ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@_query(_LINES_SQL)
def op3_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS lo FROM win GROUP BY h) USING (h) WHERE lo < doc_id),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM late, range(50) t(o)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@_query(_PASSAGES_SQL)
def op4_substring_dedup(spark, sf_dir):
    kept = substring_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query(mixing.mix_sql())
def op5_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.n_words("text").alias("size")), "sizes")
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


@_query(decontaminate.contaminated_sql())
def op6_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


_JOIN_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS_SQL} AS w
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT v, r FROM reach JOIN edges USING (u))
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.r AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(r) AS r FROM reach GROUP BY u) m USING (doc_id)"""


@_query(_JOIN_SQL)
def op7_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs, width=3, percent=90)


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


@_query()
def op8_hidden_markov_scores(spark, sf_dir):
    return hmm.score_texts(table(spark, sf_dir, "documents"), _remainder(7) == 2)


@_query()
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(_remainder(4) != 2))
    held = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return language_id.predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


@_query()
def op10_quality_rules(spark, sf_dir):
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query()
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, k, substr(x, 1000 * k + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) + 999) // 1000)) AS k FROM d)),
byte AS (SELECT doc_id, 500 * k + j AS i, substr(y, 2 * j - 1, 2) AS c, CASE WHEN 2 * j + 98 <= len(y) THEN md5_number(substr(y, 2 * j - 1, 100)) END AS h
         FROM (SELECT doc_id, k, y, unnest(range(1, least(500, len(y) // 2) + 1)) AS j FROM part)),
low AS (SELECT h, min(doc_id) AS lo FROM byte WHERE h IS NOT NULL GROUP BY h),
late AS (SELECT doc_id, i, c, coalesce(lo < doc_id, false) AS late FROM byte LEFT JOIN low USING (h)),
cut AS (SELECT doc_id, i, c, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM late),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cut),
total AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS k, string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS t FROM edge GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id)"""


@_query(_BYTES_SQL)
def op12_suffix_dedup(spark, sf_dir):
    kept = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query(hadamard_clusters.clusters_sql())
def op13_hadamard_clusters(spark, sf_dir):
    found = hadamard_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
