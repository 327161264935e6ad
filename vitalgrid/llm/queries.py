"""The registered queries of this package: (session, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import ship

Build = Callable[[SparkSession, str], DataFrame]


def prepared(build: Build) -> Build:
    """Sends the package to the executors before the query is built."""
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return build(spark, folder)
    return run


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import fifth, score_toxicity
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = score_toxicity(docs, read(spark, folder, "labels").where(~fifth()))
    return found.select("doc_id", fifth().alias("held_out"), "score", "predicted", "neighbours")


def op6_resample(spark: SparkSession, folder: str) -> DataFrame:
    from .resampling import resample
    good = read(spark, folder, "labels").where("quality = 1")
    return resample(read(spark, folder, "documents").select("doc_id", "text"), good)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .separators import count_tokens, token_streams
    end = 65535  # no text can hold it: the vocabulary ends at 49407, its own mark of an end
    blocks, order = token_streams(read(spark, folder, "documents").select("doc_id", "text"), end)
    counts = count_tokens(blocks, end)
    return counts.join(order, ["stream", "place"]).select(F.col("id").alias("doc_id"), "stream", "place", "n_tokens", "closed")


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from .neighbours import search
    return search(read(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import find_contamination
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op1_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import near_duplicates
    return near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    from .language import identify, third
    return identify(read(spark, folder, "documents"), third())


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from .secret_scan import find_secrets
    return find_secrets(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack
    return pack(read(spark, folder, "documents").select("doc_id", "text"))


def op10_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    from .hidden_markov import fifth_one, score_texts
    return score_texts(read(spark, folder, "documents").select("doc_id", "text"), fifth_one())


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from .ranking import rank
    return rank(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .collocations import collocations
    return collocations(read(spark, folder, "documents").select("text", "lang"))


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from .license_scan import scan_licenses
    found = scan_licenses(read(spark, folder, "documents").select("doc_id", "text"))
    return found.drop("spans")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM bs),
ds AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
dw AS (SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS k FROM ds),
hits AS (SELECT r, s, m, item FROM dw JOIN bw USING (m, k)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r)
"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, nd),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * nd) // l AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY item_id, term),
f AS (SELECT item_id, r, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

OP12_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {AZ}) AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ws, count(*) AS a FROM g GROUP BY lang, k, ws),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
i AS (SELECT lang, a, k - 1 AS k, unnest([ws[1:k - 1], ws[2:k]]) AS ws FROM c WHERE k > 2 UNION ALL
      SELECT lang, a, 2, unnest([ws[1:2], ws[2:3], ws[3:4]]) FROM c WHERE k = 4),
o AS (SELECT lang, k, ws, max(a) AS over FROM i GROUP BY lang, k, ws),
s AS (SELECT c.* FROM c LEFT JOIN o USING (lang, k, ws) WHERE over IS NULL OR 100 * over < 80 * a),
x AS (SELECT lang, k, ws, a, unnest(range(1, k)) AS j FROM s),
y AS (SELECT x.lang, x.k, x.ws, x.a, j, fl.a AS l, fr.a AS r, CAST((CAST(2000000 AS HUGEINT) * x.a) // (fl.a + fr.a) AS BIGINT) AS score
      FROM x JOIN f AS fl ON fl.lang = x.lang AND fl.ws = x.ws[1:j] JOIN f AS fr ON fr.lang = x.lang AND fr.ws = x.ws[j + 1:x.k]),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) AS first FROM y),
e AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM z WHERE first = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Build] = {f.__name__: prepared(f) for f in (op1_jaccard, op2_language, op3_secrets, op4_pack, op5_toxicity, op6_resample, op7_token_counts, op8_neighbours, op9_decontaminate, op10_hidden_markov,
                                                                  op11_ranked_search, op12_collocations, op13_licenses)}
SQL: dict[str, str] = {"op9_decontaminate": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_collocations": OP12_SQL}
