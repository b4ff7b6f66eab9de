"""Queries over the driver's tables, one per operator, with the SQL they must match where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .forest_search import nearest
from .labels import FOLDS, HELD
from .language import LanguageModel, held_out
from .lexical_search import ranked_documents
from .mixing import SEED, mix_sources
from .neardup import near_duplicates
from .packing import pack
from .pii import personal_report
from .quality import score_quality
from .secret_scan import secret_report
from .topk_search import top_k
from .toxicity import ToxicityModel


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP1_SQL = """
WITH finite AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scaled AS (SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM finite GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""


def _scored(rows: DataFrame, threshold: float, *more) -> DataFrame:
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *more,
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = ToxicityModel.fit(docs, _table(spark, sf_dir, "labels"))
    return _scored(model.score(docs), 0.5, F.size("passages").cast("long").alias("n_passages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_report(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_report(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return pack(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return _scored(score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), 0.3)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, with square-root weights of the sources."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.col("__copy").cast("long").alias("copy"), F.col("__place").alias("place"))


OP8_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n, 9) AS rate FROM counts
),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), below + exp(log_p + ln(rate) - ln(k + 1)) FROM steps
  WHERE k < ceil(rate + 10 * sqrt(rate) + 30)
),
drawn AS (
  SELECT doc_id, source, text,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents
),
copies AS (SELECT d.doc_id, d.source, d.text, s.k + 1 AS copy FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.below <= d.u)
SELECT doc_id, source, text, CAST(copy AS BIGINT) AS copy,
       md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS place
FROM copies
"""


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = LanguageModel.fit(docs.where("NOT held_out"))
    return model.predict(docs.select("doc_id", "held_out", "text"), drop=("text",))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH folded AS (SELECT doc_id, {_FOLDED} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY text)
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language priced against each other, and the terms they have in excess."""
    return source_divergence(_table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, {_FOLDED} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occurring AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM occurring GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM occurring o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3),
totals AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total FROM groups g),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON k.lang = t.lang
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= 200
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH docs AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term
),
asked AS (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY item_id, term),
lengthy AS (SELECT doc_id, 100 - 75 + ((75 * n * (SELECT docs FROM total)) // (SELECT terms FROM total)) AS m FROM lengths),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengthy USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk, op2_toxicity, op3_ann, op4_pii, op5_secrets, op6_packing, op7_quality, op8_mixing, op9_minhash_dedup, op10_language,
        op11_exact_dedup, op12_source_divergence, op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {
    "op1_topk": OP1_SQL.strip(),
    "op8_mixing": OP8_SQL.strip(),
    "op11_exact_dedup": OP11_SQL.strip(),
    "op12_source_divergence": OP12_SQL.strip(),
    "op13_lexical_search": OP13_SQL.strip(),
}
