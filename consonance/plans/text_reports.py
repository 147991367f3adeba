"""Text answers to TF-IDF vectors and their within-group similarity.

Input: the ``answers`` view (whole texts). Oracle: DuckDB with the same token
pattern and the same stop-word list inlined; TF-IDF pair similarity by a
join on shared terms.
"""

from __future__ import annotations

from ..operators import pairs, text_vectors
from . import views
from .registry import oracle, register, sql_text
from .views import with_views


def _stop_list_sql() -> str:
    return ", ".join(sql_text(w) for w in text_vectors.spark_stop_words())


def _tfidf_sql(body: str) -> str:
    return with_views(f"""
, tok AS (SELECT model, topic, persona_id,
            unnest(regexp_extract_all(lower(response), '{text_vectors.TOKEN_PATTERN}')) AS term FROM answers),
tf AS (SELECT model, topic, persona_id, term, count(*) AS tf FROM tok
       WHERE term NOT IN ({_stop_list_sql()}) GROUP BY model, topic, persona_id, term),
ng AS (SELECT model, topic, count(*) AS n FROM answers GROUP BY model, topic),
cs AS (SELECT model, topic, term, sum(tf) AS cnt, count(*) AS df FROM tf GROUP BY model, topic, term),
voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, topic ORDER BY cnt DESC, term) - 1
                       AS term_idx FROM cs) WHERE term_idx < 1000),
w AS (SELECT tf.model, tf.topic, tf.persona_id, tf.term, voc.term_idx,
        tf.tf * (ln((1 + ng.n) / (1 + voc.df)) + 1) AS w
      FROM tf JOIN voc ON tf.model = voc.model AND tf.topic = voc.topic AND tf.term = voc.term
      JOIN ng ON tf.model = ng.model AND tf.topic = ng.topic),
nrm AS (SELECT model, topic, persona_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY model, topic, persona_id),
wn AS (SELECT w.model, w.topic, w.persona_id, w.term, CAST(w.term_idx AS INTEGER) AS term_idx, w.w / nrm.nr AS weight
       FROM w JOIN nrm ON w.model = nrm.model AND w.topic = nrm.topic AND w.persona_id = nrm.persona_id)
{body}""", "answers").replace("\n, tok AS", ",\ntok AS", 1)


def _weights(spark, sf_dir):
    return text_vectors.tfidf_weights(views.answers(spark, sf_dir))


@register("tfidf_weights", lambda: oracle(_tfidf_sql("SELECT * FROM wn"),
    ["model", "topic", "persona_id", "term", "term_idx", "weight"], ["weight"]), ["V2"])
def q_tfidf_weights(spark, sf_dir):
    """Per-group TF-IDF weights of every answer (top 1000 terms, smoothed idf, L2 rows)."""
    return _weights(spark, sf_dir)


_PAIR_SQL = """, pj AS (SELECT a.model, a.topic, a.persona_id AS ida, b.persona_id AS idb, sum(a.weight * b.weight) AS s
  FROM wn a JOIN wn b ON a.model = b.model AND a.topic = b.topic AND a.term = b.term AND a.persona_id < b.persona_id
  GROUP BY a.model, a.topic, a.persona_id, b.persona_id),
agg AS (SELECT model, topic, sum(s) AS s1, sum(s * s) AS s2 FROM pj GROUP BY model, topic)
SELECT ng.model, ng.topic, CAST(ng.n AS BIGINT) AS n, CAST(ng.n * (ng.n - 1) / 2 AS BIGINT) AS pairs,
  CASE WHEN ng.n > 1 THEN coalesce(agg.s1, 0) / (ng.n * (ng.n - 1) / 2) END AS mean_similarity,
  CASE WHEN ng.n > 1 THEN sqrt(greatest(coalesce(agg.s2, 0) / (ng.n * (ng.n - 1) / 2)
    - (coalesce(agg.s1, 0) / (ng.n * (ng.n - 1) / 2)) ^ 2, 0)) END AS std_similarity
FROM ng LEFT JOIN agg ON ng.model = agg.model AND ng.topic = agg.topic"""


@register("tfidf_moments", lambda: oracle(_tfidf_sql(_PAIR_SQL),
    ["model", "topic", "n", "pairs", "mean_similarity", "std_similarity"],
    ["mean_similarity", "std_similarity"]), ["V2", "V3", "V4", "J11"])
def q_tfidf_moments(spark, sf_dir):
    """Mean and population std of TF-IDF cosine similarity per (model, topic).

    Small groups sum their pairs in blocks (sparse rows densified per block);
    groups above 2,000 answers use the linear Gram closed form.
    """
    a = views.answers(spark, sf_dir)
    sizes = a.groupBy("model", "topic").count().withColumnRenamed("count", "n")
    m = text_vectors.tfidf_similarity_moments(_weights(spark, sf_dir), sizes)
    return m.select("model", "topic", "n", "pairs", "mean_similarity", "std_similarity")


@register("tfidf_mean_closed_form", lambda: oracle(_tfidf_sql(_PAIR_SQL.replace(
    "CASE WHEN ng.n > 1 THEN sqrt(greatest(coalesce(agg.s2, 0) / (ng.n * (ng.n - 1) / 2)\n"
    "    - (coalesce(agg.s1, 0) / (ng.n * (ng.n - 1) / 2)) ^ 2, 0)) END AS std_similarity", "NULL AS _drop")
    .replace(", NULL AS _drop", "")),
    ["model", "topic", "n", "pairs", "mean_similarity"], ["mean_similarity"]), ["A1", "V2"])
def q_tfidf_mean_closed_form(spark, sf_dir):
    """Mean TF-IDF similarity per group from term sums alone (no pairs)."""
    a = views.answers(spark, sf_dir)
    return text_vectors.sparse_mean_similarity(_weights(spark, sf_dir), a)


def _absent_encoder():
    raise ImportError("no sentence encoder is installed")


@register("fallback_moments", lambda: oracle(_tfidf_sql(_PAIR_SQL),
    ["model", "topic", "n", "pairs", "mean_similarity", "std_similarity"],
    ["mean_similarity", "std_similarity"]), ["V1", "V2"])
def q_fallback_moments(spark, sf_dir):
    """Similarity moments asked of an encoder that is not there: the TF-IDF fallback."""
    m = text_vectors.answer_moments(views.answers(spark, sf_dir), _absent_encoder)
    return m.select("model", "topic", "n", "pairs", "mean_similarity", "std_similarity")
