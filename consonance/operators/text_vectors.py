"""Answers to vectors: per-group TF-IDF and a pluggable sentence encoder.

TF-IDF is fitted separately for every (model, topic) group, as a per-group
vectorizer would be:

* tokens: the lowercased text split into maximal runs of letters, digits and
  '_' of length >= 2 (``[\\p{L}\\p{N}_]{2,}``), whole texts;
* English stop words removed (Spark's own list, read from the Spark ML jar);
* vocabulary: the ``max_features`` terms with the highest count in the group,
  ties by term; chosen in two salted top-k steps so a group with a huge
  vocabulary is never sorted in one task;
* weight = count * (ln((1 + n) / (1 + df)) + 1), rows L2-normalised.

Every step is a DataFrame expression or grouped aggregate; Spark ML's IDF is
not used because it fits one global model (and has no +1 smoothing).
"""

from __future__ import annotations

import functools
import glob
import os
import pathlib
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: vocabulary rows of all groups that are sent to every executor, at most
SENT_TERMS = 100_000


@functools.lru_cache(maxsize=4)
def spark_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark ML's default stop words for ``language``.

    A running session is asked directly; without one the list is read from the
    Spark ML jar below ``SPARK_HOME`` or around the imported package.
    """
    from pyspark.sql import SparkSession

    if SparkSession.getActiveSession() is not None:
        from pyspark.ml.feature import StopWordsRemover
        return tuple(w.strip() for w in StopWordsRemover.loadDefaultStopWords(language) if w.strip())
    import pyspark

    # beside the package, or above pyspark.zip when PySpark is loaded from it
    above = pathlib.Path(pyspark.__file__).parents
    for home in (os.environ.get("SPARK_HOME"), *above):
        for jar in glob.glob(os.path.join(home or ".", "jars", "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                name = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
                if name in z.namelist():
                    words = z.read(name).decode("utf-8").split("\n")
                    return tuple(w.strip() for w in words if w.strip())
    raise RuntimeError("no Spark session and no Spark ML jar: set SPARK_HOME")


def tokens(docs: DataFrame, keys: Sequence[str], id_col: str, text_col: str,
           stop_words: Sequence[str] | None = None) -> DataFrame:
    """(keys, id, term) for every token occurrence, stop words removed."""
    sw = list(spark_stop_words() if stop_words is None else stop_words)
    toks = docs.select(*keys, id_col, F.explode(
        F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    if sw:
        toks = toks.where(~F.col("term").isin(sw))
    return toks


def top_k_terms(stats: DataFrame, keys: Sequence[str], k: int, salt_buckets: int = 64) -> DataFrame:
    """The k terms with the largest ``cnt`` per group (ties by term), with ``term_idx``.

    Step 1 keeps the top k inside (group, hash bucket of term); step 2 ranks at
    most k * salt_buckets candidates per group.
    """
    keys = list(keys)
    order = [F.desc("cnt"), F.asc("term")]
    s = stats.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_b").orderBy(*order)
    cand = s.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_b")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (cand.withColumn("term_idx", (F.row_number().over(w2) - 1).cast("int"))
                .where(F.col("term_idx") < k))


def tfidf_weights(docs: DataFrame, keys: Sequence[str] = ("model", "topic"),
                  id_col: str = "persona_id", text_col: str = "response",
                  max_features: int = 1000, stop_words: Sequence[str] | None = None,
                  salt_buckets: int = 64, partitions: int | None = None) -> DataFrame:
    """Sparse L2-normalised TF-IDF rows: (keys, id, term, term_idx, weight)."""
    keys = list(keys)
    d = docs.select(*keys, id_col, text_col)
    n_docs = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
    # explicit null filters make both consumers of ``tf`` the same plan, so the shuffle is computed once and reused
    not_null = F.col("term").isNotNull() & F.col(id_col).isNotNull()
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    # texts are dealt out by document once: what is counted per document, its terms and its norm, needs no other shuffle
    # (in a number of parts that is not lowered by the size of the texts: their terms take many times the room)
    parts = partitions or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    toks = tokens(d.repartition(parts, *keys, id_col), keys, id_col, text_col, stop_words).where(not_null)
    tf = toks.groupBy(*keys, id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy(*keys, "term").agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))
    vocab = top_k_terms(stats, keys, max_features, salt_buckets).join(n_docs, keys)
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    vocab = vocab.select(*keys, "term", "term_idx", idf.alias("idf"))
    # at most max_features rows per group: sent to the term counts while the groups are few, else the two are shuffled
    if n_docs.limit(SENT_TERMS // max_features + 1).count() <= SENT_TERMS // max_features:
        vocab = F.broadcast(vocab)
    w = tf.join(vocab, keys + ["term"]).select(*keys, id_col, "term", "term_idx",
                                                (F.col("tf") * F.col("idf")).alias("w"))
    # row norm over one document's terms (at most max_features rows per window)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, id_col)))
    return w.select(*keys, id_col, "term", "term_idx", (F.col("w") / norm).alias("weight"))


def sparse_vectors(weights: DataFrame, docs: DataFrame | None, keys: Sequence[str] = ("model", "topic"),
                   id_col: str = "persona_id", max_features: int = 1000) -> DataFrame:
    """One row per document: (keys, id, vec STRUCT<idx ARRAY<INT>, val ARRAY<DOUBLE>>, dim).

    With ``docs``, documents with no vocabulary term get an empty (zero)
    vector; with ``docs=None`` only documents with terms are listed (enough
    for pair sums when group sizes are known, since a zero vector adds 0).
    A row holds at most ``max_features`` entries (in no particular order).
    """
    keys = list(keys)
    v = weights.groupBy(*keys, id_col).agg(F.collect_list(F.struct("term_idx", "weight")).alias("_e"))
    v = v.select(*keys, id_col, F.struct(F.col("_e.term_idx").alias("idx"),
                                         F.col("_e.weight").alias("val")).alias("vec"))
    if docs is None:
        return v.withColumn("dim", F.lit(max_features))
    all_docs = docs.select(*keys, F.col(id_col)).distinct()
    empty = F.struct(F.array().cast("array<int>").alias("idx"), F.array().cast("array<double>").alias("val"))
    return all_docs.join(v, keys + [id_col], "left").select(
        *keys, id_col, F.coalesce(F.col("vec"), empty).alias("vec"),
        F.lit(max_features).alias("dim"))


def sparse_mean_similarity(weights: DataFrame, docs: DataFrame,
                           keys: Sequence[str] = ("model", "topic"),
                           id_col: str = "persona_id") -> DataFrame:
    """Closed-form mean pair similarity of sparse unit rows: (|S|^2 - nz) / (n(n-1))."""
    keys = list(keys)
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    nz = weights.select(*keys, id_col).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("nz"))
    s = weights.groupBy(*keys, "term").agg(F.sum("weight").alias("s")).groupBy(*keys).agg(
        F.sum(F.col("s") * F.col("s")).alias("s_sq"))
    j = n.join(nz, keys, "left").join(s, keys, "left").fillna(0, ["nz"]).fillna(0.0, ["s_sq"])
    pairs = F.expr("n * (n - 1) div 2")
    return j.select(*keys, "n", pairs.alias("pairs"),
                    F.when(pairs > 0, (F.col("s_sq") - F.col("nz")) / 2 / pairs).alias("mean_similarity"))


def encode(docs: DataFrame, encoder_factory: Callable, text_col: str = "response",
           out_col: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Add an embedding column computed by a caller-supplied sentence encoder.

    ``encoder_factory()`` is called once per Python worker task and must
    return a callable mapping a list of texts to a 2-D float array. Texts are
    passed whole. Runs as ``mapInPandas`` (Arrow batches), so the encoder
    sees ``batch_size`` texts at a time.
    """
    import numpy as np
    import pandas as pd

    schema = T.StructType(docs.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def fn(batches):
        enc = encoder_factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                texts = part[text_col].fillna("").astype(str).tolist()
                vecs = np.asarray(enc(texts), dtype=np.float32)
                part[out_col] = list(vecs)
                yield part

    return docs.mapInPandas(fn, schema)


def hashing_encoder(dim: int = 64) -> Callable:
    """A small deterministic encoder: token counts hashed into ``dim`` signed buckets.

    Stands in for a sentence encoder where none is installed; any callable
    mapping a list of texts to a 2-D array can be passed to ``encode``.
    """
    import re
    import zlib

    import numpy as np

    tok = re.compile(r"[^\W]{2,}")

    def enc(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in tok.findall(t.lower()):
                h = zlib.crc32(w.encode("utf-8"))
                out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        return out

    return enc


def tfidf_similarity_moments(weights: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("model", "topic"),
                             id_col: str = "persona_id", max_features: int = 1000,
                             pair_max: int = 2000) -> DataFrame:
    """Mean and population std of TF-IDF cosine similarity per group, adaptively.

    Groups of at most ``pair_max`` documents sum their pairs in blocks
    (O(n^2 nnz), cheapest for small groups); larger groups use the Gram
    closed form over the group's vocabulary (O(n d^2) with d <= max_features),
    so a hot group never costs quadratic work. ``sizes`` is (keys, n).
    """
    from .moments import group_moments
    from .pairs import pair_moments

    keys = list(keys)
    vec = sparse_vectors(weights, None, keys, id_col, max_features)
    cols = [*keys, "n", "pairs", "sum_s", "sum_s2", "mean_similarity", "std_similarity"]
    # the path is chosen from the measured group sizes (a one-row check)
    has_small = sizes.where(F.col("n") <= pair_max).limit(1).count() > 0
    has_big = sizes.where(F.col("n") > pair_max).limit(1).count() > 0
    if has_small and has_big:
        from ..session import checkpoint_dir

        checkpoint_dir(vec.sparkSession)
        vec = vec.checkpoint(eager=True)  # both paths read the vectors: fit TF-IDF once
    parts = []
    if has_small:
        small_keys = sizes.where(F.col("n") <= pair_max).select(*keys)
        parts.append(pair_moments(vec.join(small_keys, keys, "left_semi") if has_big else vec, keys, id_col,
                                  "vec", sparse_dim=max_features,
                                  sizes=sizes.join(small_keys, keys, "left_semi") if has_big else sizes))
    if has_big:
        big_keys = sizes.where(F.col("n") > pair_max).select(*keys)
        parts.append(group_moments(vec.join(big_keys, keys, "left_semi") if has_small else vec, keys, "vec",
                                   sparse_dim=max_features,
                                   sizes=sizes.join(big_keys, keys, "left_semi") if has_small else sizes))
    if not parts:
        return pair_moments(vec, keys, id_col, "vec", sparse_dim=max_features, sizes=sizes).select(*cols)
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def answer_moments(docs: DataFrame, encoder_factory: Callable | None = None, force_tfidf: bool = False,
                   keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
                   text_col: str = "response") -> DataFrame:
    """Similarity moments of text answers: by the sentence encoder, or by TF-IDF.

    TF-IDF is used when it is asked for, when no encoder is given, and when the
    encoder cannot be made (``encoder_factory`` raises ImportError or OSError
    on the driver: library or model files absent).
    """
    from .moments import group_moments

    keys = list(keys)
    usable = encoder_factory is not None and not force_tfidf
    if usable:
        try:
            encoder_factory()
        except (ImportError, OSError):
            usable = False
    if usable:
        enc = encode(docs.select(*keys, id_col, text_col), encoder_factory, text_col)
        return group_moments(enc.select(*keys, id_col, "embedding"), keys)
    sizes = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return tfidf_similarity_moments(tfidf_weights(docs, keys, id_col, text_col), sizes, keys, id_col)
