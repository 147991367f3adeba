"""Line dedup with fuzzy lines, in DataFrame functions only.

Lines are the ``\\n``-split parts of a text that hold a word. A line's set is
the hashes of its character shingles: the ``SHINGLE_CHARS`` characters from
each word start (in scripts written without spaces, from each character), so
shingles move with the words and an edit touches one or two of them. A word
longer than a shingle (a URL, an id, a path, a run of a script without spaces)
gives the shingles of all its positions, so every character of it counts. Lines
whose sets have a Jaccard similarity of ``percent`` / 100 or more are linked;
of each connected component only the line that comes first (smallest document
id, then line number) stays, all others go.

MinHash signatures by one hash per shingle, in ``BANDS`` bands of the
``ROWS`` smallest hashes: a line with ``LONG`` shingles or more deals its
shingles into ``BANDS`` bins by hash, a shorter one takes ``BANDS`` different hash functions; lines near
the limit do both, so no similar pair is separated by it. A band is equal with
probability about J^3, less for few shingles: a pair at 0.75 is missed with 0.4 %
(9 of 12 shingles: 0.8 %), at 0.8 with 0.08 %, at 0.9 with 0.0002 %. Lines of at
most ``SHORT`` shingles miss none: two such sets at 0.75 share three elements
among the first n - ceil(0.75 n) + 3 of both in any common order, so all
triples of these, in the order of their hashes, are their keys (again, lines near
the limit do both; sets of one or two elements are linked only when equal). Candidates are verified by exact Jaccard similarity of their
whole sets (``banding``), and grouped by distributed union-find.

Equal lines are one item from the start: items are keyed by a 64-bit hash of
the line. Texts are shuffled only where a line of theirs is a candidate or goes: the document ids
concerned are first reduced to a set of ``ID_BUCKETS`` hash buckets, at most
8 MB, which is broadcast and lets most other texts stay where they are.

Defined cases: blank lines stay; null and empty texts come back as they are,
with no lines; rows with a null id stay whole and are compared with nothing;
rows with equal id and equal text are one document; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import banding
from .common import table, written
from .components import components

NAME = "op8_line_dedup"
SHINGLE_CHARS = 8
PERCENT = 75
BANDS, ROWS = 10, 3
#: shingles up to which a line takes the triples of a prefix as keys: exact, instead of bands
SHORT = 8
#: elements of a key of such a line
SHARED = 3
#: shingles from which on a line deals them into bins
LONG = 40
ID_BUCKETS = 1 << 20

_BLANKS = r"\x20\x09-\x0D"
# scripts written without spaces: Thai, kana, ideographs
_DENSE = r"\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"
_WORD = rf"[^{_BLANKS}{_DENSE}]"
# most characters of words in Latin script: two ranges, tested in a fraction of the time that _WORD takes
_LATIN = r"[!-~\u00A1-\u024F]"
# what is consumed per shingle: a space before it, then a Latin word that fits one (the cheapest test, and the common
# case), one character of a word that goes on behind the shingle (Latin ones first), or the rest of a word
_SHINGLE = (rf"\x20?+(?=((?s:.{{1,{SHINGLE_CHARS}}})))(?:{_LATIN}{{1,{SHINGLE_CHARS}}}+(?=\x20|\z)"
            rf"|{_LATIN}(?={_LATIN}{{{SHINGLE_CHARS}}})|[{_DENSE}]|{_WORD}(?={_WORD}{{{SHINGLE_CHARS}}})|{_WORD}++)")


def with_set(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with ``s``, the sorted distinct shingle hashes of column ``line``, and ``n``, their number."""
    h = F.transform(F.regexp_extract_all(line, F.lit(_SHINGLE), F.lit(1)), lambda x: F.xxhash64(x))
    df = df.withColumn("s", F.sort_array(F.array_distinct(h)))
    return df.withColumn("n", F.size("s").cast("long"))


def band_keys():
    """Band keys (array of longs) from columns ``s`` and ``n``."""
    # s is sorted by hash, so its first elements are a prefix in an order that all lines share
    head = f"slice(s, 1, cast(least(n, n - ceil({PERCENT} * n / 100) + {SHARED}) as int))"
    triples = ("flatten(transform(sequence(0, size(p) - 3), i -> flatten(transform(sequence(i + 1, size(p) - 2), j -> "
               "transform(sequence(j + 1, size(p) - 1), k -> xxhash64(200, p[i], p[j], p[k]))))))")
    few = F.expr("array(xxhash64(200, s[0], if(n > 1, s[1], null)))")
    prefix = (F.when((F.col("n") > 0) & (F.col("n") < SHARED), few)
              .when((F.col("n") > 0) & (F.col("n") <= SHORT * 100 // PERCENT), F.expr(f"transform(array({head}), p -> {triples})[0]"))
              .otherwise(F.expr("cast(array() as array<bigint>)")))
    near_low, near_high = LONG * PERCENT // 100, LONG * 100 // PERCENT
    one = [F.expr(f"xxhash64({b}, slice(sort_array(transform(s, x -> xxhash64(x, {b}))), 1, {ROWS}))") for b in range(BANDS)]
    short = F.when((F.col("n") > SHORT) & (F.col("n") <= near_high), F.array(*one)).otherwise(F.expr("cast(array() as array<bigint>)"))
    # s is sorted, so a bin (a tenth of the range of the first byte) is a run; its first element starts the band
    def bin_of(x: str) -> str:
        return f"shiftright(shiftrightunsigned({x}, 56) * {BANDS}, 8)"

    same = [f"IF(i + {k} < n AND {bin_of(f's[least(i + {k}, n - 1)]')} = {bin_of('x')}, s[least(i + {k}, n - 1)], null)"
            for k in range(1, ROWS)]
    first = f"i = 0 OR {bin_of('s[greatest(i - 1, 0)]')} <> {bin_of('x')}"
    runs = (f"filter(transform(s, (x, i) -> IF({first}, xxhash64({', '.join(['100 + ' + bin_of('x'), 'x', *same])}), null)), "
            "k -> k IS NOT NULL)")
    long = F.when(F.col("n") >= near_low, F.expr(runs)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.array_distinct(F.concat(prefix, short, long))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line of every line with a word."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"),
                                                   F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(rf"[^{_BLANKS}]"))


def _bucket(col: str):
    return F.pmod(F.xxhash64(col), F.lit(ID_BUCKETS)).cast("int")


def _concerned(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id falls (left_semi) or does not fall (left_anti) into the hash buckets of ``ids``.

    The broadcast side has at most ``ID_BUCKETS`` rows of one int, whatever the size of the input.
    """
    hit = ids.select(_bucket("doc_id").alias("_bucket")).distinct()
    return docs.join(F.broadcast(hit), _bucket("doc_id") == F.col("_bucket"), how)


def _verifier(sets: DataFrame, percent: int):
    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("u"), F.col("s").alias("a"))
        b = sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
        j = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
        return j.where(f"100 * both >= {percent} * (size(a) + size(b) - both)").select("u", "v")
    return verify


def line_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry`` columns, n_lines (with a word), n_removed, kept_text of every row of ``docs``."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      *[F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)])
    slim = src.select("doc_id", "text")
    lines = _lines(slim).withColumn("id", F.xxhash64("line"))
    # one row per occurrence; equal lines have equal ids
    seen = written(lines.select("doc_id", "text_hash", "line_no", "id"), "line-occurrences")
    first = F.min(F.struct("doc_id", "line_no", "text_hash")).alias("first")
    # one item per line; its band rows are shuffled once, the ends of a bucket and their sizes come from a window over it
    signed = with_set(lines.select("id", "line")).select("id", "n", band_keys().alias("bands"))
    items = signed.groupBy("id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    bucket = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = items.select("id", "n", F.explode("bands").alias("key")).select(
        "key", "id", "n", F.first("id").over(bucket).alias("low"), F.first("n").over(bucket).alias("low_n"),
        F.last("id").over(bucket).alias("high"), F.last("n").over(bucket).alias("high_n"))
    # only rows of shared buckets are left
    busy = written(rows.where("low <> high"), "line-buckets")

    # the sets of candidates, from the first occurrence of each
    wanted = busy.select("id").distinct()
    where = written(seen.join(wanted, "id", "left_semi").groupBy("id").agg(first), "line-items")
    at = where.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"),
                      F.col("first.line_no").alias("line_no"), "id")
    per_doc = at.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "id")).alias("asked"))
    texts = _concerned(slim, at, "left_semi").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
    asked = texts.join(per_doc, ["doc_id", "text_hash"]).withColumn("lines", F.split("text", "\n"))
    asked = asked.select("lines", F.explode("asked").alias("q")).select(
        F.col("q.id").alias("id"), F.expr("lines[q.line_no]").alias("line"))
    sets = written(with_set(asked).select("id", "s"), "line-sets")

    links = banding.links(busy, _verifier(sets, percent),
                          lambda ids: sets.join(ids, "id", "left_semi").select("id", F.explode("s").alias("e")), percent)
    labels = components(links)

    # the first occurrence of each component stays; a line that is no member of one is its own component
    comp = seen.select("doc_id", "text_hash", "line_no", "id").join(labels, F.col("id") == F.col("vertex"), "left")
    comp = comp.select("doc_id", "text_hash", "line_no", F.coalesce("component", "id").alias("comp"))
    kept = comp.groupBy("comp").agg(first, F.count(F.lit(1)).alias("members")).where("members > 1")
    gone = comp.join(kept, "comp").where("doc_id <> first.doc_id or line_no <> first.line_no or text_hash <> first.text_hash")
    gone = written(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "line-gone")

    cols = [F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]
    n_lines = F.expr(rf"cast(size(filter(lines, x -> x rlike '[^{_BLANKS}]')) as bigint)".replace("\\", "\\\\"))
    whole = _concerned(src, gone, "left_anti").withColumn("gone", F.expr("cast(null as array<int>)"))
    hit = _concerned(src, gone, "left_semi").withColumn("text_hash", F.xxhash64("text"))
    cut = hit.join(gone, ["doc_id", "text_hash"], "left").drop("text_hash")
    both = whole.unionByName(cut).withColumn("lines", F.split("text", "\n"))
    both = both.withColumn("stay", F.expr("CASE WHEN gone IS NOT NULL THEN "
                                          "array_except(sequence(0, size(lines) - 1), gone) END"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.expr("transform(stay, i -> lines[i])"), "\n"))
    return both.select("doc_id", *cols, F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup of every whole document."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = None
