"""Near dedup, substring dedup and line dedup against brute force, and their defined cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consonance.llm import line_dedup as L
from consonance.llm import near_dedup as N
from consonance.llm import substring_dedup as S
from consonance.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _corpus(seed, n_docs=120):
    """Texts with copies, near copies of one text, a shared passage, empties and odd separators."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def words(k):
        return [rng.choice(vocab) for _ in range(k)]

    passage, one, out = words(40), words(60), []
    for i in range(n_docs):
        kind = i % 8
        w = words(rng.randint(1, 80))
        if kind == 1 and out:
            out.append(rng.choice(out))
            continue
        if kind in (2, 3):
            w = list(one)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if kind in (4, 5):
            w[rng.randrange(len(w)):0] = passage
        if kind == 6 and rng.random() < 0.4:
            w = []
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "\t "]) for x in w)
        out.append(text.upper() if kind == 7 else text)
    return [None if not t and rng.random() < 0.5 else t for t in out]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((_find(parent, a), _find(parent, b)))
                parent[y] = x
    return {i: (len(sets[i]), _find(parent, i), _find(parent, i) == i) for i in ids}


def test_near_dedup_equals_brute_force_with_few_pairs_an_item(spark, monkeypatch):
    # all large buckets go through the prefix filter
    monkeypatch.setattr(N.banding, "PAIRS_AN_ITEM", 0)
    monkeypatch.setattr(N.banding, "STARS", 1)
    rows = [(3 * i + 1, t) for i, t in enumerate(_corpus(1))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect()}
    assert got == brute_near(rows)


def test_near_dedup_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "x " * 3000), (8, "x " * 9),
            (9, "q w e r t y"), (9, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect())
    assert got == [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                   (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 4, False), (9, 2, 4, False)]
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert N.near_dedup(empty).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        x, y = sorted((_find(parent, a), _find(parent, b)))
        parent[y] = x
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: _find(parent, i) for i in parent}
    assert got == {i: c for i, c in want.items() if i in got}
    assert {i for i in want if want[i] != i} <= set(got)
    assert components(spark.createDataFrame([], T.StructType.fromDDL("u long, v long"))).collect() == []


def brute_substring(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j:j + k])] < i:
                gone.update(range(j, j + k))
        spans = []
        for j in sorted(gone):
            if spans and spans[-1][1] == j - 1:
                spans[-1][1] = j
            else:
                spans.append([j, j])
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), tuple(map(tuple, spans))))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block", [(13, 4 << 20), (3, 300)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rows = [(3 * (i % 100), t) for i, t in enumerate(_corpus(k))] + [(None, "n o i d " * 9), (None, None), (5, "y " * 4000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text, tuple((x.first, x.last) for x in r.intervals))
           for r in S.substring_dedup(df, k).collect()]
    assert sorted(got, key=str) == brute_substring(rows, k)


def test_substring_dedup_empty_table(spark):
    assert S.substring_dedup(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))).collect() == []


def brute_lines(rows):
    first, sets, at = {}, [], []
    for i, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        for k, line in enumerate(t.split("\n")):
            if WORD.search(line):
                first.setdefault(line, len(first))
                at.append((i, k, line))
    for line in first:
        sets.append({line[m.start():m.start() + 8] for m in WORD.finditer(line)})
    parent = {x: x for x in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((_find(parent, a), _find(parent, b)))
                parent[y] = x
    seen, gone = set(), {}
    for i, k, line in at:
        c = _find(parent, first[line])
        if c in seen:
            gone.setdefault(i, set()).add(k)
        seen.add(c)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        mine = gone.get(i, set()) if i is not None else set()
        kept = t if t is None or not mine else "\n".join(x for k, x in enumerate(lines) if k not in mine)
        out.append((i, sum(bool(WORD.search(x)) for x in lines) if t is not None else 0, len(mine), kept))
    return sorted(out, key=str)


def _line_corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    lines = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 8, 12, 20, 30, 39, 41, 60, 90, 55) * 4]
    rows = []
    for i in range(60):
        mine = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split(" ") if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 70))]
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            mine.append(" ".join(w))
            if rng.random() < 0.2:
                mine.append(rng.choice(["", "  ", "\t"]))
        rows.append((2 * i, "\n".join(mine)))
    return rows


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    # many narrow bands: no pair is missed, so results are the same
    monkeypatch.setattr(L, "ROWS", 1)
    rows = _line_corpus(4) + [(500, None), (None, rows_text := _line_corpus(4)[3][1]), (501, ""), (502, "\n \n"), (503, "日本語の行です\n" * 2)]
    assert rows_text
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lines int").repartition(3)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in L.line_dedup(df).collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_dedup_bands_hold_similar_lines_together(spark):
    """Pairs at 0.8 and more share a band nearly always, with production bands, on both sides of the size limit."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    rows = []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.choice([20, 38, 45, 80]))]
        v = list(w)
        for _ in range(max(1, len(w) // 20)):
            v[rng.randrange(len(v))] = rng.choice(vocab)
        rows += [(i, " ".join(w)), (i, " ".join(v))]
    df = L.with_set(spark.createDataFrame(rows, "i long, line string")).withColumn("k", L.band_keys())
    pairs = df.groupBy("i").agg(F.collect_list("s").alias("s"), F.collect_list("k").alias("k")).collect()
    missed = sum(1 for r in pairs if len(set(r.s[0]) & set(r.s[1])) >= 0.8 * len(set(r.s[0]) | set(r.s[1]))
                 and not set(r.k[0]) & set(r.k[1]))
    assert missed <= 1


def _whole_word_sets(line):
    """Shingles from word starts, and from every position of a word longer than a shingle; cuts nothing off."""
    return {line[p:p + 8] for m in WORD.finditer(line) for p in range(m.start(), max(m.start() + 1, m.end() - 7))}


def test_line_dedup_reads_whole_words(spark, monkeypatch):
    """URLs, paths, ids, CSV and hash lines and unspaced scripts that differ behind the 8th character of a word."""
    monkeypatch.setattr(L, "ROWS", 1)
    rng = random.Random(12)
    khmer, lao = [chr(c) for c in range(0x1780, 0x17B3)], [chr(c) for c in range(0x0E81, 0x0E84)] + [chr(c) for c in range(0x1000, 0x1020)]

    def run(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))

    lines = ["/usr/local/a", "/usr/local/b", "2024-01-02,1,alpha", "2024-01-02,7,omega", "1234567890123", "1234567899999"]
    for _ in range(6):
        lines += [f"https://{run('abcdef', 12)}.org/{run('xyz', 9)}", "12345678" + run("0123456789", 14), "AAAABBBB" + run("ABCD+/09", 60),
                  "ខ្ញុំស្រឡាញ់" + run(khmer, 40), "abcdefgh" + run(lao, 30), f"see https://{run('abcdef', 30)} now"]
    # near copies: one character put in or changed in the middle of a long word
    near = [x[:len(x) // 2] + "q" + x[len(x) // 2 + i % 2:] for i, x in enumerate(lines[6:]) if len(x) > 50]
    rows = [(i, x) for i, x in enumerate(lines + near)]
    sets = [_whole_word_sets(x) for _, x in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((_find(parent, a), _find(parent, b)))
                parent[y] = x
    want = {i: int(_find(parent, i) != i) for i in range(len(rows))}
    got = {r.doc_id: r.n_removed for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and not any(want[i] for i in range(len(lines))) and any(want.values())
    df = L.with_set(spark.createDataFrame(rows, "i long, line string"))
    assert {r.i: r.n for r in df.collect()} == {i: len(s) for i, s in enumerate(sets)}


def test_line_dedup_empty_table_and_same_rows(spark):
    assert L.line_dedup(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))).collect() == []
    df = spark.createDataFrame([(1, "one line of text"), (1, "one line of text"), (2, "one line of text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in L.line_dedup(df).collect()) == [(1, 0), (1, 0), (2, 1)]


def test_substring_query_digest(spark):
    """The digest of the query is that of the kept words."""
    rows = S.query(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {i: hashlib.sha256(k.encode()).hexdigest() for i, _, _, k, _ in brute_substring(list(docs.items()), 13)}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want


@pytest.mark.parametrize("swap", [False, True])
def test_near_dedup_rows_with_equal_ids_keep_all_links(spark, swap):
    """Two texts under one id, each with a near copy: one component, whatever the order of the rows."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "alone in all this text here"), (3, ""), (None, a), (None, None)]
    rows = [rows[1], rows[0], *rows[2:]] if swap else rows
    df = spark.createDataFrame(rows + rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in N.near_dedup(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}
    assert N.near_dedup(df).count() == 2 * len(rows)


def test_cross_pairs_never_meet_inside_the_largest_component(spark):
    """One component of 2,000 items and three strays in one bucket: a few thousand pairs, all across."""
    from consonance.llm import banding

    rows = [(7, i, 10, 0 if i < 2000 else i) for i in range(2003)]
    df = spark.createDataFrame(rows, "key long, id long, n long, comp long")
    got = {(r.u, r.v) for r in banding.small_pairs(banding.mixed_buckets(df), 75).collect()}
    assert got == {(u, v) for u in range(2000, 2003) for v in range(u)}


def test_short_lines_at_the_limit_share_a_key(spark):
    """Pairs at or above 0.75 of sets up to 8 elements (a partner may hold 10): no pair without a common key."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        both = rng.randint(1, 8)
        u = rng.randint(both, both * 100 // 75)
        extra = u - both
        left = rng.randint(0, extra)
        x = [rng.randrange(-2 ** 62, 2 ** 62) for _ in range(u)]
        a, b = x[:both + left], x[:both] + x[both + left:]
        if min(len(a), len(b)) <= L.SHORT:
            rows.append((i, sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    for c in "ab":
        df = df.select("*", F.col(c).alias("s"), F.size(c).cast("long").alias("n")).withColumn(f"k{c}", L.band_keys()).drop("s", "n")
    assert df.where("100 * size(array_intersect(a, b)) < 75 * size(array_union(a, b))").count() == 0
    assert df.where("not arrays_overlap(ka, kb)").count() == 0


def test_line_dedup_of_short_lines_with_production_parameters(spark):
    """Lines of 3 to 8 words, each with a copy that differs in its last character: what brute force removes goes."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    lines = []
    for _ in range(400):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(3, 8)))
        lines += [line, line + rng.choice(["", "s", "!"])]
    rows = [(i, "\n".join(lines[i * 8:i * 8 + 8])) for i in range(100)]
    out = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in out), key=str) == brute_lines(rows)


def test_shingles_of_latin_words_take_the_short_way_and_stay_the_same(spark):
    """Words with accents went through the class of all word characters, several times a shingle."""
    rng = random.Random(5)
    chars = "abcé ñß  \t\x0b \u0085 日か😀.,-xyz"
    rows = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows += ["áb" * 30 + " " + "x" * 17 + "\t" + "cióncoesí las, esueíga", " " * 50, "a" * 8 + "日" + "b" * 9 + " ", "abc ", "ab\r"]
    word = f"[^{L._BLANKS}{L._DENSE}]"
    n = L.SHINGLE_CHARS
    plain = rf"(?=((?s:.{{1,{n}}})))(?:[!-~]{{1,{n}}}+(?!{word})|[{L._DENSE}]|{word}(?={word}{{{n}}})|{word}++)"
    df = spark.createDataFrame([(t,) for t in rows], "line string")
    both = df.select("line", F.regexp_extract_all("line", F.lit(L._SHINGLE), F.lit(1)).alias("a"),
                     F.regexp_extract_all("line", F.lit(plain), F.lit(1)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(len(r["a"]) for r in both) > 1000
    assert all(re.fullmatch(f"{L._LATIN}+", w) for w in ("cióncoesí", "reißt,", "plain", "łódź"))
    assert not any(re.search(L._LATIN, c) for c in " \t\x0b\r\n日かก")


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The shuffles behind a written table stayed on disk until the driver collected its garbage."""
    import time

    from consonance.llm.common import _CLEANUP, written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, set_before = shuffles(), spark.conf.get(_CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("c"))
    t = written(df, "test-shuffles")
    end = time.time() + 30
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sorted(map(tuple, t.collect())) == [(i, 143 if i < 6 else 142) for i in range(7)]
    assert spark.conf.get(_CLEANUP, None) == set_before
