"""The Merkle manifest against a tree built in one process, and proofs that hold or break."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consonance.llm import merkle_manifest as M

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, tree string, path int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in M.FIELDS])


def _tree(digests):
    """Root, and for each leaf the siblings from its run up to the root."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for p, i in zip(paths, at):
            a = i // 16 * 16
            p += digests[a:i] + digests[i + 1:a + 16]
        digests = [_h(*digests[a:a + 16]) for a in range(0, len(digests), 16)]
        at = [i // 16 for i in at]
    return digests[0], paths


def _brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        g = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees.append((g, *_tree([_leaf(r) for r in g])))
    root, tops = _tree([t[1] for t in trees])
    return sorted(((r["doc_id"] is not None, r["doc_id"]), s, _leaf(r), sub, root, _h(*p, *top))
                  for s, (g, sub, paths), top in zip([x or "" for x in order], trees, tops) for r, p in zip(g, paths))


def _got(spark, rows, step=M.STEP):
    df = spark.createDataFrame([tuple(r[f] for f in ("doc_id", "text", "lang", "source", "n_chars")) + ("x", 1) for r in rows], DDL)
    m = M.manifest(df, step=step)
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = m.withColumn("proof", F.sha2(joined, 256)).withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root for r in out)
    return sorted(((r.doc_id is not None, r.doc_id), r.source or "", r.leaf, r.subroot, r.root, r.proof) for r in out)


def _row(i, source="web", text="Some Text", lang="en", n=3):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


@pytest.mark.parametrize("step", [1, 2, 3])
def test_trees_of_all_heights(spark, step):
    """Sources of 1, 16, 17, 256, 257 and 4,100 rows; the largest holds most of them."""
    sizes = {"one": 1, "a": 16, "b": 17, "c": 256, "ü": 257, "hot": 4100}
    rows = [_row(1000 * k + i, s, text=f"t{i}") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    assert _got(spark, rows, step) == _brute(rows)


def test_many_sources(spark):
    rows = [_row(i, f"s{i % 300}") for i in range(700)]
    assert _got(spark, rows) == _brute(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [_row(None, None, None, None, None), _row(None, "", "", "", 0), _row(5), _row(5), _row(5, text="other"), _row(-3, "z"),
            _row(9, None, "é" * 500_000), _row(10, "z", "-"), _row(11, "z", None)] + [_row(7, "same") for _ in range(40)]
    assert _got(spark, rows) == _brute(rows)


def test_single_row_and_empty_table(spark):
    (got,) = _got(spark, [_row(1)])
    assert got[2] == got[3] == got[4] == _leaf(_row(1)) and got[5] == _h()
    empty = spark.createDataFrame([], T.StructType.fromDDL(DDL))
    assert M.manifest(empty).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = M.query(spark, SF)
    want = con.execute(M.SQL).df()
    assert list(got.columns) == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


def test_tampered_leaves_are_found(spark):
    got = M.query(spark, SF).collect()
    assert 0 < sum(not r.verified for r in got) < len(got)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib
    for r in got:
        text = docs[r.doc_id].text
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None and text != "".join(
            c.lower() if "A" <= c <= "Z" else c for c in text)
        assert r.verified == (not changed)
