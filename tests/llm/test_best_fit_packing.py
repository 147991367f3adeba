"""Packing against a brute-force best fit, and the defined cases."""

import random
import re

import pytest
from pyspark.sql import types as T

from consonance.llm import best_fit_packing as P

SF = "/root/testdata/sf0.001"


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (s is None or s not in b["s"])
               and (c is None or c not in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= size
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    n = 600
    sizes = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
    hot = rng.random() < 0.5
    sources = [rng.choice([None, "hot", "hot", *map(str, range(8))]) for _ in range(n)]
    clusters = [("copy" if hot and rng.random() < 0.33 else rng.choice([None, *map(str, range(150))])) for _ in range(n)]
    got = list(zip(*P.pack(sizes, sources, clusters, 64)))
    assert got == brute(sizes, sources, clusters, 64)


def check(rows, docs, capacity):
    """Every word of every document lies in exactly one piece; bins hold no conflict and no overlap."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.first_word, r.n_words))
        if r.bin_id is not None:
            by_bin.setdefault(r.bin_id, []).append(r)
    for i, (text, _) in docs.items():
        n, at = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), 0
        for first, k in sorted(by_doc[i]):
            assert first == at
            at += k
        assert at == n
    for mine in by_bin.values():
        end = 0
        for r in sorted(mine, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.n_words
        assert end <= capacity
        s = [docs[r.doc_id][1] for r in mine if docs[r.doc_id][1] is not None]
        assert len(s) == len(set(s)) or mine[0].bin_id.startswith("full-")


def test_query_is_a_valid_packing(spark):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(P.query(spark, SF).collect(), docs, P.CAPACITY)


def test_edge_rows(spark):
    rows = [(1, None, "a", 5), (2, "", "a", 5), (3, "x " * 25, "a", 5), (4, "y z", None, 5), (5, "y z", None, 5),
            (6, " \n", "b", 5), (7, "w " * 10, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    out = P.best_fit(df, capacity=10).collect()
    check(out, {r[0]: (r[1], r[2]) for r in rows}, 10)
    where = {}
    for r in out:
        where.setdefault(r.doc_id, []).append(r.bin_id)
    assert where[1] == where[2] == where[6] == [None] and len(where[3]) == 3
    assert where[4] != where[5]     # copies of one text do not share a bin
    again = spark.createDataFrame([(None, "a b", None), (1, "c", "s"), (1, "c", "s")], "doc_id long, text string, source string")
    assert len(P.best_fit(again, capacity=10).collect()) == 3


def test_shards_follow_the_rows_alone(spark, monkeypatch):
    """Both sides of the bound: as many shards as the rows ask for, near one global packing, whatever the session's setting."""
    monkeypatch.setattr(P, "SHARD_ROWS", 400)
    rng = random.Random(3)
    rows = [(i, f"w{i} " * rng.randint(1, 60), rng.choice(["hot", *map(str, range(200))])) for i in range(401)]
    old = spark.conf.get("spark.sql.shuffle.partitions")

    def packed(n, setting):
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        out = P.best_fit(spark.createDataFrame(rows[:n], "doc_id long, text string, source string"), capacity=64).collect()
        check(out, {r[0]: (r[1], r[2]) for r in rows[:n]}, 64)
        return sorted(map(tuple, out))

    try:
        for n, shards in ((400, 1), (401, 2)):
            few, many = packed(n, "3"), packed(n, "50")
            assert few == many and len({r[4].split("-")[0] for r in few}) == shards
            monkeypatch.setattr(P, "SHARD_ROWS", 10 ** 6)
            whole = packed(n, "3")
            monkeypatch.setattr(P, "SHARD_ROWS", 400)
            assert len({r[4] for r in few}) <= 1.05 * len({r[4] for r in whole})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, source string"))
    assert P.best_fit(df).collect() == []
