import hashlib
import os
import random
import re

import duckdb
import pytest

from rimefield.llm import decontaminate as dc


def by_hand(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
    ws, hit, found = norm(text), set(), set()
    for i, t in items:
        item = norm(t)
        n = min(window, len(item))
        wins = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1):
            if n and tuple(ws[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(ws), len(hit), sorted(found)


def cases(seed, n_items=40, n_docs=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["é", "Ü", "x-y", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 25, 40]) if rng.random() < 0.9 else 0))) for i in range(n_items)]
    items = [(i, t) for i, t in items if len(t.split()) != 1 or rng.random() < 0.2] + [(900, None), (901, items[5][1])]
    docs = []
    for d in range(n_docs):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += [rng.choice(vocab + ["zz", "qq"]) for _ in range(rng.randrange(0, 15))]
            t = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(t)))
            parts += t[a : a + rng.randrange(0, 30)]
        docs.append((d, " ".join(parts)))
    return items, [*docs, (-1, None), (-2, ""), docs[3]]


def test_hits_equal_brute_force(spark):
    for seed in (1, 2):
        items, docs = cases(seed)
        b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
        for most in (10**6, 200):  # one automaton, and several in turn
            rows = dc.mark(d, b, ["doc_id"], max_words=most).select("row.doc_id", "n", "spans", "items").collect()
            assert len(rows) == len(docs)
            for r in rows:
                hits = sum(r.spans[1::2]) - sum(r.spans[0::2])
                assert (r.n, hits, r[3]) == by_hand(dict(docs)[r.doc_id], items), r


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"item{i}" for i in range(15))
    rest = "A Clean I/O word, as THEY are. " * 10
    docs = spark.createDataFrame([(1, rest + item + "! " + rest, 7), (2, item, 7), (3, rest, 7), (4, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == rest + "! " + rest and out[1].n_chars == len(out[1].text)
    assert out[3].text == rest and out[3].n_chars == 7 and out[4].text is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, none).count() == 4
    assert dc.mark(docs.where("false"), none, ["doc_id"]).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    items, docs = cases(3)
    spark.createDataFrame(items + [(None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    named = items
    rows = dc.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hits, found = by_hand(dict(docs)[r.doc_id], named)
        assert (r.n_words, r.n_items, r.items_sha256) == (n, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
        assert r.n_hit >= hits and r.contaminated == (r.n_hit > 0)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(dc.SQL).df()
    assert sorted(map(tuple, want.to_numpy())) == sorted(map(tuple, dc.query(spark, str(tmp_path)).select(*want.columns).toPandas().to_numpy()))


def test_clashing_names_stay(spark):
    names = ["row", "cut", "n", "spans", "items", "_text", "_n", "_spans", "_items"]
    item = " ".join(f"item{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "before " * 20 + item, *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in out] == [(1, "before " * 20, *names), (None, None, *names)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_query_equals_sql(spark):
    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(dc.SQL).df()
    assert want.contaminated.any()
    assert sorted(map(tuple, want.to_numpy())) == sorted(map(tuple, dc.query(spark, data).select(*want.columns).toPandas().to_numpy()))
