import random

import xxhash
from pyspark.sql import functions as F

from rimefield.llm import simhash


def by_hand(text):
    ws = "".join(c.lower() if c.isascii() else c for c in (text or ""))
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", ws) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(points):
    up = {p: p for p in points}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for a in points:
        for b in points:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                up[find(b)] = find(a)
    return {p: find(p) for p in points}


def test_fingerprint():
    for t in ["", None, "one", "Two Words", "Éa B c d e f É\x0bz \x85 q", "a a a a a a", "x " * 500]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == by_hand(t), t


def test_links_connect_as_brute_force(spark):
    rng = random.Random(1)
    points = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            points.add(p - (1 << 64) if p >> 63 else p)
            q = p
            for _ in range(rng.randrange(0, 6)):
                q ^= 1 << rng.randrange(64)
            p = q if rng.random() < 0.7 else p
            points.add(q - (1 << 64) if q >> 63 else q)
    want = roots(sorted(points))
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    for bucket in (400, 2):  # 2: nearly all goes by hubs
        found = simhash.links(df, bucket).collect()
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in found)
        got = dict.fromkeys(points)
        got.update({r.node: r.root for r in simhash.components(spark.createDataFrame(found, "a long, b long")).collect()})
        mine, theirs = {}, {}
        for p in points:
            mine.setdefault(p if got[p] is None else got[p], set()).add(p)
            theirs.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_groups_nulls_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(300))
    data = [(5, base), (3, base + " extra"), (9, "other text here now"), (1, None), (2, ""), (9, "other text here now"), (7, "\t\n"), (None, "lonely words stand here")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id, r.component_id) for r in simhash.grouped(docs).collect() if r.doc_id is not None)
    assert [x for x in got if x[0] in (1, 2, 7, 9)] == [(1, 1), (2, 1), (7, 1), (9, 9), (9, 9)]
    assert simhash.grouped(docs).count() == len(data)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect() if r.doc_id in (1, 2, 7)) == [1]
    assert simhash.grouped(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        ws = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(4):
            texts.append(" ".join(ws))
            if ws:
                ws[rng.randrange(len(ws))] = "Z"
    data = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(500, None), (501, "")]
    spark.createDataFrame(data, "doc_id long, text string").withColumn("component_id", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = simhash.query(spark, str(tmp_path)).collect()
    fps = {i: by_hand(t) for i, t in data}
    root = roots(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(map(tuple, rows)) == sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps.items())
    names = ["gone", "_gone", "node", "root", "fp"]
    docs = spark.createDataFrame([(2, "a b", *names), (1, "a b", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert [tuple(r) for r in simhash.deduplicate(docs).collect()] == [(1, "a b", *names)]
