from pyspark.sql import functions as F

from rimefield.llm import mixing


def by_hand(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """The contract's rounds: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, open_, rest = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        extra = {s: rest * w[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            got[s] += extra[s]
            if got[s] >= cap * sizes[s] - 1e-12:
                rest += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
    return got


def test_targets_match_rounds(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, "d": 700, None: 30}, {"a": 5}, {"x": 1, "y": 1, "z": 100000}, {"a": 0, "b": 7}):
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = by_hand(sizes)
        for r in rows:
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]), (sizes, r)


def test_mix_nulls_ties_and_empty(spark):
    data = [(i, "w " * (i % 7 + 1), ["a", "b", None][i % 3], 1) for i in range(3000)] + [(None, None, "a", 1), (5, "w", "b", 1), (5, "w", "b", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _copies_ int")
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(data)
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r._copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r._size * r._copies
        target[r.source] = r._target
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.1 * t
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r._copies for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.plan(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("_copies")).first()[0] == 0


def test_clashing_names_and_many_sources(spark, monkeypatch):
    names = ["row", "_size", "_total", "_target", "_rate", "_copies", "_copy", "_source"]
    docs = spark.createDataFrame([(i, "w " * 3, f"s{i % 40}", *names) for i in range(400)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    rows = sorted(map(tuple, mixing.mix(docs).collect()))
    assert rows and all(r[3:] == tuple(names) for r in rows)
    monkeypatch.setattr(mixing, "SENT", 3)  # the table of sources is joined, not sent
    assert sorted(map(tuple, mixing.mix(docs).collect())) == rows
