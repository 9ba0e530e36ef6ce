import hashlib

from rimefield.llm import decontaminate as dc


def test_items_without_id_hit_and_are_cut(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    rest = "A Clean I/O word, as THEY are. " * 10
    benchmark = spark.createDataFrame([(1, a), (None, a), (None, b), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, rest + a), (2, rest + b), (3, rest + a + " " + b), (4, rest), (5, b)], "doc_id long, text string")
    for most in (10**6, 12):  # one automaton, and several in turn
        rows = dc.mark(docs, benchmark, ["doc_id"], max_words=most).select("row.doc_id", "n", "spans", "items").mapInArrow(dc._digest, dc.DIGEST).collect()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == {1: (12, 1, sha("1"), True), 2: (12, 0, sha(""), True), 3: (24, 1, sha("1"), True), 4: (0, 0, sha(""), False), 5: (12, 0, sha(""), True)}
    out = {r.doc_id: r.text for r in dc.decontaminate(docs, benchmark).collect()}
    assert out == {1: rest, 2: rest, 3: rest, 4: rest}
