import random

from pyspark.sql import functions as F

from rimefield.llm import license_scan as ls


def best(text):
    """Best containment of each template in any stretch of the text as long as a window."""
    ws, out = ls.template_words(text or ""), {}
    sh = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    for name, t in ls.TEMPLATES.items():
        tw = ls.template_words(t)
        ts = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        n = len(tw) - 4
        step = -(-n // 2)
        got = max((len(ts & set(sh[a : a + n + step - 1])) / len(ts) for a in range(0, len(sh), step)), default=0)
        if got >= ls.SHARE:
            out[name] = round(got, 9)
    return out


def test_bands_guarantee_collisions():
    assert all(ls.collision_probability(t) > 0.9999 for t in range(1, 200))


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    names, docs = list(ls.TEMPLATES), []
    for d in range(150):
        ws = [rng.choice(["the", "code", "license", "public", "x"]) for _ in range(rng.randrange(0, 60))]
        t = ls.TEMPLATES[rng.choice(names)].split()
        if rng.random() < 0.5 and len(t) > 12:
            t[rng.randrange(len(t))] = "changed"
        at = rng.randrange(len(ws) + 1)
        docs.append((d, " ".join(ws[:at] + (t if rng.random() < 0.7 else t[: len(t) // 2]) + ws[at:])))
    docs += [(900, None), (901, ""), (902, "too short"), (903, "plain " * 30000 + ls.TEMPLATES["MIT"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit("clash"))
    got = {}
    for r in ls.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = round(r.containment, 9)
    for d, t in docs:
        assert got.get(d, {}) == best(t), (d, t[:300] if t else t)
    assert ls.scan(df.where("false")).count() == 0


def test_recall_on_edited_texts(spark):
    """Long texts with edited words: bands retrieve all occurrences that keep the share of shingles. Clashing names, repeated and null ids."""
    rng = random.Random(6)
    long = [k for k, v in ls.TEMPLATES.items() if len(ls.template_words(v)) > 60]
    assert len(long) >= 6
    docs = []
    for d in range(120):
        ws = ls.TEMPLATES[long[d % len(long)]].split()
        for _ in range(rng.randrange(0, 5)):
            ws[rng.randrange(len(ws))] = "edited"
        pad = lambda: [rng.choice(["some", "other", "words", "here"]) for _ in range(rng.randrange(0, 90))]
        docs.append((d, " ".join(pad() + ws + pad())))
    docs += [(0, docs[0][1]), (None, docs[1][1]), (None, docs[1][1])]
    names = ["hashes", "mark", "near", "first", "window", "t", "p", "license"]
    df = spark.createDataFrame([(*r, *names) for r in docs], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got, want = {}, {}
    for r in ls.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = round(r.containment, 9)
    for d, t in docs:
        if b := best(t):
            want[d] = b
    assert got == want and len(want) > 90
