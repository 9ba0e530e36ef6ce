"""corpus_pipeline.run against its stages done by brute force."""

import hashlib
import random
import sys
from pathlib import Path

from test_decontaminate import by_hand as benchmark_hits  # noqa: F401
from test_mixing import by_hand as targets
from test_secrets import brute
from test_simhash import by_hand as fingerprint
from test_simhash import roots

from rimefield.llm import toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

ITEM = " ".join(f"item{i}" for i in range(14))


def tables():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "ke", "mo", "ru", "ti") for b in ("n", "tor", "lim", "sav", "den")]
    docs, labels = [], []
    for i in range(420):
        ws = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 6 == 0:
            ws.insert(rng.randrange(len(ws)), rng.choice(["snark", "Sn\u0430rk", "5nark"]))
        if i % 7 == 1:
            ws += ["token=abcdef" + str(i), "end"]
        if i % 11 == 2:
            ws += ITEM.split() + [rng.choice(words) for _ in range(40)]
        if i % 13 == 3 and docs:
            ws = docs[-1][1].split()
        docs.append((i, " ".join(ws), "en", f"s{i % 4}" if i % 5 else None))
        labels.append((i, int("snark" in toxicity.fold(" ".join(ws)).split()), 1))
    docs += [(1000, None, None, "s1"), (1001, "", "en", "s1"), (1002, ITEM, "en", "s2"), (None, "without any id here", "en", "s0"), (None, "without any id here", "en", "s0")]
    return docs, labels


def test_run_equals_brute_force(spark, tmp_path):
    docs, labels = tables()
    columns = [(i, t, lang, s, None if t is None else len(t), "kept") for i, t, lang, s in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    spark.createDataFrame(columns, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    toxic = {i for i, t, *_ in docs if "snark" in toxicity.fold(t).split()}
    rows = [r for r in columns if r[0] not in toxic]
    fps = [fingerprint(r[1]) for r in rows]
    root = roots(sorted(set(fps)))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    rows = [r for r, f in zip(rows, fps) if r[0] is None or least[root[f]] == r[0]]
    out = []
    for r in rows:
        text, size = r[1], r[4]
        if text and ITEM in text:
            if 2 * 14 > len(text.replace("=", " ").split()):
                continue
            text = text.replace(ITEM, "")
            size = len(text)
        for _, a, b in reversed(brute(text)):
            text = text[:a] + "[SECRET]" + text[b:]
            size = len(text)
        out.append((r[0], text, r[2], r[3], size, r[5]))
    sizes = {}
    for r in out:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want, goal = [], targets(sizes)
    for r in out:
        rate = goal[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        u = int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|mix-1".encode()).hexdigest()[:8], 16) / 2**32
        want += [r] * (int(rate) + (u < rate - int(rate)))
    assert got == sorted(want, key=str) and len({r[0] for r in got}) > 200
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
