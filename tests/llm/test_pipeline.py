"""The pipeline against a plain version over a small corpus, and its stages' contracts."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, components_model, ids_of

import corpus_pipeline
from graphloom.llm import quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = ["the", "river", "runs", "under", "old", "bridges", "and", "stones", "while", "boats", "wait", "near", "quiet", "banks"]
    rows = []
    for i in range(240):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 80))) + ".\nMore."
        if i % 5 == 0:
            text = text.upper().replace(" ", "%%% ")
        elif i % 7 == 0 and rows:
            text = rows[i - 7][1] + " end"
        if i % 11 == 0:
            text += f"\ntoken = {hashlib.md5(str(i).encode()).hexdigest()}"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_equals_plain_version(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert len(good ^ {i for i in range(240) if i % 5}) < 10
    rows = {r["doc_id"]: r for r in docs.collect()}
    heads = {c for _, _, c in components_model([(i, rows[i]["text"]) for i in sorted(good)])}
    texts = {}
    for i in heads:
        text, parts, at = rows[i]["text"], [], 0
        spans = sorted([(m.start(), m.end()) for m in re.finditer(r"token = [0-9a-f]{32}", text)])
        for s, e in spans:
            parts += [text[at:s], "[SECRET]"]
            at = e
        texts[i] = "".join(parts) + text[at:]
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    by = {s: [i for i in heads if rows[i]["source"] == s] for s in ("s0", "s1", "s2", "s3")}
    total, target, weight = sum(size.values()), {}, {"s0": 5, "s1": 2, "s2": 1, "s3": 5}
    free, left = dict(weight), total
    while free:  # the excess of sources that are full goes to the others
        share = left / sum(free.values())
        full = [s for s in free if free[s] * share >= 3 * sum(size[i] for i in by[s])]
        if not full:
            target |= {s: share * w for s, w in free.items()}
            break
        for s in full:
            target[s] = 3 * sum(size[i] for i in by[s])
            left -= target[s]
            del free[s]
    want = Counter()
    for s, own in by.items():
        budget = int(target[s] + 0.5)
        order = sorted(own, key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()[:16])
        while budget > 0:
            for i in order:
                if budget >= size[i]:
                    want[(i, texts[i])] += 1
                elif budget > 0:
                    cut = [m.end() for m in WORD.finditer(texts[i])][budget - 1]
                    want[(i, texts[i][:cut])] += 1
                budget -= min(budget, size[i])
    got = Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    digest = lambda i, t: (i, hashlib.sha256(",".join(map(str, ids_of([t])[0])).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == Counter({digest(*k): n for k, n in want.items()})


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0


OWN = ["_key", "_spans", "_n", "_name", "_score", "quality_score", "_row", "_text", "size", "part", "rid", "name", "node", "hash", "copies"]


def test_stages_with_clashing_names_nulls_and_repeated_rows(spark, sf_dir):
    """Helper columns of the stages take nothing from the caller's columns of the same names."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, "no id here at all", "en", "s1", 5), (7001, None, None, None, None), (7002, "", "en", "s2", 0), (7001, None, None, None, None), (7003, "token = 0123456789abcdef0123456789abcdef ok", "en", "s2", 3)], plain.schema)
    docs = plain.union(more).union(plain.limit(3))
    for i, c in enumerate(OWN):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).collect()
        assert out and out[0].asDict().keys() == set(docs.columns)
        for r in out:
            own = "none" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[c] == f"{i}:{own}" for i, c in enumerate(OWN)), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
