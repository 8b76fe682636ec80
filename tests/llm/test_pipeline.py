"""The pipeline on a small corpus, stage by stage, and the queries on the smallest tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from counterspark.llm import queries

from ..conftest import SF
from .test_operators import brute_hits, brute_sets, union_find


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = {"en": ["the", "and", "with", "that", "this", "from", "have"], "de": ["der", "und", "für", "über", "ist", "nicht", "auch"]}
    text = lambda k, n=60: " ".join(rng.choice(words[k], n)) + f" nr{rng.integers(1e9)}"
    rows = [(i, text("en" if i % 3 else "de"), "en" if i % 3 else "de", f"s{i % 4}") for i in range(90)]
    passage = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"
    rows += [(100, rows[3][1], "de", "s0"), (101, rows[3][1].upper(), "de", "s1"), (102, None, "en", "s0"), (103, "", None, None), (104, "123 456", "en", "s0")]
    rows += [(105, text("en") + " " + passage + " " + text("en"), "en", "s2"), (None, text("en"), "en", "s3")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1.0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return d, rows, passage


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, corpus, tmp_path):
    d, rows, passage = corpus
    docs, out = spark.read.parquet(f"file://{d}/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, f"file://{d}").write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        out[i] = docs
        if i < len(cp.STAGES) - 1:
            assert docs.columns == before.columns
    everyone = sorted(-1 if r[0] is None else r[0] for r in rows)
    after = [x for x in everyone if x not in (102, 103, 104)]
    assert ids(out[0]) == after
    kept = [r for r in rows if r[0] is not None and r[0] in after]
    sets = brute_sets([r[1] for r in kept], 5)
    edges = [(i, j) for j in range(len(kept)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = union_find(range(len(kept)), edges)
    assert ids(out[1]) == sorted([-1] + [kept[i][0] for i in range(len(kept)) if groups[i] == i])
    assert ids(out[2]) == [x for x in ids(out[1]) if x != 105] and brute_hits(rows[-2][1], [("1", passage)], 10)[1] == 12
    n = {r["doc_id"]: 0 for r in out[2].select("doc_id").collect()}
    for r in out[3].select("doc_id").collect():
        n[r["doc_id"]] += 1
    assert max(n.values()) <= 2 and sum(n.values()) > len(n)
    last = out[4].toPandas()
    per = last.groupby("shard").size()
    assert len(last) == out[3].count() and per.max() - per.min() <= 1
    assert [name for name, _ in cp.STAGES][0] == "language ID" and cp.ORACLE_SQL is None


def test_near_copies_share_80_per_cent_of_five_words(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(30):  # a text, and copies with 1 to 4 spread edits
        base = [f"w{k}x{i}" for i in range(100)]
        texts.append(" ".join(base))
        for n in range(1, 5):
            w = list(base)
            for j in range(n):
                w[10 + 20 * j + int(rng.integers(0, 8))] = f"e{k}{n}{j}"
            texts.append(" ".join(w))
    words = [t.split() for t in texts]
    sets = {n: [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in words] for n in (3, 5)}

    def firsts(n, percent):
        s = sets[n]
        edges = [(i, j) for j in range(len(s)) for i in range(j) if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
        groups = union_find(range(len(s)), edges)
        return [i for i in groups if groups[i] == i]

    assert len(sets[5][0] & sets[5][2]) / len(sets[5][0] | sets[5][2]) >= 0.8 and len(sets[3][0] & sets[3][2]) / len(sets[3][0] | sets[3][2]) < 0.9
    assert len(firsts(5, 80)) < len(firsts(3, 90))  # some copies lie between the two rules
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    assert ids(cp.near_copies(spark, docs, "")) == sorted(firsts(5, 80))


def test_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (1, a), (3, b), (None, a), (None, a), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1.0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in cp.near_copies(spark, docs, "").collect()))
    assert got == sorted([(1, a), (2, b), (0, a), (0, a), (4, "")])


def test_every_stage_keeps_clashing_columns(spark, corpus, tmp_path):
    d, rows, _ = corpus
    names = ["size", "_h", "_rank", "shard", "curve", "slot", "spans", "items", "lang_pred", "lang_score", "text_hash", "mix_id", "mix_hash", "mix_times", "mix_copy", "hash", "first", "id", "k0"]
    docs = spark.read.parquet(f"file://{d}/documents.parquet").select("*", *[F.lit(f"<{n}>").alias(n) for n in names])
    columns = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, f"file://{d}").write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert docs.columns[:len(columns)] == columns and docs.count()
        assert docs.select(*names).distinct().collect() == [tuple(f"<{n}>" for n in names)]
    assert docs.columns[len(columns):] == ["_shard", "_slot"] and docs.groupBy("_shard").count().count() == 8


def test_empty_corpus(spark, corpus, tmp_path):
    d, _, _ = corpus
    docs = spark.read.parquet(f"file://{d}/documents.parquet").where("false")
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, f"file://{d}").write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_give_a_row_for_each_input_row(spark, name):
    out = queries.QUERIES[name](spark, SF).toPandas()
    table, key = {"op4": ("embeddings", "vec_id"), "op7": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name.startswith("op6"):
        assert len(out) and set(out["status"]) <= {"linked", "no_result", "orphan"}
        return
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key).toPandas()[key]
    assert sorted(out[key]) == sorted(want)


def test_contracts_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    items = [(str(i), t) for i, t in zip(bench["item_id"], bench["text"])]
    o = queries.QUERIES["op9_decontamination"](spark, SF).toPandas().set_index("doc_id")
    for i in list(docs.index)[::7]:
        n, h, found = brute_hits(docs.loc[i, "text"], items, 10)
        assert (o.loc[i, "n_words"], o.loc[i, "n_hit"], o.loc[i, "n_items"]) == (n, h, len(found))
    p = queries.QUERIES["op2_language_id"](spark, SF).toPandas().set_index("doc_id")
    held = p[p["held_out"]]
    assert (held["lang_pred"] == docs.loc[held.index, "lang"]).mean() > 0.95
    q = queries.QUERIES["op10_quality_qda"](spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    both = q.join(labels, how="inner")
    both = both[both["held_out"]]  # no row that it learned from
    assert len(both) >= 10 and (both["predicted"] == both["quality"]).mean() > 0.9
    assert re.fullmatch(r"[0-9a-f]{64}", o["items_sha256"].iloc[0])
