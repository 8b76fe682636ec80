"""Small fixtures with nulls, empties, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterspark.llm import common
from counterspark.llm import decontamination as dc
from counterspark.llm import embeddings as em
from counterspark.llm import jaccard_join as jj
from counterspark.llm import langid, mixing, quality, sharding, token_counts, tool_calls, warc
from counterspark.llm.common import Workspace, connected_components, global_rank, running_total

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, held_out string, id int, t string, `_text` string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); extra columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", "z") for r in rows], DOCS)


def some_texts():
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab, 80)) for _ in range(20)]
    out = []
    for i, b in enumerate(base):
        out.append(b)
        if i % 3 == 0:
            w = b.split()
            for k in range(1, 4):  # near copies at growing distance
                v = list(w)
                for j in range(k):
                    v[10 + 20 * j] = f"new{i}{k}{j}"
                out.append(" ".join(v))
        if i % 4 == 0:
            out.append(b.upper().replace(" ", "\t"))
    return out + [None, "", "  \n", "one", "one two", "ONE  TWO", "one two three", "x" * 50_000, " ".join(["same"] * 30_000)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "", "b", "a"][i % 4]) for i, t in enumerate(some_texts())]
    return docs(spark, rows + [rows[0], rows[0], (None, "an id is missing here", None, "a")])


def union_find(ids, edges):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- shared helpers


def test_ranks_totals_and_components(spark):
    ws = Workspace(spark, "t")
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, v int")
    ranked, n = global_rank(ws, df, ["k", "v"], "r")
    got = ranked.orderBy("r").toPandas()
    assert n == 100 and got["r"].tolist() == list(range(100)) and got["k"].is_monotonic_increasing
    tot = running_total(ws, df.withColumn("b", F.col("v") % 3), ["k"], "b", ["v"], "v", "s").orderBy("k", "b", "v").toPandas()
    assert (tot.groupby("k")["s"].apply(list) == tot.groupby("k")["v"].apply(lambda v: [0, *np.cumsum(v)[:-1]])).all()
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b] + [(300 + i, 301 + i) for i in range(40)]
    got = {r[0]: r[1] for r in connected_components(ws, spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    ids = {x for e in edges for x in e}
    assert got == union_find(ids, edges)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert connected_components(ws, none, "a", "b").count() == 0


# ---- 1 mixing


def test_mixing(spark, table):
    out, spans = mixing.mix_sources(table, Workspace(spark, "t"), block_tokens=64)
    o = out.toPandas()
    words = table.toPandas()["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert len(o) == table.count() and o["size"].sum() == words.sum() and (o["taken"] <= 2 * o["size"]).all()
    order = sorted(o["source"].dropna().unique()) + [None]
    key = o["source"].map(lambda s: order.index(s) if isinstance(s, str) else len(order) - 1)
    size, target, taken = o.groupby(key)["size"].sum(), o.groupby(key)["target"].first(), o.groupby(key)["taken"].sum()
    assert target.sum() == pytest.approx(1.5 * size.sum()) and (target <= 2 * size + 1e-9).all()
    weight = pd.Series([(5, 2, 1)[i % 3] for i in range(len(order))])
    free = target < 2 * size - 1e-9
    assert (target / weight)[free].nunique() <= 1 or np.ptp((target / weight)[free]) < 1e-6
    assert ((target - taken).abs() <= 1).all()
    assert spans.agg(F.sum("words")).first()[0] == taken.sum()
    again, _ = mixing.mix_sources(table, Workspace(spark, "t"), block_tokens=64)
    key = ["doc_id", "taken"]
    assert again.toPandas()[key].sort_values(key).reset_index(drop=True).equals(o[key].sort_values(key).reset_index(drop=True))


def plain_mix(rows, block):
    """The mix, word by word: (words taken of each row, (slot, row, word) of each word), rows: (doc_id, source, size, hash)."""
    order = sorted({r[1] for r in rows if r[1] is not None}) + ([None] if any(r[1] is None for r in rows) else [])
    size = [sum(r[2] for r in rows if r[1] == s) for s in order]
    weight = [(5, 2, 1)[i % 3] for i in range(len(order))]
    target, room, open_ = [0.0] * len(order), 1.5 * sum(size), list(range(len(order)))
    while open_:
        level = room / sum(weight[i] for i in open_)
        full = [i for i in open_ if level * weight[i] >= 2 * size[i]]
        if not full:
            break
        for i in full:
            target[i], room = 2.0 * size[i], room - 2 * size[i]
            open_.remove(i)
    for i in open_:
        target[i] = level * weight[i]
    quota = [int(t) for t in target]
    need, n_slots, golden = [-(-q // block) for q in quota], int(np.ceil(1.5 * sum(size) / block)), (5 ** 0.5 - 1) / 2
    bounds, slots, got = np.cumsum([0, *quota]) / max(1, sum(quota)), [], [0] * len(order)
    for k in range(n_slots):
        x = (k + 1) * golden % 1
        i = next((i for i in range(len(order)) if bounds[i] <= x < bounds[i + 1]), None)
        if i is not None:
            slots.append((k, i, got[i]))
            got[i] += 1
    slots += [(n_slots, i, r) for i in range(len(order)) for r in range(got[i], need[i])]
    n_buckets = max(1, min(4096, len(rows) // 1_000), -(-len(rows) // 20_000))
    tapes = [[(k, w) for k in sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (rows[k][3] % n_buckets, rows[k][3], rows[k][0] is not None, rows[k][0] or 0)) for w in range(rows[k][2])] for s in order]
    words = []
    for k, i, r in slots:
        for w in range(r * block, min((r + 1) * block, quota[i])):
            row, word = tapes[i][w % len(tapes[i])]
            words.append((k, row, word))
    return target, words


def test_mixing_against_a_plain_schedule(spark, table):
    t = table.withColumn("h", F.xxhash64("doc_id", "text")).toPandas()
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    rows = sorted([(None if pd.isna(r.doc_id) else int(r.doc_id), r.source if isinstance(r.source, str) else None, count(r.text), r.h) for r in t.itertuples()], key=str)
    target, words = plain_mix(rows, 64)
    out, spans = mixing.mix_sources(table, Workspace(spark, "t"), block_tokens=64)
    o = out.toPandas()
    got = sorted(o[["source", "target"]].drop_duplicates()["target"])
    np.testing.assert_allclose(got, sorted(target))
    # rows that repeat are interchangeable: compare by what was read
    want = {}
    for slot, row, word in words:
        want[slot, rows[row][3], word] = want.get((slot, rows[row][3], word), 0) + 1
    h, mine = dict(zip(o["row"], o["hash"])), {}
    for s in spans.toPandas().itertuples():
        for w in range(int(s.start), int(s.start + s.words)):
            mine[int(s.slot), h[s.row], w] = mine.get((int(s.slot), h[s.row], w), 0) + 1
    assert mine == want


def test_mixing_of_nothing(spark, table):
    assert mixing.mix_sources(table.where("false"), Workspace(spark, "t"))[0].count() == 0
    o = mixing.mix_sources(docs(spark, [(1, None, None, None), (2, "", None, "a")]), Workspace(spark, "t"))[0].toPandas()
    assert o["taken"].tolist() == [0, 0] and o["target"].tolist() == [0, 0]


def test_schedule_prefixes_are_in_proportion(spark):
    targets = spark.createDataFrame([("a", 0, 10**6, 50_000.0), ("b", 1, 10**6, 30_000.0), ("c", 2, 10**6, 20_000.0)], "source string, idx int, source_size bigint, target double")
    s = mixing.schedule(Workspace(spark, "t"), targets, 100_000, 100).orderBy("slot").toPandas()
    for n in (50, 200, 700):
        share = s[s.slot < n]["idx"].value_counts(normalize=True).sort_index()
        assert np.abs(share.to_numpy() - [0.5, 0.3, 0.2]).max() < 3 / n + 0.01


# ---- 2 language


def test_language_id(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "with", "that", "this"], "fr": ["les", "été", "avec", "que", "où"], "de": ["der", "und", "für", "über", "ist"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k, "s") for i, k in enumerate(["en", "fr", "de"] * 60)]
    rows += [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 34 !!", "fr", "s"), (903, "ÜBER FÜR UND", None, None), (904, "the and " * 200_000, None, None)]
    d = docs(spark, rows)
    model = langid.train(d.where(~langid.held_out(4, 2)))
    o = langid.identify(d, model, ["doc_id", "lang", "held_out", "_text"]).toPandas().set_index("doc_id")
    assert (o.loc[:179, "lang"] == o.loc[:179, "lang_pred"]).mean() > 0.98
    assert o.loc[[900, 901, 902], "lang_pred"].tolist() == ["und"] * 3 and o.loc[903, "lang_pred"] == "de" and o.loc[904, "lang_pred"] == "en"
    assert o["score"].between(0, 1).all() and len(o) == len(rows)
    assert langid.train(d.where("lang is null")) is None
    assert set(langid.identify(d, None, ["doc_id"]).toPandas()["lang_pred"]) == {"und"}
    assert langid.identify(d.where("false"), model, ["doc_id"]).count() == 0


def test_a_copied_text_leaves_room_for_other_languages(spark):
    hot = spark.range(5000).select(F.concat(F.lit("the hot text "), F.col("id")).alias("text")).orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).first()[0]
    rows = [(hot, "en")] * 600 + [(f"the text that is {i}", "en") for i in range(300)] + [(f"der und das {i}", "de") for i in range(300)]
    learn, quota = spark.createDataFrame(rows, "text string, lang string"), 40
    picked = langid.in_quota(langid.training_sample(learn, {"en": 301, "de": 300}, quota, langid.BITS).toPandas(), quota)
    per = picked["lang"].value_counts()
    assert per.max() <= quota and per.min() >= 25 and picked["h"].is_unique
    models = [langid.train(learn.repartition(n, "text"), max_train_rows=80) for n in (1, 7)]
    np.testing.assert_array_equal(models[0].weights, models[1].weights)


def test_language_model_against_a_plain_one(spark):
    """Dictionaries of n-grams, loops over coordinates: the same weights, frequencies and scores."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(v, 6)), k) for k, v in (("en", ["the", "and", "of"]), ("de", ["der", "und", "von"])) for _ in range(25)]
    rows = sorted(set(rows))
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), bits=10)
    counts = [langid.gram_counts(t, 10) for t, _ in rows]
    for (t, _), c in zip(rows, counts):
        assert c.sum() == sum(max(0, len(t) - n + 1) for n in (1, 2, 3))
    df = np.sum([c > 0 for c in counts], axis=0)
    np.testing.assert_allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "text string, lang string").withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (hashes[r[0]], r[1]))
    held = [(hashes[t] >> 32) % 5 == 0 for t, _ in ordered]
    x = []
    for t, _ in ordered:
        v = np.log1p(langid.gram_counts(t, 10)) * model.idf
        x.append(np.append(v / np.sqrt((v * v).sum()), 1.0))
    y = [["de", "en"].index(k) for _, k in ordered]
    fit_on = [i for i in range(len(x)) if not held[i]]
    z, n, order = np.zeros((1025, 2)), np.zeros((1025, 2)), np.random.default_rng(7)
    weight = lambda: np.array([[0.0 if abs(z[i, c]) <= 1e-4 else (np.sign(z[i, c]) * 1e-4 - z[i, c]) / ((1 + np.sqrt(n[i, c])) / 1.0 + 1e-3) for c in range(2)] for i in range(1025)])
    for _ in range(3):
        for r in order.permutation(len(fit_on)):
            i = fit_on[r]
            w = weight()
            p = np.exp(x[i] @ w)
            p /= p.sum()
            p[y[i]] -= 1
            for f in np.flatnonzero(x[i]):
                g = x[i][f] * p
                z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) * w[f]
                n[f] += g * g
    np.testing.assert_allclose(model.weights, weight(), atol=1e-4)
    assert np.exp(-4) * 1.01 < model.temperature < np.exp(4) * 0.99


def test_scores_are_calibrated_on_held_out_documents(spark):
    """Languages that share most of their words: the mean score is about the share that is right."""
    rng = np.random.default_rng(9)
    common = [f"wa{i}o" for i in range(40)]
    own = {k: [f"{k}{i}" for i in range(12)] for k in ("en", "fr", "de")}
    text = lambda k: " ".join(rng.choice(own[k] if rng.random() < 0.12 else common) for _ in range(8))
    d = docs(spark, [(i, text(k), k, None) for i, k in enumerate(["en", "fr", "de"] * 500)])
    o = langid.identify(d, langid.train(d.where(~langid.held_out(4, 2))), ["doc_id", "lang"]).withColumn("out", langid.held_out(4, 2)).toPandas()
    held = o[o["out"]]
    right = held["lang"] == held["lang_pred"]
    assert 0.5 < right.mean() < 0.98 and abs(held["score"].mean() - right.mean()) < 0.06
    sure = held["score"] > held["score"].median()
    assert right[sure].mean() > right[~sure].mean() + 0.1


def test_unknown_scripts_have_no_sure_language(spark):
    d = docs(spark, [(i, f"the and of {i}" if i % 2 else f"der und von {i}", "en" if i % 2 else "de", None) for i in range(80)] + [(100, "これは日本語の文です", None, None), (101, "это русский текст", None, None)])
    o = langid.identify(d, langid.train(d), ["doc_id"]).toPandas().set_index("doc_id")
    assert (o.loc[[100, 101], "score"] < 0.55).all() and (o.loc[:79, "score"] > 0.8).all()


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "".join(chr(97 + i % 23) for i in range(5000)) + "é" * 7
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 777)
    np.testing.assert_array_equal(langid.gram_counts(text), whole)


def test_temperature():
    y = np.array([0] * 80 + [1] * 20)
    logits = np.tile([5.0, 0.0], (100, 1))  # 80 % right, 99 % sure
    t = langid.fit_temperature(logits, y)
    assert 1 / (1 + np.exp(-5 / t)) == pytest.approx(0.8, abs=0.01)
    sure = langid.fit_temperature(np.tile([5.0, 0.0], (100, 1)), np.zeros(100, dtype=int))  # all right: as sure as 100 rows allow
    assert 1 / (1 + np.exp(-5 / sure)) == pytest.approx(101 / 102, abs=1e-3)


# ---- 3 sharding


def test_hilbert_curve_steps_are_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    h = sharding.hilbert_index(g, 3)
    assert sorted(h) == list(range(512))
    walk = g[:, np.argsort(h)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def plain_codes(values, bits):
    """A value's place among the distinct ones in order (null first), spread over the codes."""
    distinct = sorted(set(values), key=lambda v: (v is not None, (v or "").encode()))
    top = (1 << bits) - 1
    return {v: int(np.floor(i * float(top) / max(1, len(distinct) - 1))) for i, v in enumerate(distinct)}


def test_sharding(spark, table):
    o = sharding.shard_by_curve(table, 8, Workspace(spark, "t"), ["doc_id", "held_out", "t"]).toPandas()
    n = o.groupby("shard").size()
    assert len(o) == table.count() and n.max() - n.min() <= 1 and set(o["shard"]) == set(range(8))
    assert all(sorted(g) == list(range(len(g))) for _, g in o.groupby("shard")["slot"])
    t = table.withColumn("h", F.xxhash64("text")).withColumn("step", sharding.length_step(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).toPandas()
    # shards and slots are those of a plain sort by the curve
    lang, source = (plain_codes([None if pd.isna(v) else v for v in t[c]], sharding.BITS) for c in ("lang", "source"))
    length = {v: (int((t["step"] < v).sum()) << sharding.BITS) // len(t) for v in t["step"]}
    rows = []
    for r in t.itertuples():
        raw = (r.text or "").encode()
        at = np.array([[lang[None if pd.isna(r.lang) else r.lang]], [source[None if pd.isna(r.source) else r.source]], [length[r.step]]])
        rows.append((int(sharding.hilbert_index(at, sharding.BITS)[0]), zlib.crc32(raw), r.h, -1 if pd.isna(r.doc_id) else int(r.doc_id), len(raw) + 1))
    rows.sort()
    want = [(k * 8 // len(rows), k - next(j for j in range(len(rows)) if j * 8 // len(rows) == k * 8 // len(rows)), x[0], x[1], x[3], x[4]) for k, x in enumerate(rows)]
    got = o.sort_values(["shard", "slot"]).fillna({"doc_id": -1})
    assert [tuple(map(int, x)) for x in got[["shard", "slot", "curve", "text_crc32", "doc_id", "size"]].itertuples(index=False)] == want
    assert sharding.shard_by_curve(table.where("false"), 8, Workspace(spark, "t")).count() == 0
    few = sharding.shard_by_curve(table.limit(3), 8, Workspace(spark, "t")).toPandas()
    assert len(few) == 3 and few["shard"].is_unique


def test_sharding_keeps_clashing_columns(spark, table):
    odd = table.select("doc_id", "text", "lang", "source", F.lit("a").alias("shard"), F.lit("b").alias("SIZE"), F.lit("c").alias("_rank"), F.lit("d").alias("curve"), F.lit("e").alias("_h"))
    o = sharding.shard_by_curve(odd, 8, Workspace(spark, "t"), odd.columns)
    assert o.columns == [*odd.columns, "_size", "text_crc32", "_curve", "_shard", "slot"]
    assert o.select("shard", "SIZE", "_rank", "curve", "_h").distinct().collect() == [("a", "b", "c", "d", "e")] and o.count() == table.count()


def test_cut_points_cover_more_values_than_codes(spark):
    df = spark.createDataFrame([(f"v{i:03}",) for i in range(100)] + [(None,)], "lang string")
    cuts = sharding.cut_points(Workspace(spark, "t"), df, "lang", 3)
    want = plain_codes([None, *(f"v{i:03}" for i in range(100))], 3)
    values = [None, *(f"v{i:03}" for i in range(100))]
    assert sharding.code_of(values, cuts).tolist() == [want[v] for v in values] and len(cuts) <= 8


def test_shard_files_prune_on_every_dimension(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 12)), f"l{rng.integers(8)}", f"s{rng.integers(8)}") for i in range(4000)]
    placed = sharding.shard_by_curve(docs(spark, rows), 32, Workspace(spark, "t"), ["doc_id", "lang", "source"])
    sharding.write_shards(placed, f"file://{tmp_path}/shards")
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/shards/**/*.parquet", recursive=True)]
    assert sum(f.metadata.num_rows for f in files) == 4000 and len(files) >= 32

    def read(column, value):  # files whose statistics let the value in
        n = 0
        for f in files:
            s = f.metadata.row_group(0).column(f.schema_arrow.names.index(column)).statistics
            n += s.min <= value <= s.max
        return n / len(files)

    for column, values in (("lang", [f"l{i}" for i in range(8)]), ("source", [f"s{i}" for i in range(8)]), ("size", [2, 30, 1000, 3000])):
        assert np.mean([read(column, v) for v in values]) < 0.7, column
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.groupBy("shard").count().count() == 32


# ---- 4 embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    v = [*base, *(base[:30] + rng.normal(size=(30, 16)) * 0.2), *base[:5], *[base[0] + rng.normal(size=16) * 0.15 for _ in range(60)]]
    rows = [(i, [float(x) for x in a], i % 2 if i < 60 else (i - 60) % 2) for i, a in enumerate(v)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [float("inf")] * 16, 0), (906, [], 0), (907, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id bigint, embedding array<float>, label int, rep string, bits int")
    for block in (512, 16):  # the second cuts hot buckets
        o = em.near_duplicates(df, Workspace(spark, "t"), miss=1e-9, block=block).toPandas().set_index("vec_id").sort_index()
        x = np.array([np.float32(r[1]).astype(np.float64) for r in rows])
        c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]
        lab = np.array([r[2] for r in rows])
        link = (c >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
        assert o["n_links"].tolist() == [*link.sum(1), *[0] * len(bad)]
        comp = union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link))])
        assert o["component_id"].tolist() == [*(comp[i] for i in range(len(x))), *range(900, 908)]
        assert (o["kept"] == (o.index == o["component_id"])).all()
    assert em.near_duplicates(df.where("false"), Workspace(spark, "t")).count() == 0


def test_embedding_recall_at_the_shipped_setting(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(size=(500, 24))
    far = lambda a, c: c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * (o := rng.normal(size=24), o := o - (o @ a) / (a @ a) * a)[1] / np.linalg.norm(o)
    x = np.array([*base, *(far(a, c) for a in base for c in (0.931, 0.96))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    o = em.near_duplicates(df, Workspace(spark, "t")).toPandas().set_index("vec_id").sort_index()
    c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]
    link = ((c >= 0.93) & ~np.eye(len(x), dtype=bool)).sum(1)
    assert (o["n_links"].to_numpy() <= link).all() and o["n_links"].sum() >= 0.99 * link.sum() and link.sum() >= 2000


def test_spanning_forest():
    rng = np.random.default_rng(2)
    for n in (2, 30, 200):
        i, j = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        want = union_find(range(n), zip(i.tolist(), j.tolist()))
        assert em.spanning_forest(i, j, n).tolist() == [want[k] for k in range(n)]


# ---- 5 Jaccard join


def brute_sets(texts, words=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        out.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def hot_texts():
    rng = np.random.default_rng(2)
    texts = some_texts()
    hot = [f"h{i}" for i in range(150)]
    for k in range(40):  # a hot group: near copies of one text, not all of them linked
        w = list(hot)
        for j in rng.choice(150, 1 + k % 3, replace=False):
            w[j] = f"e{k}{j}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("settings", [{}, {"hot_list": 1, "open_per_posting": 0.0, "shard_entries": 3}])
def test_jaccard_join(spark, settings, words, percent):
    texts = hot_texts()
    # an id that repeats with its text, and one that repeats with another text
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[1], None, None), (2, texts[-1], None, None)])
    o = jj.JaccardJoin(d, Workspace(spark, "t"), words, percent, bits=12, **settings).components().toPandas()
    ids = [*range(len(texts)), 0, 2]
    sets = brute_sets([*texts, texts[0], texts[-1]], words)
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = union_find(range(len(sets)), edges)
    low = {}
    for i, c in comp.items():
        low[c] = min(low.get(c, ids[i]), ids[i])
    known = o[o["doc_id"].notna()].astype({"doc_id": int, "component_id": int})
    assert len(edges) > 50
    assert sorted(zip(known["doc_id"], known["component_id"], known["n_shingles"])) == sorted((ids[i], low[comp[i]], len(sets[i])) for i in range(len(sets)))
    assert o[o["doc_id"].isna()]["component_id"].isna().all()


def test_jaccard_join_of_nothing(spark, table):
    assert jj.JaccardJoin(table.where("false"), Workspace(spark, "t"), bits=12).components().count() == 0
    o = jj.JaccardJoin(table.where("text is null or trim(text) = ''"), Workspace(spark, "t"), bits=12).components().toPandas()
    assert (o["n_shingles"] == 0).all() and (o["doc_id"] == o["component_id"]).all()


def test_merge_and_probe():
    lists = [np.array([1, 4, 9]), np.array([4, 9]), np.array([2, 9, 12])]
    assert dict(jj.merge_short_lists(lists, 2)) == {4: 2, 9: 3}
    a = np.arange(0, 300, dtype=np.uint64)
    other = (np.arange(100, 300, dtype=np.uint64), np.arange(50, 100, dtype=np.uint64))
    assert jj.probe_long_lists(a, other, 0, 250) and not jj.probe_long_lists(a, other, 0, 251) and jj.probe_long_lists(a, other, 7, 257)
    for percent in (80, 90):
        for n in range(1, 80):
            for m in range(n, 80):
                least = min((i for i in range(n + 1) if 100 * i >= percent * (n + m - i)), default=None)
                assert least is None or jj.required(n, m, percent) == least


def test_the_merge_counts_all_short_shingles_of_the_side_that_ends_first():
    rng = np.random.default_rng(12)
    levels = rng.integers(0, 20, 1 << 8).astype(np.uint8)
    for _ in range(200):
        pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(5, 60)))) for _ in range(2))
        (sa, la, ea), (sb, lb, eb) = (jj.divide(x, levels, 80) for x in (a, b))
        if ea != eb:
            count = len(set(sa.tolist()) & set(sb.tolist()))
            first, rest, other = (sa, la, b) if ea < eb else (sb, lb, a)
            assert count == len(set(first.tolist()) & set(other.tolist()))
            assert count + len(set(rest.tolist()) & set(other.tolist())) == len(set(a.tolist()) & set(b.tolist()))


def test_the_sketch_counts_beyond_16_bits():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(["a b c"] * 70_000 + ["d e f"] * 3)], ["text"])
    count, add = jj._sketch(3, 8)
    total = np.zeros(256, dtype=np.int64)
    for piece in count(iter([rows])):
        total += np.frombuffer(__import__("zlib").decompress(piece.column("counts")[0].as_py()), dtype=np.uint16)
    assert sorted(total[total > 0].tolist()) == [3, 70_000]


def test_words_hash_alike_in_chunks_of_any_size(monkeypatch):
    text = "Hello  world " + "a" * 40 + " bbb\tc hello é " + "a" * 40
    raw, _ = common.joined([text.encode()])
    whole = common.hashed_words(raw, jj._WORD)
    for size in (1, 2, 7, 16):
        monkeypatch.setattr(common, "_CHUNK", size)
        for x, y in zip(common.hashed_words(raw, jj._WORD), whole):
            np.testing.assert_array_equal(x, y)
    assert len(whole[2]) == 8 and whole[2][0] == whole[2][5] and whole[2][2] == whole[2][7] and len(set(whole[2].tolist())) == 6


def test_a_long_text_takes_bounded_memory():
    import tracemalloc

    text = "ab c " * 2_000_000  # 10 MB, 4 million words
    for make, most in ((lambda: jj.shingles([text]), 20), (lambda: list(dc.search_texts([text], dc.Windows([("i", "x y z")], 10), 10)), 20)):
        tracemalloc.start()
        make()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text)


# ---- 6 tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 3, "f", '{"x": 1, "b": {"z": 1, "a": [2, 1]}}', ["b"]), (1, "b", 5, "f", '{"x": 2}', []), (1, "c", 6, "f", '{"x": "no"}', ["a", "gone"]),
        (2, "p", 1, "f", '{"x": 1, "extra": 2}', []), (2, "q", 2, "g", "{}", ["p"]), (2, "q", 2, "g", "{}", ["p"]), (3, "u", 1, "f", "not json", ["v"]), (3, "v", 2, "f", None, ["u"]),
        (None, "n", 1, "f", '{"x": 1}', []),
    ], "conv_id int, call_id string, turn int, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 4, "ok"), (2, "lost", 4, "?"), (None, "n", 2, "no")], "conv_id int, call_id string, turn int, content string")
    schemas = {"f": {"x": ("integer", True), "b": ("object", False)}}
    o = tool_calls.link_tool_calls(calls, results, schemas, Workspace(spark, "t")).toPandas()
    r = {(x.conv_id, x.call_id): x for x in o.itertuples()}
    assert [r[1, c].rank for c in "bac"] == [0, 1, 2]  # a waits for b although it was said before
    assert [r[2, c].rank for c in "pq"] == [0, 1] and pd.isna(r[3, "u"].rank) and pd.isna(r[3, "v"].rank)  # a cycle has none
    assert r[1, "a"].valid and r[1, "a"].result == "ok" and not r[1, "c"].valid and not r[2, "p"].valid and not r[2, "q"].valid and not r[3, "u"].valid
    assert r[1, "a"].json == '{"arguments":{"b":{"a":[2,1],"z":1},"x":1},"call_id":"a","conv_id":1,"name":"f","rank":1,"result":"ok","status":"linked","valid":true}'
    assert (o["status"] == "orphan").sum() == 2 and (o["call_id"] == "q").sum() == 2
    none = tool_calls.link_tool_calls(calls.where("false"), results.where("false"), schemas, Workspace(spark, "t"))
    assert none.count() == 0


def test_every_result_with_a_null_key_is_an_orphan(spark):
    turns = [
        (None, 1, "user", "u1"), (None, 2, "assistant", "a1"), (None, 4, "assistant", "a2"), (None, 4, "assistant", "a2"), (7, None, "user", "u2"),
        (7, None, "assistant", "a3"), (7, None, "assistant", "a4"), (7, 1, "user", "u3"), (7, 2, "assistant", "a5"), (7, 2, "assistant", "a6"), (8, 3, "assistant", "a7"),
    ]
    c = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    o = tool_calls.link_tool_calls(*tool_calls.calls_of_turns(c), tool_calls.REPLY, Workspace(spark, "t")).toPandas()
    alone = o[o["status"] == "orphan"]
    assert sorted(alone["result"]) == ["a1", "a2", "a2", "a3", "a4", "a7"] and alone["json"].str.contains('"status":"orphan"').all()
    assert alone["valid"].isna().all() and alone["rank"].isna().all() and alone["conv_id"].isna().sum() == 3
    assert o[o["status"] == "linked"]["result"].tolist() == ["a5"] and (o["status"] == "no_result").sum() == 2 and len(o) == 9


def test_every_result_without_a_call_is_a_row(spark):
    calls = spark.createDataFrame([(1, "a", 1, "f", "{}", [])], "conv_id int, call_id string, turn int, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "b", 2, "x"), (1, "b", 2, "x"), (1, "b", 3, "y"), (1, "a", 4, "z"), (1, "a", 5, "late")], "conv_id int, call_id string, turn int, content string")
    o = tool_calls.link_tool_calls(calls, results, {"f": {}}, Workspace(spark, "t")).toPandas()
    assert sorted(o[o["status"] == "orphan"]["result"]) == ["x", "x", "y"] and o[o["status"] == "linked"]["result"].tolist() == ["z"] and len(o) == 4


def test_topological_ranks_against_longest_paths(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for conv in range(30):
        n = int(rng.integers(1, 9))
        after = {k: sorted({int(x) for x in rng.integers(0, n, rng.integers(0, 3))}) for k in range(n)}
        rows += [(conv, str(k), k, [*(str(x) for x in after[k]), "gone"]) for k in range(n)]
        rank = {}
        while new := {k: max((rank[x] for x in after[k]), default=-1) + 1 for k in range(n) if k not in rank and all(x in rank for x in after[k])}:
            rank |= new
        want |= {(conv, str(k)): rank.get(k) for k in range(n)}
    assert None in want.values() and max(v for v in want.values() if v is not None) >= 3
    o = tool_calls.topological_rank(spark.createDataFrame(rows, "conv_id int, call_id string, turn int, after array<string>"), Workspace(spark, "t")).collect()
    assert {(r["conv_id"], r["call_id"]): r["rank"] for r in o} == want


def test_tool_call_query_against_its_sql_on_odd_tables(spark, tmp_path):
    import duckdb

    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(40)]  # backward edges at calls 1, 5, 9 ...
    turns += [(2, k, "system" if k == 0 else "user" if k % 2 else "assistant", f"s{k}") for k in range(13)]
    turns += [(1, 1, "assistant", "again"), (1, 0, "user", "t0"), (3, 8, "assistant", "o"), (3, 8, "assistant", "o"), (4, 2, "user", None), (4, 3, "assistant", None)]
    turns += [(None, 1, "user", "u"), (None, 2, "assistant", "a"), (None, 2, "assistant", "a"), (5, None, "assistant", "b"), (5, None, "user", "c")]
    c = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    c.write.parquet(f"file://{tmp_path}/conversations.parquet")
    o = tool_calls.op6_tool_calls(spark, f"file://{tmp_path}").toPandas()
    sql = duckdb.connect()
    sql.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sql.sql(tool_calls.OP6_SQL).df()
    key = lambda rows: sorted(rows, key=lambda r: tuple((v is not None, v or "") for v in r))
    plain = lambda df: key([tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)])
    assert plain(o) == plain(want)
    r = o[o["conv_id"] == 1].set_index("turn")["rank"]
    assert r[2] > r[4] and (o["status"] == "orphan").sum() == 5  # call 1 comes after call 2, which was said later


# ---- 7 WARC


def test_arc_headers_of_both_versions():
    one = b"filedesc://x 0.0.0.0 20000101000000 text/plain 76\n1 0 X\nURL IP-address Archive-date Content-type Archive-length\n" + b"\n" * 14
    got = list(warc.parse_arc(warc._version_block(1) + b"\nhttp://a/ 1.2.3.4 19990102030405 text/html; charset=x 5\nhello\n"))
    assert got[0][0]["Content-type"] == "text/html; charset=x" and got[0][1] == b"hello"
    got = list(warc.parse_arc(warc._version_block(2) + b"\nhttp://a/ 1.2.3.4 19990102030405 text/html 200 - - 77 f.arc 3\na\nb\n"))
    assert got[0][0]["Result-code"] == "200" and got[0][0]["Offset"] == "77" and got[0][1] == b"a\nb"
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(warc._version_block(1) + b"\nhttp://a/ 1.2.3.4 19990102030405 text/html 50\nhello\n"))
    assert len(one) > 0


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é" + "y" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(7, "http://a b/", big), (3, "http://c", big), (9, None, big), (4, "", "short"), (5, "u", "short"), (6, "v", None), (8, "w", ""), (3, "http://c", big), (11, "z", "x" * 100), (12, "z", "x" * 100), (13, "z", "x" * 99), (14, "z", "x" * 99), (None, "n", "lone" * 40)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, key string")
    ws = Workspace(spark, "t")
    o = warc.archive_round_trip(df, ws).toPandas()
    assert len(o) == len(rows)
    want = sorted((-1 if r[0] is None else r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert sorted((-1 if pd.isna(r.page_id) else int(r.page_id), r.payload_bytes, r.payload_digest) for r in o.itertuples()) == want
    again = o[o["record_type"] == "revisit"]
    assert sorted(again["page_id"]) == [3, 7, 9, 12] and dict(zip(again["page_id"], again["refers_to"])) == {3: 3, 7: 3, 9: 3, 12: 11}
    assert o[o["record_type"] == "response"]["refers_to"].isna().all()
    assert warc.archive_round_trip(df.where("false"), Workspace(spark, "t")).count() == 0


# ---- 8 token counts


def test_token_counts(spark, table):
    from tokenizers import Tokenizer

    import public_tokenizers

    ws = Workspace(spark, "t")
    cache = ws.folder("cache")
    extra = docs(spark, [(None, "no id, but its text twice", None, None)] * 2 + [(700, "a<|endoftext|>b", None, None), (701, "日本語 　 text\x1c", None, None), (702, "don't  stop\n\n now", None, None), (703, None, None, None)])
    d = table.union(extra)
    o = token_counts.count_tokens(d, "byte_bpe_50k.json", cache, ws, over=50).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    p = d.toPandas()
    want = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for t in p["text"].unique()}
    key = lambda df: sorted(zip(df["doc_id"].fillna(-1).astype(int), df["n_bytes"], df["n_tokens"]))
    p["n_bytes"], p["n_tokens"] = p["text"].map(lambda t: len((t or "").encode())), p["text"].map(want)
    assert key(o) == key(p) and (o["over_limit"] == (o["n_tokens"] > 50)).all()
    stored = token_counts.read_cache(spark, cache)
    n = stored.count()
    assert n == stored.select("content_digest").distinct().count()  # each was encoded once
    assert key(token_counts.count_tokens(d, "byte_bpe_50k.json", cache, ws).toPandas()) == key(p)
    assert token_counts.read_cache(spark, cache).count() == n  # all hits
    # half of the texts were counted by an earlier run, in a cache that the caller names
    mine = ws.folder("mine")
    token_counts.count_tokens(d.where("crc32(coalesce(text, '')) % 2 = 0"), "byte_bpe_50k.json", mine, ws).count()
    before = token_counts.read_cache(spark, mine).count()
    assert key(token_counts.count_tokens(d, "byte_bpe_50k.json", mine, ws).toPandas()) == key(p)
    after = token_counts.read_cache(spark, mine)
    assert 0 < before < n and after.count() == n == after.select("content_digest").distinct().count()
    assert token_counts.count_tokens(d.where("false"), "piece_bpe_32k.model", ws.folder("c"), ws).count() == 0


# ---- 9 decontamination


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1) if n else []:
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[k:k + n]:
                    hit |= set(range(i, i + n))
                    ids |= {name} - {None}
    return len(w), len(hit), sorted(ids)


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ü1"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [("1", text(14)), ("2", text(5)), ("3", None), ("4", ""), ("5", "W1, w2-W3!"), (None, text(11)), ("1b", text(30))]
    items += [items[0]]
    rows = [text(60) for _ in range(12)] + [text(20) + " " + items[0][1].upper() + " " + text(20), items[6][1] + " tail", None, "", "w1 w2", "w1,w2;w3 " * 50, "é" * 5000, text(40) + items[0][1]]
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(rows)])
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    want = [brute_hits(t, items, 10) for t in rows]
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    for block_bytes, keep in ((1 << 20, ["doc_id", "id"]), (60, ["doc_id", "t"]), (60, ["doc_id", "text"])):
        o = dc.find_contamination(d, b, keep, block_bytes=block_bytes, with_matches=True).withColumn("h", n_hit).orderBy("doc_id").toPandas()
        assert [(r.n_words, r.h, sorted(r.items)) for r in o.itertuples()] == want
    best = max((m for m in o["matches"][13] if m["item_id"] == "1b"), key=lambda m: m["words"])
    assert (best["doc_word"], best["words"]) == (0, 30)
    win = dc.Windows(items, 10)
    for most in (12, 17, 40):  # long texts as overlapping pieces
        for (got_n, hits), (n, h, ids) in zip(dc.search_texts(rows, win, 10, shard_words=most), want):
            assert got_n == n and len({d for s, w, _ in hits.tolist() for d in range(s, s + w)}) == h
            assert {win.names[i] for _, w, p in hits.tolist() for i, _ in win.uses(w, p)} - {None} == set(ids)
    assert dc.find_contamination(d, b.where("false"), ["doc_id"]).where("size(spans) > 0").count() == 0
    assert dc.find_contamination(d.where("false"), b, ["doc_id"]).count() == 0


def test_dense_texts_and_large_benchmarks():
    import pickle

    dense = "a b c d e f g h i j " * 200_000  # 4 MB of one-letter words
    win = dc.Windows([("1", "x " + "a b c d e f g h i j k"), ("2", "q r s t u v w x y z")], 10)
    (n, hits), = dc.search_texts([dense], win, 10)
    assert n == 2_000_000 and len(hits) == 200_000 and [win.uses(10, p) for p in set(hits[:, 2].tolist())] == [[(0, 1)]]
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 50_000, 200_000)))
    win = dc.Windows([("1", text)], 10)
    assert len(pickle.dumps(win)) < 8 * len(text)


def test_decontamination_keeps_clashing_columns(spark):
    d = docs(spark, [(1, "a b c", None, None), (2, "x y", None, None)]).withColumn("spans", F.lit("s")).withColumn("_n", F.lit("n")).withColumn("Items", F.lit("i"))
    b = spark.createDataFrame([("1", "a b c")], "item_id string, text string")
    o = dc.find_contamination(d, b, d.columns)
    assert o.columns == [*d.columns, "n_words", "_spans", "_items", "matches"]
    assert [(r["doc_id"], r["spans"], r["_n"], r["Items"], len(r["_spans"])) for r in o.orderBy("doc_id").collect()] == [(1, "s", "n", "i", 1), (2, "s", "n", "i", 0)]


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(1).integers(0, 4, 500)
    sa = dc.suffix_array(ids)
    padded = np.concatenate([ids, np.zeros(27, dtype=int)])
    keys = [tuple(padded[i:i + 27]) for i in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(500))


# ---- 10 quality


def test_quality(spark):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(["plain", "words", "make", "sentences", "here"], 30)) + "." for _ in range(60)]
    bad = ["SPAM!! " * int(rng.integers(5, 40)) for _ in range(60)]
    x = np.array([quality.statistics(t) for t in good + bad])
    y = np.array([1] * 60 + [0] * 60)
    z = np.column_stack([np.ones(120), x])
    model = quality.fit_from_moments({c: z[y == c].T @ z[y == c] for c in (0, 1)})
    s = model.scores(x)
    assert ((s >= 0.5) == y).mean() > 0.97 and ((0 <= s) & (s <= 1)).all()
    # the cached factors give the densities of the definition
    k = quality.QuadraticDiscriminant([np.zeros(2)] * 2, [np.linalg.inv(np.linalg.cholesky(np.diag([4.0, 9.0]))), np.eye(2)], [0.0, 0.0], 0.5)
    assert k.log_odds(np.array([[2.0, 3.0]]))[0] == pytest.approx(-0.5 * 13 + 0.5 * 2)
    assert np.isfinite(quality.statistics("")).all() and len(quality.statistics("")) == quality.N_FEATURES
    assert quality.fit_from_moments({}).scores(x[:2]).tolist() == [0.5, 0.5]
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x)] + [(None, x[0].tolist()), (5, x[0].tolist())], "quality int, x array<double>")
    np.testing.assert_allclose(quality.fit(df).scores(x), s, rtol=1e-6)


def test_quality_against_plain_covariances(spark):
    """Means, shrunk covariances and densities as their definitions have them, row by row."""
    rng = np.random.default_rng(18)
    x = {c: rng.normal(c, 1 + c, size=(40 + 20 * c, 3)) for c in (0, 1)}
    m = quality.fit_from_moments({c: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for c, v in x.items()})
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (40 * cov[0] + 60 * cov[1]) / 100
    probe, odds = rng.normal(size=(20, 3)), []
    for p in probe:
        part = []
        for c in (0, 1):
            lam = 0.15 + 3 / len(x[c])
            s = (1 - lam) * cov[c] + lam * pooled + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.trace(pooled) / 3 * np.eye(3)
            d = p - x[c].mean(axis=0)
            part.append(np.log(len(x[c]) / 100) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * d @ np.linalg.inv(s) @ d)
        odds.append(part[1] - part[0])
    np.testing.assert_allclose(m.log_odds(probe), odds, rtol=1e-8)


def test_quality_query_on_odd_tables(spark, tmp_path):
    rows = [(i, "plain words make sentences here." if i % 2 else "SPAM!! $$$ " * (i % 7 + 1), None, None) for i in range(60)]
    rows += [(60, None, None, None), (61, "", None, None), (62, "x" * 100_000, None, None), rows[0], rows[0], (None, "no id here", None, None)]
    d = docs(spark, rows).withColumn("x", F.lit("clash")).withColumn("quality", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (4, None), (5, 7), (None, 1), (999, 1), (0, 0), (0, 0)], "doc_id bigint, quality int")
    for name, some in (("full", "true"), ("empty", "false")):
        d.where(some).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    o = quality.op10_quality_qda(spark, f"file://{tmp_path}/full").toPandas()
    assert len(o) == len(rows) and o["score"].between(0, 1).all() and ((o["score"] >= 0.5) == (o["predicted"] == 1)).all()
    assert o[o["doc_id"] == 0]["score"].nunique() == 1 and (o["doc_id"] == 0).sum() == 3
    assert o[o["doc_id"].isna()]["held_out"].tolist() == [False]
    want = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(63)}
    assert {int(r.doc_id): r.held_out for r in o.dropna().itertuples()} == want
    assert quality.op10_quality_qda(spark, f"file://{tmp_path}/empty").count() == 0
