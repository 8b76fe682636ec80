"""Language identification.

Character 1- to 3-grams of the lower-cased text are hashed into ``2**bits`` features
and weighted by TF-IDF; a sparse multinomial logistic regression is trained by
follow-the-regularised-leader (per-coordinate rates, elastic net: L1 keeps the
weights sparse, L2 small) and its scores are calibrated by one temperature, of least log
loss against smoothed targets: sure to no more than the held-back rows can vouch for.
What the features cannot tell, because letters were never learned, is given to all
languages alike: a text in an unknown script gets a score near 1 / languages.

Document frequencies cover every learning document.  The weights are fitted, by one task, on
a sample of at most ``max_train_rows`` distinct learning texts, the same number of each
language where there are as many, in the order of a hash; a fifth of it sets the
temperature.  The ``max_languages`` most frequent languages are learned (ties by name).

Defined results: a null text, or one without a letter, is ``und`` with score 0; with
nothing to learn from every document is ``und``; rows with null lang are predicted
but not learned; rows with a null doc_id are not held out, so they teach; repeated rows are
predicted alike and teach once; very long texts are read whole (their n-gram counts are
summed over chunks); an empty table gives no rows; further columns are ignored.
``lang``, ``source`` and ``doc_id`` never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

BITS = 14
MAX_TRAIN_ROWS = 6_000
MAX_LANGUAGES = 1_000
UND = "und"
_CHUNK = 1 << 19  # characters held as arrays at a time
_GROUP = 64  # documents whose dense counts are held at a time
_MIX = np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(c: np.ndarray, bits: int) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of code points; the orders hash apart."""
    shift = np.uint32(32 - bits)
    h1 = (c + np.uint32(1)) * _MIX
    out = [(h1 ^ (h1 >> np.uint32(15))) * _MIX >> shift]
    h = h1
    for n in (1, 2):
        if len(c) > n:
            h = (h[:-1] * np.uint32(31) + c[n:] + np.uint32(n)) * _MIX
            out.append((h ^ (h >> np.uint32(15))) * _MIX >> shift)
    return np.concatenate(out)


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the whole text's hashed n-grams, in bounded memory.

    Chunks overlap by two characters; what the overlap counts twice is taken off.
    """
    dim = 1 << bits
    if len(text) <= _CHUNK:
        return np.bincount(_grams(_codes(text), bits), minlength=dim)
    total = np.zeros(dim, dtype=np.int64)
    for i in range(0, len(text), _CHUNK):
        total += np.bincount(_grams(_codes(text[max(0, i - 2):i + _CHUNK]), bits), minlength=dim)
        if i:
            total -= np.bincount(_grams(_codes(text[i - 2:i]), bits), minlength=dim)
    return total


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


@dataclass
class LanguageModel:
    classes: list[str]
    idf: np.ndarray  # (features,)
    weights: np.ndarray  # (features + 1, classes); the last row is the intercept
    temperature: float
    bits: int = BITS
    known: np.ndarray | None = None  # code points that two learning documents have

    def unknown_share(self, text: str) -> float:
        """The share of the text's letters that were not learned."""
        letters = odd = 0
        for i in range(0, len(text), _CHUNK):
            c, n = np.unique(_codes(text[i:i + _CHUNK]), return_counts=True)
            is_letter = np.array([chr(x).isalpha() for x in c], dtype=bool)
            letters += int(n[is_letter].sum())
            odd += int(n[is_letter & ~np.isin(c, self.known)].sum())
        return odd / letters if letters else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, classes)."""
        p = self.probabilities(np.stack([gram_counts(t, self.bits) for t in texts]))
        if self.known is None:
            return p
        u = np.array([self.unknown_share(t) for t in texts])[:, None]
        return p * (1 - u) + u / len(self.classes)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = (_tfidf(counts, self.idf) @ self.weights[:-1] + self.weights[-1]) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, dim: int, *, alpha=1.0, beta=1.0, l1=1e-4, l2=1e-3, epochs=3, seed=7) -> np.ndarray:
    """FTRL-proximal weights (dim + 1, k) for sparse rows (feature numbers, values)."""
    z = np.zeros((dim + 1, k))
    n = np.zeros((dim + 1, k))
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            idx, val = rows[r]
            idx, val = np.append(idx, dim), np.append(val, 1.0)
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1.0
            g = val[:, None] * p
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g2
    return weight(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Targets are smoothed as the rule of succession has it (one more row seen of each class):
    without errors among the rows the loss would fall for ever as the temperature falls.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    a, b, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequencies(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Feature f: documents with it; -1: documents; -2 - c: documents (2 at most) with code point c."""
        df, n, points = np.zeros(1 << bits, dtype=np.int64), 0, np.zeros(0x110000, dtype=np.int8)
        for batch in batches:
            for t in batch.column("text"):
                text = t.as_py()
                df += gram_counts(text, bits) > 0
                own = np.unique(np.concatenate([np.unique(_codes(text[i:i + _CHUNK])) for i in range(0, len(text), _CHUNK)] or [_codes("")]))
                points[own] = np.minimum(points[own] + 1, 2)
                n += 1
        if n:
            f, c = np.flatnonzero(df), np.flatnonzero(points)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f, [-1], -2 - c])), pa.array(np.concatenate([df[f], [n], points[c]]))], ["feature", "df"]
            )

    return count


def _sparse_counts(bits: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                idx, val = [], []
                for t in batch.column("text"):
                    c = gram_counts(t.as_py(), bits)
                    f = np.flatnonzero(c)
                    idx.append(f.astype(np.uint16 if bits <= 16 else np.uint32).tobytes())
                    val.append(np.log1p(c[f]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["lang", "h", "idx", "val"])

    return features


def training_sample(learn: DataFrame, per_class: dict[str, int], quota: int, bits: int) -> DataFrame:
    """(lang, h, idx, val) of distinct texts: a quarter over the quota of each language, by their hash.

    Cut to the quota in hash order, a text copied without end is one row, and no language
    takes another's room.
    """
    grain = 1 << 30
    level = [F.lit(x) for c, m in per_class.items() for x in (c, min(grain, int(grain * 1.25 * quota / max(1, m))))]
    wanted = F.pmod(F.xxhash64("text"), F.lit(grain)) < F.element_at(F.create_map(*level), F.col("lang"))
    return (
        learn.where(wanted).distinct().withColumn("h", F.xxhash64("text"))
        .mapInArrow(_sparse_counts(bits), "lang string, h bigint, idx binary, val binary")
    )


def in_quota(picked: pd.DataFrame, quota: int) -> pd.DataFrame:
    return picked.sort_values(["h", "lang"], kind="stable").groupby("lang").head(quota)


def fit_sample(picked: pd.DataFrame, idf: np.ndarray, classes: list[str], bits: int) -> tuple[np.ndarray, float]:
    """(weights, temperature) from the sample; a fifth of it is held back for the temperature."""
    dtype = np.uint16 if bits <= 16 else np.uint32
    rows = []
    for i, v in zip(picked["idx"], picked["val"]):
        f = np.frombuffer(i, dtype=dtype)
        x = np.frombuffer(v, dtype=np.float32) * idf[f]
        norm = np.sqrt((x * x).sum())
        rows.append((f, (x / (norm if norm > 0 else 1.0)).astype(np.float32)))
    number = {c: i for i, c in enumerate(classes)}
    y = picked["lang"].map(number).to_numpy()
    held = (picked["h"].to_numpy() >> 32) % 5 == 0
    fit_on = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    w = fit_ftrl([rows[i] for i in fit_on], y[fit_on], len(classes), 1 << bits)
    logits = np.array([rows[i][1] @ w[rows[i][0]] + w[-1] for i in np.flatnonzero(held)]).reshape(-1, len(classes))
    return w, fit_temperature(logits, y[held])


def train(learn: DataFrame, bits: int = BITS, max_train_rows: int = MAX_TRAIN_ROWS, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Model from the columns ``text`` and ``lang`` of ``learn``; None if there is nothing to learn."""
    learn = learn.select("text", "lang").where("text is not null and lang is not null")
    # distinct texts, to 2 per cent: copies do not count, as they are not sampled
    frequent = learn.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    per_class = {r[0]: r[1] for r in frequent.collect()}
    if not per_class:
        return None
    dim, classes = 1 << bits, sorted(per_class)
    df_rows = learn.select("text").mapInArrow(_document_frequencies(bits), "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df, n_docs, known = np.zeros(dim), 1, []  # at most a row for each feature and each code point came
    for f, c in df_rows:
        if f >= 0:
            df[f] = c
        elif f == -1:
            n_docs = c
        elif c > 1:
            known.append(-2 - f)
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    quota = max(1, max_train_rows // len(classes))

    def fit(table: pa.Table) -> pa.Table:
        w, t = fit_sample(in_quota(table.to_pandas(), quota), idf, classes, bits)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "t": pa.array([t], pa.float64())})

    # the sample is bounded, and the task that fits on it can be lost and run again
    fitted = training_sample(learn, per_class, quota, bits).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "w binary, t double").first()
    if fitted is None:
        return None
    return LanguageModel(classes, idf, np.frombuffer(bytes(fitted["w"]), dtype=np.float64).reshape(dim + 1, -1), fitted["t"], bits, np.array(sorted(known), dtype=np.uint32))


def _predictor(model: LanguageModel, n_keep: int, text_at: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                texts = batch.column(text_at)
                ok = np.array(batch.column("_ok").to_pylist(), dtype=bool)
                best, score = [UND] * len(ok), np.zeros(len(ok))
                todo = np.flatnonzero(ok)
                for i in range(0, len(todo), _GROUP):
                    part = todo[i:i + _GROUP]
                    p = model.scores([texts[int(j)].as_py() for j in part])
                    top = p.argmax(axis=1)
                    score[part] = p[np.arange(len(part)), top]
                    for j, t in zip(part, top):
                        best[j] = model.classes[t]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in range(n_keep)), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    [*batch.schema.names[:n_keep], "_lang", "_score"],
                )

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, with the language and its score."""
    if model is None:
        return docs.select(*keep, F.lit(UND).alias(lang), F.lit(0.0).alias(score))
    inner = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)]
    kinds = "".join(f"_k{i} {docs.schema[k].dataType.simpleString()}, " for i, k in enumerate(keep))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_ok")
    # a kept text goes to Python once
    text_at, more = (keep.index("text"), []) if "text" in keep else (len(keep), [F.col("text").alias("_text")])
    found = docs.select(*inner, *more, letter).mapInArrow(_predictor(model, len(keep), text_at), kinds + "_lang string, _score double")
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.col("_lang").alias(lang), F.col("_score").alias(score))


def held_out(modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(4, 2))
    model = train(docs.where("not held_out"))
    return identify(docs, model, ["doc_id", "held_out"])
