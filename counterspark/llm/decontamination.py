"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards of at most ``SHARD_WORDS`` words and sorts
all suffixes of a shard by their first 27 words (three rounds of triples).  Every
benchmark suffix is then looked up by binary search, which gives all places where its
first ``window`` words stand verbatim; neighbouring hits on one diagonal join to the
longest verbatim matches with their locations.  Documents that are hit can be removed.

Words are compared through 64-bit hashes in the search; every hit is then compared
byte by byte, so no hash collision reaches the result.

The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES`` of text, as arrays over
the block's own bytes; further blocks are further passes over the documents, so its size is
never unbounded in a task.

Defined results: null texts have no words and hit nothing; an item without words
matches nothing; an item shorter than the window is one window of all its words;
an item with a null id hits words but is not listed; repeated items count once; texts
of any length and density are read whole (long ones as overlapping pieces); empty tables give
no rows, or rows without hits; further columns are passed on if asked for, whatever they
are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, hashed_words, joined, slices

WINDOW = 10
SHARD_WORDS = 1 << 20  # with a separator for each piece; suffix_array packs three ranks of 21 bits
BLOCK_BYTES = 16 << 20
_AT_ONCE = 1 << 14  # patterns or hits worked on at a time

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True


class Windows:
    """The distinct windows of a block of benchmark items, by length, as arrays.

    ``by_length[w]``: (first word of each distinct window, all uses' first words grouped by
    window, where each group begins).  About five bytes for each byte of text.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [name for name, _ in items]
        self.raw, begin = joined((t or "").encode("utf-8", "replace") for _, t in items)
        self.starts, self.ends, hashes = hashed_words(self.raw, _WORD)
        first = np.searchsorted(self.starts, begin)
        self.first = first.astype(np.int32)  # of each item's words
        self.words, word = np.unique(hashes, return_inverse=True)
        self.word = word.astype(np.int32)
        size = np.diff(first)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted({min(window, int(n)) for n in size if n}):
            long_enough = size >= w if w == window else size == w
            runs = [np.arange(a, a + n - w + 1, dtype=np.int32) for a, n in zip(first[:-1][long_enough], size[long_enough])]
            at = np.concatenate(runs)
            mixed = np.zeros(len(at), dtype=np.uint64)
            for j in range(w):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[at + j]
            _, lead, group = np.unique(mixed, return_index=True, return_inverse=True)
            lead = at[lead]
            apart = np.zeros(len(at), dtype=bool)  # another window with the same mixed hash
            for j in range(w):
                apart |= self.word[at + j] != self.word[lead[group] + j]
            group[apart] = len(lead) + np.arange(apart.sum())
            lead = np.concatenate([lead, at[apart]])
            order = np.argsort(group, kind="stable")
            begins = np.searchsorted(group[order], np.arange(len(lead) + 1)).astype(np.int32)
            self.by_length[w] = (lead.astype(np.int32), at[order], begins)

    def uses(self, w: int, pattern: int) -> list[tuple[int, int]]:
        """(item, its word) of every use of a window."""
        _, at, begins = self.by_length[w]
        some = at[begins[pattern]:begins[pattern + 1]]
        item = np.searchsorted(self.first, some, side="right") - 1
        return list(zip(item.tolist(), (some - self.first[item]).tolist()))


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of ``ids`` (non-negative, below 2**21; 0 ends a document) sorted by their next 27 values."""
    n = len(ids)
    rank, order = ids.astype(np.int64), None
    for step in (1, 3, 9):
        padded = np.zeros(n + 2 * step, dtype=np.int64)
        padded[:n] = rank
        key = (padded[:n] << 42) | (padded[step:n + step] << 21) | padded[2 * step:]
        order = np.argsort(key)
        ranked = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) + 1
        rank = new
        if rank.max(initial=0) == n:
            break
    return order


def _bound(sa: np.ndarray, padded: np.ndarray, patterns: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every pattern at once: the first suffix not below (or above) it."""
    q, w = patterns.shape
    lo, hi = np.zeros(q, dtype=np.int64), np.full(q, len(sa), dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + np.arange(w)]
        differ = at != patterns
        first = differ.argmax(axis=1)
        same = ~differ.any(axis=1)
        row = np.arange(q)
        below = np.where(same, after, at[row, first] < patterns[row, first])
        go = lo < hi
        lo, hi = np.where(go & below, mid + 1, lo), np.where(go & ~below, mid, hi)
    return lo


class _Text:
    """Words of a run of texts, as arrays."""

    def __init__(self, texts: list[str | None]):
        self.raw, begin = joined((t or "").encode("utf-8", "replace") for t in texts)
        self.starts, self.ends, self.hashes = hashed_words(self.raw, _WORD)
        self.first = np.searchsorted(self.starts, begin)  # number of words before each text

    def same_bytes(self, at: np.ndarray, other: Windows, lead: np.ndarray, w: int) -> np.ndarray:
        """Whether ``w`` words from each of ``at`` are, byte for byte, those from ``lead``."""
        step = np.arange(w)
        mine, theirs = at[:, None] + step, lead[:, None] + step
        size = (self.ends[mine] - self.starts[mine]).astype(np.int64)
        ok = (size == other.ends[theirs] - other.starts[theirs]).all(axis=1)
        mine, theirs, size = mine[ok].ravel(), theirs[ok].ravel(), size[ok].ravel()
        if len(size):
            run = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(run, size)
            equal = self.raw[np.repeat(self.starts[mine], size) + inner] == other.raw[np.repeat(other.starts[theirs], size) + inner]
            ok[ok] = np.logical_and.reduceat(equal, run[::w])
        return ok


def _pieces(first: np.ndarray, window: int, most: int) -> Iterator[list[tuple[int, int]]]:
    """Shards of word runs (from, to): each of at most ``most`` words and separators; long texts overlap by ``window`` - 1 words."""
    shard, held = [], 0
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        while a < b:
            stop = min(b, a + most - 1)
            if shard and held + stop - a + 1 > most:
                yield shard
                shard, held = [], 0
            shard.append((a, stop))
            held += stop - a + 1
            if stop == b:
                break
            a = stop - (window - 1)
    if shard:
        yield shard


def _search_shard(text: _Text, pieces: list[tuple[int, int]], windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, words of the text where hits begin, windows that hit there)."""
    words = np.concatenate([np.arange(a, b) for a, b in pieces])
    vocabulary, inverse = np.unique(text.hashes[words], return_inverse=True)
    # one value 0 after each piece, so no match crosses from one to the next
    sizes = np.array([b - a for a, b in pieces])
    where = np.arange(len(words)) + np.repeat(np.arange(len(pieces)), sizes)
    ids = np.zeros(len(words) + len(pieces), dtype=np.int64)
    ids[where] = inverse + 1
    word_at = np.full(len(ids), -1, dtype=np.int64)
    word_at[where] = words
    place = np.searchsorted(vocabulary, windows.words)
    known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == windows.words
    if not known.any():
        return
    number = np.where(known, place + 1, 0)[windows.word]  # of each benchmark word; 0: not in this shard
    missing = np.concatenate([[0], np.cumsum(number == 0)])
    sa = None
    for w, (lead, _, _) in windows.by_length.items():
        live = np.flatnonzero(missing[lead + w] == missing[lead])
        for i in range(0, len(live), _AT_ONCE):
            if sa is None:
                sa, padded = suffix_array(ids), np.concatenate([ids, np.zeros(32, dtype=ids.dtype)])
            some = live[i:i + _AT_ONCE]
            wanted = number[lead[some][:, None] + np.arange(w)]
            a, b = _bound(sa, padded, wanted, False), _bound(sa, padded, wanted, True)
            n = b - a
            pattern = np.repeat(some, n)
            at = word_at[sa[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]]
            for j in range(0, len(at), _AT_ONCE):
                ok = text.same_bytes(at[j:j + _AT_ONCE], windows, lead[pattern[j:j + _AT_ONCE]], w)
                if ok.any():
                    yield w, at[j:j + _AT_ONCE][ok], pattern[j:j + _AT_ONCE][ok]


def search_texts(texts: list[str | None], windows: Windows, window: int, shard_words: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Per text of any length: its number of words, and hits (first word, words, window), distinct and sorted, as rows."""
    text = _Text(texts)
    found = [np.empty((0, 3), dtype=np.int64)]
    if windows.by_length:
        for pieces in _pieces(text.first, window, shard_words or SHARD_WORDS):
            found += [np.column_stack([at, np.full(len(at), w), pattern]) for w, at, pattern in _search_shard(text, pieces, windows)]
    hits = np.unique(np.concatenate(found), axis=0)  # pieces overlap
    cut = np.searchsorted(hits[:, 0], text.first)
    for t in range(len(texts)):
        yield int(text.first[t + 1] - text.first[t]), hits[cut[t]:cut[t + 1]] - [text.first[t], 0, 0]


def merge_spans(start: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """(start, words) spans, joined where they meet or overlap."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + words)[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), (end[last] - start[new]).tolist()))


def longest_matches(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Hits (document word, words, item, item word) joined along their diagonals."""
    out: list[list[int]] = []
    for d, w, item, at in sorted(hits, key=lambda h: (h[2], h[0] - h[3], h[0])):
        last = out[-1] if out else None
        if last and last[2] == item and last[0] - last[3] == d - at and d <= last[0] + last[1]:
            last[1] = max(last[1], d + w - last[0])
        else:
            out.append([d, w, item, at])
    return [tuple(x) for x in out]


_SPAN = pa.struct([("start", pa.int64()), ("words", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
_ADDED = "_n bigint, _spans array<struct<start: bigint, words: bigint>>, _items array<string>, _matches array<struct<item_id: string, item_word: bigint, doc_word: bigint, words: bigint>>"


def _searcher(windows, window: int, n_keep: int, text_at: int, pass_on: bool, with_matches: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = windows.value
        for whole in batches:
            for batch in slices(whole, text_at):
                earlier = [batch.column(c).to_pylist() for c in ("_spans", "_items", "_matches")]
                ns, spans, items, matches = [], [], [], []
                for k, (n, hits) in enumerate(search_texts(batch.column(text_at).to_pylist(), mine, window)):
                    ns.append(n)
                    old = np.array([(s["start"], s["words"]) for s in earlier[0][k]], dtype=np.int64).reshape(-1, 2)
                    all_spans = np.concatenate([old, hits[:, :2]])
                    spans.append([{"start": s, "words": m} for s, m in merge_spans(all_spans[:, 0], all_spans[:, 1])])
                    names = {mine.names[i] for w, p in np.unique(hits[:, 1:], axis=0).tolist() for i, _ in mine.uses(w, p)}
                    items.append(sorted(names - {None} | set(earlier[1][k])))
                    new = longest_matches([(d, w, i, a) for d, w, p in hits.tolist() for i, a in mine.uses(w, p)]) if with_matches else []
                    matches.append(earlier[2][k] + [{"item_id": mine.names[i], "item_word": a, "doc_word": d, "words": w} for d, w, i, a in new])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in range(n_keep)), *([batch.column("_text")] if pass_on else []),
                     pa.array(ns, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(_MATCH))],
                    [*batch.schema.names[:n_keep], *(["_text"] if pass_on else []), "_n", "_spans", "_items", "_matches"],
                )

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_matches: bool = False) -> DataFrame:
    """Columns ``keep`` and n_words, spans, items, matches for every row of ``docs``.

    ``matches`` (longest verbatim matches, of each item along each diagonal) is empty unless
    asked for: where a word repeats without end in text and item there is one for every shift.
    A kept column with the name of one of the four stands; the result's own then has
    underscores before it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("i", "text"), F.lit(n_blocks))
    kept = "text" in keep  # a kept text goes to Python once
    text_at = keep.index("text") if kept else len(keep)
    now = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], *([] if kept else [F.col("text").alias("_text")]), F.lit(0).cast("bigint").alias("_n"),
        F.expr("cast(array() as array<struct<start: bigint, words: bigint>>)").alias("_spans"),
        F.expr("cast(array() as array<string>)").alias("_items"),
        F.expr("cast(array() as array<struct<item_id: string, item_word: bigint, doc_word: bigint, words: bigint>>)").alias("_matches"),
    )
    kinds = "".join(f"_k{i} {docs.schema[k].dataType.simpleString()}, " for i, k in enumerate(keep))
    for b in range(n_blocks):
        rows = items.where(block == b).collect()  # one bounded block of the query set
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in rows], window))
        more = b + 1 < n_blocks and not kept
        now = now.mapInArrow(_searcher(windows, window, len(keep), text_at, more, with_matches), kinds + ("_text string, " if more else "") + _ADDED)
    return now.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
        *[F.col(c).alias(field(name, keep)) for c, name in (("_n", "n_words"), ("_spans", "spans"), ("_items", "items"), ("_matches", "matches"))],
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
