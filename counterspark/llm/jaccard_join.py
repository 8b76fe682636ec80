"""N-gram Jaccard self-join by T-occurrence search (DivideSkip) and its components.

A document's set is its distinct word shingles.  Two sets of a and b shingles reach
the threshold only if they share T or more.  For a document, the inverted lists of
all but its T - 1 most common shingles are the short ones: whatever reaches T is on at
least one of them.  Those lists are heap-merged, which counts a candidate's occurrences;
where they and the long lists together can reach T, the long ones are decided by binary
probes in the candidate's sorted set, from the merge's count on and given up as soon as T
is out of reach.

Why the merge's count can be gone on from: short shingles are those up to some place in
one global order.  Of two documents, let s be the one whose short shingles end first.
All of them that the other has are short ones there as well, so the merge has counted
them all, and only the long shingles of s are left to probe.

How it is distributed

* The order comes from a count sketch of all shingles (fixed width, added up over
  all documents); any fixed order gives the same result, so its collisions cost
  time only.
* Equal sets are one class from the start; only classes are joined.
* Inverted lists hold class numbers, sizes and a bitmap of 16 bytes, no sets.  What the merge
  leaves is tested by bitmaps of 64 bytes a class before any set is read.  A list all of whose members are
  in one component is done.  The first searches have one query for each long-standing
  list (a pivot, picked by a hash), which settles groups of near copies in linear
  work; then every class that is left is a query, and brings a few candidates to the test,
  which mostly join its group; those that have more in other components are queries again,
  and bring more, until none has.  All of them are the same search.  Queries with a common list make a pack, and lists reach a pack in
  shards of their members, each bounded, so a hot list is spread over many tasks and no
  pair is dropped.

Components are exact: every pair that could link is either tested or already known to be
in one component.

Defined results: null and empty texts, and texts without words, have 0 shingles and
are their own component; texts with fewer words than a shingle have one, the whole
sequence; repeated rows are copies; rows of one doc_id with different texts are members of
their own (a component is named by the smallest doc_id of its rows); null doc_ids have null
components and link with nothing; texts are read whole, in bounded pieces; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, bitmap_cell, connected_components, hashed_words, joined, lasting, may_contain, slices, small_batches, tasks

WORDS = 5
PERCENT = 80
SKETCH_BITS = 24
SHARD_ENTRIES = 4096  # members of a list that reach a task at once
PACK = 500  # queries of a pack
# In what order the same searches are made; none of these changes the result.
HOT_LIST = 64  # lists beyond it have a pivot
PIVOT_ROUNDS = 8
SHORT_LIST = 64  # lists up to it lose the members that no other member is near enough to in size
OPEN_PER_POSTING = 20  # pairs across components that a posting may be in before pivots are worth a search
WORTH_A_ROUND = 0.5  # share of those pairs that a round may leave
FAN = 4  # candidates, the likeliest, that a query brings to its first test ...
WIDER = 32  # ... and how many times more to each next one, as long as it has more
BITMAP_WORDS = 8

_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (64 bits) of every whole text."""
    raw, begin = joined((t or "").encode("utf-8", "replace") for t in texts)
    starts, _, h = hashed_words(raw, _WORD)
    h = _mix(h)
    first = np.searchsorted(starts, begin)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        w = h[a:b]
        if not len(w):
            out.append(w)
            continue
        n = min(words, len(w))
        s = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i])
        out.append(np.unique(s))
    return out


def required(n_a, n_b, percent: int):
    """Least intersection with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def short_lists(n, percent: int):
    """Shingles of a set of ``n`` (1 or more) whose lists must be merged: all but T - 1 for the smallest T of any partner."""
    return n - -(-percent * n // 100) + 1


def _sketch(words: int, bits: int):
    step = 1 << min(14, bits)

    def pieces(acc: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(acc), step):
            yield pa.RecordBatch.from_arrays([pa.array([i // step]), pa.array([zlib.compress(acc[i:i + step].tobytes(), 1)], pa.binary())], ["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """16-bit counts take half the room of 32; they are handed on before one could overflow."""
        most = (1 << 16) - 1
        acc, room = np.zeros(1 << bits, dtype=np.uint16), 0
        any_rows = False
        for batch in batches:
            for part in slices(batch, "text"):
                any_rows = True
                for s in shingles(part.column("text").to_pylist(), words):
                    cells = (s >> np.uint64(64 - bits)).astype(np.int64)
                    for i in range(0, len(cells), 1 << 15):
                        some = cells[i:i + (1 << 15)]
                        if len(some) > room:
                            room = most - int(acc.max())
                            if len(some) > room:
                                yield from pieces(acc)
                                acc[:], room = 0, most
                        np.add.at(acc, some, 1)
                        room -= len(some)
        if any_rows:
            yield from pieces(acc)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step, dtype=np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint16)
        # two steps an octave: the order needs no more
        level = np.floor(np.log2(total + 1) * 2).clip(0, 63).astype(np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "levels": pa.array([level.tobytes()], pa.binary())})

    return count, add


def commonness(docs: DataFrame, words: int = WORDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Logarithmic commonness of each hash cell, over all documents (2**bits bytes)."""
    count, add = _sketch(words, bits)
    rows = (
        docs.select("text").mapInArrow(count, "part bigint, counts binary")
        .groupBy("part").applyInArrow(add, "part bigint, levels binary").toLocalIterator()  # 2**bits bytes in all
    )
    levels = np.zeros(1 << bits, dtype=np.uint8)
    for part, blob in rows:
        levels[part * len(blob):(part + 1) * len(blob)] = np.frombuffer(blob, dtype=np.uint8)
    return levels


def divide(s: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(short shingles, long shingles, where the short ones end in the global order, 31 bits of it) of a sorted set."""
    if not len(s):
        return s, s, 0
    bits = len(levels).bit_length() - 1
    k = short_lists(len(s), percent)
    order = (levels[s >> np.uint64(64 - bits)].astype(np.int64) << 57) | (s >> np.uint64(7)).astype(np.int64)
    at = np.argpartition(order, k - 1)
    rare = np.zeros(len(s), dtype=bool)
    rare[at[:k]] = True
    return s[rare], s[~rare], int(order[at[k - 1]]) >> 32


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 512 hash cells, as 64-bit words."""
    odd = np.bincount((s & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _profiles(levels, words: int, percent: int):
    """Per document: size, signature and parity bitmap of the set, its short shingles, and where they end in the global order."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, sig, short, last, maps = [], [], [], [], []
                for s in shingles(part.column("text").to_pylist(), words):
                    rare, _, end = divide(s, level, percent)
                    n.append(len(s))
                    sig.append(_signature(s))
                    short.append(rare.view(np.int64))
                    last.append(end)
                    maps.append(parity_bitmap(s))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in short])]).astype(np.int32)
                flat = np.concatenate(short) if short else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(last, pa.int32()),
                     pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(maps)), BITMAP_WORDS).cast(pa.list_(pa.int64()))],
                    ["doc_id", "h", "n", "sig", "short", "last", "bits"],
                )

    return profile


def _sets(levels, words: int, percent: int):
    """The set of each class: its sorted long shingles, then its sorted short ones."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for part in slices(batch, "text"):
                keep, out = [], []
                for i, s in enumerate(shingles(part.column("text").to_pylist(), words)):
                    if _signature(s) == part.column("sig")[i].as_py():  # an id may repeat with another text
                        rare, rest, _ = divide(s, level, percent)
                        keep.append(i)
                        out.append(rest.tobytes() + rare.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["id", "set"])

    return sets


def _present(probe: np.ndarray, among: np.ndarray) -> int:
    """How many of ``probe`` the sorted ``among`` has, by binary search."""
    if not len(among):
        return 0
    at = np.searchsorted(among, probe)
    return int((among[np.minimum(at, len(among) - 1)] == probe).sum())


def probe_long_lists(long_s: np.ndarray, other: tuple[np.ndarray, np.ndarray], count: int, need: int) -> bool:
    """Whether the merge's ``count`` and the long shingles found in the other set (two sorted parts) come to ``need``."""
    step = 64
    for i in range(0, len(long_s), step):
        if count >= need:
            return True
        if count + len(long_s) - i < need:
            return False
        some = long_s[i:i + step]
        count += _present(some, other[0]) + _present(some, other[1])
    return count >= need


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                sets = [np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in ("set_s", "set_o")]
                (long_s, short_s), other = [(x[:len(x) - k], x[len(x) - k:]) for x in sets for k in [short_lists(len(x), percent)]]
                count = batch.column("count")[i].as_py()
                if count < 0:  # the ends of the short lists were too close to tell which is first
                    count = _present(short_s, other[0]) + _present(short_s, other[1])
                keep.append(probe_long_lists(long_s, other, count, required(len(sets[0]), len(sets[1]), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("s").filter(mask), batch.column("o").filter(mask)], ["s", "o"])

    return verify


def merge_short_lists(lists: list[np.ndarray], lowest: int) -> Iterator[tuple[int, int]]:
    """(candidate, occurrences) of the heap merge of sorted id lists, for ``lowest`` occurrences or more."""
    now, n = None, 0
    for x in heapq.merge(*(v.tolist() for v in lists)):
        if x == now:
            n += 1
            continue
        if n >= lowest:
            yield now, n
        now, n = x, 1
    if n >= lowest:
        yield now, n


_ENTRY = ("id", "n", "comp", "last", "b0", "b1")


def _t_occurrence(percent: int, once: bool, fan: int | None):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """All queries (left) of one pack against a shard of the inverted lists (right) of their short shingles.

        A query's lists are heap-merged, and what the merge's count and the long lists, the sizes and
        parity bitmaps of 128 cells leave within reach of T is a candidate.  ``once``: a pair is left to the one with the larger
        number.  ``fan``: a query gives the candidates with the highest counts only, and says
        (column ``more``) if it has others.
        """
        out: list[tuple[int, int, int, int | None]] = []
        right = right.combine_chunks()
        place = {t: i for i, t in enumerate(right.column("t").to_pylist())}
        if left.num_rows and place:
            lists = {c: right.column(f"l_{c}").combine_chunks() for c in _ENTRY}
            offsets = np.concatenate([[0], np.cumsum(lists["id"].value_lengths().to_numpy())])
            flat = {c: lists[c].flatten().to_numpy() for c in lists}
            maps = np.column_stack([flat["b0"], flat["b1"]]).view(np.uint64)
            left = left.combine_chunks()
            own = {c: left.column(c).to_numpy() for c in _ENTRY}
            for k, shared in enumerate(left.column("ts").to_pylist()):
                q, n, comp, last = (int(own[c][k]) for c in ("id", "n", "comp", "last"))
                ranges = [(offsets[place[t]], offsets[place[t] + 1]) for t in set(shared) if t in place]
                if not ranges:
                    continue
                at = np.concatenate([np.arange(x, y) for x, y in ranges])
                ids, first, hits = np.unique(flat["id"][at], return_index=True, return_counts=True)
                at = at[first]
                m, ends = flat["n"][at].astype(np.int64), flat["last"][at]
                need = required(n, m, percent)
                # shingles left to probe: the long ones of the side whose short ones end first
                long_q, long_c = n - short_lists(n, percent), m - short_lists(m, percent)
                left_over = np.where(ends < last, long_c, np.where(ends > last, long_q, np.maximum(n, m)))
                apart = np.bitwise_count(maps[at] ^ np.array([own["b0"][k], own["b1"][k]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                live = (flat["comp"][at] != comp) & (np.minimum(n, m) >= need) & (hits + left_over >= need) & (n + m - apart >= 2 * need) & (ids < q if once else ids != q)
                if not live.any():
                    continue
                about = dict(zip(ids[live].tolist(), ends[live].tolist()))
                keep = ids[live]
                short = [x[np.isin(x, keep)] for x in (flat["id"][x:y] for x, y in ranges)]
                found = list(merge_short_lists([x for x in short if len(x)], 1))
                more = None
                if fan is not None and len(found) > fan:
                    found, more = heapq.nsmallest(fan, found, key=lambda f: (-f[1], f[0])), q
                for c, count in found:
                    if about[c] == last:
                        out.append((min(q, c), max(q, c), -1, more))
                    else:
                        out.append((q, c, count, more) if last < about[c] else (c, q, count, more))
        s, o, count, more = zip(*out) if out else ((), (), (), ())
        return pa.table({"s": pa.array(s, pa.int64()), "o": pa.array(o, pa.int64()), "count": pa.array(count, pa.int32()), "more": pa.array(more, pa.int64())})

    return search


class JaccardJoin:
    """One run over ``docs``; ``components()`` has its result."""

    def __init__(self, docs: DataFrame, ws: Workspace, words: int = WORDS, percent: int = PERCENT, bits: int = SKETCH_BITS,
                 hot_list: int = HOT_LIST, open_per_posting: float = OPEN_PER_POSTING, fan: int = FAN, shard_entries: int = SHARD_ENTRIES):
        self.docs, self.ws, self.words, self.percent = docs, ws, words, percent
        self.hot_list, self.open_per_posting, self.fan, self.shard_entries = hot_list, open_per_posting, fan, shard_entries
        spark = docs.sparkSession
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        with small_batches(spark):
            self.levels = spark.sparkContext.broadcast(commonness(docs, words, bits))  # 2**bits bytes
            self.profiles = ws.stash(
                docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(
                    _profiles(self.levels, words, percent), "doc_id bigint, h bigint, n int, sig binary, short array<bigint>, last int, bits array<bigint>"
                ),
                "profiles",
            )
        some = self.profiles.where("n > 0 and doc_id is not null")
        # the written numbers are the classes' own, whatever their documents are called
        self.classes = ws.stash(some.groupBy("sig").agg(F.min(F.struct("doc_id", "h")).alias("rep")).select("sig", "rep.doc_id", "rep.h", F.monotonically_increasing_id().alias("id")), "classes")

    def _postings(self) -> DataFrame:
        """(t, id, n, last) of the short lists with two members or more."""
        one = self.profiles.select("doc_id", "h", "n", "last", "short", "bits").join(self.classes.select("doc_id", "h", "id"), ["doc_id", "h"])
        one = self.sizes = self.ws.stash(one.dropDuplicates(["doc_id", "h"]).select("id", "n", "bits", "last", "short"), "short_lists")
        postings = one.select("id", "n", "last", F.explode("short").alias("t"))
        shared = postings.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
        return self.ws.stash(postings.join(shared, "t"), "postings")

    def _within_reach(self, pairs: DataFrame) -> DataFrame:
        """The candidates whose sets can be alike by their parity bitmaps: sets differ in at least the cells whose parity differs."""
        side = lambda c: self.sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        both = pairs.join(side("s"), "s").join(side("o"), "o")
        apart = F.aggregate(F.zip_with("bits_s", "bits_o", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
        need = F.expr(f"({self.percent} * (cast(n_s as bigint) + n_o) + {99 + self.percent}) div {100 + self.percent}")
        return both.where(F.col("n_s") + F.col("n_o") - apart >= 2 * need).select("s", "o", "count")

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(id, set) of the classes in ``pairs`` only: the rest of the corpus keeps its text where it is."""
        ids = pairs.select(F.col("s").alias("id")).union(pairs.select(F.col("o").alias("id"))).distinct()
        needed = self.ws.stash(ids.join(self.classes, "id"), "needed")
        text = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        # a bitmap of fixed size stops most other texts before the shuffle
        hit, bitmap = may_contain(needed, "doc_id")
        text = text.withColumn("_p", bitmap_cell(F.col("doc_id"))).where(hit("_p")).drop("_p")
        sets = text.join(needed, ["doc_id", "h"]).select("id", "sig", "text").mapInArrow(_sets(self.levels, self.words, self.percent), "id bigint, set binary")
        sets = self.ws.stash(sets, "sets")
        self.ws.drop(needed)
        bitmap.destroy()
        return sets

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
        both = pairs.join(side("s"), "s").join(side("o"), "o")
        return both.select("s", "o", "count", "set_s", "set_o").mapInArrow(_verifier(self.percent), "s bigint, o bigint")

    def _open(self, live: DataFrame, comp: DataFrame | None) -> tuple[DataFrame, int, float]:
        """The postings of lists with more than one component, with component and list size; their number; and
        the pairs across components that they are in."""
        live = live.select("t", "id", "n", "last")
        if comp is None:
            live = live.withColumn("comp", F.col("id"))
        else:
            live = live.join(comp.select("id", F.col("component_id").alias("_c")), "id", "left").withColumn("comp", F.coalesce("_c", "id")).drop("_c")
        per = live.groupBy("t", "comp").agg(F.count("*").alias("g"))
        square = lambda c: F.col(c).cast("double") * F.col(c)
        lists = per.groupBy("t").agg(F.sum("g").alias("size"), F.sum(square("g")).alias("same"), F.count("*").alias("comps")).where("comps > 1")
        lists = self.ws.stash(lists.select("t", "size", ((square("size") - F.col("same")) / 2).alias("across")), "lists")
        rows, across = lists.agg(F.sum("size"), F.sum("across")).first()
        live = live.join(lists.select("t", "size"), "t")
        # In a short list a member stays only if its neighbour by size is near enough to reach T; no two others can be.
        # (A long list has no window: each of its rows is a group of its own.)
        by_size = Window.partitionBy("t", F.when(F.col("size") > SHORT_LIST, F.col("id"))).orderBy("n")
        n, p = F.col("n").cast("bigint"), self.percent
        near = F.coalesce(F.lag(n).over(by_size) * 100 >= n * p, F.lit(False)) | F.coalesce(n * 100 >= F.lead(n).over(by_size) * p, F.lit(False)) | (F.col("size") > SHORT_LIST)
        live = self.ws.stash(live.withColumn("_near", near).where("_near").drop("_near"), "open")
        self.ws.drop(lists)
        return live, rows or 0, across or 0.0

    def links(self) -> DataFrame | None:
        """(id, component_id) of every class that is linked."""
        with small_batches(self.docs.sparkSession):
            comp = self._links()
        self.levels.destroy()  # whatever is returned reads tables that are written
        return comp

    def _links(self) -> DataFrame | None:
        ws, comp = self.ws, None
        live = self._postings()

        def link(pairs: DataFrame) -> None:
            nonlocal comp
            sets = self._sets_of(pairs)
            edges = self._verify(pairs, sets).select(F.col("s").alias("a"), F.col("o").alias("b"))
            if comp is not None:
                edges = edges.union(comp.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")))
            old, comp = comp, ws.stash(connected_components(ws, edges, "a", "b"), "components")
            ws.drop(sets, *([old] if old is not None else []))

        def settle(found: DataFrame) -> None:
            pairs = ws.stash(self._within_reach(found.select("s", "o", "count").distinct()), "pairs")
            if pairs.take(1):
                link(pairs)
            ws.drop(pairs)

        before = float("inf")
        for turn in range(PIVOT_ROUNDS + 1):
            old, (live, rows, across) = live, self._open(live, comp)
            ws.drop(old)
            if not rows:
                return comp
            if turn == PIVOT_ROUNDS or across <= self.open_per_posting * rows or across > WORTH_A_ROUND * before:
                break
            before = across
            pivot = live.where(F.col("size") > self.hot_list).groupBy("t").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("p"))
            pivot = ws.stash(pivot.select(F.col("p.id").alias("id")).distinct(), "pivots")
            found = self._candidates(live, rows, pivot)
            settle(found)
            ws.drop(pivot, found)
        queries, fan, tested = None, self.fan, None
        while rows:
            found = self._candidates(live, rows, queries, fan)
            settle(found if tested is None else found.join(tested, ["s", "o"], "left_anti"))
            queries = ws.stash(found.where("more is not null").select(F.col("more").alias("id")).distinct(), "queries")
            if not queries.take(1):
                break
            tested = found.select("s", "o") if tested is None else tested.union(found.select("s", "o"))
            fan *= WIDER
            # only the lists of those that have more
            theirs = live.join(queries, "id", "left_semi").select("t").distinct()
            old, (live, rows, _) = live, self._open(live.join(theirs, "t", "left_semi"), comp)
            ws.drop(old)
        return comp

    def _candidates(self, live: DataFrame, rows: int, only: DataFrame | None = None, fan: int | None = None) -> DataFrame:
        """(s, o, count, more): pairs that the merge of the queries' short lists leaves within reach.

        ``only``: the queries.  ``fan``: how many each gives at most; ``more`` has its number if it has others.
        """
        ws = self.ws
        queries = live if only is None else live.join(only, "id", "left_semi")
        longest = live.agg(F.max("size")).first()[0]
        # Queries with the same smallest shingle make a pack, so similar ones read their lists together; a hot pack is cut.
        low = queries.groupBy("id").agg(F.min("t").alias("low"))
        cuts = low.groupBy("low").agg(F.ceil(F.count("*") / F.lit(float(PACK))).alias("cuts"))
        groups = tasks(ws.spark, rows, 20_000)
        cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
        pack = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("low"), F.lit(groups))).otherwise(F.xxhash64("low", cut))
        packs = low.join(cuts, "low").select("id", pack.alias("g"))
        # the bitmap of 512 cells, folded to 128
        fold = lambda i: F.col("bits")[i].bitwiseXOR(F.col("bits")[i + 2]).bitwiseXOR(F.col("bits")[i + 4]).bitwiseXOR(F.col("bits")[i + 6]).alias(f"b{i}")
        maps = self.sizes.select("id", fold(0), fold(1))
        queries = ws.stash(queries.drop("size").join(packs, "id").join(maps, "id"), "packed")
        wanted = queries.select("g", "t").distinct()
        shards = max(1, -(-longest // self.shard_entries))
        members = queries.drop("g") if only is None else live.drop("size").join(wanted.select("t").distinct(), "t", "left_semi").join(maps, "id")
        members = members.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        lists = members.groupBy("t", "shard").agg(F.sort_array(F.collect_list(F.struct(*_ENTRY))).alias("l")).select("t", "shard", *[F.col(f"l.{c}").alias(f"l_{c}") for c in _ENTRY])
        right = wanted.join(lists, "t").select(F.col("g").alias("_g"), F.col("shard").alias("_s"), "t", *[f"l_{c}" for c in _ENTRY])
        # every query meets every shard of its lists; one shard is the rule
        meets = queries.withColumn("shard", F.lit(0)) if shards == 1 else queries.join(lists.select("t", "shard"), "t")
        left = meets.groupBy("g", "shard", *_ENTRY).agg(F.collect_list("t").alias("ts"))
        search = _t_occurrence(self.percent, fan is not None, fan)
        found = ws.stash(left.groupBy("g", "shard").cogroup(right.groupBy("_g", "_s")).applyInArrow(search, "s bigint, o bigint, count int, more bigint"), "candidates")
        ws.drop(queries)
        return found

    def components(self, with_hash: bool = False) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row; also the text's hash ``h`` and the component's ``first`` (doc_id, h)."""
        comp, kind = self.links(), self.kind
        classes = self.classes.select("sig", "id", F.struct("doc_id", "h").alias("rep"))
        if comp is not None:
            linked = classes.join(comp, "id", "left").withColumn("root", F.coalesce("component_id", "id"))
            first = linked.where("component_id is not null").groupBy("root").agg(F.min("rep").alias("_low"))
            classes = linked.join(first, "root", "left").select("sig", F.coalesce("_low", "rep").alias("first"))
        else:
            classes = classes.select("sig", F.col("rep").alias("first"))
        some = self.profiles.where("n > 0 and doc_id is not null").select("doc_id", "h", "n", "sig").join(classes, "sig")
        none = self.profiles.where("n = 0 or doc_id is null").select("doc_id", "h", "n", F.struct("doc_id", "h").alias("first"))
        out = some.select("doc_id", "h", "n", "first").union(none)
        more = [F.col("h"), F.col("first")] if with_hash else []
        return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.col("first.doc_id").cast(kind).alias("component_id"), *more)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return JaccardJoin(docs, lasting(spark, "op5"), words=3, percent=90).components()
