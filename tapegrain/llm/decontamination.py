"""Benchmark passages in training documents: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs of letters and digits; a letter of a script without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) is a
word of its own. First pass: in how many documents each n-gram of the test items occurs. Of the two n-grams in each run
of SEED_WORDS words of an item the rarer that occurs is a seed, so phrases that many documents share are seeds only where
nothing rarer stands beside them, and a copy keeps a seed wherever SEED_WORDS words in a row are intact. Second pass: a seed found
in a document marks a stretch of it; overlapping stretches are one. A stretch that has enough of the item's words at all
is aligned with the item where it stands; nothing of the documents is shuffled. The share of the item that aligns, net of
edits, is the score. Copies without SEED_WORDS intact words in a row (an edit in each four words) have no seed and are not found.

The seed of an item of fewer than SEED_WORDS words is its whole word sequence, so it is found word for word. Items are
broadcast in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words (a longer item is a block of its own), one
after the other, so what is sent stays bounded for any benchmark.

Null and empty texts match nothing, nor do items without words. Equal items are all reported. Rows that share a
doc_id are judged one by one and reported once, by their best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import only

#: Words in a row that a copy must keep, and words of a seed: two seeds lie in each run.
SEED_WORDS, GRAM_WORDS = 4, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score from which a document counts as holding the item: net aligned share of the item's words.
THRESHOLD = 0.5
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Places of items that are worked out at once from the seeds of a slice.
PLACES = 1 << 20
MATCHES = "doc_id long, item_id long, score double, matched int, item_words int, begin long, finish long"


#: Separators and one-letter words beyond ASCII; all of them have a lead byte from 0xE0 on.
_MARKS = r"[\x{2000}-\x{200A}\x{2010}-\x{2029}\x{202F}-\x{205F}\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]+"
_LONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def _loose_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n+1 word offsets."""
    lower = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    data, off = X.text_buffer(lower)
    if len(data) and data.max() >= 0xE0:
        data, off = X.text_buffer(pc.replace_substring_regex(pc.replace_substring_regex(lower, _MARKS, " "), _LONE, r" \1 "))
    s, e, first = X.words(data, off, X.NOT_ALNUM)
    return X.span_hashes(data, s, e), first


class Grams:
    """Position of each hash in a sorted array, with a bit table before the search."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.table = grams, np.zeros(1 << 22, bool)
        self.table[grams & np.uint64(len(self.table) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which): positions of ``h`` that hold a gram, and the gram's number."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.flatnonzero(self.table[h & np.uint64(len(self.table) - 1)])
        which = np.minimum(np.searchsorted(self.grams, h[where]), len(self.grams) - 1)
        true = self.grams[which] == h[where]
        return where[true], which[true]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, matched words, begin and end in the text.

    Smith-Waterman with linear gaps; a row is computed at once, the gap along it by a running maximum.
    Scores carry the start column below and the matched words above it, so no trace is kept.
    """
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0, 0
    col = np.arange(n)
    score = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    hits = np.zeros(n + 1, np.int64)
    best = (0, 0, 0, 0)
    for w in item:
        eq = text == w
        diag = score[:-1] + np.where(eq, MATCH, MISMATCH)
        up = score[1:] + GAP
        take = diag >= up
        cur = np.where(take, diag, up)
        org = np.where(take, origin[:-1], origin[1:])
        hit = np.where(take, hits[:-1] + eq, hits[1:])
        lift = cur - GAP * col  # a gap along the row loses GAP for each column
        top = np.maximum.accumulate(lift)
        src = np.maximum.accumulate(np.where(lift == top, col, 0))
        cur = top + GAP * col
        live = cur > 0
        score = np.concatenate(([0], np.where(live, cur, 0)))
        origin = np.concatenate(([0], np.where(live, org[src], col + 1)))
        hits = np.concatenate(([0], np.where(live, hit[src], 0)))
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(hits[k]), int(origin[k]), k)
    return best


def _frequencies(grams: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Grams(grams), np.zeros(len(grams), np.int64)
        for part in X.slices(batches):
            h, first = _loose_words(part.column("text"))
            at, doc = X.window_starts(first, n)
            where, which = lookup.find(X.windows(h, n)[at])
            pair = np.unique(np.stack((doc[where], which)), axis=1)
            total += np.bincount(pair[1], minlength=len(grams))
        found = np.flatnonzero(total)
        yield pa.record_batch({"gram": found, "n": total[found]})
    return run


def _merged(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of a document and an item, overlapping ones as one."""
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    group = np.ones(len(doc), bool)
    group[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    step = int(hi.max(initial=0)) + 1
    rank = (np.cumsum(group) - 1) * step
    reach = np.maximum.accumulate(hi + rank) - rank  # furthest end so far in the group
    new = group.copy()
    new[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], item[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi


def _stretches(doc: np.ndarray, at: np.ndarray, which: np.ndarray, owner: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Where items may stand, from the seeds found: spans of each (document, item)."""
    begin, items, offsets = owner
    count = np.diff(begin)[which]
    done, parts = 0, []
    ends = np.cumsum(count)
    while done < len(which):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PLACES, side="right")))
        own = slice(done, stop)
        place = X.ranges(begin[:-1][which[own]], count[own])
        d, p = np.repeat(doc[own], count[own]), np.repeat(at[own], count[own]) - offsets[place]
        size = sizes[items[place]]
        slack = size // 2 + 4
        parts.append(_merged(d, items[place], np.maximum(first[d], p - slack), np.minimum(first[d + 1], p + size + slack)))
        done = stop
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if parts:
        for d, item, lo, hi in zip(*(x.tolist() for x in _merged(*(np.concatenate(x) for x in zip(*parts))))):
            out.setdefault((d, item), []).append((lo, hi))
    return out


def _may_hold(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """Whether enough words of the item occur in the text at all; no alignment matches more of them."""
    known = np.sort(text)
    there = int((known[np.minimum(np.searchsorted(known, item), len(known) - 1)] == item).sum()) if len(known) else 0
    return there / len(item) >= threshold


def _search(words: list[np.ndarray], item_ids: list[int], seeds: np.ndarray, owner: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, sizes = Grams(seeds), np.array([len(w) for w in words], np.int64)
        for part in X.slices(batches):
            h, first = _loose_words(part.column("text"))
            at, doc = X.window_starts(first, n)
            where, which = lookup.find(X.windows(h, n)[at])
            stretches = _stretches(doc[where], at[where], which, owner, sizes, first)
            rows: list[list] = [[] for _ in range(7)]
            ids = part.column("doc_id").cast(pa.int64())
            for (d, item), spans in stretches.items():
                size = len(words[item])
                spans = [(lo, hi) for lo, hi in spans if _may_hold(words[item], h[lo:hi], threshold)]
                if not spans:
                    continue
                best = max((align(words[item], h[lo:hi]) + (lo,) for lo, hi in spans), key=lambda x: (x[0], -x[4]))
                share = best[0] / (MATCH * size)
                if share >= threshold:
                    base = best[4] - int(first[d])
                    for out, v in zip(rows, (ids[d].as_py(), item_ids[item], share, best[1], size, base + best[2], base + best[3])):
                        out.append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(rows, kinds)], ["doc_id", "item_id", "score", "matched", "item_words", "begin", "finish"])
    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(words of a seed, item ids, words) block by block through the driver; short items by their number of words."""
    held: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        w, _ = _loose_words(pa.array([row["text"]], pa.string()))
        if not len(w):
            continue
        n = len(w) if len(w) < SEED_WORDS else GRAM_WORDS
        whole = n if len(w) == n else SEED_WORDS  # an item that is one seed has no second one beside it
        ids, words = held.setdefault((n, whole), ([], []))
        if ids and (len(ids) >= BLOCK_ITEMS or sum(map(len, words)) + len(w) > BLOCK_WORDS):
            yield n, ids, words
            ids, words = held[n, whole] = ([], [])
        ids.append(row["item_id"])
        words.append(w)
    for (n, _), (ids, words) in held.items():
        yield n, ids, words


def rare_seeds(df: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which n-grams are seeds, from the documents that hold each and its item, in the items' order.

    Of two neighbours that both occur the rarer one, the first of equally rare ones; one without a neighbour in its item if it occurs.
    """
    out = np.zeros(len(df), bool)
    pair = np.flatnonzero((item[1:] == item[:-1]) & (df[1:] > 0) & (df[:-1] > 0))
    out[np.where(df[pair + 1] < df[pair], pair + 1, pair)] = True
    alone = np.ones(len(df), bool)
    alone[1:] &= item[1:] != item[:-1]
    alone[:-1] &= item[1:] != item[:-1]
    return out | (alone & (df > 0))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, matched, item_words, begin, finish) of documents that hold an item.

    score is the alignment's score over that of a whole copy; begin and finish are word positions in the text.
    """
    source, out = docs.select("doc_id", "text"), None
    for n, ids, words in _blocks(benchmark):
        of = [X.windows(w, n) for w in words]
        grams, place = np.unique(np.concatenate(of), return_inverse=True)
        counts = source.select("text").mapInArrow(_frequencies(grams, n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(grams), np.int64)
        df[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
        item = np.repeat(np.arange(len(of)), [len(g) for g in of])
        offset = X.ranges(np.zeros(len(of), np.int64), np.array([len(g) for g in of], np.int64))
        live = np.flatnonzero(rare_seeds(df[place], item))
        live = live[np.argsort(place[live], kind="stable")]
        order = np.unique(place[live])
        seeds = grams[order]
        owner = (np.searchsorted(place[live], np.append(order, len(grams))), item[live], offset[live])
        if len(order):
            found = source.mapInArrow(_search(words, ids, seeds, owner, n, threshold), MATCHES)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], MATCHES)
    best = F.max_by(F.struct("score", "matched", "item_words", "begin", "finish"), F.struct("score", "matched", -F.col("begin"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null id are kept only if none of them does."""
    return only(docs, matches(docs, benchmark).select("doc_id"), "left_anti")
