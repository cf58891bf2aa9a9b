"""Language of texts by prediction by partial matching over bytes.

For each language a tree of byte contexts up to three bytes long is counted on a bounded sample of its
labelled documents. The code length of a byte is that of PPM with escape method C and exclusion: from the
longest known context, an escape to the next shorter one costs distinct / (total + distinct), symbols
of longer contexts are left out below, and the uniform code over what remains ends the chain. Statistics
are frozen, so the cost of every (context, byte) is worked out once, and a text's exact code length is a
sum of table entries over all its bytes. The language with the shortest code wins.

Null texts and texts without a letter are ``und`` with score 0, and so are all texts when no document
can be learned from. Ties go to the language first in alphabetical order. The score is the winner's
posterior under equal priors. Further columns, and the labels of the rows predicted, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import crc_mod, materialize

#: Labelled documents learned from, for each language (chosen by a hash of the id); their texts are read whole.
TRAIN_DOCS = 3000
#: Bytes with a symbol of their own; the others share one symbol and a uniform code.
SYMBOLS = 126
#: Contexts kept in a language's tree, most frequent first: bounds what is broadcast.
NODES = 8192
ORDER = 3


def symbols(data: np.ndarray, off: np.ndarray, of_byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte and the code of the three before it; 0 stands before a text."""
    s = of_byte[data]
    context = np.zeros(len(s), np.int32)
    starts = off[:-1][np.diff(off) > 0]
    for back in (3, 2, 1):
        prev = np.zeros(len(s), np.int32)
        prev[back:] = s[:-back] if len(s) > back else 0
        for j in range(back):
            at = starts + j
            prev[at[at < len(s)]] = 0
        context = context * k + prev
    return s, context


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for part in X.slices(batches):
        data, _ = X.text_buffer(part.column("text"))
        total += np.bincount(data, minlength=256)
    yield pa.record_batch({"byte": np.arange(256), "n": total})


def _count(of_byte: np.ndarray, k: int, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            data, off = X.text_buffer(part.column("text"))
            s, context = symbols(data, off, of_byte, k)
            lang = np.repeat(part.column("lang_no").to_numpy(), np.diff(off))
            code, n = np.unique((lang.astype(np.int64) * k ** 3 + context) * k + s, return_counts=True)
            yield pa.record_batch({"code": code, "n": n})
    return run


class Tree:
    """Cost tables of one language: node of each context, and bits of each (node, symbol)."""

    def __init__(self, code: np.ndarray, n: np.ndarray, k: int, others: int, nodes: int = NODES):
        context, sym = code // k, code % k
        levels: list[tuple[np.ndarray, np.ndarray]] = []  # contexts of a level, counts (contexts, k)
        room = nodes
        for order in range(ORDER + 1):
            key, row = np.unique(context % k ** order, return_inverse=True)
            total = np.bincount(row, weights=n)
            keep = np.argsort(-total, kind="stable")[:max(1, room)]
            keep = np.sort(keep[(total[keep] > 1) | (order == 0)])
            room -= len(keep)
            place = np.full(len(key), -1)
            place[keep] = np.arange(len(keep))
            counts = np.zeros((len(keep), k), np.float32)
            ok = place[row] >= 0
            np.add.at(counts, (place[row][ok], sym[ok]), n[ok])
            levels.append((key[keep], counts))
        tables, index, base = [], np.zeros((k,) * ORDER, np.uint16), 0
        for order, (key, counts) in enumerate(levels):
            for key_part in (slice(i, i + 1024) for i in range(0, len(key), 1024)):
                tables.append(self._bits(levels, order, key[key_part], counts[key_part], k, others))
            number = (base + np.arange(len(key))).astype(np.uint16)
            if order == 0:
                index[...] = number[0] if len(number) else 0
            elif order == 1:
                index[:, :, key] = number
            elif order == 2:
                index[:, key // k, key % k] = number
            else:
                index[key // k ** 2, key // k % k, key % k] = number
            base += len(key)
        self.index, self.bits = index.ravel(), np.concatenate(tables).ravel()

    @staticmethod
    def _bits(levels, order: int, key: np.ndarray, counts: np.ndarray, k: int, others: int) -> np.ndarray:
        out = np.full(counts.shape, np.nan, np.float64)
        barred = np.zeros(counts.shape, bool)
        barred[:, 0] = True  # the symbol before a text is never coded
        spent = np.zeros(len(key))
        for level in range(order, -1, -1):
            keys, table = levels[level]
            place = np.minimum(np.searchsorted(keys, key % k ** level), max(len(keys) - 1, 0))
            c = np.where(barred, 0, table[place]) * (keys[place] == key % k ** level)[:, None] if len(keys) else np.zeros(counts.shape)
            total, distinct = c.sum(axis=1), (c > 0).sum(axis=1)
            some = distinct > 0
            whole = np.where(some, total + distinct, 1)
            coded = (c > 0) & np.isnan(out)
            bits = spent[:, None] - np.log2(np.where(c > 0, c, 1) / whole[:, None])
            out = np.where(coded, bits, out)
            spent = spent - np.log2(np.where(some, distinct / whole, 1))
            barred |= c > 0
        left = np.maximum((~barred).sum(axis=1), 1)
        out = np.where(np.isnan(out), (spent + np.log2(left))[:, None], out)
        out[:, k - 1] += np.log2(max(others, 1))
        return out.astype(np.float32)

    def code_lengths(self, s: np.ndarray, context: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
        bits = self.bits[self.index[context].astype(np.int64) * k + s]
        run = np.concatenate(([0.0], np.cumsum(bits, dtype=np.float64)))
        return run[off[1:]] - run[off[:-1]]


class Model:
    def __init__(self, langs: list[str], of_byte: np.ndarray, k: int, trees: list[Tree]):
        self.langs, self.of_byte, self.k, self.trees = langs, of_byte, k, trees

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.trees:
            return ["und"] * len(text), np.zeros(len(text))
        data, off = X.text_buffer(text)
        s, context = symbols(data, off, self.of_byte, self.k)
        bits = np.stack([t.code_lengths(s, context, off, self.k) for t in self.trees])
        best = bits.argmin(axis=0)
        score = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """Learn from labelled rows (lang, text) outside the held-out third."""
    rows = docs.where("lang is not null and text is not null").where(crc_mod("doc_id", 3) != 1).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(256, np.int32), 2, [])
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, max_docs / sizes[lang]) * (1 << 30))))])
    number = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])
    sample = materialize(sample.select(number[F.col("lang")].alias("lang_no"), "text"), "sample")
    hist = sample.select("text").mapInArrow(_histogram, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).orderBy("byte").toArrow().column("n").to_numpy()
    own = np.flatnonzero(hist)
    own = np.sort(own[np.argsort(-hist[own], kind="stable")[:SYMBOLS]])
    k = len(own) + 2
    of_byte = np.full(256, k - 1, np.int32)
    of_byte[own] = np.arange(1, len(own) + 1)
    table = sample.mapInArrow(_count(of_byte, k, langs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    trees = []
    for i in range(len(langs)):
        part = slice(*np.searchsorted(code, [i * k ** 4, (i + 1) * k ** 4]))
        trees.append(Tree(code[part] - i * k ** 4, n[part], k, 256 - len(own)))
    return Model(langs, of_byte, k, trees)


def predict(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, max_docs))  # at most about 8 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, limit=2 << 20):
            lang, score = model.value.predict(part.column("text"))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
