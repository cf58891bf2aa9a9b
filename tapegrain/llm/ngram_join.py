"""Jaccard join of word n-gram sets by token-combination prefixes.

A token is the hash of an n-gram. All tokens have one order: rare ones first. A document that shares at
least the threshold with a partner loses at most t of its n tokens, so its first tokens hold a signature
in common with that partner: single tokens of the rare class, and pairs of tokens of the frequent class,
for which the prefix is extended by one token (c tokens of a class of k-combinations survive the loss of
c-k of them). Documents that meet in a signature are verified on their whole sets.

Components come first, and for them no group is expanded into all its pairs. Documents with equal sets form a class, joined through one of
them. Members of a signature are compared with its hub, the member that shares most of its signatures (a
star). Where single tokens still leave more than ``CROWD`` components together, they move to the frequent class and their documents are indexed
again: two documents that met in other signatures too have been compared there. Pairs of different
components that are left in a signature are compared unless their parity bitmaps prove them apart (each
token flips one bit, so the bitmaps differ in at most as many bits as the sets in tokens): 512 bits in the
join, then maps as wide as the sets ask for, before whole sets are fetched.

Links come from the components: every link lies inside one, so all pairs of classes of a component are
compared on their whole sets, in tiles of two pieces of at most about PIECE sets and PIECE_TOKENS tokens.
A tile gives the pairs that reach the threshold, or only how many each class has.

Frequent tokens are broadcast: tokens above 1/MAX_FREQUENT of all occurrences, hence at most MAX_FREQUENT.
Null and empty texts have no set and no links. Equal sets link also where the id is null; a null id is
never a component id. Rows that share a doc_id link through it if either text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import components, materialize, only, partitions

WORDS, PERCENT = 5, 80
MAX_FREQUENT = 1 << 22
#: Components a single token may leave together: each member then meets at most so many others.
CROWD = 256
#: A task counts tokens over so many at a time and reports those seen this often.
COUNTED, OFTEN = 1 << 21, 2
SLICE_BYTES = 2 << 20
BITMAP = 8  # words of 64 bits
_MAPS = [f"m{i}" for i in range(BITMAP)]
#: Sets up to this size index single tokens only: too few are sure to stay for a pair.
TINY = 8
#: Sets up to this size index pairs of frequent tokens; larger ones single tokens throughout. Sets
#: between SMALL and SMALL / threshold do both.
SMALL = 256
#: A piece of a component holds about so many sets, or tokens, at most.
PIECE, PIECE_TOKENS = 256, 1 << 21
#: Tokens of a tile that are compared at once.
COLUMNS = 1 << 13
_PAIR = np.uint64(1) << np.uint64(63)
_LARGE = np.uint64(1) << np.uint64(62)


def token_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text, ascending, and n+1 offsets. Fewer than k words make one token."""
    s, e, first = X.words(data, off)
    h = X.span_hashes(data, s, e, X.BYTE_CODE_LOWER)
    at, doc = X.window_starts(first, k)
    token = X.windows(h, k)[at] >> np.uint64(2)
    count = np.diff(first)
    for d in np.flatnonzero((count > 0) & (count < k)):
        token = np.append(token, X.windows(h[first[d]:first[d + 1]], int(count[d])) >> np.uint64(2))
        doc = np.append(doc, d)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(off)))


def fingerprints(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(token + np.uint64(salt)))))
        out.append(X.mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def bitmaps(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit: one row of BITMAP integers for each set."""
    n, width = len(first) - 1, 64 * BITMAP
    at = np.repeat(np.arange(n), np.diff(first)) * width + (token % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * width) & 1).astype(np.uint8).reshape(n, width)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def wide_bitmaps(token: np.ndarray, first: np.ndarray) -> pa.Array:
    """As ``bitmaps``, each as wide as its set asks for: a power of two, four to eight bits a token."""
    n = np.diff(first)
    width = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64), 64)
    edge = np.concatenate(([0], np.cumsum(width)))
    at = np.repeat(edge[:-1], n) + (token & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(edge[-1])) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edge // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _may_link(percent: int):
    """Pairs whose wide bitmaps differ in no more bits than the threshold lets the sets differ in tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y, n) in enumerate(zip(batch.column("x"), batch.column("y"), batch.column("both").to_pylist())):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                if len(x) < len(y):
                    x, y = y, x
                while len(x) > len(y):  # the narrower map is the wider one folded
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                if (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * n:
                    keep.append(i)
            yield batch.select(["a", "a1", "a2", "b", "b1", "b2"]).take(pa.array(keep, pa.int64()))
    return run


def _describe(k: int):
    def seen_often(held: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(held)
        t, seen = np.unique(whole, return_counts=True)
        often = seen >= OFTEN
        t, seen = np.append(t[often].astype(np.int64), -1), np.append(seen[often], len(whole))
        none = pa.nulls(len(t), pa.int64())
        return pa.record_batch({c: none for c in ("doc_id", "n", "c1", "c2", *_MAPS)} | {"wide": pa.nulls(len(t), pa.binary()), "token": pa.array(t), "seen": pa.array(seen, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document; rows for repeated tokens, and under token -1 the number of tokens."""
        held, size = [], 0
        for part in X.slices(batches, limit=SLICE_BYTES):
            token, first = token_sets(*X.text_buffer(part.column("text")), k)
            c1, c2 = fingerprints(token, first)
            maps = bitmaps(token, first)
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n": pa.array(np.diff(first), pa.int64()), "c1": pa.array(c1), "c2": pa.array(c2)} | {m: pa.array(maps[:, i]) for i, m in enumerate(_MAPS)} | {"wide": wide_bitmaps(token, first), "token": none, "seen": none})
            held.append(token)
            size += len(token)
            if size >= COUNTED:
                yield seen_often(held)
                held, size = [], 0
        if held:
            yield seen_often(held)
    return run


class Frequent:
    """Sorted frequent tokens with a bit table before the search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.table = tokens, np.zeros(1 << 22, bool)
        self.table[tokens & np.uint64(len(self.table) - 1)] = True

    def __call__(self, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t), bool)
        if len(self.tokens):
            maybe = np.flatnonzero(self.table[t & np.uint64(len(self.table) - 1)])
            place = np.minimum(np.searchsorted(self.tokens, t[maybe]), len(self.tokens) - 1)
            out[maybe] = self.tokens[place] == t[maybe]
        return out


def signatures(token: np.ndarray, first: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of every set.

    Tiny and large sets index single tokens whatever their class; sets between index pairs of frequent
    ones. A set near a border is in both schemes, so two partners always share one. Signatures of single
    tokens are the token, with bit 62 set for large sets; pairs, and the tokens of tiny sets, have bit 63.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((token, frequent, doc))
    token, frequent = token[order], frequent[order]
    rare = np.bincount(doc[~frequent], minlength=len(n))
    need = n - -(-n * percent // 100) + 1
    take = np.where(n > 0, need, 0)
    tiny, small, large = n <= TINY * 100 // percent, (n > TINY) & (n <= SMALL * 100 // percent), n > SMALL
    count = np.where(tiny, take, 0)
    sig = [X.mix(token[X.ranges(first[:-1], count)] ^ _PAIR) | _PAIR]
    of = [np.repeat(np.arange(len(n)), count)]
    for which, count, flag in ((small, np.minimum(take, rare), np.uint64(0)), (large, take, _LARGE)):
        count = np.where(which, count, 0)
        sig.append(token[X.ranges(first[:-1], count)] | flag)
        of.append(np.repeat(np.arange(len(n)), count))
    for d in np.flatnonzero(small & (take > rare)):
        t = token[first[d] + rare[d]:first[d] + min(int(n[d]), int(take[d]) + 1)]
        i, j = np.triu_indices(len(t), 1)
        sig.append(X.mix(t[i] * np.uint64(0x9E3779B97F4A7C15) + t[j]) | _PAIR)
        of.append(np.full(len(i), d))
    return np.concatenate(sig), np.concatenate(of)


def _index(k: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_frequent = Frequent(frequent)
        for part in X.slices(batches, limit=SLICE_BYTES):
            token, first = token_sets(*X.text_buffer(part.column("text")), k)
            c1, c2 = fingerprints(token, first)
            _, one = np.unique(np.stack((c1, c2)), axis=1, return_index=True)  # one of each class in the slice
            n = np.diff(first)[one]
            token = token[X.ranges(first[:-1][one], n)]
            sig, of = signatures(token, np.concatenate(([0], np.cumsum(n))), is_frequent(token), percent)
            yield pa.record_batch({"sig": sig.astype(np.int64), "cls": c1[one][of]})
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, cls), across batches: the distinct rows of signatures that hold two classes or more."""
    held: tuple | None = None  # last signature, its last class, whether it has been given out
    for batch in batches:
        sig, cls = (batch.column(c).to_numpy() for c in ("sig", "cls"))
        if not len(sig):
            continue
        given = False
        if held is not None:
            given = held[2] and held[0] == sig[0]
            sig, cls = np.append(held[0], sig), np.append(held[1], cls)
        new_sig, new = np.ones(len(sig), bool), np.ones(len(sig), bool)
        new_sig[1:] = sig[1:] != sig[:-1]
        new[1:] = new_sig[1:] | (cls[1:] != cls[:-1])
        if given:
            new[0] = False  # the row carried over is out already
        sig, cls, new_sig = sig[new], cls[new], new_sig[new]
        if not len(sig):
            continue
        many = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        many[1:] |= same
        many[:-1] |= same
        if given:
            many |= sig == held[0]
        held = (sig[-1], cls[-1], bool(many[-1]))
        yield pa.record_batch({"sig": sig[many], "cls": cls[many]})


def _token_bytes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, limit=SLICE_BYTES):
            token, first = token_sets(*X.text_buffer(part.column("text")), k)
            c1, c2 = fingerprints(token, first)
            raw = [token[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
            yield pa.record_batch({"c1": c1, "c2": c2, "tokens": pa.array(raw, pa.binary())})
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).take(pa.array(keep, pa.int64()))
    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives whose whole sets reach the threshold; pairs carry both classes."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = only(docs.select("doc_id", "text"), ids).select("text").mapInArrow(_token_bytes(k), "c1 long, c2 long, tokens binary")
    x = sets.toDF("a1", "a2", "x")
    y = sets.toDF("b1", "b2", "y")
    both = pairs.join(x, ["a1", "a2"]).select("a", "b", "b1", "b2", "x").join(y, ["b1", "b2"]).select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_verify(percent), "a long, b long").distinct(), "links")


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their class, links enough to connect every group, components of the representatives)."""
    spark = docs.sparkSession
    columns = ", ".join(f"{m} long" for m in _MAPS)
    facts = materialize(docs.select("doc_id", "text").mapInArrow(_describe(k), f"doc_id long, n long, c1 long, c2 long, {columns}, wide binary, token long, seen long"), "sets")
    own = facts.where("n is not null").select("doc_id", "n", "c1", "c2")
    classes = facts.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *_MAPS, "wide")]).where("rep is not null")
    classes = materialize(classes, "classes")
    seen = facts.where("token is not null").groupBy("token").agg(F.sum("seen").alias("n"))
    total = seen.where("token = -1").agg(F.sum("n")).first()[0] or 0
    often = seen.where((F.col("token") >= 0) & (F.col("n") > max(16, total // MAX_FREQUENT))).select("token").toArrow()
    frequent = np.sort(often.column("token").to_numpy().astype(np.uint64))

    def index(source: DataFrame) -> DataFrame:
        """Members of every shared signature: (sig, c1, c2, rep, n, hub)."""
        rows = source.select("text").mapInArrow(_index(k, percent, frequent), "sig long, cls long")
        shared = materialize(rows.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "cls").mapInArrow(_shared, "sig long, cls long"), "shared")
        hub = shared.groupBy("cls").agg(F.count("*").alias("hub")).withColumnRenamed("cls", "c1")
        known = classes.select("c1", "c2", "rep", "n").join(hub, "c1").withColumn("hub", F.col("hub") / F.col("n"))
        return materialize(shared.withColumnRenamed("cls", "c1").join(known, "c1"), "members")

    def labelled(member: DataFrame) -> DataFrame:
        if label is None:
            return member.withColumn("comp", F.col("rep"))
        return member.join(label, F.col("rep") == F.col("id"), "left").select(*member.columns, F.coalesce("component_id", "rep").alias("comp"))

    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    links = tested = label = None

    def compare(pairs: DataFrame) -> None:
        """Verify pairs of classes (a, a1, a2, b, b1, b2) not yet compared, and join their components."""
        nonlocal links, tested, label
        x, y = F.struct(F.col("a").alias("r"), F.col("a1").alias("1"), F.col("a2").alias("2")), F.struct(F.col("b").alias("r"), F.col("b1").alias("1"), F.col("b2").alias("2"))
        pairs = pairs.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["p", "q"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        flat = pairs.select(*[F.col(f"{s}.{f}").alias(n + t) for s, n in (("p", "a"), ("q", "b")) for f, t in (("r", ""), ("1", "1"), ("2", "2"))])
        x, y = (classes.select(F.col("c1").alias(f"{t}1"), F.col("c2").alias(f"{t}2"), F.col("wide").alias(w), F.col("n").alias(f"n_{t}")) for t, w in (("a", "x"), ("b", "y")))
        maps = flat.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("a", "a1", "a2", "b", "b1", "b2", "x", "y", (F.col("n_a") + F.col("n_b")).alias("both"))
        flat = materialize(maps.mapInArrow(_may_link(percent), "a long, a1 long, a2 long, b long, b1 long, b2 long"), "may-link")
        new = verified(docs, flat, k, percent)
        links = new if links is None else links.unionByName(new)
        if label is None or not new.isEmpty():
            label = components(links)

    def star(member: DataFrame) -> DataFrame:
        """Compare the members of each signature with its hub; the members with their components afterwards."""
        now = labelled(member)
        pick = F.max_by(F.struct("c1", "c2", "rep", "n", "comp"), F.struct("hub", -F.col("rep"))).alias("h")
        hubs = now.groupBy("sig").agg(pick).select("sig", F.col("h.c1").alias("a1"), F.col("h.c2").alias("a2"), F.col("h.rep").alias("a"), F.col("h.n").alias("n_a"), F.col("h.comp").alias("comp_a"))
        b = now.select("sig", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        compare(b.join(hubs, "sig").where(near & (F.col("comp_a") != F.col("comp_b"))))
        return labelled(member)

    def unresolved(now: DataFrame) -> DataFrame:
        some = now.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.approx_count_distinct("comp").alias("comps"))
        return materialize(some.where("low <> high").select("sig", "comps"), "open")

    member = index(docs)
    open_ = unresolved(star(member))
    crowd = open_.where((F.col("sig") >= 0) & (F.col("comps") > CROWD))
    token = F.col("sig").bitwiseAND(F.lit((1 << 62) - 1)).alias("token")
    more = crowd.select(token, "comps").orderBy(F.desc("comps"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    more = np.setdiff1d(more.column("token").to_numpy().astype(np.uint64), frequent)
    groups = [(member, open_.select("sig"))]
    if len(more):
        # the documents of crowded tokens are indexed again, with those tokens frequent
        moved = crowd.select("sig", token).join(F.broadcast(spark.createDataFrame(pa.table({"token": more.astype(np.int64)}))), "token").select("sig")
        again = only(docs.select("doc_id", "text"), member.join(moved, "sig", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
        frequent = np.union1d(frequent, more)
        then = index(again)
        groups = [(member, open_.join(moved, "sig", "left_anti").select("sig")), (then, unresolved(star(then)).select("sig"))]
    # what is left: pairs of different components that meet in a signature, as narrow rows
    left = [labelled(m.join(sigs, "sig", "left_semi")).select(F.xxhash64("sig", F.lit(i)).alias("s"), "c1", "c2", "rep", F.col("n").cast("int").alias("n"), "comp") for i, (m, sigs) in enumerate(groups)]
    left = left[0] if len(left) == 1 else left[0].unionByName(left[1])
    left = left.join(classes.select("c1", "c2", *_MAPS), ["c1", "c2"]).select("s", "rep", "n", "comp", *_MAPS)
    left = materialize(left, "left")
    a = left.toDF("s", *[f"{c}_a" for c in left.columns[1:]])
    b = left.toDF("s", *[f"{c}_b" for c in left.columns[1:]])
    apart = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _MAPS), F.lit(0))
    # J >= p / 100 means that the sets differ in at most (100 - p) / (100 + p) of the sum of their sizes
    may = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    met = a.join(b, "s").where((F.col("comp_a") < F.col("comp_b")) & near & may).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    x, y = (classes.select(F.col("rep").alias(t), F.col("c1").alias(f"{t}1"), F.col("c2").alias(f"{t}2")) for t in "ab")
    compare(met.join(x, "a").join(y, "b"))
    return own, links, label


def _tile_pairs(token: np.ndarray, first: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets that reach the threshold with it; sets are ascending distinct tokens."""
    n, doc = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, code, seen = np.unique(token, return_inverse=True, return_counts=True)
    shared = seen > 1
    code, doc = code[shared[code]], doc[shared[code]]
    code = (np.cumsum(shared) - 1)[code]
    width = int(shared.sum())
    both = np.zeros((len(n), len(n)), np.int32)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    step = min(COLUMNS, -(-width // 64) * 64) or 64
    for lo in range(0, width, step):
        i, j = np.searchsorted(code, (lo, lo + step))
        held = np.zeros((len(n), step), np.uint8)
        held[doc[i:j], code[i:j] - lo] = 1
        bits = np.packbits(held, axis=1).view(np.uint64)
        for x in range(len(n) - 1):
            both[x, x + 1:] += np.bitwise_count(bits[x + 1:] & bits[x]).sum(axis=1, dtype=np.int32)
    for x in range(len(n) - 1):
        m = both[x, x + 1:].astype(np.int64)
        yield x, x + 1 + np.flatnonzero(100 * m >= percent * (n[x] + n[x + 1:] - m))


def _compare_tile(percent: int, pairs: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        c1, c2, piece = (group.column(c).to_numpy() for c in ("c1", "c2", "piece"))
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens").chunk(0)]
        first = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        a, b = [], []
        for x, ys in _tile_pairs(np.concatenate(raw), first, percent):
            if p != q:
                ys = ys[piece[ys] != piece[x]]
            a.append(np.full(len(ys), x))
            b.append(ys)
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        if pairs:
            return pa.table({"a1": c1[a], "a2": c2[a], "b1": c1[b], "b2": c2[b]})
        degree = np.bincount(np.concatenate((a, b)), minlength=len(c1))
        some = np.flatnonzero(degree)
        return pa.table({"c1": c1[some], "c2": c2[some], "links": degree[some]})
    return run


def _all_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, pairs: bool) -> DataFrame:
    """Links of ``classes`` (c1, c2, rep, n, component_id): (a1, a2, b1, b2), or their number (c1, c2, links)."""
    groups = classes.groupBy("component_id").agg(F.count("*").alias("m"), F.sum("n").alias("t")).where("m > 1")
    pieces = F.ceil(F.greatest(F.col("m") / PIECE, F.col("t") / PIECE_TOKENS)).cast("int").alias("pieces")
    member = materialize(classes.join(groups.select("component_id", pieces), "component_id").select("c1", "c2", "rep", "component_id", "pieces"), "grouped")
    sets = only(docs.select("doc_id", "text"), member.select(F.col("rep").alias("doc_id"))).select("text").mapInArrow(_token_bytes(k), "c1 long, c2 long, tokens binary")
    placed = member.withColumn("piece", F.pmod(F.xxhash64("c1", "c2"), F.col("pieces")).cast("int"))
    held = materialize(sets.dropDuplicates(["c1", "c2"]).join(placed, ["c1", "c2"]), "held")
    tiles = (held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select("component_id", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "c1", "c2", "tokens"))
    schema = "a1 long, a2 long, b1 long, b2 long" if pairs else "c1 long, c2 long, links long"
    found = tiles.groupBy("component_id", "p", "q").applyInArrow(_compare_tile(percent, pairs), schema)
    return found if pairs else found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, classes with representative and component)."""
    own, links, label = linked(docs, k, percent)
    classes = own.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"))
    # a doc_id given to several texts connects their classes
    repeated = materialize(own.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        bridge = own.where("n > 0").join(repeated, "doc_id").join(classes, ["c1", "c2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        label = components(links.unionByName(bridge))
    classes = classes.join(label, F.col("rep") == F.col("id"), "left").select("c1", "c2", "rep", "n", "size", F.coalesce("component_id", "rep").alias("component_id"))
    return own, materialize(classes, "components")


def _rows(own: DataFrame, classes: DataFrame) -> DataFrame:
    linked_rows = own.where("n > 0").join(classes.drop("n"), ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("size").alias("class_size"), "links", "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"), F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_size, links, component_id), a row for each row of ``docs``.

    links counts all other classes that reach the threshold with the document's class; classes of null ids
    only have no links.
    """
    own, classes = _grouped(docs, k, percent)
    degree = _all_links(docs, classes.where("rep is not null"), k, percent, False)
    return _rows(own, classes.join(degree, ["c1", "c2"], "left").withColumn("links", F.coalesce("links", F.lit(0))))


def similar_pairs(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All links (a, b), a < b, between the representatives of classes (the smallest id of equal sets)."""
    classes = _grouped(docs, k, percent)[1].where("rep is not null")
    x, y = (classes.select(F.col("c1").alias(f"{t}1"), F.col("c2").alias(f"{t}2"), F.col("rep").alias(t)) for t in "xy")
    found = _all_links(docs, classes, k, percent, True).toDF("x1", "x2", "y1", "y2").join(x, ["x1", "x2"]).join(y, ["y1", "y2"])
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _copies(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Ids (doc_id, unique in ``docs``) of rows that are not the smallest of their component; components are enough here."""
    own, classes = _grouped(docs, k, percent)
    return own.where("n > 0").join(classes.select("c1", "c2", "component_id"), ["c1", "c2"]).where("doc_id <> component_id").select("doc_id")


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, nulls last.

    Rows are judged by their texts alone, also where ids repeat or are null: two texts of one id that are no copies both
    stay, and of rows with a null id one stays where its group has no id. Rows without words have no copies and stay.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return only(docs, _copies(docs, k, percent), "left_anti")
    # rows numbered in the order of their ids stand in for the ids
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    numbered = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    gone = _copies(numbered.select(F.col("_row").alias("doc_id"), "text"), k, percent)
    return only(numbered, gone, "left_anti", "_row").drop("_row")
