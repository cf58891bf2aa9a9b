"""Language model, language, quality, packing, sharding, token files, neighbours."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tapegrain.llm import language, language_model, neighbours, packing, quality, sharding, token_files, tokens
from tapegrain.llm import textops as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids(rows):
    """Ids of every text from the tokenizer itself."""
    model = tokens.encoder(tokens.vocabulary_path()).model
    return [x.ids for x in model.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def crc(seq):
    return zlib.crc32(np.array(seq, "<u4").tobytes())


def test_encoder_equals_whole_texts(texts):
    odd = ["a  b \n c", "it's don't 'tis", "é é\n\n é  ", " lead", "trail ", "—— w", "1st 2nd3 x-1,y", "　 a 　b", "<|endoftext|> a", "\x85 a\x85b \x1c c", "Ġ hi Ġa", "  \n x"]
    enc = tokens.Encoder(tokens.vocabulary_path())
    want = [x.ids for x in enc.model.encode_batch([t or "" for t in texts + odd], add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        got, first = enc(*X.text_buffer(pa.array(texts + odd, pa.string())))
        assert [got[i:j].tolist() for i, j in zip(first[:-1], first[1:])] == want


def test_language_model(docs, rows, none):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in language_model.score(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        w = tok(r[1])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert any(g["held_out"] == held(r[0]) and g["n_tokens"] == len(w) and g["n_known"] == sum(c[x] > 0 for x in w) and g["train_tokens"] == n and abs(g["base_score"] - base) < 1e-6 and g["score"] < 0 for g in got[r[0]])
    assert language_model.score(none).count() == 0


def test_language_model_in_blocks(docs):
    """A filter read in many blocks leaves nothing out: the same rows as from one block."""
    whole, cut = (Counter(map(tuple, language_model.score(docs, bits).collect())) for bits in (1 << 31, 1 << 10))
    assert cut == whole
    assert language_model.blocks([5, 5, 9, 30, 2, 2], 10) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_filter_counts():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    n = rng.geometric(0.3, len(h))
    edge = np.searchsorted(language_model.bucket_of(h, 4), range(5))
    made = [language_model.stretch(h[i:j], language_model.levels(n[i:j])) for i, j in zip(edge[:-1], edge[1:])]
    f = language_model.Filter(np.concatenate([m[0] for m in made]), [m[1] for m in made])
    got, true = f.count(h), language_model.COUNT_OF[language_model.levels(n)]
    assert (got >= true).all() and (got == true).mean() > 0.85
    assert (f.count(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)) > 0).mean() < 0.12


def test_language_held_out(spark):
    from tapegrain.llm.common import table
    got = language.predict(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.98 and both.score.between(0, 1).all()


def test_language_edges(docs, rows, none):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(docs).collect()}
    by = {r[0]: r[1] for r in rows}
    assert all(p in ("en", "de", "und") and 0 <= s <= 1 for _, p, s in got)
    assert all((p == "und") == (not any(c.isalpha() for c in by[i] or "")) for i, p, _ in got if i is not None)
    assert language.predict(none).count() == 0


def test_code_lengths_are_a_distribution():
    rng = np.random.default_rng(0)
    k = 12
    s = rng.choice(np.arange(1, k - 1), 4000, p=np.arange(1, k - 1) / sum(range(1, k - 1)))
    of_byte = np.full(256, k - 1, np.int32)
    of_byte[:k - 1] = np.arange(k - 1)
    sym, context = language.symbols(s.astype(np.uint8), np.array([0, len(s)]), of_byte, k)
    code, n = np.unique(context.astype(np.int64) * k + sym, return_counts=True)
    tree = language.Tree(code, n, k, 1)
    mass = (2.0 ** -tree.bits.reshape(-1, k).astype(float))[:, 1:].sum(axis=1)
    assert np.allclose(mass, 1, atol=1e-3)


def test_quality(spark):
    from tapegrain.llm.common import table
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = quality.scores(d, table(spark, "/root/testdata/sf0.01", "labels")).toPandas().merge(table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    assert (got[got.held_out].predicted == got[got.held_out].quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 60)] + [(None, 1, 0), (11, None, 0), (12, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in quality.scores(docs, labels.where("quality = 1")).collect()} == {1}
    assert quality.scores(none, labels).count() == 0
    assert quality.accepted(docs, labels.where("quality = 1")).count() == docs.count() and quality.accepted(docs, labels).columns == docs.columns


def test_isotonic():
    assert quality.isotonic(np.array([1, 1, 2, 1]), np.array([0.1, 0.5, 0.2, 0.9])).tolist() == pytest.approx([0.1, 0.3, 0.3, 0.9])


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(docs, rows, ids, capacity):
    got = packing.pack(docs, capacity=capacity).toPandas()
    want = Counter()
    for r, seq in zip(rows, ids):
        seq = [*seq, 2]
        n, head = -(-len(seq) // capacity), len(seq) - capacity * (-(-len(seq) // capacity) - 1)
        cuts = [0, *range(head, len(seq) + 1, capacity)]
        for k in range(n):
            want[(r[0], k, cuts[k], cuts[k + 1] - cuts[k], crc(seq[cuts[k]:cuts[k + 1]]))] += 1
    rows_got = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
    assert Counter(tuple(None if x is None else int(x) for x in r) for r in rows_got.itertuples(index=False)) == want
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all() and order.groupby("sequence_id").length.sum().max() <= capacity
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / capacity) + 2


def test_packing_none(none):
    assert packing.pack(none).count() == 0


def test_bin_completion():
    rng = np.random.default_rng(5)
    for _ in range(5):
        counts = np.bincount(rng.integers(1, 101, 60), minlength=101)
        best = packing.plan(counts, 100)
        used = Counter()
        for sizes, n in best:
            assert sum(sizes) <= 100
            for s in sizes:
                used[s] += n
        assert used == Counter({s: int(n) for s, n in enumerate(counts) if n})
        assert sum(n for _, n in best) <= sum(n for _, n in packing.best_fit(counts, 100))
        assert sum(n for _, n in best) - packing.least_bins(counts, 100) <= 1
    assert packing.dominates((5, 3), (4, 3)) and packing.dominates((7,), (4, 3)) and not packing.dominates((4, 3), (7,))


def test_fillings_of_many_pieces():
    """Short pieces: any number of them share a sequence, and the largest first come in falling order."""
    rng = np.random.default_rng(6)
    for low, high, n, most in ((150, 200, 20_000, 3500), (300, 400, 4000, 1520), (30, 50, 5000, 197)):
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=1025)
        best, used = packing.plan(counts, 1024), np.zeros(1025, np.int64)
        for sizes, k in best:
            assert sum(sizes) <= 1024
            np.add.at(used, list(sizes), k)
        assert (used == counts).all() and packing.least_bins(counts, 1024) <= sum(k for _, k in best) <= most


def test_fillings_against_all_subsets():
    rng = np.random.default_rng(7)
    for _ in range(60):
        counts, room, waste = np.bincount(rng.integers(1, 12, 7), minlength=30), int(rng.integers(5, 25)), int(rng.integers(0, 4))
        subsets = {()}
        for s in np.repeat(np.arange(30), counts).tolist():
            subsets |= {tuple(sorted((*f, s), reverse=True)) for f in subsets if sum(f) + s <= room}
        allowed = max(waste, room - max(map(sum, subsets)))
        fit = {f for f in subsets if room - sum(f) <= allowed}
        got = list(packing.fillings(counts, room, waste, [10**6]))
        assert set(got) <= fit and all(any(g == f or packing.dominates(g, f) for g in got) for f in fit)


def test_sharding(docs, rows, none):
    got = sharding.assign(docs, 7).toPandas()
    n = got.groupby("shard").size()
    assert len(got) == len(rows) and n.max() - n.min() <= 1 and set(got.law) == {"rows"}
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((None if pd.isna(a) else int(a), int(b), int(c)) for a, b, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == want
    assert sharding.assign(none).count() == 0


def test_sharding_keeps_groups_together(spark, docs):
    rows = [(i, f"text {i // 3}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 9).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    split = got.groupby("text").shard.nunique()
    assert split["hot"] <= 5 and (split.drop("hot") > 1).mean() < 0.2 and set(got.groupby("shard").size()) == {100}


def test_token_files(docs, rows, ids, none):
    got = [tuple(r) for r in token_files.round_trip(docs).collect()]
    at, want = 0, []
    for r, seq in sorted(zip(rows, ids), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, x[0][1] or "")):
        want.append((r[0], at, len(seq) + 1, crc([*seq, 0])))
        at += len(seq) + 1
    assert Counter(got) == Counter(want)
    assert token_files.round_trip(none).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 127, 128, 129, 5000):
        v = rng.integers(0, 300, n).astype(np.uint32)
        v[rng.random(n) < 0.05] = rng.integers(0, 2**32, dtype=np.uint64)
        raw = token_files.write_frame(np.array([4, 9]), np.array([n, 0]), v)
        f = token_files.Frame(raw)
        assert np.array_equal(f.ids(), v) and f.doc_ids.tolist() == [4, 9] and f.lengths.tolist() == [n, 0]
        assert np.array_equal(f.ids(n // 3, n // 2), v[n // 3:n // 2])
    with pytest.raises(ValueError):
        token_files.Frame(raw[:50] + bytes([raw[50] ^ 1]) + raw[51:])


def brute_nearest(vectors, every, k):
    good = [(i, np.array(x, float)) for i, x in vectors if i is not None and x is not None and len(x) == 8 and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = {}
            for i, y in good:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float((x * y).sum()))
            out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_neighbours(spark, docs):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    vectors = [(i, (centre[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)]  # ties
    vectors += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3), (None, [1.0] * 8), (2100, [])]
    df = spark.createDataFrame([(i, x, "c") for i, x in vectors], "vec_id long, embedding array<float>, rank string").repartition(3)
    want = brute_nearest(vectors, 20, 20)
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want) and all([x[0] for x in v] == list(range(1, 21)) for v in got.values())
    recall = np.mean([len({x[1] for x in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall > 0.9
    score = dict(vectors)
    assert all(abs(s - float((np.array(score[q], float) * np.array(score[i], float)).sum())) < 1e-12 for q, v in got.items() for _, i, s in v)


def test_neighbours_few(spark, docs):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (0, 3, 3), (20, 1, 0), (20, 2, 1), (20, 3, 3)]
    assert neighbours.nearest(df.limit(0)).count() == 0
