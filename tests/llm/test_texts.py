"""Word, window and alignment helpers; substring deduplication, near duplicates, decontamination."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapegrain.llm import decontamination, ngram_join, substring_dedup
from tapegrain.llm import textops as X
from tapegrain.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found(text):
    return WORD.findall(text or "")


def test_words_and_hashes(texts):
    data, off = X.text_buffer(pa.array(texts, pa.string()))
    s, e, first = X.words(data, off)
    raw = data.tobytes()
    assert [raw[i:j].decode() for i, j in zip(s, e)] == [w for t in texts for w in found(t)]
    assert np.diff(first).tolist() == [len(found(t)) for t in texts]
    h = X.span_hashes(data, s, e)
    assert len(set(h.tolist())) == len({w for t in texts for w in found(t)})
    assert X.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


def test_slices_keep_every_row(texts):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    parts = list(X.slices(iter([batch, batch.slice(3, 0)]), limit=500))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 3


def brute_dedup(rows, k):
    first, out = {}, []
    place = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(rows, key=place):
        w = found(r[1])
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, (place(r), i)), (place(r), i))
    for r in rows:
        w, gone = found(r[1]), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (place(r), i):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("k,seed", [(20, 3), (4, 2)])
def test_substring_dedup(docs, rows, k, seed):
    got = substring_dedup.remove_repeats(docs, k, seed, text=False)
    assert Counter(tuple(r) for r in got.collect()) == brute_dedup(rows, k)


def test_substring_dedup_keeps_columns(docs, none):
    got = substring_dedup.remove_repeats(docs)
    assert set(docs.columns) <= set(got.columns) and got.where("n_removed = 0").join(docs.select("doc_id", "text"), ["doc_id", "text"]).count() > 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_exact_ids_survive_equal_hashes():
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    s, e = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    ids = substring_dedup.exact_ids(data, s, e, np.zeros(4, np.uint64), np.ones(4, bool))
    assert ids[0] == ids[2] and len(set(ids.tolist())) == 3


def lower(text):
    return found((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_components(rows, k, percent):
    sets = []
    for r in rows:
        w = lower(r[1])
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            near = a and b and 100 * both >= percent * len(a | b) and (a == b or (rows[i][0] is not None and rows[j][0] is not None))
            if near or (rows[i][0] == rows[j][0] is not None and a and b):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(5, 80), (2, 60)])
def test_near_duplicates(docs, rows, k, percent):
    got = ngram_join.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, k, percent)


def test_all_links(spark, monkeypatch):
    """Every pair of different texts that reaches the threshold is a link, also inside one component."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):  # edits of one text, some of them further apart than the threshold
        w = list(base)
        for at in rng.choice(90, rng.integers(0, 3), replace=False):
            w[at] = f"x{rng.integers(4)}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, "quite another text of its own words"), (102, None)]
    sets = {i: frozenset(tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows if t}
    rep = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    near = {(a, b) for s, a in rep.items() for t, b in rep.items() if a < b and 100 * len(s & t) >= 80 * len(s | t)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PIECE", 8)
    assert {tuple(r) for r in ngram_join.similar_pairs(docs).collect()} == near
    got = {r["doc_id"]: r["links"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: sum(rep[sets[i]] in p for p in near) if i in sets else 0 for i, _ in rows}
    assert len(near) > len(rep)


def test_near_duplicates_none(none, docs):
    assert ngram_join.near_duplicates(none).count() == 0


def plain_groups(texts):
    """For each text the numbers of those linked with it through any chain, by comparing all sets of shingles."""
    sets = []
    for t in texts:
        w = found((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_keep_one_against_all_pairs(docs, rows):
    """One row of each group, whatever its id; ids that repeat and null ids lose no text."""
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got, label = kept.collect(), plain_groups([r[1] for r in rows])
    key = {r[1]: g for r, g in zip(rows, label)}
    has = [r for r in rows if found(r[1])]
    assert Counter(key[r["text"]] for r in got if found(r["text"])) == {key[r[1]]: 1 for r in has}
    least = {g: min((r[0] for r in has if key[r[1]] == g and r[0] is not None), default=None) for g in {key[r[1]] for r in has}}
    assert all(r["doc_id"] == least[key[r["text"]]] for r in got if found(r["text"]))
    assert sum(not found(r["text"]) for r in got) == len(rows) - len(has)


def test_keep_one_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (3, c)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (2, b), (3, c)]


def test_frequent_tokens_index_pairs():
    """Sets of tokens that are mostly frequent share a signature whenever they reach the threshold."""
    rng = np.random.default_rng(2)
    pool = np.arange(60, dtype=np.uint64) * np.uint64(7919) + np.uint64(1)
    for _ in range(200):
        a = np.sort(rng.choice(pool, rng.integers(4, 40), replace=False))
        b = np.sort(np.setdiff1d(np.append(a, pool[rng.integers(60)]), a[rng.integers(len(a)):][:1]))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or len(a) < 4 or len(b) < 4:
            continue
        token, first = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        sig, of = ngram_join.signatures(token, first, token % np.uint64(5) > 0, 80)
        assert set(sig[of == 0]) & set(sig[of == 1])


def test_components_of_a_chain(spark, docs):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == 1000 and got[1000] == 1000


def brute_align(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        score, hits, lo, hi = decontamination.align(a, b)
        assert score == brute_align(a, b) and 0 <= lo <= hi <= len(b) and hits <= min(len(a), len(b))


def test_decontamination(spark, docs, rows, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    edited = " ".join(x if i % 7 else "other" for i, x in enumerate(w))
    cut = " ".join(w[:5] + w[7:])
    more = spark.createDataFrame([(900, f"start {item.upper()}! end"), (901, "lead " + edited + " tail"), (902, cut), (903, " ".join(w[:4]) + " and nothing else of it"), (None, item), (900, "no such thing"), (904, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, "", "c"), (4, "too short", "c"), (5, item, "c")], "item_id long, text string, score string")
    got = decontamination.matches(docs.select("doc_id", "text").unionByName(more), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (900, 901, 902, None) for i in (1, 5)}
    whole = next(r for r in got if r["doc_id"] == 900)
    assert whole["score"] == 1.0 and whole["matched"] == len(w) and whole["finish"] - whole["begin"] == len(w)
    assert decontamination.matches(docs, bench.limit(0)).count() == 0 and decontamination.matches(none, bench).count() == 0
    left = decontamination.clean(docs, spark.createDataFrame([(1, rows[0][1])], "item_id long, text string"))
    assert left.columns == docs.columns and left.count() == sum(r[1] != rows[0][1] for r in rows)


@pytest.mark.parametrize("every", [5, 6])
@pytest.mark.parametrize("size", [20, 30, 60])
def test_decontamination_of_edited_copies(spark, none, size, every):
    """An edit in each 5 or 6 words, at any phase: alone in the corpus, and beside whole copies."""
    w = [f"item{size}word{i}" for i in range(size)]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    copies = [(p, "lead in " + " ".join(f"x{i}" if i % every == p else x for i, x in enumerate(w)) + " tail") for p in range(every)]
    for rows in ([copies[every - 1]], copies + [(90 + i, " ".join(w)) for i in range(3)]):
        got = decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bench).collect()
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}


def test_short_and_unspaced_items(spark):
    """Items shorter than a seed and items of scripts without spaces are found; their parts are not."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "日本語の問題、答えは四です。"), (3, "Solo!"), (4, "one two three"), (5, " ?! ")], "item_id long, text string")
    rows = [(1, "so alpha, BETA gamma it is"), (2, "alpha beta and gamma"), (3, "前置き日本語の問題 答えは四です続き"), (4, "日本語です"), (5, "a solo act"), (6, "one two\u2014three"), (7, None), (8, "soloist")]
    got = decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (5, 3), (6, 4)} and all(r["score"] == 1 for r in got)


def test_rare_seeds():
    """Every run of four words of which both n-grams occur has a seed, the rarer of them; common ones are left out."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        item = np.sort(rng.integers(0, 6, 40))
        df = rng.integers(0, 5, 40)
        seed = decontamination.rare_seeds(df, item)
        for i in range(39):
            if item[i] == item[i + 1] and df[i] and df[i + 1]:
                assert seed[i] or seed[i + 1]
        assert not seed[df == 0].any()
    assert decontamination.rare_seeds(np.array([9, 1, 9, 9, 1, 9]), np.zeros(6, int)).tolist() == [False, True, True, False, True, False]


def plain_loose(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_matches_against_all_alignments(spark):
    """All documents with four words of an item in a row and enough aligned are found, and none that aligns too little."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 60, n)]
    items = [word(n) for n in (6, 9, 15, 25, 40)]
    rows = []
    for d in range(80):
        w = list(items[d % 5])
        for _ in range(d // 10):
            k = int(rng.integers(len(w)))
            w[k:k + 1] = [[], ["edit"], ["edit", w[k]]][int(rng.integers(3))]
            w = w or ["x"]
        rows.append((d, " ".join(word(int(rng.integers(0, 30))) + w + word(int(rng.integers(0, 30))))))
    want, enough = set(), set()
    for d, t in rows:
        text = plain_loose(t)
        runs = {tuple(text[i:i + 4]) for i in range(len(text) - 3)}
        for i, w in enumerate(items):
            code = {x: k for k, x in enumerate(dict.fromkeys(text + w))}
            score = brute_align([code[x] for x in w], [code[x] for x in text])
            if score / (2 * len(w)) >= 0.5:
                enough.add((d, i))
                if any(tuple(w[k:k + 4]) in runs for k in range(len(w) - 3)):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()}
    assert want <= got <= enough and len(want) > 50


def test_decontamination_spans():
    """All seeds of a slice give the spans that a plain loop over them gives; the bound drops no match."""
    rng = np.random.default_rng(3)
    first, sizes = np.array([0, 300, 700]), np.array([20, 9])
    begin, items, offsets = np.array([0, 2, 3, 5]), np.array([0, 1, 1, 0, 0]), np.array([2, 5, 0, 16, 7])
    at = np.sort(rng.choice(690, 12, replace=False))
    doc, which = (at >= 300).astype(int), rng.integers(0, 3, 12)
    covered = {}
    for d, p, g in zip(doc, at, which):
        for j in range(begin[g], begin[g + 1]):
            i, slack = items[j], sizes[items[j]] // 2 + 4
            covered.setdefault((d, i), set()).update(range(max(first[d], p - offsets[j] - slack), min(first[d + 1], p - offsets[j] + sizes[i] + slack)))
    got = decontamination._stretches(doc, at, which, (begin, items, offsets), sizes, first)
    assert {k: {x for lo, hi in v for x in range(lo, hi)} for k, v in got.items()} == covered
    for _ in range(200):
        a, b = rng.integers(0, 9, rng.integers(1, 12)), rng.integers(0, 9, rng.integers(0, 25))
        assert decontamination._may_hold(a, b, 0.5) or decontamination.align(a, b)[0] / (2 * len(a)) < 0.5


def test_buckets_follow_the_bytes(spark, docs, none, monkeypatch):
    """Groups stay small whatever the shuffle partitions; the result does not depend on the number of buckets."""
    from tapegrain.llm import common
    size = docs.agg({"text": "count"}).first()[0] and sum(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    want = Counter(map(tuple, substring_dedup.remove_repeats(docs, text=False).collect()))
    monkeypatch.setattr(common, "BUCKET_BYTES", 4096)
    assert common.buckets_for(docs, 4) == -(-size // 4096) and common.buckets_for(none, 4) == 4
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs, text=False).collect())) == want
