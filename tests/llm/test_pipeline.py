"""The corpus pipeline over the small tables, stage by stage, and the queries with SQL against DuckDB."""

import os
import re
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_ngram_join", "op5_substring_dedup", "op11_conversation_repair", "op12_chat_formatting"])
def test_against_sql(spark, name):
    import check_queries as Q
    from tapegrain.llm import queries
    ok, msg = Q.compare(spark, Q.duck(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ok, msg


def test_stages(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = [before]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > before / 2
    whole = P.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.select(*whole.columns).collect()))


def without_repeats(rows):
    """Texts less the words of 20-word windows that also start earlier, by a plain scan in the order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k:k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        if not gone or len(gone) < len(w):
            out[i] = text if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_stages_against_plain_versions(spark):
    """What the n-gram join keeps, what substring removal leaves of it, and that no whole test item is left."""
    import corpus_pipeline as P
    from test_texts import plain_groups
    docs = P.filter_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    label, first = plain_groups([t for _, t in rows]), {}
    for (i, t), g in zip(rows, label):
        key = g if (t or "").strip(" \t\n\v\f\r") else ("empty", i)
        first[key] = min(first.get(key, i), i)
    kept = P.drop_near_duplicates(spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert sorted(i for i, _ in got) == sorted(first.values()) and len(got) < len(rows)
    cut = P.cut_repeated_passages(spark, kept, SF)
    left = {r["doc_id"]: r["text"] for r in cut.select("doc_id", "text").collect()}
    assert left == without_repeats(got)
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    items = [f" {plain(r['text'])} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"]: r["text"] for r in P.drop_test_leaks(spark, cut, SF).select("doc_id", "text").collect()}
    whole = {i for i, t in left.items() if any(x in f" {plain(t)} " for x in items)}
    assert whole and not whole & set(clean) and all(clean[i] == left[i] for i in clean) and len(clean) > 0.9 * (len(left) - len(whole))


def test_stages_of_nothing(spark, docs, none):
    import corpus_pipeline as P
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
