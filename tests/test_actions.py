"""Corporate actions from landed documents to distributions, by hand and with a poisoned future; the uncorrelated universe."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrain.operators import corporate as C
from tapegrain.sources import readers as R

DAY = dt.date.fromisoformat


@pytest.fixture(scope="module")
def actions(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("actions")
    first = {"cash_dividends": [{"id": "1", "symbol": "OLD", "ex_date": "2020-01-06", "rate": 9.0}, {"id": "2", "symbol": "NEW", "ex_date": "2020-02-03", "rate": 0.5, "special": True}],
             "name_changes": [{"id": "n", "process_date": "2020-02-01", "old_symbol": "OLD", "new_symbol": "NEW"}, {"id": "o", "process_date": "2020-03-01", "old_symbol": "ZZ", "new_symbol": "OLD"}]}
    second = {"cash_dividends": [{"id": "1", "symbol": "OLD", "ex_date": "2020-01-06", "rate": 0.25}, {"id": "3", "symbol": "OLD", "ex_date": "2020-03-05", "rate": 7.0}, {"id": "4", "symbol": "NEW", "rate": 1.0}],
              "spin_offs": [{"id": "5", "source_symbol": "NEW", "new_symbol": "KID", "ex_date": "2020-02-10", "new_rate": 1, "source_rate": 4},
                            {"id": "6", "source_symbol": "NEW", "new_symbol": "LOST", "ex_date": "2020-02-12", "new_rate": 1, "source_rate": 4}],
              "cash_mergers": [{"id": "7", "acquiree_symbol": "NEW", "rate": 55.0, "effective_date": "2020-03-12"}, {"id": "8", "acquiree_symbol": "NEW", "rate": 1.0, "effective_date": "2020-06-01"}]}
    for k, doc in enumerate((first, second, {})):
        (path / f"batch-{k}.json").write_text(json.dumps(doc))
    return R.corporate_actions(spark, str(path))


@pytest.fixture(scope="module")
def inputs(spark, actions):
    days = [x.date() for x in pd.bdate_range("2020-01-01", "2020-03-10")]
    fall = DAY("2020-02-12")
    rows = [("NEW", x, (90.0 if x == fall else 100.0), 100.0, 100.0) for x in days]
    bars = spark.createDataFrame(rows, "root string, session date, open double, close double, close_raw double")
    prices = spark.createDataFrame([("KID", DAY("2020-02-10"), 20.0), ("LOST", DAY("2020-02-13"), 9.0)], "symbol string, session date, close_raw double")
    periods = C.symbol_periods(spark.createDataFrame([("NEW",)], "ticker string"), actions.where("kind = 'name_changes'"), "2020-04-01")
    return periods, bars, prices


def test_last_batch_wins(actions):
    got = {(r["kind"], r["id"]): r["rate"] for r in actions.collect()}
    assert got["cash_dividends", "1"] == 0.25 and got["cash_dividends", "2"] == 0.5 and len(got) == 10


def test_distributions_follow_names(actions, inputs):
    got = {(str(r["ex_date"]), r["kind"]): (r["amount_raw"], r["new_symbol"]) for r in C.distributions(actions, *inputs).collect()}
    # the name OLD of March is another company's; the spin-off without a price is the fall overnight
    assert got == {("2020-01-06", "dividend"): (0.25, None), ("2020-02-03", "special"): (0.5, None), ("2020-02-10", "spin_off"): (5.0, "KID"), ("2020-02-12", "spin_off_gap_estimate"): (10.0, "LOST")}
    assert [(r["root"], r["price"]) for r in C.take_out_prices(actions, inputs[0], inputs[1]).collect()] == [("NEW", 55.0)]


def test_misrecorded_splits(spark, actions, inputs):
    splits = spark.createDataFrame([("NEW", DAY("2020-02-11"), "not_split", 1.5), ("NEW", DAY("2020-01-20"), "not_split", 1.5), ("NEW", DAY("2020-01-22"), "split", 2.0)], "root string, ex_date date, state string, observed_ratio double")
    got = [(str(r["ex_date"]), r["amount_raw"]) for r in C.distributions(actions, *inputs, splits).where("kind like 'misrecorded%'").collect()]
    assert got == [("2020-01-20", 0.0)]


def test_later_prices_move_no_earlier_distribution(actions, inputs):
    periods, bars, prices = inputs
    cut = DAY("2020-02-05")
    poison = lambda d: d.withColumns({c: F.when(F.col("session") > cut, F.col(c) * 7 + 3).otherwise(F.col(c)) for c in d.columns if c.startswith(("open", "close"))})
    early = lambda d: sorted(map(tuple, d.where(F.col("ex_date") <= cut).collect()))
    got, want = (early(C.distributions(actions, periods, f(bars), f(prices))) for f in (poison, lambda d: d))
    assert got == want and len(want) == 2


@pytest.mark.parametrize("block", [3, 50])
def test_uncorrelated_against_greedy(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 40))
    series = {f"s{i:02d}": base[i % 12] + rng.normal(size=40) * (0.05 if i % 3 else 3) for i in range(40)}
    held = {s: rng.random(40) < 0.8 for s in series}
    rows = [(DAY("2020-01-01"), s, DAY("2019-01-01") + dt.timedelta(days=int(t)), float(x[t])) for s, x in series.items() for t in range(40) if held[s][t]]
    company = {s: (str(i % 7) if i % 4 == 0 else None) for i, s in enumerate(series)}
    order = list(rng.permutation(list(series)))
    frames = {s: pd.Series(x, range(40))[held[s]] for s, x in series.items()}
    kept = []
    for s in order:
        if company[s] is not None and company[s] in {company[k] for k in kept} or any(frames[s].corr(frames[k]) > 0.9 for k in kept):
            continue
        kept.append(s)
    ranked = spark.createDataFrame([(DAY("2020-01-01"), str(s), i + 1, company[s]) for i, s in enumerate(order)], "rebalance date, symbol string, place bigint, company string")
    returns = spark.createDataFrame(rows, "rebalance date, symbol string, session date, ret double")
    got = C.uncorrelated(ranked, lambda names: returns.join(names, ["rebalance", "symbol"], "left_semi"), 10, 0.9, "company", block).orderBy("pick").collect()
    assert [r["symbol"] for r in got] == [str(k) for k in kept[:10]]


def test_reports_filings_holdings(spark, tmp_path):
    (tmp_path / "cal").mkdir()
    (tmp_path / "cal" / "2020-01-06.json").write_text(json.dumps([{"symbol": "A", "time": "time-pre-market", "fq": "Dec/2019"}, {"symbol": "B", "time": "", "fq": ""}]))
    (tmp_path / "cal" / "2020-01-07.json").write_text(json.dumps([{"symbol": "A", "time": "time-after-hours", "fq": ""}]))
    (tmp_path / "cal" / "2020-01-08.json").write_text("[]")
    got = sorted((r["symbol"], str(r["date"]), r["timing"]) for r in R.report_calendar(spark, str(tmp_path / "cal")).collect())
    assert got == [("A", "2020-01-06", "bmo"), ("A", "2020-01-07", "amc"), ("B", "2020-01-06", "unknown")]
    rows = [("8-K", "2020-01-06", "2020-01-06T12:00:00.000Z", "2.02,9.01"), ("8-K/A", "2020-01-07", "2020-01-07T21:00:00.000Z", "2.02"), ("8-K", "2020-07-08", "2020-07-08T13:30:00.000Z", "2.02"), ("8-K", "2020-07-09", "2020-07-10T01:00:00.000Z", "2.02"),
            ("8-K", "2020-07-13", "2020-07-14T13:00:00.000Z", "2.02"), ("8-K", "2020-07-14", None, "2.02"), ("10-Q", "2020-07-15", "2020-07-15T13:00:00.000Z", "2.02"), ("8-K", "2020-07-16", "2020-07-16T13:00:00.000Z", None), ("8-K", "2010-07-16", "2010-07-16T13:00:00.000Z", "2.02")]
    names = ("form", "filingDate", "acceptanceDateTime", "items")
    (tmp_path / "sub.json").write_text(json.dumps({"cik": 1, "filings": {"recent": {n: [r[i] for r in rows] for i, n in enumerate(names)}}}))
    got = {str(r["date"]): r["timing"] for r in R.result_filings(spark, str(tmp_path / "sub.json"), "2015-01-01").collect()}
    assert got == {"2020-01-06": "bmo", "2020-01-07": "amc", "2020-07-08": "intraday", "2020-07-09": "amc", "2020-07-13": "unknown", "2020-07-14": "unknown"}
    one = "<{p}infoTable><{p}nameOfIssuer> Co </{p}nameOfIssuer><{p}cusip>C1</{p}cusip><{p}value>12</{p}value><{p}shrsOrPrnAmt><{p}sshPrnamt>3</{p}sshPrnamt></{p}shrsOrPrnAmt>{o}</{p}infoTable>"
    doc = lambda p, o="": f"<{p}informationTable xmlns{':' + p[:-1] if p else ''}='urn:x'>{one.format(p=p, o=o)}{one.format(p=p, o='')}</{p}informationTable>"
    docs = spark.createDataFrame([(1, doc("")), (2, doc("ns1:", "<ns1:putCall>Put</ns1:putCall>")), (3, doc("")[:-9]), (4, None)], "doc_id int, xml string")
    got = [tuple(r) for r in R.holdings_xml(docs).orderBy("doc_id").collect()]
    assert got == [(1, "Co", "C1", 12.0, 3.0)] * 2 + [(2, "Co", "C1", 12.0, 3.0)]
    assert sorted(r["doc_id"] for r in R.broken_documents(docs).collect()) == [3, 4]
    m = spark.createDataFrame([("C1", "ZZ"), ("C1", "AA"), ("C2", None)], "cusip string, ticker string")
    assert {r["ticker"] for r in R.with_tickers(R.holdings_xml(docs), m).collect()} == {"AA"}


@pytest.mark.parametrize("tile", [3, 256])
def test_clusters_against_a_loop(spark, monkeypatch, tile):
    from tapegrain.operators import portfolio as P
    monkeypatch.setattr(P, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(4, 60))
    books = {"x": 11, "y": 7, "z": 1}
    series = {f"{b}{i:02d}": base[i % 4] * (-1 if i % 5 == 0 else 1) + rng.normal(size=60) * rng.choice([0.2, 0.8]) for b, n in books.items() for i in range(n)}
    held = spark.createDataFrame([(s[0], s, int(s[1:])) for s in series] + [("x", "unknown", 99)], "book string, symbol string, place int")
    gone = {("x03", 5), ("y01", 7)}  # a session that one name lacks counts for no name of its book
    rows = [(s, DAY("2020-01-01") + dt.timedelta(days=t), float(v)) for s, x in series.items() for t, v in enumerate(x) if (s, t) not in gone]
    got = {(r["leader"], r["symbol"]) for r in P.clusters(held, spark.createDataFrame(rows, "symbol string, session date, ret double"), 0.7).collect()}
    want = set()
    for b in books:
        names = sorted(s for s in series if s[0] == b)
        days = [t for t in range(60) if not any((s, t) in gone for s in names)]
        seen = set()
        for i, a in enumerate(names):
            if a in seen:
                continue
            for c in names[i + 1:]:
                if abs(np.corrcoef(series[a][days], series[c][days])[0, 1]) >= 0.7:
                    want.add((a, c))
                    seen.add(c)
    assert got == want and len(want) > 5
    assert P.clusters(held, spark.createDataFrame(rows[:60], "symbol string, session date, ret double"), 0.7).count() == 0


def test_scenarios_by_hand(spark):
    """Two universes under two rules: a name worth nothing after its end counts where the universe holds it."""
    from tapegrain.operators import evaluation as E
    anchors = [DAY("2020-11-30"), DAY("2020-12-31"), DAY("2021-01-29")]
    price = {"last": {"a": (10.0, 11.0, 12.1), "b": (10.0, 5.0, 5.0), "c": (None, 8.0, 4.0)}, "zero": {"a": (10.0, 11.0, 12.1), "b": (10.0, 5.0, 0.0), "c": (None, 8.0, 4.0)}}
    prices = spark.createDataFrame([(r, s, t, p) for r, by in price.items() for s, ps in by.items() for t, p in zip(anchors, ps)], "rule string, symbol string, anchor date, price double")
    held = spark.createDataFrame([(u, t, s) for u, names in (("all", "abc"), ("living", "a")) for t in anchors for s in names], "universe string, anchor date, symbol string")
    r = E.scenario_returns(held, prices)
    got = {(x["rule"], x["universe"], str(x["until"])): (round(x["ret"], 9), x["n"]) for x in r.collect()}
    assert got == {("last", "all", "2020-12-31"): (-0.2, 2), ("last", "all", "2021-01-29"): (round((0.1 + 0 - 0.5) / 3, 9), 3), ("last", "living", "2020-12-31"): (0.1, 1), ("last", "living", "2021-01-29"): (0.1, 1),
                   ("zero", "all", "2020-12-31"): (-0.2, 2), ("zero", "all", "2021-01-29"): (round((0.1 - 1 - 0.5) / 3, 9), 3), ("zero", "living", "2020-12-31"): (0.1, 1), ("zero", "living", "2021-01-29"): (0.1, 1)}
    y = {(x["rule"], x["year"]): (round(x["all"], 9), round(x["living"], 9)) for x in E.yearly_table(r, ["all", "living"]).collect()}
    assert y["last", 2020] == (-0.2, 0.1) and y["zero", 2021] == (round((0.1 - 1 - 0.5) / 3, 9), 0.1)
    bias = {x["rule"]: x["gap"] for x in E.survivorship_bias(r, {"gap": ("living", "all")}).collect()}
    assert bias["last"] == pytest.approx(1.1 ** 12 - (0.8 * (1 - 0.4 / 3)) ** 6) and bias["zero"] > bias["last"]


def test_uncorrelated_passes_alike_names_in_few_blocks(spark):
    """A run of alike names is passed in blocks that grow, and dates that have their names ask for no returns again."""
    rng = np.random.default_rng(5)
    days = [DAY("2019-01-01") + dt.timedelta(days=t) for t in range(30)]
    x, y, z = rng.normal(size=(3, 30))
    easy, hard = DAY("2020-01-01"), DAY("2020-02-01")
    series = {(hard, f"h{i:03d}"): x for i in range(100)} | {(hard, "h100"): y, (easy, "e000"): x, (easy, "e001"): y, (easy, "e002"): z}
    ranked = spark.createDataFrame([(t, s, int(s[1:]) + 1, None) for t, s in series], "rebalance date, symbol string, place bigint, company string")
    returns = spark.createDataFrame([(t, s, day, float(v)) for (t, s), xs in series.items() for day, v in zip(days, xs)], "rebalance date, symbol string, session date, ret double")
    asked = []

    def some(names):
        asked.append({(r["rebalance"], r["symbol"]) for r in names.collect()})
        return returns.join(names, ["rebalance", "symbol"], "left_semi")

    got = C.uncorrelated(ranked, some, 2, 0.9, "company").collect()
    assert {(r["rebalance"], r["symbol"], r["pick"]) for r in got} == {(easy, "e000", 1), (easy, "e001", 2), (hard, "h000", 1), (hard, "h100", 2)}
    assert len(asked) == 5  # 4, 8, 16, 32 and 64 names; 26 blocks of 4
    assert all(t == hard for names in asked[1:] for t, _ in names)


def test_window_returns_shuffle_only_the_names_asked_for(spark):
    days = [DAY("2020-01-01") + dt.timedelta(days=t) for t in range(0, 80, 2)]
    cal = spark.createDataFrame([(day, i + 1) for i, day in enumerate(days)], "session date, ord bigint")
    close = {(s, day): 1.0 + (s * 7 + i * i) % 11 for s in range(20) for i, day in enumerate(days) if (s + i) % 3}
    bars = spark.createDataFrame([(s, day, v) for (s, day), v in close.items()], "symbol bigint, session date, close double")
    asked = [(t, s) for t in (days[0], days[5], days[16], days[31]) for s in (3, 4, 11)]
    names = spark.createDataFrame(asked + asked[:2], "rebalance date, symbol bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        r = C.window_returns(bars, C.month_starts(cal), cal, 10, names)
        got = {(x["rebalance"], x["symbol"], x["session"]): x["ret"] for x in r.collect()}
        plan = r._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {}
    for t, s in asked:
        if t not in {min(x for x in days if (x.year, x.month) == (t.year, t.month))}:
            continue
        at = days.index(t)
        own = [day for day in days[max(0, at - 10):at] if (s, day) in close]
        want |= {(t, s, b): close[s, b] / close[s, a] - 1 for a, b in zip(own, own[1:])}
    assert got == want and len(want) == 17
    assert "LeftSemi" not in plan  # which came after the widening of all bars, and shuffled them where it was no broadcast
