"""Text, filings and disclosed trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import text as X
from tapegrain.operators import disclosures as D
from tapegrain.plans.catalog import day, ds, query, rnd, rs

# Word lists fitted to the invented prose of the tables (the market lists hardly occur in it).
POS, NEG = ("the", "and", "is", "est", "der"), ("of", "la", "und", "with")


def _in(ws):
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


SENT = f"""sn AS (SELECT doc_id, source, lang, n_chars, len(list_filter(w, lambda z: z IN {_in(POS)})) AS n_pos, len(list_filter(w, lambda z: z IN {_in(NEG)})) AS n_neg FROM
 (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)),
 sp AS (SELECT *, CASE WHEN n_pos + n_neg = 0 THEN 0 ELSE (n_pos - n_neg) / CAST(n_pos + n_neg AS DOUBLE) END AS polarity, CASE WHEN n_pos + n_neg = 0 THEN 0.05 ELSE least(1, (n_pos + n_neg) / 10.0) END AS confidence FROM sn)"""


def scored_docs(spark, d):
    return X.sentiment(B.table(spark, d, "documents"), "text", POS, NEG)


@query("sca01_lexicon_sentiment", f"WITH {SENT} SELECT doc_id, CAST(n_pos AS INTEGER) AS n_pos, CAST(n_neg AS INTEGER) AS n_neg, {rs('polarity', 6)} AS polarity, {rs('confidence', 6)} AS confidence FROM sp")
def lexicon(spark, d):
    return scored_docs(spark, d).select("doc_id", "n_pos", "n_neg", rnd("polarity", 6).alias("polarity"), rnd("confidence", 6).alias("confidence"))


@query("agg04_weighted_sentiment", f"""WITH {SENT} SELECT source, count(*) AS n, {rs('avg(polarity)', 6)} AS mean_polarity, {rs('sum(polarity * confidence) / nullif(sum(confidence), 0)', 6)} AS weighted,
 {rs('avg(abs(polarity) * confidence)', 6)} AS impact FROM sp GROUP BY 1""")
def weighted_sentiment(spark, d):
    s = scored_docs(spark, d)
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("polarity").alias("m"), (F.sum(F.col("polarity") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("w"),
                                F.avg(F.abs("polarity") * F.col("confidence")).alias("i"))
    return g.select("source", "n", rnd("m", 6).alias("mean_polarity"), rnd("w", 6).alias("weighted"), rnd("i", 6).alias("impact"))


@query("src28_page_bodies", r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS a,
  regexp_extract(html, '<time[^>]+datetime="([^"]+)"', 1) AS pub, html FROM pages),
 b AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN a <> '' THEN a ELSE html END, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS body FROM p)
 SELECT page_id, t AS title, nullif(pub, '') AS published_at, length(body) AS n_chars, md5(body) AS body_md5 FROM b WHERE length(body) >= 500""")
def page_bodies(spark, d):
    from tapegrain.sources.documents import page_bodies as pb
    p = pb(B.table(spark, d, "pages"), 500)
    return p.select("page_id", "title", "published_at", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body_md5"))


@query("sig28_transcript_tone", f"""WITH h AS (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) AS a, substr(text, CAST(length(text) // 2 AS INTEGER) + 1) AS b FROM documents),
 c AS (SELECT doc_id, {', '.join(f"len(list_filter(regexp_extract_all(lower({x}), '[a-z'']+'), lambda z: z IN {_in(ws)})) AS {x}{k}" for x in 'ab' for k, ws in (('p', POS), ('n', NEG)))} FROM h)
 SELECT doc_id, {rs('0.4 * coalesce((ap - an) / nullif(CAST(ap + an AS DOUBLE), 0), 0) + 0.6 * coalesce((bp - bn) / nullif(CAST(bp + bn AS DOUBLE), 0), 0)', 6)} AS tone FROM c""")
def transcript_tone(spark, d):
    """Second half counts more than the first; whole texts."""
    t = B.table(spark, d, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    t = t.withColumns({"_a": F.substring(F.col("text"), F.lit(1), half), "_b": F.substring(F.col("text"), half + 1, F.length("text"))})
    tone = lambda p, n: F.coalesce((p - n) / F.nullif((p + n).cast("double"), F.lit(0.0)), F.lit(0.0))
    return t.select("doc_id", rnd(0.4 * tone(*X.lexicon_counts(F.col("_a"), POS, NEG)) + 0.6 * tone(*X.lexicon_counts(F.col("_b"), POS, NEG)), 6).alias("tone"))


# --- headlines derived from the order lines ------------------------------------------------------

PHRASES = ("beats earnings and raises guidance after", "invests $2 billion in", "reportedly in talks to acquire", "partners with", "launches product against",
           "downgraded after lawsuit by", "signs a big supply deal with", "announced buyout offer for", "praises", "expands capacity near", "trades near", "sources say wins contract over")
PH_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
HEADS = f"""heads AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS id, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS published,
 'Maker ' || l_suppkey || ' ' || {PH_SQL}[l_partkey % 12 + 1] || ' maker ' || (l_partkey * 7 + l_linenumber) % 100 AS title FROM lineitem)"""


def headlines(spark, d):
    li = B.table(spark, d, "lineitem")
    ph = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("l_partkey") % 12 + 1).cast("int"))
    return li.select(F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("int").cast("string")).alias("id"), F.col("l_suppkey").alias("symbol"),
                     F.to_date("l_shipdate").alias("published"),
                     F.concat(F.lit("Maker "), F.col("l_suppkey"), F.lit(" "), ph, F.lit(" maker "), (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 100).alias("title"))


def _has(terms):
    return "(" + " OR ".join(f"contains(t, '{x}')" for x in terms) + ")"


_CAT = "CASE " + " ".join(f"WHEN {_has(ts)}{' AND ' + _has(X.ACQUISITION_WORDS) if n == 'acquisition_target' else ''} THEN '{n}'" for n, ts in X.CATEGORY_TERMS) + " ELSE 'noise' END"
_SUB = f"CASE WHEN {_has(X.RUMOR_TERMS)} THEN 'rumor' WHEN {_has(X.FACT_TERMS)} THEN CASE WHEN {_has(X.OFFICIAL_TERMS)} THEN 'official' ELSE 'confirmed' END WHEN {_has(X.REPORT_TERMS)} THEN 'reported' ELSE 'confirmed' END"


def _map(m, key, default):
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in m.items()) + f" ELSE {default}::DOUBLE END"


CLS = f"""{HEADS}, cl0 AS (SELECT *, lower(title) AS t FROM heads), cl1 AS (SELECT *, {_CAT} AS category, {_SUB} AS substantiation FROM cl0),
 cls AS (SELECT *, CASE WHEN category IN {_in([k for k, v in X.DIRECTIONS.items() if v == 'bearish'])} THEN 'bearish' WHEN category IN {_in([k for k, v in X.DIRECTIONS.items() if v == 'bullish'])} THEN 'bullish' ELSE 'neutral' END AS direction,
  least(1, {_map(X.MATERIALITY_FLOORS, 'category', 0.2)} * {_map(X.SUBSTANTIATION_MULT, 'substantiation', 1.0)}) AS materiality FROM cl1)"""


@query("sca03_headline_category", f"WITH {CLS} SELECT category, direction, substantiation, {rs('materiality', 6)} AS materiality, count(*) AS n FROM cls GROUP BY ALL")
def headline_category(spark, d):
    c = X.classify(headlines(spark, d), "title")
    return c.groupBy("category", "direction", "substantiation", rnd("materiality", 6).alias("materiality")).agg(F.count(F.lit(1)).alias("n"))


@query("sig34_classified_articles", f"WITH {CLS} SELECT id, symbol, category, substantiation FROM cls WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = symbol)")
def classified_articles(spark, d):
    """Only articles without a stored result are classified; here the stored keys are the labelled ids."""
    new = headlines(spark, d).join(B.table(spark, d, "labels").select(F.col("doc_id").alias("symbol")).distinct(), "symbol", "left_anti")
    return X.classify(new, "title").select("id", "symbol", "category", "substantiation")


@query("agg27_catalyst_score", f"""WITH {CLS}, c AS (SELECT *, materiality * CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS con FROM cls)
 SELECT symbol, count(*) AS n_articles, {rs('sum(con) / nullif(sum(materiality), 0)', 6)} AS score, {rs('max(materiality)', 6)} AS max_materiality,
 count(DISTINCT category) AS n_categories, arg_max(title, (abs(con), published, title)) AS lead_title FROM c GROUP BY 1""")
def catalyst_score(spark, d):
    s = X.catalyst_score(X.classify(headlines(spark, d), "title"), "symbol", "published", "title")
    return s.select("symbol", "n_articles", rnd("score", 6).alias("score"), rnd("max_materiality", 6).alias("max_materiality"),
                    F.size("categories").cast("bigint").alias("n_categories"), "lead_title")


TOPICS = list(X.TOPIC_PRIORS)


@query("agg28_topic_signal", f"""WITH a AS (SELECT l_suppkey AS symbol, {'[' + ', '.join(f"'{t}'" for t in TOPICS) + ']'}[l_partkey % 10 + 1] AS topic, l_discount * 10 AS conf, l_tax - 0.04::DOUBLE AS pol FROM lineitem),
 b AS (SELECT *, {_map({k: v[0] for k, v in X.TOPIC_PRIORS.items()}, 'topic', 0.0)} AS s, {_map({k: v[1] for k, v in X.TOPIC_PRIORS.items()}, 'topic', 0.01)} AS m FROM a WHERE conf >= 0.3)
 SELECT symbol, count(*) AS n_articles, {rs('tanh(sum(CASE WHEN abs(s) > 0.01 THEN s WHEN pol > 0 THEN 1 ELSE -1 END * m * conf) * 8)', 6)} AS score FROM b GROUP BY 1""")
def topic_signal(spark, d):
    li = B.table(spark, d, "lineitem")
    a = li.select(F.col("l_suppkey").alias("symbol"), F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("l_partkey") % 10 + 1).cast("int")).alias("topic"),
                  (F.col("l_discount") * 10).alias("conf"), (F.col("l_tax") - 0.04).alias("pol"))
    return X.topic_signal(a, "symbol", "topic", "conf", "pol").select("symbol", "n_articles", rnd("score", 6).alias("score"))


def aliases(spark, d):
    return B.table(spark, d, "supplier").select(F.concat(F.lit("maker "), F.col("s_suppkey")).alias("alias"), F.col("s_suppkey").alias("symbol"))


@query("sca05_entity_mentions", f"""WITH {HEADS} SELECT id, symbol AS first_symbol, CASE WHEN s_suppkey IS NULL THEN 1 ELSE 2 END AS n_mentions,
 coalesce(s_suppkey, symbol) AS last_symbol FROM heads LEFT JOIN supplier ON s_suppkey = CAST(split_part(title, ' maker ', 2) AS BIGINT)""")
def entity_mentions(spark, d):
    m = X.mentions(headlines(spark, d), aliases(spark, d), "id", "title")
    return m.select("id", F.element_at("mentions", 1)["symbol"].alias("first_symbol"), F.size("mentions").cast("bigint").alias("n_mentions"), F.element_at("mentions", -1)["symbol"].alias("last_symbol"))


REL = f"""{HEADS}, r0 AS (SELECT id, published, symbol AS actor, CAST(split_part(title, ' maker ', 2) AS BIGINT) AS target, lower(title) AS t FROM heads),
 r1 AS (SELECT *, CASE WHEN regexp_matches(t, 'invests[^a-z]') THEN 'strategic_investment' WHEN contains(t, 'to acquire') THEN 'acquisition_target' WHEN contains(t, 'partners with') OR contains(t, 'deal with') THEN 'partnership' END AS category, {_SUB} AS sub FROM r0),
 rel AS (SELECT *, least(1, {_map(X.MATERIALITY_FLOORS, 'category', 0.5)} * {_map(X.SUBSTANTIATION_MULT, 'sub', 1.0)}) AS materiality FROM r1 WHERE category IS NOT NULL AND actor <> target AND target IN (SELECT s_suppkey FROM supplier))"""


@query("sca06_relation_triples", f"WITH {REL} SELECT id, actor, target, category, {rs('materiality', 6)} AS materiality FROM rel")
def relation_triples(spark, d):
    h = headlines(spark, d)
    r = X.relations(h, X.mentions(h, aliases(spark, d), "id", "title"), "id", "title")
    return r.select("id", "actor", "target", "category", rnd("materiality", 6).alias("materiality"))


@query("set05_strongest_relation", f"WITH {REL} SELECT target, actor, category, arg_max(id, (materiality, id)) AS id, {rs('max(materiality)', 6)} AS materiality FROM rel GROUP BY 1, 2, 3")
def strongest_relation(spark, d):
    h = headlines(spark, d)
    r = X.relations(h, X.mentions(h, aliases(spark, d), "id", "title"), "id", "title")
    return X.strongest_relation(r, "id").select("target", "actor", "category", "id", rnd("materiality", 6).alias("materiality"))


@query("sca07_conflicts", r"""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Maker ' || l_suppkey || CASE l_partkey % 4 WHEN 0 THEN ' sold its ' WHEN 1 THEN ' said that it was after a very long review dumping ' WHEN 2 THEN ' buy, sell or hold ' ELSE ' keeps ' END || p_name AS title, split_part(p_name, ' ', 2) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'sold' ELSE 'dumping' END AS matched FROM h WHERE l_partkey % 4 IN (0, 1)
  AND abs(instr(lower(title), lower(k)) - instr(lower(title), CASE l_partkey % 4 WHEN 0 THEN 'sold' ELSE 'dumping' END)) <= 28""")
def conflicts(spark, d):
    li, p = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    m = F.col("l_partkey") % 4
    verb = F.when(m == 0, " sold its ").when(m == 1, " said that it was after a very long review dumping ").when(m == 2, " buy, sell or hold ").otherwise(" keeps ")
    h = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("Maker "), F.col("l_suppkey"), verb, F.col("p_name")).alias("title"),
                                                       F.array(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("ks"))
    return X.conflicts(h, "title", "ks").select("l_orderkey", "l_linenumber", "l_partkey", "matched")


# --- disclosures ---------------------------------------------------------------------------------

def disclosure_docs(spark, d):
    """Report texts written from the order lines: owner code, wrapped amounts, labels, page headers."""
    # one shuffle by document serves the join, the texts and the parser's windows; a line becomes eight or nine lines of text
    li = B.spread(B.table(spark, d, "lineitem"), spark, d, "l_orderkey")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    fmt = lambda c: F.date_format(c, "MM/dd/yyyy")
    owner = F.when(F.col("l_linenumber") % 3 == 0, "JT ").when(F.col("l_linenumber") % 3 == 1, "SP ").otherwise("")
    tail = F.concat(F.when(F.col("l_returnflag") == "R", "S (partial) ").otherwise("P "), fmt("o_orderdate"), F.lit(" "), fmt(F.date_add("o_orderdate", 7)),
                    F.lit(" $"), F.format_number(F.floor("l_extendedprice"), 0), F.lit(" - "))
    block = F.concat_ws("\n", F.concat(owner, F.lit("Maker Number "), F.col("l_suppkey")),
                        F.concat(F.lit("Common Stock (M"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(") [ST]")),
                        tail, F.concat(F.lit("$"), F.format_number(F.floor(F.col("l_extendedprice")) * 2, 0)), F.lit("F S: New"), F.lit("Filing ID #1"),
                        F.concat(F.lit("D: Purchased "), F.col("l_quantity").cast("int"), F.lit(" shares")), F.lit("for the account."))
    return j.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("l_linenumber", "l_partkey", "l_extendedprice", block.alias("b")))), lambda z: z["b"]), "\n").alias("text"))


DISC = """disc AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rec, CASE l_linenumber % 3 WHEN 0 THEN 'JT' WHEN 1 THEN 'SP' ELSE '' END AS owner,
  'M' || translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker, 'Maker Number ' || l_suppkey || ' Common Stock' AS asset_name, CASE WHEN l_returnflag = 'R' THEN 'sell_partial' ELSE 'buy' END AS side,
  CAST(o_orderdate AS DATE) AS traded_at, CAST(floor(l_extendedprice) AS BIGINT) AS amount_min, CAST(floor(l_extendedprice) AS BIGINT) * 2 AS amount_max, 'Purchased ' || CAST(l_quantity AS INTEGER) || ' shares for the account.' AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("src22_disclosure_parse", f"WITH {DISC} SELECT doc_id, rec, owner, ticker, asset_name, side, {ds('traded_at')} AS traded_at, amount_min, amount_max, description FROM disc")
def disclosure_parse(spark, d):
    p = D.parse_disclosures(disclosure_docs(spark, d))
    return p.select("doc_id", "rec", "owner", "ticker", "asset_name", "side", day("traded_at").alias("traded_at"), "amount_min", "amount_max", "description")


@query("prj19_trade_query", f"""WITH {B.FILINGS} SELECT issuer, owner, {ds('filed')} AS filed, {rs('value', 2)} AS value FROM fil WHERE code = 'P' AND role = '2-HIGH' AND filed >= DATE '1998-01-01'
 ORDER BY fil.filed DESC, fil.value DESC, issuer, owner LIMIT 100""")
def trade_query(spark, d):
    from tapegrain.sources.queries import disclosed_trades
    t = disclosed_trades(B.filings(spark, d), side="P", role="2-high", since="1998-01-01", limit=100)
    return t.select("issuer", "owner", day("filed").alias("filed"), rnd("value", 2).alias("value"))


ASOF = "DATE '1998-06-30'"


@query("agg30_insider_signal", f"""WITH {B.FILINGS}, w AS (SELECT *, {ASOF} - filed AS age FROM fil WHERE {ASOF} - filed BETWEEN 0 AND 90),
 g AS (SELECT issuer, count(*) FILTER (code = 'P') AS nb, count(*) FILTER (code = 'S') AS ns, sum(CASE WHEN code = 'P' THEN value ELSE -value END) AS nv, count(DISTINCT owner) FILTER (code = 'P' AND age <= 30) AS b30,
  count(DISTINCT owner) FILTER (code = 'S' AND age <= 30) AS s30 FROM w GROUP BY 1),
 h AS (SELECT *, greatest(-1, least(1, 0.6 * (nb - ns) / (nb + ns) + 0.4 * tanh(nv / 5000000.0))) AS raw FROM g),
 k AS (SELECT *, CASE WHEN b30 >= 3 AND raw > 0 THEN least(0.3, 0.1 * (b30 - 2)) WHEN s30 >= 4 AND raw < 0 THEN -least(0.2, 0.05 * (s30 - 3)) ELSE 0 END AS bonus FROM h)
 SELECT issuer, nb AS n_buys, ns AS n_sells, b30 AS buyers_30d, {rs('nv', 2)} AS net_value, {rs('greatest(-1, least(1, raw + bonus))', 6)} AS score FROM k""")
def insider_signal(spark, d):
    s = D.insider_signal(B.filings(spark, d), F.lit("1998-06-30").cast("date"))
    return s.select("issuer", "n_buys", "n_sells", F.col("buyers_30d").cast("bigint").alias("buyers_30d"), rnd("net_value", 2).alias("net_value"), rnd("score", 6).alias("score"))


@query("agg31_political_signal", f"""WITH {B.FILINGS}, p AS (SELECT issuer, owner, sum(CASE WHEN code = 'P' THEN 1 ELSE -1 END * CASE WHEN owner = 7 THEN 2 ELSE 1 END * value) AS net, count(*) FILTER (code = 'P') AS b, count(*) AS n
  FROM fil WHERE {ASOF} - trade_date BETWEEN 0 AND 180 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY abs(net) DESC, owner) AS rn FROM p)
 SELECT issuer, CAST(sum(b) AS BIGINT) AS n_buys, CAST(sum(n) - sum(b) AS BIGINT) AS n_sells, {rs('tanh(sum(net) / 1000000.0)', 6)} AS score, max(owner) FILTER (rn = 1) AS top1 FROM r GROUP BY 1""")
def political_signal(spark, d):
    s = D.political_signal(B.filings(spark, d), F.lit("1998-06-30").cast("date"), {7: 2.0})
    return s.select("issuer", "n_buys", "n_sells", rnd("score", 6).alias("score"), F.element_at("top", 1).alias("top1"))


@query("seq07_clusters", f"""WITH RECURSIVE {B.FILINGS}, p AS (SELECT issuer, owner, filed AS day, sum(value) AS v FROM fil WHERE code = 'P' GROUP BY 1, 2, 3), dd AS (SELECT DISTINCT issuer, day FROM p),
 q AS (SELECT dd.issuer, dd.day, count(DISTINCT p.owner) AS n, sum(p.v) AS v FROM dd JOIN p ON p.issuer = dd.issuer AND p.day > dd.day - 30 AND p.day <= dd.day GROUP BY 1, 2 HAVING count(DISTINCT p.owner) >= 4 AND sum(p.v) >= 100000 - 1e-6),
 ev AS (SELECT issuer, min(day) AS day FROM q GROUP BY 1 UNION ALL SELECT issuer, nd FROM (SELECT e.issuer, (SELECT min(q.day) FROM q WHERE q.issuer = e.issuer AND q.day >= e.day + 182) AS nd FROM ev e) WHERE nd IS NOT NULL)
 SELECT q.issuer, {ds('q.day')} AS signal_date, q.n AS n_insiders, {rs('q.v', 1)} AS total_value FROM ev JOIN q ON q.issuer = ev.issuer AND q.day = ev.day""")
def clusters(spark, d):
    f = B.filings(spark, d).where(F.col("code") == "P")
    c = D.detect_clusters(f, min_insiders=4)
    return c.select("issuer", day("signal_date").alias("signal_date"), "n_insiders", rnd("total_value", 1).alias("total_value"))


@query("agg29_social_signal", f"""WITH {SENT}, a AS (SELECT lang AS symbol, source, CASE WHEN n_pos > n_neg + 3 THEN 0.7 WHEN n_neg > n_pos + 3 THEN -0.7 END AS lab, polarity, confidence, n_chars FROM sp),
 g AS (SELECT symbol, count(*) FILTER (source <> 'src1') AS n1, avg(CASE WHEN lab IS NOT NULL THEN lab WHEN confidence > 0.1 THEN polarity END) FILTER (source <> 'src1') AS s1, count(*) FILTER (source = 'src1') AS n2,
  sum(polarity * greatest(1, ln(1 + n_chars))) FILTER (source = 'src1') / nullif(sum(greatest(1, ln(1 + n_chars))) FILTER (source = 'src1'), 0) AS s2 FROM a GROUP BY 1)
 SELECT symbol, n1 + n2 AS n, {rs('CASE WHEN n1 > 0 AND n2 > 0 THEN 0.6 * coalesce(s1, 0) + 0.4 * coalesce(s2, 0) WHEN n1 > 0 THEN coalesce(s1, 0) ELSE coalesce(s2, 0) END', 6)} AS score, {rs('tanh((n1 + n2) / 25.0)', 6)} AS hype FROM g""")
def social_signal(spark, d):
    from tapegrain.operators.signals import social_signal as ss
    s = scored_docs(spark, d)
    lab = F.when(F.col("n_pos") > F.col("n_neg") + 3, 0.7).when(F.col("n_neg") > F.col("n_pos") + 3, -0.7)
    a = s.select(F.col("lang").alias("symbol"), (F.col("source") == "src1").alias("forum"), lab.alias("label"), "polarity", "confidence", F.col("n_chars").alias("engagement"))
    return ss(a).select("symbol", "n", rnd("score", 6).alias("score"), rnd("hype", 6).alias("hype"))


@query("set02_first_by_url", """SELECT url, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(www\\.|m\\.)?', '') AS url FROM pages) GROUP BY 1""")
def first_by_url(spark, d):
    from tapegrain.operators.joins import keep_first
    p = B.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"^https?://(www\.|m\.)?", "").alias("url"))
    return keep_first(p, ["url"], ["page_id"]).select("url", "page_id")


@query("sca09_content_hashes", "SELECT doc_id, sha256(source || '|' || text) AS key, md5(text) AS text_md5 FROM documents")
def content_hashes(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", "text"), 256).alias("key"), F.md5("text").alias("text_md5"))
