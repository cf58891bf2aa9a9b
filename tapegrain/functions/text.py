"""Text rules as columns: sentiment, categories, substantiation, mentions, relations, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------

POSITIVE_WORDS = ("beat", "beats", "growth", "growing", "rally", "rallies", "surge", "soars", "upgrade", "outperform",
                  "strong", "record", "breakthrough", "wins", "expansion", "bullish", "buyback", "dividend", "innovation")
NEGATIVE_WORDS = ("miss", "missed", "downgrade", "weak", "decline", "drop", "drops", "plunge", "lawsuit", "investigation",
                  "fraud", "bearish", "loss", "recession", "warning", "cuts", "layoffs", "fine", "fined", "scandal")

CATEGORY_TERMS = (
    ("earnings_beat", ("beats earnings", "earnings beat", "tops estimates", "tops eps", "tops revenue")),
    ("earnings_miss", ("misses earnings", "misses estimates", "earnings miss", "below estimates")),
    ("guidance_raise", ("raises guidance", "lifts guidance", "raises outlook", "raises forecast")),
    ("guidance_cut", ("cuts guidance", "lowers guidance", "lowers outlook", "warns on")),
    ("fda_approval", ("fda approval", "fda approves", "fda clears", "ce mark", "approved by the fda")),
    ("fda_rejection", ("fda rejects", "complete response letter", "crl")),
    ("executive_endorsement", ("trillion-dollar company", "next trillion", "calls it the next", "praises", "endorses",
                               "ceo backs", "biggest fan", "champions")),
    ("strategic_investment", ("takes a stake", "takes stake", "equity stake", "strategic investment", "invests $",
                              "billion investment", "invests in", "leads investment round")),
    ("major_customer_win", ("design win", "anchor customer", "marquee customer", "lands as a customer",
                            "signs as customer", "wins as a customer", "secures order from")),
    ("index_inclusion", ("join the s&p 500", "added to the s&p 500", "added to s&p", "index inclusion",
                         "joins the nasdaq-100", "added to nasdaq-100", "set to join the s&p")),
    ("capacity_expansion", ("new fab", "new plant", "expands capacity", "data center buildout", "datacenter buildout",
                            "gigafactory", "capacity expansion", "new factory")),
    ("acquisition_target", ("to be acquired", "acquired by")),
    ("acquirer", ("acquires", "acquisition", "buyout offer", "takeover bid")),
    ("partnership", ("partnership", "joint venture", "strategic alliance")),
    ("contract_win", ("contract win", "wins contract", "awarded contract")),
    ("analyst_upgrade", ("upgraded", "raises price target", "buy rating", "outperform")),
    ("analyst_downgrade", ("downgraded", "lowers price target", "sell rating", "underperform")),
    ("legal_litigation", ("lawsuit", "sec investigation", "doj probe", "settlement")),
    ("product_launch", ("launches", "unveils", "introduces", "rolls out")),
    ("macro", ("fed rate", "fomc", "tariff", "trade war")),
)
# a takeover headline counts as the target's only when one of the acquirer words is there as well
ACQUISITION_WORDS = ("acquires", "acquisition", "to be acquired", "buyout offer", "takeover bid")

MATERIALITY_FLOORS = {
    "earnings_beat": 0.75, "earnings_miss": 0.75, "guidance_raise": 0.80, "guidance_cut": 0.85, "fda_approval": 0.90,
    "fda_rejection": 0.90, "acquisition_target": 0.90, "acquirer": 0.70, "executive_endorsement": 0.70,
    "strategic_investment": 0.80, "major_customer_win": 0.65, "index_inclusion": 0.75, "capacity_expansion": 0.55,
    "contract_win": 0.60, "contract_loss": 0.60, "partnership": 0.50, "insider_buy_cluster": 0.65,
    "analyst_upgrade": 0.55, "analyst_downgrade": 0.55, "legal_litigation": 0.50, "product_launch": 0.45,
    "sec_filing": 0.40, "macro": 0.35, "technical": 0.20, "noise": 0.10}

# Direction of each category (fixed values); a category that is not listed is neutral.
DIRECTIONS = {
    "earnings_beat": "bullish", "earnings_miss": "bearish", "guidance_raise": "bullish", "guidance_cut": "bearish",
    "fda_approval": "bullish", "fda_rejection": "bearish", "acquisition_target": "bullish", "acquirer": "neutral",
    "executive_endorsement": "bullish", "strategic_investment": "bullish", "major_customer_win": "bullish", "index_inclusion": "bullish",
    "capacity_expansion": "bullish", "contract_win": "bullish", "contract_loss": "bearish", "partnership": "bullish",
    "insider_buy_cluster": "bullish", "analyst_upgrade": "bullish", "analyst_downgrade": "bearish", "legal_litigation": "bearish",
    "product_launch": "bullish", "sec_filing": "neutral", "macro": "neutral", "technical": "neutral", "noise": "neutral"}

RUMOR_TERMS = ("rumor", "rumour", "speculation", "could be", "may be", "reportedly in talks", "weighing", "exploring a",
               "is said to be considering")
FACT_TERMS = ("announced", "confirmed", "official", "press release", "8-k", "files with the sec", "on stage",
              "at the keynote", "said at", "told investors", "in a statement")
OFFICIAL_TERMS = ("press release", "8-k", "files with the sec", "official")
REPORT_TERMS = ("reportedly", "sources say", "people familiar", "according to people", "rumored to")
SUBSTANTIATION_MULT = {"rumor": 0.55, "reported": 0.85, "confirmed": 1.00, "official": 1.05}

AMOUNT = r"\$?[\d.,]+\s*(?:billion|million|b|m)?"
RELATIONS = (
    (r"invests?(?:\s+" + AMOUNT + r")?\s+in", "strategic_investment"),
    (r"takes?\s+(?:a\s+)?(?:" + AMOUNT + r"\s+)?stake\s+in", "strategic_investment"),
    (r"buys?\s+(?:a\s+)?stake\s+in", "strategic_investment"),
    (r"leads?\s+(?:a\s+)?(?:" + AMOUNT + r"\s+)?(?:funding|investment)\s+(?:round\s+)?(?:in|for)", "strategic_investment"),
    (r"pours?\s+" + AMOUNT + r"\s+into", "strategic_investment"),
    (r"backs", "executive_endorsement"),
    (r"to\s+acquire", "acquisition_target"),
    (r"acquires?", "acquisition_target"),
    (r"to\s+buy", "acquisition_target"),
    (r"agrees?\s+to\s+buy", "acquisition_target"),
    (r"partners?\s+with", "partnership"),
    (r"teams?\s+up\s+with", "partnership"),
    (r"(?:signs?|inks?)\s+(?:a\s+)?(?:[\w-]+\s+){0,4}?deal\s+with", "partnership"),
    (r"strikes?\s+(?:a\s+)?(?:[\w-]+\s+){0,4}?deal\s+with", "partnership"),
    (r"joint\s+venture\s+with", "partnership"),
    (r"to\s+supply", "major_customer_win"),
    (r"selects?", "major_customer_win"),
    (r"picks?", "major_customer_win"),
    (r"chooses?", "major_customer_win"),
    (r"names?\s+(?:the\s+)?next\s+trillion", "executive_endorsement"),
    (r"calls?\s+(?:\w+\s+){0,4}?the\s+next", "executive_endorsement"),
)

REVERSAL_ACTION = (r"\b(sells?|sold|selling|sale\s+of|offload\w*|dump\w*|unload\w*|trim\w*|reduc\w*|abandon\w*|exit\w*|"
                   r"halt\w*|pause\w*|liquidat\w*|wind\s+down|divest\w*|writes?\s+down|write-down)\b")
BOILERPLATE = ("buy, sell or hold", "buy or sell", "sell or hold", "to buy or sell", "buy/sell", "buy, sell, or hold",
               "best stock", "stocks to buy")
CONFLICT_PROXIMITY = 28

TOPIC_PRIORS = {
    "earnings": (1.0, 0.05), "m_and_a": (1.0, 0.08), "regulation": (-1.0, 0.04), "lawsuit": (-1.0, 0.03),
    "product": (1.0, 0.02), "leadership_change": (0.0, 0.025), "macro": (0.0, 0.015), "analyst_action": (1.0, 0.02),
    "insider_activity": (0.0, 0.015), "other": (0.0, 0.01)}

# -------------------------------------------------------------------------------------------------


def has_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def lexicon_counts(text: Column, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> tuple[Column, Column]:
    w = words(text)
    n = lambda terms: F.size(F.filter(w, lambda x: x.isin(*terms)))
    return n(positive), n(negative)


def sentiment(df: DataFrame, text: str, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> DataFrame:
    """Polarity in [-1, 1] and confidence from word hits over the whole text."""
    p, n = lexicon_counts(F.col(text), positive, negative)
    d = df.withColumns({"n_pos": p, "n_neg": n})
    hits = F.col("n_pos") + F.col("n_neg")
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return d.withColumns({
        "polarity": F.when(empty | (hits == 0), 0.0).otherwise((F.col("n_pos") - F.col("n_neg")) / F.nullif(hits, F.lit(0))),
        "confidence": F.when(empty, 0.0).when(hits == 0, 0.05).otherwise(F.least(F.lit(1.0), hits / 10.0))})


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def category(text: Column) -> Column:
    """First matching rule in order; ``text`` is lower case."""
    out = None
    for name, terms in CATEGORY_TERMS:
        hit = has_any(text, terms)
        if name == "acquisition_target":
            hit = hit & has_any(text, ACQUISITION_WORDS)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("noise")


def substantiation(text: Column) -> Column:
    return (F.when(has_any(text, RUMOR_TERMS), "rumor")
            .when(has_any(text, FACT_TERMS), F.when(has_any(text, OFFICIAL_TERMS), "official").otherwise("confirmed"))
            .when(has_any(text, REPORT_TERMS), "reported").otherwise("confirmed"))


def lookup(table: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def direction(cat: Column) -> Column:
    return lookup(DIRECTIONS, cat, "neutral")


def classify(df: DataFrame, title: str, summary: str | None = None) -> DataFrame:
    """Category, direction, substantiation and discounted materiality of a headline."""
    text = F.lower(F.concat_ws(" ", F.col(title), F.col(summary)) if summary else F.col(title))
    d = df.withColumn("_t", text)
    d = d.withColumns({"category": category(F.col("_t")), "substantiation": substantiation(F.col("_t"))}).drop("_t")
    mult = lookup(SUBSTANTIATION_MULT, F.col("substantiation"), 1.0)
    return d.withColumns({"direction": direction(F.col("category")),
                          "materiality": F.least(F.lit(1.0), lookup(MATERIALITY_FLOORS, F.col("category"), 0.2) * mult)})


def catalyst_score(classified: DataFrame, key: str, published: str, title: str) -> DataFrame:
    """Materiality-weighted direction per key with the loudest article and the count of each category."""
    sign = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0).otherwise(0.0)
    d = classified.withColumn("_c", F.col("materiality") * sign)
    by_cat = d.groupBy(key, "category").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_s"), F.sum("materiality").alias("_m"), F.max("materiality").alias("_x"),
                                            F.max(F.struct(F.abs("_c").alias("a"), F.col(published).alias("p"), F.col(title).alias("t"))).alias("_l"))
    g = by_cat.groupBy(key).agg(F.sum("_n").alias("n_articles"), (F.sum("_s") / F.nullif(F.sum("_m"), F.lit(0.0))).alias("score"), F.max("_x").alias("max_materiality"),
                                F.max("_l").alias("_l"), F.map_from_entries(F.array_sort(F.array_agg(F.struct("category", "_n")))).alias("categories"))
    return g.withColumns({"score": F.coalesce("score", F.lit(0.0)), "lead_title": F.when(F.col("_l.a") > 0, F.col("_l.t"))}).drop("_l")


def topic_signal(df: DataFrame, key: str, topic: str, confidence: str, polarity: str) -> DataFrame:
    """Squashed sum of direction x magnitude x confidence over confident articles."""
    sign = lookup({k: v[0] for k, v in TOPIC_PRIORS.items()}, F.col(topic), 0.0)
    mag = lookup({k: v[1] for k, v in TOPIC_PRIORS.items()}, F.col(topic), TOPIC_PRIORS["other"][1])
    d = df.where((F.col(confidence) >= 0.30) & F.col(polarity).isNotNull())
    way = F.when(F.abs(sign) > 0.01, sign).otherwise(F.when(F.col(polarity) > 0, 1.0).otherwise(-1.0))
    g = d.groupBy(key).agg(F.sum(way * mag * F.col(confidence)).alias("_s"), F.count(F.lit(1)).alias("n_articles"))
    return g.withColumn("score", F.tanh(F.col("_s") * 8)).drop("_s")


# --- mentions and relations ----------------------------------------------------------------------

def pieces(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their character position: array of struct(pos, m)."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,m:string>>").alias("out"))
    both = F.zip_with(m, F.slice(gaps, F.lit(1), F.greatest(F.size(m), F.lit(1))), lambda a, b: F.struct(a.alias("m"), b.alias("g")))
    return F.aggregate(F.filter(both, lambda z: z["m"].isNotNull()), start, lambda acc, z: F.struct(
        (acc["at"] + F.length(z["g"]) + F.length(z["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(z["g"])).alias("pos"), z["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"])


def mentions(articles: DataFrame, aliases: DataFrame, id_col: str, title: str) -> DataFrame:
    """Known names in a text: word n-grams up to the longest alias, joined to the alias table by equality.

    ``aliases``: alias (lower case, words split by one blank), symbol. A mention inside a longer
    mention is dropped. No pattern over all names is built, so the alias table may be large.
    """
    max_words = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    w = articles.select(id_col, pieces(F.lower(F.col(title)), r"[a-z0-9.]+").alias("_w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), F.greatest(F.size("_w"), F.lit(1)))), lambda n: F.transform(
        F.filter(F.transform("_w", lambda x, i: F.struct(i.alias("i"), x["pos"].alias("pos"))), lambda x: x["i"] + n <= F.size("_w")),
        lambda x: F.struct(x["i"].alias("i"), n.alias("n"), x["pos"].alias("pos"),
                           F.array_join(F.transform(F.slice("_w", x["i"] + 1, n), lambda y: y["m"]), " ").alias("g")))))
    g = w.where(F.size("_w") > 0).select(id_col, F.explode(grams).alias("z")).select(id_col, "z.*")
    hit = g.join(aliases, g["g"] == aliases["alias"]).select(id_col, "i", "n", "pos", "symbol")
    per = hit.groupBy(id_col).agg(F.array_sort(F.array_agg(F.struct("pos", "i", "n", "symbol"))).alias("_ms"))  # bounded by one text
    inside = lambda a, b: (b["i"] <= a["i"]) & (b["i"] + b["n"] >= a["i"] + a["n"]) & (b["n"] > a["n"])
    return per.select(id_col, F.filter("_ms", lambda a: ~F.exists("_ms", lambda b: inside(a, b))).alias("mentions"))


def relations(articles: DataFrame, mentioned: DataFrame, id_col: str, title: str) -> DataFrame:
    """(actor, relation, target) triples: nearest mention before and after each relation phrase."""
    pattern = "(?:" + "|".join(p for p, _ in RELATIONS) + ")"
    d = articles.join(mentioned.where(F.size("mentions") >= 2), id_col)
    d = d.select(*articles.columns, "mentions", F.explode(pieces(F.lower(F.col(title)), pattern)).alias("_r"))
    before = F.filter("mentions", lambda m: m["pos"] < F.col("_r.pos"))
    after = F.filter("mentions", lambda m: m["pos"] > F.col("_r.pos"))
    cat = None
    for p, name in RELATIONS:
        hit = F.col("_r.m").rlike(f"^(?:{p})$")
        cat = F.when(hit, name) if cat is None else cat.when(hit, name)
    d = d.withColumns({"actor": F.try_element_at(before, F.lit(-1))["symbol"], "target": F.try_element_at(after, F.lit(1))["symbol"],
                       "relation": F.col("_r.m"), "category": cat.otherwise("partnership")})
    d = d.where(F.col("actor").isNotNull() & F.col("target").isNotNull() & (F.col("actor") != F.col("target")))
    d = d.withColumn("substantiation", substantiation(F.lower(F.col(title))))
    mult = lookup(SUBSTANTIATION_MULT, F.col("substantiation"), 1.0)
    return d.withColumn("materiality", F.least(F.lit(1.0), lookup(MATERIALITY_FLOORS, F.col("category"), 0.5) * mult)).drop("mentions", "_r")


def strongest_relation(rel: DataFrame, tie: str) -> DataFrame:
    """Keep the strongest triple per (target, actor, category)."""
    rest = [x for x in rel.columns if x not in ("target", "actor", "category")]
    g = rel.groupBy("target", "actor", "category").agg(F.max_by(F.struct(*rest), F.struct("materiality", F.col(tie))).alias("z"))
    return g.select("target", "actor", "category", "z.*")


def conflicts(articles: DataFrame, title: str, keywords: str) -> DataFrame:
    """Titles that put a reversal verb within a few words of one of the driver words (array column)."""
    t = F.lower(F.col(title))
    d = articles.where(~has_any(t, BOILERPLATE)).withColumn("_p", F.regexp_instr(t, F.lit(REVERSAL_ACTION)) - 1)
    near = F.exists(keywords, lambda k: (F.instr(t, k) > 0) & (F.abs(F.instr(t, k) - 1 - F.col("_p")) <= CONFLICT_PROXIMITY))
    return d.where((F.col("_p") >= 0) & near).withColumn("matched", F.regexp_extract(t, REVERSAL_ACTION, 0)).drop("_p")
