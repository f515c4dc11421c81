"""Queries over sentiment, ownership, copies of the graph, similar names and layer
scores, with their SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import evaluation as E
from shelfloom.operators import fuzzy
from shelfloom.operators import graph as G
from shelfloom.operators import retrieval as R
from shelfloom.operators import rules as N
from shelfloom.operators import sentiment as M
from shelfloom.operators import shelf as S
from shelfloom.operators import texts as T
from shelfloom.sources import backups as B
from shelfloom.sources import tables
from shelfloom.sources import views as V

from . import insight as I

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql=None, doubles=""):
    """Register a plan over (spark, folder); doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})
    if sql:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in cols)}) FROM ({sql})" if cols else sql


# --- sentiment: parts are products, the words of their names stand for tags

TAG_OF = {
    "red": "moisturizing", "blue": "hydrating", "small": "travel size", "large": "easy to use", "old": "value for money", "hot": "effective", "ring": "nice scent",
    "bolt": "sturdy", "gear": "works well", "plate": "smooth", "anvil": "gentle",
}


def customers_say(s, d):
    """(product, brand, tags, summary, success) of parts."""
    words = F.create_map(*(F.lit(x) for pair in TAG_OF.items() for x in pair))
    key = F.col("p_partkey")
    return V.table(s, d, "part").select(
        key.cast("string").alias("product"), F.col("p_brand").alias("brand"), F.transform(F.split("p_name", " "), lambda w: F.coalesce(words[w], w)).alias("tags"),
        F.when(key % 3 == 0, "Customers LOVE it").when(key % 3 == 1, "Nice, but small").otherwise("").alias("summary"), F.lit(True).alias("success"),
    )


def _cluster(tag):
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower({tag}), '{w}') OR contains('{w}', lower({tag}))''' for w in words)} THEN '{name}'" for name, words in M.CLUSTERS) + " END"


def say_sql():
    word = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TAG_OF.items()) + " ELSE w END"
    return f"""said AS (SELECT p_partkey::VARCHAR AS product, p_partkey AS id, p_brand AS brand, list_transform(string_split(p_name, ' '), lambda w: {word}) AS words, CASE p_partkey % 3 WHEN 0 THEN 'Customers LOVE it' WHEN 1 THEN 'Nice, but small' ELSE '' END AS summary FROM part),
tags AS (SELECT DISTINCT product, brand, tag, {_cluster('tag')} AS cluster FROM (SELECT product, brand, unnest(words) AS tag FROM said))"""


def edges(s, d):
    return M.sentiment_edges(customers_say(s, d))


def made(s, d):
    return V.table(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("product"))


SAY = "WITH " + say_sql()
add("sentiment_edges", edges, SAY + " SELECT product AS subject, 'hasSentiment' AS predicate, tag AS object, cluster FROM tags UNION ALL SELECT product, 'hasSummary', summary, NULL FROM said WHERE summary <> ''")
add("product_sentiments", lambda s, d: M.product_sentiments(edges(s, d)).select("product", F.array_join("tags", ",").alias("tags"), F.array_join(F.map_keys("clusters"), ",").alias("clusters"), "summary"),
    SAY + " SELECT product, string_agg(tag, ',' ORDER BY tag) AS tags, coalesce(string_agg(DISTINCT cluster, ',' ORDER BY cluster), '') AS clusters, nullif(any_value(summary), '') AS summary FROM tags JOIN said USING (product) GROUP BY 1")
add("brand_sentiments", lambda s, d: M.brand_profile(edges(s, d), made(s, d)),
    SAY + """, n AS (SELECT brand, tag, cluster, count(*) AS n FROM tags GROUP BY ALL), f AS (SELECT *, first_value(tag) OVER (PARTITION BY brand ORDER BY n DESC, tag) AS dominant FROM n)
    SELECT brand, products, dominant, cluster, mentions FROM (SELECT p_brand AS brand, count(DISTINCT p_partkey) AS products FROM part GROUP BY 1) LEFT JOIN (SELECT brand, dominant, cluster, sum(n)::BIGINT AS mentions FROM f GROUP BY ALL) USING (brand)""")
add("sentiments_compared", lambda s, d: M.compared(edges(s, d), made(s, d).select(F.col("product").alias("one"), (F.col("product").cast("long") + 2).cast("string").alias("two"))).select("one", "two", *(F.array_join(c, ",").alias(c) for c in ("common", "only_one", "only_two"))),
    SAY + """, t AS (SELECT product, list(tag ORDER BY tag) AS l FROM tags GROUP BY 1), p AS (SELECT p_partkey::VARCHAR AS one, (p_partkey + 2)::VARCHAR AS two FROM part), b AS (SELECT one, two, coalesce(x.l, []) AS a, coalesce(y.l, []) AS b FROM p LEFT JOIN t x ON one = x.product LEFT JOIN t y ON two = y.product)
    SELECT one, two, coalesce(list_aggregate(list_filter(a, lambda v: list_contains(b, v)), 'string_agg', ','), '') AS common, coalesce(list_aggregate(list_filter(a, lambda v: NOT list_contains(b, v)), 'string_agg', ','), '') AS only_one, coalesce(list_aggregate(list_filter(b, lambda v: NOT list_contains(a, v)), 'string_agg', ','), '') AS only_two FROM b""")
add("tagged_products", lambda s, d: M.tagged(edges(s, d), "hydrating", made(s, d), "BRAND#11"), SAY + " SELECT product FROM tags WHERE tag = 'hydrating' AND brand = 'Brand#11'")


def _sentiment_context(s, d):
    rivals = V.triples(s, d).where("predicate = 'directCompetitor'").select(F.col("subject").alias("brand"), F.col("object").alias("rival"))
    summary = customers_say(s, d).groupBy("brand").agg(F.min(F.when(F.col("summary") != "", F.col("summary"))).alias("summary"))
    return M.brand_sentiment_context(edges(s, d), made(s, d), rivals).join(summary, "brand", "left")


def _value(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_RULE = {r[0]: r for r in N.RULES}
_WHEN = {
    "hydration_strength": "hydration >= 2", "value_advantage": "good_value > 0 AND coalesce(rival_value, 0) = 0", "packaging_weakness": "packaging = 0 AND rival_packaging > 0", "usability_strength": "usability > 0",
    "effectiveness_strong": "effectiveness >= 1", "sensory_gap": "sensory = 0 AND rival_sensory > 0", "perception_positive": f"regexp_matches(lower(summary), '{N.PRAISE}')",
    "perception_mixed": f"regexp_matches(lower(summary), '{N.MILD}') AND regexp_matches(lower(summary), '{N.DOUBT}')",
}
add("sentiment_rule_hits", lambda s, d: N.infer(_sentiment_context(s, d), ["brand"], rules=[_RULE[n] for n in _WHEN]),
    f"WITH {V.TRIPLES_SQL}, {say_sql()}, own AS (SELECT DISTINCT brand, tag, cluster FROM tags), rival AS (SELECT DISTINCT subject AS brand, tag, cluster FROM triples JOIN own ON object = own.brand WHERE predicate = 'directCompetitor'), "
    + "a AS (SELECT brand, " + ", ".join(f"count(*) FILTER (cluster = '{c.capitalize()}') AS {c}" for c in ("hydration", "packaging", "usability", "effectiveness", "sensory")) + f", count(*) FILTER (lower(tag) IN {_value((*N.VALUE, 'worth the price'))}) AS good_value FROM own GROUP BY 1), "
    + f"b AS (SELECT brand, count(*) FILTER (cluster = 'Packaging') AS rival_packaging, count(*) FILTER (cluster = 'Sensory') AS rival_sensory, count(*) FILTER (lower(tag) IN {_value(N.VALUE)}) AS rival_value FROM rival GROUP BY 1), "
    + "c AS (SELECT * FROM a LEFT JOIN b USING (brand) LEFT JOIN (SELECT brand, min(nullif(summary, '')) AS summary FROM said GROUP BY 1) USING (brand)) "
    + " UNION ALL ".join(f"SELECT brand, '{n}' AS rule, 'sentiment' AS kind, {_RULE[n][3]} AS priority, {_RULE[n][4]}::DOUBLE AS confidence FROM c WHERE {w}" for n, w in _WHEN.items()))

# --- ownership: nations are brands, their regions own them


def owned(s, d):
    place = V.table(s, d, "nation").join(F.broadcast(V.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return G.ownership_edges(place.select(
        F.col("n_name").alias("brand"), F.when(k % 7 != 0, F.col("r_name")).alias("owner"), F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 3).cast("string"))).alias("segment"), F.lower("r_name").alias("country"), F.when(k % 5 == 0, 2000 + k).alias("acquired"),
    ))


OWNED = """WITH brands AS (SELECT n_name AS brand, CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS owner, CASE WHEN n_nationkey % 4 <> 0 THEN 'S' || n_nationkey % 3 END AS segment, lower(r_name) AS country, CASE WHEN n_nationkey % 5 = 0 THEN (2000 + n_nationkey)::VARCHAR END AS acquired FROM nation JOIN region ON n_regionkey = r_regionkey)"""
add("kg_ownership_edges", owned, OWNED + " SELECT *, 1.0::DOUBLE AS confidence FROM (SELECT brand AS subject, 'ownedByGroup' AS predicate, owner AS object FROM brands WHERE owner IS NOT NULL UNION SELECT owner, 'ownsBrand', brand FROM brands WHERE owner IS NOT NULL UNION SELECT brand, 'hasSegment', coalesce(segment, 'Unknown') FROM brands UNION SELECT brand, 'originatesFrom', country FROM brands UNION SELECT brand, 'acquiredIn', acquired FROM brands WHERE acquired IS NOT NULL)")
add("kg_ownership", lambda s, d: G.ownership(owned(s, d)), OWNED + " SELECT brand, owner, coalesce(segment, 'Unknown') AS segment, country, acquired, CASE WHEN owner IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY owner) - 1 END AS sisters FROM brands")
add("kg_sisters", lambda s, d: G.sisters(owned(s, d), "NATION_3"), OWNED + " SELECT b.brand AS sister FROM brands a JOIN brands b ON a.owner = b.owner AND a.brand <> b.brand WHERE a.brand = 'NATION_3'")

# --- dated copies of the graph


def _copies(s, d):
    t, folder = V.triples(s, d), f"{tables.shared_folder(s).rstrip('/')}/copies-{uuid.uuid4().hex}"
    B.save(t, folder, date(2024, 1, 1))
    B.save(t.where("predicate = 'hasProduct'"), folder, date(2024, 3, 1))
    B.save(t.where("predicate <> 'originatesFrom'"), folder, date(2024, 3, 1))
    B.save(t.where("predicate <> 'belongsToCategory'"), folder, date(2024, 3, 10))
    return B.restore(s, folder, date(2024, 3, 5)).groupBy("predicate").agg(F.count("*").alias("n"))


add("kg_backup", _copies, f"WITH {V.TRIPLES_SQL} SELECT predicate, count(*) AS n FROM triples WHERE predicate <> 'originatesFrom' GROUP BY 1")

# --- similar names and meanings (no SQL: difflib's ratio, a fold with state)

NAMES = list(X.BRAND_NAMES.values())


def misspelt(s, d):
    """Names that lack a letter."""
    k, names = F.col("p_partkey"), F.array(*map(F.lit, NAMES))
    name = F.element_at(names, (k % len(NAMES) + 1).cast("int"))
    at = (k % F.length(name)).cast("int")
    return V.table(s, d, "part").select("p_partkey", F.concat(name.substr(F.lit(1), at), name.substr(at + 2, F.lit(99))).alias("mention"))


def _linked(s, d):
    hit = fuzzy.closest(NAMES)(F.col("mention"))
    return misspelt(s, d).select("p_partkey", "mention", hit.alias("hit")).select("p_partkey", "mention", "hit.name", F.round("hit.score", 6).alias("score"))


add("fuzzy_links", _linked)
add("fuzzy_set_f1", lambda s, d: V.table(s, d, "part").select("p_partkey", F.round(fuzzy.set_f1()(F.split("p_name", " "), F.split(F.concat(F.col("p_name"), F.lit("s extra")), " ")), 6).alias("f1")))
add("semantic_chunks", lambda s, d: T.semantic_chunks(V.table(s, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("place"), (F.col("vec_id") % 200 + 50).alias("size"), F.col("embedding").alias("vector"))),
    """WITH RECURSIVE u AS (SELECT label AS doc, vec_id AS place, vec_id % 200 + 50 AS size, row_number() OVER w AS i, list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER w) AS sim FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
  q AS (SELECT doc, greatest(quantile_cont(sim, 0.25), 0.5) AS least FROM u GROUP BY 1), c AS (SELECT u.*, coalesce(sim < least, false) AS cut FROM u JOIN q ON q.doc IS NOT DISTINCT FROM u.doc),
  r AS (SELECT DISTINCT doc, 0::BIGINT AS i, 0::BIGINT AS chunk, 0::BIGINT AS next, 0::BIGINT AS used FROM c
    UNION ALL SELECT c.doc, c.i, r.next, r.next + (cut AND used + size >= 100 OR used + size >= 1000)::INT, CASE WHEN cut AND used + size >= 100 OR used + size >= 1000 THEN 0 ELSE used + size END FROM r JOIN c ON c.doc IS NOT DISTINCT FROM r.doc AND c.i = r.i + 1)
  SELECT c.doc, place, chunk::INT AS chunk FROM r JOIN c ON c.doc IS NOT DISTINCT FROM r.doc AND c.i = r.i""")


# --- layer scores


def _graph_items(s, d):
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("e"))
    found, right = F.col("l_linenumber") <= 4, F.col("l_returnflag") == "R"
    per = V.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(found, line))).alias("f"), F.array_sort(F.collect_list(F.when(right, line))).alias("g"))
    return per.select("l_orderkey", E.graph_layer(F.col("f")["p"], F.col("g")["p"], F.col("f")["e"], F.col("g")["e"], 2).alias("x")).select("l_orderkey", "x.*")


_P, _E = "l_partkey::VARCHAR", "l_partkey || '-' || l_suppkey"
add("graph_layer", _graph_items, f"""WITH a AS (SELECT l_orderkey, {', '.join(f"coalesce(list({c} ORDER BY l_linenumber, l_partkey::VARCHAR, {_E}) FILTER ({w}), []) AS {n}" for n, c, w in (('f', _P, 'l_linenumber <= 4'), ('g', _P, "l_returnflag = 'R'"), ('fe', _E, 'l_linenumber <= 4'), ('ge', _E, "l_returnflag = 'R'")))} FROM lineitem GROUP BY 1),
  b AS (SELECT *, len(list_distinct(f)) AS nf, len(list_distinct(g)) AS ng, len(list_intersect(list_distinct(f), list_distinct(g)))::DOUBLE AS same, len(list_distinct(fe)) + len(list_distinct(ge)) AS ne, len(list_intersect(list_distinct(fe), list_distinct(ge)))::DOUBLE AS eboth FROM a)
  SELECT l_orderkey, CASE WHEN ng = 0 THEN 1.0::DOUBLE ELSE list_has_any(f[1:2], g)::INT::DOUBLE END AS hits, CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE 2 * eboth / ne END AS edge_f1, CASE WHEN nf = 0 THEN (ng = 0)::INT::DOUBLE ELSE same / nf END AS precision, CASE WHEN ng = 0 THEN 1.0::DOUBLE ELSE same / ng END AS recall FROM b""", "edge_f1 precision recall")


def _scored(s, d):
    x = F.col("o_orderkey") % 100 / 100.0
    layers = {n: (x if i % 2 else 1 - x) for i, n in enumerate("entity_link_f1 concept_map_f1 constraint_f1 recall precision mrr hits edge_f1 violation_rate type_consistency".split())}
    answer = [x, F.when(F.col("o_orderkey") % 3 == 0, 1 - x), F.lit(None).cast("double")]
    return V.table(s, d, "orders").select("o_orderkey", E.overall(layers, F.col("o_orderkey") % 2 == 0, answer).alias("score"))


add("overall_scores", _scored, """SELECT o_orderkey, 0.45::DOUBLE * CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE x END + 0.35::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 0.3::DOUBLE * x + 0.1::DOUBLE * x + 0.4::DOUBLE * y + 0.2::DOUBLE * x ELSE 0.5::DOUBLE * x + 0.2::DOUBLE * y + 0.3::DOUBLE * x END
    + 0.1::DOUBLE * (2 * y + x) / 3 + 0.1::DOUBLE * (0.5::DOUBLE * (1 - y) + 0.5::DOUBLE * x) AS score FROM (SELECT o_orderkey, o_orderkey % 100 / 100.0::DOUBLE AS x, 1 - o_orderkey % 100 / 100.0::DOUBLE AS y FROM orders)""", "score")


def _graded(s, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return E.graded_ndcg(V.table(s, d, "lineitem").select("l_orderkey", place.alias("rank"), (F.col("l_quantity").cast("long") % 4).alias("gain")), "l_orderkey", 3)


add("graded_ndcg", _graded, """SELECT l_orderkey, CASE WHEN sum(i) > 0 THEN sum(g) / sum(i) ELSE 0 END AS ndcg FROM (SELECT l_orderkey, CASE WHEN r <= 3 THEN gain / log2(r + 1) ELSE 0 END AS g, CASE WHEN b <= 3 THEN gain / log2(b + 1) ELSE 0 END AS i
    FROM (SELECT l_orderkey, gain, r, row_number() OVER (PARTITION BY l_orderkey ORDER BY gain DESC) AS b FROM (SELECT l_orderkey, (l_quantity::BIGINT % 4)::DOUBLE AS gain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem))) GROUP BY 1""", "ndcg")

# --- the market's month, what is due in it, and keys in log lines

MONTH = ["snapshot_date", "category_id"]


def _overview(s, d):
    shelf = V.shelf(s, d)
    leader = S.brand_metrics(shelf).select(*MONTH, F.col("brand").alias("top_brand"), F.col("cpi").alias("leader_cpi"))
    out = S.market_metrics(shelf).join(S.churn(shelf).select(*MONTH, "churn_rate"), MONTH, "left").join(leader, [*MONTH, "top_brand"], "left")
    return out.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "category_id", "top_brand", "top_share", "hhi", "churn_rate", "leader_cpi")


add("market_overview", _overview, f"WITH {V.SHELF_SQL}, {I.CONTEXT_SQL} SELECT snapshot_date::VARCHAR AS snapshot_date, category_id, brand AS top_brand, sos AS top_share, hhi, churn_rate, cpi AS leader_cpi FROM ctx QUALIFY row_number() OVER (PARTITION BY snapshot_date, category_id ORDER BY sos DESC, brand) = 1", "top_share hhi churn_rate leader_cpi")


def _due(s, d):
    mine = lambda c: F.max(F.when(F.col("is_target"), F.col(c))).alias(c)
    per = I.context(s, d).groupBy(*MONTH).agg(F.count_if("rank_shock").alias("shocks"), mine("cpi"), mine("rating_gap"), F.max("churn_rate").alias("churn_rate"))
    return N.action_queue(per, MONTH).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


add("action_queue", _due, f"""WITH {V.SHELF_SQL}, {I.CONTEXT_SQL}, p AS (SELECT snapshot_date::VARCHAR AS snapshot_date, category_id, list_filter([CASE WHEN count(*) FILTER (rank_shock) > 0 THEN 'check_moved_products' END,
    CASE WHEN max(cpi) FILTER (is_target) > 100 AND max(rating_gap) FILTER (is_target) < 0 THEN 'check_price_against_rating' END, CASE WHEN max(churn_rate) > 0.2::DOUBLE THEN 'check_entries_and_exits' END], lambda x: x IS NOT NULL) AS l FROM ctx GROUP BY 1, 2)
  SELECT snapshot_date, category_id, unnest(range(greatest(len(l), 1)))::INT AS place, unnest(CASE WHEN len(l) = 0 THEN ['all_quiet'] ELSE l END) AS action FROM p""")


def _log_lines(s, d):
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    part = lambda n: F.substring(h, 1, n)
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" sk-"), part(24), F.lit(' API_KEY="'), part(20), F.lit('" Bearer '), part(30), F.lit(" id "), h, F.lit(" short "), part(12))
    return V.table(s, d, "orders").select("o_orderkey", R.masked(text, R.KEYS).alias("line"))


_LINE = """'order ' || o_orderkey || ' sk-' || h[1:24] || ' API_KEY="' || h[1:20] || '" Bearer ' || h[1:30] || ' id ' || h || ' short ' || h[1:12]"""
for _p, _to in R.KEYS:
    _q, _t = _p.replace("'", "''"), _to.replace("$1", "\\1")
    _LINE = f"regexp_replace({_LINE}, '{_q}', '{_t}', 'g')"
add("masked_keys", _log_lines, f"SELECT o_orderkey, {_LINE} AS line FROM (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS h FROM orders)")

# --- conditions on terms, as numbers where they are

_NUM = "CASE WHEN try_cast(object AS DOUBLE) IS NOT NULL THEN try_cast(object AS DOUBLE) {o} {n} ELSE object {o} '{n}' END"
add("kg_term_filter", lambda s, d: owned(s, d).where(G.compares(F.col("object"), ">=", "2010")).where(G.compares(F.col("object"), "!=", "2015.0")).select("subject", "predicate", "object"),
    f"SELECT subject, predicate, object FROM ({SQL['kg_ownership_edges']}) WHERE {_NUM.format(o='>=', n='2010')} AND {_NUM.format(o='<>', n='2015.0')}")
