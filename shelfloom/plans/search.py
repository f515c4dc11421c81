"""Queries over stored indexes, filtered retrieval, linking, model slots and chunk vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.operators import dashboard as D
from shelfloom.operators import linking, slots
from shelfloom.operators import retrieval as R
from shelfloom.operators import texts as T
from shelfloom.operators.vector_index import VectorIndex
from shelfloom.sources import tables
from shelfloom.sources import views as V

from . import insight as I
from . import texts as X

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql=None, doubles=""):
    """Register a plan over (spark, folder); doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) for c in cols})
    if sql:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in cols)}) FROM ({sql})" if cols else sql


# --- stored vectors

#: Share of the lists that an approximate search reads: these vectors point in nearly all directions alike.
PROBED = 0.8


def _asked(v):
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))


def vector_index(s, d):
    """The first two thirds of the vectors are fitted and stored, the rest appended."""
    v = V.table(s, d, "embeddings")
    index = VectorIndex.fit(v.where("vec_id % 3 < 2"), f"{tables.shared_folder(s).rstrip('/')}/vectors-{uuid.uuid4().hex}")
    return index.append(v.where("vec_id % 3 = 2")), v


def _exact(s, d):
    index, v = vector_index(s, d)
    return index.search(_asked(v))


def _recall(s, d):
    """Recall at 10 of the approximate search, and the share of the rows that it read."""
    index, v = vector_index(s, d)
    asked, probes = _asked(v), round(PROBED * len(index.middle))
    true = R.vector_topk(asked, v.select("vec_id", "embedding")).select("query", "vec_id")
    got = index.search(asked, probes=probes).select("query", "vec_id", F.lit(1).alias("found"))
    recall = true.join(got, ["query", "vec_id"], "left").groupBy("query").agg((F.count("found") / F.count("*")).alias("recall"))
    total = F.broadcast(index.rows().agg(F.count("*").alias("rows")))
    return recall.join(index.rows_read(asked, probes), "query").crossJoin(total).select("query", "recall", "read", "rows")


add("vector_index_exact", _exact, I.VEC_SQL, "similarity")
add("vector_index_recall", _recall, doubles="recall")

# --- two retrievers, a filter and its fallback: items are questions, documents have
# the vector of their number; wanted are documents like that of the item's number


def _wanted(s, d):
    """(doc, query) of what passes, and a function that marks scores."""
    docs = V.table(s, d, "documents").select("doc_id", "lang", "source")
    own = docs.select(F.col("doc_id").alias("query"), F.col("lang").alias("_lang"), F.col("source").alias("_source")).join(V.table(s, d, "benchmark").select(F.col("item_id").alias("query")), "query", "left_semi")
    mine = (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    return lambda scores: scores.join(docs, F.col("doc") == F.col("doc_id")).join(own, "query").select("query", "doc", "score", F.coalesce(mine, F.lit(False)).alias("passes"))


def _tags(s, d):
    """(query, tag) and (doc, tag): language and source, null without either."""
    tag = F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.md5(F.to_json(F.struct("lang", "source")))).alias("tag")
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("doc"), tag)
    return docs.withColumnRenamed("doc", "query").join(V.table(s, d, "benchmark").select(F.col("item_id").alias("query")), "query", "left_semi"), docs


def _two_lists(s, d):
    marked = _wanted(s, d)
    index = I.text_index(s, d)
    items = V.table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    terms = R.with_fallback(marked(index.scores(index.asked(items))))
    store, v = vector_index(s, d)
    asked = v.join(items.select(F.col("query").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    own, tags = _tags(s, d)
    near = R.with_fallback(store.sides(asked, own, tags.withColumnRenamed("doc", "vec_id")).select("query", F.col("vec_id").alias("doc"), F.col("similarity").alias("score"), "passes"))
    return terms, near


def _hybrid(s, d):
    terms, near = _two_lists(s, d)
    return R.fused([terms, near])


def _fallbacks(s, d):
    lists = _two_lists(s, d)
    named = [x.select("query", F.lit(n).alias("list"), "filtered").distinct() for n, x in zip(("terms", "vectors"), lists, strict=True)]
    return named[0].union(named[1])


_ALL = I.BM25_SQL.replace("2.5 /", "2.5::DOUBLE /").rsplit("SELECT query, doc, score", 1)[0]
_HEAD = f"""{_ALL.rstrip()}, docs AS (SELECT doc_id, lang, source FROM documents), own AS (SELECT item_id AS query, lang, source FROM benchmark JOIN docs ON doc_id = item_id),
near AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id JOIN embeddings b ON a.vec_id <> b.vec_id),
both_lists AS (SELECT 'terms' AS list, * FROM s UNION ALL SELECT 'vectors', * FROM near),
marked AS (SELECT list, query, doc, score, coalesce(x.lang = own.lang AND x.source = own.source, false) AS passes FROM both_lists JOIN docs x ON doc = x.doc_id JOIN own USING (query)),
counted AS (SELECT *, count(*) FILTER (passes) OVER (PARTITION BY list, query) >= 3 AS filtered FROM marked),
ranked_lists AS (SELECT *, row_number() OVER (PARTITION BY list, query ORDER BY round(score, 6) DESC, doc) AS rank FROM counted WHERE passes OR NOT filtered QUALIFY rank <= 10)"""
add("hybrid_filtered", _hybrid, f"{_HEAD} SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lists, row_number() OVER (PARTITION BY query ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc)::INT AS rank FROM ranked_lists GROUP BY query, doc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc) <= 10", "score")
add("hybrid_fallbacks", _fallbacks, f"{_HEAD} SELECT DISTINCT query, list, filtered FROM ranked_lists")

# --- linking: what customers ordered, in words, with product codes


def order_texts(s, d):
    """(id, text) of every order: its customer, its products' names and codes."""
    part = V.table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("item"))
    items = V.table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("items"))
    who = V.table(s, d, "orders").select("o_orderkey", "o_custkey").join(V.table(s, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return who.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.concat("c_name", F.lit(" ordered: "), "items", F.lit(".")).alias("text"))


def aliases(s, d):
    """(alias, entity): product names, their last words, customers' names."""
    part, customer = V.table(s, d, "part"), V.table(s, d, "customer")
    names = part.select(F.col("p_name").alias("alias"), F.concat(F.lit("name:"), "p_name").alias("entity"))
    kinds = part.select(F.substring_index("p_name", " ", -1).alias("alias")).select("alias", F.concat(F.lit("kind:"), "alias"))
    return names.union(kinds).union(customer.select("c_name", F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")))).distinct()


_TEXTS = """order_texts AS (SELECT o_orderkey AS id, c_name || ' ordered: ' || items || '.' AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, string_agg(item, ', ' ORDER BY item) AS items
  FROM (SELECT l_orderkey, p_name || ' B0' || lpad(p_partkey::VARCHAR, 8, '0') AS item FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1) ON o_orderkey = l_orderkey)"""
add("linked_entities", lambda s, d: linking.linked(order_texts(s, d), aliases(s, d)).select("id", "start", "length", "entity"), f"""WITH {_TEXTS},
  known AS (SELECT DISTINCT lower(alias) AS alias, entity FROM (SELECT p_name AS alias, 'name:' || p_name AS entity FROM part UNION SELECT string_split(p_name, ' ')[-1], 'kind:' || string_split(p_name, ' ')[-1] FROM part UNION SELECT c_name, 'customer:' || c_custkey FROM customer)),
  w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}#]+') AS w FROM order_texts), g AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 5) t(n)),
  m AS (SELECT id, i, n, entity FROM g JOIN known ON alias = array_to_string(w[i : i + n - 1], ' '))
  SELECT id, i::INT AS start, n::INT AS length, entity FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.id = a.id AND b.n > a.n AND b.i <= a.i AND b.i + b.n >= a.i + a.n)""")
add("linked_codes", lambda s, d: linking.coded(order_texts(s, d), D.at_latest(V.shelf(s, d)).select(F.concat(F.lit("B0"), F.lpad(F.col("asin").cast("string"), 8, "0")).alias("code"), "rank")),
    f"WITH {V.SHELF_SQL}, {_TEXTS} SELECT id, code, rank FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, 'B0[A-Z0-9]{{8}}')) AS code FROM order_texts) LEFT JOIN (SELECT 'B0' || lpad(asin::VARCHAR, 8, '0') AS code, min(rank) AS rank FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf) GROUP BY 1) USING (code)")

# --- slots without a model


def _hits(s, d):
    hits = I.bm25(s, d)
    return hits.join(V.table(s, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question")), "query").join(V.table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")


add("reranked_hits", lambda s, d: slots.reranked(_hits(s, d)), f"SELECT query, doc, rank, rank AS place, 1 - 0.1::DOUBLE * (rank - 1) AS relevance FROM ({X.BM25}) WHERE rank <= 5", "relevance")
add("graded_hits", lambda s, d: _hits(s, d).where(slots.relevant(F.col("question"), F.col("content"))).groupBy("query").agg(F.count("*").alias("kept")), f"SELECT query, count(*) AS kept FROM ({X.BM25}) GROUP BY 1")
add("answer_similarity", lambda s, d: X._answers(s, d).select("conv_id", "turn", slots.similarity(F.col("text"), F.col("context"), R.tokens).alias("similarity")),
    f"SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat({X._F}, {X._G}))) = 0 THEN 0 ELSE {X.BOTH} / len(list_distinct(list_concat({X._F}, {X._G}))) END AS similarity FROM {X.ANSWERS}", "similarity")

# --- chunks of sentences: a label is a text, its vectors are sentences, 40 ids a chunk


def _units(s, d):
    return V.table(s, d, "embeddings").select(F.col("label").alias("doc"), F.floor(F.col("vec_id") / 40).cast("long").alias("chunk"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector"))


_UNITS = "(SELECT label AS doc, vec_id // 40 AS chunk, vec_id AS place, embedding AS vector, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)"
add("chunk_means", lambda s, d: T.chunk_means(_units(s, d)), f"SELECT doc, chunk, i::INT AS part, avg(vector[i + 1]::DOUBLE) AS mean FROM {_UNITS}, range(64) t(i) GROUP BY 1, 2, 3", "mean")
add("chunk_similarity", lambda s, d: T.chunk_similarity(_units(s, d)), f"SELECT doc, chunk, count(*) AS sentences, avg(list_cosine_similarity(vector::DOUBLE[], before::DOUBLE[])) AS similarity FROM {_UNITS} GROUP BY 1, 2", "similarity")

# --- what an insight adds to a question, and how an intent is searched

#: Kinds of insight with the words that they add, and indicators likewise; fixed values, in order.
ADDED = (
    (("market_position", "market_dominance"), "시장 포지션 해석"), (("risk_alert",), "위험 신호 대응"), (("competitive_threat",), "경쟁 위협 분석"),
    (("growth_opportunity", "growth_momentum"), "성장 기회 전략"), (("price_quality_gap", "price_position"), "가격 전략 해석"),
)
INDICATORS = (("sos", "SoS 점유율 해석"), ("hhi", "HHI 시장집중도 해석"), ("cpi", "CPI 가격지수 해석"))
KIND_OF = {"view": "market_position", "click": "growth_opportunity", "purchase": "price_position", "signup": "growth_momentum", "error": "risk_alert"}
INDICATOR_OF = {"view": "sos", "purchase": "cpi"}


def _kinds(s, d):
    """(user, kinds, indicators): a user's events stand for insights."""
    named = lambda m: F.create_map(*(F.lit(x) for p in m.items() for x in p))[F.col("event_type")]
    return V.table(s, d, "events").where("value > 60").groupBy("user_id").agg(F.collect_set(named(KIND_OF)).alias("kinds"), F.collect_set(named(INDICATOR_OF)).alias("indicators"))


def _case(m):
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in m.items()) + " END"


_WORDS = ", ".join(f"CASE WHEN list_has_any(kinds, {X.listed(k)}) THEN '{w}' END" for k, w in ADDED) + ", " + ", ".join(f"CASE WHEN list_contains(indicators, '{i}') THEN '{w}' END" for i, w in INDICATORS)
add("insight_expansion", lambda s, d: _kinds(s, d).select("user_id", T.expanded_by_insight(F.lit("why"), F.col("kinds"), F.col("indicators"), ADDED, INDICATORS).alias("question")),
    f"SELECT user_id, array_to_string(list_concat(['why'], list_filter([{_WORDS}], lambda x: x IS NOT NULL)), ' ') AS question FROM (SELECT user_id, list(DISTINCT {_case(KIND_OF)}) AS kinds, coalesce(list(DISTINCT {_case(INDICATOR_OF)}) FILTER ({_case(INDICATOR_OF)} IS NOT NULL), []) AS indicators FROM events WHERE value > 60 GROUP BY 1)")

#: How an intent is searched: weights of graph, documents and inferences, number of
#: documents, their types and the fusion; fixed values.
STRATEGIES = (
    ("diagnosis", 0.5, 0.3, 0.2, 5, "playbook,metric_guide,intelligence", "weighted_sum"), ("competitive", 0.5, 0.25, 0.25, 5, "intelligence,playbook", "weighted_sum"), ("general", 0.3, 0.5, 0.2, 5, None, "weighted_sum"),
    ("definition", 0.2, 0.6, 0.2, 5, "metric_guide,playbook", "weighted_sum"), ("data_query", 0.4, 0.4, 0.2, 5, None, "weighted_sum"), ("interpretation", 0.3, 0.5, 0.2, 5, "metric_guide,playbook", "weighted_sum"),
    ("analysis", 0.3, 0.3, 0.4, 5, "intelligence,playbook,metric_guide", "geometric_mean"), ("insight_rule", 0.25, 0.35, 0.4, 5, "intelligence,knowledge_base", "geometric_mean"),
    ("trend", 0.35, 0.35, 0.3, 7, "intelligence,knowledge_base,response_guide", "harmonic_mean"), ("crisis", 0.35, 0.4, 0.25, 7, "response_guide,intelligence,playbook", "harmonic_mean"),
    ("metric", 0.4, 0.4, 0.2, 5, "metric_guide,playbook", "weighted_sum"), ("combination", 0.35, 0.35, 0.3, 7, "playbook,metric_guide", "harmonic_mean"),
)
#: For intents without a strategy.
DEFAULT = "general"
NAMED = {"trend": "trend", "compare": "competitive", "price": "metric", "why": "diagnosis", "definition": "definition", "general": "small talk"}


def _strategies(s, d):
    """Every turn with the strategy of its intent; an intent without one gets the default."""
    table = F.broadcast(s.createDataFrame(STRATEGIES, "strategy string, kg double, rag double, inference double, top_k int, types string, fusion string"))  # twelve rows
    names = F.create_map(*(F.lit(x) for p in NAMED.items() for x in p))
    known = F.array(*(F.lit(x[0]) for x in STRATEGIES))
    turns = V.table(s, d, "conversations").select("conv_id", "turn", names[R.intent(F.col("text"))].alias("intent"))
    return turns.withColumn("strategy", F.when(F.array_contains(known, F.col("intent")), F.col("intent")).otherwise(DEFAULT)).join(table, "strategy").drop("intent")


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::INT" for v in row) + ")" for row in STRATEGIES)
add("retrieval_strategies", _strategies, f"SELECT conv_id, turn, strategy, kg, rag, inference, top_k, types, fusion FROM (SELECT conv_id, turn, CASE {I.INTENT} " + " ".join(f"WHEN '{a}' THEN '{b if b != 'small talk' else 'general'}'" for a, b in NAMED.items()) + f" END AS strategy FROM conversations) JOIN (VALUES {_VALUES}) v(strategy, kg, rag, inference, top_k, types, fusion) USING (strategy)")
