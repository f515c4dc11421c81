"""Text, fusion and evaluation queries with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import evaluation as E
from shelfloom.operators import retrieval as R
from shelfloom.operators import rules as N
from shelfloom.operators import texts as T
from shelfloom.sources import views as V
from shelfloom.sources.tables import dealt

from . import insight as I

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql=None, doubles=""):
    """Register a plan over (spark, folder); doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) for c in cols})
    if sql:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in cols)}) FROM ({sql})" if cols else sql


def on(name):
    return lambda plan: lambda spark, sf: plan(V.table(spark, sf, name))


def listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def count_of(words, c="text"):
    return "(" + " + ".join(f"contains(lower({c}), '{w}')::INT" for w in words) + ")"


# --- splitting

add("section_chunks", on("documents")(lambda d: T.sections(d).groupBy("id", "kind").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))))
STRIPPED = r"list_filter(list_transform(string_split({t}, E'\n\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def packed_sql(rows, size):
    """Parts (key, part, content) of rows (key, p), p the pieces of a text, taken one
    after another; ``part`` is the open part's number, ``chunk`` the part of the piece."""
    return f"""(WITH RECURSIVE pieces AS (SELECT key, unnest(p) AS piece, generate_subscripts(p, 1)::BIGINT AS i FROM ({rows})), sized AS (SELECT *, length(piece) AS n FROM pieces),
  r AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS chunk, 0::BIGINT AS part, 0::BIGINT AS used FROM sized
    UNION ALL SELECT s.key, s.i, CASE WHEN used + n + 2 <= {size} THEN part ELSE part + (used > 0)::INT END,
      CASE WHEN used + n + 2 <= {size} THEN part WHEN n <= {size} THEN part + (used > 0)::INT ELSE part + (used > 0)::INT + (n + {size - 1}) // {size} END,
      CASE WHEN used + n + 2 <= {size} THEN used + n + 2 * (used > 0)::INT WHEN n <= {size} THEN n ELSE 0 END FROM r JOIN sized s ON s.key = r.key AND s.i = r.i + 1),
  placed AS (SELECT key, i, chunk, piece, n FROM r JOIN sized USING (key, i))
  SELECT key, chunk::INT AS part, string_agg(piece, E'\n\n' ORDER BY i) AS content FROM placed WHERE n <= {size} GROUP BY 1, 2
  UNION ALL SELECT key, (chunk + x)::INT, substring(piece, x * {size} + 1, {size}) FROM placed, range((n + {size - 1}) // {size}) t(x) WHERE n > {size})"""


add("packed_paragraphs", on("documents")(lambda d: d.select("doc_id", F.posexplode(T.packed(F.regexp_replace("text", "\n", "\n\n"), 500)).alias("part", "content")).select("doc_id", "part", F.sha2("content", 256).alias("digest"))),
    "SELECT key AS doc_id, part, sha256(content) AS digest FROM " + packed_sql("SELECT doc_id AS key, " + STRIPPED.format(t="replace(text, E'\n', E'\n\n')") + " AS p FROM documents", 500))
SENT = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([^0-9A-Z])([.!?])\\s+', '\\1\\2\n', 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"
add("sentences", on("benchmark")(lambda d: d.select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("number", "sentence"))), f"SELECT item_id, unnest(range(len(s)))::INT AS number, unnest(s) AS sentence FROM (SELECT item_id, {SENT} AS s FROM benchmark)")
add("overlapping_chunks", on("documents")(lambda d: d.select("doc_id", F.posexplode(T.overlapping(T.sentences(F.col("text")), 1000)).alias("part", "content")).select("doc_id", "part", F.sha2("content", 256).alias("digest"))),
    f"""WITH RECURSIVE docs AS (SELECT doc_id, {SENT} AS s FROM documents), s AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::BIGINT AS i FROM docs), sized AS (SELECT *, length(sentence) AS n FROM s),
  r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS part, 0::BIGINT AS used, 0::BIGINT AS before FROM sized
    UNION ALL SELECT x.doc_id, x.i, part + (used > 0 AND used + n > 1000)::INT, CASE WHEN used > 0 AND used + n > 1000 THEN before + n + 2 ELSE used + n + 1 END, n FROM r JOIN sized x ON x.doc_id = r.doc_id AND x.i = r.i + 1),
  own AS (SELECT doc_id, i, part, sentence, lead(part) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM r JOIN sized USING (doc_id, i))
  SELECT doc_id, part::INT AS part, sha256(string_agg(sentence, ' ' ORDER BY i)) AS digest FROM (SELECT doc_id, i, part, sentence FROM own UNION ALL SELECT doc_id, i, next, sentence FROM own WHERE next > part) GROUP BY 1, 2""")



def _reports(s, d):
    """A report of every customer's orders: a section with a table for each status."""
    o, n = V.table(s, d, "orders"), F.lit("\n")
    line = F.struct("o_orderkey", F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(" |")).alias("line"))
    per = o.groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    status = F.col("o_orderstatus")
    body = F.concat(F.lit("## Status "), status, n, F.lit("Orders as of now."), n, n, F.lit("**Orders "), status, F.lit("**"), n, F.lit("| key | cents |"), n, F.lit("| --- | --- |"), n, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), n)
    texts = per.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(status, body.alias("body")))).alias("all"))
    return texts.select(F.col("o_custkey").alias("doc_id"), F.array_join(F.transform("all", lambda x: x["body"]), "\n").alias("text"))


add("report_sections", lambda s, d: T.sections(_reports(s, d)).withColumn("digest", F.sha2("content", 256)).drop("content"),
    """WITH t AS (SELECT o_custkey AS id, o_orderstatus AS s, string_agg('| ' || o_orderkey || ' | ' || round(o_totalprice * 100)::BIGINT || ' |', chr(10) ORDER BY o_orderkey) AS lines FROM orders GROUP BY 1, 2),
  n AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INT AS section FROM t)
  SELECT id, 'table' AS kind, section, 0 AS part, 'Orders ' || s AS title, sha256('| key | cents |' || chr(10) || '| --- | --- |' || chr(10) || lines) AS digest FROM n
  UNION ALL SELECT id, 'text', section, 0, 'Status ' || s, sha256(CASE WHEN section = 0 THEN '## ' ELSE '' END || 'Status ' || s || chr(10) || 'Orders as of now.' || chr(10) || chr(10) || '**Orders ' || s || '**') FROM n""")

# --- search and fusion


def _asked(s, d):
    return V.table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text")


BM25 = I.BM25_SQL.replace("2.5 /", "2.5::DOUBLE /")
add("bm25_over_best", lambda s, d: R.over_best(I.bm25(s, d)).select("query", "doc", "score"), f"SELECT query, doc, score / max(score) OVER (PARTITION BY query) AS score FROM ({BM25})", "score")
LISTS = I.LISTS


def _named_lists(s, d):
    a, b = I._lists(s, d)
    text = lambda rows: rows.select(F.lit(1).alias("query"), F.concat(F.lit("item "), F.col("item") % 60).alias("content"), "rank")
    return {"often": text(a), "much": text(b)}


add("fused_lists", lambda s, d: R.fused_lists(_named_lists(s, d), "query", "content"),
    LISTS + """, f AS (SELECT substr(sha256('item ' || item % 60), 1, 16) AS hash, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
      FROM (SELECT *, 'often' AS source FROM a UNION ALL SELECT *, 'much' FROM b) GROUP BY 1)
    SELECT 1 AS query, hash, score, sources, row_number() OVER (ORDER BY score DESC, hash)::INT AS rank FROM f QUALIFY rank <= 10""", "score")


def _hits(s, d):
    kind = F.when(F.col("event_type") == "view", "vector").when(F.col("event_type") == "click", "ontology").otherwise("entity")
    return V.table(s, d, "events").select("user_id", kind.alias("source"), (F.col("value") / 80).alias("score"))


HITS = "(SELECT user_id, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'ontology' ELSE 'entity' END AS source, value / 80 AS score FROM events)"
add("source_scores", lambda s, d: R.source_scores(_hits(s, d), "user_id"),
    f"SELECT user_id, source, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY score DESC) AS n FROM {HITS} WHERE score BETWEEN 0 AND 1) WHERE source = 'entity' OR n <= CASE source WHEN 'vector' THEN 3 ELSE 1 END GROUP BY 1, 2", "score")
TYPES = "SELECT event_type, event_id % 50 AS part, avg(value) AS value FROM events GROUP BY 1, 2"


def _types(s, d):
    return V.table(s, d, "events").groupBy("event_type", (F.col("event_id") % 50).alias("part")).agg(F.avg("value").alias("value"))


add("softmax_scores", lambda s, d: R.normalised(_types(s, d), "event_type", "value", "softmax"), f"SELECT event_type, part, exp(value - max(value) OVER w) / sum(exp(value - m)) OVER w AS value FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM ({TYPES})) WINDOW w AS (PARTITION BY event_type)", "value")
add("z_scores", lambda s, d: R.normalised(_types(s, d), "event_type", "value", "z"), f"SELECT event_type, part, CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN 1 / (1 + exp(-(value - avg(value) OVER w) / stddev_pop(value) OVER w)) ELSE 0.5 END AS value FROM ({TYPES}) WINDOW w AS (PARTITION BY event_type)", "value")


def _merged(s, d):
    e = V.table(s, d, "events").select("user_id", F.col("event_id").alias("item"), "event_type", (F.col("value") / 100).alias("score"))
    kinds = {"facts": ("view", 1.0, 5), "chunks": ("click", 0.8, 3), "inferences": ("purchase", 0.6, 5)}
    return R.weighted_merge({k: (e.where(F.col("event_type") == t), w, n) for k, (t, w, n) in kinds.items()}, "user_id")


add("weighted_merge", _merged, " UNION ALL ".join(f"SELECT user_id, '{k}' AS kind, event_id AS item, value / 100 * {w}::DOUBLE AS score FROM events WHERE event_type = '{t}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= {n}" for k, t, w, n in (("facts", "view", 1.0, 5), ("chunks", "click", 0.8, 3), ("inferences", "purchase", 0.6, 5))), "score")

# --- questions

GROUPS = {"trend": {"keywords": ["trend", "over"], "indicators": ["rate"]}, "fact": {"keywords": ["what"], "patterns": ["is"], "entities": ["data"]}, "how": {"keywords": ["how"], "patterns": ["do", "can"]}}
_W = {"keywords": 2.0, "indicators": 1.5, "patterns": 1.0, "entities": 1.5}
SCORES = {n: "(" + " + ".join(f"{count_of(ws)} * {_W[k]}::DOUBLE" for k, ws in g.items()) + ")" for n, g in GROUPS.items()}
BEST = f"greatest({', '.join(SCORES.values())}, 0)"
add("query_types", on("conversations")(lambda c: c.select("conv_id", "turn", T.query_type(F.col("text"), GROUPS).alias("q")).select("conv_id", "turn", "q.*").withColumn("level", T.score_level(F.col("score")))),
    f"SELECT conv_id, turn, CASE WHEN best < 1.5 THEN 'unknown' {' '.join(f'WHEN {s} = best THEN {n!r}' for n, s in SCORES.items())} END AS type, CASE WHEN best >= 1.5 THEN best / ({' + '.join(SCORES.values())}) ELSE 0 END AS confidence, best AS score, CASE WHEN best >= 5 THEN 'high' WHEN best >= 3 THEN 'medium' WHEN best >= 1.5 THEN 'low' ELSE 'unknown' END AS level FROM (SELECT *, {BEST} AS best FROM conversations)", "confidence")
SYNONYMS = {"price": ["cost", "charge", "fee"], "data": ["records", "figures"], "how": ["in what way"]}
OFFERS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') AND NOT contains(lower(text), '{s}') THEN '{s}' END" for k, ss in SYNONYMS.items() for s in ss[:2]) + "], lambda x: x IS NOT NULL)[1:3]"
add("expanded_queries", on("conversations")(lambda c: c.select("conv_id", "turn", F.sha2(T.expanded(F.col("text"), SYNONYMS), 256).alias("digest"))), f"SELECT conv_id, turn, sha256(CASE WHEN len(o) > 0 THEN text || ' (' || array_to_string(o, ', ') || ')' ELSE text END) AS digest FROM (SELECT *, {OFFERS} AS o FROM conversations)")
TERMS = {"the": ["report"], "a": ["study", "model"]}
_O = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') AND NOT contains(lower(text), '{w}') THEN '{w}' END" for k, ws in TERMS.items() for w in ws[:2]) + "], lambda x: x IS NOT NULL)[1:3]"
_MORE = f"(SELECT item_id, CASE WHEN len({_O}) > 0 THEN text || ' (' || array_to_string({_O}, ', ') || ')' ELSE text END AS text FROM benchmark)"
add("hybrid_search", lambda s, d: R.hybrid(_asked(s, d), I.text_index(s, d).search, lambda c: T.expanded(c, TERMS)),
    f"""SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lists, row_number() OVER (PARTITION BY query ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc)::INT AS rank
    FROM (SELECT query, doc, rank AS rank FROM ({BM25}) UNION ALL SELECT query, doc, rank FROM ({BM25.replace('FROM benchmark', 'FROM ' + _MORE)})) GROUP BY query, doc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc) <= 10""", "score")
COMPLEX = ["why", "how", "compare", "because"]
add("query_complexity", on("conversations")(lambda c: c.groupBy(T.complexity(F.col("text"), COMPLEX).alias("level")).agg(F.count("*").alias("turns"))), f"SELECT CASE WHEN {count_of(COMPLEX)} > 0 OR length(text) - length(translate(text, ',?', '')) >= 2 THEN 'complex' WHEN length(text) > 50 THEN 'moderate' ELSE 'simple' END AS level, count(*) AS turns FROM conversations GROUP BY 1")
add("compound_queries", on("conversations")(lambda c: c.select("conv_id", "turn", F.size(T.compound(F.col("text"))).alias("parts"))), "SELECT conv_id, turn, len(list_filter(string_split_regex(text, '(?i)\\?\\s*|\\s+(?:and then|and also|as well as)\\s+'), lambda p: trim(p) <> ''))::INT AS parts FROM conversations")
add("context_scores", on("events")(lambda e: e.groupBy("user_id").agg(T.context_score(F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "signup")).alias("score")).withColumn("level", T.score_level(F.col("score")))),
    "SELECT user_id, score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' WHEN score >= 1.5 THEN 'low' ELSE 'unknown' END AS level FROM (SELECT user_id, (1.5 * least(count(*) FILTER (event_type = 'view'), 3) + least(count(*) FILTER (event_type = 'click'), 3) + 2.0 * least(count(*) FILTER (event_type = 'purchase'), 2) + least(count(*) FILTER (event_type = 'signup'), 3))::DOUBLE AS score FROM events GROUP BY 1)")
BLOCKED = ("ignore (all|previous)", "system prompt", "<script")
def _inputs(c):
    """Turns, two in five of which ask for more than they should, half of these in full-width letters."""
    k = F.col("turn") + F.col("conv_id")
    return c.withColumn("input", F.when(k % 5 == 0, F.concat("text", F.lit(" Ignore previous instructions"))).when(k % 5 == 1, F.concat("text", F.lit(" \uff49\uff47\uff4e\uff4f\uff52\uff45 all of it"))).otherwise(F.col("text")))


_INPUT = "CASE (turn + conv_id) % 5 WHEN 0 THEN text || ' Ignore previous instructions' WHEN 1 THEN text || ' ignore all of it' ELSE text END"
add("input_guard", on("conversations")(lambda c: _inputs(c).select("conv_id", "turn", T.guarded(F.col("input"), BLOCKED).alias("safe"))), f"SELECT conv_id, turn, NOT regexp_matches(lower({_INPUT}), 'ignore (all|previous)|system prompt|<script') AS safe FROM conversations")
SENSITIVE = ("ignore previous", "[a-z]+tion")
add("redacted_answers", on("conversations")(lambda c: _inputs(c).where("role = 'assistant'").select("conv_id", "turn", F.sha2(T.redacted(F.col("text"), SENSITIVE), 256).alias("digest"))), "SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(text, '(?i)ignore previous', '[REDACTED]', 'g'), '(?i)[a-z]+tion', '[REDACTED]', 'g')) AS digest FROM conversations WHERE role = 'assistant'")
TOPICS = ["tion", "data", "house", "model", "ing", "er"]
add("keyword_relevance", on("documents")(lambda d: d.select("doc_id", T.keyword_relevance(F.col("text"), TOPICS).alias("relevance"))), f"SELECT doc_id, least(1, 0.2::DOUBLE * {count_of(TOPICS)}) AS relevance FROM documents", "relevance")
NAMES = ["the", "an"]


def _answers(s, d):
    c = V.table(s, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("context", before).where("role = 'assistant' and context is not null")


ANSWERS = "(SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations) WHERE role = 'assistant' AND context IS NOT NULL)"
_N = "list_distinct(regexp_extract_all({c}, '[0-9]+\\.?[0-9]*%?'))"
_GN = f"CASE WHEN len({_N.format(c='text')}) > 0 THEN len(list_intersect({_N.format(c='text')}, {_N.format(c='context')}))::DOUBLE / len({_N.format(c='text')}) END"
_GB = f"CASE WHEN {count_of(NAMES)} > 0 THEN ({' + '.join(f'(contains(lower(text), {n!r}) AND contains(lower(context), {n!r}))::INT' for n in NAMES)})::DOUBLE / {count_of(NAMES)} END"
add("grounding", lambda s, d: _answers(s, d).select("conv_id", "turn", T.grounding(F.col("text"), F.col("context"), NAMES).alias("score")), f"SELECT conv_id, turn, coalesce(list_avg(list_filter([{_GN}, {_GB}], lambda x: x IS NOT NULL)), 1) AS score FROM {ANSWERS}", "score")
_TOK = "list_distinct(" + I.TOK.replace("text", "{c}") + ")"
add("citation_overlap", lambda s, d: _answers(s, d).select("conv_id", "turn", T.overlap_ratio(F.col("text"), F.col("context"), R.tokens).alias("ratio")).withColumn("cited", F.col("ratio") >= 0.15),
    f"SELECT conv_id, turn, ratio, ratio >= 0.15::DOUBLE AS cited FROM (SELECT conv_id, turn, CASE WHEN len({_TOK.format(c='text')}) = 0 THEN 0 ELSE len(list_intersect({_TOK.format(c='text')}, {_TOK.format(c='context')}))::DOUBLE / len({_TOK.format(c='text')}) END AS ratio FROM {ANSWERS})", "ratio")
REL = {"view": 0.9, "click": 0.8}
RELC = "CASE event_type WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.8 ELSE 0.7 END::DOUBLE"


def _signals(s, d):
    reliability = F.coalesce(F.create_map(*(F.lit(x) for p in REL.items() for x in p))[F.col("event_type")], F.lit(0.7))
    e = V.table(s, d, "events").withColumn("score", 0.6 * reliability + 0.4 * F.col("value") / 100)
    return T.first_of(e, ["user_id", "props"], [F.desc("score"), F.col("event_id")]).select("event_id", "user_id", "score")


add("ranked_signals", _signals, f"SELECT event_id, user_id, score FROM (SELECT *, 0.6::DOUBLE * {RELC} + 0.4::DOUBLE * value / 100 AS score FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY score DESC, event_id) = 1", "score")
add("numbered_sources", on("events")(lambda e: T.numbered_sources(e, ["event_type", "props"], ["user_id", "ts", "event_id"]).select("user_id", "event_type", "props", "number")), "SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY min(struct_pack(ts, event_id)))::INT AS number FROM events GROUP BY 1, 2, 3")
add("suppressed_errors", on("events")(lambda e: T.suppressed(e.where("event_type = 'error'"), ["event_type"], "ts", 3600, 3).select("event_id")), "SELECT event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) <= 3")

INTENTS = [(["how", "why"], ["cause", "advice"]), (["data", "model"], ["fact"]), (["what"], ["fact", "cause"])]
_K = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {count_of(w)} > 0 THEN {listed(k)} ELSE [] END" for w, k in INTENTS) + "])))"
add("asked_kinds", on("conversations")(lambda c: c.groupBy(F.array_join(T.allowed_kinds(F.col("text"), INTENTS), ",").alias("kinds")).agg(F.count("*").alias("turns"))), f"SELECT CASE WHEN len({_K}) > 0 THEN array_to_string({_K}, ',') END AS kinds, count(*) AS turns FROM conversations GROUP BY 1")
add("reference_types", on("pages")(lambda p: p.groupBy(T.reference_type(F.when(F.col("page_id") % 10 == 0, "t1"), F.col("url"), {"t1": "official"}, [("blog", "blog"), ("/fr/", "foreign")]).alias("kind")).agg(F.count("*").alias("n"))), "SELECT CASE WHEN page_id % 10 = 0 THEN 'official' WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), '/fr/') THEN 'foreign' ELSE 'article' END AS kind, count(*) AS n FROM pages GROUP BY 1")
add("extracted_terms", on("documents")(lambda d: d.select("doc_id", F.array_join(T.extracted(F.col("text"), "([A-Z][a-z]+)"), ",").alias("terms"))), "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '([A-Z][a-z]+)', 1), lambda x, i: length(x) >= 3 AND list_position(regexp_extract_all(text, '([A-Z][a-z]+)', 1), x) = i)[1:10], ',') AS terms FROM documents")
add("mean_vectors", on("embeddings")(lambda e: T.mean_vectors(e, "label", "embedding").select("label", F.posexplode("mean").alias("place", "mean"))), "SELECT label, place::INT AS place, avg(x) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2", "mean")

# --- evaluation

add("mentioned_names", lambda s, d: _answers(s, d).select("conv_id", "turn", T.mentioned_recall(F.col("text"), F.array(*map(F.lit, ("the", "an", "data")))).alias("recall")), "SELECT conv_id, turn, (" + " + ".join(f"contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' {w} ')::INT" for w in ("the", "an", "data")) + f") / 3.0::DOUBLE AS recall FROM {ANSWERS}", "recall")

def _sets(s, d):
    a = _answers(s, d)
    return a.select("conv_id", "turn", "text", "context", R.tokens(F.col("text")).alias("found"), R.tokens(F.col("context")).alias("gold"))


_F, _G = f"list_distinct({I.TOK})", f"list_distinct({I.TOK.replace('text', 'context')})"
BOTH = f"len(list_intersect({_F}, {_G}))::DOUBLE"
add("set_precision_recall", lambda s, d: _sets(s, d).select("conv_id", "turn", E.set_precision(F.col("found"), F.col("gold")).alias("precision"), E.set_recall(F.col("found"), F.col("gold")).alias("recall")),
    f"SELECT conv_id, turn, CASE WHEN len({_F}) = 0 THEN (len({_G}) = 0)::INT ELSE {BOTH} / len({_F}) END AS precision, CASE WHEN len({_G}) = 0 THEN 1 ELSE {BOTH} / len({_G}) END AS recall FROM {ANSWERS}", "precision recall")
_AW = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))"
_A, _B = _AW.format(c="text"), _AW.format(c="context")
_I = f"len(list_intersect({_A}, {_B}))::DOUBLE"
# a third of the answers is compared with itself in other punctuation
_GOLD = "CASE WHEN conv_id % 3 = 0 THEN ' ' || text || '!' ELSE context END"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _judged(a):
    gold = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" "), "text", F.lit("!"))).otherwise(F.col("context"))
    return a.select("conv_id", "turn", E.token_f1(F.col("text"), F.col("context")).alias("f1"), E.stub_judge(F.col("text"), F.col("context")).alias("judged"), E.exact_match(F.col("text"), gold).alias("same"))


add("answer_scores", lambda s, d: _judged(_sets(s, d)),
    f"SELECT conv_id, turn, CASE WHEN context = '' OR len({_A}) + len({_B}) = 0 THEN 1 ELSE 2 * {_I} / (len({_A}) + len({_B})) END AS f1, 0.3::DOUBLE + 0.4::DOUBLE * CASE WHEN len({_A}) = 0 THEN 0 ELSE {_I} / len({_A}) END AS judged, ({_PLAIN.format(c='text')} = {_PLAIN.format(c=_GOLD)})::INT::DOUBLE AS same FROM {ANSWERS}", "f1 judged")
add("numeric_accuracy", on("benchmark")(lambda b: b.select("item_id", E.numeric_accuracy(F.concat(F.lit("values 98 and "), (F.col("item_id") * 10).cast("string")), F.array(F.lit(100.0), F.lit(200.0))).alias("accuracy"))), "SELECT item_id, (1 + (abs(item_id * 10 - 200) <= 10)::INT) / 2.0::DOUBLE AS accuracy FROM benchmark", "accuracy")


def _items(s, d):
    o = V.table(s, d, "orders").withColumn("x", F.col("o_orderkey") % 100 / 100.0)
    return o.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("kg"), F.col("x").alias("entity_link_f1"), (1 - F.col("x")).alias("context_recall"), F.col("x").alias("hits"), (F.col("x") / 10).alias("violation_rate"), F.when(F.col("o_orderkey") % 3 == 0, F.col("x")).alias("groundedness"))


_X = "(o_orderkey % 100 / 100.0::DOUBLE)"
TAGS = f"unnest(list_filter([CASE WHEN {_X} < 0.5::DOUBLE THEN 'L1_mapping_fail' END, CASE WHEN o_orderkey % 2 <> 0 AND 1 - {_X} < 0.8::DOUBLE THEN 'L2_doc_retrieval_fail' END, CASE WHEN o_orderkey % 2 = 0 AND {_X} < 0.8::DOUBLE THEN 'L3_kg_fail' END, CASE WHEN {_X} / 10 > 0.05::DOUBLE THEN 'L4_constraint_violation' END, CASE WHEN o_orderkey % 3 = 0 AND {_X} < 0.7::DOUBLE THEN 'L5_grounding_fail' END], lambda x: x IS NOT NULL))"
add("fail_tags", lambda s, d: (lambda i: i.select(F.explode(E.fail_tags(i, F.col("kg"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("items")))(_items(s, d)), f"SELECT tag, count(*) AS items FROM (SELECT {TAGS} AS tag FROM orders) GROUP BY 1")
add("layer_costs", on("lineitem")(lambda i: E.costs(i.withColumn("tokens", F.col("l_quantity").cast("long")), {"N": 0.5, "R": 2.0}, "l_linenumber", "l_returnflag", "tokens")), "SELECT l_linenumber, sum(l_quantity::BIGINT * CASE l_returnflag WHEN 'N' THEN 0.5::DOUBLE WHEN 'R' THEN 2.0::DOUBLE END) / 1000 AS cost, sum(l_quantity::BIGINT)::BIGINT AS tokens, count(*) FILTER (l_returnflag = 'A') AS unpriced FROM lineitem GROUP BY 1", "cost")
add("last_figures", on("events")(lambda e: E.last_figures(e, "user_id", ["ts", "event_id"], "value")), "SELECT user_id, count(*) AS n, avg(value) AS mean, min(value) AS least FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1", "mean")

# --- scalars

KEYS = list(X.BRAND_NAMES)
FULL = list(X.BRAND_NAMES.values())


def _listing(p):
    """Parts with shortened brands, full names in some titles, and others."""
    i = F.col("p_partkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    brand = F.when(i % 3 == 0, F.concat(F.lit(" "), F.upper(pick(KEYS)))).when(i % 7 == 0, "Unknown").otherwise(F.col("p_brand"))
    return p.select("p_partkey", brand.alias("brand"), F.when(i % 5 == 0, F.concat(F.lit("New "), F.upper(pick(FULL)))).otherwise(F.col("p_name")).alias("title"))


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TITLED = " ".join(f"WHEN contains(lower(title), '{w.lower().replace(chr(39), chr(39) * 2)}') THEN '{w.replace(chr(39), chr(39) * 2)}'" for w in FULL)
LISTING = f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' || upper({_sql_list(KEYS)}[p_partkey % {len(KEYS)} + 1]) WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE p_brand END AS brand, CASE WHEN p_partkey % 5 = 0 THEN 'New ' || upper({_sql_list(FULL)}[p_partkey % {len(FULL)} + 1]) ELSE p_name END AS title FROM part"
add("normal_brands", on("part")(lambda p: _listing(p).select("p_partkey", X.normal_brand(F.col("brand"), F.col("title")).alias("brand"))),
    f"SELECT p_partkey, CASE WHEN brand IN ('', 'Unknown') THEN brand ELSE coalesce({_sql_list(FULL)}[list_position({_sql_list(KEYS)}, lower(trim(brand)))], CASE {TITLED} END, brand) END AS brand FROM ({LISTING})")
add("brand_and_type", on("part")(lambda p: p.select("p_partkey", X.brand_of(F.col("p_name"), ["red", "blue", "ring"]).alias("brand"), X.product_type(F.concat("p_name", F.lit(" lip balm cream")), X.PRODUCT_TYPES).alias("kind"))), "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'blue') THEN 'blue' WHEN contains(lower(p_name), 'ring') THEN 'ring' ELSE 'Unknown' END AS brand, 'lip_balm' AS kind FROM part")
add("parsed_prices", on("part")(lambda p: p.select("p_partkey", X.price(F.concat(F.lit("now $"), F.format_number("p_retailprice", 2)), 0.5, 950).alias("price"), X.review_count(F.concat(F.format_number(F.col("p_partkey") * 1000, 0), F.lit(" ratings"))).alias("reviews"), X.safe_int(F.col("p_size").cast("string")).alias("size"))),
    "SELECT p_partkey, CASE WHEN round(p_retailprice, 2) BETWEEN 0.5 AND 950 THEN round(p_retailprice, 2) END AS price, CASE WHEN p_partkey * 1000 <= 1000000 THEN p_partkey * 1000 END AS reviews, p_size::BIGINT AS size FROM part")
add("converted_prices", on("orders")(lambda o: o.select("o_orderkey", X.converted(F.col("o_totalprice"), F.col("o_orderstatus"), {"F": 1.0, "O": 0.5}).alias("amount"))), "SELECT o_orderkey, o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE END AS amount FROM orders", "amount")


def _statements(s, d):
    """Statements in words for every customer: what all orders, the open ones and the urgent ones come to, in an order that changes with the customer."""
    o = V.table(s, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    some = lambda w: F.coalesce(F.sum(F.when(w, cents)), F.lit(0)) / 100000
    per = o.groupBy("o_custkey").agg((F.sum(cents) / 100000).alias("all"), some(F.col("o_orderstatus") == "O").alias("open"), some(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count("*").alias("n"))
    say = lambda c: F.format_string("%.1f", F.round(c, 1))
    one = F.concat(F.lit("Net Profit: "), say(F.col("urgent")), F.lit("B. "))
    two = F.concat(F.lit("Revenue: "), say(F.col("all")), F.lit(" billion, "), F.when(F.col("n") % 2 == 0, "+").otherwise("-"), F.col("n").cast("string"), F.lit(".5% YoY. "))
    three = F.concat(F.lit("operating income "), say(F.col("open")), F.lit(" Billion. "))
    k = F.col("o_custkey") % 3
    return per.select("o_custkey", F.when(k == 0, F.concat(one, two, three)).when(k == 1, F.concat(three, one, two)).otherwise(F.concat(two, F.lit("Taxes: 9.9 billion. "))).alias("text"))


_PER = "SELECT o_custkey, sum(c) / 100000.0::DOUBLE AS a, coalesce(sum(c) FILTER (o_orderstatus = 'O'), 0) / 100000.0::DOUBLE AS b, coalesce(sum(c) FILTER (o_orderpriority = '1-URGENT'), 0) / 100000.0::DOUBLE AS u, count(*) AS n FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c FROM orders) GROUP BY 1"
add("financial_figures", lambda s, d: _statements(s, d).select("o_custkey", X.figures(F.col("text")).alias("f")).select("o_custkey", "f.*"),
    f"SELECT o_custkey, round(a, 1) AS revenue, CASE WHEN o_custkey % 3 < 2 THEN round(b, 1) END AS operating_profit, CASE WHEN o_custkey % 3 < 2 THEN round(u, 1) END AS net_income, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * (n + 0.5::DOUBLE) AS revenue_yoy FROM ({_PER})", "revenue operating_profit net_income revenue_yoy")
add("recent_change", on("orders")(lambda o: X.recent_change(o, "o_custkey", ["o_orderkey"], "o_totalprice")), "SELECT o_custkey, CASE WHEN len(v) >= 2 THEN (v[-1] - v[1]) / v[1] END AS change FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey)[-4:] AS v FROM orders GROUP BY 1)", "change")
add("hashtags", on("part")(lambda p: p.select("p_partkey", F.array_join(X.hashtags(F.concat(F.lit("#"), F.regexp_replace("p_name", " ", " #"))), ",").alias("tags"))), "SELECT p_partkey, replace(p_name, ' ', ',') AS tags FROM part")
add("run_rates", on("events")(lambda e: e.groupBy("user_id").agg((1 - F.count_if(F.col("event_type") == "error") / F.count("*")).alias("success_rate"), F.avg("value").alias("mean_value"))), "SELECT user_id, 1 - count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS success_rate, avg(value) AS mean_value FROM events GROUP BY 1", "success_rate mean_value")
add("merged_actions", lambda s, d: N.top_actions(I.context(s, d), I.KEYS, 10).groupBy("brand", "origin").agg(F.count("*").alias("n")),
    I.RULE_SQL + """ SELECT brand, origin, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, category_id, brand ORDER BY priority DESC, name) AS place
      FROM (SELECT snapshot_date, category_id, brand, 'rule' AS origin, rule AS name, priority FROM hits UNION ALL SELECT snapshot_date, category_id, brand, 'alert', 'rank_shock', 9 FROM ctx WHERE rank_shock)) WHERE place <= 10 GROUP BY 1, 2""")


def _named_sales(s, d):
    """Units by month and normalised brand: however a listing spells it."""
    brand = _listing(V.table(s, d, "part")).select("p_partkey", X.normal_brand(F.col("brand"), F.col("title")).alias("brand"))
    sold = dealt(V.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity"), "l_partkey", V.sold_rows(s, d))
    monthly = sold.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("of"), "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("units"))
    # all rows of a product are in one task, so it is counted there once a month and brand
    products = monthly.join(brand, F.col("l_partkey") == F.col("p_partkey")).groupBy("of", "brand", "l_partkey").agg(F.sum("units").alias("units"))
    return products.groupBy("of", "brand").agg(F.sum("units").alias("units"), F.count("*").alias("products")).select(F.date_format("of", "yyyy-MM").alias("month"), "brand", "units", "products")


add("monthly_brands", _named_sales, f"SELECT strftime(l_shipdate, '%Y-%m') AS month, brand, sum(l_quantity::BIGINT)::BIGINT AS units, count(DISTINCT p_partkey) AS products FROM lineitem JOIN ({SQL['normal_brands']}) ON l_partkey = p_partkey GROUP BY 1, 2")
