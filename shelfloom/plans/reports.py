"""Queries over claims, report checks, budgets and source fallback, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfloom.operators import claims as C
from shelfloom.sources import views as V

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql):
    QUERIES[name], SQL[name] = plan, sql


KINDS = ["percent", "money", "number", "comparison"]
_CLAIMS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{C.PATTERNS[k]}')) AS claim, unnest(range(len(regexp_extract_all(text, '{C.PATTERNS[k]}')))) AS number, "
    f"unnest(string_split_regex(text, '{C.PATTERNS[k]}')[1:len(regexp_extract_all(text, '{C.PATTERNS[k]}'))]) AS prior, unnest(string_split_regex(text, '{C.PATTERNS[k]}')[2:]) AS next "
    f"FROM documents WHERE regexp_matches(text, '{C.PATTERNS[k]}')"
    for k in KINDS
)
add(
    "claim_extraction", lambda s, d: C.extract(V.table(s, d, "documents"), KINDS),
    f"""SELECT doc_id, kind, number::INT AS number, (sum(length(prior)) OVER w + coalesce(sum(length(claim)) OVER (PARTITION BY doc_id, kind ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
    claim, right(prior, 50) AS before, left(next, 50) AS after FROM ({_CLAIMS}) WINDOW w AS (PARTITION BY doc_id, kind ORDER BY number)""",
)


def _half(s, d, odd, name):
    return V.table(s, d, "events").where(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias(name))


def _checked(s, d):
    return C.verify(_half(s, d, 0, "claimed"), _half(s, d, 1, "fact"), ["user_id", "event_type"])


_HALF = "SELECT user_id, event_type, round(avg(value), 4) AS {n} FROM events WHERE event_id % 2 = {o} GROUP BY 1, 2"
_CHECKED = f"""SELECT user_id, event_type, CASE WHEN fact IS NULL OR claimed IS NULL THEN 'unknown' WHEN abs(claimed - fact) <= 0.05::DOUBLE * abs(fact) THEN 'verified' WHEN abs(claimed - fact) <= 0.10::DOUBLE * abs(fact) THEN 'close' ELSE 'refuted' END AS status
  FROM ({_HALF.format(n='claimed', o=0)}) LEFT JOIN ({_HALF.format(n='fact', o=1)}) USING (user_id, event_type)"""
add("claim_verification", lambda s, d: _checked(s, d).select("user_id", "event_type", "status"), _CHECKED)
add(
    "claim_grades", lambda s, d: _checked(s, d).groupBy("status", C.grade(F.col("status"), F.lit(0.9)).alias("grade")).agg(F.count("*").alias("claims")),
    f"SELECT status, CASE status WHEN 'verified' THEN 'high' WHEN 'close' THEN 'medium' ELSE 'low' END AS grade, count(*) AS claims FROM ({_CHECKED}) GROUP BY 1, 2",
)
_V = "list_transform(regexp_extract_all(coalesce(text, ''), '([0-9]+(?:\\.[0-9]+)?) ?%', 1), lambda x: x::DOUBLE)"
add(
    "report_checks", lambda s, d: C.report_checks(V.table(s, d, "documents")),
    f"SELECT doc_id, len(v)::INT AS percentages, len(list_filter(v, lambda x: x > 50))::INT AS above_50, len(list_filter(v, lambda x: x > 100))::INT AS impossible FROM (SELECT doc_id, {_V} AS v FROM documents)",
)
BUDGET = 200
add(
    "turns_in_budget", lambda s, d: C.within_budget(V.table(s, d, "conversations"), "conv_id", [F.desc("turn"), F.col("role")], F.length("text"), BUDGET).select("conv_id", "turn", "role", "size"),
    f"""WITH RECURSIVE s AS (SELECT conv_id, turn, role, length(text)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS place FROM conversations),
    r AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, 0::BIGINT AS used, false AS taken FROM s
      UNION ALL SELECT s.conv_id, s.place, CASE WHEN used + size <= {BUDGET} THEN used + size ELSE used END, used + size <= {BUDGET} FROM r JOIN s ON s.conv_id = r.conv_id AND s.place = r.place + 1)
    SELECT conv_id, turn, role, size FROM r JOIN s USING (conv_id, place) WHERE taken""",
)


def _sources(s, d):
    """Odd days from the first source, all from the second, which counts double."""
    days = V.table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))
    return C.with_fallback([days.where("substr(day, 10, 1) in ('1', '3', '5', '7', '9')"), days.withColumn("events", F.col("events") * 2)], "day")


add("source_fallback", _sources, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) * CASE WHEN substr(strftime(ts, '%Y-%m-%d'), 10, 1) IN ('1', '3', '5', '7', '9') THEN 1 ELSE 2 END AS events FROM events GROUP BY 1")
