"""Claims in free text: extraction, verification against known figures, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds

#: Kinds of claims and what they look like.
PATTERNS = {
    "percent": r"[0-9]+(?:\.[0-9]+)? ?%",
    "money": r"\$ ?[0-9]+(?:\.[0-9]+)?",
    "date": r"(?:19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]",
    "number": r"[0-9]+(?:\.[0-9]+)?",
    "comparison": r"(?:more|less|higher|lower|better|worse) than",
    "cause": r"(?:because|therefore|due to|leads to)",
}
CONTEXT = 50
STATUS_SCORE = {"verified": 1.0, "close": 0.7, "unknown": 0.4, "refuted": 0.0}


#: Patterns of claims in Korean and English reports by unit, fixed values.
REPORT_PATTERNS = {
    "rank": r"\d+\s*위", "rank_place": r"\d+\s*등", "rank_top": r"[Tt][Oo][Pp]\s*\d+", "percent": r"\d+\.?\d*\s*%", "percent_word": r"\d+\.?\d*\s*퍼센트",
    "sos": r"[Ss][Oo][Ss]\s*[:=]?\s*\d+\.?\d*\s*%?", "hhi": r"[Hh][Hh][Ii]\s*[:=]?\s*\d+\.?\d*", "cpi": r"[Cc][Pp][Ii]\s*[:=]?\s*\d+\.?\d*", "price_usd": r"\$\s*\d+\.?\d*",
    "price_krw": r"\d{1,3}(?:,\d{3})*\s*원", "count": r"\d+\s*개", "count_people": r"\d+\s*명",
    "today": "오늘", "yesterday": "어제", "this_week": r"이번\s*주", "last_week": r"지난\s*주", "this_month": r"이번\s*달", "last_month": r"지난\s*달", "recent": "최근", "current": "현재",
    "date": r"\d{4}[-./]\d{1,2}[-./]\d{1,2}", "date_kr": r"\d{1,2}월\s*\d{1,2}일",
    "competitive_positive": r"경쟁력\s*(?:있|높|강)", "position_positive": "강세|우위|선두|지배", "trend_positive": "성장|상승|증가|개선", "competitive_negative": r"경쟁력\s*(?:없|낮|약)",
    "position_negative": "약세|열위|후발|미미", "trend_negative": "하락|감소|악화|저조", "neutral": "보통|중간|평균|유지",
    "comparison": r"보다\s*(?:높|낮|많|적|크|작)", "change": r"대비\s*\d+\.?\d*\s*%?\s*(?:증가|감소|상승|하락)", "multiple": r"\d+\.?\d*\s*배",
}
#: Weights of the kinds of claims in the score of a whole text, fixed values.
KIND_WEIGHT = {"numerical": 1.5, "temporal": 1.0, "logical": 1.2, "comparative": 0.8}
#: Ways to write a change of rank, and shortened names that a report should not hold, fixed values.
RANK_MOVES = (r"(\d+)\s*위에서\s*(\d+)\s*위로", r"(\d+)위\s*→\s*(\d+)위", r"순위:\s*(\d+)\s*→\s*(\d+)")
SHORTENED = ("Burt's", "wet", "Tree", "Summer", "Rare", "La", "Beauty", "Tower", "Drunk", "Paula's", "The", "Glow", "Youth")
#: What may follow such a word, since then the name is whole.
COMPLETED = ("Bees", r"n\s*wild", "Hut", "Fridays", "Beauty", "Roche", r"of\s*Joseon", "28", "Elephant", "Choice", "Ordinary", "Recipe", "To")


def _found(text: Column, kind: str, patterns: dict[str, str]) -> Column:
    """Array of the claims of one kind, each with the text on both sides."""
    found, around = F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0)), F.split(text, patterns[kind], -1)
    zipped = F.arrays_zip(found.alias("claim"), F.slice(around, 1, F.size(found)).alias("left"), F.slice(around, 2, F.size(found)).alias("right"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x["claim"].alias("claim"), x["left"].alias("left"), x["right"].alias("right")))


def extract(docs: DataFrame, kinds: list[str], id_col: str = "doc_id", text_col: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """One row per claim: id, kind, number within the text from 0, start offset,
    the claim, and up to 50 characters on both sides as far as the next claim of
    its kind. Null and empty texts have none."""
    parts = [_found(F.col(text_col), kind, patterns) for kind in kinds]
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.explode(F.concat(*parts)).alias("c")).select(id_col, "c.*")
    order = Window.partitionBy(id_col, "kind").orderBy("number")
    start = F.sum(F.length("left")).over(order) + F.coalesce(F.sum(F.length("claim")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(id_col, "kind", "number", start.alias("start"), "claim", F.right("left", F.lit(CONTEXT)).alias("before"), F.left("right", F.lit(CONTEXT)).alias("after"))


def verify(claims: DataFrame, facts: DataFrame, keys: list[str], near: float = 0.05, far: float = 0.10) -> DataFrame:
    """``claims`` (keys, claimed) against ``facts`` (keys, fact): verified within
    5 % of the fact, close within 10 %, else refuted; unknown without a fact."""
    off = F.abs(F.col("claimed") - F.col("fact"))
    status = (
        F.when(F.col("fact").isNull() | F.col("claimed").isNull(), "unknown").when(off <= near * F.abs("fact"), "verified")
        .when(off <= far * F.abs("fact"), "close").otherwise("refuted")
    )
    return claims.join(facts, keys, "left").withColumn("status", status)


def grade(status: Column, confidence: Column) -> Column:
    """high, medium or low by 0.7 of the status score and 0.3 of the confidence."""
    known = F.create_map(*(F.lit(x) for pair in STATUS_SCORE.items() for x in pair))
    score = 0.7 * known[status] + 0.3 * confidence
    return F.when(score >= 0.85, "high").when(score >= 0.60, "medium").otherwise("low")


def report_checks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: how many percentages it has, and how many of them are above 50
    and above 100."""
    values = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?) ?%"), 1), lambda x: x.cast("double"))
    return docs.select(id_col, values.alias("v")).select(
        id_col, F.size("v").alias("percentages"), F.size(F.filter("v", lambda x: x > 50)).alias("above_50"), F.size(F.filter("v", lambda x: x > 100)).alias("impossible")
    )


def within_budget(rows: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each group that fit into the budget, taken greedily in order;
    one that doesn't fit is skipped and later ones may still fit. The fold is
    sequential by nature; it carries sizes and positions, never the rows' text."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    placed = rows.withColumn("place", place).withColumn("size", size.cast("long"))
    folded = placed.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("all")).select(
        group,
        F.explode(F.aggregate(
            "all", F.struct(F.lit(0).cast("long").alias("used"), folds.empty("int").alias("taken")),
            lambda acc, x: F.when(acc["used"] + x["size"] <= budget, F.struct((acc["used"] + x["size"]).alias("used"), folds.added(acc["taken"], F.array(x["place"])).alias("taken"))).otherwise(acc),
            lambda acc: folds.whole(acc["taken"]),
        )).alias("place"),
    )
    return placed.join(folded, [group, "place"]).drop("place")


def with_fallback(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source; of each later one those whose key no earlier one has."""
    out = sources[0]
    for later in sources[1:]:
        out = out.unionByName(later.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def rank_status(claimed: Column, actual: Column, near: int = 1) -> Column:
    """struct(status, confidence) of a claimed rank: verified when equal, close within ``near``, else refuted; unknown without either."""
    off = F.abs(claimed - actual)
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    return F.when(off.isNull(), pair("unknown", 0.0)).when(off == 0, pair("verified", 1.0)).when(off <= near, pair("close", 0.8)).otherwise(pair("refuted", 0.0))


#: Days that data may be old for what a claim says of its time, and for other words, fixed values.
FRESH_DAYS = {"today": 1, "yesterday": 2, "this_week": 7, "last_week": 14, "this_month": 31, "last_month": 62, "recent": 7, "current": 1}
OTHER_DAYS = 7


def freshness(claimed: Column, last: Column, now: Column) -> Column:
    """struct(status, confidence) of a claim about time against the newest data:
    verified up to the allowed age, with confidence from 1 (new) down to 0; else
    unverified with 0.3; unknown without data."""
    allowed = F.coalesce(F.create_map(*(F.lit(x) for p in FRESH_DAYS.items() for x in p))[claimed], F.lit(OTHER_DAYS)) * 86_400_000_000
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), c.alias("confidence"))
    return F.when(age.isNull(), pair("unknown", F.lit(0.0))).when(age <= allowed, pair("verified", 1.0 - age / allowed)).otherwise(pair("unverified", F.lit(0.3)))


def text_scores(claims: DataFrame, key: str) -> DataFrame:
    """Score and grade of every text from its claims (key, kind, status, confidence):
    0.7 of the status score and 0.3 of the confidence, weighted by kind, to three
    digits. Sums are whole (millionths, tenths of a weight): the order of the claims
    and the last bit of a double decide nothing."""
    known = lambda table, c: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]
    whole = lambda c, parts: F.round(c * parts).cast("long")
    score = whole(0.7 * F.coalesce(known(STATUS_SCORE, F.col("status")), F.lit(0.5)) + 0.3 * F.col("confidence"), 1_000_000)
    weight = whole(F.coalesce(known(KIND_WEIGHT, F.col("kind")), F.lit(1.0)), 10)
    # thousandths, a half goes up
    total = F.call_function("div", 2 * F.sum(score * weight) + 1000 * F.sum(weight), 2000 * F.sum(weight)) / 1000
    return claims.groupBy(key).agg(total.alias("score")).withColumn("grade", F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.60, "medium").otherwise("low"))


def report_issues(text: Column, jump: int = 30, share: float = 50.0, points: float = 10_000.0) -> Column:
    """Sorted issues of a report's text: a rank that moves by more than ``jump``, a
    share above ``share`` percent, a concentration above ``points``, a shortened or an unknown brand. Empty for null."""
    number = lambda p, i: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(i)), lambda x: x.cast("double"))
    jumps = [F.exists(F.zip_with(number(p, 1), number(p, 2), lambda a, b: F.abs(a - b)), lambda x: x > jump) for p in RANK_MOVES]
    short = text.rlike(rf"(?i)\b(?:{'|'.join(SHORTENED)})\b(?!\s*(?:{'|'.join(COMPLETED)}))")
    found = {
        "rank_jump": jumps[0] | jumps[1] | jumps[2], "share_above_limit": F.exists(number(r"SoS[:\s]*(\d+\.?\d*)%", 1), lambda x: x > share),
        "concentration_above_limit": F.exists(number(r"HHI[:\s]*(\d+\.?\d*)", 1), lambda x: x > points), "shortened_brand": short, "unknown_brand": text.rlike(r"(?i)\bUnknown\b"),
    }
    return F.sort_array(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())), lambda x: x.isNotNull()))


def context_names(facts: Column, most: int = 5) -> Column:
    """struct(entities, relations) of an array of (subject, predicate, object): distinct
    names in order, ``most`` entities; null and empty names don't count."""
    plain = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    return F.struct(F.slice(plain(F.concat(facts["subject"], facts["object"])), 1, most).alias("entities"), plain(facts["predicate"]).alias("relations"))
