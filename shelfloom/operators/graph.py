"""Triple store queries as joins of an edge table (subject, predicate, object, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.sources.tables import written


def match(edges: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, least: float = 0.0) -> DataFrame:
    out = edges.where(F.col("confidence") >= least)
    for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def pattern(edges: DataFrame, triples: list[tuple[str, str, str]], select: list[str], filters: list[str] = (), cross: bool = False) -> DataFrame:
    """Basic graph pattern: terms that start with ``?`` are variables; triples
    join on the variables they share (an empty match empties the result), bag
    semantics. Filters are SQL conditions over variable names. Triples that share no
    variable with those before them are refused unless ``cross`` is set."""
    bound = None
    for s, p, o in triples:
        part = edges
        names = {}
        for column, term in (("subject", s), ("predicate", p), ("object", o)):
            if term.startswith("?"):
                if term[1:] in names:
                    part = part.where(F.col(column) == F.col(names[term[1:]]))
                else:
                    names[term[1:]] = column
            else:
                part = part.where(F.col(column) == term)
        part = part.select(*(F.col(c).alias(v) for v, c in names.items()))
        shared = [v for v in names if bound is not None and v in bound.columns]
        if bound is not None and not shared and not cross:
            raise ValueError(f"no variable in common with the triples before: {(s, p, o)}")
        bound = part if bound is None else (bound.join(part, shared) if shared else bound.crossJoin(part))
    for condition in filters:
        bound = bound.where(condition)
    return bound.select(*select)


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    out = edges.where(F.col("subject") == entity).select("predicate", F.col("object").alias("neighbour"), F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("object") == entity).select("predicate", "subject", F.lit("in")))


def levels(edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """Breadth-first levels in both directions: (entity, depth), least depth. The
    edges and every level are written, so a level costs one join and no more."""
    both = written(edges.select("subject", "object").union(edges.select("object", "subject")).distinct())
    frontier = written(edges.sparkSession.createDataFrame([(start, 0)], "entity string, depth int"))
    seen = frontier
    for d in range(1, depth + 1):
        found = both.join(frontier, both.subject == frontier.entity).select(F.col("object").alias("entity")).distinct()
        frontier = written(found.join(seen, "entity", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def shortest_paths(edges: DataFrame, start: str, end: str, depth: int = 4) -> DataFrame:
    """Outgoing path with the fewest edges (first in text order among equals), null
    if none within ``depth``. Stops at the first depth that reaches the end."""
    steps = written(edges.select("subject", "object").distinct())
    paths = edges.sparkSession.createDataFrame([([start], start)], "path array<string>, at string")
    for d in range(depth + 1):
        if d:
            longer = paths.join(steps, paths["at"] == steps.subject).where(~F.array_contains("path", F.col("object")))
            # one path per entity is enough for a shortest path
            longer = longer.select(F.array_append("path", F.col("object")).alias("path"), F.col("object").alias("at"))
            paths = written(longer.groupBy("at").agg(F.min("path").alias("path")).select("path", "at"))
        out = paths.where(F.col("at") == end)
        if not out.isEmpty():
            break
    return out.orderBy("path").limit(1).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def degrees(edges: DataFrame, k: int | None = None) -> DataFrame:
    ends = edges.select(F.col("subject").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("object", F.lit(0), F.lit(1)))
    out = ends.groupBy("entity").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))
    return out.orderBy(F.desc("degree"), "entity").limit(k) if k else out


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("edges"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.avg("confidence").alias("avg_confidence"))


def category_brands(edges: DataFrame, least: int = 2) -> DataFrame:
    """Brands of a category by their products in it."""
    made = edges.where("predicate = 'hasProduct'").select(F.col("subject").alias("brand"), F.col("object").alias("product"))
    held = edges.where("predicate = 'belongsToCategory'").select(F.col("subject").alias("product"), F.col("object").alias("category"))
    return made.join(held, "product").groupBy("category", "brand").agg(F.count("*").alias("products")).where(F.col("products") >= least)


def competitors(edges: DataFrame) -> DataFrame:
    """Symmetric closure of competitor edges; the direct kind wins over the indirect."""
    rows = edges.where(F.col("predicate").isin("directCompetitor", "indirectCompetitor")).select("subject", "object", F.when(F.col("predicate") == "directCompetitor", 1).otherwise(2).alias("kind"))
    both = rows.union(rows.select("object", "subject", "kind"))
    return both.groupBy("subject", "object").agg(F.min("kind").alias("kind")).select("subject", "object", F.when(F.col("kind") == 1, "direct").otherwise("indirect").alias("kind"))


def merged(edges: DataFrame) -> DataFrame:
    """Add-or-update of triples: one row per triple with the highest confidence."""
    return edges.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count("*").alias("times"))


def dominance(edges: DataFrame, least: float = 0.1) -> DataFrame:
    """Brand's share of a category's products, confidence min(0.5 + share, 1)."""
    per = category_brands(edges, 1)
    total = per.groupBy("category").agg(F.sum("products").alias("n"))
    share = F.col("products") / F.col("n")
    return per.join(total, "category").where(share >= least).select("category", "brand", share.alias("share"), F.least(F.lit(1.0), share + 0.5).alias("confidence"))


def price_position(products: DataFrame) -> DataFrame:
    """Brand's mean price against its category's mean: premium from +30 %, value up to -30 %."""
    per = products.groupBy("category", "brand").agg(F.sum("price").alias("s"), F.count("*").alias("c"))
    mean = products.groupBy("category").agg(F.avg("price").alias("mean"))
    ratio = F.col("s") / F.col("c") / F.col("mean")
    return per.join(mean, "category").select("category", "brand", ratio.alias("ratio"), F.when(ratio >= 1.3, "premium").when(ratio <= 0.7, "value").otherwise("mid").alias("position"))


def market_position(shares: DataFrame) -> DataFrame:
    """Classes by share of shelf: 0.30 and 0.15."""
    return shares.withColumn("position", F.when(F.col("sos") >= 0.30, "dominant").when(F.col("sos") >= 0.15, "strong").otherwise("niche"))


def importance(edges: DataFrame) -> DataFrame:
    """Eviction order of triples: scores and how many triples have them."""
    score = 0.5 + F.when(F.col("predicate") == "hasProduct", 10.0).otherwise(0.0) + 2 * F.col("confidence") + F.when(F.col("predicate").isin("directCompetitor", "belongsToCategory"), 1.0).otherwise(0.0)
    rows = edges.distinct().withColumn("score", score)
    counts = rows.groupBy("score").agg(F.count("*").alias("n"))
    return counts.select("score", "n")


def eviction(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """(score, n, evicted): how many triples of each score are among the lowest
    tenth, rounded down. Few scores exist, so their running sum is one small task."""
    counts = importance(edges)
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.floor(F.sum("n").over(Window.partitionBy()) * share) - before
    return counts.select("score", "n", F.greatest(F.lit(0), F.least(F.col("n"), room)).cast("long").alias("evicted"))


def ancestors(edges: DataFrame, predicates: tuple[str, ...] = ("parentCategory",), depth: int = 5) -> DataFrame:
    """Chain of parents of every entity: (entity, ancestor, steps), each step written."""
    up = written(edges.where(F.col("predicate").isin(*predicates)).select("subject", "object").distinct())
    step = up.select(F.col("subject").alias("entity"), F.col("object").alias("ancestor"), F.lit(1).alias("steps"))
    out = step
    for d in range(2, depth + 1):
        step = written(step.join(up, step.ancestor == up.subject).select("entity", F.col("object").alias("ancestor"), F.lit(d).alias("steps")))
        if step.isEmpty():
            break
        out = out.union(step)
    return out


#: Allowed (subject kind, predicate, object kind) of the schema.
ALLOWED = (("brand", "hasProduct", "product"), ("product", "belongsToCategory", "category"), ("nation", "parentCategory", "region"), ("region", "hasSubcategory", "nation"), ("supplier", "originatesFrom", "nation"), ("brand", "directCompetitor", "brand"), ("brand", "indirectCompetitor", "brand"))


def entity_kind(name: str):
    c = F.col(name)
    return F.when(c.rlike("^P[0-9]+$"), "product").when(c.rlike("^Brand"), "brand").when(c.rlike("^Supplier"), "supplier").otherwise("entity")


def validated(edges: DataFrame) -> DataFrame:
    """Counts of triples by kinds and whether the schema allows them ("entity" stands for any kind)."""
    rows = edges.withColumns({"sk": entity_kind("subject"), "ok": entity_kind("object")}).groupBy("predicate", "sk", "ok").agg(F.count("*").alias("n"))
    fine = F.lit(False)
    for s, p, o in ALLOWED:
        fine |= (F.col("predicate") == p) & F.col("sk").isin(s, "entity") & F.col("ok").isin(o, "entity")
    return rows.withColumn("valid", fine)


def terms(edges: DataFrame, **given) -> DataFrame:
    """Distinct subjects and objects of the matching triples: (place, term)."""
    rows = match(edges, given.get("subject"), given.get("predicate"), given.get("obj"))
    return rows.select(F.lit("subject").alias("place"), F.col("subject").alias("term")).union(rows.select(F.lit("object"), "object")).distinct()


def brand_products(edges: DataFrame, brand: str, category: str | None = None) -> DataFrame:
    """Products of a brand with their categories, of one category if given."""
    made = edges.where((F.col("predicate") == "hasProduct") & (F.col("subject") == brand)).select(F.col("object").alias("product"))
    held = edges.where("predicate = 'belongsToCategory'").select(F.col("subject").alias("product"), F.col("object").alias("category"))
    out = made.join(held, "product")
    return out if category is None else out.where(F.col("category") == category)


def entity_context(edges: DataFrame, entity: str, depth: int = 2, first: int = 5) -> DataFrame:
    """Neighbourhood of an entity: (depth, here, predicate, there, direction), the
    ``first`` edges of each direction (by predicate, then name) at every step.
    Only the steps' edges are ranked, never all of the graph."""
    here = written(edges.sparkSession.createDataFrame([(entity,)], "here string"))
    out = None
    for d in range(1, depth + 1):
        ways = edges.join(here, F.col("subject") == F.col("here")).select("here", "predicate", F.col("object").alias("there"), F.lit("out").alias("direction"))
        ways = ways.union(edges.join(here, F.col("object") == F.col("here")).select("here", "predicate", "subject", F.lit("in")))
        place = F.row_number().over(Window.partitionBy("here", "direction").orderBy("predicate", "there"))
        step = written(ways.withColumn("n", place).where(F.col("n") <= first).select(F.lit(d).alias("depth"), "here", "predicate", "there", "direction").distinct())
        out = step if out is None else out.union(step)
        here = written(step.select(F.col("there").alias("here")).distinct())
    return out


def children(edges: DataFrame, parent: str, predicate: str = "parentCategory") -> DataFrame:
    """Entities one level below."""
    return match(edges, None, predicate, parent).select(F.col("subject").alias("child"))


def product_context(edges: DataFrame, product: str) -> DataFrame:
    """A product's categories and how many products each holds."""
    held = edges.where("predicate = 'belongsToCategory'")
    mine = held.where(F.col("subject") == product).select(F.col("subject").alias("product"), F.col("object").alias("category"))
    sizes = held.groupBy(F.col("object").alias("category")).agg(F.count("*").alias("siblings"))
    return mine.join(sizes, "category").select("product", "category", "siblings")


def inconsistencies(edges: DataFrame) -> DataFrame:
    """(entity, problem, severity): products without a category (warnings) or with
    several (errors), entities that are both brand and product (errors), brands
    without products (warnings). One aggregation over both ends of the edges."""
    ends = edges.select(F.col("subject").alias("entity"), "predicate", F.lit("s").alias("end")).union(edges.select("object", "predicate", F.lit("o")))
    is_ = lambda p, e: F.count_if((F.col("predicate") == p) & (F.col("end") == e))
    per = ends.groupBy("entity").agg(is_("hasProduct", "o").alias("made"), is_("hasProduct", "s").alias("makes"), is_("belongsToCategory", "s").alias("held"), (is_("directCompetitor", "s") + is_("indirectCompetitor", "s")).alias("rivals"))
    named = lambda problem, severity: F.struct(F.lit(problem).alias("problem"), F.lit(severity).alias("severity"))
    found = F.array(
        F.when((F.col("made") > 0) & (F.col("held") == 0), named("no category", "warning")), F.when(F.col("held") > 1, named("several categories", "error")),
        F.when((F.col("made") > 0) & (F.col("makes") > 0), named("brand and product", "error")), F.when((F.col("rivals") > 0) & (F.col("makes") == 0), named("brand without products", "warning")),
    )
    return per.select("entity", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("entity", "x.*")


def allowed() -> Column:
    """Whether the schema allows a triple ("entity" stands for any kind)."""
    fine = F.lit(False)
    for s, p, o in ALLOWED:
        fine |= (F.col("predicate") == p) & entity_kind("subject").isin(s, "entity") & entity_kind("object").isin(o, "entity")
    return fine


def insert_checked(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Triples after a validated insert: what the schema forbids stays out, a
    triple that exists keeps its higher confidence."""
    return edges.unionByName(new.where(allowed())).groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))


def metric_edges(metrics: DataFrame, keys: list[str], at: str, names: dict[str, str]) -> DataFrame:
    """Metrics as edges (subject, predicate, value, at): one row per key and metric."""
    subject = F.concat_ws("/", *keys)
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(c).cast("double").alias("value")) for c, p in names.items()))
    return metrics.select(subject.alias("subject"), F.col(at).alias("at"), F.explode(pairs).alias("x")).select("subject", "x.predicate", "x.value", "at")


def alert_edges(alerts: DataFrame, order: list[str]) -> DataFrame:
    """Alerts (asin, alert, severity and others) as edges ``(subject, hasAlert,
    object, properties)``: of equal edges the first in ``order``, then by severity, stays."""
    rest = [c for c in alerts.columns if c not in ("asin", "alert")]
    place = F.struct(*order, "severity")
    return alerts.where("asin is not null").groupBy(F.col("asin").cast("string").alias("subject"), F.coalesce("alert", F.lit("unknown")).alias("object")).agg(F.min_by(F.struct(*rest), place).alias("properties")).select("subject", F.lit("hasAlert").alias("predicate"), "object", "properties")


def value_problems(entities: DataFrame, disjoint: tuple[str, ...] = ("dominant", "strong", "niche")) -> DataFrame:
    """(entity, problem, severity) of stored values. ``entities``: (entity, classes
    array, share, rank), share and rank as stored, so texts. In several disjoint
    classes or a share that is no number: errors; a share outside 0 to 1 or a rank
    that is no whole number from 1 on: warnings. Nulls are no problem."""
    share, rank = F.col("share").try_cast("double"), F.col("rank").try_cast("double")
    named = lambda problem, severity: F.struct(F.lit(problem).alias("problem"), F.lit(severity).alias("severity"))
    found = F.array(
        F.when(F.size(F.array_intersect(F.coalesce("classes", F.array().cast("array<string>")), F.array(*map(F.lit, disjoint)))) > 1, named("several classes", "error")),
        F.when(F.col("share").isNotNull() & (share.isNull() | F.isnan(share)), named("share is no number", "error")).when(~share.between(0, 1), named("share out of range", "warning")),
        F.when(F.col("rank").isNotNull() & ~F.coalesce((rank >= 1) & (rank == F.floor(rank)), F.lit(False)), named("no rank", "warning")),
    )
    return entities.select("entity", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("entity", "x.*")


def entity_facts(edges: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """Facts about the entities of a table (entity), at most ``most`` a kind of
    edge: (entity, predicate, other, direction)."""
    ways = edges.join(entities, F.col("subject") == F.col("entity")).select("entity", "predicate", F.col("object").alias("other"), F.lit("out").alias("direction"))
    ways = ways.union(edges.join(entities, F.col("object") == F.col("entity")).select("entity", "predicate", "subject", F.lit("in")))
    place = F.row_number().over(Window.partitionBy("entity", "predicate", "direction").orderBy("other"))
    return ways.distinct().withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def enriched(context: DataFrame, edges: DataFrame, brand: str = "brand") -> DataFrame:
    """A context with the graph's figures of its brand: products, categories, rivals (0 without)."""
    made = edges.where("predicate = 'hasProduct'").select(F.col("subject").alias("_b"), F.col("object").alias("_p"))
    held = edges.where("predicate = 'belongsToCategory'").select(F.col("subject").alias("_p"), F.col("object").alias("_c"))
    products = made.join(held, "_p", "left").groupBy("_b").agg(F.count_distinct("_p").alias("kg_products"), F.count_distinct("_c").alias("kg_categories"))
    rivals = competitors(edges).groupBy(F.col("subject").alias("_b")).agg(F.count("*").alias("kg_rivals"))
    figures = products.join(rivals, "_b", "full_outer")
    names = ("kg_products", "kg_categories", "kg_rivals")
    return context.join(figures, F.col(brand) == F.col("_b"), "left").drop("_b").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def ownership_edges(brands: DataFrame) -> DataFrame:
    """Edges of rows (brand, owner, segment, country, acquired): ownedByGroup,
    ownsBrand, hasSegment, originatesFrom and, if acquired, acquiredIn. Sisters of a
    brand are found through its owner (``ownership``) and not stored pair by pair."""
    edge = lambda s, p, o, real: F.when(real & o.isNotNull(), F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object")))
    b, always = F.col("brand"), F.col("brand") != ""
    found = F.array(
        edge(b, "ownedByGroup", F.col("owner"), always), edge(F.col("owner"), "ownsBrand", b, always & F.col("owner").isNotNull()), edge(b, "hasSegment", F.coalesce("segment", F.lit("Unknown")), always),
        edge(b, "originatesFrom", F.col("country"), always), edge(b, "acquiredIn", F.col("acquired"), always),
    )
    return brands.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*", F.lit(1.0).alias("confidence")).distinct()


def ownership(edges: DataFrame) -> DataFrame:
    """(brand, owner, segment, country, acquired, sisters): one aggregation over a
    brand's edges; sisters are the owner's other brands, counted."""
    names = {"ownedByGroup": "owner", "hasSegment": "segment", "originatesFrom": "country", "acquiredIn": "acquired"}
    per = edges.where(F.col("predicate").isin(*names)).groupBy(F.col("subject").alias("brand")).agg(*(F.min(F.when(F.col("predicate") == p, F.col("object"))).alias(n) for p, n in names.items()))
    sizes = edges.where("predicate = 'ownsBrand'").groupBy(F.col("subject").alias("owner")).agg((F.count_distinct("object") - 1).alias("sisters"))
    return per.join(sizes, "owner", "left").select("brand", "owner", "segment", "country", "acquired", F.coalesce("sisters", F.lit(0)).alias("sisters"))


def sisters(edges: DataFrame, brand: str) -> DataFrame:
    """The other brands of a brand's owner."""
    owner = match(edges, brand, "ownedByGroup").select(F.col("object").alias("owner"))
    owned = edges.where("predicate = 'ownsBrand'").select(F.col("subject").alias("owner"), F.col("object").alias("sister"))
    return owned.join(owner, "owner", "left_semi").where(F.col("sister") != brand).select("sister").distinct()


def compares(value: Column, op: str, limit: str) -> Column:
    """Whether a term meets a condition (``= != < <= > >=``): as numbers if both are, else as texts."""
    ops = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    number = F.lit(limit).try_cast("double")
    as_number = getattr(value.try_cast("double"), ops[op])(number)
    return F.when(value.try_cast("double").isNotNull() & number.isNotNull(), as_number).otherwise(getattr(value, ops[op])(F.lit(limit)))
