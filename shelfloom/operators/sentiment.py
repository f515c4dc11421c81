"""What customers say about products, as edges of the graph: tags, their clusters, summaries.

A product has few tags, so lists of tags stay small; a brand's or a cluster's
products are only counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dashboard import cluster_of

#: Clusters with the tags that belong to them, the first cluster wins.
CLUSTERS = [
    ("Hydration", ["moisturizing", "hydrating", "nourishing", "hydration", "moisture"]),
    ("Pricing", ["value for money", "affordable", "expensive", "worth the price", "good value"]),
    ("Usability", ["easy to use", "convenient", "travel-friendly", "user-friendly", "simple"]),
    ("Effectiveness", ["works well", "long-lasting", "effective", "quick results", "noticeable difference"]),
    ("Sensory", ["nice scent", "good texture", "lightweight", "smooth", "pleasant smell"]),
    ("Packaging", ["good packaging", "nice design", "travel size", "sturdy", "leak-proof"]),
    ("Skin_Compatibility", ["gentle", "non-irritating", "sensitive skin", "hypoallergenic", "dermatologist tested"]),
]


def sentiment_edges(products: DataFrame, clusters=CLUSTERS) -> DataFrame:
    """Edges (subject, predicate, object, cluster) of rows (product, tags, summary,
    success): hasSentiment for each tag, hasSummary for a summary that isn't empty.
    Rows without success give none; a repeated edge is one."""
    good = products.where("success")
    tags = good.select(F.col("product").alias("subject"), F.lit("hasSentiment").alias("predicate"), F.explode("tags").alias("object"))
    said = good.where("summary <> ''").select(F.col("product").alias("subject"), F.lit("hasSummary").alias("predicate"), F.col("summary").alias("object"), F.lit(None).cast("string").alias("cluster"))
    return tags.withColumn("cluster", cluster_of(F.col("object"), clusters)).unionByName(said).distinct()


def product_sentiments(edges: DataFrame) -> DataFrame:
    """(product, tags, clusters, summary): sorted tags, tags by cluster, the first summary by text."""
    tag = F.when(F.col("predicate") == "hasSentiment", F.col("object"))
    per = edges.groupBy(F.col("subject").alias("product"), "cluster").agg(F.sort_array(F.collect_set(tag)).alias("t"), F.min(F.when(F.col("predicate") == "hasSummary", F.col("object"))).alias("s"))
    named = F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", "t")))
    return per.groupBy("product").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("tags"), F.map_from_entries(F.array_sort(named)).alias("clusters"), F.min("s").alias("summary"))


def brand_profile(edges: DataFrame, made: DataFrame) -> DataFrame:
    """Profile of every brand of ``made`` (brand, product): its products, mentions
    of each cluster and the tag of most products (the first by name of several)."""
    told = made.join(edges.where("predicate = 'hasSentiment'"), F.col("product") == F.col("subject"))
    counts = told.groupBy("brand", "object", "cluster").agg(F.count("*").alias("n"))
    best = Window.partitionBy("brand").orderBy(F.desc("n"), "object")
    named = counts.withColumn("first", F.first("object").over(best))
    per = named.groupBy("brand", "first", "cluster").agg(F.sum("n").alias("mentions"))
    products = made.groupBy("brand").agg(F.count_distinct("product").alias("products"))
    return products.join(per, "brand", "left").select("brand", "products", F.col("first").alias("dominant"), "cluster", "mentions")


def compared(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tags that two products of ``pairs`` (one, two) share and those of only one."""
    tags = edges.where("predicate = 'hasSentiment'").groupBy("subject").agg(F.collect_set("object").alias("tags"))
    none = F.array().cast("array<string>")
    both = pairs.join(tags.select(F.col("subject").alias("one"), F.col("tags").alias("a")), "one", "left").join(tags.select(F.col("subject").alias("two"), F.col("tags").alias("b")), "two", "left")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("one", "two", F.sort_array(F.array_intersect(a, b)).alias("common"), F.sort_array(F.array_except(a, b)).alias("only_one"), F.sort_array(F.array_except(b, a)).alias("only_two"))


def tagged(edges: DataFrame, tag: str, made: DataFrame | None = None, brand: str | None = None) -> DataFrame:
    """Products with a tag, of one brand (whatever its case) if given."""
    rows = edges.where((F.col("predicate") == "hasSentiment") & (F.col("object") == tag)).select(F.col("subject").alias("product")).distinct()
    if brand is None:
        return rows
    return rows.join(made.where(F.lower("brand") == brand.lower()).select("product").distinct(), "product", "left_semi")


def brand_sentiment_context(edges: DataFrame, made: DataFrame, rivals: DataFrame) -> DataFrame:
    """Context of the sentiment rules: (brand, tags, clusters, rival_tags,
    rival_clusters). ``rivals`` is (brand, rival). Tags are made distinct by brand
    before rivals are joined, so the join sees a brand's vocabulary and not its products."""
    told = made.join(edges.where("predicate = 'hasSentiment'"), F.col("product") == F.col("subject")).select("brand", F.col("object").alias("tag"), "cluster").distinct()
    theirs = rivals.join(told.withColumnRenamed("brand", "rival"), "rival").select("brand", "tag", "cluster").distinct()

    def folded(rows, tags, clusters):
        per = rows.groupBy("brand", "cluster").agg(F.sort_array(F.collect_set("tag")).alias("t"))
        named = F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", "t")))
        return per.groupBy("brand").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias(tags), F.map_from_entries(named).alias(clusters))

    return folded(told, "tags", "clusters").join(folded(theirs, "rival_tags", "rival_clusters"), "brand", "left")
