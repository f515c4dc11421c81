"""Scalar parsers and normalisers: Column in, Column out. Text that doesn't parse gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Blank and "N/A" are null; ``$`` and commas are dropped."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def price(c: Column, low: float = 0.5, high: float = 500.0) -> Column:
    """A price needs ``$`` and must be plausible."""
    v = F.regexp_replace(F.regexp_extract(c, r"\$([0-9][0-9,]*\.?[0-9]*)", 1), ",", "").try_cast("double")
    return F.when(v.between(low, high), v)


def rating(c: Column) -> Column:
    """``4.5 out of 5``, ``4.5/5`` or a leading number, within 0 to 5."""
    first = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("double")
    v = F.coalesce(first(r"([0-9.]+) out of 5"), first(r"([0-9.]+)/5"), first(r"^([0-9.]+)"))
    return F.when(v.between(0, 5), v)


def review_count(c: Column, most: int = 1_000_000) -> Column:
    v = F.regexp_replace(c, "[^0-9]", "").try_cast("long")
    return F.when(v <= most, v)


def seconds_left(c: Column) -> Column:
    """``2h 30m 5s`` in seconds; nothing left is null."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"([0-9]+)\s*{unit}", 1).try_cast("long"), F.lit(0))
    return F.nullif(part("h") * 3600 + part("m") * 60 + part("s"), F.lit(0).cast("long"))


def view_count(c: Column) -> Column:
    """``1.2k``, ``3m``, ``1b``."""
    low = F.lower(F.trim(c))
    v = F.regexp_extract(low, r"^([0-9.]+)", 1).try_cast("double")
    return F.round(v * F.when(low.endswith("k"), 1e3).when(low.endswith("m"), 1e6).when(low.endswith("b"), 1e9).otherwise(1.0)).cast("long")


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"#(\w+)"), F.lit(1))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def engagement(likes: Column, comments: Column, views: Column) -> Column:
    return F.when(views > 0, 100.0 * (likes + comments) / views).otherwise(0.0)


def query_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), 256)


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(default))


def brand_of(title: Column, names: list[str]) -> Column:
    """First listed brand that the title contains, else Unknown: longer names first in the list."""
    out = F.lit("Unknown")
    for n in reversed(names):
        out = F.when(F.lower(title).contains(n.lower()), n).otherwise(out)
    return out


def product_type(title: Column, kinds: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("other")
    for word, kind in reversed(kinds):
        out = F.when(F.lower(title).contains(word), kind).otherwise(out)
    return out


#: Shortened brand names of listings and the full ones.
BRAND_NAMES = {
    "burt's": "Burt's Bees", "wet": "wet n wild", "tree": "Tree Hut", "clean": "Clean Skin Club", "summer": "Summer Fridays", "rare": "Rare Beauty", "la": "La Roche-Posay",
    "beauty": "Beauty of Joseon", "tower": "Tower 28", "drunk": "Drunk Elephant", "paula's": "Paula's Choice", "the": "The Ordinary", "glow": "Glow Recipe", "youth": "Youth To The People",
    "first": "First Aid Beauty", "charlotte": "Charlotte Tilbury", "too": "Too Faced", "urban": "Urban Decay", "fenty": "Fenty Beauty", "huda": "Huda Beauty",
    "anastasia": "Anastasia Beverly Hills", "physicians": "Physicians Formula", "covergirl": "COVERGIRL", "medicube": "MEDICUBE",
}
#: Words of a title and the product's type, the first that fits.
PRODUCT_TYPES = (
    ("lip sleeping", "lip_balm"), ("lip mask", "lip_balm"), ("lip glowy", "lip_balm"), ("lip butter", "lip_balm"), ("lip balm", "lip_balm"), ("water sleeping", "sleeping_mask"),
    ("sleeping mask", "sleeping_mask"), ("water bank", "moisturizer"), ("cream", "moisturizer"), ("moisturizer", "moisturizer"), ("toner", "toner"), ("serum", "serum"),
)


def normal_brand(brand: Column, title: Column, names: dict[str, str] = BRAND_NAMES) -> Column:
    """The full name of a shortened brand; else the first full name that the title
    contains; else the brand. Missing and unknown brands stay as they are."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.lower(F.trim(brand))]
    titled = F.lit(None).cast("string")
    for full in reversed(names.values()):
        titled = F.when(F.contains(F.lower(title), F.lit(full.lower())), full).otherwise(titled)
    return F.when(brand.isNull() | brand.isin("", "Unknown"), brand).otherwise(F.coalesce(known, titled, brand))


def converted(amount: Column, currency: Column, rates: dict[str, float]) -> Column:
    """Amount in the base currency; an unknown currency gives null."""
    return amount * F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[currency]


#: Where the figures of a statement stand, fixed patterns.
FIGURES = {
    "revenue": r"(?i)Revenue[:\s]+(\d+[.,]?\d*)\s*(?:billion|B)",
    "operating_profit": r"(?i)Operating (?:Profit|Income)[:\s]+(\d+[.,]?\d*)\s*(?:billion|B)",
    "net_income": r"(?i)Net (?:Profit|Income)[:\s]+(\d+[.,]?\d*)\s*(?:billion|B)",
    "revenue_yoy": r"(?i)Revenue.*?([+-]?\d+[.,]?\d*)\s*%\s*(?:YoY|y-o-y)",
}


def figures(text: Column) -> Column:
    """Struct of a statement's revenue, operating profit and net income (in billions)
    and the revenue's change over a year (percent); null for what it doesn't say.
    Commas separate thousands."""
    found = lambda p: F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(*(found(p).alias(n) for n, p in FIGURES.items()))


def recent_change(rows: DataFrame, key: str, order: list[str], value: str, n: int = 4) -> DataFrame:
    """``(key, change)``: relative change over the newest n values of each key; null
    without two or from 0. No more than n values of a key leave their task's window."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order)))
    last = rows.withColumn("_n", place).where(F.col("_n") <= n).groupBy(key).agg(F.max_by(value, "_n").alias("a"), F.min_by(value, "_n").alias("b"), F.count("*").alias("c"))
    return last.select(key, F.when((F.col("c") >= 2) & (F.col("a") != 0), (F.col("b") - F.col("a")) / F.col("a")).alias("change"))
