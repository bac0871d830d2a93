"""Design patterns as joins over symbols (id, name, kind, file, parent) and edges (src, dst): (pattern, id, confidence, evidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = ("Class", "Struct")


def _row(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(F.lit(pattern).alias("pattern"), "id", "confidence", F.col("evidence").cast("string").alias("evidence"))


def factories(symbols: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """Methods that call a class or function with a parent; high if the name speaks of making. Evidence: the number of such products."""
    products = symbols.where(F.col("kind").isin("Class", "Function")).select(F.col("id").alias("dst")).join(inherits.select(F.col("src").alias("dst")), "dst", "left_semi")
    made = calls.distinct().join(products, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("evidence"))
    sure = F.lower("name").rlike("create|build|make|factory|new_")
    return _row(symbols.where("kind = 'Method'").join(made, "id").withColumn("confidence", F.when(sure, "high").otherwise("medium")), "Factory")


def singletons(symbols: DataFrame) -> DataFrame:
    """Types with a method that hands out the one instance; high with a field for it too."""
    parts = symbols.where("parent <> ''").groupBy(F.col("parent").alias("id")).agg(
        F.max(F.lower("name").rlike("^(get_?instance|instance|shared|default_?instance)$") & F.col("kind").isin("Method", "Function")).alias("getter"),
        F.max(F.lower("name").rlike("^_*instance$") & F.col("kind").isin("Field", "Variable", "Constant")).alias("holder"),
    )
    found = symbols.where(F.col("kind").isin(*_TYPES)).join(parts.where("getter"), "id")
    return _row(found.withColumn("confidence", F.when(F.col("holder"), "high").otherwise("medium")).withColumn("evidence", F.col("name")), "Singleton")


def observers(symbols: DataFrame) -> DataFrame:
    """Types that take subscribers and notify them; high with a way to leave."""
    low = F.lower("name")
    parts = symbols.where("parent <> ''").groupBy(F.col("parent").alias("id")).agg(
        F.max(low.rlike("^(subscribe|attach|add_?(listener|observer)|register|on)")).alias("joins"),
        F.max(low.rlike("^(notify|emit|publish|dispatch|fire)")).alias("tells"),
        F.max(low.rlike("^(unsubscribe|detach|remove_?(listener|observer)|unregister|off)")).alias("leaves"),
    )
    found = symbols.where(F.col("kind").isin(*_TYPES)).join(parts.where("joins and tells"), "id")
    return _row(found.withColumn("confidence", F.when(F.col("leaves"), "high").otherwise("medium")).withColumn("evidence", F.col("name")), "Observer")


def strategies(inherits: DataFrame) -> DataFrame:
    """Parents with three or more children; high from five."""
    from codeweave.operators.graph import implementations

    return _row(implementations(inherits).select(F.col("parent").alias("id"), "confidence", F.col("implementations").alias("evidence")), "Strategy")


def decorators(symbols: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """Types whose methods call methods of the type they inherit from."""
    method = symbols.where("parent <> ''")
    inner = method.select(F.col("id").alias("src"), F.col("parent").alias("child"))
    outer = method.select(F.col("id").alias("dst"), F.col("parent").alias("base"))
    pairs = inherits.select(F.col("src").alias("child"), F.col("dst").alias("base")).distinct()
    hit = calls.distinct().join(inner, "src").join(outer, "dst").join(pairs, ["child", "base"], "left_semi").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("evidence"))
    return _row(hit.withColumn("confidence", F.when(F.col("evidence") >= 2, "high").otherwise("medium")), "Decorator")


def detect(symbols: DataFrame, calls: DataFrame, inherits: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All patterns, or those of the given names."""
    every = {
        "Factory": lambda: factories(symbols, calls, inherits),
        "Singleton": lambda: singletons(symbols),
        "Observer": lambda: observers(symbols),
        "Strategy": lambda: strategies(inherits),
        "Decorator": lambda: decorators(symbols, calls, inherits),
    }
    out = None
    for name in kinds or every:
        part = every[name]()
        out = part if out is None else out.unionByName(part)
    return out
