"""Several repositories: combined graphs, contracts, service links, inherited calls, advisories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators.text import normalised_route


def combined(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of repositories in one graph, ids prefixed with ``[repo]::`` and tagged with the repository; None for a side without tables."""
    tag = lambda t, repo, ids: reduce(lambda d, c: d.withColumn(c, F.concat(F.lit(f"[{repo}]::"), F.col(c).cast("string"))), ids, t).withColumn("repo", F.lit(repo))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return union([tag(t, r, ["id"]) for r, t in nodes.items()]), union([tag(t, r, ["src", "dst"]) for r, t in edges.items()])


def contracts(symbols: DataFrame) -> DataFrame:
    """(service, method, path, symbol_id, file): Route symbols named ``VERB /path``, the first of each method and path of a service."""
    routes = symbols.where("kind = 'Route'").select(F.col("repo").alias("service"), F.upper(F.regexp_replace(F.substring_index("name", " ", 1), "(?i)^map", "")).alias("method"), F.expr("substring(name, locate(' ', name) + 1)").alias("path"), F.col("id").alias("symbol_id"), "file")
    best = routes.groupBy("service", "method", "path").agg(F.min(F.struct("symbol_id", "file")).alias("first"))
    return best.select("service", "method", "path", "first.symbol_id", "first.file")


def service_calls(calls: DataFrame, offered: DataFrame) -> DataFrame:
    """(caller, src, service, symbol_id, path) where calls(caller, src, url) hit a contract of another service by normalised path."""
    left = calls.withColumn("route", normalised_route(F.col("url")))
    right = offered.select("service", "symbol_id", normalised_route(F.col("path")).alias("route"))
    return left.join(right, "route").where("caller <> service").select("caller", "src", "service", "symbol_id", F.col("route").alias("path")).distinct()


def rpc_contracts(symbols: DataFrame) -> DataFrame:
    """(service, rpc, symbol_id): methods of the classes that .proto files declare."""
    protos = symbols.where("endswith(file, '.proto')")
    owner = protos.where("kind = 'Class'").select(F.col("id").alias("parent"), F.col("name").alias("service"))
    return protos.where("kind = 'Method'").join(owner, "parent").select("service", F.col("name").alias("rpc"), F.col("id").alias("symbol_id"))


def rpc_clients(symbols: DataFrame, services: DataFrame) -> DataFrame:
    """(id, service): symbols whose name holds a client's name for a service; the service list is short and broadcast."""
    name = F.lower("service")
    wanted = services.select("service", F.explode(F.array(F.concat(name, F.lit("client")), F.concat(name, F.lit("stub")), F.concat(F.lit("new"), name), F.concat(name, F.lit("_client")))).alias("pattern")).distinct()
    return symbols.join(F.broadcast(wanted), F.lower("name").contains(F.col("pattern"))).select("id", "service").distinct()


def same_types(types: DataFrame) -> DataFrame:
    """(src, dst, members, others): types(id, name, repo) of one name in different repositories, one representative a name and
    repository (the smallest id) with the number of rows that it stands for: copies within a repository are not expanded."""
    groups = types.where("name is not null").groupBy("repo", "name").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    a = groups.select("name", F.col("repo").alias("ra"), F.col("rep").alias("src"), "members")
    b = groups.select("name", F.col("repo").alias("rb"), F.col("rep").alias("dst"), F.col("members").alias("others"))
    return a.join(b, "name").where("ra <> rb").select("src", "dst", "members", "others")


def shared_parents(types: DataFrame, inherits: DataFrame) -> DataFrame:
    """More INHERITS (src, dst): an inheritor of a type also inherits the types of that name in other repositories than its own.

    types(id, name, repo); inherits(src, dst).
    """
    named = types.select(F.col("id").alias("dst"), "name")
    other = types.select(F.col("id").alias("other"), "name", F.col("repo").alias("other_repo"))
    own = types.select(F.col("id").alias("src"), "repo")
    found = inherits.join(named, "dst").join(other, "name").where("other <> dst").join(own, "src").where("repo <> other_repo")
    return found.select("src", F.col("other").alias("dst")).distinct()


def vulnerable(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, name, version) with an advisory (advisory_id, ecosystem, name, version, severity), worst first."""
    rank = F.expr("case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end")
    return dependencies.join(advisories, ["ecosystem", "name", "version"]).withColumn("rank", rank).orderBy("rank", "name", "advisory_id")


def filtered(found: DataFrame, least: str | None = None, ecosystem: str | None = None) -> DataFrame:
    """Rows of ``vulnerable`` of at least a severity and of one ecosystem."""
    order = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    if least is not None:
        found = found.where(F.col("severity").isin(*order[: order.index(least) + 1]))
    return found if ecosystem is None else found.where(F.col("ecosystem") == ecosystem)
