"""Repositories and groups of them: a small JSON file at the driver, as tables when wanted; indexing of a whole group."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codeweave.operators.repos import combined
from codeweave.plans.graph import PropertyGraph


@dataclass
class Registry:
    """Paths by repository name, and member names by group."""

    repos: dict[str, str] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Registry:
        """The registry of a file; an empty one where there is none; unknown fields are ignored."""
        if not os.path.exists(path):
            return cls()
        with open(path) as f:
            stored = json.load(f)
        return cls(stored.get("repos", {}), stored.get("groups", {}))

    def save(self, path: str) -> None:
        with open(f"{path}.new", "w") as f:
            json.dump(asdict(self), f, indent=1, sort_keys=True)
        os.replace(f"{path}.new", path)

    def register(self, name: str, path: str) -> None:
        self.repos[name] = path

    def create_group(self, name: str) -> None:
        if name in self.groups:
            raise ValueError(f"group {name} exists")
        self.groups[name] = []

    def members(self, group: str) -> list[str]:
        if group not in self.groups:
            raise ValueError(f"no group {group}")
        return self.groups[group]

    def add(self, group: str, repo: str) -> None:
        if repo not in self.repos:
            raise ValueError(f"no repository {repo}")
        if repo not in self.members(group):
            self.groups[group].append(repo)

    def remove(self, group: str, repo: str) -> None:
        if repo not in self.members(group):
            raise ValueError(f"{repo} is not in {group}")
        self.groups[group].remove(repo)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(name, path) and (name, repo)."""
        return spark.createDataFrame(sorted(self.repos.items()), "name string, path string"), spark.createDataFrame([(g, r) for g, m in sorted(self.groups.items()) for r in m], "name string, repo string")


def group_graph(registry: Registry, group: str, index: Callable[[str, str], PropertyGraph]) -> PropertyGraph:
    """One graph of all repositories of a group: index(name, path) for each, ids prefixed and rows tagged; a group query is a query of it."""
    graphs = {r: index(r, registry.repos[r]) for r in registry.members(group)}
    if not graphs:
        return PropertyGraph()
    nodes = {k for g in graphs.values() for k in g.nodes}
    edges = {k for g in graphs.values() for k in g.edges}
    return PropertyGraph(
        {k: combined({r: g.nodes[k] for r, g in graphs.items() if k in g.nodes}, {})[0] for k in nodes},
        {k: combined({}, {r: g.edges[k] for r, g in graphs.items() if k in g.edges})[1] for k in edges},
    )


def gate_config(path: str) -> dict[str, int]:
    """Limits for ``review.gates`` from a TOML file's [gates] table; what it doesn't set keeps its default."""
    with open(path, "rb") as f:
        stored = tomllib.load(f).get("gates", {})
    return {k: int(stored[k]) for k in ("max_critical", "max_high", "max_dead", "least_coverage") if k in stored}
