"""A small Cypher front end: text to DataFrame plans. ``cypher_write`` adds the statements that change a graph.

Clauses: MATCH, OPTIONAL MATCH, WHERE, UNWIND, WITH, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT. Patterns: nodes with labels and
property maps, edges of some types in either or both directions, variable length ``*a..b`` and ``*a..`` (distinct end pairs, walked
until no new pair appears), anonymous parts, comma products. Conditions: AND, OR, NOT, comparisons, IN, CONTAINS, STARTS WITH,
ENDS WITH, IS [NOT] NULL, EXISTS { MATCH ... WHERE ... } anywhere. Aggregates group by the other items. ``$name`` is a parameter.

A query is read into patterns and conditions first and planned then, so conditions on one node narrow its table, and with it the
first frontier of a variable-length edge, before anything is joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.plans.joins import dealt_join
from codeweave.session import materialize

if TYPE_CHECKING:
    from codeweave.plans.graph import PropertyGraph

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?(?!\.\d)|\d+(?=\.\.))|(?P<name>[A-Za-z_]\w*)|(?P<op><>|<=|>=|\.\.|<-|->|[-()\[\]{}.,:;*=<>+/|$]))")
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
_SCALARS = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "size": F.length, "abs": F.abs, "id": lambda c: c, "tostring": lambda c: c.cast("string")}


class CypherError(ValueError):
    """The text is outside the dialect."""


@dataclass
class Item:
    """An expression: its column, its name, whether it aggregates, the variables in it, and the variable that it is."""

    column: Column
    name: str
    aggregate: bool = False
    used: frozenset[str] = frozenset()
    bare: str | None = None


@dataclass
class Node:
    var: str
    label: str | None
    props: dict[str, Item]


@dataclass
class Edge:
    var: str
    kinds: list[str]
    way: str
    low: int | None = None
    high: int | None = None
    props: dict[str, Item] = field(default_factory=dict)


@dataclass
class Is:
    """A condition without EXISTS."""

    column: Column
    used: frozenset[str]


@dataclass
class Exists:
    chains: list[list]
    where: object


@dataclass
class Logic:
    """and, or, not of conditions of which one has an EXISTS."""

    op: str
    parts: list


class Parser:
    def __init__(self, graph: PropertyGraph, text: str, params: dict | None = None):
        self.graph, self.tokens, self.at, self.fresh, self.params = graph, [], 0, 0, params or {}
        self.kinds: dict[str, list[str]] = {}
        end = 0
        while text[end:].strip():
            m = _TOKEN.match(text, end)
            if not m:
                raise CypherError(f"can't read {text[end : end + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            end = m.end()
        # Properties that the text takes of each variable: what a node without a label must bring along.
        names = [(k, v) for k, v in self.tokens]
        self.wanted: dict[str, set[str]] = {}
        for (k1, a), (_, dot), (k2, b) in zip(names, names[1:], names[2:]):
            if k1 == k2 == "name" and dot == "." and b != "id":
                self.wanted.setdefault(a, set()).add(b)

    # --- tokens ------------------------------------------------------------------------------------------------------

    def peek(self, *words: str) -> bool:
        if self.at + len(words) > len(self.tokens):
            return False
        return all(self.tokens[self.at + i][0] != "str" and self.tokens[self.at + i][1].upper() == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for word in words:
            if not self.take(word):
                found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
                raise CypherError(f"expected {word}, found {found}")

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        if kind != "name":
            raise CypherError(f"expected a name, found {value}")
        self.at += 1
        return value

    def spark(self):
        tables = [*self.graph.nodes.values(), *self.graph.edges.values()]
        if tables:
            return tables[0].sparkSession
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()

    # --- clauses -----------------------------------------------------------------------------------------------------

    def query(self) -> DataFrame:
        rows, scope = None, {}
        while self.at < len(self.tokens):
            if self.peek("RETURN"):
                self.take("RETURN")
                rows, _ = self.project(rows, scope, True)
                self.take(";")
                if self.at < len(self.tokens):
                    raise CypherError(f"unexpected {self.tokens[self.at][1]}")
                return rows
            rows, scope = self.reading(rows, scope)
        raise CypherError("no RETURN")

    def reading(self, rows: DataFrame | None, scope: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """One clause that reads."""
        if self.take("OPTIONAL", "MATCH"):
            return self.match(rows, scope, "left")
        if self.take("MATCH"):
            return self.match(rows, scope, "inner")
        if self.take("UNWIND"):
            values = self.expression(scope)
            self.need("AS")
            alias = self.name()
            rows = rows if rows is not None else self.spark().range(1).drop("id")
            return rows.withColumn(alias, F.explode(values.column)), scope | {alias: "flat"}
        if self.take("WITH"):
            rows, scope = self.project(rows, scope, False)
            if self.take("WHERE"):
                rows = self.apply(rows, self.conjuncts(self.condition(scope)))
            return rows, scope
        raise CypherError(f"unexpected {self.tokens[self.at][1]}")

    def match(self, rows: DataFrame | None, scope: dict[str, str], how: str) -> tuple[DataFrame, dict[str, str]]:
        chains, own = self.chains()
        where = []
        if self.take("WHERE"):
            where = self.conjuncts(self.condition(own if how == "left" else scope | own))
        local = [c for c in where if isinstance(c, Is) and len(c.used) == 1 and own.get(next(iter(c.used))) == "node" and not c.used & scope.keys()]
        told = chains[0][-1].var if rows is None and how == "inner" and len(chains) == 1 and self.only_told(chains[0]) else None
        part = self.build(chains, local, told)
        if how == "left":
            part = self.apply(part, where)
            return self.joined(rows, scope, part, own, how), scope | own
        rows = self.joined(rows, scope, part, own, how)
        return self.apply(rows, where), scope | own

    def only_told(self, chain: list) -> bool:
        """Whether what follows is DISTINCT without aggregates and takes properties of the last node, but not the node or its id."""
        var, rest = chain[-1].var, self.tokens[self.at :]
        if not (self.peek("RETURN", "DISTINCT") or self.peek("WITH", "DISTINCT")) or not self.wanted.get(var) or sum(n.var == var for n in chain) > 1:
            return False
        # Conditions are in the text before, so all of it counts but the pattern's own mention of the node.
        uses = [i for i, (kind, text) in enumerate(self.tokens) if kind == "name" and text == var]
        bare = [i for i in uses if i + 2 >= len(self.tokens) or self.tokens[i + 1][1] != "." or self.tokens[i + 2][1] == "id"]
        return len(bare) == 1 and not any(a[1].lower() in _AGGREGATES and b[1] == "(" for a, b in zip(rest, rest[1:]))

    def joined(self, rows: DataFrame | None, scope: dict, part: DataFrame, own: dict, how: str) -> DataFrame:
        if rows is None:
            return part
        keys = [f"{v}__id" for v in own if v in scope]
        have = set(rows.columns) - set(keys)
        other = part.drop(*(c for c in part.columns if c in have))
        return rows.join(other, keys, how) if keys else rows.crossJoin(other) if how == "inner" else rows.join(other, F.lit(True), how)

    # --- patterns ----------------------------------------------------------------------------------------------------

    def chains(self) -> tuple[list[list], dict[str, str]]:
        """Comma-separated patterns as lists of nodes and edges, and the kinds of their variables."""
        out, scope = [], {}
        while True:
            out.append(self.chain())
            for part in out[-1]:
                scope[part.var] = "node" if isinstance(part, Node) else "edge"
            if not self.take(","):
                return out, scope

    def chain(self) -> list:
        out = [self.node()]
        while self.peek("-") or self.peek("<-"):
            back = self.take("<-")
            if not back:
                self.need("-")
            edge = Edge(f"_e{self.fresh}", [], "")
            self.fresh += 1
            if self.take("["):
                if self.kind() == "name":
                    edge.var = self.name()
                if self.take(":"):
                    edge.kinds.append(self.name())
                    while self.take("|"):
                        self.take(":")
                        edge.kinds.append(self.name())
                if self.take("*"):
                    edge.low = 1
                    if self.kind() == "num":
                        edge.low = edge.high = int(self.literal())
                    if self.take(".."):
                        edge.high = int(self.literal()) if self.kind() == "num" else None
                edge.props = self.properties()
                self.need("]")
            if self.take("->"):
                edge.way = "both" if back else "out"
            else:
                self.need("-")
                edge.way = "in" if back else "both"
            self.kinds[edge.var] = edge.kinds
            out += [edge, self.node()]
        return out

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.kind() == "name" else f"_n{self.fresh}"
        self.fresh += 1
        label = self.name() if self.take(":") else None
        props = self.properties()
        self.need(")")
        return Node(var, label, props)

    def properties(self) -> dict[str, Item]:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expression(self.outer)
                self.take(",")
        return out

    #: Variables that property maps may refer to (only in statements that write).
    outer: dict[str, str] = {}

    def table(self, node: Node, local: list[Is]) -> DataFrame | None:
        """The node's rows with columns prefixed, narrowed by its map and by conditions on it alone; None if its edges say all there is."""
        mine = [c for c in local if node.var in c.used]
        wanted = self.wanted.get(node.var, set()) | node.props.keys()
        if node.label is None and not mine and not wanted:
            return None
        if node.label is not None:
            if node.label not in self.graph.nodes:
                raise CypherError(f"no label {node.label}")
            table = self.graph.nodes[node.label]
        else:
            tables = [t for t in self.graph.nodes.values() if wanted <= set(t.columns)]
            if not tables:
                raise CypherError(f"no label has {', '.join(sorted(wanted))}")
            if len({dict(t.dtypes)["id"] for t in tables}) > 1:
                raise CypherError(f"{node.var} needs a label: ids have different types")
            table = tables[0].select("id", *sorted(wanted - {"id"}))
            for t in tables[1:]:
                table = table.unionByName(t.select("id", *sorted(wanted - {"id"})))
        for key, value in node.props.items():
            table = table.where(F.col(key) == value.column)
        table = table.select(*(F.col(c).alias(f"{node.var}__{c}") for c in table.columns))
        for c in mine:
            table = table.where(c.column)
        return table

    def build(self, chains: list[list], local: list[Is], told: str | None = None) -> DataFrame:
        rows, scope = None, {}
        for chain in chains:
            part, own = self.build_chain(chain, local, told)
            rows, scope = self.joined(rows, scope, part, own, "inner"), scope | own
        return rows

    def build_chain(self, chain: list, local: list[Is], told: str | None = None) -> tuple[DataFrame, dict[str, str]]:
        """told: the last node, if only the distinct values of its properties count; a walk to it then keeps no pairs of nodes."""
        left = chain[0]
        narrow = lambda n: bool(n.props) or any(n.var in c.used for c in local)
        rows, scope = self.table(left, local), {left.var: "node"}
        seeded = narrow(left)
        for edge, right in zip(chain[1::2], chain[2::2]):
            table = self.table(right, local)
            seeds = back = None
            if edge.low is not None:
                if seeded and rows is not None:
                    seeds, back = rows.select(F.col(f"{left.var}__id").alias("id")).distinct(), edge.way == "in"
                elif narrow(right):
                    seeds, back = table.select(F.col(f"{right.var}__id").alias("id")).distinct(), edge.way != "in"
                elif rows is not None:
                    # A label narrows as well.
                    seeds, back = rows.select(F.col(f"{left.var}__id").alias("id")).distinct(), edge.way == "in"
                elif table is not None:
                    seeds, back = table.select(F.col(f"{right.var}__id").alias("id")).distinct(), edge.way != "in"
                if right.var == told and seeds is not None and back == (edge.way == "in") and {f"{told}__{c}" for c in self.wanted[told]} <= set(table.columns):
                    values = table.select(F.col(f"{told}__id").alias("id"), *(f"{told}__{c}" for c in sorted(self.wanted[told])))
                    found = self.steps(edge, seeds, back, values).withColumnRenamed("src", f"{left.var}__id")
                    return rows.join(found, f"{left.var}__id"), scope | {edge.var: "edge", told: "node"}
            steps = self.steps(edge, seeds, back)
            a, b = (right, left) if edge.way == "in" else (left, right)
            if a.var == b.var:
                steps = steps.where("src = dst").drop("dst").withColumnRenamed("src", f"{a.var}__id")
            else:
                steps = steps.withColumnRenamed("src", f"{a.var}__id").withColumnRenamed("dst", f"{b.var}__id")
            keys = list(dict.fromkeys(f"{v}__id" for v in (left.var, right.var) if v in scope))
            rows = steps if rows is None else rows.join(steps, keys)
            if table is not None:
                fresh = right.var not in scope
                rows = rows.join(table, f"{right.var}__id") if fresh else rows.join(table.select(f"{right.var}__id").distinct(), f"{right.var}__id", "left_semi")
            scope |= {edge.var: "edge", right.var: "node"}
            seeded, left = True, right
        if rows is None:
            raise CypherError("a lone node needs a label")
        return rows, scope

    def steps(self, edge: Edge, seeds: DataFrame | None, back: bool | None, told: DataFrame | None = None) -> DataFrame:
        """(src, dst, ...) of an edge pattern; what it lays between its ends if it has a variable length.

        told(id, ...): instead of a walk's end its values, as ``told_walks`` gives them.
        """
        for k in edge.kinds:
            if k not in self.graph.edges:
                raise CypherError(f"no edge type {k}")
        tables = [self.graph.edges[k] for k in edge.kinds or self.graph.edges]
        if not tables:
            raise CypherError("the graph has no edges")
        table = tables[0]
        for t in tables[1:]:
            table = table.unionByName(t, allowMissingColumns=True)
        for key, value in edge.props.items():
            table = table.where(F.col(key) == value.column)
        if edge.way == "both":
            turned = table.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in table.columns if c not in ("src", "dst")))
            table = table.unionByName(turned)
        if edge.low is None:
            own = [c for c in table.columns if c not in ("src", "dst", "id")]
            return table.select("src", "dst", F.struct(*table.columns).alias(f"{edge.var}__id"), *(F.col(c).alias(f"{edge.var}__{c}") for c in own))
        if edge.low == 0 and seeds is None:
            seeds = None
            for t in self.graph.nodes.values():
                seeds = t.select("id") if seeds is None else seeds.unionAll(t.select("id"))
            seeds = seeds.distinct()
        if told is not None:
            turned = table.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else table.select("src", "dst")
            return told_walks(turned.distinct(), edge.low, edge.high, seeds, told)
        return walks(table.select("src", "dst").distinct(), edge.low, edge.high, seeds, bool(back))

    # --- conditions --------------------------------------------------------------------------------------------------

    def conjuncts(self, c) -> list:
        return [p for part in c.parts for p in self.conjuncts(part)] if isinstance(c, Logic) and c.op == "and" else [c]

    def apply(self, rows: DataFrame, conditions: list) -> DataFrame:
        """rows that meet all conditions: semi and anti joins for EXISTS, marks for EXISTS below OR, filters for the rest."""
        for c in conditions:
            inner = c.parts[0] if isinstance(c, Logic) and c.op == "not" else c
            if isinstance(inner, Exists):
                part, keys = self.existing(inner, rows)
                if keys:
                    rows = rows.join(part, keys, "left_semi" if inner is c else "left_anti")
                    continue
            columns = rows.columns
            column, rows = self.marked(c, rows)
            rows = rows.where(column).select(columns)
        return rows

    def existing(self, e: Exists, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """The distinct ids for which the pattern has a match, and the columns of rows that they are."""
        own = {p.var: "node" if isinstance(p, Node) else "edge" for chain in e.chains for p in chain}
        where = self.conjuncts(e.where) if e.where is not None else []
        local = [c for c in where if isinstance(c, Is) and len(c.used) == 1 and own.get(next(iter(c.used))) == "node"]
        part = self.apply(self.build(e.chains, local), where)
        keys = [f"{v}__id" for v, kind in own.items() if kind == "node" and f"{v}__id" in rows.columns]
        return part.select(keys).distinct(), keys

    def marked(self, c, rows: DataFrame) -> tuple[Column, DataFrame]:
        """The condition as a column of rows, which get a mark for each EXISTS in it."""
        if isinstance(c, Is):
            return c.column, rows
        if isinstance(c, Exists):
            part, keys = self.existing(c, rows)
            mark = f"_mark{self.fresh}"
            self.fresh += 1
            if keys:
                rows = rows.join(part.withColumn(mark, F.lit(True)), keys, "left")
                return F.coalesce(mark, F.lit(False)), rows
            return F.col(mark), rows.crossJoin(part.limit(1).agg((F.count("*") > 0).alias(mark)))
        columns = []
        for p in c.parts:
            column, rows = self.marked(p, rows)
            columns.append(column)
        if c.op == "not":
            return ~columns[0], rows
        out = columns[0]
        for x in columns[1:]:
            out = out & x if c.op == "and" else out | x
        return out, rows

    def logic(self, op: str, parts: list):
        if all(isinstance(p, Is) for p in parts) and op != "and":
            out = parts[0].column
            for p in parts[1:]:
                out = out | p.column
            return Is(~out if op == "not" else out, frozenset().union(*(p.used for p in parts)))
        return Logic(op, parts)

    def condition(self, scope: dict):
        parts = [self.conjunction(scope)]
        while self.take("OR"):
            parts.append(self.conjunction(scope))
        if len(parts) == 1:
            return parts[0]
        return self.logic("or", [self.closed(p) for p in parts])

    def closed(self, c):
        """An AND below another operator as one column, if it has no EXISTS."""
        if isinstance(c, Logic) and c.op == "and":
            parts = [self.closed(p) for p in c.parts]
            if all(isinstance(p, Is) for p in parts):
                out = parts[0].column
                for p in parts[1:]:
                    out = out & p.column
                return Is(out, frozenset().union(*(p.used for p in parts)))
        return c

    def conjunction(self, scope: dict):
        parts = [self.negation(scope)]
        while self.take("AND"):
            parts.append(self.negation(scope))
        return parts[0] if len(parts) == 1 else Logic("and", parts)

    def negation(self, scope: dict):
        if self.take("NOT"):
            return self.logic("not", [self.closed(self.negation(scope))])
        if self.take("EXISTS"):
            self.need("{")
            self.take("MATCH")
            chains, own = self.chains()
            where = self.condition(own) if self.take("WHERE") else None
            self.need("}")
            return Exists(chains, where)
        if self.peek("("):
            start = self.at
            self.take("(")
            try:
                out = self.condition(scope)
                self.need(")")
                if not any(self.peek(op) for op in ("=", "<>", "<=", ">=", "<", ">", "+", "-", "*", "/", "IN", "IS")):
                    return out
            except CypherError:
                pass
            self.at = start
        return self.comparison(scope)

    def comparison(self, scope: dict) -> Is:
        first = self.expression(scope)
        left, used = first.column, first.used
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                other = self.expression(scope)
                right = other.column
                column = {"=": left == right, "<>": left != right, "<=": left <= right, ">=": left >= right, "<": left < right, ">": left > right}[op]
                return Is(column, used | other.used)
        if self.take("IN"):
            if self.peek("["):
                return Is(left.isin(self.literal()), used)
            other = self.expression(scope)
            return Is(F.array_contains(other.column, left), used | other.used)
        for words, f in ((("CONTAINS",), "contains"), (("STARTS", "WITH"), "startswith"), (("ENDS", "WITH"), "endswith")):
            if self.take(*words):
                other = self.expression(scope)
                return Is(getattr(left, f)(other.column), used | other.used)
        if self.take("IS", "NOT", "NULL"):
            return Is(left.isNotNull(), used)
        if self.take("IS", "NULL"):
            return Is(left.isNull(), used)
        return Is(left, used)

    # --- expressions -------------------------------------------------------------------------------------------------

    def literal(self):
        """A plain value: string, number, truth value, null, parameter, list or map."""
        if self.take("-"):
            return -self.literal()
        if self.take("$"):
            name = self.name()
            if name not in self.params:
                raise CypherError(f"no parameter {name}")
            return self.params[name]
        if self.take("["):
            values = []
            while not self.take("]"):
                values.append(self.literal())
                self.take(",")
            return values
        if self.take("{"):
            values = {}
            while not self.take("}"):
                key = self.name()
                self.need(":")
                values[key] = self.literal()
                self.take(",")
            return values
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return value
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            return float(value) if "." in value else int(value)
        raise CypherError(f"expected a value, found {value}")

    def expression(self, scope: dict) -> Item:
        """Sums of products of terms."""
        out = self.product(scope)
        while self.peek("+") or self.peek("-"):
            out = self.combined(out, self.product, scope)
        return out

    def product(self, scope: dict) -> Item:
        out = self.term(scope)
        while self.peek("*") or self.peek("/"):
            out = self.combined(out, self.term, scope)
        return out

    def combined(self, left: Item, read, scope: dict) -> Item:
        op = self.tokens[self.at][1]
        self.at += 1
        right = read(scope)
        column = {"+": left.column + right.column, "-": left.column - right.column, "*": left.column * right.column, "/": left.column / right.column}[op]
        return Item(column, f"{left.name}{op}{right.name}", left.aggregate or right.aggregate, left.used | right.used)

    def term(self, scope: dict) -> Item:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        if kind in ("str", "num") or value in ("-", "[", "{", "$") or (kind == "name" and value.upper() in ("TRUE", "FALSE", "NULL") and value not in scope):
            v = self.literal()
            return Item(column_of(v), "list" if isinstance(v, list) else "map" if isinstance(v, dict) else str(v))
        if self.take("("):
            inner = self.expression(scope)
            self.need(")")
            return inner
        var = self.name()
        if self.take("("):
            distinct = self.take("DISTINCT")
            arguments = [Item(F.lit(1), "*")] if self.take("*") else [self.expression(scope)]
            while self.take(","):
                arguments.append(self.expression(scope))
            self.need(")")
            inner, used = arguments[0], frozenset().union(*(a.used for a in arguments))
            name = f"{var}({', '.join(a.name for a in arguments)})"
            if var.lower() in _AGGREGATES and len(arguments) == 1:
                fn = _AGGREGATES[var.lower()]
                if distinct:
                    fn = {"count": F.count_distinct, "collect": F.collect_set}[var.lower()]
                return Item(fn(inner.column), name, True, used)
            if var.lower() == "coalesce":
                return Item(F.coalesce(*(a.column for a in arguments)), name, any(a.aggregate for a in arguments), used)
            if var.lower() in _SCALARS and len(arguments) == 1:
                return Item(_SCALARS[var.lower()](inner.column), name, inner.aggregate, used)
            raise CypherError(f"no function {var}")
        if var not in scope:
            raise CypherError(f"no variable {var}")
        if self.take("."):
            key = self.name()
            return Item(F.col(f"`{var}`.`{key}`") if scope[var] == "flat" else F.col(f"{var}__{key}"), f"{var}.{key}", False, frozenset([var]))
        return Item(F.col(f"`{var}`") if scope[var] == "flat" else F.col(f"{var}__id"), var, False, frozenset([var]), var)

    # --- items -------------------------------------------------------------------------------------------------------

    def items(self, scope: dict) -> list[Item]:
        out = []
        while True:
            item = self.expression(scope)
            if self.take("AS"):
                item.name = self.name()
            out.append(item)
            if not self.take(","):
                return out

    def project(self, rows: DataFrame | None, scope: dict, last: bool) -> tuple[DataFrame, dict[str, str]]:
        """RETURN (``last``) or WITH; in WITH, a node or edge that is named as it stands keeps its properties."""
        if rows is None:
            raise CypherError("nothing to return from")
        distinct = self.take("DISTINCT")
        items = self.items(scope)
        keys, names, kinds = [], [], {}
        for i in items:
            kind = scope.get(i.bare) if i.bare else None
            if not last and kind in ("node", "edge"):
                own = [c for c in rows.columns if c.startswith(f"{i.bare}__")]
                new = [f"{i.name}__{c[len(i.bare) + 2 :]}" for c in own]
                keys += [F.col(c).alias(n) for c, n in zip(own, new)]
                names += new
                kinds[i.name] = kind
                self.wanted.setdefault(i.name, set()).update(self.wanted.get(i.bare, set()))
            else:
                if not i.aggregate:
                    keys.append(i.column.alias(i.name))
                names.append(i.name)
                kinds[i.name] = "flat"
        values = [i.column.alias(i.name) for i in items if i.aggregate]
        if values:
            out = rows.groupBy(*keys).agg(*values) if keys else rows.agg(*values)
            out = out.select(*(F.col(f"`{n}`") for n in names))
        else:
            out = rows.select(*keys)
        if distinct:
            out = out.distinct()
        if self.take("ORDER", "BY"):
            out = out.orderBy(*self.order(items, scope | {k: v for k, v in kinds.items() if k not in scope}, distinct or bool(values)))
        if self.take("SKIP"):
            out = out.offset(int(self.literal()))
        if self.take("LIMIT"):
            out = out.limit(int(self.literal()))
        return out, kinds

    def order(self, items: list[Item], scope: dict, plain: bool) -> list[Column]:
        names, out = {i.name for i in items}, []
        while True:
            start = self.at
            text = self.tokens[self.at][1]
            if self.tokens[self.at][0] == "name" and text in names and not (self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] in (".", "(")):
                self.at += 1
                column = F.col(f"`{text}`")
            else:
                item = self.expression(scope)
                column = F.col(f"`{item.name}`") if item.name in names else item.column
                if plain and item.name not in names:
                    raise CypherError(f"ORDER BY {self.tokens[start][1]} isn't returned")
            if self.take("DESC") or self.take("DESCENDING"):
                out.append(column.desc())
            else:
                self.take("ASC") or self.take("ASCENDING")
                out.append(column.asc())
            if not self.take(","):
                return out


def column_of(value) -> Column:
    """A literal column; maps become structs, and the maps of a list get the same fields."""
    if isinstance(value, dict):
        return F.struct(*(column_of(v).alias(k) for k, v in value.items()))
    if isinstance(value, list):
        if value and all(isinstance(v, dict) for v in value):
            keys = list(dict.fromkeys(k for v in value for k in v))
            return F.array(*(column_of({k: v.get(k) for k in keys}) for v in value))
        return F.array(*(column_of(v) for v in value))
    return F.lit(value)


def walks(edges: DataFrame, low: int, high: int | None, seeds: DataFrame | None = None, back: bool = False) -> DataFrame:
    """Distinct (src, dst) joined by a walk of low..high of the distinct edges; without ``high``, of low or more.

    seeds(id): only walks from these (to these if ``back``). Every level keeps the pairs that it found first and is stored; the
    end is reached when one is empty, however long the walks are. With low 0, seeds reach themselves.
    """
    if back:
        turned = walks(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), low, high, seeds)
        return turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = materialize(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "steps")
    first = edges if seeds is None else edges.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi")
    if low == 0:
        now = materialize(seeds.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct(), "walks")
    else:
        now = materialize(first.select("src", "dst").distinct(), "walks")
    n = 0 if low == 0 else 1
    onward = lambda t: dealt_join(t, step, ["dst"]).select("src", F.col("next").alias("dst")).distinct()
    while n < low:
        now, n = materialize(onward(now), "walks"), n + 1
    found = now
    while (high is None or n < high) and now.limit(1).count():
        now, n = materialize(onward(now).join(found, ["src", "dst"], "left_anti"), "walks"), n + 1
        found = found.unionAll(now)
        if n % 8 == 0:
            # One table again, so that long walks don't read one table a level.
            found = materialize(found, "walks")
    return found


def told_walks(edges: DataFrame, low: int, high: int | None, seeds: DataFrame, told: DataFrame) -> DataFrame:
    """Distinct (src, *values): the values that told(id, *values) has for the ends of walks of low..high from seeds(id).

    As ``walks``, but the last hop is one to the values that lie an edge away, which are fewer than the nodes that have them, and a
    seed that has every value there is walks no farther.
    """
    values = [c for c in told.columns if c != "id"]
    step = materialize(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "steps")
    near = materialize(step.join(told.withColumnRenamed("id", "next"), "next").select("dst", *values).distinct(), "near")
    every = told.select(*values).distinct().count()
    onward = lambda t: dealt_join(t, step, ["dst"]).select("src", F.col("next").alias("dst")).distinct()
    meets = lambda t: dealt_join(t, near, ["dst"]).select("src", *values).distinct()
    now = materialize(seeds.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct(), "walks")
    own, n = now.join(told.withColumnRenamed("id", "dst"), "dst").select("src", *values), 1
    while n < low:
        now, n = materialize(onward(now), "walks"), n + 1
    if high == 0:
        return own.distinct()
    walked, found = now, materialize(meets(now).unionAll(own).distinct() if low == 0 else meets(now), "found")
    while high is None or n < high:
        done = found.groupBy("src").agg(F.count("*").alias("values")).where(F.col("values") >= every)
        now = onward(materialize(now.join(done, "src", "left_anti"), "walks")).join(walked, ["src", "dst"], "left_anti")
        now, n = materialize(now, "walks"), n + 1
        if not now.limit(1).count():
            break
        found = materialize(found.unionAll(meets(now)).distinct(), "found")
        walked = walked.unionAll(now)
        if n % 8 == 0:
            # One table again, so that long walks don't read one table a level.
            walked = materialize(walked, "walks")
    return found


def compile_query(graph: PropertyGraph, text: str, params: dict | None = None) -> DataFrame:
    """The DataFrame of a query over the graph; raises CypherError where the text is outside the dialect."""
    return Parser(graph, text, params).query()
