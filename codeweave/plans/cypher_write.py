"""Cypher statements that change a graph: each gives a new graph, whose tables are plans over the old ones.

Data: CREATE nodes and edges, MERGE with ON CREATE SET and ON MATCH SET, SET, DELETE and DETACH DELETE, after any MATCH, UNWIND or
WITH. Tables: CREATE NODE TABLE, CREATE REL TABLE, ALTER TABLE ADD or DROP, DROP TABLE, COPY FROM a Parquet or CSV file and COPY of a
query TO one. BEGIN TRANSACTION and COMMIT are accepted: a graph is a value, so a script takes effect as a whole when it is saved.

Nodes are told apart by ``id``. A node or edge that several rows set gets the value that sorts first.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.plans.cypher import CypherError, Edge, Item, Node, Parser

if TYPE_CHECKING:
    from codeweave.plans.graph import PropertyGraph

TYPES = {"STRING": "string", "INT": "int", "INT32": "int", "INT64": "bigint", "SERIAL": "bigint", "BOOL": "boolean", "BOOLEAN": "boolean", "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp"}


class Writer(Parser):
    def __init__(self, graph: PropertyGraph, text: str, params: dict | None = None):
        from codeweave.plans.graph import PropertyGraph as Graph

        super().__init__(Graph(dict(graph.nodes), dict(graph.edges)), text, params)
        self.labels: dict[str, str] = {}

    def script(self) -> PropertyGraph:
        """All statements, separated by semicolons."""
        while self.at < len(self.tokens):
            if not self.take(";"):
                self.statement()
        return self.graph

    def statement(self) -> None:
        if self.take("BEGIN", "TRANSACTION") or self.take("COMMIT"):
            return
        if self.take("CREATE", "NODE", "TABLE"):
            return self.create_table(self.graph.nodes)
        if self.take("CREATE", "REL", "TABLE"):
            return self.create_table(self.graph.edges)
        if self.take("ALTER", "TABLE"):
            return self.alter_table()
        if self.take("DROP", "TABLE"):
            there = self.take("IF", "EXISTS")
            name = self.name()
            if not there:
                self.tables(name)
            self.graph.nodes.pop(name, None)
            self.graph.edges.pop(name, None)
            return None
        if self.take("COPY"):
            return self.copy()
        return self.update()

    # --- tables ------------------------------------------------------------------------------------------------------

    def tables(self, name: str) -> dict[str, DataFrame]:
        for tables in (self.graph.nodes, self.graph.edges):
            if name in tables:
                return tables
        raise CypherError(f"no table {name}")

    def column(self) -> tuple[str, str]:
        name, kind = self.name(), self.name().upper()
        if kind not in TYPES:
            raise CypherError(f"no type {kind}")
        array = self.take("[", "]")
        return name, f"array<{TYPES[kind]}>" if array else TYPES[kind]

    def create_table(self, tables: dict[str, DataFrame]) -> None:
        careful = self.take("IF", "NOT", "EXISTS")
        name = self.name()
        self.need("(")
        columns = [] if tables is self.graph.nodes else [("src", "string"), ("dst", "string")]
        while not self.take(")"):
            if self.take("PRIMARY", "KEY"):
                self.need("(")
                self.name()
                self.need(")")
            elif self.take("FROM"):
                ends = [self.name()]
                self.need("TO")
                ends.append(self.name())
                for k, end in enumerate(ends):
                    if end in self.graph.nodes:
                        columns[k] = (columns[k][0], dict(self.graph.nodes[end].dtypes)["id"])
            else:
                columns.append(self.column())
                self.take("PRIMARY", "KEY")
            self.take(",")
        if name in self.graph.nodes or name in self.graph.edges:
            if not careful:
                raise CypherError(f"table {name} exists")
            return
        if tables is self.graph.nodes and "id" not in dict(columns):
            raise CypherError("a node table needs a column id")
        tables[name] = self.spark().createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in columns))

    def alter_table(self) -> None:
        name = self.name()
        tables = self.tables(name)
        if self.take("ADD"):
            careful = self.take("IF", "NOT", "EXISTS")
            column, kind = self.column()
            value = self.literal() if self.take("DEFAULT") else None
            if column not in tables[name].columns:
                tables[name] = tables[name].withColumn(column, F.lit(value).cast(kind))
            elif not careful:
                raise CypherError(f"column {column} exists")
        else:
            self.need("DROP")
            careful = self.take("IF", "EXISTS")
            column = self.name()
            if column not in tables[name].columns and not careful:
                raise CypherError(f"no column {column}")
            tables[name] = tables[name].drop(column)

    def copy(self) -> None:
        if self.take("("):
            rows, scope = None, {}
            while not self.peek("RETURN"):
                rows, scope = self.reading(rows, scope)
            self.need("RETURN")
            rows, _ = self.project(rows, scope, True)
            self.need(")", "TO")
            path = self.literal()
            options = self.options()
            if str(path).endswith(".csv"):
                return rows.write.options(header=options.get("header", False), sep=options.get("delim", ",")).csv(path)
            return rows.write.parquet(path)
        name = self.name()
        tables = self.tables(name)
        target = tables[name]
        columns = []
        if self.take("("):
            while not self.take(")"):
                columns.append(self.name())
                self.take(",")
        self.need("FROM")
        path = self.literal()
        options = self.options()
        if str(path).split("?")[0].endswith(".csv"):
            schema = ", ".join(f"`{c}` {t}" for c, t in target.dtypes if not columns or c in columns)
            got = self.spark().read.options(header=options.get("header", False), sep=options.get("delim", ",")).schema(schema).csv(path)
        else:
            got = self.spark().read.parquet(path)
            if not set(columns or target.columns) <= set(got.columns):
                # Files without the table's names are taken by position.
                got = got.toDF(*(columns or target.columns)[: len(got.columns)])
            got = got.select(*(columns or [c for c in target.columns if c in got.columns]))
        tables[name] = self.added(target, got)

    def options(self) -> dict:
        out = {}
        if self.take("("):
            while not self.take(")"):
                key = self.name().lower()
                self.need("=")
                out[key] = self.literal()
                self.take(",")
        return out

    def added(self, target: DataFrame, rows: DataFrame) -> DataFrame:
        """target and rows; columns of rows take the target's types, new ones are added."""
        kinds = dict(target.dtypes)
        rows = rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns))
        return target.unionByName(rows, allowMissingColumns=True)

    # --- data --------------------------------------------------------------------------------------------------------

    def update(self) -> None:
        rows, scope = None, {}
        while self.at < len(self.tokens) and not self.peek(";"):
            if self.take("CREATE"):
                rows, scope = self.create(rows, scope)
            elif self.take("MERGE"):
                rows, scope = self.merge(rows, scope)
            elif self.take("SET"):
                self.set(rows, scope, self.assignments(scope))
            elif self.take("DETACH", "DELETE"):
                self.delete(rows, scope, True)
            elif self.take("DELETE"):
                self.delete(rows, scope, False)
            else:
                start = self.at
                rows, scope = self.reading(rows, scope)
                self.note(start)

    def note(self, start: int) -> None:
        """Remember the labels of the nodes that a clause names."""
        for (_, a), (_, colon), (_, label) in zip(self.tokens[start : self.at], self.tokens[start + 1 : self.at], self.tokens[start + 2 : self.at]):
            if colon == ":" and label in self.graph.nodes:
                self.labels[a] = label

    def one_row(self, rows: DataFrame | None) -> DataFrame:
        return rows if rows is not None else self.spark().range(1).select(F.lit(1).alias("_one"))

    def pattern(self, scope: dict) -> tuple[list[list], dict]:
        self.outer = scope
        chains, own = self.chains()
        self.outer = {}
        return chains, own

    def create(self, rows: DataFrame | None, scope: dict) -> tuple[DataFrame, dict]:
        chains, _ = self.pattern(scope)
        rows = self.one_row(rows)
        for chain in chains:
            for node in (p for p in chain if isinstance(p, Node)):
                if node.var not in scope:
                    rows, scope = self.create_node(rows, scope, node)
            for left, edge, right in zip(chain[::2], chain[1::2], chain[2::2]):
                a, b = self.ends(left, edge, right)
                new = rows.select(F.col(f"{a}__id").alias("src"), F.col(f"{b}__id").alias("dst"), *(v.column.alias(k) for k, v in edge.props.items()))
                kind = self.edge_kind(edge)
                self.graph.edges[kind] = self.added(self.graph.edges[kind], new) if kind in self.graph.edges else new
        return rows, scope

    def ends(self, left: Node, edge: Edge, right: Node) -> tuple[str, str]:
        if edge.low is not None or edge.way == "both":
            raise CypherError("a new edge has one step and one direction")
        return (right.var, left.var) if edge.way == "in" else (left.var, right.var)

    def edge_kind(self, edge: Edge) -> str:
        if len(edge.kinds) != 1:
            raise CypherError("a new edge needs one type")
        return edge.kinds[0]

    def create_node(self, rows: DataFrame, scope: dict, node: Node) -> tuple[DataFrame, dict]:
        if node.label is None or "id" not in node.props:
            raise CypherError("a new node needs a label and an id")
        columns = {f"{node.var}__{k}": v.column for k, v in node.props.items()}
        rows = rows.withColumns(columns)
        new = rows.select(*(F.col(c).alias(c[len(node.var) + 2 :]) for c in columns))
        self.graph.nodes[node.label] = self.added(self.graph.nodes[node.label], new) if node.label in self.graph.nodes else new
        self.labels[node.var] = node.label
        return rows, scope | {node.var: "node"}

    def assignments(self, scope: dict) -> list[tuple[str, str, Item]]:
        """(variable, property, value) of a SET list."""
        out = []
        while True:
            var = self.name()
            self.need(".")
            key = self.name()
            self.need("=")
            out.append((var, key, self.expression(scope)))
            if not self.take(","):
                return out

    def merge(self, rows: DataFrame | None, scope: dict) -> tuple[DataFrame, dict]:
        chains, own = self.pattern(scope)
        if len(chains) != 1 or len(chains[0]) not in (1, 3):
            raise CypherError("MERGE takes one node or one edge")
        chain = chains[0]
        after = scope | own
        created, matched = [], []
        while self.peek("ON"):
            if self.take("ON", "CREATE", "SET"):
                created += self.assignments(after)
            else:
                self.need("ON", "MATCH", "SET")
                matched += self.assignments(after)
        if self.take("SET"):
            always = self.assignments(after)
            created, matched = created + always, matched + always
        rows = self.one_row(rows)
        if len(chain) == 1:
            return self.merge_node(rows, scope, chain[0], created, matched)
        left, edge, right = chain
        a, b = self.ends(left, edge, right)
        if a not in scope or b not in scope:
            raise CypherError("the ends of a merged edge must be bound before")
        kind, keys = self.edge_kind(edge), ["src", "dst", *edge.props]
        rows = rows.withColumns({f"{edge.var}__src": F.col(f"{a}__id"), f"{edge.var}__dst": F.col(f"{b}__id"), **{f"{edge.var}__{k}": v.column for k, v in edge.props.items()}})
        table = self.graph.edges.get(kind)
        if table is None:
            table = rows.select(*(F.col(f"{edge.var}__{k}").alias(k) for k in keys)).limit(0)
        self.graph.edges[kind] = self.merged(table, rows, edge.var, keys, created, matched)
        return rows, after

    def merge_node(self, rows: DataFrame, scope: dict, node: Node, created: list, matched: list) -> tuple[DataFrame, dict]:
        if node.label is None or "id" not in node.props:
            raise CypherError("a merged node needs a label and an id")
        rows = rows.withColumns({f"{node.var}__{k}": v.column for k, v in node.props.items()})
        keys = list(node.props)
        table = self.graph.nodes.get(node.label)
        if table is None:
            table = rows.select(*(F.col(f"{node.var}__{k}").alias(k) for k in keys)).limit(0)
        self.graph.nodes[node.label] = self.merged(table, rows, node.var, keys, created, matched)
        self.labels[node.var] = node.label
        return rows, scope | {node.var: "node"}

    def merged(self, table: DataFrame, rows: DataFrame, var: str, keys: list[str], created: list, matched: list) -> DataFrame:
        """table with a row for each key in rows: those that were there get the matched values, the others the created ones."""
        kinds = dict(table.dtypes)
        typed = lambda c, k: c.cast(kinds[k]) if k in kinds else c
        near = rows.select("*", *(typed(F.col(f"{var}__{k}"), k).alias(f"_k_{k}") for k in keys))
        # Values may refer to what the row had before.
        old = table.select(*(F.col(c).alias(f"_old_{c}") for c in table.columns), F.lit(True).alias("_there"))
        on = [F.col(f"_k_{k}").eqNullSafe(F.col(f"_old_{k}")) for k in keys]
        both = near.join(old, on, "left")
        both = both.withColumns({f"{var}__{c}": F.col(f"_old_{c}") for c in table.columns if c not in keys})
        names = list(dict.fromkeys([k for _, k, _ in created] + [k for _, k, _ in matched]))
        pick = lambda sets, k: next((v.column for w, key, v in reversed(sets) if key == k and w == var), None)
        values = {}
        for k in names:
            before = F.col(f"_old_{k}") if k in table.columns else F.lit(None)
            hit, new = pick(matched, k), pick(created, k)
            values[k] = typed(F.when(F.col("_there"), before if hit is None else hit).otherwise(F.lit(None) if new is None else new), k)
        said = both.select(*(F.col(f"_k_{k}").alias(k) for k in keys), *(v.alias(f"_new_{k}") for k, v in values.items()))
        said = said.groupBy(*keys).agg(F.min(F.struct(F.lit(True), *(F.col(f"_new_{k}") for k in names))).alias("_said"))
        told = said.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_said")
        whole = table.join(told, [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys], "full_outer")
        columns = []
        for c in [*table.columns, *(k for k in [*keys, *names] if k not in table.columns)]:
            have = F.col(c) if c in table.columns else F.lit(None)
            if c in names:
                have = F.when(F.col("_said").isNotNull(), F.col(f"_said._new_{c}")).otherwise(have)
            elif c in keys:
                have = F.coalesce(have, F.col(f"_k_{c}"))
            columns.append(have.alias(c))
        return whole.select(columns)

    def set(self, rows: DataFrame, scope: dict, assignments: list[tuple[str, str, Item]]) -> None:
        for var in dict.fromkeys(v for v, _, _ in assignments):
            own = [(k, item) for v, k, item in assignments if v == var]
            if scope.get(var) == "node":
                name, keys, tables = self.labels.get(var), ["id"], self.graph.nodes
            elif scope.get(var) == "edge":
                name, keys, tables = (self.kinds.get(var) or [None])[0], ["src", "dst"], self.graph.edges
            else:
                raise CypherError(f"no node or edge {var}")
            for table in [name] if name else list(tables):
                target = tables[table]
                kinds = dict(target.dtypes)
                key = {"id": F.col(f"{var}__id")} if keys == ["id"] else {k: F.col(f"{var}__id.{k}") for k in keys}
                new = rows.select(*(c.alias(k) for k, c in key.items()), *(item.column.cast(kinds[k]).alias(f"_new_{k}") if k in kinds else item.column.alias(f"_new_{k}") for k, item in own))
                new = new.groupBy(*keys).agg(F.min(F.struct(F.lit(True), *(F.col(f"_new_{k}") for k, _ in own))).alias("_said"))
                both = target.join(new, keys, "left")
                names = [k for k, _ in own]
                value = lambda c: F.when(F.col("_said").isNotNull(), F.col(f"_said._new_{c}")).otherwise(F.col(c) if c in kinds else F.lit(None))  # noqa: B023, E731
                tables[table] = both.select(*((value(c).alias(c) if c in names else F.col(c)) for c in [*target.columns, *(k for k in names if k not in kinds)]))

    def delete(self, rows: DataFrame, scope: dict, detach: bool) -> None:
        gone = [self.name()]
        while self.take(","):
            gone.append(self.name())
        for var in gone:
            if scope.get(var) == "edge":
                for kind in self.kinds.get(var) or list(self.graph.edges):
                    table = self.graph.edges[kind]
                    ends = rows.select(F.col(f"{var}__id.src").alias("src"), F.col(f"{var}__id.dst").alias("dst"), *(F.col(f"{var}__{c}").alias(c) for c in table.columns if c not in ("src", "dst") and f"{var}__{c}" in rows.columns)).distinct()
                    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ends.columns]
                    self.graph.edges[kind] = table.alias("l").join(ends.alias("r"), same, "left_anti")
            elif scope.get(var) == "node":
                ids = rows.select(F.col(f"{var}__id").alias("id")).distinct()
                if not detach:
                    for kind, table in self.graph.edges.items():
                        if table.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").limit(1).count() or table.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").limit(1).count():
                            raise CypherError(f"a node to delete has {kind} edges: DETACH DELETE takes them along")
                label = self.labels.get(var)
                left = self.graph.without(ids)
                self.graph.nodes.update({k: t for k, t in left.nodes.items() if label in (None, k)})
                self.graph.edges.update(left.edges)
            else:
                raise CypherError(f"no node or edge {var}")


def execute(graph: PropertyGraph, text: str, params: dict | None = None) -> PropertyGraph:
    """The graph after a script of statements; raises CypherError where the text is outside the dialect."""
    return Writer(graph, text, params).script()
