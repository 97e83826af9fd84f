"""Ad-hoc questions about an indexed collection: small answers as plain dictionaries.

Every answer is {"rows": [...], "total": n, "truncated": bool}; bad input raises ValueError; nothing is written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators import graph, text
from loomdex.plans import attributes, findings, inference, module_graph
from loomdex.plans.session import cut, table

#: Rows of an answer; the total always counts all.
LIMIT = 200


class Facts:
    def __init__(self, spark: SparkSession, sf_dir: str, limit: int = LIMIT):
        self.spark, self.dir, self.limit = spark, sf_dir, limit
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = cut(module_graph.edges(self.spark, self.dir))
        return self._edges

    def _answer(self, df: DataFrame, *order: str) -> dict:
        rows = [json.loads(r[0]) for r in df.orderBy(*(order or df.columns)).select(F.to_json(F.struct("*"))).limit(self.limit + 1).collect()]
        total = len(rows) if len(rows) <= self.limit else df.count()
        return {"rows": rows[: self.limit], "total": total, "truncated": total > self.limit}

    def _node(self, name: str) -> str:
        if not name or not name.strip():
            raise ValueError("a name is needed")
        return name.strip()

    def summary(self) -> dict:
        f = table(self.spark, self.dir, "files")
        return self._answer(f.groupBy("ext").agg(F.countDistinct("id").alias("files"), F.count_if(F.col("status") == "error").alias("errors")))

    def exists(self, name: str) -> dict:
        """Files and base resources of that name (resref, resref.ext or node id)."""
        n = self._node(name).lower()
        f = table(self.spark, self.dir, "files").where((F.lower("node") == n) | (F.col("resref") == n) | (F.concat_ws(".", "resref", "ext") == n))
        b = table(self.spark, self.dir, "base_resources").where((F.lower("name") == n) | F.lower("name").startswith(n + "."))
        return self._answer(f.select("node", F.col("source_id").cast("string").alias("origin")).distinct().unionByName(b.select(F.lower("name").alias("node"), F.lit("base game").alias("origin"))))

    def who_uses(self, node: str) -> dict:
        return self._answer(self.edges.where(F.col("dst") == self._node(node)))

    def uses(self, node: str) -> dict:
        return self._answer(self.edges.where(F.col("src") == self._node(node)))

    def impact(self, node: str) -> dict:
        start = self.spark.createDataFrame([(self._node(node),)], "node string")
        hard = cut(graph.impact(self.edges, start))
        live = graph.reachable(self.edges, module_graph.roots(self.spark, self.dir))
        return {"level": graph.judge(hard, start, live).first().level} | self._answer(hard.select("node", "how"))

    def path(self, node: str) -> dict:
        roots = module_graph.roots(self.spark, self.dir)
        return self._answer(graph.paths(self.edges, roots).where(F.col("node") == self._node(node)))

    def grep(self, pattern: str) -> dict:
        """Lines of all documents that match a regular expression."""
        import re

        try:
            re.compile(self._node(pattern))
        except re.error as e:
            raise ValueError(f"bad pattern: {e}") from None
        return self._answer(text.grep(table(self.spark, self.dir, "documents"), "doc_id", "text", pattern))

    def script(self, doc_id: int, first: int = 1, last: int = 200) -> dict:
        if last < first:
            raise ValueError("last is before first")
        d = table(self.spark, self.dir, "documents").where(F.col("doc_id") == int(doc_id))
        return self._answer(text.lines(d, "doc_id", "text").where(F.col("line").between(first, last)), "line")

    def variable(self, name: str) -> dict:
        return self._answer(inference.script_literals(self.spark, self.dir).where((F.col("literal") == self._node(name)) & F.col("func").isin("SetLocalInt", "GetLocalInt")))

    def tag(self, tag: str) -> dict:
        g = table(self.spark, self.dir, "gff_fields").where((F.col("path") == "Tag") & (F.col("value") == self._node(tag)))
        f = table(self.spark, self.dir, "files").select(F.col("id").alias("file_id"), "node").distinct()
        return self._answer(g.join(f, "file_id").select("node", "file_id"))

    def fields(self, label: str, value: str | None = None) -> dict:
        g = table(self.spark, self.dir, "gff_fields").where(F.lower("label") == self._node(label).lower())
        return self._answer(g if value is None else g.where(F.col("value") == value))

    def faction(self, number: str) -> dict:
        return self._answer(inference.faction_members(self.spark, self.dir).where(F.col("faction") == self._node(number)))

    def issues(self, category: str | None = None) -> dict:
        if category is not None and category not in findings.rules.REGISTRY:
            raise ValueError("no such category; there are " + ", ".join(sorted(findings.rules.REGISTRY)))
        df = findings.issues(self.spark, self.dir) if category is None else findings.rules.REGISTRY[category](self.spark, self.dir)
        return self._answer(df)

    def compiled(self) -> dict:
        """Scripts without their compiled form, and the other way round."""
        return self._answer(findings.rules.run_all(self.spark, self.dir, only=("compiled_without_source", "not_compiled")))

    def misfits(self) -> dict:
        return self._answer(attributes.p3_found(self.spark, self.dir))
