"""Results kept between runs.

A run appends its rows to a folder of its own and only then a marker for each query
it answered; rows of unfinished runs have no marker and are never read.  Inputs
are not rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.workspace import Stored, Workspace, shuffles_dropped

CANDIDATES = "candidates"
RANKED = "ranked"
# Candidates don't depend on the centrality.
ANY_CENTRALITY = "any"

ROWS = {
    CANDIDATES: "query_id bigint, from bigint, to bigint, run string",
    RANKED: "query_id bigint, from bigint, to bigint, score double, run string",
}
MARKERS = "query_id bigint, run string"


def _read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class TableSet:
    """Several tables that are published together.

    A run writes each into its own folder and then one marker; readers take the tables of the first run that has one, so
    they never see some of a run's tables without the others.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _run(self) -> str | None:
        """The published run: one, as later ones write no marker where there is one."""
        first = _read_parquet(self.spark, f"{self.root}/done", "run string").agg(F.min("run")).first()
        return first[0]

    def read(self) -> dict[str, DataFrame] | None:
        """The published tables by name, or None."""
        run = self._run()
        if run is None:
            return None
        names = _read_parquet(self.spark, f"{self.root}/done", "run string, name string")
        own = names.where(F.col("run") == run).select("name").collect()
        return {r["name"]: self.spark.read.parquet(f"{self.root}/run={run}/{r['name']}") for r in own}

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables of a run, unpublished."""
        run = uuid4().hex
        for name, table in tables.items():
            with shuffles_dropped(self.spark):
                table.write.parquet(f"{self.root}/run={run}/{name}")
        return run

    def publish(self, run: str, names: list[str]) -> None:
        """One file with all names makes them readable at once."""
        marker = self.spark.createDataFrame([(run, n) for n in names], "run string, name string")
        marker.coalesce(1).write.mode("append").parquet(f"{self.root}/done")

    def get_or_build(self, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The published tables, built first where there are none."""
        found = self.read()
        if found is None:
            made = build()
            self.publish(self.write(made), list(made))
            found = self.read()
        return found


class ResultStore:
    """Candidates by step and rankings by step and centrality, for one set of languages."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _folder(self, top: str, kind: str, step: int, centrality: str) -> str:
        return f"{self.root}/{top}/kind={kind}/step={step}/centrality={centrality}"

    def _read(self, path: str, schema: str) -> DataFrame:
        return _read_parquet(self.spark, path, schema)

    def done(self, kind: str, step: int, centrality: str = ANY_CENTRALITY) -> DataFrame:
        """``(query_id, run)`` of the queries answered so far."""
        return self._read(self._folder("done", kind, step, centrality), MARKERS)

    def pending(
        self, queries: DataFrame, kind: str, step: int, centrality: str = ANY_CENTRALITY
    ) -> DataFrame:
        """The ``queries(query_id, ...)`` without a result of just this step and centrality."""
        return queries.join(self.done(kind, step, centrality), "query_id", "left_anti")

    def write(
        self, rows: DataFrame, kind: str, step: int, centrality: str = ANY_CENTRALITY
    ) -> str:
        """Write a run's rows; until ``commit`` nobody reads them."""
        run = uuid4().hex
        columns = [c.strip().split()[0] for c in ROWS[kind].split(",")][:-1]
        with shuffles_dropped(self.spark):
            rows.select(*columns).write.parquet(
                f"{self._folder('rows', kind, step, centrality)}/run={run}"
            )
        return run

    def commit(
        self, queries: DataFrame, run: str, kind: str, step: int, centrality: str = ANY_CENTRALITY
    ) -> None:
        """Mark some queries as answered by a run; queries without rows count as answered."""
        marked = queries.select("query_id", F.lit(run).alias("run")).distinct()
        with shuffles_dropped(self.spark):
            marked.write.mode("append").parquet(self._folder("done", kind, step, centrality))

    def append(
        self,
        queries: DataFrame,
        rows: DataFrame,
        kind: str,
        step: int,
        centrality: str = ANY_CENTRALITY,
    ) -> str:
        """Add the rows found for some queries."""
        run = self.write(rows, kind, step, centrality)
        self.commit(queries, run, kind, step, centrality)
        return run

    def load(
        self,
        ws: Workspace,
        queries: DataFrame,
        kind: str,
        step: int,
        centrality: str = ANY_CENTRALITY,
    ) -> Stored:
        """The stored rows of some queries."""
        first = self.done(kind, step, centrality).groupBy("query_id").agg(F.min("run").alias("run"))
        wanted = queries.select("query_id").distinct().join(first, "query_id")
        rows = self._read(self._folder("rows", kind, step, centrality), ROWS[kind])
        found = rows.join(wanted, ["query_id", "run"], "left_semi").drop("run")
        return ws.save(found, kind)

    def page_status(
        self, pages: DataFrame, step: int, centrality: str = "HITS"
    ) -> DataFrame:
        """Pages with the step of their stored candidates (0 for none) and whether they are ranked."""

        def receivers(kind: str, how: str) -> DataFrame:
            rows = self._read(self._folder("rows", kind, step, how), ROWS[kind])
            kept = rows.join(self.done(kind, step, how), ["query_id", "run"], "left_semi")
            return kept.select(F.col("from").alias("sid")).distinct()

        found = receivers(CANDIDATES, ANY_CENTRALITY).withColumn("step", F.lit(step))
        ranked = receivers(RANKED, centrality).withColumn("ranked", F.lit(True))
        return (
            pages.join(found, "sid", "left")
            .join(ranked, "sid", "left")
            .withColumns(
                {
                    "step": F.coalesce("step", F.lit(0)),
                    "ranked": F.coalesce("ranked", F.lit(False)),
                }
            )
        )
