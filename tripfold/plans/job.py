"""The batch job: readings and edges in CSV, visits (and repaired trips) out in JSON.

Each CSV is parsed once. Its rows are written to the work folder as Parquet, rejected ones beside the
others, and later steps read them from there; trips are made once as well, and kept by date. A run that
failed goes on after the last step that was finished, if it is given the same inputs again.

Run as python -m tripfold.plans.job READINGS EDGES VISITS_OUT [TRIPS_OUT]
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.operators.hot import hot_entities
from tripfold.operators.trips import TRIP_SUMMARY
from tripfold.plans.journeys import journey_repaired, visits_of
from tripfold.schema import HotRule, PlaceRules
from tripfold.session import configure
from tripfold.sinks.files import write_json, write_parquet
from tripfold.sources.edges import EDGE_COLUMNS, edge_lookup, parsed_edges, usable_edges
from tripfold.sources.named import read_named
from tripfold.sources.readings import parsed_readings, read_raw_readings


@dataclass
class Work:
    """A folder of finished steps.

    A step is its rows and, written after them, its counts: rows without counts are those of a step
    that failed, and are written again.
    """

    spark: SparkSession
    folder: str

    def counts(self, name: str) -> dict[str, int] | None:
        """The counts of a finished step; None if it is not."""
        try:
            row = self.spark.read.json(f"{self.folder}/done/{name}").first()
        except AnalysisException:
            return None
        return None if row is None else row.asDict()

    def finish(self, name: str, counts: Mapping[str, int | str]) -> None:
        done = self.spark.createDataFrame([dict(counts)])
        done.coalesce(1).write.mode("overwrite").json(f"{self.folder}/done/{name}")

    def step(
        self,
        name: str,
        make: Callable[[], DataFrame],
        counts: Mapping[str, Column],
        partition_by: Sequence[str] = (),
    ) -> dict[str, int]:
        """Makes and writes the rows of a step, unless that is done; returns its counts."""
        known = self.counts(name)
        if known is None:
            known = write_parquet(make(), f"{self.folder}/{name}", "overwrite", partition_by, counts=counts)
            self.finish(name, known)
        return known

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def begin(self, inputs: Mapping[str, str]) -> None:
        """Fails if the folder's steps were made from other inputs."""
        before = self.counts("inputs")
        if before is not None and before != inputs:
            raise ValueError(f"{self.folder} holds the work of another run: {before}")
        self.finish("inputs", inputs)


def run(
    spark: SparkSession,
    readings_path: str,
    edges_path: str,
    visits_path: str,
    trips_path: str | None = None,
    rules: PlaceRules = PlaceRules(),
    heat: HotRule = HotRule(),
    single_file: bool = False,
    work_path: str | None = None,
    dated_path: str | None = None,
) -> dict[str, int]:
    """Writes the results; returns how many readings and edges were used and rejected, and how many
    repaired trips and visits there are.

    The work folder is `visits_path` with `.work` behind it unless given. A second run with that
    folder and the same paths and rules makes only what is missing. It holds `readings` and `edges`
    by status, `repaired_trips` by date, and `visits`. With `dated_path` the repaired trips are also
    written to a table by date that other runs share: the dates of this run are replaced.
    """
    configure(spark)
    work = Work(spark, work_path or visits_path.rstrip("/") + ".work")
    work.begin({"readings": readings_path, "edges": edges_path, "rules": repr(rules)})

    def sorted_out(parsed: DataFrame) -> DataFrame:
        return parsed.withColumn("status", F.when(F.col("reason").isNull(), "used").otherwise("rejected"))

    def split(name: str) -> dict[str, Column]:
        used = F.col("status") == "used"
        return {name: F.count_if(used), f"rejected_{name}": F.count_if(~used)}

    counts = work.step(
        "readings",
        lambda: sorted_out(parsed_readings(read_raw_readings(spark, readings_path))),
        split("readings"),
        ["status"],
    )
    counts |= work.step(
        "edges",
        lambda: sorted_out(parsed_edges(read_named(spark, edges_path, EDGE_COLUMNS))),
        split("edges"),
        ["status"],
    )
    readings = work.rows("readings").where("status = 'used'").drop("time_text", "reason", "status")
    edges = usable_edges(work.rows("edges").where("status = 'used'")).drop("status")

    def repaired_trips() -> DataFrame:
        return journey_repaired(readings, edge_lookup(edges), rules, hot_entities(readings, heat))

    number = F.count(F.lit(1))
    counts |= work.step("repaired_trips", repaired_trips, {"repaired_trips": number}, ["date"])
    repaired = work.rows("repaired_trips").select(*TRIP_SUMMARY)
    if dated_path:
        write_parquet(repaired, dated_path, "overwrite", ["date"], only_these=True)
    if trips_path and work.counts("trips_out") is None:
        write_json(repaired, trips_path, "overwrite", single_file)
        work.finish("trips_out", {"path": trips_path})

    def visits() -> DataFrame:
        return visits_of(repaired, rules, hot_entities(readings, heat))

    counts |= work.step("visits", visits, {"visits": number})
    if work.counts("visits_out") is None:
        write_json(work.rows("visits"), visits_path, "overwrite", single_file)
        work.finish("visits_out", {"path": visits_path})
    return counts


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("tripfold").getOrCreate(), *sys.argv[1:]))
