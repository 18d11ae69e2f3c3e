"""A whole run: archives and source tables in, evidence tables and a report out."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, quality
from ..sources import archives as src
from ..sources.documents import write_document
from . import code_index, native, packet, resources
from .config import Config
from .runs import Phase, cache_key, cached_phase, guard, input_fingerprint, phase_table, run_context, run_flags

SCHEMA = "1"


class Run:
    """Runs the phases in order. Each writes Parquet to the workspace and is reused while nothing changes.

    archives: a folder of archives (or a bundle). sources: a folder of decompiled files, if there are any.
    libraries: a table of native.LIBRARY rows, as the symbol tools leave it, if there is one.
    """

    def __init__(self, spark: SparkSession, config: Config, sources: str | None = None, libraries: DataFrame | None = None) -> None:
        config.validate()
        self.spark, self.config, self.sources, self.libraries = spark, config, sources, libraries
        self.workspace = Path(config.workspace)
        self.phases: list[Phase] = []

    def path(self, name: str) -> str:
        return str(self.workspace / name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _save(self, name: str, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.path(name)

    def _phase(self, name: str, outputs: list[str], settings: Any, upstream: list[str], compute: Callable[[], Phase]) -> Phase:
        key = cache_key(name, SCHEMA, self.fingerprint, settings, map(self.path, upstream))
        try:
            result = cached_phase(self.path(f"{name}.cache.json"), key, [self.path(o) for o in outputs], compute, self.config.force)
        except Exception as e:  # noqa: BLE001 - one phase's failure must not lose the others' results
            result = Phase(name, "failed", trouble=f"{type(e).__name__}: {e}")
        self.phases.append(result)
        return result

    def execute(self) -> dict[str, Any]:
        self.fingerprint = input_fingerprint(self.spark, self.config.input)
        guard(self.workspace, self.fingerprint)
        write_document(self.path("run.json"), run_context(self.fingerprint, self.config))
        first = self._phase("inventory", ["archives"], None, [], self._inventory)
        if first.status == "failed":
            # nothing sound to read: later phases would only repeat the failure
            self.phases += [Phase(n, "skipped", trouble="the inventory failed") for n in ("code", "native", "resources", "evidence")]
        else:
            c = self.config
            self._phase("code", ["files", "packages", "code_units"], [c.app_package, c.first_party_prefixes, c.third_party_prefixes, c.snippets_per_capability, self.sources], ["archives"], self._code)
            self._phase("native", ["targets", "tasks", "queue", "native_units"], [c.app_package, c.max_targets, c.max_libraries, c.per_library, c.target_capabilities, c.review_limit, c.first_party_hashes, c.third_party_hashes], ["files"], self._native)
            self._phase("resources", ["records", "resource_units"], [c.resource_scan], ["archives"], self._resources)
            self._phase("evidence", ["units", "nodes", "edges", "sample"], None, ["code_units", "native_units", "resource_units"], self._evidence)
        out = {"phases": [p._asdict() for p in self.phases], **run_flags(phase_table(self.spark, self.phases))}
        write_document(self.path("summary.json"), out)
        return out

    def _sound(self) -> DataFrame:
        good = self.table("archives").where("success").select("archive")
        return src.read_archives(self.spark, self.config.input).join(good, "archive", "left_semi")

    def _inventory(self) -> Phase:
        records = src.inventory(src.entries(src.read_archives(self.spark, self.config.input)))
        path = self._save("archives", records)
        n = self.table("archives").agg(F.count("*").alias("n"), F.count_if("success").alias("ok")).first()
        status = "failed" if not n["ok"] else "success" if n["n"] == n["ok"] else "partial"
        return Phase("inventory", status, [path], {"archives": n["n"], "sound": n["ok"]})

    def _code(self) -> Phase:
        if self.sources is None:
            empty = self.spark.createDataFrame([], "file string, text string")
            files, status = empty, "skipped"
        else:
            files, status = src.text_files(self.spark, self.sources), "success"
        index = code_index.index_files(files, self.config)
        self._save("files", index)
        index = self.table("files")
        snips = code_index.snippets(index)
        outputs = [self.path("files"), self._save("packages", code_index.packages(index)), self._save("code_units", code_index.units(index, snips, self.config.snippets_per_capability))]
        failed = index.where("read_status = 'failed'").count()
        return Phase("code", "partial" if failed else status, outputs, {"failed_files": failed})

    def _native(self) -> Phase:
        given = self.libraries if self.libraries is not None else self.spark.createDataFrame([], native.LIBRARY)
        records = native.analyzed(given, self.config)
        links = native.hints(self.table("files"), records)
        self._save("targets", native.targets(records, links, self.config))
        ranked = self.table("targets")
        self._save("tasks", native.tasks(records, ranked, links))
        outputs = [self.path("targets"), self.path("tasks"), self._save("queue", native.review_queue(self.table("tasks"), self.config.review_limit)), self._save("native_units", native.units(records, ranked))]
        return Phase("native", "success" if self.libraries is not None else "skipped", outputs, {"targets": ranked.count()})

    def _resources(self) -> Phase:
        rows = self._sound() if self.config.resource_scan else self._sound().limit(0)
        self._save("records", resources.records(rows))
        return Phase("resources", "success" if self.config.resource_scan else "skipped", [self.path("records"), self._save("resource_units", resources.units(self.table("records")))])

    def _evidence(self) -> Phase:
        self._save("units", packet.union_units({n: self.table(n) for n in ("code_units", "native_units", "resource_units")}))
        units = self.table("units")
        app = self.spark.createDataFrame([(self.config.app_package, None, None, None)], "package string, version_code string, version_name string, app_name string")
        g = units.withColumns({c: F.lit(None).cast("string") for c in ("signature", "name", "path", "file", "library") if c not in units.columns})
        outputs = [self._save("nodes", graph.evidence_nodes(g, app)), self._save("edges", graph.evidence_edges(g, app, [F.col("unit_id")]))]
        chosen, counts, head = packet.packet(units, {"app": self.config.app_package, "input": self.fingerprint})
        outputs.append(self._save("sample", chosen))
        write_document(self.path("packet.json"), head)
        write_document(self.path("report.md"), packet.report("Evidence", counts, packet.capability_totals(units)))
        state = self._dependencies()
        write_document(self.path("dependencies.json"), state)
        return Phase("evidence", "failed" if not head["units"] else "success" if state["complete"] else "partial", outputs, head)

    def _dependencies(self) -> dict[str, Any]:
        """Whether every table that the evidence draws on is there, and every phase before it that ran has succeeded."""
        names = ("archives", "files", "packages", "code_units", "targets", "native_units", "records", "resource_units")
        required = self.spark.createDataFrame([(n, "table") for n in names], "source string, kind string")
        present = self.spark.createDataFrame([(n, "table" if any(Path(self.path(n)).glob("*.parquet")) else "folder") for n in names if Path(self.path(n)).exists()], "source string, kind string")
        ran = phase_table(self.spark, [p for p in self.phases if p.status != "skipped"])
        return quality.dependency_state(required, present, ran).first().asDict()
