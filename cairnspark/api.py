"""The tools as calls with their defaults, over the tables of a project.

An engine holds tables; reading calls return DataFrames, writing calls replace the table that they change (as a plan:
the caller stores it) and return what the call reports.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CONCEPT_FILES, CONCEPTS, EDGES, FILES, LOG, NODES, NOTES, RELATIONS, SESSIONS
from .operators import coverage, graph_joins, notes, rules, search
from .operators import graph_tables as gt
from .plans import betweenness, cards, closures, components, flow, gaps, impact, note_clusters
from .sources import chunks

TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "notes": NOTES, "relations": RELATIONS, "sessions": SESSIONS, "concepts": CONCEPTS, "concept_files": CONCEPT_FILES, "log": LOG}
ARCHITECTURE = "architecture"


@dataclass
class Engine:
    """tables: any of TABLES by name; the others are empty. author and project: whose notes and sessions these are."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    author: str = "local"
    project: str = ""

    def __post_init__(self) -> None:
        self.tables = {n: self.tables.get(n, self.spark.createDataFrame([], s)) for n, s in TABLES.items()}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _target(self, target: str) -> DataFrame:
        """(id) of what a target names; none: an error with the nearest names."""
        found = graph_joins.resolve_target(self.nodes, target).select("id")
        if found.isEmpty():
            near = ", ".join(r["id"] for r in graph_joins.suggestions(self.nodes, target).collect())
            raise ValueError(f"no symbol {target!r}" + (f"; there are {near}" if near else ""))
        return found

    # The graph.

    def get_impact(self, target: str, depth: int = 2, direction: str = "up", max_results: int = 0) -> DataFrame:
        return impact.impact(self.nodes, self.edges, self._target(target), depth if depth > 0 else 2, direction, max_results if max_results > 0 else impact.CAP)

    def get_context(self, target: str, depth: int = 2) -> dict[str, DataFrame]:
        return impact.context(self.nodes, self.edges, self._target(target).first()["id"], depth if depth > 0 else 2)

    def find_symbol(self, query: str) -> DataFrame:
        return graph_joins.find(self.nodes, query)

    def get_traits(self, symbol: str, depth: int = 2) -> dict[str, DataFrame]:
        one = self._target(symbol)
        traits = closures.traits_by_type(self.nodes, self.edges, one)
        return {
            "as_type": traits,
            "methods": closures.trait_methods(self.nodes, self.edges, traits.select("type", "interface")),
            "others": closures.other_implementers(self.edges, traits.select("type", "interface")),
            "as_interface": closures.implementers(self.nodes, self.edges, one),
            "impact": closures.trait_impact(self.nodes, self.edges, one.first()["id"], depth if depth > 0 else 2),
        }

    def get_flow(self, entry: str, depth: int = 5, fan_out: int = 10) -> DataFrame:
        return flow.call_trees(self.nodes, self.edges, self._target(entry), depth if depth > 0 else 5, fan_out)

    def get_bridges(self, top: int = 20) -> DataFrame:
        return betweenness.top_bridges(self.edges, top if top > 0 else 20)

    def get_cycles(self) -> DataFrame:
        return components.cycles(self.edges)

    def test_gaps(self, top: int = 20, profile: DataFrame | None = None) -> DataFrame:
        return gaps.untested_gaps(self.nodes, self.edges, top=top if top > 0 else 20, profile=profile)

    def test_scaffold(self, parts: DataFrame, budget: int) -> DataFrame:
        """Prompt parts (target, kind, ord, text) that fit a byte budget."""
        return cards.context_within(parts, budget)

    def test_mutation(self, mutants: DataFrame, threshold: float = 0.0) -> DataFrame:
        """Scores of mutants that an engine's report lists; without rows there are none, and nothing fails."""
        return coverage.mutation_gate(coverage.mutation_score(mutants), threshold)

    # Concepts.

    def get_concept(self, name: str = "") -> DataFrame:
        known = self.concepts.filter(F.col("name") != ARCHITECTURE)
        return known.filter(F.col("name") == name).select("name", "content") if name else known.select("name", "description").orderBy("name")

    def set_concept_definition(self, name: str, definition: str) -> None:
        new = self.concepts.filter(F.col("name") == name).withColumn("description", F.lit(definition))
        self.tables["concepts"] = gt.upsert_concepts(self.concepts, new)

    def get_architecture(self) -> DataFrame:
        return self.concepts.filter(F.col("name") == ARCHITECTURE).select("content")

    def set_architecture(self, text: str) -> None:
        """The overview's text without a front block."""
        body = self.spark.createDataFrame([(ARCHITECTURE, "", text)], CONCEPTS).withColumn("content", F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""))
        self.tables["concepts"] = gt.upsert_concepts(self.concepts, body)

    # Notes.

    def mem_save(self, saves: DataFrame) -> DataFrame:
        """Saves notes; returns the rejected ones."""
        self.tables["notes"] = notes.upsert(self.notes, saves)
        return notes.invalid_saves(saves)

    def mem_rescope(self, moves: DataFrame) -> None:
        self.tables["notes"] = notes.rescope(self.notes, moves, F.current_timestamp())

    def mem_delete(self, keys: DataFrame) -> None:
        self.tables["notes"] = notes.delete(self.notes, keys, F.current_timestamp())

    def mem_reconcile(self, orphans: DataFrame, clusters: DataFrame) -> DataFrame:
        return note_clusters.suggest(orphans, clusters)

    def mem_search(self, query: str, note_type: str = "", limit: int = 20) -> DataFrame:
        return search.substring_search(self.notes, query, note_type, limit if limit > 0 else 20)[0]

    def mem_recent(self, n: int = 5) -> DataFrame:
        return notes.recent(self.notes, n if n > 0 else 5)

    def mem_clusters(self, min: int = 5) -> DataFrame:  # noqa: A002
        return note_clusters.note_clusters(self.notes, min if min > 0 else 5)[0]

    def mem_conflicts(self) -> DataFrame:
        return notes.conflicts(self.relations, self.notes)

    def crystallize_save(self, label: str, body: str, source_hash: str) -> None:
        """A skill body as the record skill/<label>, with its provenance line."""
        text = f"{body.rstrip()}\n\n<!-- crystallize: source-hash={source_hash} label={label} -->\n"
        row = self.spark.createDataFrame([(f"skill/{label}", "project", "", label, text, "skill", "crystallize", self.author)], "topic_key string, scope string, project string, title string, content string, type string, source string, author string")
        self.mem_save(row.withColumn("saved_at", F.current_timestamp()))

    def mem_export(self, folder: str) -> bool:
        return notes.write_chunk(notes.export_records(self.notes, self.author), folder, self.author)

    def mem_import(self, folder: str) -> DataFrame:
        self.tables["notes"], counts = notes.import_records(self.notes, chunks.read_chunks(self.spark, folder), F.current_timestamp())
        return counts

    def mem_relate(self, new: DataFrame) -> None:
        self.tables["relations"] = notes.relate(self.relations, new)

    def mem_related(self, *ids: str) -> DataFrame:
        return notes.related_knowledge(self.relations, self.notes, self._ids(*ids))

    # Sessions.

    def _project(self) -> DataFrame:
        return self.spark.createDataFrame([(self.project,)], "project string")

    def mem_session_start(self) -> DataFrame:
        """Starts a session; returns the summary of the one that ended last before it."""
        before = notes.last_summary(self.sessions).filter(F.col("project") == self.project)
        self.tables["sessions"] = notes.start_sessions(self.sessions, self.notes, self._project(), F.current_timestamp())
        return before

    def mem_session_end(self, summary: str = "") -> None:
        self.tables["sessions"] = notes.end_sessions(self.sessions, self.notes, self._project(), F.current_timestamp(), summary)

    def mem_session_list(self, n: int = 10) -> DataFrame:
        return notes.session_list(self.sessions, self.project, n)

    # The log.

    def advise(self, clusters_ready: int = 0, uncovered: int = 0, pending: int = 0) -> DataFrame:
        return rules.evaluate(rules.evidence(self.log, clusters_ready, uncovered, pending))
