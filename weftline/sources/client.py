"""What a planner asks of a graph. A store answers with DataFrames; all steps or seeds are asked together."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..operators import candidates, traverse
from . import graph as G


@runtime_checkable
class GraphClient(Protocol):
    def candidate_nodes(self, steps: DataFrame, node_types: list[str] | None = None, k: int = 5) -> DataFrame:
        """Top k nodes of each step (step_id, text, query)."""

    def neighbourhood(self, seeds: DataFrame, depth: int = 1) -> DataFrame:
        """(seed, source, relation, target) around each seed (id)."""

    def get_node(self, node_id: str) -> DataFrame:
        """One row, or none."""

    def all_nodes(self) -> DataFrame: ...


class TableGraph:
    """A client over tables. nodes: seq and schemas.NODE; edges: source, target, relation."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def candidate_nodes(self, steps: DataFrame, node_types: list[str] | None = None, k: int = 5) -> DataFrame:
        return candidates.candidate_nodes(steps, self.nodes, k, node_types)

    def neighbourhood(self, seeds: DataFrame, depth: int = 1) -> DataFrame:
        return traverse.neighbourhood(self.edges, seeds, depth)

    def get_node(self, node_id: str) -> DataFrame:
        return G.get_node(self.nodes, node_id)

    def all_nodes(self) -> DataFrame:
        return self.nodes
