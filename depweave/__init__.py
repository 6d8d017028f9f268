"""Dependency-graph analytics expressed as Spark DataFrame jobs."""

from depweave.model import DepGraph, stack_revisions
from depweave.operators.analysis import Analysis
from depweave.repository import TOOLS, Repository

__all__ = ["TOOLS", "Analysis", "DepGraph", "Repository", "stack_revisions"]
