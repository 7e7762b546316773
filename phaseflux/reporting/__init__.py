"""Reports: components over the small tables that the operators make, their texts and figures, and the files they are written to."""

from .components import COMPONENTS, Component, Context, Result, compose
from .write import write_report

__all__ = ["COMPONENTS", "Component", "Context", "Result", "compose", "write_report"]
