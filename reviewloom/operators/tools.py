"""The extension contract: a tool has a name, a description, a parameter schema and a DataFrame transformation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    transform: Callable[..., DataFrame]
    parameters: dict = field(default_factory=dict)

    def spec(self) -> dict:
        """The function description that model services take."""
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters or {"type": "object", "properties": {}}}}


class Registry:
    """Tools by name. Unknown names raise, as a job should end before it starts."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> Tool:
        self._tools[tool.name] = tool
        return tool

    def run(self, name: str, df: DataFrame, **options) -> DataFrame:
        if name not in self._tools:
            raise KeyError(f"unknown tool {name}; there are {', '.join(sorted(self._tools))}")
        return df.transform(self._tools[name].transform, **options)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def describe(self) -> str:
        return "\n".join(f"- **{t.name}**: {t.description}" for _, t in sorted(self._tools.items()))


def register_sql(spark: SparkSession) -> None:
    """JSON functions for use in SQL text."""
    from ..functions import jsonx

    for name in ("extract_json", "repair_json", "parse_sentiment", "shorten_result"):
        spark.udf.register(name, getattr(jsonx, name))
