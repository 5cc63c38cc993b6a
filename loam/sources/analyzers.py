"""Language analyzers: what one is, the registry of them, and their description as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources import pyfacts

CAPABILITIES = ("calls", "dependencies", "documentation", "measurements", "symbols", "syntax")


class AnalyzerError(ValueError):
    """A language without an analyzer, or with two."""


@dataclass(frozen=True)
class Analyzer:
    """Turns a table of (path, bytes) into one of facts, for one language."""

    id: str
    language: str
    version: str
    analyze: Callable[[DataFrame], DataFrame]
    level: str = "syntax"
    capabilities: tuple[str, ...] = CAPABILITIES
    grammar: str | None = None
    limitations: tuple[str, ...] = ()

    def without_documentation(self) -> Analyzer:
        return Analyzer(**(self.__dict__ | {"capabilities": tuple(c for c in self.capabilities if c != "documentation")}))


class Registry:
    """Analyzers by language."""

    def __init__(self, *analyzers: Analyzer):
        self.known: dict[str, Analyzer] = {}
        for a in analyzers:
            self.register(a)

    def register(self, analyzer: Analyzer) -> None:
        if analyzer.language in self.known:
            raise AnalyzerError(f"{analyzer.language} has an analyzer already: {self.known[analyzer.language].id}")
        self.known[analyzer.language] = analyzer

    def of(self, language: str | None, path: str) -> Analyzer:
        if language is None:
            raise AnalyzerError(f"{path} is in no known language")
        if language not in self.known:
            raise AnalyzerError(f"{language} has no analyzer: {path}")
        return self.known[language]

    def analyze(self, read: Callable[[DataFrame], DataFrame], files: DataFrame) -> DataFrame:
        """Facts of the ``files`` (with path and language) whose language has an analyzer; only those are read."""
        out = None
        for language, a in sorted(self.known.items()):
            part = a.analyze(read(files.where(F.col("language") == language)))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise AnalyzerError("no analyzer is registered")
        return out

    def descriptors(self, spark: SparkSession) -> DataFrame:
        """One row for each analyzer."""
        rows = [(a.id, a.language, a.version, a.level, sorted(a.capabilities), a.grammar, list(a.limitations)) for _, a in sorted(self.known.items())]
        return spark.createDataFrame(rows, "id string, language string, version string, level string, capabilities array<string>, grammar string, limitations array<string>")


PYTHON = Analyzer("python-ast", "python", "0.1.0", pyfacts.analyze, grammar="the standard library's parser", limitations=("no types are inferred", "files of other grammar versions are partial"))
REGISTRY = Registry(PYTHON)
