"""The corpus pipeline, whose stages are in tessera.llm.pipeline: five of the training-data operators, each over all that its predecessor kept."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
