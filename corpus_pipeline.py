"""The corpus pipeline at the driver's place for it; the code is emberwall.llm.pipeline."""

from emberwall.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
