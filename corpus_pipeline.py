"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from poolframe.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
