"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding (see ``crystalspark.llm.pipeline``)."""

from crystalspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
