"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
