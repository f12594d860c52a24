"""The corpus pipeline: quality, near-duplicates, personal data, mixing and tokens, over the documents of a folder."""

from probelight.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
