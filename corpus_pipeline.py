"""The corpus pipeline, as the driver looks for it; its stages are in tidemark.llm.pipeline."""

from __future__ import annotations

from tidemark.llm.pipeline import STAGES, run

#: The classifier and the tokenizer can't be said in SQL; the tests compare stages with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
