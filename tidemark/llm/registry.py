"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import binary, langid, lines, mixture, neardup, neighbours, packing, scoring, suffixes, syncmers


def queries() -> dict:
    return {
        "op1_scoring": scoring.query,
        "op2_langid": langid.query,
        "op3_packing": packing.query,
        "op4_mixture": mixture.query,
        "op5_line_dedup": lines.query,
        "op6_neardup": neardup.query,
        "op7_suffixes": suffixes.query,
        "op8_syncmers": syncmers.query,
        "op9_token_binary": binary.query,
        "op10_neighbours": neighbours.query,
        "pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir),
    }


def oracle_sql() -> dict[str, str]:
    found = {"op4_mixture": mixture.ORACLE, "op5_line_dedup": lines.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
