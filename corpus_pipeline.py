"""The corpus pipeline: documents in, packed token pieces out.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``. Null, empty and repeated rows are treated
as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiforge.llm.common import store, table
from kpiforge.llm.decontaminate import stage_decontaminate
from kpiforge.llm.jaccard import stage_jaccard
from kpiforge.llm.lines import stage_lines
from kpiforge.llm.packing import stage_packing
from kpiforge.llm.repetition import stage_quality

STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("ngram_jaccard_join", stage_jaccard),
    ("benchmark_decontamination", stage_decontaminate),
    ("best_fit_packing", stage_packing),
]

#: SQL can express neither packing nor rolling-hash coverage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
