"""Corpus pipeline: the training-data operators applied one after another to ``documents``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from matchup.llm.common import read, staged
from matchup.llm.jaccard_join import jaccard_stage
from matchup.llm.line_dedup import line_stage
from matchup.llm.mixing import mixing_stage
from matchup.llm.packing import packing_stage
from matchup.llm.quality_rules import quality_stage

#: (name, function of (spark, docs, sf_dir)): each works on all that the one before kept.
STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", partial(jaccard_stage, words=5, percent=80)),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn models and solve optimisation problems, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are written and reread for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
