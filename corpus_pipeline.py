"""A corpus pipeline over ``documents``: five stages, each stored as Parquet and read again."""

from __future__ import annotations

from sheetflow.llm.common import shared_dir, stored, table
from sheetflow.llm.op1_ngram_join import near_duplicate_stage
from sheetflow.llm.op3_toxicity import toxicity_stage
from sheetflow.llm.op4_decontamination import decontamination_stage
from sheetflow.llm.op6_mixing import mixing_stage
from sheetflow.llm.op7_line_dedup import line_dedup_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the trained model or the component search; a brute-force version is tested instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    where, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"{where}/{k}-{name.replace(' ', '-')}")
    return docs
