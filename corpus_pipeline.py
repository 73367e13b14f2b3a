"""The corpus pipeline: documents pass five stages, each one operator of ``evalframe.llm``.

1. toxicity           rows that the network scores at 0.7 or more go
2. line_dedup         later copies of line runs of 50 words and more go, and rows of which
                      nothing is left
3. near_duplicates    one document of each group linked at 0.8 of its shingles stays
4. decontamination    documents with a benchmark passage go
5. packing            what is left is packed into sequences of 2048 tokens

Each stage gets all that the one before it kept, as a table written to the shared folder.
The first four keep the columns of ``documents``.  Null or empty texts pass all stages (as
one end id in the last); rows without id are kept by the third.  An empty table stays empty.
The toxicity network is fitted on a bounded sample of labelled rows (see the operator);
everything else covers all rows and whole texts.  SQL can express neither the first nor the
last stage, so there is no ``ORACLE_SQL``; the tests hold every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalframe.llm.decontaminate import decontaminate
from evalframe.llm.line_dedup import drop_repeats
from evalframe.llm.ngram_join import drop_near_copies
from evalframe.llm.packing import pack_documents
from evalframe.llm.shared import shared_table, table
from evalframe.llm.toxicity import drop_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, keep_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
