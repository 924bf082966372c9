"""Registered queries on kept indexes: texts by trigrams, vectors by cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula import storage
from fabula.operators import text_index, vector_index
from fabula.plans.queries import _knn_sql, query

#: One that is everywhere, rare ones, wildcards, one that no text has, and one that is too short for the index.
PATTERNS = ("%tion the%", "%worth%", "%ment_de%", "the%", "%WAT_R%stone%", "%qzxqzx%", "%zz%", "%edited%")


@query("with document as (select doc_id, case when doc_id % 6 = 0 then 'edited ' || doc_id || ' ' || text else text end t from documents where doc_id % 7 <> 0 or doc_id % 6 = 0) " + " union all ".join(f"select {i} pattern, doc_id from document where t ilike '{p}'" for i, p in enumerate(PATTERNS)), "")
def text_search(v):
    """Documents by patterns, from an index of two batches: of the second one's keys, some are edited and some deleted."""
    root = storage.scratch(v.spark, "text-index")
    docs = v.table("documents").select("doc_id", "text")
    text_index.add(docs, root, 0)
    edited = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("edited "), F.col("doc_id").cast("string"), F.lit(" "), "text"))
    text_index.add(docs.where("doc_id % 6 = 0 or doc_id % 7 = 0").withColumn("text", edited), root, 1)
    hits = [text_index.search(v.spark, root, p).select(F.lit(i).alias("pattern"), F.col("key").alias("doc_id")) for i, p in enumerate(PATTERNS)]
    return reduce(DataFrame.unionByName, hits)


@query(_knn_sql("q.vec_id % 100 = 0", 3))
def vec_cells_knn(v):
    """The three nearest of every hundredth vector, from an index in cells."""
    root, e = storage.scratch(v.spark, "vector-index"), v.table("embeddings")
    vector_index.build(e, root)
    return vector_index.search(v.spark, root, e.where("vec_id % 100 = 0"), 3).select("query_id", "vec_id", "rank")
