"""The written tables: each is written to the shared folder and read back, beside the same rows as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varve.operators import textsearch
from varve.plans import rebuild, textindex
from varve.staging import folder
from varve.streaming.keyed import KeyedState

from .base import deals, query, table
from .texts import BM25, SPEC_SQL, extracted


def place(spark, name: str) -> str:
    return f"{folder(spark)}/written-{name}-{uuid.uuid4().hex}"


@query("""SELECT product_id, category, CASE WHEN product_id % 4 <> 0 THEN score + 1 ELSE score END AS score, is_active AND product_id % 4 <> 0 AS is_active FROM deals WHERE product_id % 3 <> 0 OR product_id % 4 <> 0""")
def snk_scores(spark, d):
    """Two thirds of the deals are known from before; the run scores three quarters of all, the rest have vanished."""
    known = deals(spark, d).select("product_id", "category", "score", "is_active")
    scored = known.filter("product_id % 4 <> 0").withColumn("score", F.col("score") + 1)
    return rebuild.write_scores(known.filter("product_id % 3 <> 0"), scored, place(spark, "scores"))


@query(SPEC_SQL)
def snk_spec_index(spark, d):
    index, _ = rebuild.write_specs(extracted(spark, d), place(spark, "specs"))
    return index.select("product_id", "family", "label", "metric", "rank")


@query(BM25)
def snk_text_index(spark, d):
    """A search in the written index."""
    index, stats = rebuild.write_text_index(table(spark, d, "documents"), "doc_id", ["text"], place(spark, "text"))
    found = textsearch.match(index, stats, "The éren")
    return found.select(F.col("doc").alias("doc_id"), (-F.floor(-F.col("bm25") * 1e4 + 0.5) / 1e4).alias("bm25"))


@query("""SELECT product_id, store_id, price FROM deals""")
def snk_compacted(spark, d):
    """Twenty small files become one."""
    source = place(spark, "small")
    deals(spark, d).select("product_id", "store_id", "price").repartition(20).write.parquet(source)
    return rebuild.compacted(spark, source, place(spark, "compacted"))


@query("""SELECT store_id, product_id, CASE WHEN product_id = (SELECT min(product_id) FROM deals WHERE product_id % 3 <> 0) THEN price + 1 ELSE price END AS price, 1 AS buckets_written FROM deals WHERE product_id % 3 <> 0""")
def snk_keyed_merge(spark, d):
    """Two thirds of the deals in one batch, then a batch of one deal, which writes one bucket anew."""
    known = deals(spark, d).filter("product_id % 3 <> 0").select("store_id", "product_id", F.col("price").cast("double").alias("price"))
    state = KeyedState(spark, place(spark, "keyed"), "store_id bigint, product_id bigint, price double", ["store_id", "product_id"])
    put = lambda part, news: part.join(news, ["store_id", "product_id"], "left_anti").unionByName(news)
    state.merge(known, put, 0)
    touched = state.merge(known.orderBy("product_id").limit(1).withColumn("price", F.col("price") + 1), put, 1)
    return state.read().withColumn("buckets_written", F.lit(len(touched)))


@query("""SELECT product_id, price, 5 AS files, 0 AS overlapping FROM deals""")
def snk_compacted_in_order(spark, d):
    """Fifty sorted files become five (of ten each, by the sizes here); no two of them overlap in product_id."""
    source = place(spark, "sorted")
    deals(spark, d).select("product_id", "price").repartitionByRange(50, "product_id").sortWithinPartitions("product_id").write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(source)
    size = sum(size for _, size in rebuild._files(spark.read.parquet(source)))
    out = rebuild.compacted(spark, source, place(spark, "compacted"), int(size / 5 * 1.1))
    span = out.groupBy(F.input_file_name().alias("file")).agg(F.min("product_id").alias("low"), F.max("product_id").alias("high"))
    other = span.select(F.col("file").alias("f"), F.col("low").alias("l"), F.col("high").alias("h"))
    both = span.join(other, (F.col("low") <= F.col("h")) & (F.col("l") <= F.col("high")) & (F.col("file") < F.col("f"))).agg(F.count(F.lit(1)).cast("int").alias("overlapping"))
    counted = span.agg(F.count(F.lit(1)).cast("int").alias("files"))
    return out.join(F.broadcast(counted)).join(F.broadcast(both))


@query(", docs AS (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN concat('The éren eren ', text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)" + BM25.replace("FROM documents", "FROM docs"))
def snk_text_updates(spark, d):
    """The documents in three updates, one in 25 entered anew with other words, one in seven taken out; segments are merged on the
    way. Then a search."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = textindex.TextIndex(spark, place(spark, "segments"))
    for k in range(3):
        index.update(docs.filter(F.col("doc_id") % 3 == k), "doc_id", ["text"])
    index.update(docs.filter("doc_id % 25 = 0").withColumn("text", F.concat(F.lit("The éren eren "), "text")), "doc_id", ["text"])
    index.remove(docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("doc")))
    return index.match("The éren").select(F.col("doc").alias("doc_id"), (-F.floor(-F.col("bm25") * 1e4 + 0.5) / 1e4).alias("bm25"))
