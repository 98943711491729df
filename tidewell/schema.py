"""Explicit schemas of the library's tables."""

from pyspark.sql import types as T

LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor_text", T.ArrayType(T.StringType()))])
PARSED = T.StructType([
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("title_words", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(LINK)), T.StructField("base", T.StringType()),
])
DOCS = "chunk_id long, doc_id long, url string, doc_len long"
POSTINGS = "chunk_id long, doc_id long, term string, pos long"
CRAWL_LOG = "server string, ts timestamp"
QRELS = "query string, rank int, url string"
FRONTIER = "url string, priority int, seq long"
ROBOTS = "host string, rule_no int, allow boolean, pattern string"
