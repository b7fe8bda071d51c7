"""Lexical retrieval: an inverted index per site as tables, and ranked answers to many requests at once.

The index is four tables: postings (site, doc, term, tf), documents (site, doc, length), terms (site, term, df) and sites
(site, n, avgdl). A batch of requests is tokenized into query terms, which meet only the postings of their own terms and
sites; texts are joined to the winners alone. An index can be kept in a folder, where postings and terms lie in folders by
term, so that a search reads those of its own terms; it is refreshed by site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import snippet, strip_front_matter, tokens
from loam.functions.urls import result_links
from loam.operators.passages import dense_blocks
from loam.sources.scratch import exists, stored

K1, B = 1.2, 0.5
#: Folders by term.
BUCKETS = 32


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class SearchIndex:
    postings: DataFrame  # site, doc, term, tf, bucket
    documents: DataFrame  # site, doc, doc_len
    terms: DataFrame  # site, term, df, idf, bucket
    sites: DataFrame  # site, n, avgdl


def build_index(docs: DataFrame) -> SearchIndex:
    """The index of documents (site, doc, content); front matter is no content, and null content is no document.

    Documents without a token count for a site's number and mean length. One row a document is expected. Texts are cut
    into tokens once.
    """
    cut = docs.where("content is not null").select("site", "doc", tokens(strip_front_matter(F.col("content"))).alias("tokens"))
    cut = stored(cut.select("site", "doc", F.size("tokens").alias("doc_len"), "tokens"), "index-tokens")
    lengths = cut.select("site", "doc", "doc_len")
    counted = cut.select("site", "doc", F.explode("tokens").alias("term")).groupBy("site", "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    postings = stored(counted.withColumn("bucket", term_bucket(F.col("term"))), "index-postings")
    sites = stored(lengths.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl")), "index-sites")
    return SearchIndex(postings, lengths, stored(term_statistics(postings, sites), "index-terms"), sites)


def term_statistics(postings: DataFrame, sites: DataFrame) -> DataFrame:
    """Documents of a site that hold a term, and the term's weight: site, term, df, idf, bucket."""
    df = postings.groupBy("site", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.join(sites, "site").select("site", "term", "df", idf.alias("idf"), term_bucket(F.col("term")).alias("bucket"))


class StoredIndex:
    """An index in a folder, in segments: each holds some sites, and a site's newest segment is the one in force.

    ``refresh`` indexes the sites whose documents differ from what the index holds, as a new segment; a segment counts
    once its table of sites, the last one, is written.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _segments(self) -> int:
        n = 0
        while exists(self.spark, f"{self.folder}/sites/segment={n}/_SUCCESS"):
            n += 1
        return n

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.folder}/{table}")

    def _live(self) -> DataFrame:
        """The sites in force with their segment and fingerprint."""
        rows = self._read("sites", "site string, n long, avgdl double, print long").where(F.col("segment") < self._segments())
        newest = rows.groupBy("site").agg(F.max_by(F.struct("n", "avgdl", "print", "segment"), "segment").alias("s"))
        return newest.select("site", "s.*").where("n > 0 or avgdl is not null")

    def refresh(self, docs: DataFrame) -> int:
        """Brings the index up to ``docs`` (site, doc, content); gives the number of sites that were indexed or dropped.

        A site is told by its number of documents and the hashes of their names and contents. Null sites are not indexed.
        """
        docs = docs.select("site", "doc", "content").where("site is not null and content is not null")
        prints = docs.groupBy("site").agg(F.sum(F.xxhash64("doc", "content").cast("decimal(20,0)")).cast("string").alias("p"), F.count(F.lit(1)).alias("c"))
        prints = prints.select("site", F.xxhash64("p", "c").alias("new"))
        segment = self._segments()
        held = self._live().select("site", F.col("print").alias("old")) if segment else self.spark.createDataFrame([], "site string, old long")
        changed = stored(prints.join(held, "site", "full").where(~F.col("new").eqNullSafe(F.col("old"))), "changed-sites")
        n = changed.count()
        if n:
            index = build_index(docs.join(changed.where("new is not null").select("site"), "site", "left_semi"))
            at = f"segment={segment}"
            for table, df in (("postings", index.postings), ("terms", index.terms)):
                by_term = df.repartition("bucket", F.pmod(F.xxhash64("site"), F.lit(4))).sortWithinPartitions("bucket", "site", "term")
                by_term.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/{table}/{at}")
            index.documents.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/documents/{at}")
            # a site that is gone has a row without numbers
            rows = changed.join(index.sites, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"), "avgdl", F.coalesce("new", F.lit(0)).alias("print"))
            rows.write.mode("overwrite").parquet(f"{self.folder}/sites/{at}")
        return n

    def index(self) -> SearchIndex:
        """The index in force."""
        live, segments = self._live(), self._segments()
        own = live.select("site", "segment")

        def table(name: str, schema: str) -> DataFrame:
            rows = self._read(name, schema)
            return rows.drop("segment") if segments == 1 else rows.join(own, ["site", "segment"], "left_semi").drop("segment")

        return SearchIndex(
            table("postings", "site string, doc string, term string, tf long, bucket int"),
            table("documents", "site string, doc string, doc_len int"),
            table("terms", "site string, term string, df long, idf double, bucket int"),
            live.select("site", "n", "avgdl"),
        )


def query_terms(requests: DataFrame) -> DataFrame:
    """Terms of each request (request_id, site, query): request_id, site, term, qn (times), n_tokens (of the request)."""
    cut = requests.select("request_id", "site", tokens(F.col("query")).alias("q")).where(F.size("q") > 0)
    return (
        cut.select("request_id", "site", F.size("q").alias("n_tokens"), F.explode("q").alias("term"))
        .groupBy("request_id", "site", "n_tokens", "term")
        .agg(F.count(F.lit(1)).alias("qn"))
    )


def scores(index: SearchIndex, requests: DataFrame) -> DataFrame:
    """The score of every document that holds a term of a request: request_id, site, doc, score (over 0, to 1).

    A term counts as often as the query repeats it. The sum is damped by the part of the query's tokens that the document
    holds, and divided by what the query could reach at most.
    """
    asked = stored(query_terms(requests).withColumn("bucket", term_bucket(F.col("term"))), "query-terms")
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    terms = asked.join(index.terms.where(F.col("bucket").isin(buckets)), ["bucket", "site", "term"])
    most = F.sum(F.col("qn") * F.col("idf") * (K1 + 1)).over(Window.partitionBy("request_id"))
    weighed = terms.withColumn("most", most).drop("df")
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    summed = (
        index.postings.where(F.col("bucket").isin(buckets))
        .join(weighed, ["bucket", "site", "term"])
        .join(index.documents, ["site", "doc"])
        .join(index.sites.select("site", "avgdl"), "site")
        .groupBy("request_id", "site", "doc", "n_tokens", "most")
        .agg(F.sum(part).alias("sum"), F.sum("qn").alias("matched"))
    )
    score = F.col("sum") * F.pow(F.col("matched") / F.col("n_tokens"), F.lit(1.5)) / F.col("most")
    return summed.select("request_id", "site", "doc", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")).where("score > 0")


def ranked(found: DataFrame, requests: DataFrame, digits: int = 9) -> DataFrame:
    """The best top_k documents of each request, best first, equal scores by document; then those under the request's
    threshold are dropped (null and 0: none are): request_id, site, doc, score, rank.

    Requests need request_id, top_k and threshold.
    """
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "doc")
    limits = requests.select("request_id", "top_k", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))
    most = limits.agg(F.max("top_k")).first()[0] or 0
    # the limit as a number lets every task keep the best of its own rows before they meet in one
    top = found.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    kept = top.join(limits, "request_id").where(F.col("rank") <= F.col("top_k"))
    return kept.where((F.col("threshold") <= 0) | (F.col("score") >= F.col("threshold"))).select("request_id", "site", "doc", "score", "rank")


def answers(winners: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Winners with what a reader sees: title, snippet, the densest passage with its lines, and links.

    ``requests``: request_id, query, output_dir; ``docs``: site, doc, title, content, url, local_path.
    """
    asked = winners.join(requests.select("request_id", "query", "output_dir"), "request_id").withColumn("tokens", tokens(F.col("query")))
    texts = docs.where("content is not null").withColumn("content", strip_front_matter(F.col("content")))
    full = stored(asked.join(texts, ["site", "doc"]), "search-winners")
    blocks = dense_blocks(full, ["request_id", "doc"], "content", "tokens")
    with_blocks = full.join(blocks, ["request_id", "doc"])
    links = result_links(F.col("doc"), F.col("output_dir"), F.col("query"), F.col("matched_block"))
    return with_blocks.select(
        "request_id", "rank", F.col("doc").alias("filename"), "title", "score", snippet(F.col("content"), F.col("tokens")).alias("snippet"),
        "url", "start_line", "end_line", "matched_block", "local_path", *[c.alias(name) for name, c in links.items()],
    )


def search(index: SearchIndex, site: str, query: str, top_k: int = 50, threshold: float = 0.0) -> DataFrame:
    """Ranked documents of one site for one query; a query without tokens gives none."""
    spark = index.postings.sparkSession
    request = spark.createDataFrame([(0, site, query, top_k, threshold)], "request_id long, site string, query string, top_k int, threshold double")
    return ranked(scores(index, request), request)


def matches(column: Column, words: Column) -> Column:
    """How many different words stand anywhere in a text."""
    return F.size(F.filter(F.array_distinct(words), lambda w: F.contains(F.lower(column), w)))
