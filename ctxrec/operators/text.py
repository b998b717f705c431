"""Documents of users and profiles, tokens, and relational tf-idf.

Texts are never concatenated per user or profile: the term counts of a
concatenation are the sums of its documents' term counts (tokens never cross
the joining space), so "all contents of a user joined by space" becomes a
grouped sum of (group, term) counts, partially aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxrec.operators.ranking import eligible_resources

# A token is a run of two or more letters, digits or '_'.
TOKEN_REGEX = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_REGEX), F.lit(0))


def user_documents(views: DataFrame, resources: DataFrame) -> DataFrame:
    """(username, url, content) for each distinct url a user viewed that has
    an eligible resource."""
    pairs = views.select("username", "url").distinct()
    return pairs.join(eligible_resources(resources).select("url", "content"), on="url")


def term_counts(docs: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(keys..., term, tf): raw term counts of each document."""
    exploded = docs.select(*keys, F.explode(tokens(F.col(text))).alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_terms(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``term_counts`` of single documents: the rows of a key meet as texts and are
    counted there, so no (document, term) row moves."""
    return term_counts(docs.select(key, text).repartition(key), [key], text)


def group_term_counts(doc_terms: DataFrame, doc_to_group: DataFrame, doc_keys: list[str],
                      group_keys: list[str]) -> DataFrame:
    """Term counts of the concatenated documents of each group."""
    j = doc_terms.join(doc_to_group, on=doc_keys)
    return j.groupBy(*group_keys, "term").agg(F.sum("tf").alias("tf"))


def grouped_text_terms(docs: DataFrame, doc_to_group: DataFrame, doc_keys: list[str], group_keys: list[str],
                       text: str = "content") -> DataFrame:
    """``group_term_counts`` of the documents' term counts, counted per group at
    once: each text moves to its groups once and no (document, term) row moves."""
    j = docs.select(*doc_keys, text).join(doc_to_group, on=doc_keys)
    return term_counts(j, group_keys, text)


def token_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    t = tokens(F.col(text))
    return docs.select(key, F.size(t).cast("bigint").alias("n_tokens"),
                       F.size(F.array_distinct(t)).cast("bigint").alias("n_terms"))


def idf_of(doc_terms: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The idf model (term, idf) of counted documents, idf = ln((n + 1) / (df + 1));
    ``docs`` holds every document, also those without a term."""
    n_docs = docs.count()
    return (doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .select("term", F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)).alias("idf")))


def fit_idf(corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The idf model of a training corpus; terms outside the corpus have none."""
    return idf_of(term_counts(corpus, [key], text), corpus.select(key), key)


def tfidf(doc_terms: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """L2-normalised tf * idf of each document's terms known to the model. A
    document whose terms all occur in every training document has weights 0."""
    w = doc_terms.dropna(subset=keys).join(idf, on="term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))  # moves a weight once
    return (w.withColumn("__norm", norm)
            .select(*keys, "term", F.coalesce(F.try_divide("w", "__norm"), F.lit(0.0)).alias("weight")))


_WS = " \t\n\r\f\u000b"


def _words(text: Column) -> Column:
    """Lower-cased whitespace tokens (no token pattern)."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def cluster_top_bigrams(docs: DataFrame, cluster: str, key: str, text: str, n: int,
                        min_freq: int = 3) -> DataFrame:
    """Per cluster, the n bigrams of the cluster's concatenated documents
    (in ``key`` order) with the best Jaccard association n12 / (n1 + n2 - n12),
    among bigrams seen at least ``min_freq`` times; ties by the words.

    Every word gives one row with the word after it (none for a document's
    last), so one partially aggregated count, stored for its three readers,
    serves both the bigrams and the word frequencies. The bigram across two
    neighbouring documents joins one document's last word with the next one's
    first, found by a skew-safe "previous document" lookup.
    """
    from ctxrec.operators.features import range_buckets
    from ctxrec.operators.sequence import carry_last
    from ctxrec.operators.topk import top_k
    from ctxrec.sources.store import materialised

    # the token array is a column of its own: it is read several times and must
    # not be split from the text for each read
    tok = docs.select(cluster, key, _words(F.col(text)).alias("__t")).where(F.size("__t") > 0)
    units = (tok.select(cluster, "__t", F.posexplode("__t").alias("__p", "w1"))
             .select(cluster, "w1", F.get("__t", F.col("__p") + 1).alias("w2"), F.lit(1).alias("word")))
    ends = tok.select(cluster, key, F.get("__t", F.lit(0)).alias("first"), F.element_at("__t", -1).alias("last"))
    ends = carry_last(range_buckets(ends, [cluster], [key]), [cluster], [key], "__rp",
                      {"__prev": (F.lit(True), F.col("last"))})
    border = ends.where(F.col("__prev").isNotNull()).select(
        cluster, F.col("__prev.v").alias("w1"), F.col("first").alias("w2"), F.lit(0).alias("word"))

    counts = materialised(units.unionByName(border).groupBy(cluster, "w1", "w2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("word").alias("words")), "bigram-counts")
    bigrams = counts.where(F.col("w2").isNotNull() & (F.col("n") >= min_freq)).select(cluster, "w1", "w2", F.col("n").alias("n12"))
    word = counts.groupBy(cluster, "w1").agg(F.sum("words").alias("n"))
    w1 = word.select(cluster, "w1", F.col("n").alias("n1"))
    w2 = word.select(cluster, F.col("w1").alias("w2"), F.col("n").alias("n2"))
    scored = (bigrams.join(w1, on=[cluster, "w1"]).join(w2, on=[cluster, "w2"])
              .withColumn("score", F.col("n12") / (F.col("n1") + F.col("n2") - F.col("n12"))))
    return top_k(scored, [cluster], [F.col("score").desc(), F.col("w1"), F.col("w2")], n)


def cluster_top_words(doc_weights: DataFrame, doc_to_cluster: DataFrame, doc_key: str,
                      cluster: str, n: int) -> DataFrame:
    """Per cluster, the n terms with the largest summed tf-idf weight."""
    from ctxrec.operators.topk import top_k

    sums = (doc_weights.join(doc_to_cluster, on=doc_key)
            .groupBy(cluster, "term").agg(F.sum("weight").alias("weight")))
    return top_k(sums, [cluster], [F.col("weight").desc(), F.col("term")], n)


# Frequent function words per language, for detection.
STOP_WORDS = {
    "en": "the and of to in is that it for was with on as are this be at by not from",
    "fr": "le la les et des est un une du dans que qui pour pas sur au avec ce il sont",
    "de": "der die und das ist den nicht mit von ein eine zu sich auf für dem des im auch es",
    "es": "el la de que y los las en un una es por con para del se no al lo como",
}
LANGUAGES = ["en", "fr", "de", "es"]


def stop_word_table(spark) -> DataFrame:
    rows = [(lang, w) for lang in LANGUAGES for w in STOP_WORDS[lang].split()]
    return spark.createDataFrame(rows, "lang string, term string")


def detect_language(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Language with the most stop-word hits per document (ties: the order of
    ``LANGUAGES``); 'unknown' without any hit. The stop-word table is fixed
    (a few dozen rows), so broadcasting it is bounded."""
    words = F.broadcast(stop_word_table(docs.sparkSession))
    toks = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    hits = toks.join(words, on="term").groupBy(key, "lang").agg(F.count(F.lit(1)).alias("hits"))
    order = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang"))
    best = hits.groupBy(key).agg(F.max_by("lang", F.struct("hits", -order)).alias("detected"))
    return (docs.select(key).join(best, on=key, how="left")
            .select(key, F.coalesce("detected", F.lit("unknown")).alias("detected")))


def lda_topics(docs: DataFrame, text: str = "text", k: int = 10, n_terms: int = 10,
               max_iter: int = 10, seed: int = 1) -> DataFrame:
    """Topics of a corpus by LDA (Spark ML): ``(topic, rank, term, weight)``.
    Every term of the corpus has an index of its own, given by a table of
    distinct terms (sorted, numbered per range partition plus the sizes of the
    partitions before it); every document shapes the topics in every pass. Only
    the ``k x n_terms`` best terms are joined back to their words."""
    import uuid

    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors, VectorUDT
    from ctxrec.session import remove_at_exit, scratch_path

    spark = docs.sparkSession
    base = remove_at_exit(spark, scratch_path(spark, f"lda-{uuid.uuid4().hex}"))
    counts = (docs.select(F.monotonically_increasing_id().alias("__doc"), F.explode(tokens(F.col(text))).alias("term"))
              .groupBy("__doc", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    counts.write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    ranged = counts.select("term").distinct().repartitionByRange("term").withColumn("__p", F.spark_partition_id())
    ranged.write.parquet(f"{base}/terms")
    ranged = spark.read.parquet(f"{base}/terms")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    ids = ranged.join(before, "__p").select(
        "term", (F.row_number().over(Window.partitionBy("__p").orderBy("term")) - 1 + F.col("__before"))
        .cast("int").alias("term_index"))
    ids.write.parquet(f"{base}/ids")
    ids = spark.read.parquet(f"{base}/ids")
    size = ids.count()
    if not size:
        return spark.createDataFrame([], "topic int, rank int, term string, weight double")
    vector = F.udf(lambda cells: Vectors.sparse(size, [(c["i"], c["tf"]) for c in cells]), VectorUDT())
    rows = (counts.join(ids, "term").groupBy("__doc")
            .agg(vector(F.sort_array(F.collect_list(F.struct(F.col("term_index").alias("i"), "tf")))).alias("__tf")))
    model = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="__tf", optimizer="online", subsamplingRate=1.0).fit(rows)
    topics = model.describeTopics(n_terms)
    z = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "tw"))
    return (z.select("topic", (F.col("pos") + 1).alias("rank"), F.col("tw.termIndices").alias("term_index"),
                     F.col("tw.termWeights").alias("weight"))
            .join(ids, on="term_index").drop("term_index"))
