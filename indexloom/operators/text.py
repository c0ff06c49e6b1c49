"""Text retrieval: tokens, chunks, BM25, page text, number guards, grading."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Words that carry no meaning for retrieval.
STOPWORDS = "a an and are as at be by for from how in is it of on or that the this to was what when which who will with".split()


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, without stopwords; an empty array for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def chunks(docs: DataFrame, key: str, text: str, words: int = 220, overlap: int = 40) -> DataFrame:
    """Windows of ``words`` words, each starting ``words - overlap`` after the last; a tail under 20 words joins the one before.

    Columns: key, ``chunk`` (from 0), ``first_word``, ``n_words``, ``body``. Blank texts give no chunk.
    """
    step = words - overlap
    w = docs.select(F.col(key), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "").alias("__w")).where(F.size("__w") > 0)
    n = F.size("__w")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    tail = n - (count - 1) * step
    count = F.when((count > 1) & (tail - overlap < 20), count - 1).otherwise(count)
    def window(i: Column) -> Column:
        length = F.when(i == count - 1, n - i * step).otherwise(words)
        return F.struct(i.alias("chunk"), (i * step).alias("first_word"), length.alias("n_words"), F.array_join(F.slice("__w", i * step + 1, length), " ").alias("body"))

    # cut before they are written out, so that no row carries the whole text
    return w.select(key, F.explode(F.transform(F.sequence(F.lit(0), count - 1), window)).alias("__c")).select(key, "__c.*")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): term counts per document, aggregated map-side."""
    t = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("term"))
    return t.groupBy("doc", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, *, key: str, text: str, query_key: str, query_text: str, top: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``top`` documents per query by BM25: query, doc, score, rank.

    Postings are reduced to the queries' terms before any join with scores; corpus statistics
    (documents, mean length, document frequencies) cover all documents. Ties go to the least key.
    """
    q = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    asked = q.agg(F.collect_set("term")).scalar()  # as many terms as the queries have
    t = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).withColumn("q", asked).select("doc", F.size("t").alias("length"), F.filter("t", lambda x: F.array_contains(F.col("q"), x)).alias("t"))
    # per document its length and only the queries' terms: texts are read once, statistics and postings come from what is kept
    t = cut(t)
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    p = t.select("doc", "length", F.explode("t").alias("term")).groupBy("doc", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = stats.select("n").scalar(), stats.select("mean").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    s = p.join(df, "term").select("doc", "term", part.alias("part")).join(q, "term").groupBy("query", "doc").agg(F.sum("part").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def page_text(raw: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, entities resolved, spaces collapsed."""
    x = F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")

    def unescape(t: pa.Array) -> pa.Array:
        return pa.array([html.unescape(v) if v is not None and "&" in v else v for v in t.to_pylist()], pa.string())

    return F.trim(F.regexp_replace(F.arrow_udf(unescape, "string")(x), r"[\s ]+", " "))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text as written, without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(F.rtrim(x, F.lit(",")), ",", "")))


def unsupported_numbers(draft: Column, allowed: Column) -> Column:
    """Numbers of a draft that no allowed rendering covers."""
    return F.array_except(numbers(draft), allowed)


def renderings(value: Column) -> Column:
    """Ways to write a value: as it is, rounded to 0-4 places, and as percent and basis points."""
    out = [F.format_string(f"%.{n}f", v) for v in (F.abs(value), F.abs(value * 100), F.abs(value * 10_000)) for n in range(5)]
    return F.array_distinct(F.array(*out))


def grade(df: DataFrame, *, answer: str, must: str, must_not: str, cited: str, expected: str, abstained: str, should_abstain: str) -> DataFrame:
    """``df`` with contains_ok, avoids_ok, citation_precision, abstention_ok and passed."""
    low = F.lower(F.coalesce(F.col(answer), F.lit("")))
    contains = F.forall(must, lambda x: F.contains(low, F.lower(x)))
    avoids = F.forall(must_not, lambda x: ~F.contains(low, F.lower(x)))
    precision = F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, expected)) / F.size(cited))
    abstention = F.col(abstained) == F.col(should_abstain)
    ok = abstention & (F.col(should_abstain) | (contains & avoids))
    return df.withColumns({"contains_ok": contains, "avoids_ok": avoids, "citation_precision": precision, "abstention_ok": abstention, "passed": ok})


def report(graded: DataFrame, by: str, *, abstained: str, should_abstain: str, unsupported: str) -> DataFrame:
    """Graded answers per ``by``: n, accuracy, citation precision (of answers given that cite), abstention accuracy, hallucination rate (answers with an unsupported number)."""
    mean = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return graded.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.count_if(abstained).alias("abstained"), mean(F.col("passed")).alias("accuracy"), F.avg(F.when(~F.col(abstained), F.col("citation_precision"))).alias("citation_precision"),
        mean(F.col(abstained) == F.col(should_abstain)).alias("abstention_accuracy"), mean(F.size(unsupported) > 0).alias("hallucination_rate"),
    )
