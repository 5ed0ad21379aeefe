"""Keyword extraction without a model: tokens, part-of-speech look-up, TF-IDF and TextRank.

The published tokenizer gives runs of Latin letters as lower-case words and every n-gram of 2 to 4 Chinese characters.
A segmenter's dictionary can be put in its place as a table of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHORTEST, LONGEST = 2, 4
#: Tokens whose frequencies are broadcast, at some 40 bytes each: 40 MB.
MAX_VOCABULARY = 1_000_000
# Part-of-speech tags of nouns, adjectives and verbs.
NOUNS, ADJECTIVES, VERBS = ("n", "nr", "ns", "nt", "nz", "vn", "an"), ("a", "ad"), ("v", "vd", "vn")


def tokens_of(text: Column) -> Column:
    """``array<string>`` in order of place; tokens of one place by length."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{2,}|[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run))
        sized = F.flatten(F.transform(starts, lambda p: F.transform(F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: p + n - 1 <= F.length(run)), lambda n: F.substr(run, p, n))))
        return F.when(run.rlike("^[a-z]"), F.array(run)).otherwise(sized)

    return F.flatten(F.transform(runs, grams))


def bag_of(text: Column) -> Column:
    """The same tokens without their order: overlapping n-grams by a look-ahead, one scan for each length."""
    low = F.lower(text)
    grams = [F.regexp_extract_all(low, F.lit(rf"(?=([\x{{4e00}}-\x{{9fff}}]{{{n}}}))"), F.lit(1)) for n in range(SHORTEST, LONGEST + 1)]
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z]{2,}"), F.lit(0)), *grams)


def exploded_tokens(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, pos, token``; texts without tokens give no rows."""
    return df.select(F.col(doc).alias("doc"), F.posexplode(tokens_of(F.col(text))).alias("pos", "token"))


def document_frequencies(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """``token, df, idf`` over the texts: how many hold the token, and ln(texts / texts with it). A text's repeats count once."""
    single = texts.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(bag_of(F.col(text)))).alias("token"))
    documents = texts.select(F.count_distinct(F.col(doc)).alias("documents"))
    return single.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.ln(documents.scalar() / F.col("df")))


def tf_idf(df: DataFrame, doc: str, text: str, top_k: int = 8, idf: DataFrame | None = None) -> DataFrame:
    """``doc, token, weight, score, rank``: the ``top_k`` tokens of each text by term frequency times inverse document frequency.

    Inverse document frequencies come from ``idf`` (``token, idf``) or from the corpus, as ln(texts / texts with it); texts
    are single by ``doc``. Equal weights go by token.

    Texts are placed by key once, before they are split, so that counting and ranking need no shuffle of tokens. The
    frequencies are broadcast up to ``MAX_VOCABULARY`` tokens, counted first. Of a larger table the most frequent ones are
    broadcast, and only the other tokens are joined by shuffle, none of which is hot.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    if not _is_placed(df, doc):
        placed = placed.repartition(parts, F.col("doc"))
    counts = placed.select("doc", F.explode(bag_of(F.col("text"))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))
    sized = counts.withColumn("total", F.sum("n").over(Window.partitionBy("doc")))
    known = cut_lineage((document_frequencies(df, doc, text) if idf is None else idf).select("token", *([] if idf is not None else ["df"]), "idf"))
    if known.count() <= MAX_VOCABULARY:
        weighted = sized.join(F.broadcast(known.select("token", "idf")), "token")
    else:
        order = [F.col("df").desc(), "token"] if idf is None else [F.col("idf"), "token"]
        heavy = cut_lineage(known.orderBy(*order).limit(MAX_VOCABULARY).select("token", "idf"))
        both = sized.join(F.broadcast(heavy), "token", "left")
        light = both.where(F.col("idf").isNull()).drop("idf").join(known.join(F.broadcast(heavy), "token", "left_anti").select("token", "idf"), "token")
        weighted = both.where(F.col("idf").isNotNull()).unionByName(light)
    weighted = weighted.select("doc", "token", F.round(F.col("n") / F.col("total") * F.col("idf"), 6).alias("weight"))
    best = Window.partitionBy("doc").orderBy(F.col("weight").desc(), "token")
    ranked = weighted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return ranked.withColumn("score", F.least(F.round(F.col("weight") * 2, 6), F.lit(1.0)))


def placed_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once to the shared folder, placed by ``key``: what groups or joins by it later shuffles no rows of it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(df.repartition(parts, F.col(key)))
    found._placed_by = key
    return found


def _is_placed(df: DataFrame, key: str) -> bool:
    return getattr(df, "_placed_by", None) == key


def pos_keywords(df: DataFrame, doc: str, text: str, lexicon: DataFrame, nouns: bool = True, adjectives: bool = True, verbs: bool = False, shortest: int = 2, most: int = 20, score: float = 0.5) -> DataFrame:
    """``doc, token, score, rank``: words of the lexicon (``word, pos``) with a wanted tag, the first ``most`` by place.

    Words are broadcast up to ``MAX_VOCABULARY``, counted first, so that tokens aren't shuffled; a larger lexicon is joined by shuffle.
    """
    tags = (NOUNS if nouns else ()) + (ADJECTIVES if adjectives else ()) + (VERBS if verbs else ())
    wanted = cut_lineage(lexicon.where(F.col("pos").isin(list(tags))).select(F.col("word").alias("token")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_VOCABULARY else wanted
    found = exploded_tokens(df, doc, text).where(F.length("token") >= shortest).join(wanted, "token")
    first = found.groupBy("doc", "token").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "token")))
    return ranked.where(F.col("rank") <= most).select("doc", "token", F.lit(score).alias("score"), "rank")


def word_tokens(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, pos, token`` of words that don't overlap: Latin words and pairs of Chinese characters; the graph's nodes."""
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z]{2,}|[\x{4e00}-\x{9fff}]{2}"), F.lit(0))
    return df.select(F.col(doc).alias("doc"), F.posexplode(runs).alias("pos", "token"))


def cooccurrence(df: DataFrame, doc: str, text: str, window: int = 5) -> DataFrame:
    """``doc, a, b, weight``: how often two words stand within ``window`` words of each other, a < b.

    A word's followers are read from the row itself, so no text is joined with itself and a long text stays one row.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z]{2,}|[\x{4e00}-\x{9fff}]{2}"), F.lit(0))
    words = df.select(F.col(doc).alias("doc"), runs.alias("words")).where(F.size("words") > 1)
    pairs = words.select("doc", F.posexplode("words").alias("pos", "token"), "words").select("doc", "token", F.explode(F.slice("words", F.col("pos") + 2, F.lit(window - 1))).alias("other"))
    ordered = pairs.where(F.col("token") != F.col("other")).select("doc", F.least("token", "other").alias("a"), F.greatest("token", "other").alias("b"))
    return ordered.groupBy("doc", "a", "b").agg(F.count("*").alias("weight"))


def text_rank(df: DataFrame, doc: str, text: str, top_k: int = 8, window: int = 5, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """``doc, token, weight, rank``: words by their rank in the text's own graph, after ``rounds`` rounds, the best one 1.

    Every text is a graph of its own, held as one row of edges, and all rounds run in that row; nothing is iterated over
    the cluster. Equal weights go by token.
    """
    edges = cooccurrence(df, doc, text, window)
    both = edges.unionByName(edges.select("doc", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))

    def rank(pdf):
        nodes = sorted(set(pdf["a"]))
        at = {n: k for k, n in enumerate(nodes)}
        import numpy as np
        import pandas as pd

        a, b, w = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy(), pdf["weight"].to_numpy(dtype=float)
        out = np.bincount(a, weights=w, minlength=len(nodes))
        score = np.full(len(nodes), 1.0)
        for _ in range(rounds):
            score = (1 - damping) + damping * np.bincount(b, weights=w * score[a] / out[a], minlength=len(nodes))
        table = pd.DataFrame({"doc": pdf["doc"].iloc[0], "token": nodes, "weight": np.round(score / score.max(), 6)})
        table = table.sort_values(["weight", "token"], ascending=[False, True]).head(top_k).reset_index(drop=True)
        return table.assign(rank=range(1, len(table) + 1))

    kind = dict(df.dtypes)[doc]
    return both.groupBy("doc").applyInPandas(rank, f"doc {kind}, token string, weight double, rank int")


def pos_top(df: DataFrame, doc: str, text: str, top_k: int = 8, lexicon: DataFrame | None = None) -> DataFrame:
    """The part-of-speech method under the name of the others' parameters; without a lexicon there are no keywords."""
    words = df.sparkSession.createDataFrame([], "word string, pos string") if lexicon is None else lexicon
    return pos_keywords(df, doc, text, words, most=top_k)


METHODS = {"tfidf": tf_idf, "textrank": text_rank, "pos": pos_top}


def extract(df: DataFrame, doc: str, text: str, method: str = "tfidf", top_k: int = 8, **options) -> DataFrame:
    """``doc, keywords array<struct<reasoning, keyword, score>>``; an unknown method is taken for TF-IDF.

    Texts without any keyword give no row: for the fallback tool they have failed, as blank ones have.
    """
    found = METHODS.get(method, tf_idf)(df, doc, text, top_k, **options)
    score = F.col("score") if "score" in found.columns else F.least(F.col("weight"), F.lit(1.0))
    item = F.struct("rank", F.lit("").alias("reasoning"), F.col("token").alias("keyword"), score.alias("score"))
    grouped = found.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("k"))  # at most top_k a text
    return grouped.select("doc", F.transform("k", lambda k: F.struct(k["reasoning"].alias("reasoning"), k["keyword"].alias("keyword"), k["score"].alias("score"))).alias("keywords"))
