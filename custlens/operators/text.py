"""Review text analysis: tokens, word counts (optionally stemmed), word-cloud
weights, dictionary polarity, aspect sentiment and LDA topics."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.porter import stem as porter_stem
from custlens.plans import lda

# fixed values: stop words dropped before counting review words (the original list, in its order)
REVIEW_STOP_WORDS = """the a an and my is was for of to in from at this that with such very i me it be so
you your we our they them he she his her its are were been being do does did have has
had will would can could should may might must not no nor but or if then than too""".split()

# fixed values: the original default aspect dictionary
DEFAULT_ASPECTS = [
    ("flavor", ["flavor", "taste"]),
    ("shipping", ["shipping", "delivery", "arrived", "delayed"]),
    ("price", ["price", "expensive", "overpriced"]),
    ("packaging", ["packaging", "bags", "box"]),
]

LEXICON_ROWS = 500_000


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), 0)


def tokens(df: DataFrame, key: str, text: str, stop: Iterable[str] | None = REVIEW_STOP_WORDS,
           min_len: int = 3) -> DataFrame:
    """(key, pos, token): lower-cased ``[a-z]+`` runs of the whole text, stop
    words and tokens shorter than ``min_len`` dropped; ``pos`` is the position
    among all runs."""
    stop = sorted(set(stop or []))
    src = df.select(key, text)
    t = src.where(F.col(text).isNotNull()).select(key, F.posexplode(_words(text)).alias("pos", "token"))
    cond = F.length("token") >= min_len
    if stop:
        cond = cond & ~F.col("token").isin(stop)
    return t.where(cond)


@functools.cache
def _stemmer(extended: bool):
    @F.pandas_udf("string")
    def _stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: porter_stem(w, extended))

    return _stem


def word_counts(df: DataFrame, text: str, stop: Iterable[str] | None = REVIEW_STOP_WORDS, stem: bool = True,
                min_len: int = 3, extended: bool = True) -> DataFrame:
    """(word, count) over all texts.  Tokens are counted first (map-side
    combine); stemming then runs on the distinct vocabulary with an Arrow UDF
    and counts are re-aggregated by stem: by the extended variant of Porter's
    rules, or (``extended=False``) those of 1980."""
    t = tokens(df.select(F.lit(0).alias("_k"), text), "_k", text, stop, min_len)
    counts = t.groupBy("token").agg(F.count("*").alias("count"))
    if not stem:
        return counts.withColumnRenamed("token", "word")
    return counts.select(_stemmer(extended)("token").alias("word"), "count").groupBy("word").agg(
        F.sum("count").alias("count"))


def top_words(df: DataFrame, text: str, n: int = 15, **kw) -> DataFrame:
    """The ``n`` most frequent (stemmed) words; ties by word."""
    return word_counts(df, text, **kw).orderBy(F.desc("count"), F.asc("word")).limit(n)


def word_weights(df: DataFrame, text: str, **kw) -> DataFrame:
    """(word, count, weight) with weight = count / largest count."""
    wc = word_counts(df, text, **kw)
    mx = wc.agg(F.max("count").alias("_mx"))
    return wc.crossJoin(F.broadcast(mx)).select("word", "count", (F.col("count") / F.col("_mx")).alias("weight"))


def polarity_scorer(lexicon: DataFrame, negations: Sequence[str] = (), negation_factor: float = -0.5,
                    intensifiers: DataFrame | None = None):
    """A function from a text column to struct(polarity, n_matched).

    The word tables are dictionaries of checked size (at most
    ``LEXICON_ROWS`` rows each); texts are scored where they are read, in
    Arrow batches, so they are never shuffled or joined."""
    values = _dictionary(lexicon, "polarity")
    factors = _dictionary(intensifiers, "intensity") if intensifiers is not None else {}
    negative = frozenset(negations)

    def score(text: str | None) -> tuple[float | None, int | None]:
        if text is None:
            return None, None
        total, n, before = 0.0, 0, None
        for w in re.findall("[a-z]+", text.lower()):
            v = values.get(w)
            if v is not None:
                if before in negative:
                    v *= negation_factor
                v *= factors.get(before, 1.0)
                total, n = total + max(-1.0, min(1.0, v)), n + 1
            before = w
        return total / n if n else 0.0, n

    @F.pandas_udf("polarity double, n_matched long")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(t) for t in texts], columns=["polarity", "n_matched"]).astype(
            {"polarity": "float64", "n_matched": "Int64"})

    return scored


def _dictionary(table: DataFrame, value: str) -> dict[str, float]:
    rows = table.select(F.lower("word").alias("w"), F.col(value).cast("double").alias("v")).where(
        F.col("w").isNotNull() & F.col("v").isNotNull()).limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"word table with more than {LEXICON_ROWS} rows")
    return {r["w"]: r["v"] for r in rows}


def with_polarity(df: DataFrame, text: str, lexicon: DataFrame, **options) -> DataFrame:
    """The rows with text and their ``polarity`` and ``n_matched``; a projection, no shuffle."""
    scored = polarity_scorer(lexicon, **options)
    return df.where(F.col(text).isNotNull()).withColumn("_scored", scored(F.col(text))).withColumns(
        {"polarity": F.col("_scored.polarity"), "n_matched": F.col("_scored.n_matched")}).drop("_scored")


def polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: Sequence[str] = (),
             negation_factor: float = -0.5, intensifiers: DataFrame | None = None) -> DataFrame:
    """(key, polarity, n_matched) for every row with text.

    Polarity is the mean lexicon value over the text's words found in
    ``lexicon`` (word, polarity); 0 when none is found.  A word preceded by a
    negation word is multiplied by ``negation_factor``; with ``intensifiers``
    (word, intensity) a preceding intensifier multiplies the value."""
    return with_polarity(df.select(key, text), text, lexicon, negations=negations, negation_factor=negation_factor,
                         intensifiers=intensifiers).select(key, "polarity", "n_matched")


def polarity_summary(df: DataFrame, pol: str = "polarity") -> DataFrame:
    """One row: share > 0.05, share < -0.05, mean polarity, n."""
    p = F.col(pol)
    return df.agg(F.avg((p > 0.05).cast("double")).alias("share_positive"),
                  F.avg((p < -0.05).cast("double")).alias("share_negative"),
                  F.avg(p).alias("mean_polarity"), F.count(p).alias("n"))


ASPECT_KEYWORDS = 1_000_000


def _aspect_list(aspects) -> list[tuple[int, str, list[str]]]:
    """Aspects as (index, name, keywords): from a dict, a list of pairs, or a
    DataFrame (aspect, keywords array) - a dictionary table of checked size."""
    if isinstance(aspects, DataFrame):
        rows = aspects.select("aspect", "keywords").where("aspect IS NOT NULL")
        size = rows.agg(F.sum(F.greatest(F.size(F.coalesce("keywords", F.array())), F.lit(1)))).first()[0] or 0
        if size > ASPECT_KEYWORDS:
            raise ValueError(f"aspect table with more than {ASPECT_KEYWORDS} keywords")
        aspects = [(r["aspect"], list(r["keywords"] or [])) for r in rows.collect()]
    items = list(aspects.items()) if isinstance(aspects, Mapping) else list(aspects)
    out = []
    for i, (name, kws) in enumerate(items):
        kws = [k.strip().lower() for k in kws if k and k.strip()]
        if kws:
            out.append((i, name.strip(), kws))
    return out


def aspect_tagger(listed: Sequence[tuple[int, str, list[str]]], whole_word: bool = False):
    """A function from a lower-cased text column to the numbers of the aspects it
    mentions: one automaton over all keywords reads each text once, however many
    keywords there are."""
    owners: dict[str, list[int]] = {}
    for i, _, kws in listed:
        for k in set(kws):
            owners.setdefault(k, []).append(i)

    def word(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

    def bounded(text: str, start: int, end: int) -> bool:
        return word(text, start - 1) != word(text, start) and word(text, end - 1) != word(text, end)

    @F.pandas_udf("array<int>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, numbers in owners.items():
            automaton.add_word(k, (len(k), numbers))
        automaton.make_automaton()

        def mentioned(text: str | None) -> list[int]:
            found: set[int] = set()
            for last, (length, numbers) in automaton.iter(text or ""):
                if not whole_word or bounded(text, last + 1 - length, last + 1):
                    found.update(numbers)
            return sorted(found)

        for texts in batches:
            yield pd.Series([mentioned(t) for t in texts], index=texts.index, dtype=object)

    return tagged


def aspect_sentiment(df: DataFrame, text: str, pol: str = "polarity", aspects=DEFAULT_ASPECTS,
                     whole_word: bool = False) -> DataFrame:
    """(aspect, n, mean_polarity) ascending by mean polarity.

    A text mentions an aspect when any keyword is a substring of the lower-cased
    text (``whole_word=True`` asks for word boundaries).  Texts are scanned where
    they are read and only the aspects' numbers go on; the dictionary (at most
    ``ASPECT_KEYWORDS`` keywords, else an error) travels with the function, so
    the plan does not grow with it.  Aspects without a mention are left out; an
    aspect listed twice gives two rows; without keywords there are none."""
    listed = _aspect_list(aspects)
    schema = "aspect string, n long, mean_polarity double"
    if not listed:
        return df.sparkSession.createDataFrame([], schema)
    tagged = aspect_tagger(listed, whole_word)
    rows = df.where(F.col(text).isNotNull()).select(tagged(F.lower(F.col(text))).alias("_i"), F.col(pol).alias("_pol"))
    found = rows.select(F.explode("_i").alias("_i"), "_pol").groupBy("_i").agg(
        F.count("*").alias("n"), F.avg("_pol").alias("mean_polarity"))
    names = df.sparkSession.createDataFrame([(i, name) for i, name, _ in listed], "_i int, aspect string")
    return found.join(names, "_i").select("aspect", "n", "mean_polarity").orderBy("mean_polarity", "aspect")


# texts of up to so many characters in all are fitted by Spark's LDA, whose tasks and driver
# hold tables of all terms; more by ``plans.lda``, which holds none
LDA_CHARS = 32_000_000


def topics(df: DataFrame, text: str, k: int = 3, min_df: int = 5, top: int = 8, seed: int = 42,
           max_iter: int = 20, texts_per_task: int = 2000, lda_chars: int = LDA_CHARS) -> DataFrame:
    """LDA topics: (topic, rank, term, weight) for the ``top`` terms of each of
    ``k`` topics.  Tokens of two or more word characters, English stop words
    removed, terms in at least ``min_df`` documents; no topics without such terms.
    Texts of more than ``lda_chars`` characters in all go through ``plans.lda``:
    the same estimate (draws differ), with the terms dealt to shards."""
    docs = df.select(text).where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    # the work is in the iterations, not in the bytes read: a file of few row groups
    # must not leave it to as many tasks
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    tasks = min(2 * df.sparkSession.sparkContext.defaultParallelism, n // texts_per_task)
    many = chars > lda_chars
    if docs.rdd.getNumPartitions() < tasks:
        docs = docs.repartition(tasks)
        if not many:
            docs = docs.persist(StorageLevel.DISK_ONLY)
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern="\\b\\w\\w+\\b", gaps=False,
                         toLowercase=True).transform(docs)
    clean = StopWordsRemover(inputCol="_tok", outputCol="_words").transform(tok)
    if many:
        return lda.topics(clean.select(F.concat_ws(" ", "_words").alias("_words")),
                          min_df if min_df >= 1 else min_df * n, chars, k, top, seed, max_iter)
    # the vocabulary holds every term that reaches min_df, and every iteration
    # reads every document
    terms = clean.select(F.explode(F.array_distinct("_words")).alias("w")).groupBy("w").count().where(
        F.col("count") >= min_df).count()
    if not terms:
        return df.sparkSession.createDataFrame([], "topic int, rank int, term string, weight double")
    cv = CountVectorizer(inputCol="_words", outputCol="_counts", minDF=float(min_df), vocabSize=max(1, terms)).fit(clean)
    vec = cv.transform(clean).select("_counts").persist()
    model = LDA(k=k, seed=seed, featuresCol="_counts", maxIter=max_iter, subsamplingRate=1.0).fit(vec)
    vec.unpersist()
    docs.unpersist()
    desc = model.describeTopics(top)
    spark = df.sparkSession
    vocab = spark.createDataFrame([(i, w) for i, w in enumerate(cv.vocabulary)], "_idx int, term string")
    t = desc.select(F.col("topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
    t = t.select((F.col("topic") + 1).alias("topic"), (F.col("rank") + 1).alias("rank"),
                 F.col("z.termIndices").alias("_idx"), F.col("z.termWeights").alias("weight"))
    return t.join(vocab, "_idx").select("topic", "rank", "term", "weight")
