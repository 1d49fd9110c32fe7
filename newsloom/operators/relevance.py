"""Article relevance: TF-IDF over word 1-2-grams and class-balanced logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsloom.session import drop_stored, ship, store

THRESHOLD = 0.5
#: Words sent to the workers, to leave out pairs that can't be in the vocabulary; beyond that all pairs are counted.
MOST_WORDS = 1_000_000


def balanced(rows: DataFrame) -> DataFrame:
    """rows with a label, and weights that make both classes count the same."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weights = sizes.crossJoin(total).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
    return rows.join(F.broadcast(weights), "label")  # weights: one row a class


def fit(rows: DataFrame, vocabulary: int = 200_000, min_df: float = 2.0, max_df: float = 0.9, c: float = 1.0) -> PipelineModel:
    """Train on (text, label 0/1); blank texts are left out.

    Lower-cased words of two characters or more, their pairs, L2-normalised TF-IDF, logistic regression.
    Texts are cut into words once; words and counts are tables of the shared folder during the fit.
    """
    usable = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("text", F.col("label").cast("double").alias("label")).where("label is not null")
    cut = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    learnt = Pipeline(stages=[
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * 100), maxIter=50),
    ])
    paths = []
    try:
        texts, path = store(cut.transform(usable).select("label", F.array_join("words", " ").alias("words")), "relevance-words")
        paths.append(path)
        known = frequent_terms(texts, vocabulary, min_df, max_df)
        _, path = store(texts.mapInArrow(_count_known(known), f"label double, counts {VectorUDT.sqlType().simpleString()}"), "relevance-counts")
        paths.append(path)
        counted = rows.sparkSession.read.schema(StructType([StructField("label", DoubleType()), StructField("counts", VectorUDT())])).parquet(path)
        fitted = learnt.fit(balanced(counted)).stages
    finally:
        drop_stored(rows.sparkSession, *paths)
    terms = [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    return PipelineModel([cut, *terms, CountVectorizerModel.from_vocabulary(known, "terms", "counts"), *fitted])


def frequent_terms(texts: DataFrame, size: int, min_df: float, max_df: float) -> list[str]:
    """The `size` most frequent words and pairs of neighbours in texts (words: joined by spaces), of equal ones those that sort first.

    min_df and max_df bound the texts a term occurs in, as a number (1 and more) or a share of all.
    A pair occurs no more often, and in no more texts, than either of its words. So words are counted
    first, and pairs of words that are too rare by themselves are left out before they are counted.
    """
    ship(texts.sparkSession)
    total = texts.count()
    least, most = (x if x >= 1 else x * total for x in (min_df, max_df))
    if most < least:
        raise ValueError("max_df must not be less than min_df")
    words, path = store(_summed(texts, _words), "relevance-terms")
    try:
        fits = F.col("texts").between(least, most)
        top = words.where(fits).select("n").orderBy(F.desc("n")).limit(size).agg(F.count("*").alias("words"), F.min("n").alias("n")).first()
        common = words.where((F.col("texts") >= least) & (F.col("n") >= (top.n if top.words == size else 0))).select("term").limit(MOST_WORDS + 1).toArrow().column(0)
        kept = common.combine_chunks() if len(common) <= MOST_WORDS else None
        terms = words.unionByName(_summed(texts, lambda text, code, known: _pairs(text, code, known, kept))).where(fits)
        found = [r.term for r in terms.orderBy(F.desc("n"), "term").limit(size).select("term").collect()]
    finally:
        drop_stored(texts.sparkSession, path)
    if not found:
        raise ValueError("no term is left for the vocabulary; lower min_df")
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Up to 1000 texts at a time: the batch; the text and the code of each word, the words by code."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            words = pc.split_pattern(part.column("words"), " ")
            coded = words.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            some = pc.not_equal(part.column("words"), "").to_numpy(zero_copy_only=False)[text]  # a text without words splits into an empty one
            yield part, (text[some], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[some], coded.dictionary)


def _each(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes in order, and where the texts of each begin in what follows; the texts; how often the code occurs in the text."""
    width = int(text.max(initial=0)) + 1
    key, times = np.unique(code * width + text, return_counts=True)
    code, text = np.divmod(key, width)
    start = np.flatnonzero(np.r_[len(code) > 0, code[1:] != code[:-1]])
    return code[start], start, text, times


def _words(text: np.ndarray, code: np.ndarray, known: pa.Array):
    """The words, and the rest of _each()."""
    code, *rest = _each(text, code)
    return known.take(pa.array(code)), *rest


def _pairs(text: np.ndarray, code: np.ndarray, known: pa.Array, kept: pa.Array | None = None):
    """As _words() for pairs of neighbours, both of which are in kept if that is given."""
    fits = np.ones(len(known), bool) if kept is None else pc.is_in(known, kept).to_numpy(zero_copy_only=False)
    both = (text[1:] == text[:-1]) & fits[code[1:]] & fits[code[:-1]]
    code, *rest = _each(text[1:][both], code[:-1][both] * len(known) + code[1:][both])
    a, b = (known.take(pa.array(x)) for x in np.divmod(code, max(1, len(known))))
    return pc.binary_join_element_wise(a, b, " "), *rest


def _summed(texts: DataFrame, terms) -> DataFrame:
    """The terms (_words or _pairs) of all texts with their number n and the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(batches):
            term, start, _, times = terms(*words)
            if len(term):
                yield pa.RecordBatch.from_arrays([term, pa.array(np.add.reduceat(times, start)), pa.array(np.diff(start, append=len(times)))], ["term", "n", "texts"])

    counted = texts.select("words").mapInArrow(run, "term string, n long, texts long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _count_known(vocabulary: list[str]):
    """Rows (label, words) -> label, and the counts of the vocabulary's terms as the fields of a sparse vector."""
    vocabulary = pa.array(vocabulary, pa.string())
    parts = pa.array(sorted({w for term in vocabulary.to_pylist() if " " in term for w in term.split(" ")}), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in _slices(batches):
            keys, values = [], []
            for term, start, text, times in (_words(*words), _pairs(*words, parts)):
                place = np.repeat(pc.fill_null(pc.index_in(term, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(start, append=len(times)))
                keys.append((text * len(vocabulary) + place)[place >= 0])
                values.append(times[place >= 0])
            key, value = np.concatenate(keys), np.concatenate(values).astype(float)
            order = np.argsort(key)
            text, place = np.divmod(key[order], len(vocabulary))
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=rows.num_rows))].astype(np.int32))
            fields = [pa.array(np.zeros(rows.num_rows, np.int8)), pa.array(np.full(rows.num_rows, len(vocabulary), np.int32))]
            fields += [pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[order]))]
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])], ["label", "counts"])

    return run


def predict(model: PipelineModel, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows with score, is_relevant and reason; blank texts are irrelevant with score 0."""
    clean = F.trim(F.coalesce("text", F.lit("")))
    scored = model.transform(rows.withColumn("text", clean))
    score = F.when(F.col("text") == "", 0.0).otherwise(F.round(vector_to_array("probability")[1], 6))
    return scored.select(*[c for c in rows.columns if c != "text"], score.alias("score"), (score >= threshold).alias("is_relevant"), F.when(F.col("text") == "", "empty_text").alias("reason"))


def funnel(stages: dict[str, DataFrame], key: str = "article_id") -> DataFrame:
    """Articles that reach each stage, each stage among those of the one before."""
    rows, reached = None, None
    for k, (name, table) in enumerate(stages.items()):
        mine = table.select(key).distinct()
        reached = mine if reached is None else reached.join(mine, key, "left_semi")
        counted = reached.agg(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.count("*").alias("articles"))
        rows = counted if rows is None else rows.unionByName(counted)
    return rows
