"""Toxicity by class-conditional Kneser-Ney models.

Two language models, of toxic and of ordinary texts, give each text a log-likelihood
per word; their difference is calibrated to a score. Each model interpolates, with
absolute discounts,

* pairs of words of the class,
* pairs of words of both classes together, so that a pair that few documents hold says only a little about the class,
* words of the class, each counted by the number of words it follows (Kneser-Ney),
* word beginnings of the class, for expressions too rare to be counted as words,
* and, shared by both classes, how a beginning continues to whole words: counts over
  *all* documents, labelled or not.

Words seen in neither class thus differ only by what is known of their
beginning, and a word with an unknown beginning differs by the models' total
discounts alone.

The class counts come from a bounded sample of labelled documents (``CLASS_DOCS`` of each
class), the scale of the score from another (``FIT_DOCS``). The model is bounded by
these, and is broadcast. The shared counts are a table of all words of all documents, which grows with them. The model has
its share for the words of the sample; for the other words the shared factor is joined to the documents that hold them
(``add_shared``): it is the same in both models, so it belongs to the likelihoods and not to their difference, the score.

Edge cases: a null or empty text has no words and scores the calibrated share of toxic
texts; a label of null is no label; several labels of a document count as one each; a
document id of null is never labelled; without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragchew.llm.common import free_name, materialize, text_batches
from ragchew.llm.hashing import PLAIN, U, mix, word_hashes

CLASS_DOCS = 4000
FIT_DOCS = 3000
STEM = 5
DISCOUNT = 2.0
PAIR_DISCOUNT = 1.0
HELD_WORDS = 1 << 19
CLEAR = 2.5
LIMIT = 2 << 20


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0x9E3779B97F4A7C15) + b, 7)


def _tokens(batch: pa.RecordBatch, text: str):
    return word_hashes(batch.column(batch.schema.get_field_index(text)), PLAIN, STEM, fold=True)


def class_counts(sample: DataFrame, corpus: DataFrame, text: str = "text", label: str = "toxic",
                 discount: float = PAIR_DISCOUNT):
    """Counts of a labelled sample, as small tables with the counts of ``corpus`` (n): words (key, its beginning, and per class the
    documents that have it and the distinct words it follows), and pairs (key, first word,
    documents per class). Pairs that ``discount`` takes whole have no mass in the models and are left out of the
    table; they are in the sums that the others are divided by."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, text, LIMIT):
            toxic = np.asarray(batch.column(batch.schema.get_field_index(label))).astype(bool)
            words, firsts, stems = _tokens(batch, text)
            of = np.repeat(np.arange(len(toxic)), np.diff(firsts))
            p = np.flatnonzero(of[1:] == of[:-1])
            for kind, key, a, b, d in ((0, words, stems, words, of),
                                       (1, pair_hash(words[p], words[p + 1]), words[p], words[p + 1], of[p + 1])):
                if not len(key):
                    continue
                once = np.unique(mix(key) ^ mix(d.astype(U), 3), return_index=True)[1]  # once per document
                uniq, at, inv = np.unique(key[once], return_index=True, return_inverse=True)
                n1 = np.bincount(inv, weights=toxic[d[once]], minlength=len(uniq)).astype(np.int64)
                n = np.bincount(inv, minlength=len(uniq)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(uniq), kind, np.int32)), pa.array(uniq.view(np.int64)),
                    pa.array(a[once][at].view(np.int64)), pa.array(b[once][at].view(np.int64)),
                    pa.array(n1), pa.array(n - n1)], ["kind", "key", "a", "b", "n1", "n0"])

    rows = sample.select(text, label).mapInArrow(run, "kind int, key long, a long, b long, n1 long, n0 long")
    counts = materialize(rows.groupBy("kind", "key").agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0")),
        "tox-counts")
    pairs = counts.where("kind = 1")
    follows = pairs.groupBy(F.col("b").alias("key")).agg(
        F.count_if(F.col("n1") > 0).alias("f1"), F.count_if(F.col("n0") > 0).alias("f0"))
    words = counts.where("kind = 0").join(follows, "key", "left").select(
        "key", "a", "n1", "n0", F.coalesce("f1", F.lit(0)).alias("f1"), F.coalesce("f0", F.lit(0)).alias("f0"))
    heads = pairs.groupBy(F.col("a").alias("key")).agg(F.sum("n1").alias("h1"), F.sum("n0").alias("h0"))
    corpus = corpus.select("key", F.col("n").cast("double").alias("n"), "stem", F.col("begun").cast("double").alias("begun"))
    words = words.join(heads, "key", "left").join(corpus.select("key", "n"), "key", "left").fillna(0)
    begun = corpus.groupBy(F.col("stem").alias("key")).agg(F.max("begun").alias("n"))
    stems = words.groupBy(F.col("a").alias("key")).agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "f1", "f0")])
    stems = stems.join(begun, "key", "left").fillna(0)
    size = words.agg(F.sum("f1"), F.sum("f0")).first()
    some = pairs.where(F.col("n1") + F.col("n0") > discount).select(
        "key", "a", F.col("n1").cast("int").alias("n1"), F.col("n0").cast("int").alias("n0"))

    def small(df: DataFrame):
        """To the driver, counts as 32 bits: bounded by the sample."""
        return df.select(*[F.col(c).cast("int").alias(c) if c in ("n1", "n0", "f1", "f0", "h1", "h0") else F.col(c)
                           for c in df.columns]).toArrow().to_pandas()

    return small(words), small(stems), small(some), (size[0] or 0, size[1] or 0)


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All words of all documents: key, stem, n (occurrences) and begun (occurrences of all words of the stem). Tasks sum
    before the shuffle, ``HELD_WORDS`` words at a time."""
    schema = ["key", "stem", "n"]

    def run(batches: Iterator[pa.RecordBatch]):
        held = [np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].view(np.int64)),
                                               pa.array(held[2])], schema)

        for batch in text_batches(batches, text, LIMIT):
            words, _, stems = _tokens(batch, text)
            every = np.concatenate([held[0], words])
            n = np.concatenate([held[2], np.ones(len(words), np.int64)])
            begin = np.concatenate([held[1], stems])
            keys, at, inv = np.unique(every, return_index=True, return_inverse=True)
            held = [keys, begin[at], np.bincount(inv, n, len(keys)).astype(np.int64)]
            if len(keys) > HELD_WORDS:
                yield out()
                held = [x[:0] for x in held]
        yield out()

    counts = docs.select(text).mapInArrow(run, "key long, stem long, n long").groupBy("key").agg(
        F.first("stem").alias("stem"), F.sum("n").alias("n"))
    counts = materialize(counts, "tox-corpus")
    begun = counts.groupBy("stem").agg(F.sum("n").alias("begun"))
    return materialize(counts.join(begun, "stem").select("key", "stem", "n", "begun"), "tox-begun")


class Models:
    """Both class models as sorted arrays, ready for whole columns of words.

    Mass that the discounts free goes to the shared counts. It is pooled over the classes, so that an
    expression that neither class has counts for says nothing about the class.
    """

    def __init__(self, words, stems, pairs, sizes, every: float, discount: float = DISCOUNT,
                 pair_discount: float = PAIR_DISCOUNT):
        self.words, w = _sorted(words)
        self.stems, t = _sorted(stems)
        self.pairs, p = _sorted(pairs)
        every = max(float(every), 1.0)
        in_corpus = np.maximum(w.n.to_numpy(), 0.5) / every
        begun = np.maximum(t.n.to_numpy(), 0.5) / every
        stem_of, has_stem = _find(self.stems, w.a.to_numpy().view(U))
        goes_on = np.where(has_stem, np.minimum(in_corpus / _at(begun, stem_of), 1.0), 1.0)

        def kept(n, size):
            return np.maximum(n.to_numpy() - discount, 0) / max(size, 1.0)

        heads = [w[h].to_numpy() for h in ("h1", "h0")]
        prev, led = _find(self.words, p.a.to_numpy().view(U))
        self.word_p, self.rare_p, self.pair_p, self.back = [], [], [], []
        stem_kept = [kept(t[c], n) for c, n in zip(("f1", "f0"), sizes)]
        word_kept = [kept(w[c], n) for c, n in zip(("f1", "f0"), sizes)]
        pair_kept = [np.where(led, np.maximum(p[c].to_numpy() - discount, 0)
                              / np.maximum(_at(h, prev), 1.0), 0.0) for c, h in zip(("n1", "n0"), heads)]
        free_stem = max(1.0 - np.mean([x.sum() for x in stem_kept]), 1e-3)
        free_word = max(1.0 - np.mean([x.sum() for x in word_kept]), 1e-3)
        free_pair = np.maximum(1.0 - np.mean([np.bincount(prev, x, len(self.words)) for x in pair_kept], axis=0), 1e-3) \
            if len(self.words) else np.ones(0)
        both = np.where(led, np.maximum((p.n1 + p.n0).to_numpy() - pair_discount, 0)
                        / np.maximum(_at(heads[0] + heads[1], prev), 1.0), 0.0)
        free_both = np.maximum(1.0 - np.bincount(prev, both, len(self.words)), 1e-3) if len(self.words) else np.ones(0)
        for c in (0, 1):
            stem_p = stem_kept[c] + free_stem * begun
            lower = np.where(has_stem, _at(stem_p, stem_of) * goes_on, free_stem * in_corpus)
            self.word_p.append(word_kept[c] + free_word * lower)
            self.rare_p.append(free_word * stem_p)
            self.pair_p.append(pair_kept[c] + _at(free_pair, prev) * both)
            self.back.append(free_pair * free_both)
        self.lost_p = free_word * free_stem / every

    @classmethod
    def of(cls, arrays: dict) -> Models:
        """A model from its arrays, which are what travels to tasks."""
        made = cls.__new__(cls)
        made.__dict__.update(arrays)
        return made

    def ratio(self, words: np.ndarray, stems: np.ndarray, firsts: np.ndarray):
        """Log-likelihoods of every word under the toxic and the ordinary model."""
        at, known = _find(self.words, words)
        st, begun = _find(self.stems, stems)
        before = np.ones(len(words), bool)
        before[firsts[:-1][firsts[:-1] < len(words)]] = False
        before[0:1] = False
        pr = np.zeros(len(words), np.int64)
        paired = np.zeros(len(words), bool)
        if len(words) > 1:
            pr[1:], paired[1:] = _find(self.pairs, pair_hash(words[:-1], words[1:]))
        paired &= before
        led = np.concatenate([[False], known[:-1]])[:len(words)] & before
        prev = np.concatenate([[0], at[:-1]])[:len(words)]
        out = []
        for c in (0, 1):
            p = np.where(known, _at(self.word_p[c], at), np.where(begun, _at(self.rare_p[c], st), self.lost_p))
            p = np.where(led, _at(self.back[c], prev), 1.0) * p + np.where(paired & led, _at(self.pair_p[c], pr), 0.0)
            out.append(np.log(np.maximum(p, 1e-300)))
        return out

    def strange(self, words: np.ndarray, stems: np.ndarray, firsts: np.ndarray) -> pa.Array:
        """Per text, the words that the model has no count of: list of (key, begun: whether it has their beginning, n)."""
        odd = np.flatnonzero(~_find(self.words, words)[1])
        of = np.searchsorted(firsts, odd, side="right") - 1
        order = np.lexsort((words[odd], of))
        odd, of = odd[order], of[order]
        new = np.ones(len(odd), bool)
        new[1:] = (of[1:] != of[:-1]) | (words[odd[1:]] != words[odd[:-1]])
        at = np.flatnonzero(new)
        rows = pa.StructArray.from_arrays(
            [pa.array(words[odd[at]].view(np.int64)), pa.array(_find(self.stems, stems[odd[at]])[1]),
             pa.array(np.diff(np.append(at, len(odd))).astype(np.int64))], ["key", "begun", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(len(firsts))).astype(np.int32)), rows)

    def features(self, batch: pa.RecordBatch, text: str):
        """Per text: words, both log-likelihoods per word, and how much of their difference per
        word lies ``CLEAR`` above what is usual in the text (a language or subject shifts all its words)."""
        words, firsts, stems = _tokens(batch, text)
        n = np.diff(firsts)
        if not len(words):
            return n, np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
        toxic, plain = self.ratio(words, stems, firsts)
        d, per = toxic - plain, np.maximum(n, 1)
        usual = _sums(np.clip(d, -1, 1), firsts) / per
        clear = _sums(np.maximum(d - np.repeat(usual, n) - CLEAR, 0), firsts) / per
        return n, _sums(toxic, firsts) / per, _sums(plain, firsts) / per, clear


def _sorted(table):
    table = table.iloc[np.argsort(table.key.to_numpy().view(U), kind="stable")]
    return table.key.to_numpy().view(U).copy(), table


def _at(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    return values[index] if len(values) else np.zeros(len(index))


def _find(keys: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _sums(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(x)])[firsts])


def _columns(n, toxic, plain, clear) -> np.ndarray:
    """What the score depends on: the differences per word, also weighted by the length."""
    return np.stack([np.ones(len(n)), toxic - plain, clear, np.minimum(clear, 0.05) * np.sqrt(n),
                     np.minimum(clear, 0.02)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0.0, 1.0
    sd[sd < 1e-12] = 1.0
    z = (x - mean) / sd
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    out = b / sd
    out[0] = b[0] - (b[1:] * mean[1:] / sd[1:]).sum()
    return out


@dataclass
class Fitted:
    """The calibration, the broadcast model and the table of all words."""

    weights: np.ndarray
    box: object
    corpus: DataFrame


def fit(docs: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS, fit_docs: int = FIT_DOCS,
        id_col: str = "doc_id", text: str = "text", label: str = "toxic"):
    """Models and calibration from labelled documents; None without both classes.

    ``labels`` has the id and the label of the rows that may be learned from. Of each
    class, ``class_docs`` documents in order of a hash of the id give the counts and the next ``fit_docs``
    the calibration.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"),
        F.xxhash64(id_col, F.lit(17)).alias("_o")).distinct()
    many = dict(marks.groupBy("_y").count().collect())
    if len(many) < 2:
        return None
    # as many of each class; a share of them goes to calibration where there are few
    least = min(min(many.values()), class_docs + fit_docs)
    for_fit = min(fit_docs, max(1, least // 4))
    parts = None
    for y in many:
        some = marks.where(F.col("_y") == y).orderBy("_o", "_id").limit(least).withColumn(
            "_fit", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1000)) < F.lit(int(1000 * for_fit / least)))
        parts = some if parts is None else parts.unionByName(some)
    # bounded by class_docs + fit_docs of each class, so it may be broadcast
    sample = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(parts.select("_id", "_y", "_fit")), "_id"), "tox-sample")
    corpus = corpus_counts(docs, text)
    words, stems, pairs, sizes = class_counts(sample.where(~F.col("_fit")), corpus, "text", "_y")
    models = Models(words, stems, pairs, sizes, corpus.agg(F.sum("n")).first()[0] or 0)
    box = docs.sparkSession.sparkContext.broadcast(dict(vars(models)))

    def run(batches):
        own = Models.of(box.value)
        for batch in text_batches(batches, "text", LIMIT):
            y = np.asarray(batch.column(batch.schema.get_field_index("_y")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (y.astype(np.int32), *own.features(batch, "text"))],
                ["y", "n", "toxic", "plain", "clear"])

    held = sample.where("_fit").select("text", "_y").mapInArrow(
        run, "y int, n long, toxic double, plain double, clear double").toPandas()
    if held.y.nunique() < 2:
        return Fitted(np.array([0.0, 20.0, 0.0, 0.0, 0.0]), box, corpus)
    weights = _logistic(_columns(*(held[c].to_numpy() for c in ("n", "toxic", "plain", "clear"))),
                        held.y.to_numpy().astype(float))
    weights[0] += np.log(many[1] / many[0])  # the sample has as many of each class
    return Fitted(weights, box, corpus)


NEW = ["n_words", "toxic_ll", "plain_ll", "score"]
STRANGE = "array<struct<key:bigint,begun:boolean,n:bigint>>"


def score(docs: DataFrame, fitted: Fitted | None, text: str = "text", strange: str | None = None) -> DataFrame:
    """``docs`` and behind its columns n_words, toxic_ll, plain_ll (per word) and score, named by ``free_name``. With
    ``strange``, a column of that name holds the words whose shared factor the likelihoods lack (``add_shared``)."""
    new = [free_name(docs, c) for c in NEW] + ([strange] if strange else [])
    if fitted is None:
        none = F.lit(None).cast("double")
        values = [F.lit(None).cast("long"), none, none, F.lit(0.0), F.array().cast(STRANGE)]
        return docs.withColumns(dict(zip(new, values)))
    weights, box = fitted.weights, fitted.box
    names = docs.columns

    def run(batches):
        own = Models.of(box.value)
        for batch in text_batches(batches, text, LIMIT):
            n, toxic, plain, clear = own.features(batch, text)
            s = 1 / (1 + np.exp(-np.clip(_columns(n, toxic, plain, clear) @ weights, -30, 30)))
            out = [pa.array(n, pa.int64()), pa.array(toxic), pa.array(plain), pa.array(s)]
            if strange:
                words, firsts, stems = _tokens(batch, text)
                out.append(own.strange(words, stems, firsts))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*names, *new])

    given = StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(new, ("long", "double", "double", "double", STRANGE))))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *given.fields]))


def add_shared(scored: DataFrame, corpus: DataFrame, strange: str) -> DataFrame:
    """Likelihoods with the shared factor of the words in ``strange``: of a word whose beginning the model has, how often the
    beginning goes on so; of any other, its occurrences. Sums per text are joined back by a row number."""
    numbered = materialize(scored.withColumn("__row", F.monotonically_increasing_id()), "tox-scored")
    odd = numbered.select("__row", F.explode(strange).alias("w")).select("__row", "w.*")
    known = corpus.select("key", F.col("n").alias("all"), F.col("begun").alias("stem_all"))
    factor = F.when(F.col("begun"), F.least(F.col("all") / F.col("stem_all"), F.lit(1.0))).otherwise(F.col("all"))
    shared = odd.join(known, "key").groupBy("__row").agg(F.sum(F.col("n") * F.log(factor.cast("double"))).alias("__shared"))
    per_word = F.coalesce(F.col("__shared") / F.col("n_words"), F.lit(0.0))
    return (numbered.join(shared, "__row", "left")
            .withColumns({c: F.col(c) + per_word for c in ("toxic_ll", "plain_ll")}).drop("__row", "__shared", strange))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted, and the likelihoods."""
    fitted = fit(docs, labels.where(~held_out()), **options)
    scored = score(docs.select("doc_id", "text"), fitted, strange="strange")
    scored = scored.drop("strange") if fitted is None else add_shared(scored.drop("text"), fitted.corpus, "strange")
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "toxic_ll", "plain_ll")
