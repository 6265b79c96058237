"""Toxicity by a classifier chain.

The chain predicts categories one after the other; each link is a linear (logistic) model over the presence
of words and word beginnings *and* over the probabilities that the links before it gave. In training, a link
never sees a probability that its own label helped to make: earlier links give out-of-fold predictions (each
fold by a model of the other folds), so that later links learn how far to trust them. The last link is the
label itself, ``toxic``; it decides.

Where labels only say toxic or not, the earlier categories are the modes in which texts are toxic: the toxic
texts of the sample, clustered by the features that go with the label. They need no word lists and follow
whatever languages the labels cover. A caller with word lists of their own passes ``categories``.

Fitting takes a bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_OTHER``, those of least hash),
weighted back to the shares of all labels. Spark counts their features and picks the best; the driver gets at
most ``FEATURES`` numbers of each sampled text. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of
from loamcube.llm._shared import materialize
from loamcube.llm.decontam import words_of

#: Bounds of the labelled sample.
MOST_TOXIC = 3000
MOST_OTHER = 5000
FEATURES = 1024
#: Words and beginnings are hashed to so many buckets.
BUCKETS = 1 << 20
FOLDS = 3
THRESHOLD = 0.5
#: Least number of sampled texts that hold a feature.
LEAST_TEXTS = 3
_MOST_CACHED = 100_000
_MOST_LOGIT = 9.0
#: Categories before the last, where no word lists are given.
MODES = 2


def features_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings of 4, 5 and 6 bytes."""
    h = xxhash.xxh32_intdigest
    return (h(word, 1) % BUCKETS, *(h(word[:n], n) % BUCKETS for n in (4, 5, 6) if len(word) > n))


@dataclass
class Link:
    """Weights over the chosen features, over the logits of earlier links, and the intercept."""

    name: str
    words: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class ToxicityChain:
    """The chosen features and the links in order; without links nothing is toxic."""

    index: dict[int, int]
    links: list[Link]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Texts by features to texts by links."""
        logits = np.zeros((len(rows), len(self.links)))
        for k, link in enumerate(self.links):
            logits[:, k] = np.clip(rows @ link.words + logits[:, :k] @ link.earlier + link.intercept, -_MOST_LOGIT, _MOST_LOGIT)
        return 1 / (1 + np.exp(-logits))


@dataclass
class Presence:
    """Texts by features, as the places of the ones, and columns of numbers beside them."""

    row: np.ndarray
    column: np.ndarray
    n_rows: int
    n_columns: int
    beside: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        k = self.n_columns
        return np.bincount(self.row, weights=w[self.column], minlength=self.n_rows) + self.beside @ w[k:]

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, weights=g[self.row], minlength=self.n_columns), self.beside.T @ g])

    def with_column(self, values: np.ndarray) -> Presence:
        return replace(self, beside=np.column_stack([self.beside, values]))

    def where(self, keep: np.ndarray) -> Presence:
        number = np.cumsum(keep) - 1
        ones = keep[self.row]
        return Presence(number[self.row[ones]], self.column[ones], int(keep.sum()), self.n_columns, self.beside[keep])


def _fit_link(x: Presence, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 200, settled: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted L2 logistic regression by accelerated gradient steps, over columns of equal mean square."""
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(x.n_columns + x.beside.shape[1]), float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return w, b
    weight = weight / weight.sum()
    square = np.concatenate([np.bincount(x.column, weights=weight[x.row], minlength=x.n_columns), weight @ x.beside**2])
    scale = 1 / np.sqrt(square + 1e-4)
    # step from a bound of the curvature, by power iteration
    v, most = np.ones(len(w)), 1.0
    for _ in range(15):
        v = scale * x.transposed_times(weight * x.times(scale * v / (np.linalg.norm(v) + 1e-12)))
        most = float(np.linalg.norm(v))
    step = 1 / (0.3 * (most + 1) + penalty)
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x.times(scale * pw) + pb, -40, 40))) - y)
        nw, nb = pw - step * (scale * x.transposed_times(g) + penalty * pw), pb - step * float(g.sum())
        moved = float(np.abs(nw - w).max(initial=0)) + abs(nb - b)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
        if moved < settled:
            break
    return scale * w, b


def fit_chain(x: Presence, labels: dict[str, np.ndarray], weight: np.ndarray, folds: np.ndarray, **steps) -> list[Link]:
    """Links for ``labels`` in order; ``folds`` numbers the fold of each row, ``steps`` are those of ``_fit_link``."""
    links: list[Link] = []
    for name, y in labels.items():
        y = y.astype(float)
        w, b = _fit_link(x, y, weight, **steps)
        links.append(Link(name, w[: x.n_columns], w[x.n_columns :], b))
        if len(links) < len(labels):
            held_out = np.zeros(len(y))
            for f in np.unique(folds):
                own = folds == f
                fw, fb = (w, b) if own.all() else _fit_link(x.where(~own), y[~own], weight[~own], **steps)
                held_out[own] = x.where(own).times(fw) + fb
            x = x.with_column(np.clip(held_out, -_MOST_LOGIT, _MOST_LOGIT))
    return links


def modes_of(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Number of the cluster of each text (texts by features): spherical k-means from texts far apart, larger clusters first."""
    x = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)
    centres = [x.mean(axis=0)]
    while len(centres) <= k:
        near = np.max(x @ np.array(centres[1:] or centres[:1]).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    centre, at = np.array(centres[1:]), np.zeros(len(x), int)
    for _ in range(rounds):
        at = np.argmax(x @ centre.T, axis=1)
        sums = np.array([x[at == c].sum(axis=0) for c in range(k)])
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centre = np.where(length > 0, sums / np.maximum(length, 1e-9), centre)
    order = np.argsort(-np.bincount(at, minlength=k), kind="stable")
    return np.argsort(order, kind="stable")[at]


def _sample_rows(categories: dict[str, tuple[str, ...]]):
    """(id, hash, toxic, weight, text) to (id, hash, toxic, weight, categories met as bits, features)."""
    sets = [{w.encode() for w in words} for words in categories.values()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, rows = [], []
            for text in binary_of(batch.column(4)):
                words = set(words_of(text.as_py()))
                bits.append(sum(1 << n for n, s in enumerate(sets) if words & s))
                rows.append(np.unique(np.array([f for w in words for f in features_of(w)], np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(bits, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["id", "h", "toxic", "weight", "bits", "features"])

    return scan


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    categories: dict[str, tuple[str, ...]] | None = None,
    modes: int = MODES,
    most_toxic: int = MOST_TOXIC,
    most_other: int = MOST_OTHER,
    n_features: int = FEATURES,
) -> ToxicityChain:
    """Train the chain on labelled rows of ``docs``.

    ``categories`` are word lists; a toxic text with a word of one belongs to it. Without them the toxic texts'
    own ``modes`` are the categories. Labels of null id or value are left out; an id with several labels is toxic if
    one says so, one with several texts counts with the least of them by features. A null text has no features, a very long one is read whole
    and leaves its features alone; other columns, of whatever name, aren't read. Without any labelled text the chain is
    empty and calls nothing toxic.
    """
    each = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = each.withColumn("h", F.xxhash64("id"))
    picked = None
    for value, most in ((1, most_toxic), (0, most_other)):
        some = each.where(F.col("toxic") == value).orderBy("h", "id").limit(most).withColumn("weight", F.lit(max(1.0, counts.get(value, 0) / most)))
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most most_toxic + most_other rows are broadcast
    rows = texts.join(F.broadcast(picked), "id").select(F.col("id").cast("string"), "h", "toxic", "weight", "text")
    rows = rows.mapInArrow(_sample_rows(categories or {}), "id string, h long, toxic int, weight double, bits int, features array<int>")
    rows = rows.groupBy("id", "h", "toxic", "weight").agg(F.min(F.struct("features", "bits")).alias("x")).select("id", "h", "toxic", "weight", "x.*")
    rows = materialize(rows, "labelled")
    total, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not total:
        return ToxicityChain({}, [])
    # how surely presence goes with the label: signed root of chi squared, by counts
    share = n_toxic / total
    here, expected = F.count("*"), F.count("*") * share
    score = (F.sum("toxic") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
    each = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(here.alias("n"), F.round(score, 9).alias("score"))
    best = each.where(F.col("n") >= min(LEAST_TEXTS, max(1, total // 20))).orderBy(F.desc(F.abs("score")), "feature").limit(n_features).collect()
    best.sort(key=lambda r: r.feature)
    index = {r.feature: n for n, r in enumerate(best)}

    @F.arrow_udf(T.ArrayType(T.ShortType()))
    def chosen(column: pa.Array) -> pa.Array:
        return pa.array([[index[f] for f in x if f in index] for x in column.to_pylist()], pa.list_(pa.int16()))

    got = rows.select("id", "h", "toxic", "weight", "bits", chosen("features").alias("at")).orderBy("h", "id").toArrow()
    toxic, weight, bits, h = (got.column(c).to_numpy() for c in ("toxic", "weight", "bits", "h"))
    at = got.column("at").combine_chunks()
    sizes = at.value_lengths().to_numpy(zero_copy_only=False)
    x = Presence(np.repeat(np.arange(total, dtype=np.int32), sizes), at.flatten().to_numpy().astype(np.int32), total, len(best), np.zeros((total, 0)))
    if categories:
        chain = {name: (toxic == 1) & (bits >> n & 1 == 1) for n, name in enumerate(categories)}
    else:
        goes_with = np.array([r.score > 0 for r in best], bool)
        chain = {f"mode{m + 1}": np.zeros(total, bool) for m in range(modes)}
        if n_toxic:
            own = x.where(toxic == 1)
            held = np.zeros((own.n_rows, own.n_columns), np.float32)
            held[own.row, own.column] = goes_with[own.column]
            mode = modes_of(held, modes)
            for m in range(modes):
                chain[f"mode{m + 1}"][np.flatnonzero(toxic == 1)[mode == m]] = True
    chain["toxic"] = toxic == 1
    return ToxicityChain(index, fit_chain(x, chain, weight, h.astype(np.int64) % FOLDS))


def _scorer(shared):
    chain: ToxicityChain = shared.value
    names = [link.name for link in chain.links]
    kind = pa.struct([(n, pa.float64()) for n in names])
    out = T.StructType()
    for n in names:
        out = out.add(n, "double")

    @F.arrow_udf(out)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain: ToxicityChain = shared.value
        get, width = chain.index.get, len(chain.index)
        known: dict[bytes, tuple[int, ...]] = {}
        for column in batches:
            parts = []
            column = binary_of(column)
            for first in range(0, len(column), 500):
                texts = column.slice(first, 500)
                x = np.zeros((len(texts), width), np.float32)
                for i, text in enumerate(texts):
                    for w in set(words_of(text.as_py())):
                        found = known.get(w)
                        if found is None:
                            if len(known) > _MOST_CACHED:
                                known.clear()
                            found = known[w] = tuple(k for f in features_of(w) if (k := get(f)) is not None)
                        for k in found:
                            x[i, k] = 1
                parts.append(chain.probabilities(x))
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], fields=list(kind))

    return score


def score(docs: DataFrame, chain: ToxicityChain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the probability ``tx_<link>`` of each link and ``tx_is_toxic`` (that of the last link at ``threshold``).

    A null or empty text has no words: its probabilities are the chain's without any. Whole texts are scored, however long;
    equal texts score alike, an empty table gives an empty one. Columns named ``tx_*`` are replaced, all others stay.
    """
    if not chain.links:
        return docs.withColumns({"tx_toxic": F.lit(0.0), "tx_is_toxic": F.lit(False)})
    # n_features entries and as many weights for each link: bounded
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    out = docs.withColumn("tx", _scorer(shared)(F.col(text_col)))
    out = out.withColumns({f"tx_{link.name}": F.col(f"tx.{link.name}") for link in chain.links})
    return out.withColumn("tx_is_toxic", F.col(f"tx_{chain.links[-1].name}") >= threshold).drop("tx")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the texts that the chain, fitted on ``labels``, calls toxic."""
    names = docs.columns
    return score(docs, fit(docs, labels, **options)).where(~F.col("tx_is_toxic")).select(*names)
