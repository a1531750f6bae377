"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters look at the words of a text: lexicon voters at fixed words, pattern voters at beginnings of
words and whole words that occur more often in the labelled toxic texts. A voter fires or not. The
label model has a hidden label for each text and, given the label, a firing rate for each voter (its
accuracy). Correlations are parameters too: voters that depend on each other beyond the label are joined in
a forest, and a voter's rate is then given by the label and its parent's vote, so that two voters that say
the same count once. Rates, forest and the accuracy of the labels that were given, which are one more
vote, are fitted by expectation maximisation. A logistic classifier over word features, with a quadratic
penalty, is then trained on the posterior labels and scores every text.

Voters and models are fitted on at most ``max_rows`` labelled rows, those with the least hash of
their id, with at most ``max_candidates`` features looked at, ``max_voters`` pattern voters and
``max_features`` features of the classifier; labels serve to choose voters and to start the fit. All else
covers every row and the whole of its text. Texts that are null or empty have the score of a text without
features; rows that repeat are scored each for itself; an empty table gives no rows. With labelled rows of
one kind only no voter is chosen, and every text has the share of toxic rows as its score; without any
labelled row the lexicon alone scores, each of its words alike. Labels that are null are left out; of
several for one id the largest counts. Features of equal ratio are ranked by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import packing
from vertexloom.llm.workspace import Workspace, ship

#: Words that a text is often toxic by.
LEXICON = """
abuse awful bastard bitch braindead clown coward creep crap cretin cunt damn despicable dirtbag
disgrace disgusting dumb dumbass failure fool freak fuck garbage hate hateful hideous idiot idiotic
ignorant imbecile incompetent jerk kill lame liar loathsome loser lowlife maggot miserable moron
moronic nasty obnoxious parasite pathetic pig psycho punk rat repulsive retard rotten rubbish scum
scumbag shit shut sick slob slut stupid suck sucks swine thug trash ugly useless vermin vile vulgar
weak whore worthless wretched
""".split()
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
#: Bytes of text taken up at once; words whose features a worker remembers before it starts anew.
CHUNK_BYTES, KNOWN_WORDS = 1 << 18, 100_000
#: The log-likelihood ratio that a feature needs; chance gives it to one in 100,000.
MIN_RATIO = 20


def features_of_word(word: str) -> list[str]:
    """Beginnings as "abc-", the whole word as "abc"."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def _text(raw: bytes | None) -> str:
    return raw.decode("utf-8", "replace").lower() if raw else ""


def _features(docs: DataFrame) -> DataFrame:
    """The distinct features of each text."""
    arrow = pa.schema({"row": pa.int64(), "toxic": pa.int32(), "features": pa.list_(pa.string())})

    def run(chunk: pa.RecordBatch) -> Iterator[dict]:
        texts = packing.text_bytes(chunk.column(2))
        each = [sorted({f for w in set(WORD.findall(_text(t))) for f in features_of_word(w)}) for t in texts]
        yield {"row": chunk.column(0), "toxic": chunk.column(1), "features": each}

    return docs.select("row", "toxic", "text").mapInArrow(packing.map_chunks(run, 2, arrow, CHUNK_BYTES // 2), "row long, toxic int, features array<string>")


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are for measuring only; a null id: none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class LabelModel:
    """Voters' rates given the hidden label, a forest of their correlations (``parent``, -1: none), and rates
    given the label and the parent's vote.

    The labels that were given are a vote too. Its accuracy begins at ``trust``, which counts as much as
    ``trust_rows`` rows; that ties the hidden label to toxicity and lets the other votes overrule a slip.
    """

    def __init__(self, votes: np.ndarray, given: np.ndarray, trust: float = 0.97, trust_rows: int = 200, rounds: int = 20):
        given = np.asarray(given) > 0
        q = np.where(given, trust, 1 - trust)
        for k in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
            # Of each label: the joint rate of all pairs of voters; a voter's own is on the diagonal.
            self.joint = [self._joint(votes, w, a) for w, a in ((1 - q, 0.01), (q, 0.5 * self.prior))]
            self.fires_clean, self.fires_toxic = (np.diag(j).copy() for j in self.joint)
            if k % 5 == 0:
                self.parent = self._forest(len(given))
            self._set_weights()
            right = [((q if label else 1 - q)[given == bool(label)].sum() + trust * trust_rows) / ((q if label else 1 - q).sum() + trust_rows) for label in (0, 1)]
            self.given_right = right
            annotator = np.where(given, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
            q = self.posterior(votes, annotator)
        self.labels = q

    @staticmethod
    def _joint(votes: np.ndarray, weight: np.ndarray, add: float) -> np.ndarray:
        out = (votes * weight[:, None]).T @ votes
        out[np.diag_indices(len(out))] += add
        return np.clip(out / (weight.sum() + 1), 1e-9, 1 - 1e-9).astype(float)

    def _cells(self, label: int) -> list[np.ndarray]:
        """The rates of (both, only the row's, only the column's, none) for all pairs, given the label."""
        both, own = self.joint[label], np.diag(self.joint[label])
        both = np.minimum(both, np.minimum(own[:, None], own))
        return [np.clip(x, 1e-9, 1) for x in (both, own[:, None] - both, own - both, 1 - own[:, None] - own + both)]

    def _forest(self, n: int) -> np.ndarray:
        """The forest of the largest mutual information given the label; links that chance gives to fewer than one in 100,000."""
        info = 0
        for label, share in ((0, 1 - self.prior), (1, self.prior)):
            own = np.diag(self.joint[label])
            alone = (own[:, None] * own, own[:, None] * (1 - own), (1 - own[:, None]) * own, (1 - own[:, None]) * (1 - own))
            info = info + share * sum(c * np.log(c / np.clip(a, 1e-9, 1)) for c, a in zip(self._cells(label), alone))
        links = np.argwhere(np.triu(2 * n * info > MIN_RATIO, 1))
        links = links[np.argsort(-info[tuple(links.T)], kind="stable")]
        tree, near = list(range(len(info))), [[] for _ in info]

        def root(i: int) -> int:
            while tree[i] != i:
                i = tree[i]
            return i

        for i, j in links.tolist():
            if (a := root(i)) != (b := root(j)):
                tree[a] = b
                near[i].append(j), near[j].append(i)
        parent, seen = np.full(len(info), -1), set()
        for first in range(len(info)):
            todo = [] if first in seen else [first]
            seen.add(first)
            while todo:
                i = todo.pop()
                for j in near[i]:
                    if j not in seen:
                        seen.add(j), todo.append(j)
                        parent[j] = i
        return parent

    def _set_weights(self) -> None:
        """The evidence for toxicity as bias + linear in the votes + for each voter with a parent one for both firing."""
        logs = []
        for label in (0, 1):
            own = np.diag(self.joint[label])
            has = np.flatnonzero(self.parent >= 0)
            up = self.parent[has]
            both, alone, other, none = (c[has, up] for c in self._cells(label))
            fired = np.stack([own, own], 1)  # given that the parent did not fire, that it did
            fired[has, 1], fired[has, 0] = both / (both + other), alone / (alone + none)
            logs.append(np.log(np.stack([1 - fired, fired], 2).clip(1e-6, 1)))
        ratio = logs[1] - logs[0]  # [voter, parent's vote, own vote]
        m = len(ratio)
        self.bias = float(ratio[:, 0, 0].sum())
        self.linear = ratio[:, 0, 1] - ratio[:, 0, 0]
        has = np.flatnonzero(self.parent >= 0)
        np.add.at(self.linear, self.parent[has], (ratio[:, 1, 0] - ratio[:, 0, 0])[has])
        self.pair = np.zeros(m)
        self.pair[has] = (ratio[:, 1, 1] - ratio[:, 1, 0] - ratio[:, 0, 1] + ratio[:, 0, 0])[has]

    def posterior(self, votes: np.ndarray, annotator: np.ndarray | float = 0.0) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + annotator + self.bias + votes @ self.linear
        has = np.flatnonzero(self.parent >= 0)
        z = z + (votes[:, has] * votes[:, self.parent[has]]) @ self.pair[has]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with a quadratic penalty, by damped Newton steps; the
    bias is not penalised."""
    n, m = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    w, penalty = np.zeros(m + 1), np.full(m + 1, ridge)
    w[-1], penalty[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(h, g), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - after < 1e-6 * abs(now):
            break
        now = after
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, weights: dict[str, float], bias: float, label_model: LabelModel | None = None, voters: list[str] = ()):
        self.weights, self.bias, self.label_model, self.voters = weights, bias, label_model, voters
        self._known: dict[str, list[int]] = {}
        self._place = self._weight = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"label_model": None, "voters": [], "_known": {}, "_place": None, "_weight": None}

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The weighted features of some words in a row, as places among the weights, and how many each word has."""
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = [self._place[x] for x in features_of_word(w) if x in self._place]
        each = [known[w] for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text; each feature counts once a text."""
        if self._place is None:
            self._place, self._weight = {f: i for i, f in enumerate(self.weights)}, np.array([*self.weights.values(), 0.0])
        found = [WORD.findall(t) for t in texts]
        coded = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        size = max(1, len(coded.dictionary))
        doc, word = np.divmod(np.unique(doc * size + coded.indices.to_numpy()), size)
        feature, count = self._features(coded.dictionary.to_pylist())
        first, n = (np.cumsum(count) - count)[word], count[word]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        hit = np.unique(np.repeat(doc, n) * len(self._weight) + feature[at])
        doc, feature = np.divmod(hit, len(self._weight))
        z = self.bias + np.bincount(doc, self._weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_candidates: int = 4096, max_voters: int = 128, max_features: int = 256) -> Model:
    """Fit voters, label model and classifier on labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "toxic").collect()
    if not chosen:
        return Model({w: 3.0 for w in LEXICON}, -3.0)
    # At most max_rows pairs of numbers, so they can be broadcast.
    sample = spark.createDataFrame([(r["doc_id"], r["toxic"], i) for i, r in enumerate(chosen)], "doc_id long, toxic int, row long")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("row", "toxic", "text")
    seen = Workspace(spark, "toxicity").save(_features(texts), "features")
    toxic, n = (int(x or 0) for x in seen.agg(F.sum("toxic"), F.count("*")).first())
    if not toxic or toxic == n:
        return Model({}, float(np.log((toxic + 0.5) / (n - toxic + 0.5))) if n else 0.0)
    each = seen.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    counts = each.agg(F.sum("toxic").alias("t"), F.count("*").alias("f")).filter("f >= 4")
    # Log-likelihood ratio of a feature's counts among toxic and clean texts.
    cells = []
    for a, of, share in (("t", "f", toxic / n), ("f - t", "f", 1 - toxic / n), (f"{toxic} - t", f"{n} - f", toxic / n), (f"{n - toxic} - f + t", f"{n} - f", 1 - toxic / n)):
        cells.append(F.expr(f"CASE WHEN {a} > 0 THEN ({a}) * ln(({a}) / (({of}) * {share!r}D)) ELSE 0D END"))
    ratio = 2 * (cells[0] + cells[1] + cells[2] + cells[3])
    clear = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO)
    top = clear.orderBy(F.desc("ratio"), "feature").limit(max_candidates).collect()
    features = _apart([r["feature"] for r in top])[:max_features]
    firm = {r["feature"] for r in top if r["t"] * (n - toxic) > 3 * (r["f"] - r["t"]) * toxic}
    voters = list(dict.fromkeys([*LEXICON, *[f for f in features if f in firm][:max_voters]]))
    wanted = spark.sparkContext.broadcast({f: i for i, f in enumerate(dict.fromkeys([*voters, *features]))})

    arrow = pa.schema({"toxic": pa.int32(), "at": pa.list_(pa.int32())})

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(wanted.value))
        for batch in batches:
            column = batch.column(1)
            at = pc.index_in(column.flatten(), value_set=known)
            row = pc.list_parent_indices(column).to_numpy()
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            ends = np.searchsorted(row[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), at.drop_null())], schema=arrow)

    rows = seen.orderBy("row").select("toxic", "features").mapInArrow(narrow, "toxic int, at array<int>").collect()
    names = list(wanted.value)
    y = np.array([r["toxic"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    column = np.array([i for r in rows for i in r["at"]], np.int64)
    x = np.zeros((len(rows), len(names)), np.float32)
    x[row, column] = 1
    votes = x[:, : len(voters)]
    label_model = LabelModel(votes[:, votes.any(0)], y)
    used = [i for i, f in enumerate(names) if f in set(features) or x[:, i].sum() >= 4]
    w, b = fit_linear(x[:, used], label_model.labels)
    return Model({names[i]: float(v) for i, v in zip(used, w)}, b, label_model, voters)


def _apart(features: list[str]) -> list[str]:
    """Features in order, without those that begin like one before, or with which one before begins."""
    out, stems, begins = [], set(), set()
    for f in features:
        stem = f.rstrip("-")
        if stem not in begins and not any(stem[:k] in stems for k in range(1, len(stem) + 1)):
            out.append(f)
            stems.add(stem)
            begins.update(stem[:k] for k in range(1, len(stem) + 1))
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted added (columns of these names are replaced)."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    text = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in packing.chunks(batches, text, CHUNK_BYTES):
            scores = shared.value.scores([_text(t) for t in packing.text_bytes(chunk.column(text))])
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(scores, pa.float64())], names=[*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
