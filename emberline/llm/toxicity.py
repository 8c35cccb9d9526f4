"""Toxicity by weak supervision: voters, a generative label model, a linear classifier (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let, text_of, words_of, written

#: Labelled rows that lexicons are learnt from, and further rows that the classifier is trained on, at most (by hash order).
LABELLED_ROWS, TRAINING_ROWS = 20_000, 20_000
#: Words and word beginnings in the learnt lexicons at most, documents that one must be in, the least log-odds, and evidence beyond chance.
LEXICON, LEAST_DOCS, LEAST_ODDS, LEAST_GAIN = 600, 3, 2.0, 6.0
#: Letters of a word beginning, voters per learnt lexicon, features of the classifier, rounds of the label model.
STEM, GROUPS, FEATURES, ROUNDS = 5, 3, 1 << 15, 40

# Insults by language.
SEED_EN = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb fool jerk garbage filth hate kill".split()
SEED_OTHER = "idiota estúpido imbécil basura asqueroso patético payaso tonto escoria idiote stupide imbécile ordure dégoûtant pathétique crétin clochard minable dumm idiot dummkopf trottel abschaum müll wertlos erbärmlich ekelhaft versager".split()


def features_of(text: Column) -> Column:
    """The distinct words of a text, and the distinct beginnings of its longer words, marked with ^."""
    stems = lambda words: F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.substr(w, F.lit(1), F.lit(STEM)))))
    return let(F.array_distinct(words_of(text)), lambda words: F.concat(words, stems(words)))


def trains(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def bounded(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, toxic): training labels, at most `rows`, the first by hash; an id's labels as their maximum."""
    kept = labels.where(trains(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def lexicon(docs: DataFrame, labels: DataFrame) -> list[tuple[str, float]]:
    """Words and beginnings that go with toxic labels, best first: (feature, log-odds)."""
    seen = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("toxic", F.explode(features_of(text_of())).alias("f"))
    totals = labels.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, n = totals.p or 0, (totals.n or 0) - (totals.p or 0)
    if not p or not n:
        return []
    counted = seen.groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(f"p >= {LEAST_DOCS}")
    odds = F.log((F.col("p") + 0.5) / (p + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (n + 1.0))
    # twice the log-likelihood ratio against the base rate; the more candidates there are, the more one must show
    share = p / (p + n)
    clean = F.col("n") - F.col("p")
    gain = 2 * (F.col("p") * F.log(F.col("p") / F.col("n") / share) + F.when(clean > 0, clean * F.log(clean / F.col("n") / (1 - share))).otherwise(0.0))
    best = written(counted.select("f", odds.alias("odds"), gain.alias("gain")).where(F.col("odds") > 0))
    least = 2 * log(max(best.count(), 1)) + LEAST_GAIN
    best = best.where((F.col("odds") >= LEAST_ODDS) & (F.col("gain") >= least))
    return [(r.f, r.odds) for r in best.orderBy(F.desc("gain"), "f").limit(LEXICON).collect()]


def voters(f: Column, text: Column, learnt: list[tuple[str, float]]) -> dict[str, Column]:
    """Name -> whether the voter fires. Lexicon voters, patterns, and one that speaks for clean texts."""

    def has(words: list[str]) -> Column:
        return F.arrays_overlap(f, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)

    words = [w for w, _ in learnt if not w.startswith("^")]
    stems = [w for w, _ in learnt if w.startswith("^")]
    every = [w for w, _ in learnt] + SEED_EN + SEED_OTHER
    hits = F.size(F.array_intersect(f, F.array(*[F.lit(w) for w in dict.fromkeys(every)])))
    out = {"seed_en": has(SEED_EN), "seed_other": has(SEED_OTHER)}
    out |= {f"words_{g}": has(words[g::GROUPS]) for g in range(GROUPS)}
    out |= {f"stems_{g}": has(stems[g::GROUPS]) for g in range(GROUPS)}
    out |= {
        "two": hits >= 2,
        "dense": hits * 50 >= F.size(f),
        "shouting": (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 2 > F.length(text)),
        "marks": text.rlike(r"!!|\?\?"),
        "calm": (hits == 0) & (F.size(f) >= 20),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


@dataclass
class LabelModel:
    """Of voters that fire or don't: the share of toxic texts and, for each voter, how likely it fires for either class
    given what its parent did. Parents are the correlations: a tree over the strongest dependences that remain when the class is known."""

    prior: float
    parent: list[int]
    fires: np.ndarray  # voter, class, what the parent did
    gold: np.ndarray  # class, label: how reliable given labels are

    @staticmethod
    def fit(votes: np.ndarray, label: np.ndarray, n: np.ndarray, stance: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """votes: pattern x voter; label: -1, 0 or 1; n: how many texts. stance: whether a voter speaks for the class (1), against it (-1) or neither (0) at first."""
        m = votes.shape[1]
        fires = np.empty((m, 2, 2))
        fires[:, 1] = np.choose(stance + 1, [0.2, 0.2, 0.5])[:, None]
        fires[:, 0] = np.choose(stance + 1, [0.6, 0.2, 0.03])[:, None]
        model = LabelModel(0.1, [-1] * m, fires, np.array([[0.97, 0.03], [0.1, 0.9]]))
        for r in range(rounds):
            q = model.posterior(votes, label)
            if r == rounds // 2:
                model.parent = _tree(votes, n, q)
            w = np.stack([n * (1 - q), n * q])
            model.prior = float(np.clip((w[1].sum() + 1) / (n.sum() + 10), 0.005, 0.5))
            for j in range(m):
                on = votes[:, model.parent[j]] if model.parent[j] >= 0 else np.zeros(len(votes), bool)
                for y in (0, 1):
                    base = (w[y] @ votes[:, j] + 0.5) / (w[y].sum() + 1)
                    for z in (0, 1):
                        at = w[y] * (on == z)
                        model.fires[j, y, z] = np.clip((at @ votes[:, j] + 5 * base) / (at.sum() + 5), 1e-4, 1 - 1e-4)
            for y in (0, 1):
                for z in (0, 1):
                    model.gold[y, z] = (w[y] @ (label == z) + (9 if y == z else 1)) / (w[y] @ (label >= 0) + 10)
        return model

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The probability of the toxic class by votes and, where given, the label."""
        ll = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, parent in enumerate(self.parent):
            on = votes[:, parent].astype(int) if parent >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = self.fires[j, y, on]
                ll[:, y] += np.log(np.where(votes[:, j], p, 1 - p))
        for y in (0, 1):
            ll[:, y] += np.where(label >= 0, np.log(self.gold[y, np.maximum(label, 0)]), 0)
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))


def _tree(votes: np.ndarray, n: np.ndarray, q: np.ndarray, least: float = 0.002) -> list[int]:
    """Parents by a maximum spanning forest over the conditional mutual information of voters given the class."""
    m = votes.shape[1]
    total, info = n.sum(), np.zeros((m, m))
    for y in (0, 1):
        w = n * (q if y else 1 - q)
        s = w.sum() + 1e-9
        for a in range(m):
            for b in range(a):
                for va in (0, 1):
                    for vb in (0, 1):
                        pa, pb = w @ (votes[:, a] == va) / s, w @ (votes[:, b] == vb) / s
                        pab = w @ ((votes[:, a] == va) & (votes[:, b] == vb)) / s
                        if pab > 0:
                            info[a, b] += s / total * pab * np.log(pab / (pa * pb))
    parent, root = [-1] * m, [*range(m)]
    edges = sorted(((info[a, b], a, b) for a in range(m) for b in range(a) if info[a, b] > least), reverse=True)
    near: dict[int, list[int]] = {j: [] for j in range(m)}
    for _, a, b in edges:
        if root[a] != root[b]:
            old, new = root[a], root[b]
            root = [new if x == old else x for x in root]
            near[a].append(b)
            near[b].append(a)
    seen: set[int] = set()
    for start in range(m):
        queue = [] if start in seen else [start]
        seen.add(start)
        while queue:
            j = queue.pop()
            for k in near[j]:
                if k not in seen:
                    seen.add(k)
                    parent[k] = j
                    queue.append(k)
    return parent


@dataclass
class Scorer:
    learnt: list[tuple[str, float]]
    names: list[str]
    label_model: LabelModel
    classifier: LogisticRegressionModel | None

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score (0 to 1) and predicted (1 if score >= 0.5). Only the text enters a score; null counts as empty. Other
        columns are carried along; one that is named score or predicted gives way to the new one."""
        docs = docs.drop("score", "predicted")
        rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), features_of(text_of()).alias("_f"))
        if self.classifier is None:
            scored = rows.withColumn("_score", F.lit(float(self.label_model.prior)))
        else:
            tf = HashingTF(numFeatures=FEATURES, inputCol="_f", outputCol="_v", binary=True)
            model = self.classifier.setFeaturesCol("_v").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
            scored = model.transform(tf.transform(rows)).withColumn("_score", vector_to_array("_p")[1])
        return scored.select("_row.*", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic), labels of rows with crc32(doc_id) mod 5 <> 0 only.

    Lexicons are learnt from at most LABELLED_ROWS labelled rows. Voters vote on all rows; the patterns of votes, of which
    there are 2^voters at most whatever the input, are counted with the labels of that sample, and the label model is
    fitted to the counts. Its posteriors label at most about TRAINING_ROWS + LABELLED_ROWS rows for the classifier. Null and empty texts vote
    like texts without words; rows without an id are not learnt from. With no labels or no texts, scores are the prior.
    """
    spark = docs.sparkSession
    sample = written(bounded(labels))
    learnt = lexicon(docs, sample)
    named = voters(F.col("f"), F.col("text"), learnt)
    bits = sum((F.shiftleft(v.cast("int"), i) for i, v in enumerate(named.values())), F.lit(0))
    rows = docs.select("doc_id", text_of().alias("text")).where(trains(F.col("doc_id"))).join(F.broadcast(sample), "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.lit(-1)).alias("label"))

    def voted(some: DataFrame) -> DataFrame:
        return some.select("label", "text", features_of(F.col("text")).alias("f")).select("label", "f", bits.alias("votes"))

    counted = voted(rows).groupBy("votes", "label").agg(F.count("*").alias("n")).orderBy("votes", "label").toPandas()
    names = list(named)
    if not len(counted):
        return Scorer(learnt, names, LabelModel(0.1, [], np.empty((0, 2, 2)), np.ones((2, 2))), None)
    votes = (counted["votes"].to_numpy()[:, None] >> np.arange(len(names)) & 1).astype(bool)
    label, n = counted["label"].to_numpy(), counted["n"].to_numpy(float)
    model = LabelModel.fit(votes, label, n, np.array([{"calm": -1, "shouting": 0, "marks": 0}.get(x, 1) for x in names]))
    q = model.posterior(votes, label)
    posterior = spark.createDataFrame([(int(v), int(y), float(p)) for v, y, p in zip(counted["votes"], label, q)], "votes int, label int, q double")
    share = TRAINING_ROWS / n.sum()
    bound = int(min(1.0, share) * (1 << 63)) - 1
    chosen = rows.where((F.col("label") >= 0) | (F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 63) - 1)) <= bound))
    posts = voted(chosen).join(F.broadcast(posterior), ["votes", "label"])
    tf = HashingTF(numFeatures=FEATURES, inputCol="f", outputCol="features", binary=True)
    both = written(posts.select("f", F.explode(F.array(F.struct(F.lit(0.0).alias("y"), (1 - F.col("q")).alias("w")), F.struct(F.lit(1.0).alias("y"), F.col("q").alias("w")))).alias("x")).select("f", "x.*").where("w > 0.001"))
    if both.select("y").distinct().count() < 2:
        return Scorer(learnt, names, model, None)
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=60, regParam=2e-4, standardization=False, aggregationDepth=2)
    return Scorer(learnt, names, model, lr.fit(tf.transform(both).select("features", "y", "w")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the fitted scorer predicts to be toxic."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"))
    return fit(docs, labels).score(rows).where("predicted = 0").select("_doc.*")
