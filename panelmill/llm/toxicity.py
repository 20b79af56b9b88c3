"""Operator 5: toxicity by weak supervision.

1. A lexicon is mined from a bounded sample of labelled texts: words and word beginnings that occur in
   toxic texts far more often than in others. Its entries are dealt to ``LEXICONS`` lexicon voters; pattern
   voters add how many entries are hit, how densely, and in what style a text is written.
2. A generative label model joins them: a latent label, each voter's accuracy given the label and, for
   correlation, given one other voter too (a maximum spanning tree over the voters' conditional mutual
   information). It is fitted by EM to the vote patterns of *all* documents, of which there are at most
   2^voters, with the sample's labels as anchors.
3. A linear (logistic) classifier over lexicon hits and votes is trained on the model's posteriors of the
   sample and scores every document.

Labels come only from rows that the caller's condition lets through; scores see only text.
Defined cases: a null text counts as empty and scores as a text without hits; no labelled row, or labels of
one kind only: every score is that kind's smoothed share; repeated rows score alike; an empty table gives no rows; extra
columns of any name are ignored; a text of any length is scored whole, in one task's memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, own_name, small_batches, stash

#: The classifier's bounded sample: the labelled rows with the smallest id hashes.
SAMPLE_ROWS = 20_000
#: Lengths of word beginnings that the lexicon may hold beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Most different words on one beginning that an entry tells apart.
LEVELS = 4
#: Entries at most, the toxic texts that one must occur in, and the least share of toxic texts among its texts.
ENTRIES, LEAST_TEXTS, LEAST_SHARE = 400, 5, 0.8
#: Lexicon voters: entries of a (smoothed) share of ``SURE`` go to the first ones, others to the rest.
LEXICONS, SURE_LEXICONS, SURE = 7, 4, 0.95
EM_ROUNDS = 25

_CAPITALS = regex.compile(r"\p{Lu}").findall
_WORDS = regex.compile(r"\p{L}+").findall


def text_entries(text: str) -> set[str]:
    """What a text can match in the lexicon: its words, and ``beginning-k`` for a beginning that k or more of
    its different words share (several words on one stem tell more than one)."""
    words = set(_WORDS(text.lower()))
    shared = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) >= n)
    return words | {f"{b}-{k}" for b, times in shared.items() for k in range(1, min(times, LEVELS) + 1)}


def _count_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each entry, by label, summed within the task."""
    with_label, without = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        keys = list(with_label.keys() | without.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([with_label[k] for k in keys], pa.int64()), pa.array([without[k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
        with_label.clear()
        without.clear()
        return out

    for batch in small_batches(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (with_label if label else without).update(text_entries(text))
        if len(with_label) + len(without) > 300_000:
            yield rows()
    yield rows()


def mine_lexicon(sample: DataFrame) -> list[tuple[str, int]]:
    """Entries by falling weight of evidence, each with its voter; a longer entry goes where a beginning of it says as much."""
    counts = sample.select("text", "label").mapInArrow(_count_entries, "entry string, toxic long, clean long")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    best = counts.where((F.col("toxic") >= LEAST_TEXTS) & (share >= LEAST_SHARE)).orderBy(F.desc(F.col("toxic") * share * share), "entry").limit(4 * ENTRIES).collect()
    kept: list[tuple[str, int]] = []
    dealt = [0, 0]
    stems: dict[str, int] = {}
    for row in best:
        bare, _, level = row["entry"].partition("-")
        # needless: an entry that implies a stem at a level which is in already
        if not any(stems.get(bare[:n], LEVELS + 1) <= int(level or 1) for n in BEGINNINGS if n <= len(bare)):
            sure = row["toxic"] >= SURE * (row["toxic"] + row["clean"] + 1)
            voter = dealt[0] % SURE_LEXICONS if sure else SURE_LEXICONS + dealt[1] % (LEXICONS - SURE_LEXICONS)
            dealt[not sure] += 1
            kept.append((row["entry"], voter))
            if level:
                stems[bare] = min(int(level), stems.get(bare, LEVELS + 1))
    return kept[:ENTRIES]


class Voters:
    """Turns a text into lexicon hits and votes (1: toxic, 0: abstains)."""

    def __init__(self, lexicon: list[tuple[str, int]]):
        self.at = {e: i for i, (e, _) in enumerate(lexicon)}
        self.voter = [v for _, v in lexicon]
        self.stems = {e.partition("-")[0] for e, _ in lexicon if "-" in e}
        self.memo = Memo(32 << 20)
        self.names = [f"lexicon_{i}" for i in range(LEXICONS)] + ["two_hits", "three_entries", "dense", "shouting", "masked"]
        self.masked = regex.compile(r"\p{L}[*#@$%]{1,}\p{L}").search

    def _stems(self, word: str) -> tuple[str, ...]:
        """The lexicon's stems that a word begins with; itself first where it is an entry."""
        own = (word,) if word in self.at else ()
        return own + tuple(word[:n] + "-" for n in BEGINNINGS if word[:n] in self.stems and len(word) >= n)

    def read(self, text: str) -> tuple[list[int], int]:
        """Distinct lexicon hits and the votes as bits."""
        words = _WORDS(text.lower())
        self.memo.trim()
        memo, hits, stems, places = self.memo.known, set(), Counter(), 0
        for word in set(words):
            own = memo.get(word)
            if own is None:
                own = self._stems(word)
                self.memo.learn([(word, own)])
            for e in own:
                if e[-1] == "-":
                    stems[e] += 1
                else:
                    hits.add(self.at[e])
                    places += 1
        for stem, times in stems.items():
            reached = [self.at[e] for k in range(1, min(times, LEVELS) + 1) if (e := f"{stem}{k}") in self.at]
            hits.update(reached)
            places += times * bool(reached)
        votes = 0
        for h in hits:
            votes |= 1 << self.voter[h]
        upper = len(_CAPITALS(text))
        for i, yes in enumerate((places >= 2, len(hits) >= 3, places * 100 >= 2 * len(words) > 0, upper * 2 > len(text) > 0, self.masked(text) is not None)):
            votes |= bool(yes) << (LEXICONS + i)
        return sorted(hits), votes


class LabelModel:
    """Latent label and a tree of voters: P(label) and P(vote | label, the parent's vote)."""

    def __init__(self, n: int):
        self.n, self.prior, self.parent = n, 0.1, [-1] * n
        self.table = np.full((n, 2, 2), 0.5)  # voter, label, parent's vote -> P(vote = 1)

    def _tree(self, votes: np.ndarray, weight: np.ndarray) -> None:
        """Maximum spanning tree over conditional mutual information (Prim); weight: rows x labels."""
        info = np.zeros((self.n, self.n))
        total = weight.sum()
        for y in (0, 1):
            w = weight[:, y]
            if w.sum() <= 0:
                continue
            on = (votes * w[:, None]).sum(0) / w.sum()
            both = (votes * w[:, None]).T @ votes / w.sum()
            for a, b, joint in ((1, 1, both), (1, 0, on[:, None] - both), (0, 1, on[None, :] - both), (0, 0, 1 - on[:, None] - on[None, :] + both)):
                p = np.clip(joint, 1e-9, None)
                q = np.clip((on if a else 1 - on)[:, None] * (on if b else 1 - on)[None, :], 1e-9, None)
                info += w.sum() / total * p * np.log(p / q)
        inside, self.parent = {0}, [-1] * self.n
        while len(inside) < self.n:
            _, a, b = max((info[a, b], a, b) for a in inside for b in range(self.n) if b not in inside)
            self.parent[b] = a
            inside.add(b)

    def _estimate(self, votes: np.ndarray, weight: np.ndarray) -> None:
        self.prior = float((weight[:, 1].sum() + 1) / (weight.sum() + 2))
        for v in range(self.n):
            above = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes))
            for y in (0, 1):
                # smoothed towards the voter's rate given the label alone
                alone = ((weight[:, y] * votes[:, v]).sum() + 0.5) / (weight[:, y].sum() + 1)
                for a in (0, 1):
                    w = weight[:, y] * (above == a)
                    self.table[v, y, a] = ((w * votes[:, v]).sum() + 2 * alone) / (w.sum() + 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for v in range(self.n):
            above = votes[:, self.parent[v]].astype(int) if self.parent[v] >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = self.table[v, y, above]
                log[:, y] += np.where(votes[:, v] > 0, np.log(p), np.log1p(-p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def fit(self, votes: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray) -> None:
        """votes: distinct patterns; unlabelled: rows of each; labelled: (patterns, 2), rows by label."""
        self._tree(votes, labelled + 1e-6)
        self._estimate(votes, labelled)
        for _ in range(EM_ROUNDS):
            p = self.posterior(votes)
            soft = unlabelled[:, None] * np.stack([1 - p, p], 1)
            # anchors: the labels weigh as much as the rest together
            anchor = labelled * max(1.0, unlabelled.sum() / max(labelled.sum(), 1))
            self._estimate(votes, soft + anchor)


def _bits(patterns: np.ndarray, n: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(n) & 1).astype(float)


class Classifier:
    """Logistic regression over lexicon hits, their number, and votes; ridge-penalised, Newton's method."""

    def __init__(self, n_entries: int, n_voters: int):
        self.n_entries, self.n_voters = n_entries, n_voters
        self.weights = np.zeros(n_entries + n_voters + 2)

    def design(self, hits: list[list[int]], votes: np.ndarray) -> np.ndarray:
        x = np.zeros((len(hits), len(self.weights)))
        for i, h in enumerate(hits):
            x[i, h] = 1
        x[:, self.n_entries : -2] = _bits(votes, self.n_voters)
        x[:, -2] = np.minimum([len(h) for h in hits], 5)
        x[:, -1] = 1
        return x

    def fit(self, x: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> None:
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        w = np.zeros(x.shape[1])
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - target) + penalty * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _read_all(df: DataFrame, lexicon: list[tuple[str, int]], *ids: str) -> DataFrame:
    """ids, hits and votes of each row's whole text."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)
    kept = df.select(*ids, "text")
    head = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(sent.value)
        for batch in small_batches(batches):
            read = [voters.read(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ids] + [pa.array([h for h, _ in read], pa.list_(pa.int32())), pa.array([v for _, v in read], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*ids, "hits", "votes"])

    return kept.mapInArrow(run, f"{head}, hits array<int>, votes int")


def score(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, score (0 to 1). ``trains``, over the id, says which labels may be learnt from."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = labels.where(trains & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS narrow rows are broadcast, so the texts stay where they are; one of equal texts counts
    sample = stash(texts.join(F.broadcast(chosen), id_col).dropDuplicates(["text"]).limit(SAMPLE_ROWS), "sample")
    lexicon = mine_lexicon(sample)
    everything = stash(_read_all(texts, lexicon, id_col), "votes")
    learnt = _read_all(sample, lexicon, "label").toPandas()

    voters = Voters(lexicon)
    n = len(voters.names)
    counts = everything.groupBy("votes").count().toPandas()  # at most 2^n rows
    labelled = pd.crosstab(learnt["votes"], learnt["label"]).reindex(columns=[0, 1], fill_value=0)
    patterns = np.array(sorted({*counts["votes"], *learnt["votes"]}), np.int64)
    by_pattern = counts.set_index("votes")["count"].reindex(patterns, fill_value=0).to_numpy(float)
    by_label = labelled.reindex(patterns, fill_value=0).to_numpy(float)
    classifier = Classifier(len(lexicon), n)
    if len(patterns) and by_label.sum(0).min() > 0:
        model = LabelModel(n)
        model.fit(_bits(patterns, n), by_pattern, by_label)
        hits = [list(h) for h in learnt["hits"]]
        x = classifier.design(hits, learnt["votes"].to_numpy(np.int64))
        classifier.fit(x, model.posterior(_bits(learnt["votes"].to_numpy(np.int64), n)))
    else:
        share = (by_label[:, 1].sum() + 1) / (by_label.sum() + 2) if len(patterns) else 0.5
        classifier.weights[-1] = np.log(share / (1 - share))
    sent = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                x = sent.value.design(part.column("hits").to_pylist(), part.column("votes").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sent.value.score(x))], [id_col, "score"])

    return everything.mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, score double")
