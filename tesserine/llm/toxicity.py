"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import bitmap, bits_of, keyed, row_key, settle, table

# Fixed value: insults that the lexicon voters start from.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser")
#: Lexicon entries are dealt to this many voters; with the pattern voters the label model sees at most
#: 2**(VOTERS + len(PATTERNS)) different rows, however many documents and entries there are.
VOTERS = 11
PATTERNS = ("two_entries", "three_hits", "dense", "shouted", "none")
#: A stem counts in a document with two different words of it at least, and one in so many characters.
STEM_CHARS = 520
STEM_LENGTHS = (3, 4, 5, 6, 7)
#: Labelled toxic texts that must hold an entry, and the share of its texts that must be toxic.
SUPPORT, PRECISION = 5, 0.85
#: Entries that a task holds before it sends them on, and slots by which labelled documents are picked.
HELD, SLOTS = 500_000, 1 << 22
#: Labelled rows that the classifier is fitted on, about (default of a parameter).
FIT_SAMPLE = 20_000

_WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...]
    stems: tuple[str, ...]

    @property
    def entries(self) -> list[tuple[str, bool]]:
        return [(w, False) for w in self.words] + [(s, True) for s in self.stems]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """One label a document (toxic if any row says so), without the held-out ones."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def entry_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), known(doc_id, toxic) -> entry, stem, bad, n: of the different labelled texts, how
    many toxic ones and how many in all hold an entry. Tasks add up their own texts before anything is sent."""
    k1, k2 = row_key("doc_id", "text")
    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    # one row of each different labelled text, by keys alone; joins are of one kind at every size
    names = usable.select("doc_id", "k1", "k2", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("lexicon"), "text").alias("t2")).join(known.hint("merge"), "doc_id")
    picked = names.groupBy("t1", "t2").agg(F.min(F.struct("k1", "k2")).alias("k"), F.max("toxic").cast("long").alias("toxic"))
    picked = settle(picked.select("k.k1", "k.k2", "toxic"), "toxicity-picked")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(picked.select(F.col("k1").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")), SLOTS))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Most other texts stay where they are; the join drops the rest."""
        bits = bits_of(wanted.value)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(0).to_numpy() & (SLOTS - 1)]))

    texts = usable.select("k1", "k2", "text").mapInArrow(labelled, "k1 long, k2 long, text string")
    texts = texts.join(picked.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[int]] = {}

        def sent() -> pa.RecordBatch:
            cols = [pa.array([e for e, _ in held]), pa.array([s for _, s in held], pa.bool_()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["entry", "stem", "bad", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in entries_of(text.lower()):
                    own = held.setdefault(entry, [0, 0])
                    own[0] += toxic
                    own[1] += 1
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    return texts.select("text", "toxic").mapInArrow(count, "entry string, stem boolean, bad long, n long")


def entries_of(text: str) -> list[tuple[str, bool]]:
    """What a text in lower case holds: its words, and the stems that are dense in it."""
    words = Counter(_WORD.findall(text))
    total, kinds = Counter(), Counter()
    for word, n in words.items():
        for k in STEM_LENGTHS:
            if len(word) >= k:
                total[word[:k]] += n
                kinds[word[:k]] += 1
    return [(w, False) for w in words] + [(e, True) for e, k in kinds.items() if k >= 2 and total[e] * STEM_CHARS >= len(text)]


def induce_lexicon(docs: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS, support: int = SUPPORT, precision: float = PRECISION) -> Lexicon:
    """The seeds, and words and stems that labelled toxic documents hold and others hardly do.

    Counted in Spark over all labelled rows that aren't held out; equal texts count once. A word counts
    where it occurs, a stem where it is dense (STEM_CHARS). Entries that `support` toxic texts hold, with one
    clean text more than was seen at `precision` or better, are taken, whatever share of the toxic texts
    that is; of entries that extend one another only the most frequent is. The list grows with the
    vocabulary of toxic texts, not with the number of documents.
    """
    counts = entry_counts(docs, _known(labels)).groupBy("entry", "stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    found = counts.filter((F.col("bad") >= support) & (F.col("bad") >= precision * (F.col("n") + 1))).orderBy(F.desc("bad"), "stem", F.desc(F.length("entry")), "entry").collect()
    taken: list[tuple[str, bool]] = [(w, False) for w in seeds]
    whole, begun = set(seeds), {w[:i] for w in seeds for i in range(1, len(w) + 1)}
    for r in found:
        e = r["entry"]
        if e not in begun and not any(e[:i] in whole for i in range(1, len(e) + 1)):
            taken.append((e, r["stem"]))
            whole.add(e)
            begun |= {e[:i] for i in range(1, len(e) + 1)}
    return Lexicon(tuple(e for e, stem in taken if not stem), tuple(e for e, stem in taken if stem))


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, k1, k2 (row key), f (array of double: what the linear classifier sees), votes (bits)."""
    k1, k2 = row_key("doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_length = {n: [s for s in lexicon.stems if len(s) == n] for n in sorted({len(s) for s in lexicon.stems})}

    def stem_of(h: Column) -> Column:
        """The entry that a word begins with, null if none; entries don't extend one another."""
        return F.coalesce(F.lit(None).cast("string"), *[F.when(F.substring(h, 1, n).isin(own), F.substring(h, 1, n)) for n, own in by_length.items()])

    least = min([3, *(len(w) for w in lexicon.words)])
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    hits = F.filter(words, lambda h: h.isin(list(lexicon.words)) | stem_of(h).isNotNull())
    seen = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), hits.alias("hits"), F.greatest(F.length(text), F.lit(1)).alias("chars"), text.rlike(r"!{2,}|\?!|!\?").alias("loud"))
    plain = lambda h: h.isin(list(lexicon.words))
    seen = seen.withColumn("w", F.filter("hits", plain)).withColumn("s", F.filter("hits", lambda h: ~plain(h)))
    kinds, stem_kinds = F.size(F.array_distinct("w")), F.size(F.array_distinct("s"))
    dense = (F.size("s") * STEM_CHARS >= F.col("chars")) & (stem_kinds >= 2)
    seen = seen.withColumn("found", F.concat(F.array_distinct("w"), F.when(dense, F.array_distinct(F.transform("s", stem_of))).otherwise(F.array().cast("array<string>"))))
    dealt = [[e for e, _ in lexicon.entries][i::VOTERS] for i in range(VOTERS)]
    lists = [F.exists("found", _among(own)) if own else F.lit(False) for own in dealt]
    n = F.size("w") + F.when(dense, F.size("s")).otherwise(0)
    patterns = [kinds + F.when(dense, stem_kinds).otherwise(0) >= 2, n >= 3, n * STEM_CHARS >= F.col("chars"), F.col("loud"), n == 0]
    votes = sum((F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate([*lists, *patterns])), F.lit(0)).cast("long")
    rate = lambda x: F.log1p(x * 1000.0 / F.greatest(F.col("chars"), F.lit(100)))
    values = [F.log1p(F.size("w")), F.log1p(kinds), rate(F.size("w")), F.log1p(F.size("s")), F.log1p(stem_kinds), rate(F.size("s")), dense, F.size("w") > 0, F.col("loud")]
    return seen.select("doc_id", "k1", "k2", F.array(*[v.cast("double") for v in values]).alias("f"), votes.alias("votes"))


def _among(own: list[str]) -> Callable[[Column], Column]:
    return lambda entry: entry.isin(own)


@dataclass
class LabelModel:
    """P(toxic | votes): prior, each voter's rate of firing by class, and weights that share out what
    correlated voters say alike."""

    prior: float
    rates: np.ndarray  # 2 x voters
    weights: np.ndarray

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + (np.where(fires, on, off) * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(fires: np.ndarray, n: np.ndarray, labelled: np.ndarray, start: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over the different rows of votes.

    fires: rows x voters; n: documents without a label with these votes; labelled: rows x 2, documents
    known to be clean and toxic. start: first guess of P(toxic) for each row. After each round the
    voters' correlation within the classes is measured, and a voter that repeats others counts less.
    """
    total = max(float(n.sum() + labelled.sum()), 1.0)
    p = start.copy()
    model = LabelModel(0.5, np.full((2, fires.shape[1]), 0.5), np.ones(fires.shape[1]))
    if not len(fires):
        return model
    for _ in range(rounds):
        bad, good = n * p + labelled[:, 1], n * (1 - p) + labelled[:, 0]
        prior = float(np.clip(bad.sum() / total, 1e-4, 0.5))
        rates = np.stack([((m[:, None] * fires).sum(axis=0) + 0.5) / (m.sum() + 1.0) for m in (good, bad)])
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        alike = np.zeros((fires.shape[1],) * 2)
        for m, rate in ((good, rates[0]), (bad, rates[1])):
            off = fires - rate
            cov = (off * m[:, None]).T @ off / max(m.sum(), 1.0)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            alike += np.clip(cov / scale[:, None] / scale[None, :], 0, 1) / 2
        weights = 1 / np.maximum(alike.sum(axis=1), 1.0)
        model = LabelModel(prior, rates, weights)
        new = model.posterior(fires)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Newton's method: weights (the last is the bias), mean, scale. Row i counts n[i] times."""
    n = np.ones(len(x)) if n is None else n
    mean = np.average(x, axis=0, weights=n)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    keep = np.r_[np.full(x.shape[1], ridge * n.sum()), 1e-9]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(keep), z.T @ (n * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def score_rows(docs: DataFrame, labels: DataFrame, fit_sample: int = FIT_SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic) -> doc_id, k1, k2 (row key), held_out, score,
    predicted; one row a row of docs.

    Words and the label model's priors are learned from labels of documents that aren't held out; the
    label model also sees the votes on all other documents. The classifier is fitted to the posteriors of
    about `fit_sample` labelled rows (all, if they are fewer), picked by a hash of the row and counted by what is seen of them,
    so that a row repeated a million times comes to the driver once. Null or empty
    text scores as a text without any word. Without labels the seeds alone vote, and rows without a
    label are picked. The text is read twice (lexicon, votes); what follows reads a slim table.
    """
    lexicon = induce_lexicon(docs, labels)
    slim = settle(features(docs, lexicon), "toxicity-votes")
    known = settle(_known(labels), "toxicity-known")
    rows = slim.join(known, "doc_id", "left").groupBy("votes").agg(
        F.count(F.when(F.col("toxic").isNull(), 1)).alias("n"), F.count(F.when(F.col("toxic") == 0, 1)).alias("good"), F.count(F.when(F.col("toxic") > 0, 1)).alias("bad")
    ).collect()  # at most 2**voters rows
    voters = VOTERS + len(PATTERNS)
    votes = np.array([r["votes"] for r in rows], np.int64)
    fires = ((votes[:, None] >> np.arange(voters)) & 1).astype(float).reshape(-1, voters)
    start = np.where(fires[:, :VOTERS].any(axis=1), 0.9, 0.02)
    counts = np.array([[r["n"], r["good"], r["bad"]] for r in rows], float).reshape(-1, 3)
    model = fit_label_model(fires, counts[:, 0], counts[:, 1:], start)
    labelled = int(counts[:, 1:].sum())
    pool = slim.join(known, "doc_id", "left_semi") if labelled else slim.filter(~held_out(F.col("doc_id")))
    share = min(1.0, fit_sample / max(labelled or int(counts[:, 0].sum()), 1))
    picked = pool.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).groupBy("f", "votes").agg(F.count(F.lit(1)).alias("n"))
    picked = picked.orderBy("votes", "f").collect()  # rows that are alike, repeated ones included, are one row with a weight
    linear = F.lit(0.0)
    if picked:
        x = np.array([r["f"] for r in picked], float)
        bits = ((np.array([r["votes"] for r in picked], np.int64)[:, None] >> np.arange(voters)) & 1).astype(float)
        w, mean, scale = fit_linear(x, model.posterior(bits), np.array([r["n"] for r in picked], float))
        slope = w[:-1] / scale
        linear = F.lit(float(w[-1] - (slope * mean).sum()))
        for i, s in enumerate(slope.tolist()):
            linear = linear + F.col("f")[i] * F.lit(s)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
    return slim.select("doc_id", "k1", "k2", held_out(F.col("doc_id")).alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_rows without the row key."""
    return score_rows(docs, labels).drop("k1", "k2")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted to be toxic. Repeated rows share one verdict; rows with
    equal (or null) doc_id and different texts have their own. Same columns, whatever their names."""
    bad = score_rows(docs, labels).filter("predicted = 1").select("k1", "k2").distinct()
    return keyed(docs).join(bad, ["k1", "k2"], "left_anti").select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
