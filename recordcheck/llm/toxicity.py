"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon, second-person words near its hits, capitals, punctuation and
obfuscated spellings. Learning uses a bounded sample of labelled rows; scoring covers every whole text, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize, table

#: Labelled rows to learn from (expected number; a hash of doc_id chooses), and terms of the learned lexicon.
SAMPLE_ROWS, LEXICON_TERMS = 20_000, 400
#: Share of the toxic sample rows that a learned term must occur in, the least number, and its least log odds.
TERM_SHARE, TERM_ROWS, TERM_ODDS = 0.01, 5, 1.5
PREFIXES = (4, 5)
#: Score from which predicted is 1.
THRESHOLD = 0.3

SEED_LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown imbecile fool "
    "ugly hate jerk creep pig vermin freak filth filthy liar coward kill die shut "
    "idiota estúpido estúpida imbécil basura asqueroso asco payaso inútil tonto escoria patético "
    "idiote stupide imbécile ordure dégoûtant nul minable crétin abruti pathétique racaille "
    "dumm dummkopf trottel abschaum müll ekelhaft wertlos versager erbärmlich clown".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tú tu tus te ti usted ustedes vosotros toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer".split())
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
WORD = re.compile(r"[^\W\d_]+")
#: A letter, then digits or signs inside the word, then another letter.
OBFUSCATED = re.compile(r"(?<!\S)[^\s\d@]?\S*?[^\W\d_][\d@$!|+*._-]+[^\W\d_]\S*")
NEAR = 5
FEATURES = (
    "log_words", "seed_hits", "seed_density", "term_hits", "term_density", "odds_sum", "odds_density", "odds_max", "hidden_hits", "hidden_rate",
    "second_near", "second_density", "capitals", "capital_words", "punctuation", "exclamations", "digits", "beyond_ascii", "repeats",
)

CLASSES = np.zeros((256, 5))
CLASSES[ord("A") : ord("Z") + 1, 0] = 1
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()], 1] = 1
CLASSES[[ord("!"), ord("?")], 2] = 1
CLASSES[ord("0") : ord("9") + 1, 3] = 1
CLASSES[0xC0:, 4] = 1


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Lexicon:
    """Fixed and learned terms; a learned term that ends in * matches words that begin so."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.heads = frozenset(t.rstrip("*")[:4] for t in (*odds, *SEED_LEXICON))

    def weight(self, word: str) -> float:
        """The largest log odds of a matching learned term, at least a tenth for fixed ones, else 0."""
        if word[:4] not in self.heads:
            return 0.0
        return max([self.odds.get(t, 0.0) for t in terms_of(word)] + [0.1] * (word in SEED_LEXICON))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text; those of null and empty texts are zeros."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    seed, found, where = 0, [], []
    heads = lexicon.heads
    for i, w in enumerate(words):
        if w[:4] in heads and (weight := lexicon.weight(w)):
            seed += w in SEED_LEXICON
            where.append(i)
            found.append(weight)
    hidden = tokens = 0
    for m in OBFUSCATED.findall(text.lower()):
        tokens += 1
        hidden += lexicon.weight("".join(WORD.findall(m.rstrip(".,;:!?|+*-_").translate(LEET)))) > 0
    you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    hits = np.array(where, np.int64)
    near = int((np.searchsorted(you, hits + NEAR, "right") > np.searchsorted(you, hits - NEAR, "left")).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = len(raw)
    caps, punct, excl, digits, beyond = np.bincount(raw, minlength=256) @ CLASSES / size
    total = sum(found)
    shout = sum(w.isupper() and len(w) > 1 for w in text.split()) / n
    return [
        float(np.log1p(len(words))), seed, seed / n, len(found), len(found) / n, total, total / n, max(found, default=0.0), hidden, tokens / n,
        near / max(1, len(where)), len(you) / n, caps, shout, punct, excl, digits, beyond, 1 - len(set(words)) / n,
    ]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            counts[label].update({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)})
    names = list(counts[0] | counts[1])
    for k in range(0, len(names), 1 << 16):
        part = names[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[t] for t in part], pa.int64()) for c in counts)], names=["term", "clean", "toxic"])


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_TERMS) -> dict[str, float]:
    """Log odds of the words and word beginnings that mark toxic rows of (text, label); at most `limit` reach the driver."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.select("text", "label").coalesce(8).mapInArrow(_term_counts, "term string, clean bigint, toxic bigint")
    sums = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    kept = sums.filter(F.col("toxic") >= max(TERM_ROWS, TERM_SHARE * toxic)).withColumn("odds", odds).filter(F.col("odds") >= TERM_ODDS)
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(limit).collect()}


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, on histogram bins, with isotonic calibration."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []
        self.knots = (np.array([0.0]), np.array([0.0]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Rare features have most mass at one value: cut their other values apart as well.
        cuts = [np.unique(np.concatenate([q, np.quantile(c[c > c.min()], np.linspace(0, 1, 17))])) if (c > c.min()).any() else q for q, c in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        width = max(len(q) for q in cuts) + 1
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                count, first = 1 << level, (1 << level) - 1
                best = np.full(count, 1e-9)
                choice = [(0, -1)] * count
                for f in range(x.shape[1]):
                    key = node * width + binned[:, f]
                    g, h, n = (np.bincount(key, w, count * width).reshape(count, width).cumsum(1) for w in (grad, hess, None))
                    gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                    gain = g * g / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt * gt / (ht + 1)
                    gain[(n < self.least) | (nt - n < self.least)] = 0
                    at = gain.argmax(1)
                    for k in range(count):
                        if gain[k, at[k]] > best[k] and at[k] < len(cuts[f]):
                            best[k], choice[k] = gain[k, at[k]], (f, at[k])
                for k, (f, c) in enumerate(choice):
                    if c >= 0:
                        feature[first + k], threshold[first + k] = f, cuts[f][c]
                f, t = feature[first + node], threshold[first + node]
                node = node * 2 + (x[np.arange(len(x)), f] > t)
            g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
            leaf = self.rate * g / (h + 1)
            raw += leaf[node]
            self.trees.append((feature, threshold, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.knots = isotonic(self.raw(x), y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a fiftieth of the plain ones keeps the order within the steps."""
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to y by pooling adjacent violators; ties in score are pooled first."""
    values, back = np.unique(score, return_inverse=True)
    sums, sizes = np.bincount(back, y), np.bincount(back).astype(float)
    blocks: list[list[float]] = []  # sum, size, first, last
    for s, n, v in zip(sums, sizes, values):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, last = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    return np.array([b[k] for b in blocks for k in (2, 3)]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label"), b.column("fold")], names=["x", "label", "fold"])

    return run


def _held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, Boosted | float]:
    """(lexicon, model) from labelled documents that are not held out.

    labels has (doc_id, toxic); null labels are passed over, of several for one id the largest counts. About `rows` rows are
    used, chosen by a hash of the id, four fifths for the trees and one for calibration. With no rows, or of one class only,
    the model is a constant: the share of toxic rows, 0 if there are none.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label")).filter(~_held_out("doc_id"))
    known = materialize(known, "toxicity-labels")
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # at most about `rows` narrow rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.xxhash64("text")), F.lit(5)).cast("int")  # copies fall into one fold
    sample = texts.join(F.broadcast(drawn), "doc_id").select("text", "label", F.coalesce(fold, F.lit(0)).alias("fold"))
    sample = materialize(sample, "toxicity-sample")
    lexicon = Lexicon(learn_lexicon(sample.filter("fold <> 0")))  # its densities must be as new to the calibration rows as to others
    got = sample.mapInArrow(_feature_rows(lexicon), "x array<double>, label int, fold int").toPandas()
    if got["label"].nunique() < 2:
        return lexicon, float(got["label"].mean()) if len(got) else 0.0
    x, y, fit = np.array(got["x"].tolist()), got["label"].to_numpy(float), (got["fold"] != 0).to_numpy()
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[~fit])) < 2:
        fit[:] = True
        return lexicon, Boosted().fit(x, y).calibrate(x, y)
    return lexicon, Boosted().fit(x[fit], y[fit]).calibrate(x[~fit], y[~fit])


def _score(lexicon: Lexicon, model: Boosted | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            scores = np.empty(len(texts))
            for k in range(0, len(texts), 1024):
                part = texts[k : k + 1024]
                scores[k : k + 1024] = model if isinstance(model, float) else model.score(np.array([features(t, lexicon) for t in part]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], names=[*b.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs with score (0 to 1) and predicted (1 from the threshold on), which replace columns of these names.

    The score depends on the text alone: equal texts score alike; null counts as empty, and an empty text gets the score of
    a text without any sign of toxicity. An empty table gives an empty one.
    """
    lexicon, model = train(docs, labels)
    own = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    rows = own.withColumn("__text", F.col(text_col).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    scored = rows.mapInArrow(_score(lexicon, model), f"{fields}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", "predicted")
