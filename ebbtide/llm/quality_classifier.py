"""Quality classifier by importance resampling over hashed n-gram models.

Three generative models over hashed n-grams are fitted to labelled documents: the target (good,
not toxic), low quality, toxic. Raw text is their mixture at the labelled shares. A document's
importance weight is p_target / p_raw; Gumbel noise is added to its logarithm and the k documents
with the greatest keys are the sample. k is the number of documents whose posterior of being
target is at least `keep_at`, so it follows the corpus.

N-grams: each distinct word once per document (lower case, outer punctuation off), and all pairs
of neighbouring word shapes (case, outer punctuation, repetition). Probabilities of a model are
the whole corpus' counts times a smoothed ratio of seen to expected. Ratios are shrunk by a prior:
few n-grams tell classes apart, and a ratio counts by the chance that its n-gram is one of them, so
that rare n-grams do not add up to a verdict and those of a few labelled rows are not lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import hash_pair, identity, matching_rows, table
from ebbtide.session import materialize, settle

BUCKETS = 1 << 20
SHAPES = 1 << 16
CLASSES = 3
#: At most about so many labelled rows fit the class models, taken per class; the prior shares use
#: all labels, the corpus counts all documents.
MAX_LABELLED = 100_000
KAPPA = 3.0
#: Share of the n-grams that tell classes apart, and the standard deviation of their log ratios.
TELLING, WIDTH = 0.03, 2.0
#: Error of a log ratio beside that of its counts, for words and for pairs: pairs are counted
#: wherever they stand, so one document brings many. Tuned on held-out labels, as `TELLING`.
SPREAD = (0.4, 1.0)
#: Shrunk ratios below this (in nats) are left out: over a long text they add up to noise.
NOISE = 0.03
#: Weights are raised to this power before sampling: noise decides between near-equal ones only.
SHARPNESS = 20.0
CHUNK = 1 << 22
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Codes(dict):
    """Word to code: the bucket of its letters, and above it the hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        head = word.lstrip(_PUNCTUATION)
        core = head.rstrip(_PUNCTUATION)
        kind = (
            b"U" if core.isupper() and len(core) > 1
            else b"T" if core[:1].isupper()
            else b"l" if core.islower()
            else b"d" if core.isdigit()
            else b"x"
        )
        lead = word[: min(3, len(word) - len(head))]
        tail = head[len(core) :][:3]
        shape = zlib.crc32(lead + b" " + kind + b" " + tail) % SHAPES
        code = shape * BUCKETS + zlib.crc32(core.lower()) % BUCKETS
        if len(self) >= 250_000:
            self.clear()
        self[word] = code
        return code


def _chunks(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        cut = data.find(b" ", at + CHUNK)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def features(text: str | None, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets (each once) and shape-pair buckets (all), the latter behind the former."""
    words, pairs, last = [], [], None
    for chunk in _chunks((text or "").encode()):
        split = chunk.split()
        code = np.fromiter(map(codes.__getitem__, split), np.int64, len(split))
        words.append(np.unique(code % BUCKETS))
        if last is not None:
            code = np.concatenate([last, code])
        shape = code // BUCKETS
        same = code[1:] == code[:-1]
        pairs.append(BUCKETS + (shape[:-1] * 31 + shape[1:] * 17 + same * 7919) % BUCKETS)
        last = code[-1:]
    return (np.unique(np.concatenate(words)) if len(words) > 1 else words[0]), np.concatenate(pairs)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: for each bucket the number of times in all documents and in each labelled class."""
    codes = _Codes()
    total = np.zeros((CLASSES + 1, 2 * BUCKETS), np.int64)
    for batch in batches:
        for text, kind in zip(batch["text"], batch["kind"]):
            words, pairs = features(text, codes)
            for row in (0,) if kind < 0 else (0, kind + 1):
                total[row][words] += 1
                np.add.at(total[row], pairs, 1)
    seen = np.flatnonzero(total[0])
    for at in range(0, len(seen), 100_000):
        some = seen[at : at + 100_000]
        yield pd.DataFrame({"bucket": some} | {f"n{i}": total[i][some] for i in range(CLASSES + 1)})


def labelled_classes(labels: DataFrame, id_col: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """(id, kind, of): 0 target, 1 low quality, 2 toxic, and how many rows the whole kind has.

    At most about `most` rows are taken, by hash: small kinds whole, of the others like many. Rows
    without an id are left out, and rows without a quality that are not toxic; of several labels of
    one id the worst counts.
    """
    low, toxic = F.col("quality") <= 0, F.col("toxic") > 0
    rows = (
        labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | (F.col("toxic") > 0)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .select("id", F.when(low, 1).when(toxic, 2).otherwise(0).alias("kind"))
    )
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, below, of = most, F.lit(0), F.lit(0).cast("long")
    for place, (kind, n) in enumerate(sorted(sizes.items(), key=lambda size: size[1])):
        quota = min(n, left // (len(sizes) - place))
        left -= quota
        share = 1.0 if quota == n else 0.97 * quota / n
        below = F.when(F.col("kind") == kind, int(share * (1 << 20))).otherwise(below)
        of = F.when(F.col("kind") == kind, F.lit(n).cast("long")).otherwise(of)
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < below).withColumn("of", of).limit(most)


def fit(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: prior shares and, for the buckets that say something, log(p_class / p_target).

    The classes are broadcast (bounded by `MAX_LABELLED`), so no text is shuffled; the driver gets
    the telling buckets, at most 2 * BUCKETS rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(classes.select("id", "kind")), "id", "left").select(
        "text", F.coalesce("kind", F.lit(-1)).cast("int").alias("kind")
    )
    names = [f"n{i}" for i in range(CLASSES + 1)]
    counts = materialize(
        marked.mapInPandas(_count, "bucket long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names]),
        "ngram-counts",
    )
    half = F.floor(F.col("bucket") / BUCKETS).alias("half")
    sums = counts.groupBy(half).agg(*[F.sum(n).alias(f"s{n}") for n in names])
    rated = counts.withColumn("half", half).join(F.broadcast(sums), "half")

    def seen_to_expected(i: int):
        expected = F.col(f"sn{i}") * F.col("n0") / F.col("sn0")
        return F.log((F.col(f"n{i}") + KAPPA) / (expected + KAPPA))

    def telling(i: int):
        gap = seen_to_expected(i) - seen_to_expected(1)
        noise = 1 / (F.col(f"n{i}") + KAPPA) + 1 / (F.col("n1") + KAPPA)
        noise += F.when(F.col("half") == 0, SPREAD[0] ** 2).otherwise(SPREAD[1] ** 2)
        total = noise + WIDTH**2
        odds = math.log(TELLING / (1 - TELLING)) + (F.log(noise / total) + gap * gap * (1 / noise - 1 / total)) / 2
        shrunk = gap * WIDTH**2 / total / (1 + F.exp(-odds))
        return F.when(F.abs(shrunk) >= NOISE, shrunk).otherwise(0.0)

    gaps = rated.select("bucket", telling(2).alias("g1"), telling(3).alias("g2")).where("g1 <> 0 OR g2 <> 0")
    found = gaps.toPandas().sort_values("bucket")
    shares = {r["kind"]: r["n"] for r in classes.groupBy("kind").agg(F.max("of").alias("n")).collect()}
    # Without labels nothing is known against any document.
    prior = np.array([shares.get(i, 0) + (i == 0) for i in range(CLASSES)], float)
    return {
        "prior": prior / prior.sum(),
        "buckets": found["bucket"].to_numpy(np.int64),
        "gaps": found[["g1", "g2"]].to_numpy(np.float64).T.copy(),
    }


def weigh(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, log_weight) for each row; h1 and h2 are hashes of its text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, own = _Codes(), shared.value
        gaps = np.zeros((2, 2 * BUCKETS))
        gaps[:, own["buckets"]] = own["gaps"]
        prior = own["prior"]
        for batch in batches:
            out = []
            for text in batch["text"]:
                words, pairs = features(text, codes)
                ratio = gaps[:, words].sum(axis=1) + gaps[:, pairs].sum(axis=1)
                raw = prior[0] + (prior[1:] * np.exp(np.clip(ratio, -700, 700))).sum()
                out.append(-np.log(raw))
            yield pd.DataFrame({"id": batch["id"], "h1": batch["h1"], "h2": batch["h2"], "log_weight": out})

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        *[h.alias(n) for h, n in zip(hash_pair(text), ("h1", "h2"))],
        text.alias("text"),
    )
    return rows.mapInPandas(score, "id long, h1 long, h2 long, log_weight double")


def greatest_keys(keyed: DataFrame, key: str, k: int) -> float:
    """The k-th greatest key. Counts of 1,024 ranges narrow it down; no row reaches the driver."""
    low, high = keyed.agg(F.min(key), F.max(key)).first()
    left = k
    while low < high:
        width = (high - low) / 1024
        cell = F.least(F.lit(1023), F.floor((F.col(key) - low) / width))
        inside = keyed.where(F.col(key).between(low, high))
        rows = inside.groupBy(cell.alias("c")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        for row in sorted(rows.collect(), key=lambda r: -r["c"]):
            if row["n"] >= left:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int | None = None,
    keep_at: float = 0.5,
    seed: int = 7,
) -> DataFrame:
    """The sampled rows as (id, h1, h2, log_weight, sample_key).

    Null texts count as empty; a text without words has no evidence against it. Rows with equal id
    and text get equal keys, and all rows that tie at the cut stay. Without labels every row stays;
    an empty table gives no rows. Only the id and the text of `docs` are read.
    """
    model = fit(docs, labelled_classes(labels), id_col, text_col)
    weighed = weigh(docs, model, id_col, text_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "h1"), 11) + 0.5) / float(1 << 53)
    keyed = materialize(
        weighed.withColumn("sample_key", SHARPNESS * F.col("log_weight") - F.log(-F.log(uniform))),
        "sample-keys",
    )
    if k is None:
        posterior = F.exp("log_weight") * float(model["prior"][0])
        k = keyed.where(posterior >= keep_at).count()
    if k == 0:
        return keyed.limit(0)
    return keyed.where(F.col("sample_key") >= greatest_keys(keyed, "sample_key", k))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are sampled, with all their columns; repeated rows stay rows of their own."""

    def kept() -> DataFrame:
        return resample(docs, labels, id_col, text_col).select(*identity(F.col("id")), "h1", "h2").distinct()

    # a sampled row stands for all rows of its id and text, which have the same key
    keys = identity(F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    return matching_rows(docs, keys, settle(kept, "kept-sampled"), every=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents; rejected ones are not in the result."""
    sample = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sample.select(F.col("id").alias("doc_id"), "log_weight", "sample_key")
