"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed by tasks. A bounded sample of labelled rows trains the trees: statistics are binned
by quantiles once, and each level of a tree is grown from per-bin sums of gradients. All trees are complete and flattened
into arrays (one row a tree), which tasks walk with numpy for all documents and trees at once, one step a level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Symbols of junk, and the byte classes in order.
SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "lower", "digit", "space", "newline", "symbol", "mark", "control", "other")
STATISTICS = ("log_bytes", *CLASSES, "word_bytes", "distinct_words", "top_word", "repeated_lines", "line_bytes", "end_marks")
#: Most labelled rows that train, chosen by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SHRINK = 60, 4, 64, 0.2, 8, 1.0
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), np.int64)
    of[:32] = of[127] = CLASSES.index("control")
    of[33:127] = CLASSES.index("mark")
    for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("symbol", SYMBOLS.encode())):
        of[list(chars)] = CLASSES.index(name)
    return of


_CLASS_OF = _classes()


def statistics(text: str) -> list[float]:
    """STATISTICS of one text."""
    raw = text.encode()
    n = len(raw)
    shares = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES)) / max(n, 1)
    words = text.split()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum())
    return [
        float(np.log1p(n)), *shares.tolist(), n / (len(words) + 1), len(counts) / max(len(words), 1), max(counts.values(), default=0) / max(len(words), 1),
        1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(n / (len(lines) + 1))), marked / max(len(words), 1),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t.as_py() or "") for t in b.column(1)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(STATISTICS))), *b.columns[2:]], ["id", *STATISTICS, *b.schema.names[2:]])


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of the inner nodes in level order, values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        out, t = np.full(len(x), self.start), np.arange(len(self.feature))
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            node, rows = np.zeros((len(part), len(t)), np.int64), np.arange(len(part))[:, None]
            for _ in range(int(np.log2(self.leaf.shape[1])) if len(t) else 0):
                node = 2 * node + 1 + (part[rows, self.feature[t, node]] > self.threshold[t, node])
            if len(t):
                out[lo : lo + 2048] += self.leaf[t, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for logistic loss. One class alone, or no row, gives a constant score (that share; 0.5 for no row)."""
    inner, n_leaf, f = 2**depth - 1, 2**depth, x.shape[1]
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, n_leaf)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1)  # bin b: over edge b - 1, up to edge b
    out, score = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, n_leaf)), start), np.full(len(x), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = p - y, p * (1 - p), np.zeros(len(x), int)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            for j in range(f):
                if not len(edges[j]):
                    continue
                key = (node - base) * BINS + bins[:, j]
                sums = [np.cumsum(np.bincount(key, w, width * BINS).reshape(width, BINS), 1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + SHRINK) + (ga - gl) ** 2 / (ha - hl + SHRINK) - ga**2 / (ha + SHRINK)
                gain[(nl < LEAST) | (na - nl < LEAST)] = 0
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], out.feature[t, base + k], out.threshold[t, base + k] = top[k], j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.leaf[t] = -RATE * np.bincount(leaf, g, n_leaf) / (np.bincount(leaf, h, n_leaf) + SHRINK)
        score += out.leaf[t, leaf]
    return out


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, mod 4, is 2; null ids count as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """One row per row: id, held_out, score, predicted.

    Learns from at most `sample` rows that have a label 0 or 1 and aren't held out, those with the smallest hashes of their id;
    of several labels for an id the largest counts. Only statistics of the text are inputs of a score; null texts count as
    empty, and empty texts have a score too. Without usable labels all scores are 0.5. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result. row_col: a column of keys (string) of the rows themselves, put out as well.
    """
    row, named = ([F.col(row_col).alias("row")], ["row"]) if row_col else ([], [])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row)
    rows = stash(rows.mapInArrow(_statistics, ", ".join(["id long", *(f"{s} double" for s in STATISTICS), *(f"{c} string" for c in named)])))
    labelled = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(label_col).alias("label"))
    train = rows.where(~held_out(F.col("id"))).join(labelled, F.col("id") == F.col("label_id"))
    train = train.orderBy(F.xxhash64("id"), "id", *STATISTICS).limit(sample).select("label", *STATISTICS).toArrow()
    x = np.stack([train.column(s).to_numpy() for s in STATISTICS], 1) if train.num_rows else np.zeros((0, len(STATISTICS)))
    model = fit(x, train.column("label").to_numpy().astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(np.stack([c.to_numpy() for c in b.columns[1 : len(STATISTICS) + 1]], 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), *b.columns[len(STATISTICS) + 1 :]], ["id", "score", *named])

    out = rows.mapInArrow(score, "id long, score double" + (", row string" if row_col else ""))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(c).alias(row_col) for c in named])
