"""Periodic runs of words by Main-Lorentz divide and conquer.

Words of a text are interned as numbers. A text is halved at multiples of powers of two; a run that crosses a midpoint has the larger
part of its four periods or more on one side of it, so that two periods at least begin (or end) at the midpoint. The Z-function of that
side tells the periods; where the first words already differ its value is too small, so one comparison of a whole batch of texts with itself,
level by level, leaves few midpoints whose Z-functions are worked out. A period found is extended to both sides, intervals are
deduplicated, and each keeps its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words at least, and so many of its periods.
WORDS, TIMES = 6, 4
#: Words of texts that are searched together; cells of a comparison; leading words that are compared at once; periods of a midpoint that are extended one by one.
BATCH, CELLS, LEADING, SINGLE = 1 << 20, 1 << 22, 8, 16


def z_function(w: list[int], limit: int) -> list[int]:
    """Length of the longest common prefix of w and w[i:], for i up to limit."""
    z, left, right = [len(w)] + [0] * min(limit, max(len(w) - 1, 0)), 0, 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(w) and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix, looked for in steps that double."""
    n, at, step = min(len(a), len(b)), 0, 16
    a, b = a[:n], b[:n]
    while at < n:
        unequal = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(unequal):
            return at + int(unequal[0])
        at, step = at + step, step * 2
    return n


def _candidates(w: np.ndarray, mids: np.ndarray, most: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """(midpoint, period) where the first words of one side, read away from the midpoint, agree with those one period on."""
    found_m, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sign, first = (-1, -1) if back else (1, 0)
    for lo in range(0, len(mids), rows := max(1, CELLS // most)):
        m = mids[lo : lo + rows]
        for p0 in range(1, most + 1, CELLS):
            p = np.arange(p0, min(most + 1, p0 + CELLS))
            at = m + first
            i, j = np.nonzero(w[at][:, None] == np.take(w, at[:, None] + sign * p, mode="clip"))
            m2, p2 = m[i], p[j]
            for k in range(1, LEADING):
                needed = k < np.maximum(WORDS // 2 - p2, p2)
                a, b = m2 + first + sign * k, m2 + first + sign * (k + p2)
                ok = ~needed | (w[np.clip(a, 0, len(w) - 1)] == w[np.clip(b, 0, len(w) - 1)])
                m2, p2 = m2[ok], p2[ok]
            found_m.append(m2)
            found_p.append(p2)
    return np.concatenate(found_m), np.concatenate(found_p)


def _crossing(w: np.ndarray, m: int, half: int, periods: np.ndarray, back: bool, add) -> None:
    """Runs of one text that reach from its midpoint over two of these (ascending) periods on one side, within half on both. One that
    goes on beyond is another midpoint's."""
    left, right = w[max(0, m - half) : m][::-1], w[m : m + half]
    side, other = (left, right) if back else (right, left)
    z, periods = None, periods[periods < len(side)]
    while len(periods):
        p, periods = int(periods[0]), periods[1:]
        if z is None and len(periods) >= SINGLE:
            z = z_function(side.tolist(), int(periods[-1]))
        ahead = p + (z[p] if z else common(side, side[p:]))
        if ahead < max(WORDS // 2, 2 * p):
            continue
        # the other side is continued by the word one period into this side: p - 1, p - 2, ... then its own
        lead = np.concatenate([side[:p][::-1], other])
        behind = common(other, lead)
        start, end = (m - ahead, m + behind) if back else (m - behind, m + ahead)
        if not (start and w[start - 1] == w[start - 1 + p] or end < len(w) and w[end] == w[end - p]):
            add(start, end, p)
        periods = periods[(periods % p != 0) | (ahead < 2 * periods)]  # multiples of a period give the same run


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of interned words, by start, then period. Numbers are not negative."""
    found: list[dict] = [{} for _ in texts]
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes  # a word that equals none lies before, between and after the texts
    w = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64)
    for t, s in zip(texts, starts):
        w[s : s + len(t)] = t
    w[w == -1] = -1 - np.arange((w == -1).sum())
    k = 8  # below, no run fits
    while k < 2 * sizes.max(initial=0):
        half = k // 2  # midpoints are the odd multiples of half
        many = np.where(sizes > half, (sizes - 1 - half) // k + 1, 0)
        mids = np.repeat(starts + half, many) + k * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        most = max(1, half // 2)
        for back in (False, True):
            m, p = _candidates(w, mids, most, back)
            order = np.lexsort((p, m))
            m, p = m[order], p[order]
            edges = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])).tolist() if len(m) else []
            for lo, hi in zip(edges, [*edges[1:], len(m)]):
                of = int(np.searchsorted(starts, m[lo], side="right")) - 1
                own = found[of]

                def add(start: int, end: int, period: int) -> None:
                    if end - start >= max(WORDS, TIMES * period):
                        own[start, end] = min(period, own.get((start, end), period))

                _crossing(texts[of], int(m[lo] - starts[of]), half, p[lo:hi], back, add)
        k *= 2
    return [sorted((s, e - s, p) for (s, e), p in f.items()) for f in found]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, runs, collapsed) of (id, text); some texts at a time."""
    texts: list[np.ndarray] = []
    held: list[tuple] = []
    ids: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for (i, words), runs in zip(held, runs_of(texts)):
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            left = words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()]
            rows.append((i, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(left)))
        texts.clear()
        held.clear()
        ids.clear()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(_RUN)))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    size = 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = (text.as_py() or b"").split()  # at the six ASCII white-space bytes
            texts.append(np.array([ids.setdefault(x, len(ids)) for x in words], np.int64))
            held.append((i, words))
            size += len(words)
            if size >= BATCH or len(held) >= 10_000:
                yield out()
                size = 0
    if held:
        yield out()


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, runs (start, length, period of words, by start, then period) and collapsed (the words left when a run
    keeps its first period alone, joined by one space).

    Words are what lies between ASCII white space. A run is a stretch with a smallest period, four of them and six words at least, that
    no neighbouring word extends. Null, empty and blank texts have no words, no runs and an empty text. Rows are judged one by one, so
    repeated rows and null ids don't matter. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    out = rows.mapInArrow(_found, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
