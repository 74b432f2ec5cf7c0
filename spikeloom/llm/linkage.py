"""Matching entities across sources without keys: regularised Gaussian mixtures under a transitivity constraint.

1. Candidates share a recording and a neighbourhood. Rows with both
   coordinates meet in cells of the array, rows with one of them in bands.
   Rows whose known coordinates have none in common meet all over the recording.
   All blocks are keys of one join, which carries the rows' fields with it.
2. Each candidate pair gets a vector of similarities. Shapes are aligned at
   their peak (at either one, where two of them compete), made free of scale and polarity, and compared over small shifts,
   so each source may write them in its own units. Missing fields leave their
   dimension out.
3. Expectation-maximisation fits mixtures for matched and unmatched pairs
   without labels. Variances are regularised. Rows of ``left`` are distinct
   entities, so a row of ``right`` that matched two of them would make those
   two one: the E-step therefore shares each right row's probability out over
   its candidates and the chance that it has no partner.
4. Sources have conventions: where they place their origin in a recording, and
   their gain. Both are estimated from the posteriors, taken out of the
   similarities, and the mixtures are fitted again.
5. Rows of one source in ``right`` are distinct as well, so a left row has at
   most one whole match in a source: its whole matches share out theirs (parts
   of a divided entity don't). The posterior is the pair's confidence.

Each iteration is one pass over the pairs, which stay partitioned by the right
row, and returns some fifty sums to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.functions.keys import recording_key, usable
from spikeloom.session import cut

HALF, SHIFT, SECOND, SCALE = 12, 2, 0.6, 16384  #: samples kept on either side of a peak; shifts tried; least size of a second peak; 1 in a packed shape
SMALL = 50_000  #: rows of a table of recordings up to which it is sent to all tasks (some ten MB); larger ones are joined by shuffle
DIMS = ("drow", "dcol", "shape", "rate", "gain")
#: Components: a whole match, a match with a part of a divided unit, close strangers, other strangers.
MATCHED, UNMATCHED = (0, 1), (2, 3)


def _aligned(waves: pd.Series) -> pd.Series:
    """Each shape cut about its greatest excursion, and about the greatest of the other sign where that is nearly as great.

    Both cuts are scaled to -1 at their middle, and packed as 16-bit numbers,
    as shapes travel with every block that their row enters. There is no second one where
    the other sign's excursion is under ``SECOND`` of the first.
    """
    size = 2 * (HALF + SHIFT) + 1
    out: list[np.ndarray | None] = []
    for w in waves:
        if w is None or len(w) == 0:
            out.append(None)
            continue
        w = np.asarray(w, dtype=float)
        if not np.isfinite(w).all() or not np.abs(w).max() > 0:
            out.append(None)
            continue
        first, other = sorted((int(w.argmin()), int(w.argmax())), key=lambda p: -abs(w[p]))
        cuts = (first, other) if w[first] * w[other] < 0 and abs(w[other]) >= SECOND * abs(w[first]) else (first,)
        x = np.zeros((len(cuts), size), dtype=np.float32)
        for k, p in enumerate(cuts):
            lo, hi = max(0, p - HALF - SHIFT), min(len(w), p + HALF + SHIFT + 1)
            x[k, lo - p + HALF + SHIFT : hi - p + HALF + SHIFT] = w[lo:hi] / -w[p]
        out.append(np.round(x.ravel() * SCALE).astype("<i2").tobytes())
    return pd.Series(out, dtype=object)


def _padded(shapes: pd.Series, size: int) -> np.ndarray:
    """One or two cuts of each shape; NaN for a second one that there isn't."""
    out = np.full((len(shapes), 2, size), np.nan)
    two = np.array([len(x) > 2 * size for x in shapes])
    for k, which in ((1, ~two), (2, two)):
        if which.any():
            out[which, :k] = np.frombuffer(b"".join(shapes[which]), "<i2").reshape(-1, k, size)
    return out


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greatest correlation over small shifts and both cuts of either shape (but not the lesser of both); missing where a shape is."""
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if both.any():
        size, n = 2 * (HALF + SHIFT) + 1, 2 * HALF + 1
        x, y = (_padded(s[both], size) for s in (a, b))
        best = np.full(len(x), -1.0)
        for i, j in ((0, 0), (0, 1), (1, 0)):
            use = np.flatnonzero(~np.isnan(x[:, i, 0]) & ~np.isnan(y[:, j, 0]))
            p = x[use, i, SHIFT : SHIFT + n]
            p = p - p.mean(1, keepdims=True)
            p /= np.linalg.norm(p, axis=1, keepdims=True) + 1e-12
            for k in range(2 * SHIFT + 1):
                z = y[use, j, k : k + n]
                z = z - z.mean(1, keepdims=True)
                best[use] = np.maximum(best[use], (p * z).sum(1) / (np.linalg.norm(z, axis=1) + 1e-12))
        out[both] = best
    return pd.Series(out)


aligned = F.pandas_udf(_aligned, T.BinaryType())
alike = F.pandas_udf(_alike, T.DoubleType())


def _small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it has ``SMALL`` rows or fewer; its rows are counted."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def prepared(df: DataFrame, key: str, recording: str, row: str, col: str, waveform: str, rate: str, source: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """One row per key: ``key, rec, source, row, col, shape, lograte, logpeak``. Unusable fields become NULL; rows without key or recording go.

    ``source`` names who wrote the row, as conventions are its own. ``within``
    keeps rows of the recordings (``rec``) it holds, before anything is shuffled.
    """
    wave = F.when(F.size(waveform) > 0, F.col(waveform).cast("array<float>"))
    peak = F.greatest(F.abs(F.array_max(wave)), F.abs(F.array_min(wave))).cast("double")
    one = df.select(
        F.col(key).cast("long").alias("key"), recording_key(recording).alias("rec"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source") if source else F.lit("").alias("source"),
        F.when(F.col(row) >= 0, F.col(row)).cast("int").alias("row"), F.when(F.col(col) >= 0, F.col(col)).cast("int").alias("col"), wave.alias("wave"),
        F.when(usable(rate) & (F.col(rate) > 0), F.log(F.col(rate).cast("double"))).alias("lograte"), F.when(usable(peak) & (peak > 0) & (peak < float("inf")), F.log(peak)).alias("logpeak"),
    ).where("key IS NOT NULL AND rec IS NOT NULL")
    if within is not None:
        one = one.join(_small(within.select("rec").distinct()), "rec", "left_semi")
    # Shapes are packed before repeated rows meet: they are a third of a waveform's size.
    packed = one.select("key", "rec", "source", "row", "col", aligned("wave").alias("shape"), "lograte", "logpeak")
    return packed.groupBy("key").agg(*[F.max(c).alias(c) for c in packed.columns if c != "key"])


def _knows() -> Column:
    return F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), "full").when(F.col("row").isNotNull(), "row").when(F.col("col").isNotNull(), "col").otherwise("bare")


#: What a left row knows -> what the right rows know that it shares no coordinate with.
_APART = {"full": ("bare",), "row": ("bare", "col"), "col": ("bare", "row"), "bare": ("full", "row", "col", "bare")}


def candidates(left: DataFrame, right: DataFrame, reach: int = 6, chunk: int = 1000) -> DataFrame:
    """Pairs of one recording whose known coordinates differ by ``reach`` at most: all fields of both, prefixed ``l`` and ``r``, each pair once.

    A block is (recording, row cell, column cell) with cells twice ``reach``
    wide; right rows, of which there are fewer, enter the cells that their
    reach touches (four at most), left rows their own. Where one of the two rows lacks a
    coordinate, the block is a band of the other one. Rows without a coordinate
    in common are all candidates, unless they share neither shape nor rate:
    they meet per recording in blocks of about ``chunk`` by ``chunk`` rows,
    however many a recording has. So a crowded recording divides. Left rows
    enter only kinds of blocks in which their recording has right rows.
    """
    cell = lambda c, off=0: F.floor((F.col(c) + F.lit(off)) / F.lit(2 * reach)).cast("int")
    touched = lambda c: F.sequence(cell(c, -reach), cell(c, reach))
    some = F.col("shape").isNotNull() | F.col("lograte").isNotNull()
    n = lambda df: df.where(some).groupBy("rec", "knows").agg(F.count("*").alias("n"))
    le, ri = left.withColumn("knows", _knows()), right.withColumn("knows", _knows())
    # Per recording: what its right rows know, and into how many chunks each kind of row is cut.
    kinds = ri.groupBy("rec").agg(F.collect_set("knows").alias("has"))  # at most four values
    parts = lambda df: F.map_from_entries(F.collect_list(F.struct("knows", F.ceil(F.col("n") / F.lit(float(chunk))).cast("int").alias("k"))))
    sizes = _small(cut(kinds.join(n(le).groupBy("rec").agg(parts(le).alias("lk")), "rec", "left").join(n(ri).groupBy("rec").agg(parts(ri).alias("rk")), "rec", "left"), "sizes"))

    def block(mark: str | Column, x: Column, y: Column) -> Column:
        return F.struct((F.lit(mark) if isinstance(mark, str) else mark).alias("mark"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    zero, has = F.lit(0), lambda *k: F.arrays_overlap("has", F.array(*map(F.lit, k)))
    band = lambda mark, c: F.transform(touched(c), lambda x: block(mark, x, zero))
    none = F.array().cast("array<struct<mark:string,x:int,y:int>>")
    pick = lambda cond, blocks: F.when(cond, blocks).otherwise(none)

    def apart(me: str, other: str, mine_left: bool) -> Column:
        """The chunk blocks of a row that knows ``me`` against rows that know ``other``: its own chunk by all of theirs."""
        mark = f"{me}-{other}" if mine_left else f"{other}-{me}"
        k_me, k_other = ("lk", "rk") if mine_left else ("rk", "lk")
        own = F.pmod(F.xxhash64("key"), F.element_at(k_me, F.lit(me))).cast("int")
        theirs = F.sequence(zero, F.coalesce(F.try_element_at(k_other, F.lit(other)), zero) - 1)
        made = F.transform(theirs, lambda t: block(mark, own if mine_left else t, t if mine_left else own))
        return pick((F.col("knows") == me) & some & (F.coalesce(F.try_element_at(k_other, F.lit(other)), zero) > 0), made)

    knows = lambda *k: F.col("knows").isin(*k)
    l_blocks = [
        pick(knows("full") & has("full"), F.array(block("rc", cell("row"), cell("col")))),
        pick(knows("full", "row") & has("row"), F.array(block("r", cell("row"), zero))),
        pick(knows("full", "col") & has("col"), F.array(block("c", cell("col"), zero))),
        pick(knows("row") & has("full"), band("R", "row")),
        pick(knows("col") & has("full"), band("C", "col")),
        *[apart(me, other, True) for me, others in _APART.items() for other in others],
    ]
    r_blocks = [
        pick(knows("full"), F.concat(F.flatten(F.transform(touched("row"), lambda x: F.transform(touched("col"), lambda y: block("rc", x, y)))), F.array(block("R", cell("row"), zero), block("C", cell("col"), zero)))),
        pick(knows("row"), band("r", "row")),
        pick(knows("col"), band("c", "col")),
        *[apart(other, me, False) for me, others in _APART.items() for other in others],
    ]
    fields = ("key", "source", "row", "col", "shape", "lograte", "logpeak")

    def placed(df: DataFrame, blocks: list[Column], side: str) -> DataFrame:
        rows = df.join(sizes, "rec").select("rec", F.explode(F.concat(*blocks)).alias("b"), *[F.col(c).alias(f"{side}{c}") for c in fields])
        return rows.select("rec", "b.mark", "b.x", "b.y", *[f"{side}{c}" for c in fields])

    met = placed(le, l_blocks, "l").join(placed(ri, r_blocks, "r"), ["rec", "mark", "x", "y"])
    near = lambda p, q: F.coalesce(F.abs(F.col(p) - F.col(q)) <= reach, F.lit(True))
    share = F.col("mark").contains("-") & ~((F.col("lshape").isNotNull() & F.col("rshape").isNotNull()) | (F.col("llograte").isNotNull() & F.col("rlograte").isNotNull()))
    return met.where(near("lrow", "rrow") & near("lcol", "rcol") & ~share).drop("mark", "x", "y")


@dataclass
class Mixture:
    """Diagonal Gaussians: ``weight[k]``, ``mean[k][d]``, ``var[k][d]``."""

    weight: list[float]
    mean: list[list[float]]
    var: list[list[float]]
    steps: int = 0
    history: list[float] = field(default_factory=list)

    def log_density(self, k: int) -> Column:
        out = F.lit(math.log(max(self.weight[k], 1e-12)))
        for d, name in enumerate(DIMS):
            m, v = self.mean[k][d], self.var[k][d]
            x = F.col(name) - m
            out = out + F.when(F.col(name).isNotNull(), x * x * (-0.5 / v) - 0.5 * math.log(2 * math.pi * v)).otherwise(0.0)
        return out


def _scored(pairs: DataFrame, mix: Mixture) -> DataFrame:
    """Adds ``l0..l3`` (log densities) and ``p``, the posterior under the constraint on right rows."""
    d = pairs.select("*", *[mix.log_density(k).alias(f"l{k}") for k in (*MATCHED, *UNMATCHED)])
    lse = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))
    d = d.select("*", lse(F.col("l0"), F.col("l1")).alias("lm"), lse(F.col("l2"), F.col("l3")).alias("lu"))
    odds = F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), F.col("lm") - F.col("lu"))))
    d = d.withColumn("odds", odds)
    return d.withColumn("p", F.col("odds") / (1.0 + F.sum("odds").over(Window.partitionBy("rkey"))))


def _sums(keys: np.ndarray, x: np.ndarray, mix: Mixture) -> np.ndarray:
    """The E-step of whole groups of a right row's pairs, and their share in the M-step's sums: ``4 x (1 + 3 * dimensions)``.

    A component's row holds its weight, then per dimension the weight of the
    values that are there, their sum and their squares' sum.
    """
    have = ~np.isnan(x)
    filled = np.where(have, x, 0.0)
    mean, var = np.array(mix.mean), np.array(mix.var)
    dens = [math.log(max(mix.weight[k], 1e-12)) + np.where(have, (filled - mean[k]) ** 2 * (-0.5 / var[k]) - 0.5 * np.log(2 * np.pi * var[k]), 0.0).sum(1) for k in (*MATCHED, *UNMATCHED)]
    lm, lu = np.logaddexp(dens[0], dens[1]), np.logaddexp(dens[2], dens[3])
    odds = np.exp(np.clip(lm - lu, -60.0, 60.0))
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    p = odds / (1.0 + np.add.reduceat(odds, np.flatnonzero(first))[np.cumsum(first) - 1])
    out = np.zeros((4, 1 + 3 * x.shape[1]))
    for k, share, whole in ((0, p, lm), (1, p, lm), (2, 1 - p, lu), (3, 1 - p, lu)):
        r = share * np.exp(dens[k] - whole)
        out[k, 0] = r.sum()
        out[k, 1::3], out[k, 2::3], out[k, 3::3] = r @ have, r @ filled, r @ filled**2
    return out


def _step(pairs: DataFrame, mix: Mixture) -> np.ndarray:
    """The sums of one iteration. ``pairs`` are partitioned and sorted by the right row; the plan is the same in each iteration, so its code is made once."""
    width = 4 * (1 + 3 * len(DIMS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros((4, 1 + 3 * len(DIMS))), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(DIMS))], 1)
            if rest is not None:
                keys, x = np.concatenate([rest[0], keys]), np.concatenate([rest[1], x])
            cut_at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
            if cut_at:
                total += _sums(keys[:cut_at], x[:cut_at], mix)
            rest = keys[cut_at:], x[cut_at:]
        if rest is not None:
            total += _sums(*rest, mix)
        yield pa.record_batch([pa.array(range(width)), pa.array(total.ravel())], names=["i", "s"])

    rows = pairs.select("rkey", *DIMS).mapInArrow(scan, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row per sum
    out = np.zeros(width)
    for r in rows:
        out[r.i] = r.s
    return out.reshape(4, -1)


def fit(pairs: DataFrame, start: Mixture | None = None, max_steps: int = 40, tol: float = 4e-3, ridge: float = 0.02) -> Mixture:
    """The mixture of matched and unmatched pairs, by EM over all pairs. ``ridge`` regularises variances.

    Starts without labels: matched components at the upper end of the shape
    similarities and at small differences, unmatched ones at the middle; or
    from ``start``, with differences free of conventions.
    """
    whole = pairs.agg(*[F.avg(d).alias(f"m_{d}") for d in DIMS], *[F.var_pop(d).alias(f"v_{d}") for d in DIMS], F.percentile_approx("shape", [0.5, 0.95]).alias("q")).first()
    mean = [whole[f"m_{d}"] if whole[f"m_{d}"] is not None else 0.0 for d in DIMS]
    var = [max(whole[f"v_{d}"] or 0.0, 1e-2) for d in DIMS]
    low, high = whole["q"] if whole["q"] else (1.0, 2.5)
    if start is None:
        mix = Mixture(
            [0.15, 0.03, 0.41, 0.41],
            [[1.0, 1.0, high, 0.0, 0.0], [1.0, 1.0, high, -0.7, 0.0], [mean[0], mean[1], low, mean[3], mean[4]], [mean[0], mean[1], (low + high) / 2, mean[3], mean[4]]],
            [[1.0, 1.0, var[2] / 4, 0.02, 0.1], [1.0, 1.0, var[2] / 4, 0.06, 0.1], list(var), list(var)],
        )
    else:
        centred = lambda k: [0.0, 0.0, start.mean[k][2], start.mean[k][3], 0.0] if k in MATCHED else [mean[0], mean[1], start.mean[k][2], start.mean[k][3], mean[4]]
        spread = lambda k: [0.5, 0.5, start.var[k][2], start.var[k][3], 0.05] if k in MATCHED else [var[0], var[1], start.var[k][2], start.var[k][3], var[4]]
        mix = Mixture(list(start.weight), [centred(k) for k in range(4)], [spread(k) for k in range(4)])
    for _ in range(max_steps):
        s = _step(pairs, mix)
        total = float(s[:, 0].sum())
        if not total:
            break
        old = [list(m) for m in mix.mean]
        for k in (*MATCHED, *UNMATCHED):
            mix.weight[k] = max(float(s[k, 0]) / total, 1e-6)
            for i in range(len(DIMS)):
                n, sx, sq = (float(v) for v in s[k, 1 + 3 * i : 4 + 3 * i])
                if n > 1e-6:
                    mix.mean[k][i] = sx / n
                    mix.var[k][i] = max(sq / n - (sx / n) ** 2, 0.0) + ridge * var[i] * (0.25 if k in MATCHED else 1.0)
        mix.steps += 1
        moved = max(abs(a - b) / math.sqrt(v) for p, q in zip(old, mix.mean) for a, b, v in zip(p, q, var))
        mix.history.append(moved)
        if moved < tol:
            break
    return mix


def _centred(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """The pairs with each source's conventions taken out: its offset in a recording (drawn to 0 by one pair's weight), and its gain."""
    off = lambda c: (F.coalesce(F.sum(F.col("p") * F.col(c)), F.lit(0.0)) / (1.0 + F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("p"))), F.lit(0.0))))
    weighed = [off("srow").alias("orow"), off("scol").alias("ocol"), F.sum(F.when(F.col("sgain").isNotNull(), F.col("p") * F.col("sgain"))).alias("g"), F.sum(F.when(F.col("sgain").isNotNull(), F.col("p"))).alias("w")]
    place = cut(scored.groupBy("rec", "source").agg(*weighed), "places")
    gain = cut(place.groupBy("source").agg((F.sum("g") / F.sum("w")).alias("ogain")), "gains")
    out = pairs.join(_small(place.drop("g", "w")), ["rec", "source"], "left").join(_small(gain), "source", "left")
    keep = [c for c in pairs.columns if c not in ("drow", "dcol", "gain")]
    return out.select(*keep, (F.col("srow") - F.col("orow")).alias("drow"), (F.col("scol") - F.col("ocol")).alias("dcol"), (F.col("sgain") - F.col("ogain")).alias("gain"))


def _by_right(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("rkey").sortWithinPartitions("rkey").persist(StorageLevel.MEMORY_AND_DISK)


def link(left: DataFrame, right: DataFrame, reach: int = 6, rounds: int = 1) -> DataFrame:
    """Confidence of every candidate pair: ``lkey, rkey`` , the similarities and ``confidence``.

    ``left`` and ``right`` come from ``prepared``; ``right`` is read several
    times, so it should be a written table. Conventions are estimated
    ``rounds`` times. Pairs that share no usable field get no say: with all
    dimensions missing their odds are the prior's. Empty tables give an empty
    result.
    """
    le = cut(left, "left")
    both = candidates(le, right, reach)
    both = both.select(
        "rec", F.col("rsource").alias("source"), "lkey", "rkey", (F.col("rrow") - F.col("lrow")).cast("double").alias("srow"), (F.col("rcol") - F.col("lcol")).cast("double").alias("scol"),
        alike("lshape", "rshape").alias("cc"), (F.col("rlograte") - F.col("llograte")).alias("rate"), (F.col("rlogpeak") - F.col("llogpeak")).alias("sgain"),
    )
    shape = F.when(F.col("cc").isNotNull() & ~F.isnan("cc"), -F.log10(1.0 - F.col("cc") + 1e-3))
    both = cut(both.select("*", F.abs("srow").alias("drow"), F.abs("scol").alias("dcol"), shape.alias("shape"), F.lit(None).cast("double").alias("gain")).drop("cc"), "pairs")
    kept = _by_right(both)
    mix = fit(kept, max_steps=12)  # near enough for the conventions
    for i in range(rounds):
        scored = _scored(kept, mix).select("rec", "source", "srow", "scol", "sgain", "p")
        centred = _centred(both, scored)
        kept.unpersist()
        kept = _by_right(centred)
        mix = fit(kept, mix, max_steps=40 if i + 1 == rounds else 12)
    whole = F.col("p") * F.exp(F.col("l0") - F.col("lm"))
    out = _scored(kept, mix).withColumn("whole", F.least(whole, F.lit(1 - 1e-9))).withColumn("part", F.greatest(F.col("p") - whole, F.lit(0.0)))
    odds = F.col("whole") / (1.0 - F.col("whole"))
    out = out.withColumn("confidence", F.col("part") + (1 - F.col("part")) * odds / (1.0 + F.sum(odds).over(Window.partitionBy("lkey", "source"))))
    out = cut(out.select("lkey", "rkey", *DIMS, "confidence"), "links")
    kept.unpersist()
    return out
