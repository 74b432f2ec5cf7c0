"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies,
``wanted tokens / tokens there are``. Its whole part is taken for certain; the
fractional part is an inclusion probability. The flight phase of the cube
method moves these probabilities through the null space of two constraints, the
number of documents and the number of tokens, until at most two documents of a
block are undecided: each step takes three of them along the one direction that
changes neither total. What is left of the blocks forms the blocks of the next
level, so no task holds more than ``block`` documents of a source, and at the
end at most two documents a source remain for the landing.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.session import cut

LANDING = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, source: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of every document; NULL texts have 0 tokens. ``tokenizer`` is the path of a rank file on every executor."""
    path = tokenizer or default_tokenizer()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return cols.mapInArrow(scan, "doc_id long, source string, tokens long")


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most; the sums of ``prob`` and ``prob * size`` stay."""
    p = prob.astype(float).copy()
    eps = 1e-9
    queue = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    x = size.astype(float) / max(float(size.max()), 1.0) if len(size) else size
    active: list[int] = []
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    while True:
        while len(active) < LANDING + 1:
            k = next(queue, None)
            if k is None:
                break
            active.append(k)
        if len(active) < LANDING + 1:
            break
        a, b, c = active
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])  # orthogonal to (1, 1, 1) and to the sizes
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, v in zip(active, u):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, -p[k] / v), min(down, (p[k] - 1) / v)
        move = up if next(draws) * (up + down) < down else -down
        for k, v in zip(active, u):
            p[k] = min(1.0, max(0.0, p[k] + move * v))
        active = [k for k in active if eps < p[k] < 1 - eps]
    return np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))


def plan_shares(available: pd.DataFrame, targets: pd.DataFrame, total: float | None = None) -> pd.DataFrame:
    """What to take of each target source: ``source, target_share, max_repeats, tokens, reachable, copies``.

    Sources without tokens can't be reached; the others share the whole in
    proportion to their targets. Without ``total`` it is the largest that no
    source's cap forbids. With one, a source whose cap is too low gives all it
    may.
    """
    t = targets.copy()
    t = t[t["source"].notna() & (t["target_share"] > 0)]
    t["max_repeats"] = t["max_repeats"].fillna(1).clip(lower=0)
    t = t.groupby("source", as_index=False).agg({"target_share": "sum", "max_repeats": "min"})
    t = t.merge(available, on="source", how="left")
    t[["tokens", "documents"]] = t[["tokens", "documents"]].astype(float).fillna(0.0)
    t["reachable"] = (t["tokens"] > 0) & (t["max_repeats"] > 0)
    within = t["target_share"].where(t["reachable"], 0.0)
    share = within / within.sum() if within.sum() else within
    if total is None:
        caps = (t["max_repeats"] * t["tokens"] / share)[t["reachable"]]
        total = float(caps.min()) if len(caps) else 0.0
    t["wanted"] = share * total
    copies = (t["wanted"] / t["tokens"].where(t["tokens"] > 0, np.nan)).fillna(0.0)
    copies = np.minimum(copies, t["max_repeats"])
    t["copies"] = np.where(np.abs(copies - np.round(copies)) < 1e-9, np.round(copies), copies)
    return t


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, tokenizer: str | None = None, block: int = 2000, seed: int = 7, max_targets: int = 10_000) -> tuple[DataFrame, pd.DataFrame]:
    """The chosen documents and the plan: ``doc_id, source, tokens, copies`` with ``copies >= 1``.

    ``targets`` has ``source, target_share, max_repeats`` and at most
    ``max_targets`` sources (an error beyond that; shares that small aren't
    targets). No document is used more often than its source's ``max_repeats``.

    Documents with a NULL key or source, of a source without target, or whose
    text is NULL or has no tokens aren't used. A key that comes more than once
    counts once. Target rows without source or with a share that is NULL or
    not positive are ignored, several of one source add up under the lowest
    cap, a NULL cap is 1. Equal seeds give equal results.
    """
    if block < 4 * LANDING:
        raise ValueError(f"a block needs {4 * LANDING} documents or more")
    spark = docs.sparkSession
    goal = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    rows = goal.limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} target sources")
    want = pd.DataFrame([tuple(r) for r in rows], columns=["source", "target_share", "max_repeats"]).astype({"target_share": float, "max_repeats": float})
    names = sorted({s for s in want["source"] if s is not None})
    sized = token_counts(docs.where(F.col(key).isNotNull() & F.col(source).isin(names)), key, text, source, tokenizer)
    sized = cut(sized.where("tokens > 0").groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("d")).select("doc_id", "d.source", "d.tokens"), "sized")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).collect()  # a row per target source
    plan = plan_shares(pd.DataFrame([tuple(r) for r in have], columns=["source", "tokens", "documents"]), want, total_tokens)

    part = spark.createDataFrame([(r.source, int(math.floor(r.copies)), float(r.copies - math.floor(r.copies)), int(r.documents)) for r in plan.itertuples() if r.reachable], "source string, base int, prob double, documents long")
    units = sized.join(F.broadcast(part), "source")  # at most max_targets rows
    certain = units.where("prob = 0 AND base > 0").select("doc_id", "source", "tokens", F.col("base").cast("long").alias("copies"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / block)).cast("long")
    level = units.where("prob > 0").select("doc_id", "source", "tokens", "base", "prob", F.pmod(F.xxhash64("doc_id"), blocks).alias("block"))

    def fly(at: int):
        def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            rng = np.random.default_rng([seed, at, int(keys[1]), *str(keys[0]).encode()])
            order = rng.permutation(len(pdf))
            p = np.empty(len(pdf))
            p[order] = flight(pdf["prob"].to_numpy()[order], pdf["tokens"].to_numpy()[order], rng)
            return pdf.assign(prob=p)

        return run

    schema = "doc_id long, source string, tokens long, base int, prob double, block long"
    decided, at = None, 0
    most = max([int(-(-d // block)) for d in plan["documents"]] or [1])
    while True:
        flown = cut(level.groupBy("source", "block").applyInPandas(fly(at), schema), "flown")
        done = flown.where("prob = 0 OR prob = 1")
        decided = done if decided is None else decided.unionAll(done)
        open_ = flown.where("prob > 0 AND prob < 1")
        if most <= 1:
            break
        most = -(-most // (block // (2 * LANDING)))
        level = open_.withColumn("block", F.floor(F.col("block") / (block // (2 * LANDING))))
        at += 1

    # Landing: at most two documents a source, put where the source's tokens come closest.
    left = pd.DataFrame([tuple(r) for r in open_.collect()], columns=["doc_id", "source", "tokens", "base", "prob", "block"])
    landed: list[tuple[int, float]] = []
    for _, own in left.groupby("source"):
        goal_sum = float((own["prob"] * own["tokens"]).sum())
        best = min(range(1 << len(own)), key=lambda m: (abs(sum(t for k, t in enumerate(own["tokens"]) if m >> k & 1) - goal_sum), m))
        landed += [(int(d), float(best >> k & 1)) for k, d in enumerate(own["doc_id"])]
    if landed:
        final = spark.createDataFrame(landed, "doc_id long, landed double")
        decided = decided.unionAll(open_.join(F.broadcast(final), "doc_id").select("doc_id", "source", "tokens", "base", F.col("landed").alias("prob"), "block"))
    chosen = decided.select("doc_id", "source", "tokens", (F.col("base") + F.col("prob")).cast("long").alias("copies")).where("copies > 0")
    return certain.unionAll(chosen), plan


def shares(chosen: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """A row per target source: ``source, target_share, reachable, max_repeats, documents, copies, tokens, actual_share``."""
    spark = chosen.sparkSession
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    goals = spark.createDataFrame([(r.source, float(r.target_share), bool(r.reachable), int(r.max_repeats)) for r in plan.itertuples()], "source string, target_share double, reachable boolean, max_repeats int")
    rows = goals.join(got, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per target source
    return rows.withColumn("actual_share", F.coalesce(F.col("tokens") / total, F.lit(0.0)))
