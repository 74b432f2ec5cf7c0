"""Evaluation texts leaking into training text: spaced-seed hashing with verified overlaps.

Texts become word codes, free of case, punctuation, spacing and markup. A mask
such as ``1101011`` picks word positions of a window and ignores the others, so
a seed survives a changed word at an ignored position. Seeds of the test items
form a sorted table; the seeds of the corpus are joined with it where the
corpus is read, so the corpus isn't shuffled. Around the hits of a document
and an item a local word alignment, which lets words be changed, added or
dropped, finds the longest stretch with about one word in eight altered.
Items that share a turn of phrase compete: a stretch that another item explains
better, word for word, counts only if hardly a word of it is altered.

The item side is broadcast in blocks of at most ``block_words`` words. A larger
set of items takes more passes over the corpus, none of them larger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The masks; 1 takes a word, 0 ignores it. Items of fewer than SHORT words have the shorter masks as well.
MASKS = ("11111", "111011", "1101011", "1100111", "1111", "11011", "1011", "1101")
LONG_MASKS, SHORT = 4, 45

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|[­​-‍﻿]|(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
_WORD = re.compile(r"\d+(?:[.,]\d+)+|[^\W_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64()), ("matching", pa.float64())])


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, spacing, layout and markup."""
    if "<" in text or "&" in text or "-" in text or "­" in text or "​" in text:
        text = _MARKUP.sub(lambda m: " " if m[0][0] in "<&" else "", text)
    return _WORD.findall(text.lower())


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def _encode(texts: list[str | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """All word codes in a row, and where each text starts."""
    flat: list[int] = []
    start = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            flat.extend([codes[w] for w in words(t)])
        start[i + 1] = len(flat)
    return np.array(flat, dtype=np.uint64), start


def _seeds(flat: np.ndarray, owner: np.ndarray, mask: str, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of one mask and their positions; windows across two texts are left out."""
    span = len(mask)
    n = len(flat) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[span - 1 :])
    h = np.full(len(at), 0x9E3779B97F4A7C15 + which, dtype=np.uint64)
    for o, take in enumerate(mask):
        if take == "1":
            h = (h ^ flat[at + o]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h, at


def _covered(group: np.ndarray, d: np.ndarray, q: np.ndarray, span: np.ndarray, need: np.ndarray, width: int = 12) -> np.ndarray:
    """Which hits lie on diagonals where the hits of their group cover ``need`` words of the item or more.

    Diagonals are taken in overlapping pairs of bands, so words added or
    dropped on the way move a passage by up to a band without splitting it.
    ``span`` is the number of words that a hit covers.
    """
    band = (d - q) // width
    band -= band.min() - 1
    code = np.concatenate([(group << 42) + ((band - o) << 20) for o in (0, 1)])
    first, spans = np.concatenate([q, q]), np.concatenate([span, span])
    words_ = np.concatenate([(code + first + o)[spans > o] for o in range(int(span.max()))])
    pairs, n = np.unique(np.unique(words_) >> 20, return_counts=True)
    good = pairs[n >= need[pairs >> 22]]
    return np.isin(code >> 20, good).reshape(2, -1).any(0)


def stretch(doc: np.ndarray, item: np.ndarray, cost: float = 0.9) -> tuple[float, np.ndarray, np.ndarray]:
    """The best local alignment: its score, and the positions in ``item`` and ``doc`` of its matching words.

    A matching word counts 1, a changed, added or dropped one ``-cost``.
    """
    n, m = len(doc), len(item)
    slope = cost * np.arange(n + 1)
    rows = np.zeros((m + 1, n + 1), dtype=np.float32)
    for i in range(m):
        row, new = rows[i], rows[i + 1]
        np.maximum(row - cost, 0.0, out=new)
        np.maximum(new[1:], row[:-1] + np.where(doc == item[i], 1.0, -cost), out=new[1:])
        new[:] = np.maximum.accumulate(new + slope) - slope
    i, j = (int(x) for x in np.unravel_index(rows.argmax(), rows.shape))
    score = float(rows[i, j])
    at: list[tuple[int, int]] = []
    while i > 0 and j > 0 and rows[i, j] > 0:
        here, same = rows[i, j], doc[j - 1] == item[i - 1]
        if abs(here - (rows[i - 1, j - 1] + (1.0 if same else -cost))) < 1e-3:
            if same:
                at.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(here - (rows[i - 1, j] - cost)) < 1e-3:
            i -= 1
        else:
            j -= 1
    pos = np.array(at[::-1], dtype=np.int64).reshape(-1, 2)
    return score, pos[:, 0], pos[:, 1]


def faithful(q: np.ndarray, d: np.ndarray, rate: float, slack: float) -> tuple[int, int, int]:
    """The longest run ``first .. last`` of matching words, by words of the item, in which at most ``rate`` of the words, and ``slack`` more, are altered; with the altered ones counted.

    Words of the item that have no match are changed or dropped, words of the
    document between matches are changed or added; a change counts once.
    """
    if not len(q):
        return 0, -1, 0
    gap = np.maximum(np.diff(q), np.diff(d)) - 1
    lost = np.concatenate([[0], np.cumsum(gap)])  # altered words before each match
    # A run x..y is faithful if lost[y] - lost[x] <= rate * (q[y] - q[x] + 1) + slack.
    level = lost - rate * q
    best = (0, 0, 0)
    low = np.maximum.accumulate(level)  # the farther back a start may lie, the better the best level before it
    for y in range(len(q)):
        x = int(np.searchsorted(low[: y + 1], level[y] - rate - slack - 1e-9))
        x = min(x, y)
        if q[y] - q[x] > q[best[1]] - q[best[0]]:
            best = (x, y, int(lost[y] - lost[x]))
    return best


class ItemSeeds:
    """The seed table of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.codes = _Codes()
        self.ids = np.array(ids, dtype=np.int64)
        self.flat, self.start = _encode(texts, self.codes)
        sizes = np.diff(self.start)
        owner = np.repeat(np.arange(len(ids)), sizes)
        self.tables = []
        for k, mask in enumerate(MASKS):
            h, at = _seeds(self.flat, owner, mask, k)
            if k >= LONG_MASKS and len(at):
                short = sizes[owner[at]] < SHORT
                h, at = h[short], at[short]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            item = owner[at] if len(at) else at
            known = np.zeros(1 << 20, dtype=bool)  # most words of a corpus end here
            known[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, h, item, at - self.start[item] if len(at) else at, known))
        self.codes = _Codes()  # workers fill their own

    def matches(self, flat: np.ndarray, start: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The join of all seeds, not unfolded: mask, position in the texts, first row of the table and number of rows."""
        owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
        out = []
        for k, (mask, hashes, _, _, known) in enumerate(self.tables):
            if not len(hashes):
                continue
            h, at = _seeds(flat, owner, mask, k)
            got = np.flatnonzero(known[(h >> np.uint64(44)).astype(np.int64)]) if len(h) else at
            h, at = h[got], at[got]
            lo = np.searchsorted(hashes, h)
            n = np.searchsorted(hashes, h, side="right") - lo
            out.append((k, at[n > 0], lo[n > 0], n[n > 0]))
        return out

    def hits(self, flat: np.ndarray, start: np.ndarray, bound: int = 4_000_000) -> Iterator[tuple[np.ndarray, ...]]:
        """The seeds' hits in blocks of whole (text, item) pairs: text, item, word in the text, word in the item, words covered.

        A seed that many items share, in a text or batch full of it, would
        unfold to any number of hits. Texts are therefore taken in runs of at
        most ``bound`` hits, and a text with more of them in blocks of items.
        """
        found = self.matches(flat, start)
        owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
        load = np.zeros(len(start) - 1, dtype=np.int64)
        for _, at, _, n in found:
            load += np.bincount(owner[at], weights=n, minlength=len(load)).astype(np.int64)
        total, runs, first = np.cumsum(load), [], 0
        while first < len(load):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + bound, side="right")))
            blocks = max(1, -(-int(load[first:last].sum()) // bound))
            runs += [(first, last, x, blocks) for x in range(blocks)]
            first = last
        for first, last, block, blocks in runs:
            parts = []
            for k, at, lo, n in found:
                mask, _, items, pos, _ = self.tables[k]
                mine = (at >= start[first]) & (at < start[last])
                a, lo_, n_ = at[mine], lo[mine], n[mine]
                for x in range(0, len(a), max(1, bound // max(1, int(n_.max(initial=1))))) if blocks > 1 else [0]:
                    y = x + max(1, bound // max(1, int(n_.max(initial=1)))) if blocks > 1 else len(a)
                    aa, ll, nn = a[x:y], lo_[x:y], n_[x:y]
                    which = np.repeat(ll - np.concatenate([[0], np.cumsum(nn)[:-1]]), nn) + np.arange(nn.sum()) if len(aa) else ll
                    word = np.repeat(aa, nn)
                    if blocks > 1:
                        own = items[which] % blocks == block
                        which, word = which[own], word[own]
                    if len(which):
                        text = owner[word]
                        parts.append((text, items[which], word - start[text], pos[which], np.full(len(which), mask.count("1"))))
            if parts:
                yield tuple(np.concatenate(x) for x in zip(*parts))

    def leaks(self, texts: list[str | None], least: float, altered: float, slack: float, close: float, bound: int = 4_000_000) -> list[tuple[int, int, int, int, float, float]]:
        """Text, item, first and last leaked word of the text, share of the item's words, share of these that match."""
        flat, start = _encode(texts, self.codes)
        sizes = np.diff(self.start)
        got: dict[int, list[tuple]] = {}
        for text, item, dpos, ipos, span in self.hits(flat, start, bound):
            order = np.lexsort((dpos, item, text))
            text, item, dpos, ipos, span = text[order], item[order], dpos[order], ipos[order], span[order]
            lo = np.concatenate([[0], np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1])
            group = np.repeat(np.arange(len(lo)), np.diff(np.concatenate([lo, [len(text)]])))
            own = sizes[item[lo]]
            need = np.clip((0.5 * least * own).astype(int), np.clip(np.ceil(0.7 * least * own), 4, 8).astype(int), None)
            keep = _covered(group, dpos, ipos, span, need)
            text, item, dpos, ipos, group = text[keep], item[keep], dpos[keep], ipos[keep], group[keep]
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]) if len(text) else ():
                t, k = int(text[a]), int(item[a])
                query = self.flat[self.start[k] : self.start[k + 1]]
                size = len(query)
                d, q = dpos[a:b], ipos[a:b]
                best = None
                # Hits far apart in the text belong to different passages.
                gaps = np.flatnonzero(np.diff(d) > size) + 1
                for x, y in zip([0, *gaps.tolist()], [*gaps.tolist(), len(d)]):
                    # The passage can't begin before, or end behind, the item laid along its hits, but for added words.
                    w0 = max(0, int((d[x:y] - q[x:y]).min()) - size // 4)
                    doc = flat[start[t] + w0 : min(start[t + 1], start[t] + int((d[x:y] - q[x:y]).max()) + size + size // 4)]
                    _, qi, di = stretch(doc, query)
                    u, v, lost = faithful(qi, di, altered, slack)
                    length = int(qi[v] - qi[u] + 1) if v >= u else 0
                    same = v - u + 1
                    if same >= 5 and length >= least * size - 1e-9 and (best is None or same > best[4]):
                        best = (k, w0 + int(di[u]), w0 + int(di[v]), length / size, same, same / (same + lost))
                if best:
                    got.setdefault(t, []).append(best)
        out = []
        for t, found in got.items():
            for k, j0, j1, share, same, match in found:
                # A phrase that another item's stretch holds more faithfully is that item's, unless hardly a word of it is altered.
                better = any(o[0] != k and o[5] > match and o[4] > same and min(j1, o[2]) - max(j0, o[1]) + 1 >= 0.5 * (j1 - j0 + 1) for o in found) if match < close else False
                if not better:
                    out.append((t, k, j0, j1, share, match))
        return out


def leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least_share: float = 0.3, altered: float = 0.125, slack: float = 1.0, close: float = 0.9, block_words: int = 1_000_000,
) -> DataFrame:
    """Documents and the items that leaked into them: ``doc_id, item_id, first_word, last_word, share, matching``.

    A pair comes out where a stretch of at least ``least_share`` of the item's
    words stands in the document, with at most ``altered`` of its words, and
    ``slack`` word more, changed, added or dropped; only the stretch with most
    matching words is told, with the share of words that match. Where two
    items' stretches share half of their place in a document, the one with
    fewer matching words and a smaller share of them counts only from a share
    of ``close`` on. One pass over the documents for each block of items; no
    shuffle but that of the pairs.

    NULL and blank texts, on either side, match nothing. A stretch needs five
    matching words, so items of fewer words match nothing, nor does a third of
    an item of fewer than 15 words; items of fewer than 45 words are searched
    with shorter seeds. Rows without key are left out. Repeated documents each
    come out under their own key; repeated rows of one key come out once.
    Very long texts are aligned only in windows around hits. Empty tables give
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t"))
    total = keyed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (block_words * 4)))
    side = docs.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t"))
    out = None
    for block in range(blocks):
        rows = keyed.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).distinct().orderBy("k", "t").collect()  # at most about block_words words
        shared = spark.sparkContext.broadcast(ItemSeeds([r.k for r in rows], [r.t for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds: ItemSeeds = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    keys = part.column(0).to_pylist()
                    got = [(keys[t], int(seeds.ids[k]), j0, j1, s, x) for t, k, j0, j1, s, x in seeds.leaks(part.column(1).to_pylist(), least_share, altered, slack, close)]
                    if got:
                        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*got), _OUT)], schema=_OUT)

        found = side.mapInArrow(scan, "doc_id long, item_id long, first_word long, last_word long, share double, matching double")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "matching", "first_word", "last_word")).alias("b")).select("doc_id", "item_id", "b.first_word", "b.last_word", "b.share", "b.matching")
