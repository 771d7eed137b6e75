"""Evaluation texts inside a corpus: q-gram lemma filter in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.runtime import Scratch, ship

ship(__name__)

Q = 12
BAND = 16
"""Bands are 2 x BAND diagonals wide and start every BAND, so a match that drifts by at most BAND lies whole in one."""
_WORD = re.compile("[a-z0-9]+")
_SLOTS = 22
_CHUNK = 4 << 20
_HITS = 1 << 24


def _plain(text: str | None) -> bytes:
    """The words of a text, lower-cased, each with a blank before and after."""
    return (" " + " ".join(_WORD.findall(text.lower())) + " ").encode() if text else b" "


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes at every position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    code = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8 : Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class ItemIndex:
    """Q-grams of a block of items and, per item, the windows of a fixed number of words."""

    ids: list
    texts: list[np.ndarray]
    starts: list[np.ndarray]
    ends: list[np.ndarray]
    need: list[np.ndarray]
    least: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filled: np.ndarray
    edits: int


def build_index(items: list[tuple[object, str | None]], words: int, edits: int) -> ItemIndex:
    """A window of length L that keeps within e edits shares at least L-Q+1-Q*e q-grams; short windows allow fewer edits."""
    ids, texts, starts, ends, need, least, codes, item, at = [], [], [], [], [], [], [], [], []
    for item_id, text in items:
        data = np.frombuffer(_plain(text), np.uint8)
        blanks = np.flatnonzero(data == 32)
        if len(blanks) <= words:
            continue
        s, e = blanks[:-words], blanks[words:] + 1
        budget = np.minimum(edits, np.maximum(0, (e - s - Q) // Q))
        share = np.maximum(1, e - s - Q + 1 - Q * budget)
        c = _grams(data)
        codes.append(c)
        item.append(np.full(len(c), len(ids), np.int32))
        at.append(np.arange(len(c), dtype=np.int32))
        ids.append(item_id)
        texts.append(data)
        starts.append(s)
        ends.append(e)
        need.append(share)
        least.append(int(share.min()))
    if not ids:
        none = np.zeros(0, np.int64)
        return ItemIndex([], [], [], [], [], none, none.astype(np.uint64), none, none, none, np.zeros(1 << _SLOTS, bool), edits)
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    unique, first = np.unique(code[order], return_index=True)
    filled = np.zeros(1 << _SLOTS, bool)
    filled[(unique >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
    return ItemIndex(
        ids, texts, starts, ends, need, np.array(least), unique, np.append(first, len(code)), np.concatenate(item)[order],
        np.concatenate(at)[order], filled, edits,
    )


def _aligned(windows: list[np.ndarray], starts: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray, low: np.ndarray, width: int, most: int) -> np.ndarray:
    """Edits between every window, at ``starts`` of its item, and its best place in its text on ``width`` diagonals from low.

    One banded dynamic programme for all windows at once: a row of costs per window, a column per diagonal. Windows that need more than
    ``most`` edits get some larger number.
    """
    sizes = np.array([len(w) for w in windows])
    order = np.argsort(-sizes, kind="stable")
    padded = np.zeros((len(windows), int(sizes.max())), np.uint8)
    for row, i in enumerate(order):
        padded[row, : sizes[i]] = windows[i]
    sizes, starts, begin, length, low = sizes[order], starts[order], begin[order], length[order], low[order]
    slope = np.arange(width, dtype=np.int16)
    cost = np.zeros((len(windows), width), np.int16)
    j = (low + starts)[:, None] + slope
    out = np.full(len(windows), 1 << 14, np.int64)
    for i in range(padded.shape[1]):
        alive = int(np.searchsorted(-sizes, -i, side="left"))  # windows longer than i
        if i % 12 == 0 or alive < len(sizes):
            # those at their end, and those beyond the budget, which never come back, are done with
            least = cost.min(1)
            out[order[alive:]] = least[alive:]
            going = np.flatnonzero(least[:alive] <= most)
            order, sizes, padded, begin, length, cost, j = (x[going] for x in (order, sizes, padded, begin, length, cost, j))
            alive = len(going)
            if not alive:
                return out
        at = j + i
        inside = (at >= 0) & (at < length[:, None])
        miss = data[begin[:, None] + np.where(inside, at, 0)] != padded[:, i : i + 1]
        step = cost + (miss | ~inside)
        np.minimum(step[:, :-1], cost[:, 1:] + np.int16(1), out=step[:, :-1])
        step -= slope
        np.minimum.accumulate(step, axis=1, out=step)
        cost = step + slope
    out[order] = cost.min(1)
    return out


def _stands(index: ItemIndex, item: int, windows: np.ndarray, hits: np.ndarray, on: np.ndarray, text: np.ndarray) -> bool:
    """Whether one of the windows, whose q-grams all occur in the band, stands in the text as it is: the alignment without an edit."""
    own = index.texts[item]
    for w in windows.tolist():
        s, e = int(index.starts[item][w]), int(index.ends[item][w])
        for d in on[np.searchsorted(hits, s) : np.searchsorted(hits, s, side="right")].tolist():
            if s + d >= 0 and np.array_equal(text[s + d : e + d], own[s:e]):
                return True
    return False


def find_leaks(index: ItemIndex, texts: list[str | None], most_hits: int = _HITS) -> list[tuple[int, int, int]]:
    """(text, item, edits) for every text that holds a window of an item within the edit budget; fewest edits first tried.

    Texts that share more than ``most_hits`` q-grams with the items are looked at in parts: fewer texts at a time, then stretches of one
    text that overlap by more than the longest window, so that memory stays bounded whatever repeats.
    """
    reach = 2 * (max((int((e - s).max()) for s, e in zip(index.starts, index.ends, strict=True)), default=0) + index.edits + Q + 2 * BAND)
    best: dict[tuple[int, int], int] = {}
    todo = [(np.arange(len(texts)), [_plain(t) for t in texts])]
    while todo:
        of, plain = todo.pop()
        found = _leaks(index, plain, most_hits if len(plain) > 1 or len(plain[0]) > 4 * reach else None) if plain else []
        if found is not None:
            for t, i, n in found:
                best[int(of[t]), i] = min(n, best.get((int(of[t]), i), n))
        elif len(plain) > 1:
            half = len(plain) // 2
            todo += [(of[:half], plain[:half]), (of[half:], plain[half:])]
        else:
            half = len(plain[0]) // 2
            todo += [(of, [plain[0][: half + reach]]), (of, [plain[0][half:]])]
    return [(t, i, n) for (t, i), n in best.items()]


def _leaks(index: ItemIndex, plain: list[bytes], most_hits: int | None) -> list[tuple[int, int, int]] | None:
    """find_leaks of texts as plain bytes; None where they share more q-grams with the items than ``most_hits``."""
    lengths = np.array([len(p) + 1 for p in plain])
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"\0".join(plain) + b"\0", np.uint8)
    if not len(index.codes) or len(data) < Q:
        return []
    codes = _grams(data)
    place = np.flatnonzero(index.filled[(codes >> np.uint64(64 - _SLOTS)).astype(np.int64)])
    code = codes[place]
    slot = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
    hit = index.codes[slot] == code
    place, slot = place[hit], slot[hit]
    if not len(place):
        return []
    many = index.first[slot + 1] - index.first[slot]
    total = int(many.sum())
    if most_hits is not None and total > most_hits:
        return None
    source = np.repeat(index.first[slot] - (np.cumsum(many) - many), many) + np.arange(total)
    place = np.repeat(place, many)
    item, at = index.item[source], index.at[source]
    text = np.searchsorted(begins, place, side="right") - 1
    diagonal = place - begins[text] - at
    band = np.floor_divide(diagonal, BAND)
    band = np.concatenate([band, band - 1])
    text, item, at, diagonal = (np.tile(x, 2) for x in (text, item, at, diagonal))
    order = np.lexsort((at, band, item, text))
    text, item, band, at, diagonal = text[order], item[order], band[order], at[order], diagonal[order]
    begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
    size = np.diff(np.append(begin, len(text)))
    # a band whose hits, like those of the band before it, all lie on the diagonals the two share, holds nothing else
    low, high, t, i, b = np.minimum.reduceat(diagonal, begin), np.maximum.reduceat(diagonal, begin), text[begin], item[begin], band[begin]
    again = np.zeros(len(begin), bool)
    again[1:] = (t[1:] == t[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1] + 1) & (low[:-1] >= BAND * b[1:]) & (high[1:] < BAND * (b[1:] + 1))
    keep = ~again & (size >= index.least[i])
    begin, size, t, i, b = begin[keep], size[keep], t[keep], i[keep], b[keep]
    best: dict[tuple[int, int], int] = {}
    tries: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for one in np.unique(i).tolist():
        groups = np.flatnonzero(i == one)
        s, e, size_of = index.starts[one], index.ends[one] - Q + 1, len(index.texts[one]) + 1
        step = max(1, (1 << 22) // size_of)
        for lo in range(0, len(groups), step):
            part = groups[lo : lo + step]
            spot = np.repeat(begin[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(int(size[part].sum()))
            seen = np.zeros((len(part), size_of), np.int32)
            seen[np.repeat(np.arange(len(part)), size[part]), at[spot] + 1] = 1
            count = np.cumsum(seen, axis=1)
            shared = count[:, e] - count[:, s]
            enough = shared >= index.need[one]
            # an edit breaks only q-grams that start within Q places of each other: cover the missing ones greedily
            some = np.flatnonzero(enough.any(1))
            missing = np.where(seen[some, 1:] == 0, np.arange(size_of - 1, dtype=np.int32), np.int32(1 << 30))
            after = np.full((len(some), size_of + Q), 1 << 30, np.int32)
            after[:, : size_of - 1] = np.minimum.accumulate(missing[:, ::-1], axis=1)[:, ::-1]
            gap = after[:, s]
            for _ in range(index.edits):
                gap = np.where(gap < e, np.take_along_axis(after, np.minimum(gap, size_of - 1) + Q, 1), gap)
            enough[some] &= gap >= e
            for row in np.flatnonzero(enough.any(1)).tolist():
                g = part[row]
                pair = (int(t[g]), one)
                if best.get(pair) == 0:
                    continue
                windows = np.flatnonzero(enough[row])
                hits, on = at[begin[g] : begin[g] + size[g]], diagonal[begin[g] : begin[g] + size[g]]
                if _stands(index, one, windows[(e - s)[windows] == shared[row, windows]], hits, on, data[begins[t[g]] : begins[t[g]] + lengths[t[g]]]):
                    best[pair] = 0
                    tries.pop(pair, None)
                    continue
                tries.setdefault(pair, []).extend((int(n), w, int(b[g])) for n, w in zip((e - s - shared[row])[windows], windows.tolist(), strict=True))
    for windows in tries.values():
        windows.sort()
    turn, open_ = 0, list(tries)
    while open_:
        # a pair's windows by missing q-grams: one, then the next eight, then 64 at a time, until one is within its budget
        few = 1 if turn == 0 else 8 if turn == 1 else 64
        work = [(pair, *w) for pair in open_ for w in tries[pair][turn : turn + few]]
        for lo in range(0, len(work), 2048):
            part = work[lo : lo + 2048]
            t, i = np.array([p[0][0] for p in part]), [p[0][1] for p in part]
            s = np.array([index.starts[x][p[2]] for x, p in zip(i, part, strict=True)])
            e = np.array([index.ends[x][p[2]] for x, p in zip(i, part, strict=True)])
            own = [index.texts[x][y:z] for x, y, z in zip(i, s, e, strict=True)]
            low = np.array([p[3] for p in part]) * BAND - index.edits
            got = _aligned(own, s, data, begins[t], lengths[t] - 1, low, 2 * BAND + 2 * index.edits + 1, index.edits)
            for k in np.flatnonzero(got <= np.minimum(index.edits, np.maximum(0, (e - s - Q) // Q))).tolist():
                pair = part[k][0]
                best[pair] = min(int(got[k]), best.get(pair, 1 << 20))
        turn += few
        open_ = [p for p in open_ if len(tries[p]) > turn and (p not in best or best[p] and not tries[p][turn][0])]
    return [(t, i, n) for (t, i), n in best.items()]


def _scan(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(**held.value)
        for b in batches:
            texts, ids, lo = b["text"].tolist(), b["id"].tolist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= _CHUNK):
                    size += len(texts[hi] or "")
                    hi += 1
                found = find_leaks(index, texts[lo:hi])
                yield pd.DataFrame({"id": [ids[lo + t] for t, _, _ in found], "item": [index.ids[i] for _, i, _ in found], "edits": [e for _, _, e in found]})
                lo = hi

    return run


def leaked_items(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 15, edits: int = 3,
    block_chars: int = 2 << 20,
) -> DataFrame:
    """doc_id, item_id, edits for every document that holds ``words`` consecutive words of an item within ``edits`` character edits.

    Texts are compared as runs of a-z and 0-9 after lower-casing. The documents are scanned once, whole and without a
    shuffle. Items are broadcast in blocks of at most ``block_chars`` characters (at least one item); more items than
    fit into one block mean more scans, not a larger broadcast. edits = 0 means the words stand there exactly: if any
    window does, it shares all its q-grams and is aligned first. A reported number above 0 is that of the best window tried.

    Defined cases: null, empty and wordless texts leak nothing, nor do items of fewer than ``words`` words; every item
    and document stands for itself, repeated or not; empty tables give no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    ids = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    schema = f"id {dict(docs.dtypes)['id']}, item {dict(ids.dtypes)['item']}, edits int"
    done: list[DataFrame] = []
    block: list[tuple[object, str | None]] = []
    size = 0

    def scan() -> DataFrame:
        return docs.mapInPandas(_scan(spark.sparkContext.broadcast(vars(build_index(block, words, edits)))), schema)  # plain arrays, which need no package on the worker

    for row in ids.toLocalIterator():
        if block and size + len(row["text"] or "") > block_chars:
            done.append(scratch.cut(scan()))
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"] or "")
    found = reduce(DataFrame.unionByName, [*done, scan()])
    return found.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "edits")
