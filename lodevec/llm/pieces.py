"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass over the text.

The automaton reports, at each position, every piece that ends there, longest first, along its output links. Each report
relaxes the best score of that position: the score of the piece's start plus the piece's own, if the step is allowed.
What is allowed is the model's own rule:

- unigram models: every step, so the pass finds the largest sum of scores;
- BPE models: steps between pieces that merging leaves apart. By merges a piece is right exactly if the encoding of what
  comes before ends in a piece that stays apart from it, so the best allowed way is the one that merge-by-merge encoding
  ends in, and the pass gives its ids without merging.

Whether two pieces stay apart is read off their merge trees: their last merges are undone in turn, and no pair met at the
border on the way may be one that would have merged before the merge undone last.

Texts are cut at white-space marks before the pass where no piece crosses them. The cuts of some texts that are not known
yet go through the pass side by side, lots of bounded size, a position at a time, as arrays; very long cuts go through
the same pass one by one. Known cuts are kept up to a bounded number, their ids packed as bytes. Characters without a
piece become byte pieces (or the unknown piece).
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field, replace
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = 1 << 40
#: Characters of the cuts that go side by side, and bytes of the texts that are cut in one go: what a worker holds at once.
LOT_CHARS, STRETCH_BYTES = 1 << 18, 1 << 20


@dataclass(frozen=True)
class PieceModel:
    """pieces, scores, types: by id; unigram: which rule holds; prefix: whether a text gets a mark in front.

    known: cuts that a coder keeps before it begins anew, with the last lot beside them; long: cuts from this length on
    go through the pass alone and aren't kept.
    """

    pieces: tuple[str, ...] = field(repr=False)
    scores: tuple[float, ...] = field(repr=False)
    types: tuple[int, ...] = field(repr=False)
    unigram: bool = False
    prefix: bool = True
    known: int = 100_000
    long: int = 128
    trees: tuple[np.ndarray, ...] | None = field(default=None, repr=False)

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a .model file on the driver. Models whose normaliser changes texts are turned down."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(Path(path).read_bytes())
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError(f"only models with the identity normaliser that keep white space are supported: {m.normalizer_spec.name}")
        if m.trainer_spec.model_type not in (1, 2) or any(p.type == USER for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        model = PieceModel(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces), m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix)
        return model if model.unigram else replace(model, trees=merge_trees(model))


def merge_trees(m: PieceModel) -> tuple[np.ndarray, ...]:
    """How merging makes each piece: (rank, left, right, whole, odd, pairs, pair_ranks); made once, on the driver.

    rank: place in the order of merges, -1 for characters; left, right: the parts of the last merge; whole: whether
    merging a piece's text gives that piece; odd: whether a part doesn't rank before what it is merged into (runs of
    marks, all of one score), so that ranks don't tell the order. pairs: left * pieces + right of all two pieces that
    can merge, sorted, and the ranks of what they make.
    """
    ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == NORMAL}
    n = len(m.pieces)
    rank, left, right, whole = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    falling = {s: k for k, s in enumerate(sorted({m.scores[i] for p, i in ids.items() if len(p) > 1}, reverse=True))}
    pairs, made = [], []
    for p, i in ids.items():
        if len(p) > 1:
            rank[i] = falling[m.scores[i]]
        parts, last = merged(p, ids, m.scores)
        whole[i] = parts == [i]
        if whole[i] and last:
            left[i], right[i] = last
        for k in range(1, len(p)):
            x, y = ids.get(p[:k]), ids.get(p[k:])
            if x is not None and y is not None:
                pairs.append(x * n + y)
                made.append(rank[i])
    order = np.argsort(np.array(pairs, np.int64))
    inner, odd = left >= 0, np.zeros(n, bool)
    odd[inner] = (rank[left[inner]] >= rank[inner]) | (rank[right[inner]] >= rank[inner])
    while (more := inner & ~odd & (odd[left] | odd[right])).any():
        odd |= more
    return rank, left, right, whole, odd, np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]


def merged(text: str, ids: dict[str, int], scores: tuple[float, ...]) -> tuple[list[int], tuple[int, int] | None]:
    """Merge by merge, the rule itself: the pieces (-1 for none) and the two that the last merge joined."""
    parts, last = list(text), None
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap: list = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (k := ids.get(parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (-scores[k], i, parts[i], parts[after[i]]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if parts[i] != x or j < 0 or parts[j] != y:
            continue
        last = ids.get(x, -1), ids.get(y, -1)
        parts[i], parts[j], after[i] = x + y, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ids.get(p, -1) for p in parts if p], last


class Lookup:
    """Whole numbers by whole numbers, 0 and up, for arrays: open addressing, -1 for what isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = np.flatnonzero(self.keys[at] != keys)  # of several at one free place the last one has it
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            out[left] = np.where(found == keys[left], self.values[at[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return out


class Automaton:
    """Aho-Corasick over the pieces, as arrays: piece of each state (-1: none), fail and output links, steps by character."""

    def __init__(self, ids: dict[str, int]):
        steps: list[dict[str, int]] = [{}]
        piece = [-1]
        for text, i in ids.items():
            at = 0
            for c in text:
                if c not in steps[at]:
                    steps[at][c] = len(steps)
                    steps.append({})
                    piece.append(-1)
                at = steps[at][c]
            piece[at] = i
        fail, out = [0] * len(steps), [0] * len(steps)
        level = list(steps[0].values())
        while level:
            for at in level:
                out[at] = fail[at] if piece[fail[at]] >= 0 else out[fail[at]]
                for c, to in steps[at].items():
                    back = fail[at]
                    while back and c not in steps[back]:
                        back = fail[back]
                    fail[to] = steps[back].get(c, 0)
            level = [to for at in level for to in steps[at].values()]
        self.piece, self.fail, self.out = (np.array(x, np.int64) for x in (piece, fail, out))
        self.steps = Lookup(np.array([(at << 21) + ord(c) for at, x in enumerate(steps) for c in x], np.int64), np.array([to for x in steps for to in x.values()], np.int64))

    def after(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that characters lead to, along fail links where there is no step."""
        to = self.steps.get((state << 21) + char)
        left = np.flatnonzero((to < 0) & (state > 0))
        state, char = state[left], char[left]
        while len(left):
            state = self.fail[state]
            to[left] = found = self.steps.get((state << 21) + char)
            going = np.flatnonzero((found < 0) & (state > 0))
            left, state, char = left[going], state[going], char[going]
        return np.maximum(to, 0)


class PieceCoder:
    """Encodes and decodes with one model; built once in each task."""

    def __init__(self, model: PieceModel):
        self.model = m = model
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(m.types) if t == UNKNOWN), 0)
        self.automaton = Automaton(self.ids)
        lone = [p for p in self.ids if len(p) == 1]
        chars = {c for p in self.ids for c in p}
        if chars - set(lone) and not m.unigram:
            raise ValueError("a BPE model needs each character of a piece as a piece")
        self.lone = np.zeros(0x110000, bool)
        self.lone[[ord(c) for c in lone]] = True
        # Place n stands for a character without a piece.
        self.missing = n = len(m.pieces)
        self.length = np.ones(n + 1, np.int64)
        self.length[list(self.ids.values())] = [len(p) for p in self.ids]
        self.score = np.array([*m.scores, min((m.scores[i] for i in self.ids.values()), default=0.0) - 10])
        self.pairs = Lookup(*m.trees[5:]) if m.trees else None
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        # White space without a piece stands alone as well, so it may end a cut.
        breaks = "".join(c for c in "\n\t\r" if c not in chars)
        ends = f"{MARK}{breaks}"
        self.cuts = None if crossing else re.compile(f"{MARK}+[^{ends}]*|[^{ends}]+" + f"|[{breaks}]" * bool(breaks))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.strange: dict[tuple[int, int], bool] = {}
        # Byte pieces decode through escapes, so that a run of them is read as UTF-8 at the end.
        self.shown = [chr(int(p[3:5], 16) + (0xDC00 if int(p[3:5], 16) > 127 else 0)) if t == BYTE else p if t == NORMAL else " ⁇ " if t == UNKNOWN else "" for p, t in zip(m.pieces, m.types)]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves y whole and apart from x before it, for arrays of pieces (x = -1: nothing before)."""
        rank, left, right, whole, odd = self.model.trees[:5]
        n, out = self.missing, np.ones(len(y), bool)
        own = y != n
        out[own] = whole[y[own]]
        at = np.flatnonzero(own & out & (x >= 0) & (x != n))
        strange = odd[x[at]] | odd[y[at]]
        for i in at[strange].tolist():
            out[i] = self.apart_merged(int(x[i]), int(y[i]))
        at = at[~strange]
        a, b, before = x[at], y[at], np.full(len(at), NEVER)
        while len(at):
            made = self.pairs.get(a * n + b)
            joins = (made >= 0) & (made < before)
            out[at[joins]] = False
            going = np.flatnonzero(~joins & ((left[a] >= 0) | (left[b] >= 0)))
            at, a, b = at[going], a[going], b[going]
            # The later merge is undone; of two equal ones the left one came first. A pair at the border merges before
            # an equal merge to its right, and after one to its left.
            by_left = rank[a] > rank[b]
            before = np.where(by_left, rank[a], rank[b] + 1)
            a, b = np.where(by_left, right[a], a), np.where(by_left, b, left[b])
        return out

    def apart_merged(self, x: int, y: int) -> bool:
        """The same by merging the two."""
        if (x, y) not in self.strange:
            if len(self.strange) > 10_000:
                self.strange.clear()
            self.strange[x, y] = merged(self.model.pieces[x] + self.model.pieces[y], self.ids, self.model.scores)[0] == [x, y]
        return self.strange[x, y]

    def spelled(self, char: str) -> list[int]:
        """A character without a piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]

    def side_by_side(self, cuts: list[str]) -> list[np.ndarray]:
        """The pass over many cuts at once, a character of each at a time; cuts come by falling length."""
        text = "".join(cuts)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        first = np.cumsum(size) - size  # of each cut's characters
        begin = first + np.arange(len(cuts))  # its places; there is one more place than characters
        going = np.cumsum(np.bincount(size)[::-1])[::-1]  # cuts of at least each length
        best, last = np.full(len(text) + len(cuts), -np.inf), np.full(len(text) + len(cuts), -1)
        best[begin] = 0.0
        state = np.zeros(len(cuts), np.int64)
        auto = self.automaton

        def relax(end: np.ndarray, piece: np.ndarray) -> None:
            start = end - self.length[piece]
            there = np.flatnonzero(best[start] > -np.inf)
            end, piece, start = end[there], piece[there], start[there]
            if self.pairs is not None:
                allowed = np.flatnonzero(self.apart(last[start], piece))
                end, piece, start = end[allowed], piece[allowed], start[allowed]
            total = best[start] + self.score[piece]
            better = np.flatnonzero(total > best[end])
            best[end[better]], last[end[better]] = total[better], piece[better]

        for t in range(1, len(going)):
            n = going[t]
            char = chars[first[:n] + (t - 1)]
            state = auto.after(state[:n], char)
            bare = np.flatnonzero(~self.lone[char])
            if len(bare):
                relax(begin[bare] + t, np.full(len(bare), self.missing))
            found = np.where(auto.piece[state] >= 0, state, auto.out[state])
            rows = np.flatnonzero(found)
            found = found[rows]
            while len(rows):
                relax(begin[rows] + t, auto.piece[found])
                found = auto.out[found]
                more = np.flatnonzero(found)
                rows, found = rows[more], found[more]
        # Back from the ends, a piece of every cut at a time.
        owner, at, places = np.arange(len(cuts)), begin + size, []
        while len(owner):
            p = last[at]
            at = at - self.length[p]
            places.append((owner, at, p))
            more = at > begin[owner]
            owner, at = owner[more], at[more]
        owner, at, p = (np.concatenate(x) for x in zip(*places))
        order = np.argsort(at)
        owner, at, p = owner[order], at[order], p[order]
        stops = np.searchsorted(owner, np.arange(len(cuts) + 1)).tolist()
        out = [p[lo:hi] for lo, hi in zip(stops[:-1], stops[1:])]
        for k in np.unique(owner[p == self.missing]).tolist():
            chars = (at[stops[k] : stops[k + 1]] - k).tolist()
            out[k] = np.array([*chain.from_iterable([i] if i != self.missing else self.spelled(text[c]) for i, c in zip(out[k].tolist(), chars))])
        return out

    def alone(self, text: str) -> tuple[int, ...]:
        """The pass over one long cut, a report at a time."""
        reports = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.ids.items():
            if p in text:
                reports.add_word(p, i)
        reports.make_automaton()
        bare = ((k, self.missing) for k, c in enumerate(text) if not self.lone[ord(c)])
        found = heapq.merge(reports.iter(text) if len(reports) else (), bare, key=lambda x: x[0])
        best, last, length, score = [0.0] + [-np.inf] * len(text), [-1] * (len(text) + 1), self.length.tolist(), self.score.tolist()
        stays: dict[tuple[int, int], bool] = {}
        for end, p in found:
            end += 1
            start = end - length[p]
            if best[start] + score[p] > best[end]:
                pair = last[start], p
                if self.pairs is not None and pair not in stays:
                    if len(stays) > 100_000:
                        stays.clear()
                    stays[pair] = bool(self.apart(np.array(pair[:1]), np.array(pair[1:]))[0])
                if self.pairs is None or stays[pair]:
                    best[end], last[end] = best[start] + score[p], p
        out, at = [], len(text)
        while at:
            p = last[at]
            at -= length[p]
            out += [p] if p != self.missing else self.spelled(text[at])[::-1]
        return tuple(out[::-1])

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts, each text's as packed 32-bit numbers."""
        front = MARK if self.model.prefix else ""
        cuts = [(self.cuts.findall(marked) if self.cuts else [marked]) if len(marked := front + x.replace(" ", MARK)) > len(front) else [] for x in texts]
        here = set(chain.from_iterable(cuts))
        if len(self.known) > self.model.known:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update((x, older[x]) for x in here if x not in known and x in older)
        new = sorted((x for x in here if x not in known), key=len, reverse=True)
        many = next((k for k, x in enumerate(new) if len(x) < self.model.long), len(new))
        known.update((x, np.array(self.alone(x), np.int32).tobytes()) for x in new[:many])
        upto = np.cumsum([len(x) for x in new[many:]])
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LOT_CHARS, "right")))
            lot = new[many + lo : many + hi]
            known.update((x, ids.astype(np.int32).tobytes()) for x, ids in zip(lot, self.side_by_side(lot)))
            lo = hi
        out = [b"".join(map(known.__getitem__, own)) for own in cuts]
        for x in new[:many]:
            del known[x]
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of some texts."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed_all(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        if len(self.bytes) == 256:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


def stretches(column: pa.Array, most: int = STRETCH_BYTES) -> list[tuple[int, int]]:
    """Runs of rows of a text column with about so many bytes; a longer row comes alone."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])
    cuts = [0]
    while cuts[-1] < len(column):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + most, "right")) - 1))
    return list(zip(cuts[:-1], cuts[1:]))


def encoded(docs: DataFrame, model: PieceModel, keep: list[str] = ["doc_id"], decode: bool = False) -> DataFrame:
    """The columns in keep, ids (array of int) and n_ids of every row; with decode also decoded, read back from the ids.

    Null and empty texts have no ids and decode to the empty text. A text that holds the mark U+2581 itself decodes with
    spaces in its place, as the format has it. Rows are taken one by one, so repeated rows and null keys stay.
    """
    fields = docs.select(*keep).schema
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        coder = PieceCoder(model)
        for batch in batches:
            for lo, hi in stretches(batch.column(len(keep))):
                part = batch.slice(lo, hi - lo)
                ids = coder.packed_all(part.column(len(keep)).to_pylist())
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                out = [*part.columns[: len(keep)], lists, pa.array(sizes)]
                if decode:
                    out.append(pa.array([coder.decode(np.frombuffer(x, np.int32).tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*names, "ids", "n_ids", "decoded"][: len(out)])

    schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, fields)) + "ids array<int>, n_ids long" + ", decoded string" * decode
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(tidy(run), schema)
    return out.toDF(*keep, *out.columns[len(keep) :])
