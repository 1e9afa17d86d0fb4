"""Byte-level BPE by speculation: propose tokens greedily, check every adjacent pair, merge the rest.

A token sequence is what the merges give exactly when no merge would ever cross a border between
two of its tokens. While two tokens are built up, the pieces beside their border are the right
edge of one and the left edge of the other; a merge crosses if one of these edge pairs merges
before either piece is taken up by its own token. That test is a table lookup, done with numpy for
all adjacent pairs of many words at once. Only words with a crossing are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import give_back

RUN_CHARS = 1_000_000
#: Chunks kept between runs; beyond so many in all, only those that came again since, and those that the run at hand needs.
CACHED = 300_000
_SPACE = r"\p{White_Space}"
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|"
           rf"{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+")
_SHORT = 64  # bytes of a word up to which it is merged together with others, not on its own with a heap
_TOGETHER = 5_000
_NEVER = np.iinfo(np.int32).max
_SIGNS = tuple(".,:;!?")
_LOADED: dict[str, "Vocabulary"] = {}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge tables of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        back = {ord(c): b for b, c in self.letters.items()}
        ids = spec["model"]["vocab"]
        self.size = max(ids.values()) + 1
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[ord(c)] for c in t) for t, i in ids.items() if t not in self.added}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.byte_id = {c: ids[c] for c in self.letters.values()}
        self.letter_id = np.full(max(map(ord, self.byte_id)) + 1, -1, np.int64)
        self.letter_id[[ord(c) for c in self.byte_id]] = list(self.byte_id.values())
        self.numbers = np.array(range(self.size), object)  # one object a number, whatever lists it is in
        self.decimal = [str(i) for i in range(max([self.size, *[i + 1 for i in self.added.values()]]))]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[s]] for p in pairs], np.int64) for s in (0, 1))
        self.made = made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.pair, self.pair_rank = key[order], order.astype(np.int64)
        self.left_edge, self.left_limit = self._edge(left, made)
        self.right_edge, self.right_limit = self._edge(right, made)
        self.proposals = ahocorasick.Automaton()
        for t, i in ids.items():
            if t not in self.added:
                self.proposals.add_word(t, i)
        self.proposals.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.awkward = regex.compile(rf" {_SPACE}|{_SPACE} |^ | $")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        #: Of each chunk the ids joined by commas, and the bytes that they decode to.
        self.chunks: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.first: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        #: Those of the two that a later run needed again.
        self.again: tuple[set[str], set[str]] = (set(), set())

    def _edge(self, side: np.ndarray, made: np.ndarray) -> tuple[list, list]:
        """For each depth the outermost piece of every token, and the rank of the merge that takes it up."""
        child, rank = np.full(self.size, -1), np.full(self.size, _NEVER)
        child[made], rank[made] = side, np.arange(len(made))
        at, limit = np.arange(self.size), np.full(self.size, _NEVER)
        edges, limits = [], []
        while (at >= 0).any():
            edges.append(at)
            limits.append(limit)
            inner = np.where(at >= 0, child[at], -1)
            limit = np.where(inner >= 0, rank[at], _NEVER)
            at = inner
        return edges, limits

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a merge crosses the border between tokens ``a`` and ``b``."""
        bad = np.zeros(len(a), bool)
        for edge, limit in zip(self.right_edge, self.right_limit):
            x, live = edge[a], np.flatnonzero((edge[a] >= 0) & ~bad)
            if not len(live):
                break
            for edge_b, limit_b in zip(self.left_edge, self.left_limit):
                y = edge_b[b[live]]
                live = live[y >= 0]
                if not len(live):
                    break
                y = y[y >= 0]
                key = x[live] * self.size + y
                i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                r = self.pair_rank[i]
                bad[live] |= (self.pair[i] == key) & (r < limit[a[live]]) & (r <= limit_b[b[live]])
        return bad

    def merge(self, word: str) -> list[int]:
        """The tokens of a word of byte letters, merge by merge, the lowest rank and leftmost first."""
        ids = [self.byte_id[c] for c in word]
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        queue = [(r[0], i, r[1], a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := self.rank.get((made, ids[after[i]])):
                    heapq.heappush(queue, (r[0], i, r[1], made, ids[after[i]]))
            if before[i] >= 0 and (r := self.rank.get((ids[before[i]], made))):
                heapq.heappush(queue, (r[0], before[i], r[1], ids[before[i]], made))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; pieces below 0 stand for none."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[i] == key) & (a >= 0) & (b >= 0), self.pair_rank[i], _NEVER)

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """``merge`` of many words of at most ``_SHORT`` letters: each round takes one merge in every word."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < size[:, None]] = self.letter_id[
            np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        ranks = np.full(ids.shape, _NEVER, np.int64)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        merged, of, cols = np.full(ids.shape, -1, np.int64), np.arange(len(words)), np.arange(width)
        while len(of):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(of)), at]
            live = low < _NEVER
            merged[of[~live]] = ids[~live]
            ids, ranks, of, at, low = ids[live], ranks[live], of[live], at[live], low[live]
            row = np.arange(len(of))
            ids[row, at] = self.made[low]
            closed = cols + (cols > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, closed, axis=1)
            ranks[:, :-1] = np.take_along_axis(ranks, closed, axis=1)
            ranks[row, at] = self._ranks(ids[row, at], ids[row, at + 1])
            inner, left = row[at > 0], at[at > 0]
            ranks[inner, left - 1] = self._ranks(ids[inner, left - 1], ids[inner, left])
        flat = self.numbers[merged[merged >= 0]].tolist()
        cuts = np.cumsum([0, *(merged >= 0).sum(axis=1)]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def speculate(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Tokens of each word (in byte letters), and how many words had to be merged step by step."""
        starts = np.cumsum([0, *[len(w) + 1 for w in words]])
        found = np.fromiter(chain.from_iterable(self.proposals.iter_long("\n".join(words))), np.int64).reshape(-1, 2)
        ids, of = found[:, 1], np.searchsorted(starts, found[:, 0], side="right") - 1
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        bad = self.crossing(pairs // self.size, pairs % self.size)[back]
        wrong = np.unique(of[inner[bad]]).tolist()
        cuts = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        flat = self.numbers[ids].tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        wrong.sort(key=lambda i: len(words[i]))  # so that words merged together are about as long
        for a in range(0, len(wrong), _TOGETHER):
            part = [i for i in wrong[a:a + _TOGETHER] if len(words[i]) <= _SHORT]
            for i, merged in zip(part, self.merge_many([words[i] for i in part]) if part else ()):
                out[i] = merged
        for i in wrong:
            if len(words[i]) > _SHORT:
                out[i] = self.merge(words[i])
        return out, len(wrong)

    def _pieces(self, chunk: str) -> list[str]:
        word = chunk[1:]  # mostly a space and letters, perhaps with a sign behind
        if chunk[:1] == " ":
            if word.isalpha():
                return [chunk]
            if word[-1:] in _SIGNS and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def learn(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        pieces = [self._pieces(c) for c in chunks]
        new = list(set(chain.from_iterable(pieces)))
        letters = self.letters
        found, _ = self.speculate([p.encode().decode("latin-1").translate(letters) for p in new]) if new else ([], 0)
        of = dict(zip(new, found))
        return [of[ps[0]] if len(ps) == 1 else [i for p in ps for i in of[p]] for ps in pieces]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids joined by commas, their number and the bytes they decode to.

        A text is cut at single spaces between other characters, where no word can lie across, so
        that a chunk is looked up once and kept; other texts are cut into words as a whole.
        """
        plans, inner, outer = [], set(), set()
        for t in texts:
            plan = []
            for part in self.split_added.split(t) if any(a in t for a in self.added) else (t,):
                if part in self.added:
                    plan.append((None, part))
                elif part:
                    cut = self.pattern.findall(part) if self.awkward.search(part) else None
                    if cut is None:
                        head, *rest = part.split(" ")
                        outer.add(head)
                        inner.update(rest)
                        plan.append((head, rest))
                    else:
                        outer.update(cut)
                        plan.append((cut, ()))
            plans.append(plan)
        if len(self.chunks[0]) + len(self.first[0]) > CACHED:
            stay = [need.intersection(kept[0]) for need, kept in ((inner, self.chunks), (outer, self.first))]
            if len(stay[0] | self.again[0]) + len(stay[1] | self.again[1]) <= CACHED:
                stay = [a | b for a, b in zip(stay, self.again)]
            self.chunks, self.first = (tuple({c: of[c] for c in some} for of in kept)
                                       for some, kept in zip(stay, (self.chunks, self.first)))
            self.again = set(), set()
        for again, need, kept in zip(self.again, (inner, outer), (self.chunks, self.first)):
            again.update(need.intersection(kept[0]))
        self._keep(self.chunks, inner, " ")
        self._keep(self.first, outer, "")
        (chunk_ids, chunk_bytes), (first_ids, first_bytes) = self.chunks, self.first
        for plan in plans:
            ids, raw = [], []
            for head, rest in plan:
                if head is None:
                    ids.append(self.decimal[self.added[rest]])
                    raw.append(self.bytes[self.added[rest]])
                elif isinstance(head, list):
                    ids += [first_ids[c] for c in head]
                    raw += [first_bytes[c] for c in head]
                else:
                    if head:
                        ids.append(first_ids[head])
                        raw.append(first_bytes[head])
                    ids += [chunk_ids[c] for c in rest]
                    raw += [chunk_bytes[c] for c in rest]
            one = ",".join(ids)
            yield one, one.count(",") + 1 if one else 0, b"".join(raw)

    def _keep(self, kept: tuple[dict[str, str], dict[str, bytes]], chunks: set[str], before: str) -> None:
        """Learn the chunks that are not yet kept; each is encoded with ``before`` ahead of it."""
        new = list(chunks.difference(kept[0]))
        found = self.learn([before + c for c in new])
        decimal, letters = self.decimal, self.bytes
        kept[0].update(zip(new, [",".join([decimal[i] for i in ids]) for ids in found]))
        kept[1].update(zip(new, [b"".join([letters[i] for i in ids]) for ids in found]))


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _coded(path: str, with_ids: bool):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        load = vocabulary(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            a = 0
            while a < len(texts):
                part, size = [], 0
                while a + len(part) < len(texts) and (not part or size < RUN_CHARS):
                    part.append(texts[a + len(part)].as_py() or "")
                    size += len(part[-1])
                n, digest, back, ids = [], [], [], []
                for one, count, raw in load.encode(part):
                    n.append(count)
                    digest.append(hashlib.sha256(one.encode()).hexdigest())
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        raw = raw.decode(errors="replace").encode()
                    back.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        ids.append(np.array(one.split(","), np.int32) if one else np.zeros(0, np.int32))
                columns = [keys.slice(a, len(part)), pa.array(n, pa.int64()), pa.array(digest), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)
                a += len(part)
                give_back()

    return coded


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token counts and digests, one row per row of ``docs``; with ``with_ids`` the ids too.

    ``path`` names a byte-level BPE tokenizer file that every executor has. ``ids_sha256`` is of
    the ids as decimals joined by commas, ``decoded_sha256`` of the text they decode to. Added
    tokens in a text become their ids. Null and empty texts have no tokens.
    """
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key).cast("long"), text).mapInArrow(
        _coded(path, with_ids), out + (", ids array<int>" if with_ids else ""))
