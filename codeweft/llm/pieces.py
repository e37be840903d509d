"""SentencePiece encoding and decoding: the library's ids, by the method of the model's own kind.

BPE models merge by rank: of all neighbours whose join is a piece the best-scored join comes first, the
leftmost among equals. Between two characters that stand side by side in no piece no merge can
cross, so texts fall into segments that are merged by themselves: words are merged once per worker
and then looked up, and a giant text is cut into chunks at such places, whose ids are joined.

Unigram models take the segmentation into vocabulary pieces of greatest total score, by a max-plus
parallel scan: the best path of the library's lattice. Its dynamic programme is a chain of max-plus matrix products, so a giant
document is cut into chunks: a boundary state is the number of characters by which the last piece
reaches over a boundary, a chunk yields the matrix of best scores from each entry state to each
exit state, matrices are combined associatively in two levels, and with the states that come out
every chunk is traced back by itself.

Other texts are encoded many at once: pieces are looked up from every place in vectorised steps, and
places that no piece runs over (the start of a space after another character is one, which is
checked when a vocabulary is read) cut them into short segments that are solved in step."""
from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 65_536
BLOCK = 256                     # chunks whose matrices one task combines
SPACE = "▁"
_TOGETHER = 1 << 16             # characters encoded at once; a longer text goes by itself
_IN_STEP = 32                   # longest segment solved in step with others
_SLOT_BITS = 19
_ROWS = 512                     # texts per result batch
_CACHED = 1 << 22               # characters of the words whose ids a worker keeps
_AT_ONCE = 1 << 20              # characters whose words are merged in step
_WIDTHS = (8, 16, 32, 64)       # longest words of those merged in step; longer ones go by themselves
NEVER = -np.inf


def read_vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte, or other. Its size is that of a vocabulary,
    so it is read on the driver and broadcast."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: ("byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)
                      else "normal")
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def is_bpe(path: str = MODEL) -> bool:
    """Whether a model merges by rank (else it is of unigram kind). Other kinds and normalisations are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, rules, piece = model.trainer_spec.model_type, model.normalizer_spec, pb.ModelProto.SentencePiece
    if kind not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM):
        raise ValueError("neither a BPE nor a unigram model")
    if (rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
            or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("a model with a normalisation of its own")
    if any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
        raise ValueError("a model with user-defined or unused pieces")
    return kind == pb.TrainerSpec.BPE


class Merges:
    """The ids of a BPE model. A symbol is the id of a piece, or `size` and the code of a character that is none."""

    def __init__(self, vocabulary):
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(vocabulary) if kind == "normal"]
        self.id, self.size = {p: i for p, _, i in normal}, len(vocabulary)
        self.pairs = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.pairs):
            raise ValueError("a piece has a space after another character")
        self.score = np.array([s for _, s, _ in vocabulary])
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.unknown_id = next((i for i, v in enumerate(vocabulary) if v[0] == "<unk>"), 0)
        own = "" if any("\n" in p for p in self.pairs) else "\n"     # line ends stand alone if no piece has them
        self.words = re.compile(f"{SPACE}+[^{SPACE}{own}]*|[^{SPACE}{own}]+" + (f"|{own}" if own else "")).findall
        self._forget()
        self._tables(normal)

    def _forget(self) -> None:
        """No words are known: places in `starts` and `counts` by word, and the ids there."""
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.ids, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def _tables(self, normal) -> None:
        """Joins as arrays: a table hashed by both symbols, whose slots are short runs of a sorted array. Its
        last entry is that of pairs which don't join."""
        self.pad = self.size + 0x110000                  # a symbol that joins with none
        self.symbol = np.arange(self.size, self.pad)
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        self.rank = {p: ranks[s] for p, s, _ in normal}
        keys, rank, joined = [], [], []
        for p, _, i in normal:
            if len(p) == 1:
                self.symbol[ord(p)] = i
            for cut in range(1, len(p)):
                left, right = (self.id.get(x, self.size + ord(x) if len(x) == 1 else None) for x in (p[:cut], p[cut:]))
                if left is not None and right is not None:
                    keys.append(left * (self.pad + 1) + right)
                    rank.append(self.rank[p])
                    joined.append(i)
        keys = np.array(keys, np.int64)
        slot = Codec._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.never = np.iinfo(np.int32).max
        self.keys = np.append(keys[order], -1)
        self.join_rank = np.append(np.array(rank, np.int32)[order], np.int32(self.never))
        self.joined = np.append(np.array(joined, np.int64)[order], -1)
        self.slots = np.searchsorted(slot[order], np.arange((1 << _SLOT_BITS) + 1))

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entries of the table of joins."""
        key = left * (self.pad + 1) + right
        slot = Codec._slot(key)
        at, end, none = self.slots[slot], self.slots[slot + 1], len(self.keys) - 1
        hit = (self.keys[at] == key) & (at < end)
        out = np.where(hit, at, none)
        rest = np.flatnonzero(~hit & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.keys[at[rest]] == key[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit]
            rest = rest[at[rest] + 1 < end[rest]]
        return out

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _in_step(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, with the count of each. Merges words of `width` characters at most, one join in each word at a time. A row of the arrays
        is a word with a pad at least behind it, so the pad before a row ends the row before."""
        wide = width + 1
        codes = np.frombuffer("".join([w.ljust(wide, "\0") for w in words]).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = np.where((np.arange(wide) < sizes[:, None]).ravel(), self.symbol[codes], self.pad)
        entry = np.append(self._join(symbol[:-1], symbol[1:]), len(self.keys) - 1)
        rank = self.join_rank[entry]
        table, rows = rank.reshape(-1, wide), np.arange(len(words))
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        while True:
            at = rows * wide + table[rows].argmin(axis=1)            # the leftmost of equal rank
            more = rank[at] < self.never
            rows, at = rows[more], at[more]
            if not len(at):
                break
            gone = after[at]
            symbol[at], symbol[gone], rank[gone] = self.joined[entry[at]], self.pad, self.never
            right, left = after[gone], before[at]
            after[at], before[right] = right, at
            for a, b in ((at, right), (left, at)):
                entry[a] = found = self._join(symbol[a], symbol[b])
                rank[a] = self.join_rank[found]
        kept = symbol < self.pad
        ids, counts = symbol[kept], kept.reshape(-1, wide).sum(axis=1)
        outside = np.flatnonzero(ids >= self.size)                   # characters outside the vocabulary, as bytes
        if len(outside):
            raw = [self._bytes(chr(c)) for c in (ids[outside] - self.size).tolist()]
            times = np.ones(len(ids), np.int64)
            times[outside] = [len(r) for r in raw]
            counts = np.bincount(np.repeat(np.arange(len(words)), counts), times, len(words)).astype(np.int64)
            ids = np.repeat(ids, times)
            ids[ids >= self.size] = list(chain.from_iterable(raw))
        return ids, counts

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown_id) for b in character.encode()]

    def _alone(self, text: str) -> list[int]:
        """Ids of a long word, segment by segment."""
        at, out = 0, []
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1:i + 1] not in self.pairs:
                for p in self._merged(text[at:i]):
                    out += [self.id[p]] if p in self.id else self._bytes(p)
                at = i
        return out

    def _merged(self, text: str) -> list[str]:
        """With a heap of joins and linked neighbours: n log n."""
        n = len(text)
        parts, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get(text[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j == n or len(parts[i]) + len(parts[j]) != size:
                continue                                 # a neighbour has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def _learn(self, words: set[str]) -> None:
        """Puts words and their ids among those known."""
        words = sorted(words, key=len)
        sizes = list(map(len, words))
        found, at = [], 0
        for width in _WIDTHS:
            end = bisect_right(sizes, width)
            if end > at:
                found.append(self._in_step(words[at:end], width))
            at = end
        for w in words[at:]:
            ids = self._alone(w)
            found.append((ids, [len(ids)]))
        counts = np.concatenate([self.counts, *[c for _, c in found]]).astype(np.int64)
        self.known.update(zip(words, range(len(self.known), len(counts))))
        self.starts, self.counts, self.held = np.cumsum(counts) - counts, counts, self.held + sum(sizes)
        self.ids = np.concatenate([self.ids, *[i for i, _ in found]]).astype(np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normalised texts or chunks, one after the other, with the count and the score of each."""
        done, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= _AT_ONCE:
                size += len(texts[end])
                end += 1
            words = [self.words(t) for t in texts[at:end]]
            flat = list(chain.from_iterable(words))
            self._learn(set(flat).difference(self.known))
            place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            counts = self.counts[place]
            ids = self.ids[np.repeat(self.starts[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            counts = np.bincount(np.repeat(np.arange(end - at), list(map(len, words))), counts, end - at).astype(np.int64)
            done.append((ids, counts, np.bincount(np.repeat(np.arange(end - at), counts), self.score[ids], end - at).astype(float)))
            if self.held > _CACHED:
                self._forget()
            at = end
        empty = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*(done or [empty])))

    def chunks(self, text: str, size: int) -> Iterator[str]:
        """Parts of a text that no merge crosses, of `size` characters at most where there is such a place."""
        at, n, pairs = 0, len(text), self.pairs
        crossed = lambda i: text[i - 1:i + 1] in pairs
        while n - at > size:
            end = at + size
            while end > at and crossed(end):
                end -= 1
            if end == at:
                end = at + size + 1
                while end < n and crossed(end):
                    end += 1
            yield text[at:end]
            at = end
        if at < n:
            yield text[at:]


class Codec:
    """Best segmentation over a vocabulary, and back."""

    def __init__(self, vocabulary):
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(vocabulary) if kind == "normal"]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in normal):
            raise ValueError("a piece has a space after another character")
        self.reach = max(len(p) for p, _, _ in normal)
        self.unknown = min(s for _, s, _ in normal) - 10.0
        # a node of the trie: next nodes by character, score of the piece that ends here or None, its id
        self.root = ({}, None, -1)
        for p, s, i in sorted(normal):
            nodes = self.root[0]
            for c in p[:-1]:
                nodes = nodes.setdefault(c, ({}, None, -1))[0]
            nodes[p[-1]] = ({}, s, i)                  # sorted: longer pieces come later
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "other" else p.encode()
                    for p, _, kind in vocabulary]
        self.unknown_id = next((i for i, v in enumerate(vocabulary) if v[0] == "<unk>"), 0)
        self._tables(normal)

    def _tables(self, normal) -> None:
        """The trie as arrays: classes of characters (0: in no piece), and a table of child nodes hashed by
        (node, class), whose slots are short runs of a sorted array."""
        letters = sorted({c for p, _, _ in normal for c in p})
        self.klass = np.zeros(0x110000, np.int32)
        self.klass[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        keys, children, scores, pieces, queue = [], [], [NEVER], [-1], [(0, self.root[0])]
        for at, nodes in queue:
            for c, (below, score, piece) in nodes.items():
                keys.append(at * self.width + int(self.klass[ord(c)]))
                children.append(len(scores))
                queue.append((len(scores), below))
                scores.append(NEVER if score is None else score)
                pieces.append(piece)
        keys, children = np.array(keys, np.int64), np.array(children, np.int64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.children = np.append(keys[order], -1), np.append(children[order], 0)
        self.slots = np.searchsorted(slot[order], np.arange((1 << _SLOT_BITS) + 1))
        self.node_score, self.node_piece = np.array(scores), np.array(pieces, np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _child(self, node: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        key = node * self.width + klass
        slot = self._slot(key)
        at, end = self.slots[slot], self.slots[slot + 1]
        hit = (self.keys[at] == key) & (at < end)
        out = np.where(hit, self.children[at], 0)
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == key[left]
            out[left[hit]] = self.children[at[left[hit]]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def forward(self, text: str, start: int, stop: int):
        """Best score at each position from `start`, and the piece (length, id) that ends there.
        Pieces begin before `stop`. Among equal scores the piece that begins first stays."""
        n, first, reach, unknown = len(text), self.root[0], self.reach, self.unknown
        best, back = [NEVER] * (n + 1), [None] * (n + 1)
        best[start] = 0.0
        for i in range(start, min(stop, n)):
            score = best[i]
            if score == NEVER:
                continue
            nodes, j, single = first, i, False
            for c in text[i:i + reach]:
                node = nodes.get(c)
                if node is None:
                    break
                nodes, gain, piece = node
                j += 1
                if gain is not None:
                    if j == i + 1:
                        single = True
                    if score + gain > best[j]:
                        best[j] = score + gain
                        back[j] = i, piece
            if not single and score + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = score + unknown, (i, -1)
        return best, back

    def trace(self, text: str, back, start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            i, piece = back[end]
            if piece >= 0:
                out.append(piece)
            else:                                      # a character outside the vocabulary, as bytes
                out.extend(self.byte_ids.get(b, self.unknown_id) for b in reversed(text[i:end].encode()))
            end = i
        return out[::-1]

    def encode(self, normal: str, ids: array) -> float:
        """Appends the ids of a whole normalised text; returns its score."""
        found, _, scores = self.encode_all([normal])
        ids.frombytes(found.tobytes())
        return float(scores[0])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole normalised texts, one after the other, with the count and the score of each text."""
        done, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= _TOGETHER:
                size += len(texts[end])
                end += 1
            done.append(self._encode_together(texts[at:end]))
            at = end
        empty = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*(done or [empty])))

    def _encode_together(self, texts: list[str]):
        """All places of some texts in step. Pieces are looked up from every place at once; places that no
        piece runs over cut the texts into segments, whose best paths do not depend on each other."""
        flat = "\0".join(texts) + "\0"
        n, reach = len(flat), self.reach
        codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        klass = self.klass[codes].astype(np.int64)
        klass[stops] = 0
        # gain[l - 1, i]: score of the piece of l characters from i
        gain, piece, longest = np.full((reach, n), NEVER), np.full((reach, n), -1, np.int32), np.ones(n, np.int64)
        at, node = np.arange(n), np.zeros(n, np.int64)
        for length in range(1, reach + 1):
            node = self._child(node, klass[at + length - 1])
            at, node = at[node > 0], node[node > 0]         # a stop ends every walk before the end
            ends = self.node_piece[node] >= 0
            i, last = at[ends], node[ends]
            gain[length - 1, i], piece[length - 1, i], longest[i] = self.node_score[last], self.node_piece[last], length
            if not len(at):
                break
        gain[0, piece[0] < 0] = self.unknown
        far = np.maximum.accumulate(np.arange(n) + longest)
        start = np.flatnonzero(np.append(True, far[:-1] == np.arange(1, n)))
        size = np.diff(np.append(start, n))
        own = ~np.isin(start, stops, assume_unique=True)
        start, size = start[own], size[own]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        long = int(np.searchsorted(-size, -_IN_STEP))        # those of more than _IN_STEP characters come first
        chosen, total = np.zeros(n, np.int8), np.zeros(len(start))   # length of the piece that begins here
        for s in range(long):
            b, e = int(start[s]), int(start[s] + size[s])
            best, back = self.forward(flat[b:e], 0, e - b)
            total[s], j = best[-1], e - b
            while j:
                i = back[j][0]
                chosen[b + i], j = j - i, i
        s, size = start[long:], size[long:]
        if len(s):
            best, back = np.zeros(n), np.zeros(n, np.int8)   # of the paths that end with this character
            for e in range(1, int(size[0]) + 1):
                k = int(np.searchsorted(-size, -e, "right"))
                end = s[:k] + e - 1
                score, length = np.full(k, NEVER), np.zeros(k, np.int8)
                for l in range(min(e, reach), 0, -1):        # the piece that begins first wins ties
                    new = gain[l - 1, end - l + 1]
                    if l < e:
                        new += best[end - l]
                    better = new > score
                    score[better], length[better] = new[better], l
                best[end], back[end] = score, length
            total[long:] = best[s + size - 1]
            end = s + size
            while len(end):
                length = back[end - 1]
                end = end - length
                chosen[end] = length
                s, end = s[end > s], end[end > s]
        of_text = lambda places: np.searchsorted(stops, places)
        places = np.flatnonzero(chosen)
        ids = piece[chosen[places] - 1, places]
        count = np.ones(len(ids), np.int64)
        outside = np.flatnonzero(ids < 0)                    # characters outside the vocabulary, as bytes
        if len(outside):
            raw = [[self.byte_ids.get(b, self.unknown_id) for b in flat[i].encode()] for i in places[outside].tolist()]
            count[outside] = [len(r) for r in raw]
            ids = np.repeat(ids, count)
            ids[ids < 0] = np.fromiter((x for r in raw for x in r), np.int32)
        counts = np.bincount(of_text(places), count, len(texts)).astype(np.int64)
        return ids, counts, np.bincount(of_text(start), total, len(texts)).astype(float)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    # chunks: `n` own characters of `text`, which goes on with up to reach - 1 characters of the next
    def _cuts(self, text: str, n: int) -> tuple[int, int] | None:
        """First and last word start that every path through the chunk must touch."""
        at = [m.start() for m in re.finditer(f"(?<!{SPACE}){SPACE}", text[:n]) if m.start() >= min(self.reach - 1, n)]
        return (at[0], at[-1]) if at else None

    def transfer(self, text: str, n: int, entries) -> np.ndarray:
        """Best score from each entry state to each exit state."""
        out = np.full((self.reach, self.reach), NEVER)
        cuts = self._cuts(text, n)
        if cuts:
            first, last = cuts
            middle = float(self.encode_all([text[first:last]])[2][0])
            tail, _ = self.forward(text[last:], 0, n - last)
            ends = [middle + (tail[n - last + e] if n + e <= len(text) else NEVER) for e in range(self.reach)]
            for s in entries:
                out[s] = self.forward(text[:first], s, first)[0][first] + np.array(ends)
        else:
            for s in entries:
                if s >= n:
                    out[s, s - n] = 0.0
                else:
                    best, _ = self.forward(text, s, n)
                    out[s, :len(text) - n + 1] = best[n:n + self.reach]
        return out

    def solve(self, text: str, n: int, entry: int, exit_: int, ids: array) -> float:
        """The chunk's part of the best path between two states: its score, its ids appended."""
        if entry >= n:
            return 0.0
        cuts = self._cuts(text, n)
        first, last = cuts or (entry, entry)
        score = 0.0
        if cuts:
            best, back = self.forward(text[:first], entry, first)
            score += best[first]
            ids.extend(self.trace(text, back, entry, first))
            score += self.encode(text[first:last], ids)
        best, back = self.forward(text[last:n + exit_], 0, n - last)
        ids.extend(self.trace(text[last:n + exit_], back, 0, n + exit_ - last))
        return score + best[n + exit_ - last]


_CODECS: dict[tuple, Codec | Merges] = {}


def _codec(shared, kind=Codec):
    key = kind, id(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = kind(shared.value)
    return _CODECS[key]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product: associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """State before each matrix, and after the last, on a best path between two given ones."""
    ahead = [None] * len(matrices) + [np.where(np.arange(len(matrices[0])) == exit_, 0.0, NEVER)]
    for i in range(len(matrices) - 1, -1, -1):
        ahead[i] = (matrices[i] + ahead[i + 1][None, :]).max(axis=1)
    out = [entry]
    for i, m in enumerate(matrices):
        out.append(int(np.argmax(m[out[-1]] + ahead[i + 1])))
    return out


def _lists(flat: array | np.ndarray, ends) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))


def _whole(shared, kind):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids, counts, scores = codec.encode_all([codec.normal(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, np.append(0, np.cumsum(counts))), pa.array(scores)],
                                                 names=["doc_id", "ids", "score"])

    return whole


def encode(docs: DataFrame, model: str = MODEL, chunk_chars: int = CHUNK_CHARS, block: int = BLOCK,
           bpe: bool | None = None) -> DataFrame:
    """(doc_id, ids array<int>, score double) for each row of `docs` (doc_id, text); score is the sum
    of the pieces' scores.

    Null and empty texts have no ids and score 0. Characters outside the vocabulary become bytes.
    Texts of more than `chunk_chars` characters are cut into chunks. `bpe` is the model's kind, read
    from the model if None; `block` counts for unigram models only. Repeated rows repeat their result;
    other columns are not read; an empty table gives no rows."""
    bpe = is_bpe(model) if bpe is None else bpe
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    solved = (_merged_chunks(docs.where(giant), shared, chunk_chars) if bpe
              else _scanned_chunks(docs.where(giant), shared, chunk_chars, block))
    solved = solved.dropDuplicates(["row", "seq"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("seq", "ids", "score"))).alias("parts"))
    large = docs.where(giant).select("doc_id", "row").join(solved, "row").select(
        "doc_id", F.flatten("parts.ids").alias("ids"),
        F.aggregate("parts.score", F.lit(0.0), lambda a, x: a + x).alias("score"))
    return docs.where(~giant).mapInArrow(_whole(shared, Merges if bpe else Codec),
                                         f"doc_id {kind}, ids array<int>, score double").unionByName(large)


def _merged_chunks(docs: DataFrame, shared, chunk_chars: int) -> DataFrame:
    """(row, seq, ids, score) by merges. Chunks end where no merge crosses, and are dealt out one by one."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, Merges)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                parts = list(codec.chunks(codec.normal(text.as_py()), chunk_chars))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()),
                                                  pa.array(parts, pa.string())], names=["row", "seq", "piece"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, Merges)
        for batch in batches:
            ids, counts, scores = codec.encode_all(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), _lists(ids, np.append(0, np.cumsum(counts))),
                                              pa.array(scores)], names=["row", "seq", "ids", "score"])

    return (docs.mapInArrow(split, "row bigint, seq bigint, piece string").repartition("row", "seq")
            .mapInArrow(merge, "row bigint, seq bigint, ids array<int>, score double"))


def _scanned_chunks(docs: DataFrame, shared, chunk_chars: int, block: int) -> DataFrame:
    """(row, seq, ids, score) by the scan. Chunks begin at a word start where one is near, so only in
    words longer than that can equally good segmentations differ from those of one pass; the score
    never does."""
    reach = Codec(shared.value).reach

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = codec.normal(text.as_py())
                out, at, clean = [], 0, True
                while at < len(text):
                    end, next_clean = min(at + chunk_chars, len(text)), True
                    if end < len(text):
                        near = text.rfind(SPACE, end - min(256, chunk_chars // 2), end)
                        next_clean = near > at and text[near - 1] != SPACE
                        end = near if next_clean else end
                    out.append({"row": row, "seq": len(out), "n": end - at, "clean": clean, "piece": text[at:end + reach - 1]})
                    at, clean = end, next_clean
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                        ("row", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("clean", pa.bool_()), ("piece", pa.string())]))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            made = [codec.transfer(p.as_py(), n, [0] if c else range(reach)).tobytes() for p, n, c in
                    zip(batch.column("piece"), batch.column("n").to_pylist(), batch.column("clean").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), pa.array(made, pa.binary())],
                                             names=["row", "seq", "matrix"])

    matrix = lambda m: np.frombuffer(m.as_buffer(), np.float64).reshape(reach, reach)

    def combine(key, table):
        table = table.sort_by("seq")
        total = None
        for m in table.column("matrix"):
            total = matrix(m) if total is None else product(total, matrix(m))
        return pa.table({"row": [key[0].as_py()], "block": [key[1].as_py()], "matrix": pa.array([total.tobytes()], pa.binary())})

    def between(key, table):
        table = table.sort_by("block")
        found = states([matrix(m) for m in table.column("matrix")], 0, 0)
        return pa.table({"row": table.column("row"), "block": table.column("block"), "entry": pa.array(found[:-1], pa.int32()),
                         "exit": pa.array(found[1:], pa.int32())})

    def inside(key, table, ends):
        table = table.sort_by("seq")
        found = states([matrix(m) for m in table.column("matrix")], ends["entry"][0].as_py(), ends["exit"][0].as_py())
        return pa.table({"row": table.column("row"), "seq": table.column("seq"), "entry": pa.array(found[:-1], pa.int32()),
                         "exit": pa.array(found[1:], pa.int32())})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids, ends, scores = array("i"), [0], []
            for p, n, s, e in zip(batch.column("piece"), *(batch.column(c).to_pylist() for c in ("n", "entry", "exit"))):
                scores.append(codec.solve(p.as_py(), n, s, e, ids))
                ends.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), _lists(ids, ends), pa.array(scores, pa.float64())],
                                             names=["row", "seq", "ids", "score"])

    chunks = docs.mapInArrow(split, "row bigint, seq bigint, n bigint, clean boolean, piece string")
    matrices = (chunks.mapInArrow(transfer, "row bigint, seq bigint, matrix binary").dropDuplicates(["row", "seq"])
                .withColumn("block", F.floor(F.col("seq") / block)))
    blocks = matrices.groupBy("row", "block").applyInArrow(combine, "row bigint, block bigint, matrix binary")
    edges = blocks.groupBy("row").applyInArrow(between, "row bigint, block bigint, entry int, exit int")
    known = (matrices.groupBy("row", "block").cogroup(edges.groupBy("row", "block"))
             .applyInArrow(inside, "row bigint, seq bigint, entry int, exit int"))
    return chunks.join(known, ["row", "seq"]).mapInArrow(solve, "row bigint, seq bigint, ids array<int>, score double")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` plus `decoded`, the text of its `ids`; null ids give null. Spaces come back as
    spaces; a lower one eighth block of the original does too, as the vocabulary has it so."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    others = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*others).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                lists = part.column("ids")
                ids, ends = lists.flatten().to_pylist(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))).tolist()
                texts = [codec.decode(ids[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.select(others).columns, pa.array(texts, pa.string())], names=[*others, "decoded"])

    return encoded.select(*others).mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """Ids of every text, and a digest of what they decode to (the text itself, as tests show)."""
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "score",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as ids. No row goes: null and empty texts have no ids, repeated rows
    the same ones."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "score")
