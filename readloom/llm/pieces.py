"""A SentencePiece vocabulary: streaming Viterbi encoding, decoding, and the lattice of all segmentations.

A unigram file's scores are log probabilities: a path through the pieces of a text is as good as the sum of its scores.
A BPE file's are merge ranks 0, -1, -2, …: its one right path is that on which every two neighbouring pieces stay
two when they are merged by rank on their own (a merge across a boundary would show between the two pieces beside it
first, and what goes on elsewhere doesn't change it). So of all paths into a boundary the best, or the one right one, survives,
and both kinds of file go through the same lattice. Where likelihoods are asked of a BPE file (the lattice), its ranks become
log probabilities of Zipf's law, -log(rank + 2.7), normalised. Blanks are written as U+2581, one is put in
front of a non-empty text, and a character that no piece covers (a U+2581 of the text itself included) is written in
byte pieces, so decoding gives back any text exactly.

Streaming Viterbi: the text arrives in parts, and a boundary is expanded once ``longest`` characters, the length of the
longest piece, follow it or the text ends. Later pieces can begin at the last ``longest`` boundaries only, so these are
where the live paths end; when a part is done their back pointers are followed to the last boundary that all of them
share, and all ids up to it are committed. What is kept is the stretch since then. Between a non-blank and a blank no piece
can lie (checked when a vocabulary is loaded), nor between two characters that stand side by side in no piece, so paths meet
there and the ids of each such stretch depend on it alone: every distinct stretch, of whatever length, goes through the
stream, and short ones are remembered in bounded dictionaries.
"""

from __future__ import annotations

import math
import re

import numpy as np

from readloom.llm.common import GAP, looked_up

BLANK = "\u2581"
#: Stands for a U+2581 of the text itself: a lone surrogate, which no text holds.
FOREIGN = "\ud800"
#: Characters that an encoder gives to its stream at a time.
WINDOW = 1 << 10
#: Texts that a normaliser would change.
_PROBES = ("\ufb01x \u2460", " a", "a  b ", "\uff21\u00a0b\tc", "A\u0301 \u1100\u1161")
#: Pairs of pieces that a worker remembers whether they may be neighbours.
PAIRS = 400_000


class Vocabulary:
    """Pieces with their ids and natural log probabilities; picklable and free of the library that read them."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], size: int, ranks: dict[str, float] | None = None):
        """ranks: of a BPE file, the higher the earlier merged."""
        self.ranks, self.pairs = ranks, {}
        self.size, self.byte_ids = size, byte_ids
        self.text = {i: p for p, _, i in pieces}
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        self.log = {i: s for _, s, i in pieces}
        self.floor = min((s for _, s, _ in pieces), default=0.0) - 10.0
        self.pieces = pieces
        self.cut = not any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces)
        self.trie = self.raw = self.own = self.inner = None

    def __getstate__(self):
        return self.__dict__ | {"trie": None, "raw": None, "own": None, "pairs": {}}

    def encoder(self, remember: int = 700_000) -> Encoder:
        """One for each copy of the vocabulary: what it remembers outlives a task, and goes with the worker's broadcast."""
        if self.own is None:
            # One vocabulary at a time: what was remembered for an earlier one goes now, not when the collector comes by.
            for other in _in_use:
                other.forget()
            self.own = Encoder(self, remember)
            _in_use[:] = [self.own]
        return self.own

    def merged(self, spelled: str) -> list[str]:
        """A short text's pieces by merging, best rank first, of equal ones the leftmost."""
        ranks, parts = self.ranks, list(spelled)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and r > best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spelling(self, code: int) -> str:
        """Of a code: a piece's id, ``size`` for a text's begin, and beyond that a character without a piece."""
        return self.text[code] if code < self.size else chr(code - self.size - 1) if code > self.size else ""

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the piece of one code may follow that of another."""
        key = left << 22 | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.spelling(left), self.spelling(right)
            found = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, byte_ids = [], {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw.append((piece, sp.get_score(i), i))
        scores = [s for _, s, _ in raw if s > -1e8]
        least, ranks = min(scores, default=0.0), None
        bpe = {p: s for p, s, _ in raw}
        raw = [(p, s if s > -1e8 else least - 1, i) for p, s, i in raw]  # pieces outside of the merges rank last
        if scores and all(s == round(s) for s in scores) and least < -1000:
            ranks = bpe
            weight = {i: 1.0 / (2.7 - s) for _, s, i in raw}
            total = sum(weight.values())
            raw = [(p, math.log(weight[i] / total), i) for p, _, i in raw]
        out = cls(raw, byte_ids, sp.vocab_size(), ranks)
        if any(sp.encode(x) != out.encoder().encode(x).tolist() for x in _PROBES):
            raise ValueError(f"{path} changes texts before it encodes them; only files that keep them as they are can be decoded to the same text")
        return out

    def pieces_trie(self) -> Trie:
        if self.trie is None:
            self.trie = Trie(self.pieces)
        return self.trie

    def cuts(self, flat: np.ndarray) -> np.ndarray:
        """Places (over 0) in code points between two that stand side by side in no piece: every path has a boundary there."""
        if self.inner is None:
            self.inner = np.array(sorted({ord(p[k]) << 21 | ord(p[k + 1]) for p, _, _ in self.pieces for k in range(len(p) - 1)} | {1 << 62}), dtype=np.int64)
        pairs = flat[:-1] << 21 | flat[1:]
        return np.flatnonzero(self.inner[np.searchsorted(self.inner, pairs)] != pairs) + 1

    def spelled(self) -> dict[int, bytes]:
        """What each id stands for."""
        if self.raw is None:
            self.raw = {i: p.replace(BLANK, " ").encode("utf-8") for i, p in self.text.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        return self.raw

    def foreign(self, c: str) -> tuple[tuple[int, ...], float]:
        raw = (BLANK if c == FOREIGN else c).encode("utf-8")
        return tuple(self.byte_ids[b] for b in raw), self.floor * len(raw)


def written(text: str) -> str:
    """A text as the vocabulary spells it."""
    return BLANK + text.replace(BLANK, FOREIGN).replace(" ", BLANK) if text else ""


class Trie:
    """The pieces' trie in sorted arrays, so that it is walked from many places at once."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        nodes, keys, to = {"": 0}, [], []
        for piece, _, _ in pieces:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    keys.append(nodes[piece[: k - 1]] << 21 | ord(piece[k - 1]))
                    to.append(nodes[piece[:k]])
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]
        self.id = np.full(len(nodes), -1, dtype=np.int64)
        for piece, _, i in pieces:
            self.id[nodes[piece]] = i

    def matches(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Pieces in the characters ``flat`` from each place of ``begin`` on, before the place of ``end`` beside it: for
        each length from 1 on, the numbers of the places and the ids."""
        which, at = np.arange(len(begin)), begin
        node = np.zeros(len(begin), dtype=np.int64)
        while len(at) and len(self.keys):
            key = node << 21 | flat[at]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            alive = self.keys[k] == key
            node, at, which = self.to[k[alive]], at[alive] + 1, which[alive]
            piece = self.id[node]
            full = piece >= 0
            yield which[full], piece[full]
            on = at < end[which]
            node, at, which = node[on], at[on], which[on]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


class Stream:
    """Viterbi over a text that arrives in parts; ``feed`` and ``finish`` return the ids committed so far and not yet given.

    Of each boundary of the window: ``code``, the last piece of the path that survives into it (-1: none yet), ``come``,
    where that piece begins, and for a file of probabilities ``best``, the path's score. ``commits`` counts the
    commits, ``widest`` is the longest stretch that was kept; after a text's end the stream is ready for the next. ``at``
    holds where, in the text since its begin, each id given by the last call begins."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie, self.commits, self.widest = vocabulary, vocabulary.pieces_trie(), 0, 0
        self.log = np.full(vocabulary.size, vocabulary.floor)
        for i, score in vocabulary.log.items():
            self.log[i] = score
        self.clear()

    def clear(self) -> None:
        self.held, self.next, self.gone = "", 0, 0
        self.code, self.come, self.best = [self.v.size], [0], [0.0]

    def feed(self, text: str, last: bool = False) -> list[int]:
        held, longest = self.held + text, self.v.longest
        size = len(held)
        self.code += [-1] * (size + 1 - len(self.code))
        self.come += [0] * (size + 1 - len(self.come))
        stop = size if last else size - longest
        if stop > self.next:
            (self._scored if self.v.ranks is None else self._ranked)(held, *self._edges(held, stop))
            self.next = stop
        base = size if last else self._met()
        out = self._ids(base)
        self.commits += base > 0
        if last:
            self.clear()
            return out
        self.widest = max(self.widest, size - base)
        # Only what follows the last committed boundary is kept; scores are counted from there.
        zero = self.best[base] if self.v.ranks is None else 0.0
        self.held, self.code, self.best = held[base:], self.code[base:], [x - zero for x in self.best[base:]]
        self.come = [x - base for x in self.come[base:]]
        self.next, self.gone = max(self.next - base, 0), self.gone + base
        return out

    def finish(self) -> list[int]:
        return self.feed("", True)

    def _edges(self, held: str, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that begin at the boundaries from ``next`` to before ``stop``, by end, then begin: begins, ends, codes. A
        character that no piece covers has its code point for a code, from ``size`` + 1 on."""
        flat, begin, longest = code_points(held), np.arange(self.next, stop), self.v.longest
        # A row for each end, a column for each length, the longest first.
        found = np.full((len(held) + 1 - self.next, longest), -1, dtype=np.int64)
        lone = np.ones(len(begin), dtype=bool)
        for k, (which, piece) in enumerate(self.trie.matches(flat, begin, np.full(len(begin), len(held))), 1):
            found[which + k, longest - k] = piece
            if k == 1:
                lone[which] = False
        where = np.flatnonzero(lone)
        found[where + 1, longest - 1] = flat[where + self.next] + self.v.size + 1
        found = found.ravel()
        at = np.flatnonzero(found >= 0)
        end, column = at // longest, at % longest
        return end - longest + column + self.next, end + self.next, found[at]

    def _scored(self, held: str, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> None:
        code, come, best, size = self.code, self.come, self.best, self.v.size
        best += [-math.inf] * (len(code) - len(best))
        scores = self.log[np.minimum(codes, size - 1)]
        for k in np.flatnonzero(codes >= size).tolist():
            scores[k] = self.v.foreign(chr(codes[k] - size - 1))[1]
        for i, j, piece, score in zip(begin.tolist(), end.tolist(), codes.tolist(), scores.tolist()):
            score += best[i]
            if score > best[j]:
                best[j], code[j], come[j] = score, piece, i

    def _ranked(self, held: str, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> None:
        """For a BPE file: the one right path into each boundary survives."""
        code, come, known, may, size = self.code, self.come, self.v.pairs.get, self.v.neighbours, self.v.size
        # What is on the left of a boundary, ready to be put together with what is on the right. Where no piece lies across, it is as at a text's begin.
        left = [c << 22 for c in code]
        for k in self.v.cuts(code_points(held)).tolist():
            left[k] = size << 22
        for i, j, piece in zip(begin.tolist(), end.tolist(), codes.tolist()):
            if code[j] < 0:
                fits = known(left[i] | piece)
                if fits or fits is None and may(left[i] >> 22, piece):
                    code[j], come[j] = piece, i
                    if left[j] < 0:
                        left[j] = piece << 22

    def _met(self) -> int:
        """The last boundary that the paths into all boundaries share at which a later piece can begin, or into which one leads already."""
        live = {k for k in range(self.next, len(self.code)) if self.code[k] >= 0}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(self.come[k])
        return live.pop()

    def _ids(self, to: int) -> list[int]:
        """Ids of the path into a boundary."""
        out, at, code, come, size, spelt = [], [], self.code, self.come, self.v.size, {}
        while to > 0:
            c, to = code[to], come[to]
            if c < size:
                out.append(c)
                at.append(to)
            else:
                ids = spelt.get(c)
                if ids is None:
                    ids = spelt[c] = self.v.foreign(chr(c - size - 1))[0][::-1]
                out += ids
                at += [to] * len(ids)
        out.reverse()
        at.reverse()
        self.at = np.array(at, dtype=np.int64) + self.gone
        return out


#: Stands between two words.
_BETWEEN = "\x03"
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


#: The encoder that a worker uses.
_in_use: list[Encoder] = []


class Encoder:
    """Encodes texts through one stream; short stretches between blanks are remembered."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 700_000):
        """remember: words and stretches in memory, a third of them words; two generations of each."""
        self.v, self.stream = vocabulary, Stream(vocabulary)
        self.large, self.small = ([{}, {}, max(1, remember // k)] for k in (6, 3))

    def forget(self) -> None:
        """Drops all that is remembered; it is made again when asked for."""
        for memory in (self.large, self.small):
            memory[:2] = {}, {}
        self.v.pairs.clear()
        self.v.own = None

    def _streamed(self, spelled: str, part: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that is already spelled as the vocabulary does, and where each begins."""
        ids, at, stream = [], [], self.stream
        last = max(0, len(spelled) - 1) // part * part
        for k in range(0, last, part):
            ids += stream.feed(spelled[k : k + part])
            at.append(stream.at)
        ids += stream.feed(spelled[last:], True)
        return np.array(ids, dtype="<u4"), np.concatenate([*at, stream.at])

    def short(self, spelled: str) -> list[int]:
        return self._streamed(spelled)[0].tolist()

    def stretches(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct stretches, sent through the stream as one text: a character that is in no piece stands between
        two of them, so paths meet on both its sides."""
        if not parts:
            return []
        ids, at = self._streamed(FOREIGN.join(parts))
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first, last = np.searchsorted(at, begin[:-1]) * 4, np.searchsorted(at, begin[1:] - 1) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words: cut where no piece lies across, they share many stretches."""
        if not words:
            return []
        flat = code_points(_BETWEEN.join(words))
        cuts = self.v.cuts(flat)
        cuts = cuts[(flat[cuts] != ord(_BETWEEN)) & (flat[cuts - 1] != ord(_BETWEEN))]
        lines = np.insert(flat, cuts, ord(GAP)).astype(np.uint32).tobytes().decode("utf-32-le").split(_BETWEEN)
        return [x.tobytes() for x in looked_up(lines, lambda parts: self._remembered(parts, self.stretches, self.small))]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; each distinct stretch of them is looked up once."""
        out, lines, at = [np.empty(0, dtype="<u4")] * len(texts), [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.v.cut or BLANK in text or GAP in text or _BETWEEN in text:
                out[k] = self._streamed(written(text))[0]
                continue
            text = BLANK + text.replace(" ", BLANK)
            plain = BLANK + BLANK not in text and text[-1] != BLANK
            lines.append(text[0] + text[1:].replace(BLANK, GAP + BLANK) if plain else GAP.join(_STRETCH.findall(text)))
            at.append(k)
        for k, ids in zip(at, looked_up(lines, lambda parts: self._remembered(parts, self.words, self.large))):
            out[k] = ids
        return out

    def _remembered(self, parts: list[str], make, memory: list) -> list[bytes]:
        """In two generations: the older one goes when the younger is full, so what is asked for often stays."""
        young, old, limit = memory
        found = list(map(young.get, parts))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in gaps:
            found[k] = old.get(parts[k])
            if found[k] is None:
                new.append(k)
        for k, ids in zip(new, make([parts[k] for k in new])):
            found[k] = ids
        if len(young) + len(gaps) > limit:
            memory[:2] = {}, young
        memory[0].update((parts[k], found[k]) for k in gaps[:limit] if len(parts[k]) <= 64)
        return found


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text that ids spell; bytes that are no UTF-8 give U+FFFD."""
    whole = b"".join(map(vocabulary.spelled().__getitem__, ids)).decode("utf-8", "replace")
    return whole[1:] if whole[:1] == " " else whole


class Lattice:
    """All segmentations of many words at once: edges by a trie held in sorted arrays, then the forward recursion."""

    def __init__(self, vocabulary: Vocabulary, log: dict[int, float] | None = None):
        log, self.trie = log or vocabulary.log, vocabulary.pieces_trie()
        self.log = np.full(vocabulary.size, vocabulary.floor)
        for i, s in log.items():
            self.log[i] = s
        self.bytes = np.array([vocabulary.byte_ids.get(b, 0) for b in range(256)])

    def edges(self, words: list[str]):
        """(start, end, piece id or -1 - number of a foreign character, sizes): positions count over all words, each with one more for its end."""
        sizes = np.array([len(w) for w in words])
        flat = code_points("".join(words))
        word = np.repeat(np.arange(len(words)), sizes)
        position = np.arange(len(flat)) + word  # boundaries: one more for each word
        starts, stops, ids, covered = [], [], [], np.zeros(len(flat), dtype=bool)
        for k, (which, piece) in enumerate(self.trie.matches(flat, np.arange(len(flat)), np.cumsum(sizes)[word]), 1):
            starts.append(position[which])
            stops.append(position[which] + k)
            ids.append(piece)
            if k == 1:
                covered[which] = True
        lone = np.flatnonzero(~covered)
        starts.append(position[lone])
        stops.append(position[lone] + 1)
        ids.append(-1 - flat[lone])
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(ids), sizes

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.log[np.maximum(ids, 0)]
        for k in np.flatnonzero(ids < 0):
            out[k] = self.log[self.bytes[list(chr(-1 - ids[k]).encode("utf-8", "surrogatepass"))]].sum()
        return out

    def forward(self, words: list[str], expect: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word over all its segmentations. With ``expect``, the expected number of
        uses of each piece, ``weight`` times a word, is added to it."""
        if not words:
            return np.empty(0)
        start, stop, ids, sizes = self.edges(words)
        score = self.scores(ids)
        first = np.cumsum(sizes + 1) - sizes - 1
        total = int((sizes + 1).sum())
        alpha = np.full(total, -np.inf)
        alpha[first] = 0.0
        depth = stop - np.repeat(first, sizes + 1)[stop]
        order = np.lexsort((stop, depth))
        s, t, e = start[order], stop[order], score[order]
        bounds = np.searchsorted(depth[order], np.arange(1, sizes.max() + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                self._sum(alpha, t[a:b], alpha[s[a:b]] + e[a:b])
        ends = first + sizes
        if expect is not None:
            beta = np.full(total, -np.inf)
            beta[ends] = 0.0
            left = np.repeat(first, sizes + 1)[start]
            back = start - left
            order = np.lexsort((start, back))
            s, t, e = start[order], stop[order], score[order]
            bounds = np.searchsorted(back[order], np.arange(0, sizes.max() + 1))
            for a, b in list(zip(bounds[:-1], bounds[1:]))[::-1]:
                if a < b:
                    self._sum(beta, s[a:b], beta[t[a:b]] + e[a:b])
            owner = np.repeat(np.arange(len(words)), sizes + 1)[start]
            share = np.exp(np.minimum(alpha[start] + score + beta[stop] - alpha[ends][owner], 0)) * weight[owner]
            known = ids >= 0
            np.add.at(expect, ids[known], share[known])
            for k in np.flatnonzero(~known):
                np.add.at(expect, self.bytes[list(chr(-1 - ids[k]).encode("utf-8", "surrogatepass"))], share[k])
        return alpha[ends]

    @staticmethod
    def _sum(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Log-sum of values by sorted place."""
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        top = np.maximum.reduceat(values, new)
        size = np.diff(np.append(new, len(at)))
        into[at[new]] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size)), new))
