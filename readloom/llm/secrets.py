"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

Patterns (leftmost, non-overlapping within a kind): ``assign`` a keyword with a value of 6 or more characters,
``access`` an access key id of 20 or more, ``hex`` a run of 24 or more lower-case hexadecimal digits. Their spans
always stay; the model's spans (kind ``crf``) are added where they touch none of them.

Model: every token of a text is tagged begin, inside or outside, and one Viterbi path runs over the whole text. Tokens
are the runs of letters and digits (of any script) and every other character that isn't white space; a digit, a least
length or a class of characters is not asked for. Features: shape, length, variety of characters, how common the letter
pairs are in the sample, the tokens around, the chunk between white space that the token stands in, the last key word
(``_KEY``) with what stands between, and how dense the file is in fields with digits and in signs. The field is trained
here by full-gradient ascent in numpy on a sample: cut-outs of about ``sample_rows`` rows, tagged by the fixed patterns,
and ``made_up`` secrets and harmless values from a seeded generator, set into contexts of the sample. File features are
those of the whole text, in training too. What one sampled row adds to training is bounded: ``SAMPLE_FIELDS`` cut-outs,
``AROUND`` characters to each side of a field of at most ``SAMPLE_CHARS``. Of paths with equal scores, at a text's end
outside goes before inside before begin, and of the ways into a token's tag begin before inside before outside.

Scale: a map over whole texts without a shuffle; the model is a few hundred kilobytes. Features and path are computed
for many texts at once; the path by max-plus products of blocks, which is exact.

Defined cases: a null or empty text has no spans. Offsets are in code points, ends exclusive. Repeated rows are
scanned one by one. With an empty table only the made-up fields train the model. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import map_slices, table

KINDS = ("assign", "access", "hex", "crf")
SAMPLE_ROWS, MADE_UP, BUCKETS, EPOCHS = 2_000, 3_000, 1 << 14, 50
#: Of a sampled row at most so many cut-outs train the model, around fields of at most so many characters; all tokens of all rows are tagged.
SAMPLE_FIELDS, SAMPLE_CHARS, AROUND = 50, 2_000, 80
#: Tokens that a worker remembers, and tokens whose features are in memory at once (a longer text goes alone).
REMEMBER, AT_ONCE, BLOCK = 200_000, 200_000, 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_RIGHT = re.compile(r"[A-Za-z0-9+/_.=-]*", re.ASCII)
_TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_)")
_KEY = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|signature|pin$|login", re.IGNORECASE)
_SIGNS = set("+/_.=-")
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value)."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def fields(text: str, least: int = 8) -> list[tuple[int, int]]:
    out, done = [], 0
    m = _DIGIT.search(text)
    while m:
        start = m.start()
        while start > done and (text[start - 1] in _SIGNS or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        done = _RIGHT.match(text, m.start()).end()
        if done - start >= least:
            out.append((start, done))
        m = _DIGIT.search(text, done)
    return out


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Of each character of the basic plane its bits (1 digit, 2 lower, 4 upper, 8 not a letter or digit, 16 not hexadecimal, 32 not ASCII), and its lower case."""
    every = [chr(i) for i in range(1 << 16)]
    bits = [c.isdigit() + 2 * c.islower() + 4 * c.isupper() + 8 * (not c.isalnum()) + 16 * (c not in "0123456789abcdefABCDEF") + 32 * (c > "\x7f") for c in every]
    return np.array(bits, dtype=np.int64), np.array([ord(c.lower()[0]) for c in every], dtype=np.int64)


_BITS, _LOWER = _letter_table()


def file_features(text: str) -> tuple[int, int]:
    """How dense the text is in fields with digits and in signs of code, 0 to 9 each."""
    size = len(text) + 1
    return min(9, 4000 * len(fields(text)) // size), min(9, 40 * (text.count("=") + text.count("{") + text.count(";")) // size)


def _letters(low: np.ndarray) -> np.ndarray:
    """Places of a to z in their table, 0 for anything else."""
    c = low - 96
    return np.where((c < 1) | (c > 26), 0, c)


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Mean surprise of each pair of letters in the words of the texts."""
    c = _letters(_LOWER[np.frombuffer(" ".join(re.findall(r"[A-Za-z]{4,}", " ".join(texts))).encode(), dtype=np.uint8)])
    n = 1.0 + np.bincount((c[:-1] * 27 + c[1:])[(c[:-1] > 0) & (c[1:] > 0)], minlength=27 * 27)
    return -np.log(n / n.reshape(27, 27).sum(axis=1).repeat(27))


#: Features of a token alone, and of its surroundings.
ALONE, ABOUT = 6, 12


class Lexicon:
    """What is known of tokens with the white space before them, by place; forgotten when there are too many."""

    def __init__(self, pairs: np.ndarray | None):
        self.pairs, self.ids = pairs, {}
        self.facts, self.alone = np.zeros((0, 8), dtype=np.int64), np.zeros((0, ALONE), dtype=np.int64)

    def places(self, keys: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > REMEMBER:
            ids.clear()
            self.facts, self.alone = self.facts[:0], self.alone[:0]
        new = [k for k in set(keys) if k not in ids]
        if new:
            facts, alone = self._known(new)
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self.facts, self.alone = np.concatenate([self.facts, facts]), np.concatenate([self.alone, alone])
        return np.fromiter(map(ids.__getitem__, keys), dtype=np.int64, count=len(keys))

    def _known(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: characters with and without white space, whether there is any, name, shape, bits for its chunk, key word, word; and its features."""
        tokens = [k.lstrip() for k in keys]
        short = [t[:64] for t in tokens]
        total, size = np.fromiter(map(len, keys), np.int64, len(keys)), np.fromiter(map(len, tokens), np.int64, len(keys))
        n = np.minimum(size, 64)
        at = np.cumsum(n) - n
        code = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        code = np.minimum(code, (1 << 16) - 1)
        of = np.repeat(np.arange(len(keys)), n)
        place, low, each = np.arange(len(code)) - at[of], _LOWER[code], _BITS[code]
        bits = np.bitwise_or.reduceat(each, at)
        word = (bits & 8) == 0
        upper, lower = np.add.reduceat((each >> 2) & 1, at), np.add.reduceat((each >> 1) & 1, at)
        title = (upper == 1) & ((each[at] & 4) > 0) & (lower == n - 1) & (n > 1)
        hexa = ((bits & 16) == 0) & ((bits & 1) > 0)
        shape = np.where(word, (bits & 39) * 4 + title * 2 + hexa, 1000 + np.where(code[at] < 128, code[at], 128))
        length = np.where(size < 4, size, 4 + np.minimum(12, size // 4))
        seen = np.sort(of << 16 | code)
        spread = np.bincount(seen[np.append(True, seen[1:] != seen[:-1])] >> 16, minlength=len(keys))
        variety = np.where(size > 7, 4 * spread // n, -1)
        same = np.append(of[1:] == of[:-1], False)
        kind = each & 5
        turns = np.add.reduceat((np.append(kind[1:], 0) != kind) & same, at, dtype=np.int64)
        changes = np.where(size > 3, turns * 8 // n, -1)
        odd = np.full(len(keys), -1)
        if self.pairs is not None:
            c = _letters(low)
            surprise = np.add.reduceat(np.where(same, self.pairs[c * 27 + np.append(c[1:], 0)], 0.0), at)
            odd = np.where(word & (size > 3), np.minimum(9, 2 * surprise / np.maximum(n - 1, 1)).astype(np.int64), -1)
        name = np.add.reduceat(np.where(place < 12, (low + 1) * _POWERS[place], 0), at) & (1 << 62) - 1
        for_chunk = (bits & 7) | 8 * ~word | 16 * np.isin(code[at], (58, 64, 47)) | 32 * (code[at] == 46)
        key = np.array([bool(_KEY.search(t)) for t in short]) & word
        facts = np.stack([total, size, total > size, name, shape * 8 + np.minimum(length, 7), for_chunk, key, word], axis=1)
        alone = [_mixed(20, shape), _mixed(21, shape, length), _mixed(22, shape, variety + 1), _mixed(23, shape, changes + 1), _mixed(24, odd + 1, length), _mixed(25, name)]
        return facts.astype(np.int64), np.stack(alone, axis=1)


#: Weights of the places in a token's name.
_POWERS = np.array([pow(0x5851F42D4C957F2D, k + 1, 1 << 40) for k in range(64)], dtype=np.int64)


def _mixed(salt: int, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 & (1 << 63) - 1, dtype=np.uint64)
    for p in parts:
        x = (x ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(BUCKETS)).astype(np.int64)


def features(texts: list[str], abouts: list[tuple[int, int]], lexicon: Lexicon):
    """(start and end of each token, number of the text, places of tokens alone, features of their surroundings one by one)."""
    keys, counts = [], []
    for t in texts:
        found = _TOKEN.findall(t)
        keys += found
        counts.append(len(found))
    at = lexicon.places(keys)
    whole, size, blank, name, shape, bits, key, word = lexicon.facts[at].T
    of = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    n, i = len(at), np.arange(len(at))
    if not n:
        return np.zeros((0, 2), dtype=np.int64), of, at, iter(())
    end = np.cumsum(whole)
    end -= np.repeat(np.where(first > 0, end[np.maximum(first, 1) - 1], 0), counts)
    place = i - first[of]
    back = lambda x, k: np.where(place >= k, np.concatenate([np.zeros(k, dtype=x.dtype), x[:-k]])[:n], 0)
    last = np.append(of[1:] != of[:-1], True)
    ahead = lambda x, other: np.where(last, other, np.append(x[1:], other))
    chunk_start = (blank > 0) | (place == 0)
    chunk = np.cumsum(chunk_start) - 1
    starts = np.flatnonzero(chunk_start)
    length = np.add.reduceat(size, starts)
    kinds = np.bitwise_or.reduceat(bits, starts)
    length = np.where(length < 8, length, 8 + np.minimum(12, length // 4))
    into = np.minimum(i - starts[chunk], 4)
    # The last key word of the same text within twelve tokens, the words since then, and whether = or : came after it.
    seen = np.maximum.accumulate(np.where(key > 0, i, -1))
    seen = np.concatenate([[-1], seen[:-1]])
    near = (seen >= first[of]) & (i - seen <= 12)
    words, set_ = np.cumsum(word), np.maximum.accumulate(np.where(name == _EQUALS, i, np.where(name == _COLON, i, -1)))
    set_ = np.concatenate([[-1], set_[:-1]])
    since = np.where(near, np.minimum(words - word - words[seen], 3) * 4 + (set_ > seen) * 2 + (i - seen < 4), 99)
    glued = 1 - blank
    f, g = np.array(abouts, dtype=np.int64).reshape(-1, 2).T

    def about():
        one, two = back(name, 1), back(name, 2)
        yield _mixed(1, one, shape)
        yield _mixed(2, two, one)
        yield _mixed(3, back(name, 3), two, shape)
        yield _mixed(4, back(shape, 1), glued, shape)
        yield _mixed(5, ahead(shape, 1), ahead(glued, 0), shape)
        yield _mixed(6, since, shape)
        yield _mixed(7, since, glued, into)
        yield _mixed(8, kinds[chunk], into, bits)
        yield _mixed(9, kinds[chunk], length[chunk], into)
        yield _mixed(10, f[of], shape)
        yield _mixed(11, g[of], shape)
        yield _mixed(12, length[chunk], shape)

    return np.stack([end - size, end], axis=1), of, at, about()


_EQUALS, _COLON = (int((ord(c) + 1) * _POWERS[0]) & (1 << 62) - 1 for c in "=:")


def viterbi(scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of sequences set end to end (``start``: their first tokens): products of blocks, a pass over blocks, then all blocks at once."""
    n = len(scores)
    if not n:
        return np.zeros(0, dtype=np.int8)
    blocks = -(-n // BLOCK)
    e = np.zeros((blocks * BLOCK, 3))
    e[:n] = scores
    e[:n][start, I] = -1e9
    on = np.zeros(blocks * BLOCK)
    on[:n] = ~start
    e, on = np.ascontiguousarray(e.reshape(blocks, BLOCK, 3).transpose(1, 2, 0)), np.ascontiguousarray(on.reshape(blocks, BLOCK).T)
    product = [np.where(np.arange(3)[:, None] == j, 0.0, -1e18) + np.zeros((3, blocks)) for j in range(3)]
    for k in range(BLOCK):
        product = [np.maximum(np.maximum(product[0] + moves[0, j] * on[k], product[1] + moves[1, j] * on[k]), product[2] + moves[2, j] * on[k]) + e[k, j] for j in range(3)]
    into, v = [], (0.0, 0.0, 0.0)
    for p in np.stack(product).transpose(2, 0, 1).tolist():
        into.append(v)
        v = [max(v[0] + x[0], v[1] + x[1], v[2] + x[2]) for x in p]
        top = max(v)
        v = [x - top for x in v]
    now, came, new = np.array(into).T, np.empty((BLOCK, 3, blocks), dtype=np.int8), on == 0
    for k in range(BLOCK):
        step = []
        for j in range(3):
            b, i, o = (now[m] + moves[m, j] * on[k] for m in range(3))
            bi = np.maximum(b, i)
            # Into a new text, as at the end, nothing is added on the way: there outside goes before inside before begin.
            came[k, j] = np.where((o > bi) | (new[k] & (o == bi)), O, np.where((i > b) | (new[k] & (i == b)), I, B))
            step.append(np.maximum(bi, o) + e[k, j])
        now = np.stack(step)
    whence, every = np.repeat(np.arange(3)[:, None], blocks, axis=1), np.arange(blocks)
    for k in reversed(range(BLOCK)):
        whence = came[k][whence, every]
    tag, ends = max((O, I, B), key=lambda x: v[x]), []
    for w in reversed(whence.T.tolist()):
        ends.append(tag)
        tag = w[tag]
    cur, tags = np.array(ends[::-1]), np.empty((BLOCK, blocks), dtype=np.int8)
    for k in reversed(range(BLOCK)):
        tags[k] = cur
        cur = came[k][cur, every]
    return tags.T.ravel()[:n]


class Model:
    def __init__(self, weights: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None):
        self.weights, self.moves, self.pairs, self.table, self.lexicon = [tuple(w) for w in weights.tolist()], moves.tolist(), pairs, weights, None

    def __getstate__(self):
        return self.table, np.array(self.moves), self.pairs

    def __setstate__(self, state):
        self.__init__(*state)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi; inside follows begin or inside only."""
        w, m, back, best = self.weights, self.moves, [], None
        for row in rows:
            b = i = o = 0.0
            for f in row:
                x = w[f]
                b += x[0]
                i += x[1]
                o += x[2]
            if best is None:
                best = (b, float("-inf"), o)
                continue
            step, now = [], []
            for to, e in ((B, b), (I, i), (O, o)):
                score, frm = max((best[k] + m[k][to], -k) for k in (B, I, O))
                step.append(-frm)
                now.append(score + e)
            best = tuple(now)
            back.append(step)
        tag = max((B, I, O), key=lambda k: (best[k], k))
        out = [tag]
        for step in reversed(back):
            tag = step[tag]
            out.append(tag)
        return out[::-1]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of each text; a text's own tokens alone decide on them."""
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) > 4 * AT_ONCE:
                out += self._spans(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self._spans(some)

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.pairs)
        at, of, places, about = features(texts, [file_features(t) for t in texts], self.lexicon)
        known = self.table[self.lexicon.alone].sum(axis=1)
        scores = known[places]
        for x in about:
            scores += self.table[x]
        tags = viterbi(scores, np.append(True, of[1:] != of[:-1])[: len(of)], np.array(self.moves))
        out, before = [[] for _ in texts], -2
        for i in np.flatnonzero(tags != O).tolist():
            k, a, b = int(of[i]), int(at[i, 0]), int(at[i, 1])
            if tags[i] == I and before == i - 1 and out[k]:
                out[k][-1] = (out[k][-1][0], b)
            else:
                out[k].append((a, b))
            before = i
        return out


def scan_all(texts: list[str | None], model: Model) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text the fixed patterns' spans, and all spans; both by start, then kind."""
    out = []
    for text, own in zip(texts, model.spans([t or "" for t in texts])):
        base = [x[:3] for x in base_spans(text)] if text else []
        added, i, reach = [], 0, -1
        for a, b in own:
            while i < len(base) and base[i][1] < b:
                reach = max(reach, base[i][2])
                i += 1
            if reach <= a:
                added.append(("crf", a, b))
        out.append((base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))))
    return out


def scan(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    return scan_all([text], model)[0]


def _tags(at: list[tuple[int, int]], secret: list[tuple[int, int]]) -> list[int]:
    out, before = [], None
    for a, b in at:
        inside = next(((x, y) for x, y in secret if x <= a and b <= y), None)
        out.append(O if not inside else I if inside == before else B)
        before = inside
    return out


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


_LEADS = ("key=", "client_key: ", "Authorization: Bearer ", "pwd=", "pwd: ", "auth = \"", "PRIVATE_KEY=", "credential: ", "signature=", "pass: ", "access_key = ", "passphrase: ", "login: ", "DB_PASS='", "auth_key=", "user_pwd: ", "pin: ")


def _made_up(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(text before the secret, secret or harmless value, text after); harmless ones have an empty mark in front."""
    pick = lambda n, of=_ALNUM: "".join(rng.choice(of) for _ in range(n))
    digits = lambda n: pick(n, "0123456789")
    letters, upper, hexa = _ALNUM[:52], _ALNUM[:26] + _ALNUM[52:], "0123456789abcdef"
    word = lambda: rng.choice(words)
    chance = rng.random()
    if chance < 0.3:
        secret = rng.choice([
            lambda: "ghp_" + pick(36), lambda: "sk_live_" + pick(24), lambda: "xoxb-" + digits(11) + "-" + pick(24), lambda: "eyJ" + pick(20) + "." + pick(40) + "." + pick(32),
            lambda: pick(rng.randint(20, 48)), lambda: pick(rng.randint(20, 40), _ALNUM + "+/") + "==", lambda: pick(rng.randint(24, 40), upper), lambda: pick(rng.randint(12, 18)), lambda: pick(40, hexa.upper()), lambda: "AIza" + pick(35), lambda: pick(rng.randint(14, 40), letters),
        ])()
        return "" if rng.random() < 0.5 else rng.choice(_LEADS), secret, rng.choice(["", "\"", ",", ".", "\n"])
    if chance < 0.55:
        # After a key word, any value: short ones, words, letters only, broken up by signs.
        secret = rng.choice([
            lambda: pick(rng.randint(4, 8)), lambda: pick(rng.randint(8, 24), letters), lambda: pick(rng.randint(6, 12), letters[26:]), lambda: word() + digits(rng.randint(1, 4)), lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 3))), word, lambda: digits(rng.randint(4, 6)),
            lambda: "".join(rng.choice([pick(rng.randint(1, 4)), rng.choice("@!#$%^&*?~+")]) for _ in range(rng.randint(4, 9))) + pick(2), lambda: word() + rng.choice("@!#$%&*-_") + pick(rng.randint(2, 6)), lambda: pick(rng.randint(1, 2)) + rng.choice("@$") + pick(rng.randint(1, 3)) + rng.choice("!#%") + pick(rng.randint(1, 5)),
            lambda: (word() + word()).translate({97: "@", 115: "$", 105: "!", 111: "0", 101: "3"}), lambda: pick(rng.randint(1, 4)) + rng.choice("@!#$%^&*?~+") + word().translate({111: "0", 101: "3"}),
        ])()
        if not secret[0].isalnum():
            secret = pick(1) + secret
        return rng.choice(_LEADS), secret, rng.choice(["", "\n", " "])
    plain = rng.choice([
        lambda: ".".join(digits(rng.randint(1, 3)) for _ in range(4)), lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", lambda: f"+1-555-{digits(4)}", lambda: f"555-{digits(4)}-{digits(4)}", lambda: f"555-{digits(4)}", lambda: digits(rng.choice([8, 10, 16])), lambda: f"{word()}{digits(rng.randint(1, 2))}@mail{digits(1)}.example.com", lambda: f"{word()}@{word()}.org",
        lambda: f"mail{digits(1)}.example.com", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}-beta", lambda: f"report_20{digits(2)}-0{rng.randint(1, 9)}.pdf", lambda: f"www.example{digits(1)}.org/page/{digits(3)}", lambda: f"chapter{digits(2)}.txt", lambda: f"{pick(8, _ALNUM[26:52])}{digits(2)}", lambda: f"{digits(3)}.{digits(3)}.{digits(2)}", lambda: f"ISBN-{digits(3)}-{digits(9)}",
        lambda: word() + word().capitalize() + word().capitalize(), lambda: f"https://{word()}.com/{word()}/{word()}", lambda: word().upper(), lambda: word() + word(), lambda: f"{word()}_{word()}({word()})",
    ])()
    if rng.random() < 0.2:
        # Key words in prose, without a value.
        return "\0" + rng.choice(["the key ", "a token of ", "pass the ", "key ", "secret ", "passwords are ", "the author ", "tokens, ", "pass. "]), word(), " " + word()
    return "\0" + rng.choice(["", "", "call ", "from ", "id=", "page: ", "see ", "name = ", "title: ", "write to "]), plain, rng.choice(["", ".", ",", ")"])


def examples(texts: list[tuple[str, int, int]], made_up: int = MADE_UP) -> tuple[list[tuple[np.ndarray, list[int]]], np.ndarray]:
    """Tagged tokens of the sample (cut-outs, with the file features of their whole texts) and of made-up secrets and harmless values; surprise of pairs of letters."""
    rng, all_ = random.Random(11), []
    for text, *about in texts:
        all_.append((text, about, [(x[3], x[2]) for x in base_spans(text)]))
    contexts = [x for x in texts if len(x[0]) > 80] or [("the quick brown fox jumps over the lazy dog and runs on " * 3, f, g) for f in range(3) for g in range(2)]
    words = sorted({w for t, *_ in contexts for w in re.findall(r"\b[a-z]{3,10}\b", t)}) or ["word"]
    for _ in range(made_up):
        lead, value, tail = _made_up(rng, words)
        text, *about = rng.choice(contexts)
        at = rng.randrange(max(1, len(text) - 60))
        left, right = text[max(0, at - AROUND) : at].rpartition(" ")[0], text[at : at + AROUND].partition(" ")[2]
        harmless, lead = lead[:1] == "\0", lead.lstrip("\0")
        start = len(left) + 1 + len(lead)
        whole = f"{left} {lead}{value}{tail} {right}"
        own = [] if harmless else [(start, start + len(value))]
        all_.append((whole, about, own + [(x[3], x[2]) for x in base_spans(whole) if harmless or x[2] <= start or x[3] >= start + len(value)]))
    pairs = letter_pairs([t for t, *_ in texts] or [contexts[0][0]])
    lexicon = Lexicon(pairs)
    at, of, places, about = features([t for t, _, _ in all_], [tuple(a) for _, a, _ in all_], lexicon)
    rows = np.concatenate([lexicon.alone[places], np.stack(list(about), axis=1)], axis=1)
    cuts = np.searchsorted(of, np.arange(len(all_) + 1))
    return [(rows[a:b], _tags(at[a:b].tolist(), secret)) for a, b, (_, _, secret) in zip(cuts, cuts[1:], all_) if b > a], pairs


def fit(data: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, most: int = 48, pairs: np.ndarray | None = None) -> Model:
    """Full-gradient ascent (Adagrad) on the mean conditional log-likelihood, with forward-backward over padded sequences."""
    data = [(r[i : i + most], [B if t[i] == I else t[i], *t[i + 1 : i + most]]) for r, t in data for i in range(0, len(r), most)]
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    moves[O, I] = -1e9
    if not data:
        weights[:, O] = 1.0
        return Model(weights, moves, pairs)
    n, steps, width = len(data), max(len(r) for r, _ in data), len(data[0][0][0])
    rows, tags, there = np.zeros((n, steps, width), dtype=np.int64), np.full((n, steps), O), np.zeros((n, steps), dtype=bool)
    for k, (r, t) in enumerate(data):
        rows[k, : len(r)], tags[k, : len(t)], there[k, : len(r)] = r, t, True
    gold = np.eye(3)[tags] * there[..., None]
    both = there[:, 1:] & there[:, :-1]
    gold_moves = np.einsum("ns,nsi,nsj->ij", both.astype(float), np.eye(3)[tags][:, :-1], np.eye(3)[tags][:, 1:])
    flat, seen_w, seen_m = np.ascontiguousarray(rows[there].T), np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(epochs):
        e = np.zeros((n, steps, 3))
        e[there] = sum(weights[x] for x in flat)
        e[:, 0, I] = -1e9
        # Forward and backward, each step scaled to a sum of 1.
        x, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(np.maximum(moves, -700))
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
        for s in range(1, steps):
            a = (alpha[:, s - 1] @ m) * x[:, s] + 1e-300
            alpha[:, s] = a / (a @ np.ones((3, 1)))
        for s in range(steps - 2, -1, -1):
            a = (x[:, s + 1] * beta[:, s + 1]) @ m.T + 1e-300
            beta[:, s] = np.where(there[:, s + 1, None], a / (a @ np.ones((3, 1))), 1)
        chance = alpha * beta
        chance *= there[..., None] / chance.sum(axis=2, keepdims=True)
        ahead = x[:, 1:] * beta[:, 1:]
        z = ((alpha[:, :-1] @ m) * ahead).sum(axis=2) + 1e-300
        pair = (alpha[:, :-1] * (both / z)[..., None]).reshape(-1, 3).T @ ahead.reshape(-1, 3) * m
        gap = (gold - chance)[there] / n
        grad = np.stack([sum(np.bincount(x, gap[:, k], BUCKETS) for x in flat) for k in range(3)], axis=1) - 1e-6 * weights
        grad_moves = (gold_moves - pair) / n
        seen_w += grad**2
        seen_m += grad_moves**2
        weights += 0.5 * grad / np.sqrt(seen_w)
        moves += np.where(moves < -1e8, 0, 0.5 * grad_moves / np.sqrt(seen_m))
    return Model(weights, moves, pairs)


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on about ``sample_rows`` of the rows with a text, drawn by a hash of the text."""
    rows = docs.select(docs[text_col].alias("text")).filter("text <> ''")
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = rows.filter(F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) < share * float(1 << 53))

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of each drawn text cut-outs with the file features of the whole: around its fields and base spans, and one from anywhere."""
        out = []
        for t in batch.column(0).to_pylist():
            found = [(a, b) for a, b in fields(t) if b - a <= SAMPLE_CHARS][:SAMPLE_FIELDS]
            found += [(a, b) for _, a, b, _ in base_spans(t) if b - a <= SAMPLE_CHARS and not _DIGIT.search(t, a, b)][:SAMPLE_FIELDS]
            found.append((zlib.crc32(t[:1000].encode("utf-8", "replace")) % len(t),) * 2)
            about, done = file_features(t), -1
            for a, b in sorted(found):
                if a >= done:
                    # Whole chunks only: half a secret would be none.
                    x, y = max(0, a - AROUND), min(len(t), b + AROUND)
                    x, y = t.find(" ", x, a) + 1 if x and " " in t[x:a] else x, t.rfind(" ", b, y) if y < len(t) and " " in t[b:y] else y
                    out.append((t[x:y], *about))
                    done = y
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], of) for k, of in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["text", "f", "g"])

    texts = sorted(tuple(r) for r in map_slices(drawn, around, "text string, f bigint, g bigint").orderBy(F.xxhash64("text"), "text", "f", "g").limit(2 * sample_rows).collect())
    data, pairs = examples(texts)
    return fit(data, pairs=pairs)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(train(docs))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_all(batch.column(1).to_pylist(), shared.value)
        counts = [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]), pa.array([_joined(every) for _, every in found])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_slices(docs, step, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in the text; all columns as they came, but for the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cut(text, spans):
        out, done = [], 0
        for _, a, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if spans else text

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = batch.column(at).to_pylist()
        cuts = [cut(t, spans) for t, (_, spans) in zip(texts, scan_all(texts, shared.value))]
        return batch.set_column(at, batch.schema.field(at), pa.array(cuts, batch.schema.field(at).type))

    return map_slices(docs, step, docs.schema, text_col)
