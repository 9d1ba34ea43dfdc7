"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

Machines are compiled from a model. The normaliser rewrites the longest matches of the model's character map, squeezes spaces,
adds the dummy prefix and escapes spaces to U+2581. The pieces are a trie of states; from where a piece ends an arc leads
back to the first state, emits the piece and has its weight. The fallback takes a character that is no piece itself and emits its
bytes, or the unknown piece. Each text is composed with them lazily: a state of the composition is a place in the
normalised text with the piece that ends there, and the path to the text's end with the least tropical sum of weights has the text's pieces.

For a unigram model a piece's weight is its negated log probability; of paths of one weight the one found first is taken. A BPE model's scores rank merges and are no
weights of a path: there pieces weigh nothing, and one more machine, over pairs of neighbours, adds nothing where the model's merges leave
the two apart when they meet, and infinity otherwise. Every text then has one path of finite weight, the model's own encoding.
States that no arc leaps, before a run of U+2581 and around line ends without a piece, cut each path, so the parts between
them are solved once each and kept."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import with_arrays

SPACE = "▁"
#: Kinds of pieces and models in the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: By what the unknown piece weighs more than the dearest one, and what a user-defined piece weighs for each byte behind its first (fixed values).
UNKNOWN_PENALTY, USER_WEIGHT = 10.0, -0.1
INFINITY = float("inf")
#: What stands before a part's first piece; a character that is no piece stands as -1 less its code point.
START = -(1 << 30)
#: Parts of texts whose paths a worker keeps, through all its tasks; then it starts anew.
KEPT_PARTS = 400_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        v = s = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class _Parts(dict):
    """From a part of a text to its piece ids, as packed 32-bit numbers."""

    def __init__(self, solve):
        self.solve = solve

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_PARTS:
            self.clear()
        out = self.solve(part)
        if len(part) <= 64:
            self[part] = out
        return out


class Pieces:
    """The machine of pieces: states with arcs by characters, and the piece and the weight of the arc that leads back from each, -1 for none."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.emits: list[int] = [-1]
        self.weights: list[float] = [INFINITY]

    def add(self, text: str, piece: int, weight: float) -> None:
        state = 0
        for c in text:
            if c not in self.arcs[state]:
                self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.emits.append(-1)
                self.weights.append(INFINITY)
            state = self.arcs[state][c]
        self.emits[state], self.weights[state] = piece, weight


class Normaliser:
    """The machine before the pieces. A character map is a double array over UTF-8 with replacements behind it (a fixed
    format); its arcs are followed as texts need them. User-defined pieces pass as they are."""

    def __init__(self, spec: dict, user: re.Pattern | None):
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.user, self.units, self.values = user, [], b""
        if blob := spec.get(2):
            n = struct.unpack_from("<I", blob)[0]
            self.units, self.values = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]
        self.begins: dict[str, bool] = {}
        self.identity = not self.units and not self.squeeze and user is None

    def _step(self, state: int, c: str) -> tuple[int, bool] | None:
        """The state that a character's bytes lead to and whether a key ends there; states are places in the double array."""
        ends = False
        for byte in c.encode("utf-8", "surrogatepass"):
            state ^= byte
            if state >= len(self.units) or self.units[state] & 0x800000FF != byte:
                return None
            ends, state = bool(self.units[state] & 256), state ^ self._offset(state)
        return state, ends

    def _offset(self, state: int) -> int:
        unit = self.units[state]
        return unit >> 10 << ((unit & 512) >> 6)

    def _longest(self, text: str, at: int) -> tuple[int, str]:
        """The end of the map's longest key from a place on and what replaces it; the character itself if there is no key."""
        state, found = self._offset(0), (at + 1, text[at])
        for k in range(at, len(text)):
            step = self._step(state, text[k])
            if step is None:
                break
            state, ends = step
            if ends:
                value = self.units[state] & 0x7FFFFFFF
                found = k + 1, self.values[value : self.values.index(b"\0", value)].decode()
        return found

    def _mapped(self, text: str) -> str:
        if not self.units:
            return text
        for c in set(text).difference(self.begins):
            if len(self.begins) >= KEPT_PARTS:
                self.begins.clear()
            self.begins[c] = self._step(self._offset(0), c) is not None
        if not any(self.begins.get(c, True) for c in set(text)):
            return text
        out, at = [], 0
        while at < len(text):
            to, new = self._longest(text, at) if self.begins.get(text[at], True) else (at + 1, text[at])
            out.append(new)
            at = to
        return "".join(out)

    def readable(self, text: str) -> str:
        """The text as decoding should give it back."""
        if self.user is None:
            text = self._mapped(text)
        else:
            at, out = 0, []
            for m in self.user.finditer(text):
                out += [self._mapped(text[at : m.start()]), m[0]]
                at = m.end()
            text = "".join([*out, self._mapped(text[at:])])
        return re.sub(" +", " ", text.strip(" ")) if self.squeeze else text

    def run(self, text: str) -> str:
        """What the machine of pieces reads."""
        if not text or self.squeeze and not text.strip(" "):
            return ""
        space = SPACE if self.escape else " "
        text = space * self.prefix + self.readable(text).replace(" ", space)
        return text.rstrip(space) if self.squeeze else text


class Transducer:
    def __init__(self, model: bytes):
        self.pieces, kinds, scores = [], [], []
        self.kind, spec = UNIGRAM, {}
        for k, v in _fields(model):
            if k == 1:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif k == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif k == 3:
                spec = dict(_fields(v))
        if self.kind not in (UNIGRAM, BPE) or self.kind == BPE and UNUSED in kinds:
            raise ValueError("only unigram models and BPE models without unused pieces can be compiled")
        user = [p for p, k in zip(self.pieces, kinds, strict=True) if k == USER]
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        self.normaliser = Normaliser(spec, self.user)
        self.prefix = self.normaliser.prefix
        self.score = {p: s for p, s, k in zip(self.pieces, scores, kinds, strict=True) if k == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in kinds else None
        self.machine, self.fallback = Pieces(), UNKNOWN_PENALTY - min(self.score.values(), default=0.0) if self.kind == UNIGRAM else 0.0
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == USER and self.kind == UNIGRAM:
                self.machine.add(p, i, USER_WEIGHT * (len(p.encode()) - 1))
            elif k == NORMAL and (self.kind == UNIGRAM or self._merged(p) == [p]):
                self.machine.add(p, i, -self.score[p] if self.kind == UNIGRAM else 0.0)
        self.own = {p: struct.pack("<i", i) for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == USER} if self.kind == BPE else {}
        self.text = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.apart: dict[tuple[int, int], bool] = {}
        known = [p for p, k in zip(self.pieces, kinds, strict=True) if k in (NORMAL, USER)]
        line = "" if any("\n" in p for p in known) else "\n"  # cuts at line ends
        whole = any(SPACE in p.lstrip(SPACE) for p in known)  # no cuts at all
        self.cuts = None if whole else re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else ""))
        self.plain, self.spaced = _Parts(self.solve), _Parts(lambda w: self.solve(SPACE + w))
        self.by_lines = self.kind == BPE and self.normaliser.identity and self.prefix and self.normaliser.escape and bool(line) and not whole and self.bytes is not None

    def _merged(self, text: str) -> list[str]:
        """What the merges of a BPE model leave of a short text: the best-scored neighbours first, leftmost of equals."""
        s, score = list(text), self.score
        while True:
            best, at = -INFINITY, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _apart(self, a: int, b: int) -> bool:
        """The machine over pairs: whether b may follow a."""
        known = self.apart.get((a, b))
        if known is None:
            p, q = (self.pieces[x] if x >= 0 else chr(-1 - x) for x in (a, b))
            if len(self.apart) >= 4 * KEPT_PARTS:
                self.apart.clear()
            known = self.apart[a, b] = self._merged(p + q) == [p, q]
        return known

    def solve(self, part: str) -> bytes:
        """The ids on the shortest path through the composition with one part: its states in the order of their places, each relaxing
        the arcs of the pieces, and of the fallback, that leave it."""
        n, arcs, emits, weights, apart = len(part), self.machine.arcs, self.machine.emits, self.machine.weights, self.apart
        pairs, first = self.kind == BPE, self.machine.arcs[0]
        total = [0.0] + [INFINITY] * n
        last, came = [START] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here = total[i]
            if here == INFINITY:
                continue
            before, state, j, single = last[i], first.get(part[i]), i, False
            while state is not None:
                j += 1
                t = emits[state]
                if t >= 0:
                    single |= j == i + 1
                    w = here + weights[state]
                    if w < total[j] and (not pairs or before == START or (apart[before, t] if (before, t) in apart else self._apart(before, t))):
                        total[j], last[j], came[j] = w, t, i
                state = arcs[state].get(part[j]) if j < n else None
            if not single:
                t, w = -1 - ord(part[i]), here + self.fallback
                if w < total[i + 1] and (not pairs or before == START or self._apart(before, t)):
                    total[i + 1], last[i + 1], came[i + 1] = w, t, i
        out, j = [], n
        while j:
            out += [last[j]] if last[j] >= 0 else [self.bytes[b] for b in chr(-1 - last[j]).encode("utf-8", "surrogatepass")][::-1] if self.bytes else [self.unknown]
            j = came[j]
        return struct.pack(f"<{len(out)}i", *out[::-1])

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.plain.__getitem__, self.cuts.findall(text))) if self.cuts else self.solve(text)

    def encode(self, text: str) -> bytes:
        """Piece ids, as packed 32-bit numbers."""
        if not text:
            return b""
        if self.by_lines and not (SPACE in text or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text):
            return self._encode_lines(text)
        text = self.normaliser.run(text)
        if self.own:  # user-defined pieces of a BPE model take part in no merge
            out, at = [], 0
            for m in self.user.finditer(text):
                out += [self._parts(text[at : m.start()]), self.own[m[0]]]
                at = m.end()
            ids = b"".join([*out, self._parts(text[at:])])
        else:
            ids = self._parts(text)
        if self.bytes is None:  # neighbouring unknown characters are one piece
            x = np.frombuffer(ids, np.int32)
            ids = x[~((x == self.unknown) & (np.append(-1, x[:-1]) == self.unknown))].tobytes() if len(x) else ids
        return ids

    def _encode_lines(self, text: str) -> bytes:
        """The same for texts in which single spaces stand between words: words are looked up without escaping them first."""
        out: list[bytes] = []
        spaced, plain, newline = self.spaced.__getitem__, self.plain.__getitem__, self.plain["\n"]
        for k, line in enumerate(text.split("\n")):
            w = line.split(" ")
            if k:
                out.append(newline)
                if w[0]:
                    out.append(plain(w[0]))
                out += map(spaced, w[1:])
            elif line:
                out += map(spaced, w)
            else:
                out.append(plain(SPACE))
        return b"".join(out)

    def forget(self) -> None:
        """Drops the solved parts."""
        for kept in (self.plain, self.spaced, self.apart):
            kept.clear()

    def decode(self, ids) -> bytes:
        """UTF-8 text of piece ids."""
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=4)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def encode(docs: DataFrame, model: bytes, remember: bool = True) -> DataFrame:
    """docs with ids (the pieces of text), n_pieces and round_trip (whether decoding the ids gives the text back).

    model holds the bytes of a model file of bounded size, read by the caller, and goes to the workers as a broadcast. A null text
    has null ids, zero pieces and a null round_trip; an empty one an empty list. Where a model's normaliser changes characters or squeezes spaces,
    round_trip compares with what it makes of the text. remember: workers keep solved parts from task to task, which saves time and costs
    each up to some 100 MB. Rows are independent: nothing is shuffled."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        t = compiled(shared.value)

        def of(b):
            rows, trips = [], []
            for text in b.column("text").to_pylist():
                ids = None if text is None else t.encode(text)
                rows.append(ids)
                trips.append(None if text is None else t.decode(np.frombuffer(ids, np.int32).tolist()) == t.normaliser.readable(text).encode("utf-8", "surrogatepass"))
            n = np.array([len(x or b"") // 4 for x in rows], np.int64)
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(x for x in rows if x), np.int32))
            missing = pa.array([x is None for x in rows])
            return [pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing), pa.array(n), pa.array(trips, pa.bool_())]

        if not remember:
            of.close = t.forget
        return of

    return with_arrays(docs, make, "ids array<int>, n_pieces long, round_trip boolean")


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null ids give null, bytes that aren't UTF-8 the replacement character."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        t = compiled(shared.value)
        return lambda b: [pa.array([None if x is None else t.decode(x).decode("utf-8", "replace") for x in b.column(ids).to_pylist()], pa.string())]

    return with_arrays(df, make, f"{out} string")
