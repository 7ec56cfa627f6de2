"""Byte-level BPE as a lazily determinised transducer.

A byte sequence has exactly one segmentation that the merge list can produce, and a segmentation is that one exactly
when each two neighbouring tokens could stand side by side (merging never crosses their border). So the last token of
every prefix is determined by the last tokens of shorter prefixes, and encoding is a left-to-right walk. A state of the
transducer is what that walk still needs: the token before the undecided bytes, and these bytes. States and edges are
made when first used; an edge carries the tokens that no later byte can change. The undecided bytes are never more than
the longest vocabulary entry, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array

import regex

# The split pattern that belongs to the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RUN = re.compile(r"(\s\s+\S*)")
_BLANK = re.compile(r"(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: one base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece of split text at a time. ``max_states`` bounds memory: beyond it, states are made anew."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 2_000_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.max_states = max_states
        # Every beginning of an entry: its id, or -1 where it is no entry; and whether a longer entry begins so.
        inner = {token[:n] for token in ranks for n in range(1, len(token))}
        self.known = {part: (ranks.get(part, -1), part in inner) for part in inner | ranks.keys()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.single = [bytes([b]) for b in range(256)]
        self._reset()

    def _reset(self) -> None:
        # A state's open places: where a later token may begin, with the tokens of the undecided bytes before it.
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.keys: list[tuple[int, bytes]] = [(-1, b"")]
        self.open: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())]]
        self.edges: dict[int, tuple[tuple[int, ...], int]] = {}
        self.ends: list[tuple[int, ...]] = [()]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = self._merge(self.tokens[token], below=token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging with the tokens under an id; used on single vocabulary entries only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge would have crossed the border between the two tokens.

        Both tokens are taken apart in the reverse order of their merges. At each moment the pieces at the border are
        those that met there; had a merge of these two come before the next merge inside, it would have been taken.
        """
        known = self.beside.get((left, right))
        if known is None:
            a, b, taken = left, right, 1 << 62
            known = True
            while True:
                joint = self.ranks.get(self.tokens[a] + self.tokens[b])
                if joint is not None and joint < taken:
                    known = False
                    break
                splits_a, splits_b = self._split(a), self._split(b)
                if splits_a is None and splits_b is None:
                    break
                # The later merge is undone first. Of equal ids the right one was merged later.
                if splits_b is None or (splits_a is not None and a > b):
                    taken, a = a, splits_a[1]
                else:
                    taken, b = b + 1, splits_b[0]
            self.beside[left, right] = known
        return known

    def _edge(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        before, data = self.keys[state]
        data += self.single[byte]
        places, whole, known = [], None, self.known
        for place in self.open[state]:
            entry = known.get(data[place[0] :])
            if entry is None:
                continue
            token, longer = entry
            if longer:
                places.append(place)
            if whole is None and token >= 0:
                way = place[1]
                last = way[-1] if way else before
                if last < 0 or self.fits(last, token):
                    whole = (*way, token)
        if whole is not None:
            places.append((len(data), whole))
        out = places[0][1]
        if out:
            for _, way in places:
                while way[: len(out)] != out:
                    out = out[:-1]
        if out:
            n, cut = len(out), 0
            for token in out:
                cut += len(self.tokens[token])
            before, data = out[-1], data[cut:]
            places = [(start - cut, way[n:]) for start, way in places]
            whole = None if whole is None else whole[n:]
        key = (before, data)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.open.append(places)
            self.ends.append(whole)
        edge = self.edges[state << 8 | byte] = (out, target)
        return edge

    def encode(self, piece: bytes) -> list[int]:
        if len(self.keys) > self.max_states:
            self._reset()
            self.beside.clear()
        state, ids, edges = 0, [], self.edges.get
        for byte in piece:
            out, state = edges(state << 8 | byte) or self._edge(state, byte)
            if out:
                ids += out
        ids += self.ends[state]
        return ids


class _Cache(dict):
    """Packed ids by text, made by ``make`` when first asked for; emptied when it holds ``most`` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Whole texts to ids. Texts between single blanks are looked up first, as nearly all of them recur."""

    def __init__(self, path: str, max_cached: int = 400_000):
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(SPLIT).findall
        self.pieces = _Cache(self._piece, max_cached)
        self.words = _Cache(self._parts, max_cached)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as native 32-bit integers; none for an empty text or a null."""
        if not text:
            return b""
        # Runs of white space go with the word behind them; all other white space is single. The split pattern then has
        # a border before every run and every blank, so the parts are independent of each other.
        parts = _RUN.split(text)
        if "\0" in text or len(parts) > 1:
            words: list[str] = []
            for i, part in enumerate(parts):
                words += [part] if i % 2 else _BLANK.split(part) if "\0" in part else part.replace(" ", "\0 ").split("\0")
        else:
            words = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class StreamDecoder:
    """Ids to text, id by id; characters come out once all their bytes are there. ``close`` gives what is left."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", final=True)
