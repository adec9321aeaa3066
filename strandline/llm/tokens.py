"""Whole texts to token ids with a public tokenizer, encoding each distinct stretch of text once."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_128_digest

from strandline.llm.common import worker_state

CUT = re.compile(r" (?<=\S )")
STRETCH = re.compile(r"([^\W\d_]+)([.,;:!?]*\n?)([^\W\d_]*)")
# A space at the start or behind white space, where a text is not cut.
UNEVEN = (r"(^|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) ")
FIRST = "\0"
NOTHING = FIRST * 2
MEMO_BYTES = 32 << 20  # a generation's; there are two. A table of 2^20 places fits, one of twice as many does not
JOINED = 200
TEXT_CHARS = 1 << 20


def digests(names: list[str]) -> np.ndarray:
    """128-bit hashes of stretches as pairs of numbers, which stand for the stretches in a memo."""
    raw = b"".join([xxh3_128_digest(name.encode("utf-8", "surrogatepass")) for name in names])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


class Generation:
    """Ids of stretches of text, one behind the other, under the stretches' hashes in a table with open places.

    It takes some 50 bytes a stretch, no Python object.
    """

    def __init__(self, kind=np.uint32):
        self.keys, self.values = np.zeros((1 << 12, 2), np.uint64), np.full(1 << 12, -1, np.int32)
        self.ids = np.zeros(1 << 14, kind)
        self.starts = np.zeros(1 << 12, np.int64)
        self.count = 0

    @property
    def bytes(self) -> int:
        return self.keys.nbytes + self.values.nbytes + self.ids.nbytes + self.starts.nbytes

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[:, 0] & np.uint64(len(self.values) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of stretches, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        rows, at = np.arange(len(hashes)), self._places(hashes)
        while len(rows):
            value = self.values[at]
            taken = value >= 0
            same = taken & (self.keys[at] == hashes[rows]).all(1)
            out[rows[same]] = value[same]
            go = taken & ~same
            rows, at = rows[go], (at[go] + 1) & (len(self.values) - 1)
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        rows, at = np.arange(len(hashes)), self._places(hashes)
        while len(rows):
            free = np.flatnonzero(self.values[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = hashes[rows[won]], numbers[rows[won]]
            rest = np.ones(len(rows), bool)
            rest[won] = False
            rows, at = rows[rest], (at[rest] + 1) & (len(self.values) - 1)

    def keep(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add different new stretches; ``ids`` of all of them, ``lengths`` for each."""
        if not len(hashes):
            return
        n, start = self.count, int(self.starts[self.count])
        ends = start + np.cumsum(lengths)
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.zeros(len(self.ids) // 2 + len(ids), self.ids.dtype)])
        if n + len(hashes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) // 2 + len(hashes) + 1, np.int64)])
        self.ids[start:ends[-1]] = ids
        self.starts[n + 1:n + 1 + len(hashes)] = ends
        self.count = n + len(hashes)
        if self.count * 3 > len(self.values) * 2:
            held = np.flatnonzero(self.values >= 0)
            keys, values, size = self.keys[held], self.values[held], len(self.values)
            while self.count * 3 > size * 2:
                size *= 2
            self.keys, self.values = np.zeros((size, 2), np.uint64), np.full(size, -1, np.int32)
            self._insert(keys, values)
        self._insert(hashes, np.arange(n, self.count, dtype=np.int32))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches one behind the other, and how many each has."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        take = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        take += np.arange(len(take))
        return self.ids[take].astype(np.uint32), lengths


class Memo:
    """Ids of stretches seen lately, in two generations of about ``limit`` bytes at most.

    Stretches are looked up in the young generation, then in the old one, from where they are taken over.
    When the young one is full it becomes the old one, so that what is still in use is never learned again.
    """

    def __init__(self, limit: int = MEMO_BYTES, ids: int = 1 << 32):
        self.limit, self.kind = limit, np.uint16 if ids <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.young, self.old = Generation(self.kind), Generation(self.kind)

    def _learn(self, names: list[str]) -> None:
        """Keep the ids of different new stretches."""
        raise NotImplementedError

    def turn(self) -> None:
        """Let a full young generation become the old one; numbers found before are void then."""
        if self.young.bytes > self.limit:
            self.young, self.old = Generation(self.kind), self.young

    def _absent(self, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Places of the stretches that neither generation has; the old one's are taken over."""
        new = np.flatnonzero(numbers < 0)
        found = self.old.find(hashes[new])
        held = found >= 0
        self.young.keep(hashes[new[held]], *self.old.gather(found[held]))
        return new[~held]

    def missing(self, names: list[str]) -> list[str]:
        """Those of different stretches that have to be learned."""
        hashes = digests(names)
        return [names[i] for i in self._absent(hashes, self.young.find(hashes)).tolist()]

    def known(self, names: list[str]) -> np.ndarray:
        """Numbers of different stretches in the young generation; new ones are learned."""
        hashes = digests(names)
        numbers = self.young.find(hashes)
        absent = self._absent(hashes, numbers)
        if len(absent):
            self._learn([names[i] for i in absent.tolist()])
        late = np.flatnonzero(numbers < 0)
        numbers[late] = self.young.find(hashes[late])
        return numbers

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that are ``sizes`` stretches each."""
        ids, lengths = self.young.gather(numbers)
        stops = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:])]


def numbered(names: list[str]) -> tuple[list[str], np.ndarray]:
    """The different names, and the place of each name among them."""
    places: dict[str, int] = {}
    codes = np.array([places.setdefault(n, len(places)) for n in names], np.int64)
    return list(places), codes


def split_once(texts: list[str], mark: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at every ``mark``: the different parts, the number of each part in turn, and how many a text has.

    Arrow cuts and numbers them, so that only different parts become Python strings.
    """
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), mark)
    coded = parts.flatten().cast(pa.string()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), parts.value_lengths().to_numpy()


class ChunkEncoder(Memo):
    """Byte-level BPE by the tokenizers library, with the ids of stretches kept between texts.

    The pattern that the tokenizer splits texts with never joins a space that follows a
    non-space to what stands before it, so a text may be cut before each such space. Nor does it join letters to
    punctuation or a line end beside them, so words are encoded apart from these, many in one call.
    Texts with a special
    token's string or a null character go to the library whole.

    Stretches are named without their leading space; the first of a text, which has none, starts with ``FIRST``.
    """

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.line = self._library(["\n"])[0][0]
        super().__init__(limit, size)

    def _library(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + 4096], add_special_tokens=False)]
        return out

    def _words(self, words: list[str], space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters and how many each has, ``JOINED`` words in one text.

        With a space before each, a word starts at every id that starts with one; without,
        line ends stand between them.
        """
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        glue = " " if space else "\n"
        found = self._library([(" " if space else "") + glue.join(g) for g in groups])
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        if space:
            marks = np.flatnonzero(self.spaced[ids])
            lengths = np.diff(np.append(marks, len(ids)))
        else:
            # Behind each group a line end that its last word lacks is counted with it.
            ends = np.cumsum([len(x) for x in found])
            lines = np.flatnonzero(ids == self.line)
            stops = np.sort(np.concatenate([lines, ends]))
            begins = np.sort(np.concatenate([[0], lines + 1, ends[:-1]]))
            lengths, ids = stops - begins, np.delete(ids, lines)
        if len(lengths) != len(words):
            raise ValueError("words can't be told apart by their ids")
        return ids, lengths

    def _learn(self, chunks: list[str]) -> None:
        """Keep the ids of new chunks: of words, of what stands around them, and of both together."""
        atoms, parts, made, pieces = {}, {}, [], []
        for chunk in chunks:
            found = None if chunk.isalpha() else STRETCH.fullmatch(chunk, int(chunk[:1] == FIRST))
            head, middle, tail = found.groups() if found else ("", "", "")
            if middle and head.isalpha() and (not tail or tail.isalpha()):
                three = (FIRST + head if chunk[:1] == FIRST else head, FIRST + middle, FIRST + tail if tail else NOTHING)
                parts.update(dict.fromkeys(three))
                made.append(chunk)
                pieces.append(three)
            else:
                atoms[chunk] = None
        atoms.update(dict.fromkeys(self.missing([p for p in parts if p not in atoms])))
        spaced = [w for w in atoms if w.isalpha()]
        bare = [w for w in atoms if w[:1] == FIRST and w[1:].isalpha()]
        for names, words, space in ((spaced, spaced, True), (bare, [w[1:] for w in bare], False)):
            if names:
                self.young.keep(digests(names), *self._words(words, space))
        others = [w for w in atoms if not (w.isalpha() or w[:1] == FIRST and w[1:].isalpha())]
        found = self._library(["" if w == NOTHING else w[1:] if w[:1] == FIRST else " " + w for w in others])
        sizes = np.array([len(x) for x in found], np.int64)
        self.young.keep(digests(others), np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
        if made:
            ids, lengths = self.young.gather(self.young.find(digests([name for three in pieces for name in three])))
            self.young.keep(digests(made), ids, lengths.reshape(-1, 3).sum(1))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; of a null one, none."""
        self.turn()
        out = [np.zeros(0, np.uint32)] * len(texts)
        held = [i for i, text in enumerate(texts) if text]
        even = pc.match_substring_regex(pa.array([texts[i] for i in held], pa.large_string()), UNEVEN).to_pylist()
        plain, flat, sizes, apart = [], [], [], []
        for i, odd in zip(held, even):
            text = texts[i]
            if FIRST in text or any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif odd:
                cut = CUT.split(text)
                cut[0] = FIRST + cut[0]
                apart.append(i)
                sizes.append(len(cut))
                flat += cut
            else:
                plain.append(i)
        if apart:
            names, codes = numbered(flat)
            for i, ids in zip(apart, self.joined(self.known(names)[codes], np.array(sizes))):
                out[i] = ids
        if plain:
            names, codes, sizes = split_once([texts[i] for i in plain], " ")
            numbers = self.known(names)[codes]
            first = np.cumsum(sizes) - sizes
            openings, places = numbered([FIRST + names[c] for c in codes[first].tolist()])
            numbers[first] = self.known(openings)[places]
            for i, ids in zip(plain, self.joined(numbers, sizes)):
                out[i] = ids
        return out


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker for a tokenizer file."""
    return worker_state(("tokens", path), lambda: ChunkEncoder(path))


def slices(texts: list[str | None], chars: int = TEXT_CHARS):
    """Ranges of consecutive texts of about ``chars`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_arrays(path: str, texts: list[str | None], end: int | None = 0):
    """Ids of each text, with the end id behind them; never all texts' ids at once."""
    tail = np.array([] if end is None else [end], np.uint32)
    for start, stop in slices(texts):
        for ids in encoder(path).encode(texts[start:stop]):
            yield np.concatenate([ids.astype(np.uint32), tail])
