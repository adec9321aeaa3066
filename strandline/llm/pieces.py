"""SentencePiece encoding by suffix arrays, and decoding.

New words of a batch are put one behind the other and indexed by a suffix array. Binary search
finds the range of suffixes that start with a piece, for all pieces of the vocabulary at once: an edge
for each occurrence. Edges are sorted by where they end in their word and relaxed in that order.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import tidy, worker_state
from strandline.llm.tokens import Memo, digests, numbered, slices, split_once

BLANK = "▁"
CUT = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")
NEVER = np.iinfo(np.int64).max
BATCH_CHARS = 1 << 18


def _own_merges(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that merging makes a piece of last; None for what it never becomes."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], NEVER), i))
        if parts[best] + parts[best + 1] not in rank:
            return None
        last = parts[best], parts[best + 1]
        parts[best:best + 2] = ["".join(last)]
    return last


class PieceEncoder(Memo):
    """Byte-pair merging with a SentencePiece vocabulary, without merging.

    Merging prefers the better score, then the left. A word's pieces are the one path of edges on
    which every two neighbours are compatible: merging their two strings gives just these two. So
    an edge is relaxed by asking whether it is compatible with the one edge that ends where it starts.

    Characters outside the vocabulary are edges of their own, written as bytes. Words with
    several blanks before them go to the library, since pieces of blanks have equal scores.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i)
                                                or model.is_byte(i) or model.is_unused(i))]
        self.names = {i: model.id_to_piece(i) for i in plain}
        if any(BLANK in name.lstrip(BLANK) for name in self.names.values()):
            raise ValueError("a piece goes on behind a blank")
        self.id_of = {name: i for i, name in self.names.items()}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        order = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in plain}))}
        rank = {name: order[-model.get_score(i)] for i, name in self.names.items()}

        # Of each piece: rank of the merge that makes it (-1: a character), its parts, whether it can stand.
        self.rank = np.full(size + 0x110000, -1, np.int64)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.stands = np.ones(size + 0x110000, bool)
        pairs = {}
        for i, name in self.names.items():
            for cut in range(1, len(name)):
                a, b = self._symbol(name[:cut]), self._symbol(name[cut:])
                if a is not None and b is not None:
                    pairs[a * self.rank.size + b] = rank[name]
            if len(name) > 1:
                self.rank[i] = rank[name]
                last = _own_merges(name, rank)
                self.stands[i] = last is not None
                if last:
                    self.left[i], self.right[i] = self._symbol(last[0]), self._symbol(last[1])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.size = size
        self.width = np.array([len(self.names.get(i, "")) for i in range(size)])
        self.longest = max(map(len, self.names.values()))
        self.inner = {name[i:i + 2] for name in self.names.values() for i in range(len(name) - 1)}
        self.searched = np.array(list(self.names))
        self.spelled = np.full((len(self.names), self.longest), -1, np.int64)
        for row, name in enumerate(self.names.values()):
            self.spelled[row, :len(name)] = [ord(c) for c in name]
        super().__init__(ids=size)

    def _symbol(self, text: str) -> int | None:
        """Number of a piece, or of a character that is none."""
        found = self.id_of.get(text)
        return len(self.stands) - 0x110000 + ord(text) if found is None and len(text) == 1 else found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the strings of two pieces gives these two again.

        Goes back through the merges of both, the last one first: at no time may a merge across
        their border have been better than the one that was made.
        """
        fine = np.ones(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        while len(rows):
            keys = a * self.rank.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossing = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit)
            fine[rows[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossing & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb = rows[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[np.where(undo, a, 0)], a), np.where(undo, b, self.left[np.where(undo, 0, b)])
        return fine

    # ---- suffix array and search

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Places of a text in the order of the suffixes there, told apart by as many characters as pieces have."""
        order = np.argsort(codes)
        rank, width = codes.astype(np.int64), 1
        while width < self.longest:
            after = np.zeros_like(rank)
            after[:-width] = rank[width:] + 1
            key = rank * (rank.max() + 2) + after
            order = np.argsort(key)
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            width *= 2
        return order

    def occurrences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in the text, and which; each piece found by two binary searches."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        order = self.suffixes(codes)
        padded = np.concatenate([codes, np.full(self.longest, -1)])
        present = np.zeros(0x110001, bool)
        present[codes] = present[-1] = True
        rows = np.flatnonzero(present[self.spelled].all(1))
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted, ids = self.spelled[rows], self.searched[rows]
        sizes, count = self.width[ids], len(rows)

        def search(behind: bool) -> np.ndarray:
            low, high = np.zeros(count, np.int64), np.full(count, len(order), np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                at = order[np.minimum(middle, len(order) - 1)]
                sign, undecided = np.zeros(count, np.int8), open_.copy()
                for k in range(self.longest):
                    undecided &= k < sizes
                    rows = np.flatnonzero(undecided)
                    if not len(rows):
                        break
                    gap = np.sign(padded[at[rows] + k] - wanted[rows, k])
                    sign[rows] = gap
                    undecided[rows[gap != 0]] = False
                right = open_ & ((sign <= 0) if behind else (sign < 0))
                low = np.where(right, middle + 1, low)
                high = np.where(open_ & ~right, middle, high)
            return low

        first, last = search(False), search(True)
        counts = last - first
        ends = np.cumsum(counts)
        take = np.repeat(first - ends + counts, counts) + np.arange(ends[-1])
        return order[take], np.repeat(ids, counts)

    # ---- words

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words: edges of all words by the place in the word where they end, then relaxed."""
        text = "\0".join(words)
        lengths = np.array([len(w) for w in words])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        starts, pieces = self.occurrences(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        single = np.ones(len(codes), bool)
        wide = self.width[pieces]
        single[starts[wide == 1]] = False
        single[codes == 0] = False
        lone = np.flatnonzero(single)
        starts = np.concatenate([starts, lone])
        pieces = np.concatenate([pieces, self.size + codes[lone]])
        stops = starts + np.concatenate([wide, np.ones(len(lone), np.int64)])
        word = np.searchsorted(begins, starts, "right") - 1
        inside = stops - begins[word]
        keep = self.stands[pieces]
        order = np.argsort(inside[keep], kind="stable")
        starts, pieces, stops, word, inside = (x[keep][order] for x in (starts, pieces, stops, word, inside))
        ends_at = np.searchsorted(inside, np.arange(1, lengths.max() + 2))

        last = np.full(len(codes) + 2, -1, np.int64)     # piece that ends before this place
        back = np.zeros(len(codes) + 2, np.int64)
        for a, b in zip(ends_at[:-1], ends_at[1:]):
            s, p, e, w = starts[a:b], pieces[a:b], stops[a:b], word[a:b]
            opening = s == begins[w]
            before = np.where(opening, 0, last[s])
            good = opening.copy()
            rows = np.flatnonzero(~opening & (before >= 0))
            good[rows] = self.compatible(before[rows], p[rows])
            last[e[good]], back[e[good]] = p[good], s[good]
        return self._paths(begins, begins + lengths, last, back)

    def _paths(self, begins, ends, last, back) -> list[np.ndarray]:
        at, words = ends.copy(), np.arange(len(begins))
        steps = []
        while len(words):
            if (last[at] < 0).any():
                raise ValueError("a word has no path of pieces")
            steps.append((words, last[at]))
            at = back[at]
            go = at > begins[words]
            words, at = words[go], at[go]
        owner = np.concatenate([w for w, _ in reversed(steps)])
        symbol = np.concatenate([s for _, s in reversed(steps)])
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        cuts = np.searchsorted(owner, np.arange(len(begins) + 1))
        ids = symbol.astype(np.uint32)
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for word in np.unique(owner[symbol >= self.size]).tolist():
            out[word] = self._with_bytes(symbol[cuts[word]:cuts[word + 1]])
        return out

    def _with_bytes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids where characters outside the vocabulary are written as bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s < self.size else self.bytes[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.uint32)

    def _learn(self, chunks: list[str]) -> None:
        """Keep the ids of new words; long ones are cut where no piece holds the two characters beside."""
        runs = [c for c in chunks if BLANK * 2 in c or "\0" in c]
        self._keep(runs, [np.array(self.model.encode(c.replace(BLANK, " ")[1:]), np.uint32) for c in runs])
        odd = set(runs)
        parts = {c: self._cut(c) for c in chunks if c not in odd}
        whole = {c for c, ps in parts.items() if len(ps) == 1}
        new = [*whole, *self.missing(list(dict.fromkeys(p for ps in parts.values() if len(ps) > 1 for p in ps if p not in whole)))]
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and (stop == at or size + len(new[stop]) < BATCH_CHARS):
                size += len(new[stop]) + 1
                stop += 1
            self._keep(new[at:stop], self.encode_words(new[at:stop]))
            at = stop
        several = [(c, ps) for c, ps in parts.items() if len(ps) > 1]
        if several:
            ids, lengths = self.young.gather(self.young.find(digests([p for _, ps in several for p in ps])))
            firsts = np.cumsum([0, *(len(ps) for _, ps in several[:-1])])
            self.young.keep(digests([c for c, _ in several]), ids, np.add.reduceat(lengths, firsts))

    def _keep(self, names: list[str], arrays: list[np.ndarray]) -> None:
        if names:
            self.young.keep(digests(names), np.concatenate(arrays), np.array([len(a) for a in arrays], np.int64))

    def _cut(self, word: str) -> list[str]:
        if len(word) <= 24:
            return [word]
        cuts = [0] + [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inner] + [len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as the library gives them; of a null one, none."""
        self.turn()
        out = [np.zeros(0, np.uint32)] * len(texts)
        plain, normal, apart, flat, sizes = [], [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            text = self.model.normalize(text)
            if text[:1] == BLANK and BLANK * 2 not in text:
                plain.append(i)
                normal.append(text[1:])
            else:
                words = CUT.split(text)
                apart.append(i)
                sizes.append(len(words))
                flat += words
        if apart:
            names, codes = numbered(flat)
            for i, ids in zip(apart, self.joined(self.known(names)[codes], np.array(sizes))):
                out[i] = ids
        if plain:
            names, codes, sizes = split_once(normal, BLANK)
            for i, ids in zip(plain, self.joined(self.known([BLANK + n for n in names])[codes], sizes)):
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, blanks back to spaces, the first one dropped."""
        if not hasattr(self, "spelling"):
            spelled = [(self.names.get(i, "").replace(BLANK, " ")).encode() for i in range(self.size)]
            for value, i in enumerate(self.bytes.tolist()):
                spelled[i] = bytes([value])
            sizes = np.array([len(x) for x in spelled])
            self.spelling = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes
        letters, starts, sizes = self.spelling
        lengths = sizes[ids]
        take = np.repeat(starts[ids] - np.cumsum(lengths) + lengths, lengths)
        take += np.arange(len(take))
        text = letters[take].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def piece_encoder(path: str) -> PieceEncoder:
    return worker_state(("pieces", path), lambda: PieceEncoder(path))


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts with a SentencePiece vocabulary and decode them again.

    Returns ``doc_id``, ``n_ids``, ``ids_crc32`` (of the ids as little-endian 32-bit integers) and
    ``restored``, whether the decoded text is the text. A null text is empty and has no ids. Rows with null
    or repeated keys are encoded each. Other columns are not read. What the vocabulary's normalisation
    changes is not restored.
    """
    def run(batches):
        coder = piece_encoder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts):
                found = coder.encode(texts[start:stop])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start).cast(pa.int64()),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                    pa.array([coder.decode(ids) == (t or "") for ids, t in zip(found, texts[start:stop])], pa.bool_())],
                    ["doc_id", "n_ids", "ids_crc32", "restored"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        lambda batches: tidy(run(batches)), "doc_id long, n_ids long, ids_crc32 long, restored boolean")
