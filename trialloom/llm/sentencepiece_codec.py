"""SentencePiece encoding and decoding in batched numpy."""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import mix64, text_buffers, text_parts

# Kinds of models and of pieces in the model format, the space mark, the unknown penalty and surface.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
MARK = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "

#: Texts are encoded in parts of so many rows and bytes.
PART_ROWS, PART_BYTES = 4096, 2 << 20
#: Words' lengths are padded to the next of these; longer ones are cut into overlapping windows of the last.
BATCH_CHARS = (4, 8, 12, 16, 24, 32, 64)
#: Cells of a batch's table of substrings.
BATCH_CELLS = 1 << 22
#: Words that a task remembers, and bits of the number of its slots for pairs of pieces and of its index of piece keys.
REMEMBERED_WORDS, PAIR_BITS, INDEX_BITS = 1_500_000, 21, 20
NONE, LONE = -1, -2
_MARK = np.uint32(ord(MARK))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        return np.cumprod(p)


def _char_codes(chars: np.ndarray) -> np.ndarray:
    return mix64(chars.astype(np.uint64) + np.uint64(1))


class Codec:
    """Encodes and decodes with the pieces of a model file.

    Texts are cut into words before a space mark that follows other characters;
    no piece reaches over such a place (models that have one are refused). Each
    different word is encoded once and remembered.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        self.kind = trainer.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        pieces = proto.pieces
        if any(p.type == USER_DEFINED or p.type == NORMAL and MARK in p.piece.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches over the start of a word")
        normal = [(i, p) for i, p in enumerate(pieces) if p.type == NORMAL]
        self.size = len(pieces)
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.byte_fallback = trainer.byte_fallback
        self.byte_ids = np.full(256, self.unknown, np.int64)
        surface: list[bytes] = []
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                surface.append(b"")
            elif p.type == UNKNOWN:
                surface.append(UNKNOWN_SURFACE.encode())
            else:
                surface.append(p.piece.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in pieces])
        self.is_byte = np.array([p.type == BYTE for p in pieces])
        self.longest = max(len(p.piece) for _, p in normal)
        self.scores = np.array([p.score for p in pieces])
        self.unknown_score = min(p.score for _, p in normal) - UNKNOWN_PENALTY
        self.power = _powers(_STEP, self.longest + 1)
        chars, self.chars_size = np.zeros((self.size, self.longest), np.uint32), np.zeros(self.size, np.int64)
        for i, p in normal:
            c = np.frombuffer(p.piece.encode("utf-32-le"), np.uint32)
            chars[i, : len(c)], self.chars_size[i] = c, len(c)
        self.raw_hash = self._hash(chars, mixed=False)[:, 0, :][np.arange(self.size), np.maximum(self.chars_size - 1, 0)]
        ids = np.array([i for i, _ in normal])
        keys = mix64(self.raw_hash[ids])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one hash")
        # where the keys of each value of the first bits begin
        head = (self.keys >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        self.index = np.searchsorted(head, np.arange((1 << INDEX_BITS) + 1)).astype(np.int32)
        self.filled_heads = np.bincount(head, minlength=1 << INDEX_BITS) > 0
        self.crowded = int(np.bincount(head).max())
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self._forget_words()
        if self.kind == BPE:
            # merges of the best score come first; of equal scores the leftmost
            _, rank = np.unique(-self.scores[ids], return_inverse=True)
            self.rank = np.full(self.size + 1, self.size, np.int64)  # the last one is for no piece
            self.rank[ids] = rank
            self._own_merges(ids, chars)

    # ------------------------------------------------------------- substrings

    def _hash(self, chars: np.ndarray, mixed: bool = True) -> np.ndarray:
        """Hashes [word, start, length - 1] of the substrings of words padded to equal length."""
        n, size = chars.shape
        width = min(size, self.longest)
        code = _char_codes(chars)
        out = np.zeros((n, size, width), np.uint64)
        h = np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = h[:, : size - k] * _STEP + code[:, k:]
                out[:, : size - k, k] = h
            return mix64(out) if mixed else out

    def _look(self, h: np.ndarray) -> np.ndarray:
        h, shape = h.ravel(), h.shape
        out = np.full(len(h), NONE, np.int32)
        live = np.flatnonzero(self.filled_heads[(h >> np.uint64(64 - INDEX_BITS)).view(np.int64)])
        wanted = h[live]
        first = (wanted >> np.uint64(64 - INDEX_BITS)).view(np.int64)
        at, end = self.index[first], self.index[first + 1]
        for _ in range(self.crowded):
            hit = self.keys[at] == wanted
            out[live[hit]] = self.key_ids[at[hit]]
            on = ~hit & (at + 1 < end)
            live, at, end, wanted = live[on], at[on] + 1, end[on], wanted[on]
        return out.reshape(shape)

    def _probe(self, chars: np.ndarray) -> np.ndarray:
        """Piece ids [word, start, length - 1] of the substrings, NONE where none is a piece; padding is in no piece."""
        ids = self._look(self._hash(chars))
        for k in range(1, ids.shape[2]):
            ids[:, ids.shape[1] - k :, k] = NONE
        return ids

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that two pieces make side by side, NONE if none."""
        size = self.chars_size[b]
        with np.errstate(over="ignore"):
            h = self.raw_hash[a] * self.power[size] + self.raw_hash[b]
        return np.where(self.chars_size[a] + size <= self.longest, self._look(mix64(h)), NONE)

    # ------------------------------------------------- which pieces can be neighbours

    def _own_merges(self, ids: np.ndarray, chars: np.ndarray) -> None:
        """For each piece the ranks of the merges that make it, in order, and its first and last parts before each."""
        steps = self.longest
        self.merge_rank = np.full((self.size, steps + 1), np.iinfo(np.int64).max, np.int64)
        self.first_part, self.last_part = (np.full((self.size, steps + 1), NONE, np.int64) for _ in range(2))
        self.whole = np.zeros(self.size, bool)  # merging its characters makes the piece
        for size in np.unique(self.chars_size[ids]):
            some = ids[self.chars_size[ids] == size]
            part = self._look(mix64(_char_codes(chars[some, :size])))
            if (part == NONE).any():
                raise ValueError("a piece has a character that is no piece")
            rows = np.arange(len(some))
            for step in range(size):
                self.first_part[some, step] = part[:, 0]
                self.last_part[some, step] = part[rows, (part != NONE).cumsum(axis=1).argmax(axis=1)]
                if step == size - 1:
                    break
                # parts stay where they start; the next part of each is the nearest one to its right
                place = np.where(part != NONE, np.arange(size), size)
                after = np.minimum.accumulate(np.concatenate([place[:, 1:], np.full((len(some), 1), size)], axis=1)[:, ::-1], axis=1)[:, ::-1]
                both = np.full(part.shape, NONE)
                w, i = np.nonzero((part != NONE) & (after < size))
                both[w, i] = self._joined(part[w, i], part[w, after[w, i]])
                rank = self.rank[both]
                at = rank.argmin(axis=1)
                found = rank[rows, at] < self.size
                w, i = rows[found], at[found]
                self.merge_rank[some[w], step] = rank[w, i]
                part[w, after[w, i]] = NONE
                part[w, i] = both[w, i]
            self.whole[some] = part[:, 0] == some

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b side by side makes these two pieces.

        Both pieces' own merges go on in order of rank; as long as a merge over
        the seam never comes first, they do not meet. A run of pieces is what
        merging makes of a text just if each two neighbours fit: the first merge
        over a seam would come first between these two pieces alone as well.
        """
        ok = self.whole[a] & self.whole[b]
        live = np.flatnonzero(ok)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            left, right = self.merge_rank[x, p], self.merge_rank[y, q]
            over = self.rank[self._joined(self.last_part[x, p], self.first_part[y, q])]
            cross = (over < self.size) & (over < left) & (over <= right)
            ok[live[cross]] = False
            going = ~cross & ((self.last_part[x, p] != x) | (self.first_part[y, q] != y))
            on_left = left <= right
            i[live] += on_left
            j[live] += ~on_left
            live = live[going]
        return ok

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_fit`` of pairs, each of which is worked out once while its slot is not taken by another."""
        keys = a.astype(np.int64) * self.size + b
        slot = (mix64(keys) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(new):
            pairs, first, of = np.unique(keys[new], return_index=True, return_inverse=True)
            known = self._fit(pairs // self.size, pairs % self.size)
            fits[new] = known[of]
            slot = slot[new[first]]
            self.pair_keys[slot], self.pair_fits[slot] = pairs, known
        return fits

    # ----------------------------------------------------------------- Viterbi

    def _viterbi(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of words padded to equal length: piece ids (LONE: no piece) and lengths [word, start].

        All words advance together, one character a step. The options of a step are
        the pieces that end there; the maximum over them is stored as a
        backpointer. Unigram models add up scores. In BPE models a piece scores 0
        if it fits the piece that the path to its start ends with, else minus
        infinity: just one path is left, and it is what merging makes.
        """
        n, size = chars.shape
        width = min(size, self.longest)
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, last = np.zeros((n, size + 1), np.int16), np.full((n, size + 1), NONE, np.int32)
        order = np.argsort(lengths, kind="stable")
        by_length = lengths[order]
        block = max(width, BATCH_CELLS // (n * width))
        for low in range(0, size, block):
            high = min(low + block, size)
            first = max(low - width + 1, 0)
            # pieces that start before ``low`` were in the block before too
            ids = self._probe(chars[:, first : min(high + width, size)])
            for end in range(low + 1, high + 1):
                live = order[np.searchsorted(by_length, end) :]
                k = np.arange(min(width, end))[::-1]  # of equal totals the longest last piece
                start = end - 1 - k
                piece = ids[live[:, None], start - first, k]
                before = last[live[:, None], start]
                piece[:, -1] = np.where(piece[:, -1] == NONE, LONE, piece[:, -1])
                if self.kind == BPE:
                    ok = (piece == LONE) | ((piece >= 0) & self.whole[piece])
                    w, o = np.nonzero(ok & (piece >= 0) & (before >= 0))
                    ok[w, o] = self._neighbours(before[w, o], piece[w, o])
                    options = np.where(ok, best[live[:, None], start], -np.inf)
                else:
                    score = np.where(piece >= 0, self.scores[piece], np.where(piece == LONE, self.unknown_score, -np.inf))
                    options = best[live[:, None], start] + score.astype(np.float32)
                at = options.argmax(axis=1)
                rows = np.arange(len(live))
                best[live, end], back[live, end], last[live, end] = options[rows, at], k[at], piece[rows, at]
        out, length = np.full((n, size), NONE), np.zeros((n, size), np.int64)
        at = lengths.copy()
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                return out, length
            end = at[live]
            at[live] -= back[live, end] + 1
            out[live, at[live]] = last[live, end]
            length[live, at[live]] = back[live, end] + 1

    def _long(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece starts and ids of one long word.

        BPE: overlapping windows advance together. Where two of them share a piece,
        the path of the one up to there and of the other from there on is the word's,
        as all neighbours fit. Without such a place, and for unigram models, the
        word advances alone.
        """
        window = BATCH_CHARS[-1]
        if self.kind == BPE:
            begin = np.arange(0, len(chars) - window // 2, window // 2)
            lengths = np.minimum(len(chars) - begin, window)
            padded = np.zeros((len(begin), window), np.uint32)
            for w, (b, n) in enumerate(zip(begin, lengths)):
                padded[w, :n] = chars[b : b + n]
            out, length = (np.concatenate(x) for x in zip(*[self._viterbi(padded[s : s + 1024], lengths[s : s + 1024]) for s in range(0, len(begin), 1024)]))
            starts, ids, upto = [], [], 0  # pieces before ``upto`` are settled
            for w, b in enumerate(begin.tolist()):
                own = np.flatnonzero(length[w])
                if w + 1 == len(begin):
                    keep = own + b >= upto
                else:
                    here = own + b
                    there = np.flatnonzero(length[w + 1]) + begin[w + 1]
                    same, x, y = np.intersect1d(here, there, return_indices=True)
                    good = (same >= upto) & (length[w, same - b] == length[w + 1, same - begin[w + 1]])
                    if not good.any():
                        break
                    keep = (here >= upto) & (here < same[good][0])
                starts.append(own[keep] + b)
                ids.append(out[w, own[keep]])
                upto = same[good][0] if w + 1 < len(begin) else len(chars)
            else:
                return np.concatenate(starts), np.concatenate(ids)
        out, length = self._viterbi(chars[None, :], np.array([len(chars)]))
        at = np.flatnonzero(length[0])
        return at, out[0, at]

    # ------------------------------------------------------------------ encode

    def _forget_words(self) -> None:
        self.word_keys, self.word_slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.count, self.filled = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _find_words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each of the sorted keys, and whether it is known."""
        if not len(self.word_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        return self.word_slots[at], self.word_keys[at] == keys

    def _remember(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Ids of new words, one word after the other."""
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        first = len(self.count)
        self.begin = np.concatenate([self.begin, self.filled + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.filled += len(ids)
        at = np.searchsorted(self.word_keys, keys)
        self.word_keys, self.word_slots = np.insert(self.word_keys, at, keys), np.insert(self.word_slots, at, first + np.arange(len(keys)))

    def _encode_words(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of each word's."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place in word, id
        padded = np.searchsorted(BATCH_CHARS, size)
        for b in np.unique(padded):
            at = np.flatnonzero(padded == b)
            if b == len(BATCH_CHARS):
                for w in at:
                    place, ids = self._long(chars[begin[w] : begin[w] + size[w]])
                    parts.append((np.full(len(ids), w), place, ids))
                continue
            width = BATCH_CHARS[b]
            step = max(1, BATCH_CELLS // (width * min(width, self.longest)))
            for s in range(0, len(at), step):
                some = at[s : s + step]
                inside = np.arange(width) < size[some][:, None]
                words = np.where(inside, chars[np.minimum(begin[some][:, None] + np.arange(width), len(chars) - 1)], 0)
                out, length = self._viterbi(words, size[some])
                w, p = np.nonzero(length)
                parts.append((some[w], p, out[w, p]))
        word, place, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(3))
        lone = np.flatnonzero(ids == LONE)
        if len(lone) and not self.byte_fallback:
            ids[lone] = self.unknown
        elif len(lone):
            spelt = [chr(c).encode("utf-8", "replace") for c in chars[begin[word[lone]] + place[lone]]]
            times = np.ones(len(ids), np.int64)
            times[lone] = [len(x) for x in spelt]
            ids[lone] = self.byte_ids[[x[0] for x in spelt]]
            to = np.cumsum(times) - times
            ids, word, place = (np.repeat(x, times) for x in (ids, word, place))
            for t, x in zip(to[lone].tolist(), spelt):
                ids[t : t + len(x)] = self.byte_ids[list(x)]
        order = np.lexsort((place, word))  # stable: bytes of one character stay in order
        return ids[order], np.bincount(word, minlength=len(size))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end; null as empty."""
        raw, offsets = text_buffers(column)
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        chars = np.where(chars == 0x20, _MARK, chars)
        size = np.diff(heads)
        if self.prefix:
            chars = np.insert(chars, heads[:-1][size > 0], _MARK)
            heads = heads + np.concatenate([[0], np.cumsum(size > 0)])
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(heads), np.int64)
        # words begin with a text, and at a mark after another character
        mark = chars == _MARK
        edge = mark.copy()
        edge[1:] &= ~mark[:-1]
        edge[heads[:-1][np.diff(heads) > 0]] = True
        begin = np.flatnonzero(edge)
        length = np.diff(np.append(begin, len(chars)))
        with np.errstate(over="ignore"):
            n = len(chars)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_char_codes(chars) * _powers(_STEP, n), out=total[1:])
            keys = mix64((total[begin + length] - total[begin]) * _powers(_UNSTEP, n)[begin] + length.astype(np.uint64))
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.word_keys) + len(distinct) > REMEMBERED_WORDS:
            self._forget_words()
        _, known = self._find_words(distinct)
        new = first[~known]
        ids, count = self._encode_words(chars, begin[new], length[new])
        self._remember(distinct[~known], ids, count)
        slot = self._find_words(distinct)[0][of]
        count = self.count[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.begin[slot] - upto[:-1], count) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(begin, heads)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as the sentencepiece library gives them."""
        flat, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    # ------------------------------------------------------------------ decode

    def decode_flat(self, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of ids that follow one another; bytes that are not UTF-8 become U+FFFD, control pieces nothing."""
        begin, size = self.surface_begin[flat], self.surface_size[flat]
        if self.prefix:
            heads = bounds[:-1][np.diff(bounds) > 0]
            heads = heads[self.marked[flat[heads]]]
            begin[heads] += 1
            size[heads] -= 1
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.surface[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        offsets = upto[bounds]
        odd = np.concatenate([[0], np.cumsum(self.is_byte[flat])])[bounds]
        odd = np.flatnonzero(np.diff(odd))
        if not len(odd):
            return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
        text = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        return pa.array(text, pa.large_string())

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_flat(ids, np.array([0, len(ids)]))[0].as_py()


_CODECS: dict[str, Codec] = {}
_LOCK = threading.Lock()


def codec(model_file: str) -> Codec:
    """The codec of a model file, made once in a process."""
    with _LOCK:
        if model_file not in _CODECS:
            with open(model_file, "rb") as f:
                _CODECS[model_file] = Codec(f.read())
        return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids array<int>) for each row of ``docs``; with ``decoded`` also the text that the ids decode to.

    Ids are those the sentencepiece library gives. They are best paths, found in
    numpy for all new words of a part of the texts at once (``Codec``): words of
    equal padded length advance together, hashes of their substrings probe the
    sorted keys of the pieces, and vectorised maxima store the backpointers.
    Characters that are no piece are spelt in bytes if the model has them, else
    unknown. The model file must be on every executor.

    Null and empty texts have no ids. Null ids and repeated rows are kept, other
    columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        own = codec(model_file)
        for part in text_parts(batches, "text", PART_ROWS, PART_BYTES):
            flat, bounds = own.encode_column(part.column("text"))
            arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
            if decoded:
                arrays.append(own.decode_flat(flat, bounds).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (with an ``ids`` column) plus ``decoded``; null ids decode to null.

    A column named ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                column = part.column(part.schema.get_field_index("ids"))
                size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = own.decode_flat(flat, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])).cast(pa.string())
                text = pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(None).cast("string")).schema)
