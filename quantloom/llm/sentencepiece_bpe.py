"""SentencePiece BPE encoding and decoding with numpy merge rounds.

A text is cut into words (a run of meta spaces and what follows it) where no piece of the vocabulary can reach across.  Each different word is
encoded once per worker.  All new words of a batch lie in one flat symbol array; a round looks up the rank of every neighbouring pair, takes the
least rank of each word by a segmented minimum, merges its leftmost occurrences and compacts the array, until no pair remains.

Equal pairs of a word merge in one round only where that can't differ from the library's strict order (best score, then leftmost):
for some pieces the merged piece can join a neighbour with an equal or better score, and that join would come before the next merge of the same
pair.  Of such pairs only the leftmost of each cluster merges in a round; clusters are further apart than any piece reaches.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quantloom.llm.common import pieces

META = "▁"
NONE = np.iinfo(np.int32).max
CACHE_WORDS, CACHE_IDS = 100_000, 2_000_000     # per worker; then the cache starts anew


class Vocabulary:
    """Tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto.FromString(sp.serialized_model_proto())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        plain = (norm.precompiled_charsmap == b"" and norm.add_dummy_prefix and norm.escape_whitespaces
                 and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix)
        kinds = {p.type for p in spec.pieces}
        normal, unknown, control, byte = 1, 2, 3, 6
        if not plain or train.model_type != 2 or not kinds <= {normal, unknown, control, byte}:
            raise ValueError("a BPE model without text normalisation, user symbols and unused pieces is expected")
        self.size = len(spec.pieces)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == normal}
        self.byte_fallback = train.byte_fallback
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = sp.unk_id()
        scores = {p.piece: p.score for p in spec.pieces if p.type == normal}
        rank = {s: r for r, s in enumerate(sorted({v for k, v in scores.items() if len(k) > 1}, reverse=True))}
        self.max_len = max(map(len, self.ids))
        # rows of the pair table: both parts are single characters or pieces
        pairs = sorted((self.ids[q[:k]] * self.size + self.ids[q[k:]], i, rank[scores[q]]) for q, i in self.ids.items()
                       for k in range(1, len(q)) if q[:k] in self.ids and q[k:] in self.ids)
        self.pair_key, self.pair_id, self.pair_rank = (np.array(x, t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        self.strict = np.zeros(self.size, bool)
        self._find_strict(scores)
        inner = [p for p in self.ids if META in p[1:] and p.strip(META)]
        if any(META in p.lstrip(META) for p in inner):
            raise ValueError("a piece spans a word border")
        self.new_line = "\n" in "".join(self.ids)
        self.long_runs = self._longest_run(scores)
        self.words = re.compile(f"{META}*[^{META}]+|{META}+" if self.new_line else f"{META}*[^{META}\n]+|{META}+|\n")
        # decoding: the bytes of each id
        self.is_byte = np.array([p.type == byte for p in spec.pieces])
        self.byte_of = np.array([int(p.piece[3:5], 16) if p.type == byte else 0 for p in spec.pieces], np.uint8)
        shown = {normal: lambda p: p.piece.replace(META, " "), unknown: lambda p: train.unk_surface, control: lambda p: "", byte: lambda p: ""}
        self.text_of = [shown[p.type](p) for p in spec.pieces]
        self.silent = np.array([p.type == control for p in spec.pieces])

    def _find_strict(self, scores: dict[str, float]) -> None:
        """Marks pieces after whose merge a join of equal or better score can become possible that wasn't before."""
        parts = {p: [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids] for p in self.ids}
        for q in self.ids:
            for a, b in parts[q]:
                for p, x, left in ((a, b, True), (b, a, False)):
                    if len(p) > 1 and scores[q] >= scores[p]:
                        joins = (d + x if left else x + c for c, d in parts[p])
                        if any(not (j in self.ids and scores[j] > scores[p]) for j in joins):
                            self.strict[self.ids[p]] = True

    def _longest_run(self, scores: dict[str, float]) -> int:
        """Length n of the longest run of meta spaces that is a piece, if a longer run always starts with it; else 0."""
        runs = {len(p): scores[p] for p in self.ids if set(p) == {META} and len(p) > 1}
        n, least = max(runs, default=0), min(v for k, v in scores.items() if len(k) > 1)
        if not n or set(runs.values()) != {least}:        # runs of one score, the least: they merge last, from the left
            return 0
        ids, count = self.encode_words([META * k for k in range(n, 3 * n + 1)])
        first = ids[np.cumsum(count) - count]
        return n if (first == self.ids[META * n]).all() else 0

    def cut(self, text: str) -> list[str]:
        """The words of a text; long runs of spaces are cut into the pieces that they become."""
        if not text:
            return []
        marked = META + text.replace(" ", META)
        words, n = self.words.findall(marked), self.long_runs
        if not n or META * (n + 1) not in marked:
            return words
        out = []
        for w in words:
            full = max(0, len(w) - len(w.lstrip(META)) - 1) // n
            out += [META * n] * full + [w[full * n:]]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        chars = "".join(words)
        code = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        kinds, place = np.unique(code, return_inverse=True)
        known = np.array([self.ids.get(chr(c), self.size + k) for k, c in enumerate(kinds.tolist())], np.int64)
        sym = known[place]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        seg = np.repeat(np.arange(len(words)), lens)
        done_sym, done_seg, done_pos = [], [], []
        pos = np.arange(len(sym))
        merged, rank = self._pairs(sym, seg, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seg)]))
            live = best != NONE
            if not live.all():
                done_sym.append(sym[~live]), done_seg.append(seg[~live]), done_pos.append(pos[~live])
                sym, seg, pos, merged, rank, best = (x[live] for x in (sym, seg, pos, merged, rank, best))
                if not len(sym):
                    break
            at = self._chosen(np.flatnonzero(rank == best), seg, merged)
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg, pos, merged, rank = (x[keep] for x in (sym, seg, pos, merged, rank))
            at = at - np.arange(len(at))                      # where the merged symbols stand now
            changed = np.concatenate((at, at[at > 0] - 1))    # pairs with the right and with the left neighbour
            merged[changed], rank[changed] = self._pairs(sym, seg, changed)
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, seg, pos = map(np.concatenate, (done_sym, done_seg, done_pos))
        order = np.argsort(pos)
        return self._fallback(sym[order], seg[order], kinds, len(words))

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the symbols at `at` with their right neighbours in the word: the piece they make and its rank."""
        merged, rank = np.zeros(len(at), np.int64), np.full(len(at), NONE, np.int32)
        right = np.minimum(at + 1, len(sym) - 1)
        ok = np.flatnonzero((right > at) & (seg[right] == seg[at]) & (sym[right] < self.size) & (sym[at] < self.size))
        key = sym[at[ok]] * self.size + sym[right[ok]]
        found = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[found] == key
        ok, found = ok[hit], found[hit]
        merged[ok], rank[ok] = self.pair_id[found], self.pair_rank[found]
        return merged, rank

    def _chosen(self, at: np.ndarray, seg: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Of the best pairs those that merge in this round."""
        same = np.r_[False, seg[at[1:]] == seg[at[:-1]]]
        touching = np.r_[False, at[1:] == at[:-1] + 1] & same
        run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
        free = (np.arange(len(at)) - run) % 2 == 0
        near = same & np.r_[False, np.diff(at) <= 2 * self.max_len + 2]
        return at[np.where(self.strict[merged[at]], ~near, free)]

    def _fallback(self, sym: np.ndarray, seg: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes, or the unknown id."""
        odd = sym >= self.size
        if not odd.any():
            return sym.astype(np.int32), np.bincount(seg, minlength=n)
        if not self.byte_fallback:
            return np.where(odd, self.unknown, sym).astype(np.int32), np.bincount(seg, minlength=n)
        raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in kinds.tolist()]
        many = np.array([len(r) for r in raw])
        count = np.ones(len(sym), np.int64)
        count[odd] = many[sym[odd] - self.size]
        out = np.repeat(sym, count)
        first = np.cumsum(count) - count
        nth = np.arange(len(out)) - np.repeat(first, count)
        wide = np.zeros((len(raw), 4), np.int64)
        for k, r in enumerate(raw):
            wide[k, :len(r)] = self.byte_ids[r]
        w = out >= self.size
        out[w] = wide[out[w] - self.size, nth[w]]
        return out.astype(np.int32), np.bincount(seg, weights=count, minlength=n).astype(np.int64)

    def decode(self, ids) -> str:
        """As the library's decode(ids); ids outside the vocabulary raise IndexError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("id out of range")
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        edge = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        out = []
        for part in np.split(ids, edge):
            out.append(decode_bytes(self.byte_of[part].tobytes()) if self.is_byte[part[0]] else "".join(map(self.text_of.__getitem__, part.tolist())))
        text = "".join(out)
        return text[1:] if text.startswith(" ") and self.ids.get(META) is not None and not self.is_byte[ids[0]] and ids[0] != self.unknown else text


codecs.register_error("each byte", lambda e: ("\N{REPLACEMENT CHARACTER}", e.start + 1))


def decode_bytes(raw: bytes) -> str:
    """UTF-8; each byte that belongs to no character becomes U+FFFD."""
    return raw.decode("utf-8", "each byte")


class Encoder:
    """Encodes batches of texts; remembers the ids of words up to a fixed size."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.count, self.table = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        ids, count = self.v.encode_words(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.first = np.r_[self.first, len(self.table) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.table = np.r_[self.table, ids]

    def _spaced(self, text: str | None) -> str:
        """The words of the text with a space between them; an empty word encodes to nothing."""
        if not text:
            return ""
        if text[0] == " " or "  " in text or META in text or self.v.new_line:
            return " ".join(self.v.cut(text))
        return META + text.replace(" ", " " + META).replace("\n", " \n ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each.  Null is empty; an empty text has no id."""
        if len(self.place) > CACHE_WORDS or len(self.table) > CACHE_IDS:
            self._reset()
        words = pc.split_pattern(pa.array(map(self._spaced, texts), pa.large_string()), " ")
        lexicon = words.flatten().dictionary_encode()
        unique = lexicon.dictionary.to_pylist()
        self._learn(unique)
        place = np.fromiter(map(self.place.__getitem__, unique), np.int64, len(unique))
        at = place[lexicon.indices.to_numpy()]
        count, first = self.count[at], self.first[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.table[np.arange(total) + np.repeat(first - (ends - count), count)]
        return ids, np.diff(np.r_[0, ends][words.offsets.to_numpy()])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


MOST_CHARS = 2_000_000       # characters encoded at once: bounds a worker's memory, not the texts


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= MOST_CHARS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of every whole text and what they decode to; of the other columns only those named in `df` stay as they are.

    Null texts give no ids and the empty text.  `path` must be readable on every executor under the same name.  A column of the given names is replaced.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    at = keep.index(text)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{ids}` array<int>", f"`{decoded}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            for s in _slices(texts):
                part = b.slice(s.start, s.stop - s.start)
                flat, count = e.encode(texts[s])
                ends = np.cumsum(count)
                back = [e.v.decode(flat[z - n:z]) for z, n in zip(ends.tolist(), count.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(back, pa.string())], [*keep, ids, decoded])

    return df.select(*[df[c] for c in keep]).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids only."""
    return round_trip(df, path, text, ids, "__decoded").drop("__decoded")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that each list of ids decodes to; a null list gives the empty text."""
    keep = [c for c in df.columns if c != text]
    at = keep.index(ids)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).v
        for b in batches:
            back = [v.decode(x) if x else "" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*keep, text])

    return df.select(*[df[c] for c in keep]).mapInArrow(run, schema)
