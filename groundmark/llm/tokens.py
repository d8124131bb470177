"""Token ids of whole texts by public tokenizers, each distinct pre-token encoded once per Python worker.

Cutting a text where a non-space character meets a space never cuts through a token of either library: the byte-level
pre-tokenizer starts a new pre-token there, and no piece of the sentencepiece model holds the space mark after another
character. Texts with other or adjoining white space, and texts with a special string, go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, sums

#: White space other than the space and the line feed, as Unicode and Python define it.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
SPACE_MARK = "▁"
#: Pre-tokens that the caches of a process hold; about 200 bytes each.
LIMIT = 600_000


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; an existing path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Ids by pre-token. A cache only: when it holds `limit` pre-tokens or eight times as many ids, it drops those that one call had only, and at least half."""

    #: Texts that match are not cut at every space.
    unusual = ""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the pre-tokens that more than one call had, the most used ones if these are many; none if their ids are many."""
        uses = self.uses[: len(self.slots)]
        kept = np.flatnonzero(uses > 1)
        if 2 * len(kept) > self.limit:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: self.limit // 2]])
        names = list(self.slots)
        self._keep(kept)
        if self.used > 4 * self.limit:
            self._reset()
            return
        self.uses[: len(kept)] = uses[kept] // 2
        self.uses[len(kept) :] = 0
        self.slots = {names[i]: k for k, i in enumerate(kept.tolist())}

    def _keep(self, kept: np.ndarray) -> None:
        """Move what is known of the slots `kept`, in order, to the first slots."""
        lengths = self.lengths[kept]
        ids = self.ids[ragged(self.starts[kept], lengths)]
        self.used = len(ids)
        self.ids[: self.used] = ids
        self.starts[: len(kept)] = np.cumsum(lengths) - lengths
        self.lengths[: len(kept)] = lengths

    def prepare(self, texts: pa.Array) -> pa.Array:
        """Usual texts so that the pieces between single spaces are their keys."""
        return texts

    def parted(self, names: pa.Array, numbers: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct keys, their numbers in order of the texts and how many each text has, with keys cut further."""
        return names, numbers, counts

    def keys(self, text: str) -> list[str]:
        """The keys of the pre-tokens of any text, in order."""
        raise NotImplementedError

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys one after the other, and how many each has."""
        raise NotImplementedError

    def _found(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """Slots of distinct keys, and those keys that are new; new ones are numbered on in order."""
        slots = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        new, first = np.flatnonzero(slots < 0), len(self.slots)
        fresh = [keys[i] for i in new.tolist()]
        slots[new] = np.arange(first, first + len(fresh))
        self.slots.update(zip(fresh, range(first, first + len(fresh))))
        return slots, fresh

    def distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Keys, the numbers in them of all pre-tokens of the texts, and how many each text has."""
        whole = pa.array(texts, pa.string())
        odd = pc.or_(pc.equal(whole, ""), pc.match_substring_regex(whole, self.unusual)).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(self.prepare(whole.filter(pa.array(~odd))), " ")
        flat = parts.flatten().dictionary_encode()
        found, numbers, of_text = self.parted(flat.dictionary, flat.indices.to_numpy().astype(np.int64), np.diff(parts.offsets.to_numpy()))
        names = found.to_numpy(zero_copy_only=False).tolist()
        counts = np.empty(len(texts), np.int64)
        counts[~odd] = of_text
        lists = [self.keys(texts[i]) for i in np.flatnonzero(odd)]
        counts[odd] = [len(x) for x in lists]
        if not odd.any():
            return names, numbers, counts
        place = {k: i for i, k in enumerate(names)}
        others = np.fromiter((place.setdefault(k, len(place)) for x in lists for k in x), np.int64)
        out = np.empty(int(counts.sum()), np.int64)
        starts = np.cumsum(counts) - counts
        out[ragged(starts[~odd], counts[~odd])] = numbers
        out[ragged(starts[odd], counts[odd])] = others
        return list(place), out, counts

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all pre-tokens of the texts, and how many each text has. Valid until the next call."""
        if len(self.slots) > self.limit or self.used > 8 * self.limit:
            self._shrink()
        names, numbers, counts = self.distinct(texts)
        slots, fresh = self._found(names)
        if fresh:
            ids, lengths = self.encode(fresh)
            n = len(self.slots)
            self._append(ids, lengths, n - len(lengths), n)
            while n > len(self.uses):
                self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))
        self.uses[slots] += 1
        return slots[numbers], counts

    def _append(self, ids: np.ndarray, lengths: np.ndarray, first: int, end: int) -> None:
        while end > len(self.starts):
            self.starts = np.concatenate((self.starts, np.empty_like(self.starts)))
            self.lengths = np.concatenate((self.lengths, np.empty_like(self.lengths)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.lengths[first:end] = lengths
        self.starts[first:end] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        codes, counts = self.codes(texts)
        lengths = self.lengths[codes]
        return self.ids[ragged(self.starts[codes], lengths)], sums(lengths, counts)


class ByteTable(PieceTable):
    """Byte-level BPE by the tokenizers library.

    A key that begins with `EXACT` stands for what follows, one that begins with a line feed for itself, and any other for
    itself behind a space. Where the pre-tokenizer parts kinds of characters, ASCII signs at the end of a key, behind a
    letter or digit, are a key of their own, so that a word is one key with all signs behind it.
    """

    EXACT = "\x02"
    #: A letter up to U+024F or a digit, and signs behind it.
    SIGN = r"[!-/:-@\[-`{-~]"
    SIGNED = r"(?s)^(?P<word>.*[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])(?P<signs>" + SIGN + "+)$"

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a byte-level token stands for one byte
            self.bytes_of[i] = len(token)
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = "|".join(["  ", "\n ", " \n", "\n\n", "^ ", " $", f"[{OTHER_SPACE}{self.EXACT}]", *special])
        self.parts_kinds = bool(getattr(self.tokenizer.pre_tokenizer, "use_regex", False))

    def prepare(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring(pc.binary_join_element_wise(self.EXACT, texts, ""), "\n", " \n")

    def parted(self, names: pa.Array, numbers: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        signed = pc.match_substring_regex(names, self.SIGN + "$").to_numpy(zero_copy_only=False).copy()
        found = pc.extract_regex(names.filter(pa.array(signed)), self.SIGNED)  # of few: it is slow
        signed[signed] = found.is_valid().to_numpy(zero_copy_only=False)
        if not self.parts_kinds or not signed.any():
            return names, numbers, counts
        found = found.drop_null()
        signs = pc.binary_join_element_wise(self.EXACT, found.field("signs"), "")
        every = pa.concat_arrays([names.filter(pa.array(~signed)), found.field("word"), signs]).dictionary_encode()
        place = every.indices.to_numpy()
        many = int(signed.sum())
        plain = len(names) - many
        first, second = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        first[~signed], first[signed], second[signed] = place[:plain], place[plain : plain + many], place[plain + many :]
        more = signed[numbers]
        ends = np.cumsum(1 + more)
        out = np.empty(int(ends[-1]), np.int64)
        out[ends - 1 - more] = first[numbers]
        out[ends[more] - 1] = second[numbers[more]]
        return every.dictionary, out, counts + sums(more.astype(np.int64), counts)

    def keys(self, text: str) -> list[str]:
        return [self.EXACT + text] if text else []

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        exact = np.fromiter((k[:1] == self.EXACT for k in keys), bool, len(keys))
        places, alone = np.flatnonzero(~exact), np.flatnonzero(exact)
        names = [keys[i] if keys[i][:1] == "\n" else " " + keys[i] for i in places.tolist()]
        lengths = np.zeros(len(keys), np.int64)
        whole = self._whole([keys[i][1:] for i in alone.tolist()])
        lengths[alone] = [len(x) for x in whole]
        runs = [slice(a, a + 10_000) for a in range(0, len(names), 10_000)]
        joined = self._whole(["".join(names[r]) for r in runs])
        for run, got in zip(runs, joined):  # as one text: every key starts where a pre-token does
            ends = np.cumsum(pc.binary_length(pa.array(names[run], pa.string())).to_numpy(), dtype=np.int64)
            cuts = np.searchsorted(np.cumsum(self.bytes_of[got]), ends, "left") + 1
            lengths[places[run]] = np.diff(cuts, prepend=0)
        ids, starts = np.empty(int(lengths.sum()), np.int32), np.cumsum(lengths) - lengths
        for where, lists in ((places, joined), (alone, whole)):
            if lists:
                ids[ragged(starts[where], lengths[where])] = np.concatenate(lists)
        return ids, lengths


class SentenceTable(PieceTable):
    """BPE with byte fallback by sentencepiece. A key is what follows one space mark; the library puts that mark first."""

    unusual = f"  |^ | $|{SPACE_MARK}"

    def __init__(self, path: str, limit: int = LIMIT):
        import sentencepiece

        super().__init__(limit)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark = self.processor.piece_to_id(SPACE_MARK)
        size = self.processor.get_piece_size()
        self.is_byte = np.array([self.processor.is_byte(i) for i in range(size)])

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        *parts, last = text.replace(SPACE_MARK, " ").split(" ")
        out, held = [], 0  # adjoining spaces belong to the word behind them; at the end they stand alone
        for part in parts:
            if part:
                out.append(" " * held + part)
                held = 0
            else:
                held += 1
        return [*out, " " * held + last]

    def sizes(self, keys: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of each key, and how many it has."""
        got = self.processor.encode(keys, num_threads=1)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        for i in np.flatnonzero(lengths == 0):  # the key of a lone space mark
            got[i], lengths[i] = [self.mark], 1
        return got, lengths

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got, lengths = self.sizes(keys)
        return np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())), lengths


_held: dict[tuple, PieceTable] = {}


def held(kind: type[PieceTable], path: str, limit: int = LIMIT) -> PieceTable:
    """This process's table of that kind. A worker lives through many stages, so older tables go once all may hold over `LIMIT`."""
    key = (kind, path, limit)
    if key not in _held:
        while _held and limit + sum(x[2] for x in _held) > LIMIT:
            del _held[next(iter(_held))]
        _held[key] = kind(path, limit)
    return _held[key]


def byte_table(path: str, limit: int = LIMIT) -> ByteTable:
    return held(ByteTable, path, limit)


def sentence_table(path: str, limit: int = LIMIT) -> SentenceTable:
    return held(SentenceTable, path, limit)
