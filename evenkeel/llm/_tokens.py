"""Token ids of whole texts by a public tokenizer file, with encoded words remembered."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A special token of the file: it parts chunks that are encoded in one call, as chunks are parted anyway.
PART = "<|startoftext|>"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters that may follow a word: a run of them is a word of its own, whatever it holds.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of Latin letters whose lower case has one letter for each, and marks.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[!-/:-@\[-`{-~]*$"


def _cut(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a pool one after the other, and their ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    wide = np.int32 if total + len(pool) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(wide), sizes)
    at += np.arange(total, dtype=wide)
    return pool[at], ends


def _pooled(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ids as one pool, and their sizes."""
    return np.frombuffer(b"".join(pieces), dtype="<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def _tails(words: pa.LargeStringArray, heads: pa.LargeStringArray) -> pa.LargeStringArray:
    """What words have after their heads."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset + 1 : words.offset + n + 1]
    sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
    raw, ends = _gather(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), ends - sizes, sizes)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw))


def _strings(words: pa.LargeStringArray) -> list[str]:
    """Words without a space as a list, by one string and one split."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py().split(" ")


class TextEncoder:
    """Whole texts to ids by the tokenizers library.

    The file's rules never join characters across white space, so that the ids of a text are those of its
    chunks between ASCII white space.  A few MB of texts are cut, and their chunks numbered, in Arrow; each
    word that is new is encoded by the library, many in a call, and remembered under a number, by which its ids lie
    in one array.  At a fixed number of words, those that one group of texts alone had are forgotten.
    """

    #: Words and marks, and chunks that are no such words, that are remembered.
    WORDS, LIMIT = 500_000, 200_000
    #: Bytes of text whose chunks are looked up together, and chunks in a call.
    STEP, CALL = 4 << 20, 2000

    def __init__(self, name: str):
        # calls are of one text, for which a pool of threads would only spin beside the other workers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        #: the same model for plain words in lower case, on which the file's normaliser and pattern have no effect
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.part = self.tokenizer.token_to_id(PART)
        vocab = self.tokenizer.get_vocab()
        #: which ids end a word
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self._keep({}, np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))

    def _keep(self, words: dict[str, int], pool: np.ndarray, ends: np.ndarray, uses: np.ndarray) -> None:
        """Numbers of words; their ids one after the other and where each word's end; how many groups had each."""
        self.words, self.pool, self.ended, self.uses = words, pool, ends, uses

    def _forget(self) -> None:
        """Keep the words that two groups had since the last time, unless these are too many."""
        kept = np.flatnonzero(self.uses > 1)
        if 2 * len(kept) > self.WORDS:
            kept = kept[:0]
        names = list(self.words)  # in the order of their numbers
        words = {names[i]: k for k, i in enumerate(kept.tolist())}
        self._keep(words, *_gather(self.pool, *self._pieces(kept)), self.uses[kept] // 2)

    def _pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words start in the pool, and how many they are."""
        starts = np.append(0, self.ended)[numbers]
        return starts, self.ended[numbers] - starts

    def _numbers(self, names: list[str]) -> np.ndarray:
        """Numbers of different words; new ones are learned."""
        look = lambda: np.fromiter(map(self.words.get, names, repeat(-1)), np.int64, len(names))
        numbers = look()
        new = np.flatnonzero(numbers < 0)
        if len(self.words) + len(new) > self.WORDS:
            self._forget()
            numbers = look()
            new = np.flatnonzero(numbers < 0)
        numbers[new] = len(self.words) + np.arange(len(new))
        self._learn_words([names[i] for i in new.tolist()])
        self.uses[numbers] += 1
        return numbers

    def _learn_words(self, missing: list[str]) -> None:
        """Remember the ids of new words, none for those that the library doesn't take for one word."""
        if not missing:
            return
        pool, sizes = [self.pool], []
        for i in range(0, len(missing), self.CALL):
            some = missing[i : i + self.CALL]
            ids = self._ids(" ".join(some), self.bare)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                pool.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [self._ids(w) for w in some]
                each = [x if int(self.ends[x].sum()) == 1 else x[:0] for x in each]
                pool += each
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        self.words.update(zip(missing, range(len(self.words), len(self.words) + len(missing)), strict=True))
        size = np.concatenate(sizes)
        ended = np.append(self.ended, len(self.pool) + np.cumsum(size))
        self._keep(self.words, np.concatenate(pool), ended, np.append(self.uses, np.zeros(len(size), dtype=np.int32)))

    def _learn_whole(self, chunks: list[bytes]) -> None:
        """Remember the ids of chunks that are no plain words."""
        known = self.known
        missing = [c for c in chunks if c not in known]
        if len(known) + len(missing) > self.LIMIT:
            known.clear()
            missing = chunks
        alone = [c for c in missing if b"<|" in c]
        plain = [c for c in missing if b"<|" not in c]
        for i in range(0, len(plain), self.CALL):
            some = plain[i : i + self.CALL]
            ids = self._ids(PART.join([c.decode("utf-8", "replace") for c in some]))
            cuts = np.flatnonzero(ids == self.part)
            if len(cuts) != len(some) - 1:
                alone += some
            else:
                known.update(zip(some, _cut(ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]), strict=True))
        known.update((c, self._ids(c.decode("utf-8", "replace")).tobytes()) for c in alone)

    def _look_up(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks: a pool, and where each chunk's piece starts in it and its size."""
        starts, sizes = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        plain = np.flatnonzero(pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False))
        # a run of letters is one word whatever its case, and a run of marks after it another
        low = pc.utf8_lower(chunks.take(pa.array(plain)))
        heads = pc.utf8_rtrim(low, MARKS)
        tails = _tails(low, heads).dictionary_encode()
        heads = heads.dictionary_encode()
        marked = pc.binary_length(tails.dictionary).to_numpy() > 0
        some = pc.filter(tails.dictionary, pa.array(marked))
        words = _strings(heads.dictionary)
        # one call, as words may be forgotten between two; a run of marks is no word of letters
        numbers = self._numbers(words + _strings(some))
        start, size = self._pieces(numbers)
        at = np.empty((len(plain), 2), dtype=np.int64)
        at[:, 0] = heads.indices.to_numpy()
        places = np.full(len(marked), len(numbers))  # no marks: no ids, by a last piece that is empty
        places[marked] = len(words) + np.arange(len(some))
        at[:, 1] = places[tails.indices.to_numpy()]
        start, size, bare = np.append(start, 0), np.append(size, 0), at[:, 1] == len(numbers)
        pool, ends = _gather(self.pool, start[at].ravel(), size[at].ravel())
        ends = ends[1::2]
        odd = (size[at[:, 0]] == 0) | (size[at[:, 1]] == 0) & ~bare
        starts[plain], sizes[plain] = np.append(0, ends)[:-1], np.diff(ends, prepend=0)
        rest = np.ones(len(chunks), dtype=bool)
        rest[plain[~odd]] = False
        others = np.flatnonzero(rest)
        raw = chunks.take(pa.array(others)).view(pa.large_binary()).to_pylist()
        self._learn_whole(raw)
        more, size = _pooled([self.known[c] for c in raw])
        starts[others], sizes[others] = len(pool) + np.cumsum(size) - size, size
        return np.concatenate([pool, more]), starts, sizes

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, texts: list[bytes | None]):
        """Ids of each text, in order; null is empty."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text or b"")
            size += len(text or b"")
            if size >= self.STEP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[bytes]):
        cut = pc.ascii_split_whitespace(pa.array(group, pa.large_binary()).view(pa.large_string()))
        chunks = cut.values.dictionary_encode()
        pool, starts, sizes = self._look_up(chunks.dictionary)
        at = chunks.indices.to_numpy()
        ids, ends = _gather(pool, starts[at], sizes[at])
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy()].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]

    def ids(self, text: bytes | None) -> np.ndarray:
        return next(self.encode([text]))


def slices(batches, rows: int = 1250):
    """Record batches of fewer rows, so that a worker holds less of its output at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
            pa.default_memory_pool().release_unused()


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """One encoder a worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(name)
    return _ENCODERS[name]
