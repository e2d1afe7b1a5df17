"""Token ids in compressed blocks: a range coder driven by mixed predictions of order 0 to 2.

A block holds whole documents and is coded on its own: models start anew, and a checksum
covers it.  Its ids are cut into lanes of equal length that advance together, one id of
every lane at a time, and share the models; so a step is a handful of array operations,
for the encoder and the decoder alike.

Each id is predicted by three orders.  The candidate is the id that last followed the same
two ids (order 2) or, where these are new, the same id (order 1).  The probability that it
comes next mixes, in the logistic domain and with weights that learn from every answer, what
the orders say of it: how often the two contexts held their word, whether order 1 agrees, and
how frequent the candidate is (order 0).  An id that is not the candidate goes by the adaptive
counts of order 0.  All arithmetic is on whole numbers, so that a block reads the same everywhere.

Layout of a block, little-endian: 4 bytes `CMR1`, checksum of what follows (u32), ids (u32),
documents (u32), lanes (u32), vocabulary (u32), documents' lengths (u32 each), digits a lane
(u32 each), and the lanes' 16-bit digits one lane after another.  Blocks one after another
form a stream, which `read_stream` reads back.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, pieces

END = 2
BLOCK = 1 << 18  # ids after which a block ends with its document
LANES = 2048
STEPS = 64  # a lane of a small block has this many ids at least
_PIECE = 1 << 22  # bytes of text that words are cut from at once
_MAGIC = b"CMR1"
_SLOTS = 1 << 17  # order-2 contexts
_STATES = 64
_REFRESH = 16  # steps after which order 0 takes up what it has seen
_STEP_UP, _TOTAL = 24, 1 << 20  # what an id adds to its count; counts are halved beyond the total
_ZERO, _ODDS_BITS, _DIGIT, _LOW = np.uint64(0), np.uint64(12), np.uint64(16), np.uint64(32)
_NARROW, _MASK48 = np.uint64(1 << 32), np.uint64((1 << 48) - 1)

# Logistic tables of 12-bit probabilities: squash(x) = 4096 / (1 + e^(-x / 256)), by rule.
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 32, 4064).astype(np.int64)
_STRETCH = np.searchsorted(_SQUASH, np.arange(4096)).clip(0, 4095).astype(np.int64) - 2048
_REACH = 3 << 13  # no mix of three orders with their greatest weights lies further out
_MIXED = _SQUASH[np.clip(np.arange(-_REACH, _REACH + 1), -2047, 2047) + 2048]
_CLASS = np.frexp(np.arange(1 << 14).astype(np.float64))[1].astype(np.int64)  # position of the highest bit


class _Encoder:
    """A range coder for each lane: 48-bit intervals, 16-bit digits, carries settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _MASK48, np.uint64)
        self.digits = np.zeros((lanes, 8 + 2 * steps), np.int64)
        self.at = np.zeros(lanes, np.int64)

    def answer(self, k: int, yes: np.ndarray, p: np.ndarray) -> None:
        """A yes of 12-bit probability p takes the lower part of the interval."""
        width = self.range[:k]
        part = (width >> _ODDS_BITS) * p
        self.low[:k] += np.where(yes, _ZERO, part)
        self.range[:k] = np.where(yes, part, width - part)

    def symbol(self, lane: np.ndarray, below: np.ndarray, share: np.ndarray, total: int) -> None:
        unit = self.range[lane] // np.uint64(total)
        self.low[lane] += unit * below
        self.range[lane] = unit * share

    def settle(self, k: int) -> None:
        """Pass carries on and write digits until every interval is wide enough again."""
        carry = np.flatnonzero(self.low[:k] > _MASK48)
        if len(carry):
            self.low[carry] &= _MASK48
            self.digits[carry, self.at[carry] - 1] += 1
        short = np.flatnonzero(self.range[:k] < _NARROW)
        while len(short):
            at = self.at[short]
            if int(at.max()) + 2 >= self.digits.shape[1]:
                self.digits = np.concatenate([self.digits, np.zeros_like(self.digits)], axis=1)
            low, width = self.low[short], self.range[short] << _DIGIT
            self.digits.reshape(-1)[short * self.digits.shape[1] + at] = (low >> _LOW).view(np.int64)
            self.at[short] = at + 1
            self.low[short] = (low << _DIGIT) & _MASK48
            self.range[short] = width
            short = short[width < _NARROW]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Digits of all lanes; one digit more names a number inside the last interval."""
        lane = np.arange(len(self.at))
        last = (self.low + (_NARROW - np.uint64(1))) >> _LOW
        self.digits[lane, self.at] = last.astype(np.int64)
        self.at += 1
        for column in range(int(self.at.max()) - 1, 0, -1):
            self.digits[:, column - 1] += self.digits[:, column] >> 16
            self.digits[:, column] &= 0xFFFF
        inside = np.arange(self.digits.shape[1]) < self.at[:, None]
        return self.digits[inside].astype("<u2"), self.at


class _Decoder:
    def __init__(self, digits: np.ndarray, sizes: np.ndarray):
        # Noughts follow a lane's digits; no reading goes further.
        lanes, width = len(sizes), int(sizes.max(initial=0)) + 3
        self.digits = np.zeros(lanes * width, np.uint64)
        self.digits[(np.arange(width) < sizes[:, None]).ravel()] = digits
        self.at = np.arange(lanes) * width
        self.code = np.zeros(lanes, np.uint64)
        self.range = np.full(len(sizes), _MASK48, np.uint64)
        for _ in range(3):
            self._next(np.arange(len(sizes)))

    def _next(self, lane: np.ndarray) -> None:
        at = self.at[lane]
        self.code[lane] = (self.code[lane] << _DIGIT) | self.digits[at]
        self.at[lane] = at + 1

    def answer(self, k: int, p: np.ndarray) -> np.ndarray:
        width, code = self.range[:k], self.code[:k]
        part = (width >> _ODDS_BITS) * p
        yes = code < part
        self.code[:k] = np.where(yes, code, code - part)
        self.range[:k] = np.where(yes, part, width - part)
        return yes

    def symbol(self, lane: np.ndarray, below: np.ndarray) -> np.ndarray:
        total = below[-1]
        unit = self.range[lane] // total
        wanted = np.minimum(self.code[lane] // unit, total - np.uint64(1))
        # In order, each is found close to the one before; places ride in the low bits, since plain sorting is faster.
        ranked = np.sort(wanted << _LOW | np.arange(len(lane), dtype=np.uint64))
        found = np.empty(len(lane), np.int64)
        found[(ranked & (_NARROW - np.uint64(1))).view(np.int64)] = np.searchsorted(below, ranked >> _LOW, "right") - 1
        start = below[found]
        self.code[lane] -= unit * start
        self.range[lane] = unit * (below[found + 1] - start)
        return found

    def settle(self, k: int) -> None:
        short = np.flatnonzero(self.range[:k] < _NARROW)
        while len(short):
            width = self.range[short] << _DIGIT
            self.range[short] = width
            self._next(short)
            short = short[width < _NARROW]


class _Models:
    """Predictions that encoder and decoder keep in step."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        self.counts = np.ones(vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.steps = 0
        self._refresh()
        # The id that followed two ids, or one, times 8, and how often it held (up to 7).
        self.second = np.zeros(_SLOTS, np.int64)
        self.first = np.zeros(vocabulary + 1, np.int64)
        self.odds = np.full((3, _STATES), 1 << 13, np.int64)  # 16-bit, by state of an order
        self.weights = np.full(3, 1 << 15, np.int64)  # 16-bit fractions
        self.before = np.full((2, lanes), vocabulary, np.int64)  # the last id and the one before
        self._tables()

    def _tables(self) -> None:
        self.stretched = _STRETCH[self.odds >> 4]
        self.parts = self.weights[:, None] * self.stretched

    def chances(self, k: int) -> np.ndarray:
        """12-bit probability that the candidate of each lane comes next."""
        one, two = self.before[0, :k], self.before[1, :k]
        self.one = one
        self.slot = (one * 40503 + two * 30011 + (one >> 3)) & (_SLOTS - 1)
        kept = self.second[self.slot], self.first[one]
        self.guesses = kept[0] >> 3, kept[1] >> 3
        self.held = kept[0] & 7, kept[1] & 7
        known = self.held[0] > 0
        agree = self.guesses[0] == self.guesses[1]
        self.guess = np.where(known, self.guesses[0], self.guesses[1])
        self.states = (
            self.held[0] * 8 + self.held[1],
            np.where(known, agree, 2) * 8 + self.held[1],
            _CLASS[np.minimum(self.counts[self.guess] >> 3, len(_CLASS) - 1)],
        )
        dot = (self.parts[0].take(self.states[0]) + self.parts[1].take(self.states[1]) + self.parts[2].take(self.states[2])) >> 16
        self.mixed = _MIXED.take(dot + _REACH)
        return self.mixed.astype(np.uint64)

    def learn(self, yes: np.ndarray) -> None:
        """States move by the share of yes that their lanes saw, weights along the error."""
        if self.steps > 16 and self.steps % 4:
            return  # the early steps teach most; later every fourth does
        error = ((yes.astype(np.int64) << 12) - self.mixed).astype(np.float64)  # whole numbers throughout
        came = np.flatnonzero(yes)
        for i, state in enumerate(self.states):
            n = np.bincount(state, minlength=_STATES)
            sure = np.bincount(state[came], minlength=_STATES)
            slope = int(np.bincount(state, error, _STATES).astype(np.int64) @ self.stretched[i]) // len(yes)
            self.weights[i] = min(max(int(self.weights[i]) + (slope >> 9), -(1 << 17)), 1 << 18)
            aim = (sure << 16) // np.maximum(n, 1) - self.odds[i]
            self.odds[i] += aim * np.minimum(n, 8) // 32
        np.maximum(self.odds, 512, out=self.odds)
        np.minimum(self.odds, 65023, out=self.odds)
        self._tables()

    def _refresh(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary) * _STEP_UP
            self.recent = []
        while int(self.counts.sum()) > _TOTAL and int(self.counts.max()) > 1:
            self.counts = (self.counts + 1) >> 1
        self.below = np.zeros(self.vocabulary + 1, np.uint64)
        self.shares = self.counts.astype(np.uint64)
        np.cumsum(self.shares, out=self.below[1:])

    def update(self, ids: np.ndarray) -> None:
        k = len(ids)
        # A word that held is trusted more; one that failed loses half, and its place at nought.
        for table, guess, held, at in (
            (self.second, self.guesses[0], self.held[0], self.slot),
            (self.first, self.guesses[1], self.held[1], self.one),
        ):
            failed = np.where(held < 2, ids * 8, guess * 8 + (held >> 1))
            table[at] = np.where(guess == ids, ids * 8 + np.minimum(held + 1, 7), failed)
        self.recent.append(ids)
        self.steps += 1
        if len(self.recent) == _REFRESH or self.steps & (self.steps - 1) == 0:
            self._refresh()
        self.before[1, :k] = self.before[0, :k]
        self.before[0, :k] = ids


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _active(n: int, lanes: int, steps: int) -> np.ndarray:
    """How many lanes have an id at each step; lanes are filled in order."""
    return np.array([max(0, -(-(n - t) // steps)) if t < n else 0 for t in range(steps)]).clip(0, lanes)


def encode_block(documents: list[np.ndarray], vocabulary: int) -> bytes:
    """One block of whole documents, given as arrays of ids below `vocabulary`."""
    ids = np.concatenate(documents).astype(np.int64) if documents else np.empty(0, np.int64)
    n = len(ids)
    lanes, steps = _shape(n)
    digits, sizes = np.empty(0, "<u2"), np.zeros(lanes, np.int64)
    if n:
        padded = np.zeros(lanes * steps, np.int64)
        padded[:n] = ids
        grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        coder, models = _Encoder(lanes, steps), _Models(lanes, vocabulary)
        for t, k in enumerate(_active(n, lanes, steps).tolist()):
            now = grid[t, :k]
            chance = models.chances(k)
            yes = models.guess == now
            coder.answer(k, yes, chance)
            left = np.flatnonzero(~yes)
            missed = now[left]
            coder.symbol(left, models.below[missed], models.shares[missed], models.below[-1])
            coder.settle(k)
            models.learn(yes)
            models.update(now)
        digits, sizes = coder.finish()
    body = b"".join(
        [
            np.array([n, len(documents), lanes, vocabulary], "<u4").tobytes(),
            np.array([len(d) for d in documents], "<u4").tobytes(),
            sizes.astype("<u4").tobytes(),
            digits.tobytes(),
        ]
    )
    return _MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def block_size(data: bytes) -> int:
    """Bytes of the block that `data` starts with."""
    n, documents, lanes, _ = np.frombuffer(data, "<u4", 4, 8)
    at = 24 + 4 * int(documents)
    return at + 4 * int(lanes) + 2 * int(np.frombuffer(data, "<u4", int(lanes), at).sum())


def decode_block(data: bytes) -> list[np.ndarray]:
    """The documents' ids; a block that was damaged is refused."""
    if len(data) < 24 or data[:4] != _MAGIC or zlib.crc32(data[8:]) != struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("damaged block of token ids")
    n, documents, lanes, vocabulary = np.frombuffer(data, "<u4", 4, 8).astype(int).tolist()
    lengths = np.frombuffer(data, "<u4", documents, 24).astype(np.int64)
    at = 24 + 4 * documents
    sizes = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    digits = np.frombuffer(data, "<u2", offset=at + 4 * lanes)
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int64)
    if n:
        coder, models = _Decoder(digits, sizes), _Models(lanes, vocabulary)
        for t, k in enumerate(_active(n, lanes, steps).tolist()):
            yes = coder.answer(k, models.chances(k))
            now = models.guess.copy()
            left = np.flatnonzero(~yes)
            now[left] = coder.symbol(left, models.below)
            coder.settle(k)
            models.learn(yes)
            models.update(now)
            grid[t, :k] = now
    ids = grid.T.ravel()[:n]
    return np.split(ids, np.cumsum(lengths)[:-1]) if documents else []


def read_stream(data: bytes) -> Iterator[list[np.ndarray]]:
    """The documents of each block of a stream of blocks."""
    at = 0
    while at < len(data):
        size = block_size(data[at:])
        yield decode_block(data[at : at + size])
        at += size


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed values of the vocabulary's own word pattern, for letters below U+0180:
# 's|'t|'re|'ve|'m|'ll|'d|[letters]+|[digits]|[^blanks letters digits]+
_LETTERS, _DIGITS, _BLANKS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾", " \t\n\r"
# Texts of these characters are unchanged by the vocabulary's normal form but for lower case.
_PLAIN = re.compile("[ -~\t\n\r¡-įı-ſ]*")
_BLANK, _LETTER, _DIGIT_KIND, _OTHER = range(4)
_KINDS = np.array(
    [next((kind for kind, some in enumerate((_BLANKS, _LETTERS, _DIGITS)) if re.match(f"[{some}]", chr(i))), _OTHER) for i in range(0x180)], np.uint8
)
# The vocabulary writes bytes as letters: those that can be seen as themselves, the others from U+0100 on.
_SEEN = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
_BYTES = np.where(_SEEN, np.arange(256), 255 + np.cumsum(~_SEEN)).astype("<u4")
_BYTES[ord("\n")] = ord("\n")  # parts words
_QUOTE = ord("'")
_TAIL = np.zeros((256, 256), np.uint8)  # letters that belong to a quote before them, by the two bytes that follow it
for _letter in b"stmd":
    _TAIL[_letter] = 1
for _pair in (b"re", b"ve", b"ll"):
    _TAIL[_pair[0], _pair[1]] = 2


def _cut(data: np.ndarray) -> np.ndarray:
    """Where words begin in lower-case bytes of plain Latin letters; the blanks before a word belong to it."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = _KINDS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    kind[lead + 1] = kind[lead]
    word = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=word[1:])
    word[np.flatnonzero(kind == _DIGIT_KIND)] = True  # every digit is a word
    word[lead + 1] = False
    quote = np.flatnonzero(data[:-2] == _QUOTE)
    tail = _TAIL[data[quote + 1], data[quote + 2]]
    own = (tail > 0) & ((quote == 0) | (kind[quote - 1] != _OTHER))
    quote, tail = quote[own], tail[own]
    word[quote + 1] = False
    word[quote + 1 + tail] = True
    blank = kind == _BLANK
    word[1:] &= ~blank[:-1]  # the word that follows blanks began with them
    return word


class WordIds:
    """Ids of whole texts, as `tokenizers` gives them, with each different word asked for once.

    The vocabulary never joins characters of two words, so a text's ids are its words' ids.
    Words are cut here for texts of plain Latin letters, as their normal form is the text in lower case:
    all texts of a call at once, and numbered by Arrow, so that Python meets new words only.
    Any other text goes to `tokenizers` whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads only cost
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.marks = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
        self.most = most
        self._keep_none()

    def _keep_none(self) -> None:
        self.words = pa.array([""], pa.large_string())  # blanks that no word follows have no ids
        self.ids, self.first, self.met = np.empty(0, np.int32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the words that were met again; all others are asked for anew."""
        again = self.met > 1
        again[0] = True
        if again.sum() > self.most // 2:
            return self._keep_none()
        sizes = np.diff(self.first)
        self.words = self.words.filter(pa.array(again))
        self.ids = self.ids[np.repeat(again, sizes)]
        self.first = np.append(0, np.cumsum(sizes[again]))
        self.met = np.zeros(len(self.words), np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has.

        The words are cut and in normal form already, so the vocabulary's model alone is asked;
        should any word lack an id that ends a word, all go to `tokenizers` whole.
        """
        split = self.tokenizer.model.tokenize
        letters = _BYTES[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        found = [[token.id for token in split(word)] for word in letters.split("\n")]
        if not all(some and self.ends[some[-1]] for some in found):
            found = self._whole(words)
        return np.fromiter(itertools.chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, words: pa.Array) -> None:
        new = words.to_numpy(zero_copy_only=False).tolist()
        # The library's results are large next to their ids.
        found = [self._asked(new[a : a + 2048]) for a in range(0, len(new), 2048)]
        self.words = pa.concat_arrays([self.words, words])
        self.met = np.append(self.met, np.zeros(len(words), np.int64))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([sizes for _, sizes in found]))])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Places of the words among the known; those without ids yet are asked for."""
        number = pc.index_in(words, value_set=self.words)
        new = pc.is_null(number)
        number = np.array(pc.fill_null(number, 0), np.int64)
        if pc.any(new).as_py():
            words = words.filter(new)
            unknown = words.unique()
            number[np.array(new)] = np.array(pc.index_in(words, value_set=unknown)) + len(self.words)
            self._learn(unknown)
        self.met[number] += 1
        return number

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self._forget()  # bounds memory; words are asked for again
        out = [np.empty(0, np.int32)] * len(texts)
        plain, lowered, odd = [], [], []
        for i, text in enumerate(texts):
            lower = (text or "").lower()
            if not _PLAIN.fullmatch(text or "") or any(m in lower for m in self.marks):
                odd.append(i)
            elif lower:
                plain.append(i)
                lowered.append(lower.encode())
        for i, ids in zip(plain, self._plain(lowered), strict=True):
            out[i] = ids
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = np.array(ids, np.int32)
        return out

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-case texts of plain Latin letters; each different word is looked up once."""
        if not texts:
            return []
        data = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)  # a quote is followed by two bytes
        word = _cut(data)
        last = np.cumsum([len(text) + 1 for text in texts]) - 1
        word[last] = True
        begin = np.flatnonzero(word)
        where = pa.array(np.append(begin, len(data)), pa.int64()).buffers()[1]
        coded = pa.LargeStringArray.from_buffers(len(begin), where, pa.py_buffer(data)).dictionary_encode()
        number = self._numbers(pc.utf8_ltrim(coded.dictionary, _BLANKS))[coded.indices.to_numpy()]
        sizes = np.diff(self.first)[number]
        end = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[number] - (end - sizes), sizes) + np.arange(int(end[-1]))]
        return np.split(ids, np.append(0, end)[np.searchsorted(begin, last[:-1])])


_TOKENISERS: dict[str, WordIds] = {}
_BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<long>, data binary"


def _write(path: str, end: int, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENISERS:
            _TOKENISERS[path] = WordIds(path)
        words = _TOKENISERS[path]
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def finished() -> pa.RecordBatch:
            row = [[part], [block], [before], [n], [docs], [encode_block(held, max(words.size, end + 1))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "block", "before", "n_ids", "doc_ids", "data"])

        for batch in pieces(batches, "text", _PIECE):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words(batch.column("text").to_pylist()), strict=True):
                docs.append(doc)
                held.append(np.append(ids, np.int32(end)))
                n += len(held[-1])
                if n >= size:
                    yield finished()
                    block, before, n = block + 1, before + n, 0
                    docs, held = [], []
        if held:
            yield finished()

    return write


def write_blocks(scratch: Scratch, docs: DataFrame, *, path: str | None = None, end: int = END, size: int = BLOCK, rows: int = 50_000) -> DataFrame:
    """Blocks of the documents' ids in ascending order of doc_id, one row a block, as stored Parquet.

    Every task writes the blocks of one range of ids; `part` and `block` order them, and `before`
    counts the ids of the part's earlier blocks.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("_tie", F.monotonically_increasing_id())
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plain.count() // rows))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()]
    ranged = plain.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.store(ranged.mapInArrow(_write(path or vocabulary_file(), end, size), _BLOCKS))


def _read(starts: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_ids", "data")), strict=True):
                found = decode_block(data)
                sizes = np.array([len(f) for f in found], np.int64)
                start = starts[part] + before + np.cumsum(sizes) - sizes
                crc = [zlib.crc32(f.astype("<u4").tobytes()) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Every document's place, number of ids and checksum, decoded from stored blocks."""
    starts, before = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row a range
        starts[part] = before
        before += n
    return blocks.select("part", "before", "doc_ids", "data").mapInArrow(_read(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, *, path: str | None = None, end: int = END, size: int = BLOCK) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    `docs` needs doc_id and text; other columns are ignored.  A null or empty text is the end id
    alone.  Null ids come last, equal ids in the order of the table; each row counts for
    itself.  A document longer than `size` has a block to itself or ends one.  An empty table gives no rows.
    """
    return read_blocks(write_blocks(Scratch(docs.sparkSession), docs, path=path, end=end, size=size))
