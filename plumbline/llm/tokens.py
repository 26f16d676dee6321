"""Tokenizers by file path; a worker loads each once and keeps what it has worked out."""

from __future__ import annotations

import base64
import ctypes
import functools
import os
import re
import threading
import time
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps (some 200 bytes each), the longest such word, and the seconds without a text after which they go.
CACHE_WORDS, CACHE_CHARS, IDLE_S = 600_000, 48, 3.0

#: Words that the library encodes at a time.
BATCH_WORDS = 2048

LONGEST_BLANK = 10_000
_BLANKS = re.compile(r"\s{%d,}" % LONGEST_BLANK)
_TAIL = ".,!?;:)(\"$%&*#@|+-="  # ASCII marks that the word tokenizer splits off after a letter


class WordBpe:
    """A word-level BPE (``tokenizers`` file) that splits at white space and lowers case: ids of whole texts.

    Words repeat, so a column is cut and numbered in Arrow and each distinct word is encoded
    once; marks after a word's last letter are encoded apart, which is what the tokenizer's own
    pattern does.  Texts that hold one of the tokenizer's added tokens, which it finds before
    anything else and only as written, take the plain call.  The ids equal those of the plain call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True  # lowering case may make an added token of other text
        self.added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # what was known before; words still in use come back from there
        self.busy, self.used, self.watched = threading.Lock(), time.monotonic(), False

    def _watch(self) -> None:
        """Drop the words once no text has come for IDLE_S: an idle worker stays, beside whatever its executor does next."""
        while True:
            time.sleep(IDLE_S / 3)
            with self.busy:
                if time.monotonic() - self.used < IDLE_S:
                    continue
                self.known, self.older, self.watched = {"": b""}, {}, False
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
            return

    @functools.cached_property
    def whole(self):
        """The tokenizer as it is; only texts with added tokens need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, words: list[str]) -> list[bytes]:
        found = []
        for k in range(0, len(words), BATCH_WORDS):  # what the library returns for a word takes more than a kilobyte
            found += [array("H", e.ids).tobytes() for e in self.inner.encode_batch_fast(words[k : k + BATCH_WORDS], add_special_tokens=False)]
        return found

    def _resolve(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known; short ones are kept."""
        known, older, parts, wanted = self.known, self.older, {}, set()
        back = {w: older[w] for w in words if w in older} if older else {}
        if back:
            known.update(back)
            words = [w for w in words if w not in back]
        for w in words:
            core = w.rstrip(_TAIL)
            if core != w and core and core[-1].isalpha():
                parts[w] = core, w[len(core) :]
                wanted.update(parts[w])
            else:
                wanted.add(w)
        wanted = [w for w in wanted if w not in known]
        found = dict(zip(wanted, self._plain(wanted), strict=True))
        for w, (core, tail) in parts.items():
            found[w] = (found.get(core) or known[core]) + (found.get(tail) or known[tail])
        known.update(found)
        for w in [w for w in found if len(w) > CACHE_CHARS]:
            del known[w]
        found.update(back)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column without nulls, one after the other, and where each text begins and ends."""
        plain = functools.reduce(pc.or_, (pc.match_substring(texts, a) for a in self.added)) if self.added else None
        if plain is None or not pc.any(plain).as_py():
            return self._by_words(texts)
        ids, cuts = self._by_words(pc.if_else(plain, "", texts))
        parts, place = [], np.flatnonzero(np.asarray(plain))
        at = 0
        for k in place.tolist():
            parts += [ids[at : cuts[k]], np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint16)]
            at = cuts[k]
        sizes = np.diff(cuts)
        sizes[place] = [len(p) for p in parts[1::2]]
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        with self.busy:
            try:
                return self._numbered(texts)
            finally:
                self.used = time.monotonic()
                if not self.watched:
                    self.watched = True
                    threading.Thread(target=self._watch, daemon=True).start()

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {"": b""}, self.known
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # ASCII letters and ASCII white space alone
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        values = list(map(self.known.get, words))
        fresh = [k for k, v in enumerate(values) if v is None]
        if fresh:
            found = self._resolve([words[k] for k in fresh])
            for k in fresh:
                values[k] = found[words[k]]
        pool = np.frombuffer(b"".join(values), np.uint16)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 2
        begin = np.cumsum(size) - size
        at = np.asarray(coded.indices)
        many = size[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = pool[np.repeat(begin[at] - ends[:-1], many) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
        return ids, ends[cuts]


class ByteBpe:
    """A byte-level BPE (``tiktoken`` ranks file): lossless ids of whole texts."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. White space beyond LONGEST_BLANK in a row is encoded in parts, which the library can't take whole."""
        cuts = [k for m in _BLANKS.finditer(text) for k in range(m.start() + LONGEST_BLANK, m.end(), LONGEST_BLANK)]
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]
        return np.array([i for part in parts for i in self.inner.encode_ordinary(part)], np.uint16)


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def public(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
