"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

The library spends its time on words it has already seen. Texts are cut at spaces where the tokenizer's own
pre-tokenizer cuts as well, whatever stands around; the ids of the parts joined are the ids of the whole.

* Byte-level BPE whose pattern has optional leading spaces and no look-behind: a cut before a single space between
  two characters that are not white space is always a cut of the pattern.
* BPE with word ends, white space dropped: no token holds white space, and no normal form joins across a space.
* Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, islice

CACHE_WORDS = 700_000  # entries a worker keeps; of two halves the one filled first goes, but for what was met again
CACHE_MARKS = 4096
#: A word that is one pre-token, or two with the mark behind it; lower case and normal form are plain for these letters.
_PLAIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")
#: The same where every run of marks is one pre-token; apostrophes may belong to letters behind them.
_LED_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte that is no visible Latin-1 character as the next letter from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(visible))
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordCachedTokenizer:
    """``encode_bytes`` gives the ids of a text as little-endian integers of ``itemsize`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.itemsize = array(self.code).itemsize
        self.kind = self._kind(json.loads(self.tokenizer.to_str()))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.marks = dict(zip(["", ".", ","], [b"", *self._plain([".", ","])], strict=True))
        letters = _byte_letters()
        self.as_text = "".join([letters[b] for b in range(256)])

    def forget(self) -> None:
        self.words.clear()
        self.older.clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return "leading space"
        parts = pre.get("pretokenizers", [])
        steps = {n["type"] for n in (norm or {}).get("normalizers", [])}
        if (
            steps == {"NFC", "Replace", "Lowercase"}
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and r"[^\s" in parts[0]["pattern"]["Regex"]
            and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        ):
            return "space dropped"
        return "whole"

    def _plain(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """The ids of letters alone, which the model takes as they are."""
        led = self.kind == "leading space"
        if not led:
            word = word.lower()
        if not word.isascii():
            word = charmap_decode(word.encode(), "strict", self.as_text)[0]
        return array(self.code, [t.id for t in self.model.tokenize("\u0120" + word if led else word)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._plain([mark])[0]
            if len(self.marks) < CACHE_MARKS:
                self.marks[mark] = ids
        return ids

    def _encode_words(self, new: Iterable[str], lead: str) -> None:
        words, older, rest = self.words, self.older, []
        plain = _LED_WORD if lead else _PLAIN_WORD
        for w in new:
            if (ids := older.get(w)) is not None:
                words[w] = ids
            elif m := plain.fullmatch(w):
                stem, mark = m.groups()
                ids = words.get(stem) or older.get(stem)
                if ids is None:
                    ids = words[stem] = self._word(stem)
                if mark:
                    words[w] = ids + self._mark(mark)
            elif not (lead and (not w or w[0].isspace() or w[-1].isspace())):
                rest.append(w)  # others may belong to a run of white space
        words.update(zip(rest, self._plain([lead + w for w in rest]), strict=True))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._plain(texts)
        if len(self.words) > CACHE_WORDS // 2:
            self.older, self.words = self.words, {}
        split = [t.split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        if self.kind == "space dropped":
            self._encode_words(new, "")
            return [b"".join(map(self.words.__getitem__, s)) for s in split]
        self._encode_words(new, " ")
        firsts = self._plain([s[0] for s in split])
        return [self._leading(*x) for x in zip(texts, split, firsts, strict=True)]

    def _leading(self, text: str, parts: list[str], first: bytes) -> bytes:
        if parts[0] and not parts[0][-1].isspace():
            try:
                return b"".join(chain((first,), map(self.words.__getitem__, islice(parts, 1, None))))
            except KeyError:
                pass  # a part that is not kept
        parts = _SINGLE_SPACE.split(text)
        unknown = list({w for w in parts[1:] if w not in self.words})
        own = dict(zip(unknown, self._plain([" " + w for w in unknown]), strict=True))
        return self._plain(parts[:1])[0] + b"".join([own[w] if w in own else self.words[w] for w in parts[1:]])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordCachedTokenizer:
    """One for each worker process and file."""
    return WordCachedTokenizer(path)
