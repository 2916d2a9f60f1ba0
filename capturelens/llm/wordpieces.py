"""Encoding with a public tokenizer on executors, each distinct word of a task once."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

CACHED_WORDS = 800_000
CACHED_PARTS = 800_000
# str.split() also cuts at these, which the tokenizers take as ordinary characters
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# letters that are composed and lower-cased alike everywhere, then ASCII marks other than the apostrophe
LETTERS_AND_MARKS = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]+|)")


def public_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """A tokenizer of the tokenizers library without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """One tokenizer per worker process and file; special strings inside texts are ordinary text to it."""
    tokenizer = load(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Encoder:
    """Token ids of whole texts as packed unsigned 32-bit integers.

    ``.json`` files are read by the tokenizers library, ``.model`` files by sentencepiece. A tokenizer
    that drops white space encodes a text word by word, so each distinct word is encoded once and kept;
    any other encodes whole texts. Special strings inside texts are handled as the library does by
    default.
    """

    def __init__(self, path: str):
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.merge = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_all, self.by_words = lambda texts: model.encode(texts, num_threads=1), False
            return
        tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_words = drops_spaces(config)
        if folds_case(config):
            from tokenizers import pre_tokenizers

            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.as_bytes = {c: spell(chr(c))[0][0] for c in range(0xC0, 0x100)}
            self.merge = tokenizer.model.tokenize
        self.encode_all = lambda texts: [
            e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null counts as empty."""
        if not self.by_words:
            for text in texts:
                yield array("I", self.encode_all([text or ""])[0]).tobytes()
            return
        kept = self.kept
        for text in texts:
            words = split_words(text or "")
            missing = set(words).difference(kept)
            if missing:
                if len(kept) > CACHED_WORDS:
                    kept.clear()
                    missing = set(words)
                self.learn(missing)
            yield b"".join(map(kept.__getitem__, words))

    def learn(self, words: Iterable[str]) -> None:
        """Keeps the ids of words; letters with marks after them are two parts that the merges take as they are."""
        kept, parts, whole = self.kept, self.parts, []
        if len(parts) > CACHED_PARTS:
            parts.clear()
        for word in words:
            found = LETTERS_AND_MARKS.fullmatch(word) if self.merge else None
            if found is None:
                whole.append(word)
                continue
            letters, marks = found[1].lower(), found[2]
            ids = parts.get(letters)
            if ids is None:
                ids = parts[letters] = self.merged(letters if letters.isascii() else letters.translate(self.as_bytes))
            if marks:
                more = parts.get(marks)
                if more is None:
                    more = parts[marks] = self.merged(marks)
                ids += more
            kept[word] = ids
        for word, ids in zip(whole, self.encode_all(whole) if whole else ()):
            kept[word] = array("I", ids).tobytes()

    def merged(self, part: str) -> bytes:
        return array("I", [token.id for token in self.merge(part)]).tobytes()


def split_words(text: str) -> list[str]:
    """The text cut at white space as Unicode defines it."""
    if SEPARATORS.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def drops_spaces(config: dict) -> bool:
    """Whether a tokenizer's first cut keeps only runs without white space, so that words stand alone."""
    steps = (config.get("pre_tokenizer") or {})
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", " ")
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern
        and bool(config["model"].get("end_of_word_suffix"))
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in config["added_tokens"])
    )


def folds_case(config: dict) -> bool:
    """Whether a tokenizer that works word by word lower-cases and parts letters from marks."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        drops_spaces(config) and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in first["pattern"]["Regex"]
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
