"""Tokenizer front ends over the distinct-chunk table, one set per Python worker."""

from __future__ import annotations

import functools
import os
import re

from .common import ChunkEncoder, pack_ids

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _file(name: str) -> str:
    return name if "/" in name else tokenizer_path(name)


#: A word of Latin letters with closing punctuation. Both tokenizers split it between the two, no normal form changes
#: the letters, and each has one lower case letter.
LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
CLOSING = ".,;:!?|*$%&#"
#: Stands before a chunk that has no blank of its own in front.
AS_IS = "\0"


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Words:
    """Packed ids of chunks. Letters and punctuation of plain words are looked up apart and segmented by the
    library's model, once each for the first `most` of them; whatever else goes through the whole tokenizer."""

    def __init__(self, name: str, lower: bool, blank: str = "", most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.lower, self.blank, self.most, self.known = Tokenizer.from_file(_file(name)), lower, blank, most, {}
        self.model, self.letters = self.tok.model, _byte_letters()

    def part(self, text: str) -> bytes:
        if (got := self.known.get(text)) is None:
            if text.isascii():  # letters and punctuation stand for themselves
                seen = text if text[0] != " " else self.letters[32] + text[1:]
            else:
                seen = "".join(map(self.letters.__getitem__, text.encode()))
            got = pack_ids([t.id for t in self.model.tokenize(seen)])
            if len(self.known) < self.most:
                self.known[text] = got
        return got

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def __call__(self, chunk: str) -> bytes:
        blank, text = ("", chunk[1:]) if chunk[0] == AS_IS else (self.blank, chunk)
        head = text.rstrip(CLOSING)
        if head and not head.strip(LETTERS):
            got = self.part(blank + (head.lower() if self.lower else head))
            return got if len(head) == len(text) else got + self.part(text[len(head) :])
        return self.whole(blank + text)


#: White space for str.split() that the tokenizers' \s doesn't name.
_ODD = re.compile("[\x1c-\x1f]")
#: A single space between two other characters: no word-level pattern reaches across the place before it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_NEWLINE = f" {AS_IS}\n {AS_IS}"
_RUN = re.compile(r"\s\s")


def words(text: str) -> list[str] | None:
    """Chunks for a tokenizer that drops white space."""
    return None if _ODD.search(text) or AS_IS in text else text.split()


def spaced_words(text: str) -> list[str] | None:
    """Chunks for a byte-level tokenizer: each is written without the one space before it, or with AS_IS where there is
    none. A single newline between two other characters is a chunk; longer white space stays inside one."""
    if AS_IS in text:
        return None
    if _RUN.search(text) or not text or text[0].isspace() or text[-1].isspace():
        return [c[1:] if c[0] == " " and not c[1:2].isspace() and len(c) > 1 else AS_IS + c for c in _CUT.split(text) if c]
    return f"{AS_IS}{text.replace(chr(10), _NEWLINE)}".split(" ")


@functools.cache
def word_encoder(name: str = "word_bpe_49k.json") -> ChunkEncoder:
    w = _Words(name, lower=True)
    return ChunkEncoder(words, w, w.whole)


@functools.cache
def byte_encoder(name: str = "byte_bpe_50k.json") -> ChunkEncoder:
    w = _Words(name, lower=False, blank=" ")
    return ChunkEncoder(spaced_words, w, w.whole, most=800_000)
