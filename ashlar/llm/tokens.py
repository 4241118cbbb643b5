"""Token ids of whole texts by the tokenizers library, with a cache of the parts that a text is made of.

Both vocabularies split a text before it is merged into tokens, and never merge across white space. A text is cut at
places where the library's own splitting always has a boundary, whatever stands around it:

* at the literals of added tokens such as ``<|endoftext|>``, which have ids of their own;
* ``words``: at runs of ASCII white space, which the vocabulary drops, after A-Z are lower-cased, as it does itself;
* ``spaced``: before each single space that stands between two bytes that are not ASCII white space (the space opens
  the next part).

So the ids of a text are the ids of its parts in order. A part that is letters of ASCII or Latin-1 with punctuation
after them has a boundary between the two as well, and its letters are merged by the library's model alone; the library
encodes any other part as a whole. Parts are kept in two dictionaries, the newer of which replaces the older when it
holds MOST_PARTS: parts that recur stay, memory is bounded, and results do not depend on it.
"""

from __future__ import annotations

import os
import re
from struct import pack

from .common import release

#: Entries in each of the two generations of parts, and of words without their marks; about 200 bytes an entry.
MOST_PARTS, MOST_WORDS = 320_000, 320_000
#: Longer parts are encoded each time.
LONGEST_PART = 64

_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_ENDS = b".,!?;:$%&*#"
#: White space next to a single space, or a space at either end.
_ODD = [a + b for w in b" \t\n\r\x0b\x0c" for a, b in ((bytes([w]), b" "), (b" ", bytes([w])))][1:]
#: No white space, ASCII or other.
_BARE = re.compile(rb"[!-~\xc3\x80-\xbf]*[!-~][!-~\xc3\x80-\xbf]*")
_CUT = re.compile(rb"(?<=[^\s]) (?=[^\s])")
#: Byte -> the letter that stands for it in a byte-level vocabulary: itself if it can be printed, else the next from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
_KEPT: dict[tuple[str, str, bool], "Encoder"] = {}


class _Parts(dict):
    """Part (UTF-8) -> its ids, little-endian numbers of ``kind`` (H: two bytes, I: four); makes what it lacks."""

    def __init__(self, library, before: str, lower: bool, kind: str):
        self.kind = kind
        self.library, self.model, self.before, self.lower = library, library.model, before, lower
        self.shown = before.encode().decode("latin-1").translate(_LETTER)
        self.old: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.old_letters: dict[bytes, bytes] = {}
        self.after_line, self.line = self, None
        self.marks: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}{self.kind}", *ids)

    def word(self, word: bytes) -> bytes:
        """Ids of letters alone."""
        if (ids := self.letters.get(word)) is None:
            if (ids := self.old_letters.get(word)) is None:
                shown = word.decode("latin-1")
                found = [t.id for t in self.model.tokenize(self.shown + (shown if word.isascii() else shown.translate(_LETTER)))]
                ids = pack(f"<{len(found)}{self.kind}", *found)
            self.letters[word] = ids
        return ids

    def __missing__(self, part: bytes) -> bytes:
        if (ids := self.old.get(part)) is None:
            word = part.rstrip(_ENDS)
            if not word.isalpha():  # bytes: letters of ASCII only
                m = _PLAIN.fullmatch(text := part.decode("utf-8", "replace"))
                word = (m[1].lower() if self.lower else m[1]).encode() if m else b""
                marks = m[2].encode() if m else b""
            else:
                marks = part[len(word) :]
            if word:
                ids = self.word(word)
                if marks:
                    if (more := self.marks.get(marks)) is None:
                        more = self.marks[marks] = self.whole(marks.decode())
                    ids += more
            elif b"\n" in part and all(map(_BARE.fullmatch, lines := part.split(b"\n"))):
                # A single line feed between other characters is a token of its own, and what follows has no space before it.
                if self.line is None:
                    self.line = self.whole("\n")
                return self[lines[0]] + b"".join(self.line + self.after_line[x] for x in lines[1:])
            else:
                ids = self.whole(self.before + text)
        if len(part) <= LONGEST_PART:
            self[part] = ids
        return ids

    def forget(self) -> None:
        """Drop all but the newer words."""
        self.clear()
        self.old, self.old_letters, self.marks = {}, {}, {}

    def trim(self) -> None:
        if len(self) > MOST_PARTS:
            self.old = dict(self)
            self.clear()
        if len(self.letters) > MOST_WORDS:
            self.old_letters, self.letters = self.letters, {}
        if len(self.marks) > MOST_PARTS:
            self.marks = {}


class Encoder:
    def __init__(self, path: str, kind: str, wide: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        plain = Tokenizer.from_file(path)
        number = "I" if wide or plain.get_vocab_size() > 1 << 16 else "H"
        #: Of each id in what ``one`` gives: two bytes, or four where the vocabulary needs them (or ``wide``).
        self.dtype = {"H": "<u2", "I": "<u4"}[number]
        added = plain.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens are looked for as they stand")
        self.added = {t.content.encode(): pack(f"<{number}", i) for i, t in added.items()}
        self.literal = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")")
        plain.encode_special_tokens = True  # texts are cut at these literals first: a part that has one got it by lower-casing
        self.spaced = {"words": False, "spaced": True}[kind]
        self.first = _Parts(plain, "", False, number)
        self.rest = _Parts(plain, " ", False, number) if self.spaced else _Parts(plain, "", True, number)
        self.rest.after_line = self.first

    @property
    def library(self):
        """The library's own tokenizer, whose ids those of ``one`` are."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def one(self, text: bytes) -> bytes:
        """Ids of a text (UTF-8), as ``dtype``."""
        if any(map(text.__contains__, self.added)):
            return b"".join(self.added[x] if k % 2 else self.between(x) for k, x in enumerate(self.literal.split(text)))
        return self.between(text)

    def between(self, text: bytes) -> bytes:
        """Ids of a text without literals of added tokens."""
        self.rest.trim()
        if not self.spaced:
            return b"".join(map(self.rest.__getitem__, text.lower().split()))  # the vocabulary has no capitals
        if not text:
            return b""
        odd = text[:1] == b" " or text[-1:] == b" " or any(x in text for x in _ODD)
        parts = _CUT.split(text) if odd else text.split(b" ")
        self.first.trim()
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def done(self) -> None:
        """At the end of a task: the worker may wait long for the next, beside others."""
        self.first.forget()
        self.rest.forget()
        release()


def encoder(path: str, kind: str, wide: bool = False) -> Encoder:
    """One for each Python worker."""
    if (path, kind, wide) not in _KEPT:
        _KEPT[path, kind, wide] = Encoder(path, kind, wide)
    return _KEPT[path, kind, wide]


def vocabulary(name: str) -> str:
    """The path of one of the public tokenizer files, in the driver and on executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)
