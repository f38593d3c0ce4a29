"""Code points to Telex letters: case, tone, and a base of one or two ASCII letters.

The letters of Vietnamese are its twelve vowels with and without the five tone marks, and d with a stroke; their table
is composed from these, by Unicode, and not listed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: The vowels and how Telex writes them; tones and their combining marks.
VOWELS = {"a": "a", "ă": "aw", "â": "az", "e": "e", "ê": "ez", "i": "i", "o": "o", "ô": "oz", "ơ": "ow", "u": "u", "ư": "uw", "y": "y"}
TONE_MARKS = {"s": "́", "f": "̀", "r": "̉", "x": "̃", "j": "̣"}
#: Combining characters that set a tone, and those that mark a vowel: the letters they may follow and what they add.
COMBINING_TONES = {0x301: "s", 0x341: "s", 0x300: "f", 0x340: "f", 0x309: "r", 0x303: "x", 0x323: "j"}
COMBINING_MARKS = {0x302: ("aeo", "z"), 0x306: ("a", "w"), 0x31B: ("uo", "w")}
MAX_LEN = 10


class Letter(NamedTuple):
    base: str
    tone: str
    upper: bool


@lru_cache(maxsize=1)
def letters() -> dict[str, Letter]:
    """Each character that a syllable may be written with, alone."""
    out = {c: Letter(c, "", False) for c in "abcdefghijklmnopqrstuvwxyz"}
    out |= {c: Letter("dd", "", False) for c in "đð"}
    for vowel, base in VOWELS.items():
        out[vowel] = Letter(base, "", False)
        out |= {unicodedata.normalize("NFC", vowel + mark): Letter(base, tone, False) for tone, mark in TONE_MARKS.items()}
    return out | {c.upper(): x._replace(upper=True) for c, x in out.items()}


def toned(vowel: str, tone: str) -> str:
    """A vowel with a tone mark; no tone leaves it as it is."""
    return unicodedata.normalize("NFC", vowel + TONE_MARKS[tone]) if tone else vowel


class Stream:
    """What a token looks like in Telex: letters, with tone and case apart. `push` is False where no syllable can be."""

    __slots__ = ("text", "tone", "last", "marked", "first_upper", "n_upper", "n_lower")

    def __init__(self) -> None:
        self.text, self.tone, self.last, self.marked = "", "", "", False
        self.first_upper, self.n_upper, self.n_lower = False, 0, 0

    def push(self, char: str) -> bool:
        if len(self.text) >= MAX_LEN:
            return False
        code = ord(char)
        if code in COMBINING_TONES:
            return self._set_tone(COMBINING_TONES[code], again=False)
        if code in COMBINING_MARKS:
            follows, adds = COMBINING_MARKS[code]
            if adds == "w" and self.text.endswith("w"):  # the stream has turned the letters round before
                adds = ""
            elif not self.text or self.text[-1] not in follows:
                return False
            self.text, self.marked = self.text + adds, True
            return True
        letter = letters().get(char)
        self.last = char
        if letter is None:
            return False
        self.first_upper |= letter.upper and not self.text
        self.n_upper += letter.upper
        self.n_lower += not letter.upper
        if letter.tone and not self._set_tone(letter.tone, again=True):
            return False
        double = len(letter.base) == 2
        self.marked |= double
        if self.text.endswith("w") and letter.base[0] in ("oa" if double else "o"):
            self.text = self.text[:-1] + letter.base[0] + "w"
            return True
        if double and len(self.text) + 2 > MAX_LEN:
            return False
        self.text += letter.base
        return True

    def _set_tone(self, tone: str, again: bool) -> bool:
        if self.tone and not (again and self.tone == tone):
            return False
        self.tone = tone
        return True

    @property
    def all_upper(self) -> bool:
        return len(self.text) > 1 and self.n_lower == 0
