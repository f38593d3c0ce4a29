"""Vietnamese syllables: parsing of single tokens, driven by tables of onsets, nuclei and rimes.

A token becomes Telex letters one character at a time. After each one the onset and the nucleus are the longest table
entries that the letters so far begin with, until the entry is one that nothing longer can follow: it stays from then
on. Only what holds at the end decides: what is left must be a coda of the rime table and at most one tone.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from ..schemas import FINALS, INITIALS, NUCLEI, TONES
from .telex import MAX_LEN, Stream, letters

#: Onsets by spelling. Those that a longer spelling may replace stay open.
ONSETS = {x: x for x in "b c d g h l m n p r s t v x ch zd kh gh ng nh ngh ph qu th tr".split()} | {"k": "c", "dd": "zd"}
OPEN_ONSETS = frozenset(["", "c", "d", "g", "n", "p", "t", "ng"])
#: Nuclei by spelling; ASCII spellings stand for the marked nuclei they can only be.
RIMES = {
    "a": "a", "aa": "az", "az": "az", "aw": "aw", "e": "e", "ee": "ez", "ez": "ez", "i": "i", "ia": "ia", "ie": "iez", "y": "y", "ye": "iez",
    "o": "o", "oo": "ooo", "oz": "oz", "ow": "ow", "oe": "oe", "oa": "oa", "oaz": "uaz", "oaw": "oaw",
    "u": "u", "ua": "ua", "uaa": "uaz", "uaz": "uaz", "uaw": "uaw", "ue": "uez", "uw": "uw", "uwa": "uaw", "uwo": "uow", "uoo": "uoz", "uoz": "uoz", "uow": "uow", "uy": "uy", "uya": "uya", "uye": "uyez",
}
OPEN_RIMES = frozenset(["", "a", "e", "i", "o", "u", "y", "oa", "ooo", "ua", "uw", "uy"])
#: Letters that a nucleus takes when it is written in full.
WIDTH = {"": 0} | {x: {"uow": 4, "uyez": 4, "ooo": 2}.get(x, len(x)) for x in RIMES.values()}
CODAS = {x: x for x in "i u m n ng c p t ch nh y o".split()}
STOPS = frozenset(["c", "ch", "p", "t"])
MARKED = frozenset("az aw ez uw oz ow oaw uaz uez uow uoz uaw iez uyez".split())
#: The codas each nucleus takes ("-" for none).
ALLOWED = {
    k: frozenset("" if x == "-" else x for x in v.split())
    for ks, v in {
        "a": "- i u m n ng c p t ch nh y o",
        "e oe": "- o m n ng c p t",
        "i ez": "- u m n p t ch nh",
        "o oz ow u": "- i m n ng c p t",
        "uw": "- i u m n ng c p t",
        "y ia ua uaw uya": "-",
        "az": "u y m n ng c p t",
        "aw oaw": "m n ng c p t",
        "uyez": "n t",
        "oa": "- i y o m n ng c p t ch nh",
        "ooo": "ng c",
        "uy": "- u n p t ch nh",
        "iez": "u m n ng c p t",
        "uaz": "y m n ng c p t",
        "uez": "- m n p t ch nh",
        "uoz": "i m n ng c p t",
        "uow": "i u m n ng c p t",
    }.items()
    for k in ks.split()
}
#: Where the onset changes which codas a nucleus takes.
WITH_ONSET = {
    ("gi", "i"): ALLOWED["i"] | {"ng", "c"},
    ("gi", "ez"): ALLOWED["ez"] | {"ng", "c"},
    ("qu", "y"): frozenset(["", "u", "m", "n", "p", "t", "ch", "nh"]),
    ("qu", "iez"): frozenset(["u", "m", "n", "t"]),
    ("kh", "uez"): ALLOWED["uez"] | {"u"},
}
#: Nuclei that an onset never takes.
BARRED = {"gi": frozenset(["i", "y", "ia", "iez"]), "c": frozenset(["oa", "oaw", "oe", "uyez", "uaz", "uez", "uy"]), "qu": frozenset(["oe", "oa", "oaw", *(x for x in RIMES.values() if x.startswith("u"))])}
OPENED = {"ua": "uoz", "ia": "iez", "uaw": "uow", "uya": "uyez"}


class Syllable(NamedTuple):
    dau: str
    giua: str
    cuoi: str
    tone: str


class Parsed(NamedTuple):
    """A syllable with what its spelling said of marks and case."""

    syllable: Syllable
    marked: bool
    first_upper: bool
    all_upper: bool


def _longest(table: dict[str, str], text: str, most: int) -> str:
    return next((table[text[:n]] for n in range(min(most, len(text)), 0, -1) if text[:n] in table), "")


def _onset(text: str) -> str:
    if text[:2] == "gi" and text[2:3] in tuple("eyuioa"):
        return "gi"
    return _longest(ONSETS, text, 3)


def _width(onset: str) -> int:
    return 2 if onset == "zd" else len(onset)


def valid(dau: str, giua: str, cuoi: str) -> bool:
    """Whether an onset, a nucleus and a coda go together."""
    return giua in ALLOWED and giua not in BARRED.get(dau, ()) and cuoi in WITH_ONSET.get((dau, giua), ALLOWED[giua])


def _rest_at(stream: Stream, dau: str, giua: str) -> int:
    """Where the letters after the nucleus begin: ASCII spellings may leave out the nucleus's last letter."""
    at, text = _width(dau), stream.text
    end = at + WIDTH[giua]
    last = {"uyez": (3, "ez"), "iez": (2, "ez"), "uez": (2, "ez"), "uow": (3, "w")}.get(giua)
    if last and (end > len(text) or text[at + last[0]] not in last[1]):
        end -= 1
    return end


def _finished(stream: Stream, dau: str, giua: str) -> Syllable | None:
    if not giua or giua in BARRED.get(dau, ()):
        return None
    at = _rest_at(stream, dau, giua)
    rest = stream.text[at:]
    if len(rest) > at + 3:
        return None
    cuoi = _longest(CODAS, rest, 2)
    if not rest and giua == "uow":
        giua = "ua"
    if not valid(dau, giua, cuoi):
        return None
    extra = len(rest) - len(cuoi)
    if extra > (0 if stream.tone else 1):
        return None
    tone = stream.tone or (stream.last if extra else "")
    if tone not in TONES or (cuoi in STOPS and tone not in ("s", "j")):
        return None
    return Syllable(dau, giua, cuoi, tone)


def _acceptable(s: Syllable, stream: Stream) -> bool:
    """The strict rules: no tones or marks in ASCII, but where the nucleus leaves no doubt, and nothing left over."""
    if s.tone and not stream.tone:
        return False
    if (s.dau == "zd" or s.giua in MARKED) and not stream.marked:
        sure = s.giua == "uyez" or (s.giua in ("iez", "uez") and 2 * bool(stream.tone) + _width(s.dau) + len(s.cuoi) >= 4)
        if not sure:
            return False
        stream.marked = True
    size = _width(s.dau) + WIDTH[s.giua] + len(s.cuoi) + len(s.tone)
    return len(stream.text) <= size or (s.giua == "ua" and stream.text.endswith("uow"))


def normalized(s: Syllable) -> Syllable:
    """One form for what is pronounced alike."""
    dau, giua = s.dau, OPENED.get(s.giua, s.giua)
    if dau == "gi" and giua == "ez" and s.cuoi:
        giua = "iez"
    elif dau == "g" and giua == "i":
        dau = "gi"
    return Syllable({"ngh": "ng", "gh": "g"}.get(dau, dau), giua, s.cuoi, s.tone)


def _shape() -> re.Pattern[str]:
    """What every syllable looks like, in lower case: consonants, vowels and marks, consonants and a tone."""
    vowels = "".join(c for c, x in letters().items() if x.base[0] in "aeiouy" and not x.upper)
    return re.compile(f"[bcdđðghklmnpqrstvx]{{0,3}}[{vowels}wz]+[nghmcptsfrxj]{{0,3}}")


_is_shaped = _shape().fullmatch
_has_combining = re.compile("[\u0300-\u0362]").search


def parse(token: str, strict: bool = True) -> Parsed | None:
    """The normalised syllable of a token, or None. Without `strict`, ASCII Telex counts as well.

    Most tokens that are none don't even look like one, which is found out at once.
    """
    return _parse(token, strict) if may_parse(token) else None


def may_parse(token: str) -> bool:
    """Whether a token looks like a syllable, or has marks of its own and may be one."""
    return bool(token) and bool(_is_shaped(token.lower()) or _has_combining(token))


def _parse(token: str, strict: bool) -> Parsed | None:
    stream, dau, giua = Stream(), "", ""
    for char in token:
        if not stream.push(char):
            return None
        if not stream.last:
            continue
        if dau in OPEN_ONSETS:
            dau = _onset(stream.text)
        if giua in OPEN_RIMES and len(stream.text) > _width(dau):
            giua = _longest(RIMES, stream.text[_width(dau) :], 3)
    if len(stream.text) == _width(dau):
        return None
    s = _finished(stream, dau, giua)
    if s is None or (strict and not _acceptable(s, stream)):
        return None
    return Parsed(normalized(s), stream.marked or bool(stream.tone), stream.first_upper, stream.all_upper)


def syllable_id(s: Syllable) -> int:
    """The id of a normalised syllable: mixed radix over onset, nucleus, and coda with tone."""
    giua, cuoi = folded(s.giua, s.cuoi)
    coda, tone = FINALS.index(cuoi), TONES.index(s.tone)
    return INITIALS.index(s.dau) * 1050 + NUCLEI.index(giua) * 42 + (coda * 6 + tone if coda < 6 else 36 + (coda - 6) * 2 + tone - 1)


#: Codas that are written in two ways count as one; the nucleus keeps the difference.
FOLD = {
    "y": ("i", {"a": "aw", "oa": "oaw"}),
    "o": ("u", {"a": "aw"}),
    "nh": ("ng", {"a": "ah", "oa": "oah"}),
    "ch": ("c", {"a": "ah", "oa": "oah"}),
}


def folded(giua: str, cuoi: str) -> tuple[str, str]:
    to, changes = FOLD.get(cuoi, (cuoi, {}))
    return changes.get(giua, giua), to


@lru_cache(maxsize=200_000)
def lookup(token: str) -> tuple[int | None, bool, bool, bool]:
    """(id, marked, first letter upper, all upper) of a token, by the strict rules; a bounded memo of a process."""
    if len(token.encode("utf-8", "surrogatepass")) > MAX_LEN:
        return None, False, False, False
    p = parse(token)
    return (syllable_id(p.syllable), p.marked, p.first_upper, p.all_upper) if p else (None, False, False, False)


def can_be_vietnamese(token: str | None) -> bool:
    return bool(token) and parse(token, strict=False) is not None
