"""The id space of syllables as column arithmetic: encoding, decoding, validity and the four renderings.

An id is onset * 1050 + nucleus * 42 + (coda with tone); the whole space is a table of 26,250 rows that `syllable_dim`
makes from a range, so lookups by id or by rendering are equi-joins with a broadcast of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import BASE64, FINALS, INITIALS, MAX_ID, NUCLEI, TONES
from .columns import let
from .syllable import ALLOWED, BARRED, FOLD, MARKED, OPEN_ONSETS, STOPS, WIDTH, WITH_ONSET
from .telex import VOWELS, toned

#: What folding has made one, taken apart again: nucleus and folded coda to nucleus and coda.
UNFOLD = {("aw", "i"): ("a", "y"), ("oaw", "i"): ("oa", "y"), ("az", "i"): ("az", "y"), ("uaz", "i"): ("uaz", "y"), ("aw", "u"): ("a", "o")}
UNFOLD |= {(g, "u"): (g, "o") for g in ("e", "oa", "oe")}
UNFOLD |= {(g, stop): (g, to) for g in ("ez", "i", "uez", "uy") for stop, to in (("ng", "nh"), ("c", "ch"))}
UNFOLD |= {(f"{g}h", stop): (g, to) for g in ("a", "oa") for stop, to in (("ng", "nh"), ("c", "ch"))}
SYLLABLE = StructType([StructField(x, StringType()) for x in ("dau", "giua", "cuoi", "tone")])


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _mapped(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("|", a, b)


def decode(i: Column) -> Column:
    """struct(dau, giua, cuoi, tone) of an id; null outside the space."""
    act = (i % 42).cast("int")
    coda = F.when(act < 36, F.floor(act / 6)).otherwise(F.floor((act - 36) / 2) + 6).cast("int")
    tone = F.when(act < 36, act % 6).otherwise((act - 36) % 2 + 1)
    dau = F.get(_words(INITIALS), F.floor(i / 1050).cast("int"))
    giua = F.get(_words(NUCLEI), F.floor(i / 42).cast("int") % len(NUCLEI))
    cuoi = F.get(_words(FINALS), coda)
    table = {"|".join(k): "|".join(v) for k, v in UNFOLD.items()} | {"y|ng": "y|nh"}
    rime = lambda x: F.when((x == "y|ng") & (dau != "qu"), x).otherwise(_mapped(table, x, x))
    both = let(_pair(giua, cuoi), lambda x: F.split(rime(x), r"\|"))
    found = let(both, lambda x: F.struct(dau.alias("dau"), F.get(x, 0).alias("giua"), F.get(x, 1).alias("cuoi"), F.get(_words(TONES), tone).alias("tone")))
    return F.when((i >= 0) & (i < MAX_ID), found)


def encode(dau: Column, giua: Column, cuoi: Column, tone: Column) -> Column:
    """The id of a normalised syllable; null if a part is unknown or a stop has a tone it can't."""
    nuclei = {f"{g}|{c}": to for c, (_, changes) in FOLD.items() for g, to in changes.items()}
    giua = _mapped(nuclei, _pair(giua, cuoi), giua)
    cuoi = _mapped({c: to for c, (to, _) in FOLD.items()}, cuoi, cuoi)
    at = lambda values, x: F.array_position(_words(values), x).cast("int") - 1
    places = F.struct(at(INITIALS, dau).alias("d"), at(NUCLEI, giua).alias("g"), at(FINALS, cuoi).alias("c"), at(TONES, tone).alias("t"))

    def number(x: Column) -> Column:
        act = F.when(x["c"] < 6, x["c"] * 6 + x["t"]).when(x["t"].between(1, 2), 36 + (x["c"] - 6) * 2 + x["t"] - 1)
        return F.when((x["d"] >= 0) & (x["g"] >= 0) & (x["c"] >= 0) & (x["t"] >= 0), x["d"] * 1050 + x["g"] * 42 + act)

    return let(places, number)


def valid(dau: Column, giua: Column, cuoi: Column) -> Column:
    """Whether the parts go together, from the tables that the parser uses."""
    names = lambda x: ",".join(y or "-" for y in sorted(x))
    plain = _mapped({k: names(v) for k, v in ALLOWED.items()}, giua, F.lit(""))
    own = _mapped({"|".join(k): names(v) for k, v in WITH_ONSET.items()}, _pair(dau, giua), plain)
    barred = _pair(dau, giua).isin(*[f"{d}|{g}" for d, gs in BARRED.items() for g in gs])
    return ~barred & F.array_contains(F.split(own, ","), F.when(cuoi == "", "-").otherwise(cuoi))


def shown_nucleus(s: Column) -> Column:
    """The nucleus as it is spelt in Telex: it depends on whether a coda or an onset is there."""
    dau, giua, bare = s["dau"], s["giua"], s["cuoi"] == ""
    return (
        F.when((giua == "uow") & bare, "uaw").when((giua == "uoz") & bare, "ua").when(giua == "ooo", "oo").when((giua == "uyez") & bare, "uya")
        .when((giua == "iez") & bare, "ia").when((giua == "iez") & dau.isin("", "qu"), "yez").otherwise(giua)
    )


def _shown_onset(dau: Column, first: Column, d: str) -> Column:
    """The onset as it is spelt before a vowel letter."""
    front = first.isin("e", "i", "y")
    return (
        F.when(dau == "zd", d).when((dau == "c") & front, "k").when((dau == "gi") & (first == "i"), "g")
        .when((dau == "g") & front, "gh").when((dau == "ng") & front, "ngh").otherwise(dau)
    )


def dense(s: Column, spare: bool = False) -> Column:
    """`nuoc|ws`, or `nuoc ws` with `spare`: letters, then mark and tone."""
    return let(shown_nucleus(s), lambda giua: _dense(s, giua, spare))


def _dense(s: Column, giua: Column, spare: bool) -> Column:
    letters = F.concat(_shown_onset(s["dau"], giua.substr(1, 1), "d d" if spare else "dd"), F.regexp_replace(giua, "[wz]", ""), s["cuoi"])
    signs = F.concat(F.regexp_extract(giua, "[wz]", 0), s["tone"])
    return F.rtrim(F.concat(letters, F.lit(" "), signs)) if spare else F.concat(letters, F.lit("|"), signs)


def parts(s: Column) -> Column:
    """`n_uow|c_s`: onset, nucleus, coda and tone in one spelling each."""
    giua, cuoi = s["giua"], s["cuoi"]
    dau = F.when(s["dau"] == "zd", "dd").when(s["dau"] == "gi", "d").otherwise(s["dau"])
    shown = (
        F.when(giua == "ooo", "oo").when(giua == "iez", "yez").when(giua == "i", "y")
        .when((giua == "a") & cuoi.isin("y", "o"), "aw").when((giua == "oa") & (cuoi == "y"), "oaw").otherwise(giua)
    )
    onset = F.when(dau == "", "").when(dau == "qu", F.when(shown.isin("a", "e"), "c_o").otherwise("c_u")).otherwise(F.concat(dau, F.lit("_")))
    coda = F.when(cuoi == "", "").otherwise(F.concat(F.lit("|"), F.when(cuoi == "o", "u").when(cuoi == "y", "i").otherwise(cuoi)))
    return F.concat(onset, shown, coda, F.lit("_"), s["tone"])


def _toned_nuclei() -> dict[str, str]:
    """`nucleus tone` to its letters; the tone stands on the last vowel, or on the one before in ia, ua, uaw and uya."""
    telex = {v: k for k, v in VOWELS.items()}
    spelt = {x: x for x in NUCLEI} | {"ooo": "oo", "ia": "ia", "ua": "ua", "uaw": "uwa", "uya": "uya", "uow": "uwow", "yez": "yez"}
    out = {}
    for name, letters in spelt.items():
        vowels, at = [], 0
        while at < len(letters):
            two = letters[at : at + 2]
            vowels.append(telex.get(two) or telex.get(two[:1], two[:1]))
            at += 2 if two in telex else 1
        place = len(vowels) - (2 if name in ("ia", "ua", "uaw", "uya") else 1)
        for tone in TONES:
            out[f"{name} {tone}"] = "".join(toned(v, tone) if i == place and v in VOWELS else v for i, v in enumerate(vowels))
    return out


def utf8(s: Column) -> Column:
    """The syllable as it is written, in lower case."""
    table = _toned_nuclei()
    giua = F.when(s["giua"] == "ooo", "ooo").otherwise(shown_nucleus(s))
    letters = let(giua, lambda g: _mapped(table, F.concat(g, F.lit(" "), s["tone"]), g))
    return F.concat(_shown_onset(s["dau"], s["giua"].substr(1, 1), "đ"), letters, s["cuoi"])


def to_base64(i: Column) -> Column:
    """Three characters, the most significant first."""
    digit = lambda shift: F.substring(F.lit(BASE64), F.shiftright(i, shift).bitwiseAND(63) + 1, F.lit(1))
    return F.concat(digit(12), digit(6), digit(0))


def from_base64(x: Column) -> Column:
    digit = lambda at: F.instr(F.lit(BASE64), x.substr(at, 1)) - 1
    return F.shiftleft(digit(1), 12) + F.shiftleft(digit(2), 6) + digit(3)


def without_case(transform: Column) -> Column:
    """A rendering without its leading carets."""
    return F.regexp_replace(transform, r"^\^{0,2} ?", "")


def without_tone_and_mark(transform: Column) -> Column:
    """A rendering without case, then without one tone and one mark at its end."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(without_case(transform), "[sfrxj]$", ""), "[wz]$", ""))


def syllable_dim(spark: SparkSession) -> DataFrame:
    """syllable_id, dau, giua, cuoi, tone, is_valid, dense, spare, parts, utf8 for each id."""
    s = F.col("s")
    rows = spark.range(MAX_ID).select(F.col("id").cast("int").alias("syllable_id"), decode(F.col("id").cast("int")).alias("s"))
    return rows.select("syllable_id", "s.*", valid(s["dau"], s["giua"], s["cuoi"]).alias("is_valid"), dense(s).alias("dense"), dense(s, spare=True).alias("spare"), parts(s).alias("parts"), utf8(s).alias("utf8"))


def features(s: Column) -> dict[str, Column]:
    """What the parts of a syllable are, by name."""
    dau, giua, cuoi, tone = (s[x] for x in ("dau", "giua", "cuoi", "tone"))
    return {
        "onset_len": F.length(dau), "nucleus_len": _mapped({k: str(v) for k, v in WIDTH.items()}, giua, F.length(giua).cast("string")).cast("int"), "coda_len": F.length(cuoi), "tone_len": F.length(tone),
        "onset_closed": ~dau.isin(*OPEN_ONSETS), "coda_closed": (F.length(cuoi) == 2) | ((F.length(cuoi) == 1) & ~cuoi.isin("c", "n")),
        "bare_onset": F.when(dau == "zd", "d").otherwise(dau), "starts_front": giua.isin("i", "y", "ia", "iez"), "has_mark": (dau == "zd") | giua.isin(*MARKED),
        "has_glide": giua.isin("uaz", "uez", "uy", "uyez", "uya", "oa", "oaw", "oe", "ooo"), "has_tone": tone != "", "is_stop": cuoi.isin(*STOPS), "tone_may_stop": tone.isin("s", "j", ""), "is_harsh": tone.isin("x", "j"),
    }


def renderings(spark: SparkSession, mode: str) -> list[str]:
    """The rendering of each id, by id: MAX_ID short strings."""
    return [r[mode] for r in syllable_dim(spark).select("syllable_id", mode).orderBy("syllable_id").collect()]


def from_dense(rows: DataFrame, column: str = "dense") -> DataFrame:
    """rows with the syllable_id of a dense rendering, null if there is none: a join with the id space."""
    dim = syllable_dim(rows.sparkSession).where("is_valid").groupBy(F.col("dense").alias(column)).agg(F.min("syllable_id").alias("syllable_id"))
    return rows.join(F.broadcast(dim), column, "left")  # at most MAX_ID rows
