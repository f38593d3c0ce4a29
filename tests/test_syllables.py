"""Phonology: what is accepted, ids, renderings."""

import random

import pytest

from sonca.functions import ids
from sonca.functions.syllable import _parse, can_be_vietnamese, parse, syllable_id
from sonca.functions.telex import Stream, letters
from pyspark.sql import functions as F

LOOSE = "huơ quýt quýu nghộ Soọc Gioăng iệp BÙI que nghe binh muoons cuoocj nguyeen cuar huyeets boong nieemf ieemf yeeu tyeeu iar chos ox gioocs gieets o TƯ VỚI sưòn suờn tuơm tiem tiém tuyen cưă"
NEVER = "quyậts CÉCI quyật GII Lyn hoon cawtx nguyee huyeet ieef yee iamr 1triệu GX OOÒO n nnnn iê yê niê tyê vuong chuong tuoij"
STRICT = "gì A Quấc quạu quọ iến iếc miéng Nguyen nghieng khuều ngoẩy ðạo Ðạo ách ích ếch oách uỵch uệch huyu queng quăn uở hươ KHUƠ"
NOT_STRICT = "tuon khuắng íc ếc uỵc uệc ấch ých éch óch oau chuan coa coen coăn quyeu quuyen quyng cuyen huiu quung quước quoẹt chuẩnh quyểng quyểnh"


@pytest.mark.parametrize("word", LOOSE.split())
def test_accepted_loosely(word):
    assert can_be_vietnamese(word)


@pytest.mark.parametrize("word", [*NEVER.split(), ""])
def test_never_accepted(word):
    assert not can_be_vietnamese(word)


def test_strict_mode():
    assert [w for w in STRICT.split() if not parse(w)] == []
    assert [w for w in NOT_STRICT.split() if parse(w)] == []


def test_decomposed_spellings():
    assert parse("mất").syllable == ("m", "az", "t", "s")
    assert parse("ắn").syllable == ("", "aw", "n", "s")


def test_letters_are_those_of_vietnamese():
    assert len([c for c in letters() if ord(c) > 127]) == 136
    s = Stream()
    assert all(map(s.push, "TAQ")) and s.text == "taq" and s.all_upper
    s = Stream()
    assert s.push("ư") and s.push("o") and s.text == "uow"
    assert s.push("á") and not s.push("à")  # a second tone


RENDERED = [("ịa", "dense", "ia|j"), ("tía", "dense", "tia|s"), ("mịa", "utf8", "mịa"), ("yêu", "utf8", "yêu"), ("thuở", "utf8", "thủa"), ("tuơ", "dense", "tua|"), ("ngoẩy", "dense", "nguay|zr"), ("toong", "dense", "toong|"), ("thoọng", "dense", "thoong|j"), ("đoong", "dense", "ddoong|"), ("voọc", "dense", "vooc|j")]
RENDERED_LOOSE = [("tieu", "dense", "tieu|z"), ("tuyenr", "dense", "tuyen|zr"), ("tuej", "dense", "tue|zj"), ("BÔI", "dense", "boi|z"), ("CHUẨN", "dense", "chuan|zr"), ("nghuyen", "utf8", "nguyên")]


def test_renderings(spark):
    rows = [(form, want, syllable_id(parse(w, strict).syllable)) for rs, strict in ((RENDERED, True), (RENDERED_LOOSE, False)) for w, form, want in rs]
    dim = {r["syllable_id"]: r for r in ids.syllable_dim(spark).collect()}
    assert [(form, dim[i][form]) for form, _, i in rows] == [(form, want) for form, want, _ in rows]
    assert [dim[i]["utf8"] for i in (13064, 17210, 12436, 6689, 22090, 270, 19308, 21291, 21327)] == "tự động sửa lỗi phát âm không nhập nhằng".split()


def test_parts_of_a_struct(spark):
    cases = [("ng", "uaw", "", "s", "ngua|ws", "ngứa", "ng_uaw_s"), ("ng", "o", "", "s", "ngo|s", "ngó", "ng_o_s"), ("ng", "iez", "n", "s", "nghien|zs", "nghiến", "ng_yez|n_s"), ("ng", "oz", "n", "", "ngon|z", "ngôn", "ng_oz|n_"), ("", "a", "", "", "a|", "a", "a_")]
    df = spark.createDataFrame([(c[:4], *c[4:]) for c in cases], "s struct<dau:string,giua:string,cuoi:string,tone:string>, d string, u string, p string")
    got = df.select(ids.dense(F.col("s")), ids.utf8(F.col("s")), ids.parts(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]


def test_id_space(spark):
    dim = ids.syllable_dim(spark)
    assert dim.where("is_valid").count() == 17880
    valid = dim.where("is_valid").collect()
    back = {r["syllable_id"]: syllable_id(parse(r["utf8"]).syllable) for r in valid}
    assert sum(a != b for a, b in back.items()) == 30  # gi + ez and gi + iez are written alike
    again = dim.select("syllable_id", ids.from_base64(ids.to_base64(F.col("syllable_id"))).alias("x"))
    assert again.where("x <> syllable_id").count() == 0
    assert ids.from_dense(spark.createDataFrame([("nuoc|ws",), ("??",)], "dense string")).where("syllable_id is not null").count() == 1


def test_nothing_that_parses_is_turned_away():
    rng = random.Random(1)
    onsets = ["", *"b c d đ g h k l m n p q r s t v x ch gh gi kh ng ngh nh ph qu th tr dd w z f j".split()]
    marked = [c for c in letters()]
    for i in range(200_000):
        middle = "".join(rng.choices("aeiouywz" if i % 2 else marked, k=rng.randint(0, 4)))
        word = rng.choice(onsets) + middle + "".join(rng.choices(["", *"iumnpcty", "ng", "nh", "ch"], k=rng.randint(0, 2))) + rng.choice(["", "", *"sfrxjw", chr(0x301), chr(0x302)])
        for strict in (True, False):
            assert parse(word, strict) == (_parse(word, strict) if word else None), word
