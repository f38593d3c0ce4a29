"""Constants of the token and syllable model, shared by Spark code and SQL oracles."""

from __future__ import annotations

#: Letters: ASCII, and the accented ranges the segmenter takes as marked letters.
ALPHA = "A-Za-zÀ-ýĀ-Ľŀ-Žƀ-ƽ̀-̣̀-ͣẀ-ỿ"
#: Stands for the two characters backslash and n while a text is cut; a private-use code point.
ESCAPED = ""
#: Marks in a text that is cut: where, and which tokens have a separator after and before them.
CUT, AFTER, BEFORE = "\ufdd0", "\ufdd1", "\ufdd2"
SPACE = " \t "
TOKEN = f"[{SPACE}]+|\n|{ESCAPED}|[{ALPHA}]+|[^{ALPHA}{SPACE}\n{ESCAPED}]+"
BLANK, NONE_ID, MAX_ID = "#", 32767, 26250
CATEGORY_CODE = {"nonalpha": 0, "alphmark": 4, "alph0m0t": 5, "syllmark": 6, "syll0m0t": 7}
FENCE_NAMES = ("none", "right", "left", "both")

INITIALS = ["", "b", "c", "d", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "x", "ch", "zd", "gi", "kh", "ng", "nh", "ph", "qu", "th", "tr"]
NUCLEI = ["a", "e", "i", "o", "u", "y", "az", "aw", "ez", "oz", "ow", "uw", "oa", "oe", "ooo", "uy", "iez", "oaw", "uaz", "uez", "uoz", "uow", "uyez", "ah", "oah"]
FINALS = ["", "i", "u", "m", "n", "ng", "c", "p", "t"]
TONES = ["", "s", "j", "f", "r", "x"]
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
