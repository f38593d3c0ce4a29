"""Segmentation, n-grams, routing, encoding, rules, filters and jobs on small inputs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sonca import queries
from sonca.functions import hashes
from sonca.operators import cdx, filters, index, lines, ngrams, rdr, syllables, tokens, vocab, words
from sonca.plans import jobs
from sonca.sources import text as io
from sonca.streaming import counts

TEXT = "Giá       trúng    binh quân 13.011 đồng/cp, thu về hơn 1.300 voọc.\nHeirsNguyễn tránh TP.Long Xuyên sẽ 'khai tử' trạm BOT T2.\nhttps://vnexpress.net/cdc-tinh-dong-thap-dong-cua-4299620.html\n"
LINES = ["Giá trúng binh quân 13.011 đồng / cp , thu về hơn 1.300 voọc .", "HeirsNguyễn tránh TP . Long Xuyên sẽ ' khai tử ' trạm BOT T 2.", "https :// vnexpress . net / cdc - tinh - dong - thap - dong - cua -4299620. html"]
FENCES = ["333332001333321", "332013321213321", "2" + "0" * 17 + "1"]
DENSE = "^gia|s trung|s binh| quan|z 13.011 ddong|zf / cp , thu| ve|zf hon|w 1.300 vooc|j ."


def docs(spark, *texts):
    return io.from_memory(spark, list(texts))


def test_tokens(spark):
    got = tokens.line_tokens(docs(spark, TEXT)).orderBy("line_no", "pos").collect()
    for i, want in enumerate(LINES):
        assert [r["token"] for r in got if r["line_no"] == i] == want.split()
    assert tokens.tokenize(docs(spark, TEXT[:-1])).count() == 52
    cats = {"alphmark": "m", "alph0m0t": "0", "nonalpha": "n"}
    assert ["".join(cats[r["category"]] for r in got if r["line_no"] == i) for i in range(2)] == ["mm0mnmn0n0mmnmn", "mm0n0mmn0mnm00n"]
    fences = ["".join(str(r["fenced"]) for r in got if r["line_no"] == i) for i in range(3)]
    assert fences == FENCES


def test_odd_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a\\nb\\tc\\rd"), (4, "  \t"), (5, "x\ry")], "doc_id long, text string")
    got = {}
    for r in tokens.tokenize(d).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["token"])
    assert got == {1: ["\n"], 2: ["\n"], 3: ["a", "\\n", "b", "c", "d", "\n"], 4: ["\n"], 5: ["x", "\r", "y", "\n"]}


def test_long_text_is_linear(spark):
    assert tokens.tokenize(docs(spark, "từ ngữ " * 100_000)).count() == 200_001


def test_syllables_of_tokens(spark):
    rows = syllables.with_syllables(tokens.line_tokens(docs(spark, TEXT)).where("line_no = 0"))
    shown = rows.select("pos", "token", syllables.transform(*map(rows.__getitem__, ("syllable_id", "first_upper", "all_upper"))).alias("x")).orderBy("pos").collect()
    assert " ".join(r["x"] or r["token"] for r in shown) == DENSE
    v = {r["vocab"]: r["n"] for r in syllables.syllable_types(vocab.alphabet_types(tokens.tokenize(docs(spark, "Cả nhà đơi , thử nghiệm nhé , cả nhà ! TAQs")))).collect()}
    assert len(v) == 7 and v["nha|f"] == 2 and v["^ca|r"] == 1 == v["ca|r"]


GRAM_TEXT = "Cả nhà nhà nhà nhà nhà nhà nhà nhà nhà đơi thử nghiệm nhé , cả nhà ! TAQs cả nhà"


def test_grams_of_syllables(spark):
    s = ngrams.syllable_symbols(docs(spark, GRAM_TEXT))
    by = lambda n: {r["shown"]: r["n_count"] for r in ngrams.shown(ngrams.grams(s, n)).collect()}
    assert by(1) == {"nha|f": 11, "ca|r": 3, "ddoi|w": 1, "thu|wr": 1, "nghiem|zj": 1, "nhe|s": 1}
    assert by(2)["nha|f nha|f"] == 8 and by(2)["ca|r nha|f"] == 3 and len(by(2)) == 6
    assert by(3)["nha|f nha|f nha|f"] == 7 and len(by(3)) == 6
    four = by(4)
    assert four["nha|f nha|f nha|f nha|f"] == 6 and four["# ca|r nha|f nha|f"] == 1 and four["thu|wr nghiem|zj nhe|s #"] == 1 and sum(four.values()) == 13
    assert sum(by(5).values()) == 12
    assert ngrams.pruned(ngrams.grams(s, 1), least=2, distinct=3).count() == 2


def test_routes(spark):
    got = lines.route(lines.stats(docs(spark, "từ đầu đến cuối\nall in English here\n\nmột and two more"))).orderBy("line_no").collect()
    assert [r["route"] for r in got] == ["main", "no_vi", "main", "low_vi"]
    shown = syllables.rendered_lines(docs(spark, "Nước Việt\n\nxyz")).orderBy("line_no").collect()
    assert [r["line"].rstrip() for r in shown] == ["^nuoc|ws ^viet|zj", "", "xyz"]


def test_encoding_round_trip(spark):
    t = syllables.with_syllables(tokens.line_tokens(docs(spark, "tự động sửa , lỗi !")))
    row = cdx.read(cdx.write_lines(t)).first()
    assert row["ids"] == [32767, 13064, 17210, 12436, 32767, 6689, 32767]


MODEL = """True : object.conclusion = ""
\tobject.tag == "B" : object.conclusion = "B"
\t\tobject.prevWord1 == "con" and object.word == "gái" : object.conclusion = "I"
\t\t\tobject.prevTag1 == "I" : object.conclusion = "B"
\t\t\tobject.nextWord1 == "út" and object.nextTag1 == "I" : object.conclusion = "B"
\t\tobject.prevWord2 == "một" and object.nextTag2 == "N" : object.conclusion = "I"
\tobject.tag == "I" : object.conclusion = "I"
\t\tobject.word == "," : object.conclusion = "B"
"""


def test_rules(spark):
    (top,) = rdr.load(MODEL)
    ask = lambda ws, ts, i: rdr.Rules(top.exceptions).tag(rdr.window(ws.split(), list(ts), i))
    assert ask("con gái út", "BBB", 1) == "I"  # the rule
    assert ask("con gái út", "BBI", 1) == "B"  # its second exception
    assert ask("con gái", "IB", 1) == "B"  # its first exception
    assert ask("một con gà", "BBB", 2) == "I" and ask("một con gà mái ạ", "BBBBB", 2) == "B"  # beyond the end tags are N
    assert ask("a , b", "BIB", 1) == "B" and ask("a b", "NN", 1) == "N"
    rows = [(["con", "gái", "út"], ["B", "B", "I"]), ([], []), (None, None)]
    got = rdr.retag(spark.createDataFrame(rows, "syllables array<string>, tags array<string>"), top.exceptions).collect()
    assert [r["new_tags"] for r in got] == [["B", "B", "I"], [], None]
    with pytest.raises(ValueError):
        rdr.load("what is this")


def test_models_of_thousands_of_rules(spark):
    """A model as large as a trained one: every rule is found, as one by one, and by a table of positions."""
    rng = np.random.default_rng(7)
    names, word = list(rdr.NAMES), lambda: f"w{rng.integers(40)}"
    lines, flat = ['True : object.conclusion = ""'], []
    for tag in "BI":
        lines.append(f'\tobject.tag == "{tag}" : object.conclusion = "{tag}"')
        for _ in range(1500):
            when = {n: word() if "ord" in n else "NBI"[rng.integers(3)] for n in rng.choice(names[:5] + names[6:], rng.integers(1, 4), replace=False)}
            out = "BI"[rng.integers(2)]
            lines.append("\t\t" + " and ".join(f'object.{k} == "{v}"' for k, v in when.items()) + f' : object.conclusion = "{out}"')
            flat.append((tag, {rdr.NAMES[k]: v for k, v in when.items()}, out))
    (top,) = rdr.load("\n".join(lines))
    model = rdr.Rules(top.exceptions)
    for _ in range(300):
        ws, ts = [word() for _ in range(7)], ["BI"[rng.integers(2)] for _ in range(7)]
        for i in range(7):
            at = rdr.window(ws, ts, i)
            want = next((out for tag, when, out in flat if tag == ts[i] and all(at[k] == v for k, v in when.items())), ts[i])
            assert model.tag(at) == want


def test_hashes():
    assert [hashes.fnv1a32(x) for x in (b"", b"a", b"foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert [hashes.xxh32(b""), hashes.xxh32(bytes([42])), hashes.xxh32(b"", 2654435761)] == [0x02CC5D05, 0xE0FE705F, 0x36B78AE7]
    assert int(hashes.murmur64(np.array([20], np.uint64))[0]) == 11156705658460211942
    assert hashes.rotl64(43, 52) == 193654783976931328 and hashes.reduce32(1936547838, 19412321) == 8752776
    state, drawn = 13337, []
    for _ in range(3):
        state, x = hashes.splitmix64(state)
        drawn.append(x)
    assert drawn == [8862613829200693549, 1009918040199880802, 8603670078971061766]
    assert hashes.xxh32(b"Hello, world!\0") == 0x9E5E7E93 and hashes.xxh32(b"", 0x42C91977) == 0xD6BF8459
    for n in range(40):
        data = bytes(range(n))
        assert hashes.xxh32(data, 7) == xxhash.xxh32_intdigest(data, 7)
    with pytest.raises(ValueError):
        hashes.city32(bytes(13))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_fuse_filter(n, bits):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    f = filters.BinaryFuse(keys, bits)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 4 / (1 << bits) + 1e-4


def test_fuse_layout_and_repeats():
    assert [filters.layout(n)[2] for n in (0, 1, 2, 3, 10, 10**6, 2 * 10**6, 5 * 10**6)] == [3, 12, 12, 24, 48, 1130496, 2260992, 5636096]
    with pytest.raises(ValueError):
        filters.BinaryFuse(np.array([1, 1, 2], np.uint64))


def test_members(spark):
    rows, keys = spark.range(1000).withColumnRenamed("id", "key"), spark.range(0, 1000, 7).withColumnRenamed("id", "key")
    exact = {r["key"] for r in filters.members(rows, keys, exact=True).collect()}
    near = {r["key"] for r in filters.members(rows, keys).collect()}
    assert exact == set(range(0, 1000, 7)) <= near and len(near) < 160
    blocks = [r["key"] for r in filters.members(rows, keys, shard_keys=40, most_bytes=100).collect()]
    assert exact <= set(blocks) and len(blocks) == len(set(blocks)) < 160
    assert filters.members(rows, keys.limit(0)).count() == 0
    f = filters.BinaryFuse.of(x * x for x in range(500))
    assert f.n == 500 and f.contains(np.arange(500, dtype=np.uint64) ** np.uint64(2)).all()
    counts = spark.createDataFrame([([5],), ([3],), ([5],), ([9],)], "ids array<int>")
    ordered = [r["hash"] for r in filters.in_hash_order(filters.hash_counts(counts)).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 3


@pytest.mark.parametrize("most", [words.MOST, 0])
def test_words(spark, most):
    """A dictionary that is held in each task, and one that is joined."""
    s = spark.createDataFrame([(1, ["học", "sinh", "học", "sinh", "học"]), (2, ["a"]), (3, [])], "sent_id long, syllables array<string>")
    d = spark.createDataFrame([("học sinh", 100), ("sinh học", 50)], "word string, n long")
    got = {r["sent_id"]: "".join(r["tags"]) for r in words.segmented(s, d, most=most).collect()}
    assert got == {1: "BIBIB", 2: "B", 3: ""}
    assert {r["sent_id"]: "".join(r["tags"]) for r in words.greedy(s, d, most=most).collect()} == got
    want = {0: words.BEGINS, 1: words.BEGINS | words.ENDS, 2: words.BEGINS | words.ENDS, 3: words.BEGINS | words.ENDS, 4: words.ENDS}
    for found in (words.position_flags(words.lattice(s, d, most=most)), words.flagged(s, d, most=most)):
        assert {r["pos"]: r["flags"] for r in found.collect()} == want
    v = words.variants(spark.createDataFrame([("toi|z", 9), ("toi|s", 3)], "vocab string, n long"))
    pairs = spark.createDataFrame([("toi|z toi|s", 50)], "gram string, n_count long")
    out = words.restored(spark.createDataFrame([(1, ["toi|", "toi|", "x"])], "sent_id long, syllables array<string>"), v, pairs, most=most).first()
    assert out["restored"] == ["toi|z", "toi|s", "x"]


def test_longer_words_both_ways(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [f"s{x}" for x in rng.integers(4, size=rng.integers(0, 30))]) for i in range(60)]
    s = spark.createDataFrame(rows, "sent_id long, syllables array<string>")
    d = spark.createDataFrame([(" ".join(f"s{x}" for x in rng.integers(4, size=n)), int(rng.integers(1, 50))) for n in (2, 2, 2, 3, 3, 3, 4, 4, 4, 4)], "word string, n long").dropDuplicates(["word"])
    for f in (words.lattice, words.segmented, words.greedy, words.flagged):
        a, b = (sorted(map(str, f(s, d, most=most).collect())) for most in (words.MOST, 0))
        assert a == b
    rows = {r["sent_id"]: r["syllables"] for r in s.collect()}
    held = {r["word"]: r["n"] for r in d.collect()}
    for r in words.segmented(s, d).collect():  # against all ways to cut a short sentence
        w = rows[r["sent_id"]]
        if len(w) <= 10:
            cuts = lambda i: [[]] if i == len(w) else [[k, *c] for k in (1, 2, 3, 4) if i + k <= len(w) and (k == 1 or " ".join(w[i : i + k]) in held) for c in cuts(i + k)]
            def score(c):
                at, total = 0, 0.0
                for k in c:
                    total += -1.0 if k == 1 else 100.0 * (k - 1) + np.log10(held[" ".join(w[at : at + k])])
                    at += k
                return total
            best = max(map(score, cuts(0)))
            sizes = [len(x) for x in "".join(r["tags"]).replace("B", " B").split()]
            assert abs(score(sizes) - best) < 1e-9


def test_restored_paths_against_all():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(60):
        options = [[(f"x{j}", float(rng.integers(1, 4))) for j in rng.permutation(rng.integers(1, 4))] for _ in range(rng.integers(1, 6))]
        pairs = {(f"x{a}", f"x{b}"): float(rng.integers(0, 3)) for a in range(3) for b in range(3)}
        score = lambda p: sum(words.gain(n) for _, n in p) + sum(2 * words.gain(pairs[a[0], b[0]]) for a, b in itertools.pairwise(p))
        assert words.restored_path(options, pairs) == [x for x, _ in max(itertools.product(*options), key=lambda p: (score(p), [x for x, _ in p]))]
    assert words.restored_path([], {}) == []


def test_listing_is_filled_greedily(spark):
    rng = np.random.default_rng(4)
    types = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 12))) for _ in range(400)} | {"x" * 79, "y" * 78, "z" * 200, "w" * 39, "v" * 38})
    size = lambda t: len(t.encode())
    want, line, used = {}, 0, 0
    for t in sorted(types, key=lambda t: (-size(t), t)):
        if used and used + size(t) >= 80:
            line, used = line + 1, 0
        want[t] = line
        used += size(t) + 2
    got = vocab.wrapped(spark.createDataFrame([(t,) for t in types], "token string"))
    assert {r["token"]: r["line"] for r in got.collect()} == want
    assert vocab.wrapped(got.limit(0)).count() == 0


def test_smoothing(spark):
    uni = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "gram string, n_count long")
    bi = spark.createDataFrame([("a b", 2), ("a c", 1), ("b a", 1)], "gram string, n_count long")
    q = spark.createDataFrame([("a b",), ("a a",), ("c b",), ("x y",)], "gram string")
    got = {r["gram"]: r["score"] for r in ngrams.absolute_discount(q, uni, bi).collect()}
    assert got == {"a b": round(1.25 / 3 + 1.25 / 3 * 2 / 6, 9), "a a": round(1.25 / 3 * 3 / 6, 9), "c b": round(2 / 6, 9), "x y": 0.0}


def test_index(spark):
    t = tokens.tokenize(docs(spark, "a b a b", "b a"))
    p = {r["token"]: r for r in index.postings(t.where("category <> 'nonalpha'")).collect()}
    d = docs(spark, "a b, a b", "b a", "", ".")
    assert sorted(map(str, index.gathered(index.document_postings(d)).collect())) == sorted(map(str, index.postings(tokens.tokenize(d).where("category <> 'nonalpha'")).collect()))
    assert [tuple(r) for r in tokens.token_at(d, 2).orderBy("doc_id").collect()] == [(0, ",", "nonalpha", 1), (1, "\n", "nonalpha", 3)]
    assert [(d["doc_id"], d["at"]) for d in p["a"]["docs"]] == [(0, [0, 2]), (1, [1])]
    assert sorted(map(tuple, index.phrase(t, ["a", "b", "a"]).collect())) == [(0, 0)]
    assert {(r["line"], r["doc_id"], r["n"]) for r in index.first_lines(docs(spark, "x\ny", "x\nx\n")).collect()} == {("x", 0, 3), ("y", 0, 1)}


def test_jobs(spark, tmp_path):
    totals = jobs.telexify(docs(spark, TEXT, "một hai ba bốn\n"), str(tmp_path / "out"), grams=True)
    assert totals["alphmark"] > 0
    assert "1 ^gia|s" in [r["value"] for r in spark.read.text(str(tmp_path / "out" / jobs.LAYOUT["syllables"])).collect()]
    assert {r["route"] for r in spark.read.text(str(tmp_path / "out" / "out")).select("route").distinct().collect()} == {"main", "low_vi"}
    t = syllables.with_syllables(tokens.line_tokens(docs(spark, "tự động sửa lỗi\ntự động")))
    io.write_encoded(t, str(tmp_path / "cdx"))
    assert jobs.telegram(spark, str(tmp_path / "cdx"), str(tmp_path / "grams"))[1] == 5
    assert jobs.stats(spark) == {"valid": 17880, "invalid": 8370}
    assert jobs.unreadable(spark).count() == 7722
    (tmp_path / "f.txt").write_text("12 tự\nx\n3 của\n")
    assert io.frequencies(spark, str(tmp_path / "f.txt")).count() == 2


def test_streams(spark, tmp_path):
    docs(spark, "một hai một", "ba").write.parquet(str(tmp_path / "in"))
    q = counts.vocabulary(counts.documents(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("v").start()
    q.processAllAvailable()
    q.stop()
    assert {r["token"]: r["n"] for r in spark.table("v").collect()} == {"một": 2, "hai": 1, "ba": 1, "\n": 2}


def test_windowed_streams(spark, tmp_path):
    schema, place = "doc_id long, text string, at timestamp", str(tmp_path / "in")
    times = [("10:01", "một hai"), ("10:09", "một"), ("10:11", "ba")], [("13:00", "bốn")], [("10:02", "hai"), ("12:05", "năm")], [("16:00", None)]
    for i, batch in enumerate(times):
        rows = spark.createDataFrame([(i, t, f"2024-01-01 {at}:00") for at, t in batch], "doc_id long, text string, at string")
        rows.selectExpr("doc_id", "text", "cast(at as timestamp) as at").coalesce(1).write.mode("append").parquet(place)
        q = counts.windowed_vocabulary(counts.documents(spark, place, schema)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    found = spark.read.parquet(str(tmp_path / "out")).where("category <> 'nonalpha'").selectExpr("date_format(start, 'HH:mm') as start", "token", "n")
    got = {(r["start"], r["token"]): r["n"] for r in found.collect()}
    want = {("10:00", "một"): 2, ("10:00", "hai"): 1, ("10:10", "ba"): 1, ("13:00", "bốn"): 1, ("12:00", "năm"): 1}  # one document came too late
    assert got == want


def _generated(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")


def test_marked_rows_stand_once(spark):
    keys, rows = spark.range(0, 400, 2).toDF("key"), spark.range(500).toDF("key")
    for k in ({}, {"shard_keys": 40, "most_bytes": 100}):
        got = {r["key"]: r["near"] for r in filters.marked(rows, keys, "near", **k).collect()}
        assert len(got) == 500 and all(got[i] for i in range(0, 400, 2)) and sum(got.values()) < 220


def test_fuse_counts_once(spark):
    s = ngrams.symbols(docs(spark, "a b c d. " * 6 + "b c d e f a b x"))
    out = queries._fuse(s)
    assert _generated(out) <= 2  # pairs and trigrams are counted once each, besides the pairs of the filter
    assert out.first().asDict() == {"n_exact": 4, "n_missed": 0, "few_more": True}


@pytest.mark.parametrize("most", [0, 3, 7])
def test_rarer_words_are_joined(spark, most):
    """The most frequent words are held, the others are looked up by a join of what a filter lets through."""
    rng = np.random.default_rng(7)
    s = spark.createDataFrame([(i, [f"ữ{x}" for x in rng.integers(6, size=rng.integers(0, 40))]) for i in range(80)] + [(99, None)], "sent_id long, syllables array<string>")
    d = spark.createDataFrame([(" ".join(f"ữ{x}" for x in rng.integers(6, size=n)), int(rng.integers(1, 500))) for n in (1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5)] + [("never seen", 9)], "word string, n long").dropDuplicates(["word"])
    for f in (words.lattice, words.segmented, words.greedy, words.flagged):
        a, b = (sorted(map(str, f(s, d, most=m).collect())) for m in (words.MOST, most))
        assert a == b
    top, rest = words.held(d, most)
    assert len(top.value.words) <= most and rest.count() + len(top.value.words) == d.where("size(split(word, ' ')) between 2 and 4").count()
    passed = words.candidates(s, "sent_id", "syllables", 4, words._filter_of(rest)).select("gram").distinct()
    every = words.candidates(s, "sent_id", "syllables", 4, None)
    found = passed.join(rest.select("word"), passed["gram"] == rest["word"]).count()
    assert found == every.select("gram").distinct().join(rest.select("word"), F.col("gram") == F.col("word")).count()
    assert passed.count() <= found + 0.05 * every.select("gram").distinct().count() + 3


@pytest.mark.parametrize("most", [0, 4])
def test_restored_by_rarer_pairs(spark, most):
    """Options that are held, and pairs of which some or all are joined."""
    rng = np.random.default_rng(11)
    s = spark.createDataFrame([(i, [f"w{x}" for x in rng.integers(6, size=rng.integers(0, 12))]) for i in range(60)], "sent_id long, syllables array<string>")
    forms = {f"w{x}": [f"w{x}", f"ẃ{x}", f"ŵ{x}"][: 1 + x % 3] for x in range(5)}
    o = spark.createDataFrame([(b, [(int(rng.integers(1, 9)), v) for v in vs]) for b, vs in forms.items()], "bare string, variants array<struct<n:long,vocab:string>>")
    every = [v for vs in forms.values() for v in vs] + ["w5"]
    pairs = spark.createDataFrame([(f"{a} {b}", int(rng.integers(1, 40))) for a in every for b in every if rng.random() < 0.4], "gram string, n_count long")
    want = sorted(map(str, words.restored(s, o, pairs).collect()))
    got = words.restored(s, o, pairs, most=most, most_options=100)
    assert sorted(map(str, got.collect())) == want
    assert "variants" not in got._jdf.queryExecution().optimizedPlan().toString()  # options are not joined


def test_backoff_joins_twice(spark):
    s = ngrams.symbols(docs(spark, "a b a b c. a b c b a! d c b. e a", "c b a d d d"))
    uni, bi, tri = (ngrams.grams(s, n) for n in (1, 2, 3))
    asked = tri.select("gram").union(queries._turned(tri)).distinct()
    got = queries._backoff(s)
    assert sorted(map(str, got.collect())) == sorted(map(str, ngrams.backoff_score(asked, uni, bi, tri).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_batches_are_sliced(spark):
    import pyarrow as pa

    rows = [["a"] * n for n in (3, 0, 9, 1, 30, 2, 2)] + [None, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(rows, pa.list_(pa.string()))], names=["i", "p"])
    got = list(syllables.sliced(batch, 5))
    assert [r for b in got for r in b.column(0).to_pylist()] == list(range(9)) and [r for b in got for r in b.column(1).to_pylist()] == rows
    assert len(got) > 3 and all(b.num_rows == 1 or sum(len(r or ()) for r in b.column(1).to_pylist()[:-1]) <= 10 for b in got)
    assert list(syllables.sliced(batch.slice(0, 0))) == []
    assert sum(b.num_rows for b in syllables.sliced(batch.slice(3, 4), 5)) == 4
