"""Steps over texts in Arrow batches, against the column pipeline and brute force."""

import random
from collections import Counter

import numpy as np

from sonca import queries
from sonca.operators import lines, tokens, typed, vocab, windows
from sonca.schemas import BLANK

ODD = ["", None, "\n", "\n\n a", "a\\nb \\n\\n c\\r\\td", "Cả nhà đơi ,  x\t", "x" * 300 + " é", "é" * 11 + " " + "é" * 10 + "!", "a-b--c  ..\n.. \\n", "\\", "1 2\n3 á\r\nb "]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def planned(found):
    return found._jdf.queryExecution().optimizedPlan().toString()


def test_line_figures(spark):
    d = table(spark, ODD)
    found = lines.stats(d)
    assert "MapInArrow" in planned(found) and "lambdafunction" not in planned(found)
    per = tokens.line_tokens(d).collect()
    got = {(r["doc_id"], r["line_no"]): (r["line_bytes"], r["vi_bytes"], r["n_tokens"]) for r in found.collect()}
    assert len(got) == sum((t or "").count("\n") + 1 for t in ODD)
    want = {k: (0, 0, 0) for k in got}
    for r in per:
        size, k = len(r["token"].encode()), (r["doc_id"], r["line_no"])
        if size <= 255:
            a, b, n = want[k]
            after = r["fenced"] % 2
            want[k] = a + size + after, b + (size + 1 if r["category"] == "alphmark" and size <= 20 else 0), n + 1
    assert got == want


def test_types(spark):
    d = table(spark, ODD)
    found = vocab.types_of(d)
    assert "MapInArrow" in planned(found) and "explode" not in planned(found)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in vocab.types(tokens.tokenize(d)).collect()}


def with_counts_by_hand(spark, d):
    rows = [tuple(r) for r in tokens.tokenize(d).where("category <> 'nonalpha'").select("doc_id", "pos", "token").collect()]
    n = Counter(r[2] for r in rows)
    return Counter((*r, n[r[2]]) for r in rows)


def test_words_with_counts(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["the", "của", "a1", "x\n", "w" + "x" * rng.randrange(300)]) for _ in range(rng.choice([1, 30, 400]))) for _ in range(60)]
    d = table(spark, texts + ["the " * 5000, "... 1 2"]).repartition(5)
    want = with_counts_by_hand(spark, d)
    for most in (1, 50, typed.WORDS):
        found = typed.with_counts(d, most=most)
        assert Counter(map(tuple, found.collect())) == want and dict(found.dtypes) == {"doc_id": "bigint", "pos": "int", "token": "string", "n": "bigint"}
    assert typed.with_counts(d.limit(0)).count() == 0 == typed.with_counts(table(spark, ["", None, " .\n"])).count()
    twice = d.selectExpr("if(doc_id % 3 = 0, null, cast(doc_id % 7 as string)) as doc_id", "text")
    assert Counter(map(tuple, typed.with_counts(twice).collect())) == with_counts_by_hand(spark, twice)


def test_type_join_reads_texts_once_and_shuffles_no_words(spark, tmp_path):
    table(spark, ["the " * 1000 + "w" + "x" * i for i in range(40)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["token_type_join"](spark, str(tmp_path))
    plan = planned(found)
    assert plan.count("Relation") == 1 and "Join" not in plan and "explode" not in plan
    assert {tuple(r) for r in found.groupBy("n").count().collect()} == {(40000, 40000), (1, 40)}


def test_windows(spark):
    rng = random.Random(3)
    lists = [[rng.choice("a b c d #".split()) for _ in range(rng.choice([0, 1, 5, 60]))] for _ in range(60)] + [["a"] * 400] * 3
    rows = spark.createDataFrame([(x,) for x in lists], "s array<string>").repartition(5)
    for lengths, rule in ((range(1, 9), windows.plain), (range(1, 5), windows.blanks), ((6, 7, 8), windows.plain)):
        want = Counter()
        for x in lists:
            words = np.array([c != BLANK for c in x] + [False] * 9)
            for n in lengths:
                good = rule(n, lambda i: words[i : i + len(x)])  # noqa: B023
                want.update((n, " ".join(x[i : i + n])) for i in range(len(x) - n + 1) if good[i])
        found = windows.counted(rows, lengths, rule)
        assert "Aggregate" not in planned(found)
        assert Counter({(r["n"], r["gram"]): r["n_count"] for r in found.collect()}) == want and found.count() == len(want)
        sizes = Counter()
        for r in windows.counted(rows, lengths, rule, sizes=True).collect():
            sizes[r["n"], r["n_count"]] += r["n_grams"]
        assert sizes == Counter((n, c) for (n, _), c in want.items())


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(windows, "_mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    columns = [np.array([1, 2, 1, 1 << 40]), np.array([5, 5, 5, 1 << 40])]
    at, count = windows.distinct(columns)
    assert sorted(zip(columns[0][at].tolist(), count.tolist())) == [(1, 2), (2, 1), (1 << 40, 1)]
    assert sorted(windows.distinct(columns, np.array([3, 4, 5, 6]))[1].tolist()) == [4, 6, 8]
