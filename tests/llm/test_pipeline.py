"""The pipeline on the smallest tables: each stage's decisions take effect and clean documents stay."""

import itertools
import os
import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from sonca.llm import queries, token_counts
from sonca.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left = docs.count()
        assert left <= n and (name != "substring_dedup" or left == n)
        n = left
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def tables(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_rows_by_brute_force(spark, tmp_path):
    """All stages with nothing for the classifier to learn: what is left is found one row at a time."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    item, passage = text(20), text(60)
    base = [text(rng.randint(60, 150)) for _ in range(12)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    docs += [(20, docs[3][1]), (21, " ".join([*base[4][:-1], "changed"])), (22, docs[5][1])]  # copies and near copies
    docs += [(30, " ".join(text(40) + passage + text(40))), (31, " ".join(text(70) + passage)), (32, " ".join(passage))]
    docs += [(40, " ".join(text(50) + item + text(50))), (41, " ".join(text(30) + item[:9] + ["edit"] + item[10:])), (42, " ".join(item[:12]))]
    docs += [(50, None), (51, ""), (52, " \n "), (53, "word"), (None, " ".join(text(30))), (6, docs[6][1])]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in docs]
    folder = tables(spark, tmp_path / "in", rows, [], [(1, " ".join(item)), (2, None)])
    packed = cp.run(spark, folder).collect()

    kept = [(k, t) for k, t in docs if (t or "").split()]  # stage 1: without labels, all rows with words
    kept = [(k, t) for k, t in kept if k not in (20, 21, 22)]  # stage 2: the smallest key of each group
    seen, left = set(), []  # stage 3: windows of 50 words; repeated rows are one document
    for k, t in sorted(set(kept), key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = t.split()
        gone = set()
        for i in range(len(ws) - cp.PASSAGE + 1):
            w = tuple(ws[i : i + cp.PASSAGE])
            gone |= set(range(i, i + cp.PASSAGE)) if w in seen else set()
            seen.add(w)
        left += [(k, " ".join(w for i, w in enumerate(ws) if i not in gone))] * kept.count((k, t))
    left = [(k, t) for k, t in left if k not in (40, 41)]  # stage 4
    tok = token_counts.tokenizer(queries.vocabulary(queries.PACKING))
    want = Counter()
    for k, t in left:  # stage 5
        # white space after what is cut goes with it, and what stood before stays
        ids = tok.encode(t, add_special_tokens=False).ids
        want[k, len(ids) + 1] += 1
    got = Counter((r["doc_id"], r["length"]) for r in packed)
    cut = {31, 32}  # their white space at the edges of a cut may be one token more
    assert Counter(x for x in got.elements() if x[0] not in cut) == Counter(x for x in want.elements() if x[0] not in cut)
    assert {k for k, _ in got} == {k for k, _ in want}
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in used.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(x)) and sum(n for _, n in x) <= 4096


def test_no_rows(spark, tmp_path):
    folder = tables(spark, tmp_path / "in", [], [], [])
    assert cp.run(spark, folder).count() == 0
