"""The training-data operators against brute force, round trips and held-out rows, on small inputs."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sonca.llm import decontamination, flac, html_extract, langid, minhash, packing, quality, queries, substring_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, bucket long"


def words(rng, n):
    return [rng.choice("the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()) + rng.choice(["", "a", "er", "est", "ing"]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeats, copies, near copies, shared passages."""
    rng = random.Random(5)
    texts = [None, "", "   ", "one", "one two three", " ".join(words(rng, 30_000))]
    base = [words(rng, rng.randint(20, 200)) for _ in range(30)]
    passage = words(rng, 60)
    for b in base:
        texts += [" ".join(b), " ".join(b), " ".join([*b[:9], "changed", *b[10:]]), " ".join(b[: len(b) // 2] + passage)]
    out = [(i, t, rng.choice(["en", "fr", None]), None, None, "x", 7) for i, t in enumerate(texts)]
    return [*out, out[7], (None, " ".join(base[0]), None, None, None, "y", 8)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randint(8, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "two words"), (0, None)]
    texts = []
    for i, t in items[:20]:
        ws = t.split()
        edited = list(ws)
        for _ in range(decontamination.allowed(len(ws)) // 2):
            edited[rng.randrange(len(edited))] = "edit"
        texts += [" ".join([*words(rng, 50), *ws, *words(rng, 50)]), " ".join([*words(rng, 30), *edited]), " ".join(words(rng, 80))]
    texts += [None, "", "say two words here"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        x = decontamination.words_of(t)
        number = {w: j for j, w in enumerate(dict.fromkeys(x))}
        for i, item in items:
            ws = decontamination.words_of(item)
            if ws and x:
                best, _ = decontamination.best_substring(np.array([number.get(w, -1 - j) for j, w in enumerate(ws)]), np.array([number[w] for w in x]))
                if best <= decontamination.allowed(len(ws)):
                    want.add((d, i))
    found = decontamination.leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want) and {(3 * i, i) for i in range(20)} <= got
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench, block_bytes=500).collect()} == got
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("short", [7, 13, 19, 26, 33])
def test_count_filter_loses_no_match_beside_a_shorter_item(short):
    n = short + 1
    item = [f"w{i}" for i in range(n)]
    block = decontamination.Items([(1, " ".join(f"s{i}" for i in range(short))), (2, " ".join(item))])
    d = decontamination.allowed(n)
    assert d > decontamination.allowed(short)
    edited = list(item)
    for i in range(d):
        edited[2 * i + 2] = "edit"  # edits apart from each other and from the ends: each costs two pairs
    x = np.array([block.of(w, 0) for w in ["before", *edited, "after"]], np.int64)
    assert n in [m for m, starts in block._windows(x) if 1 in starts]
    if n < 20:  # so short that the walks find it too
        assert (2, d, n, 1) in block.matches("before " + " ".join(edited) + " after")


def test_recall_at_all_the_edits_allowed():
    rng, found, planted = random.Random(11), Counter(), Counter()
    tried = {8: 100, 14: 100, 20: 100, 40: 100, 60: 100, 100: 60, 150: 40, 300: 20}
    for n, most in tried.items():
        d = decontamination.allowed(n)
        while planted[n] < most:
            item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            x = list(item)
            for _ in range(d):
                i, kind = rng.randrange(len(x)), rng.randrange(3)
                x[i : i + (kind > 0)] = ["edit"] * (kind < 2)
            text = [*words(rng, rng.randrange(30)), *x, *words(rng, rng.randrange(30))]
            block = decontamination.Items([(1, " ".join(item))])
            symbols = np.array([block.of(w, 0) for w in text], np.int64)
            if decontamination.best_substring(block.items[0][1], symbols)[0] == d:
                planted[n] += 1
                found[n] += [(k, e, m) for k, e, m, _ in block.matches(" ".join(text))] == [(1, d, n)]
    print(dict(found))
    assert sum(found.values()) >= 0.99 * sum(planted.values()) and all(found[n] >= 0.95 * tried[n] for n in tried), found


@pytest.mark.parametrize("n", [513, 3000])
def test_long_items_are_found_by_their_pieces(n):
    rng = random.Random(n)
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    x, d = list(item), decontamination.allowed(n)
    for _ in range(d):
        i, kind = rng.randrange(len(x)), rng.randrange(3)
        x[i : i + (kind > 0)] = ["edit"] * (kind < 2)
    block = decontamination.Items([(1, " ".join(item)), (2, " ".join(item[: n // 2] + ["other"] * n))])
    text = ["a"] * 700 + x + ["b"] * 700
    symbols = np.array([block.of(w, 0) for w in text], np.int64)
    least, start = decontamination.best_substring(block.items[0][1], symbols)
    assert block.matches(" ".join(text)) == [(1, least, n, start)] and least <= d


def test_texts_of_one_word():
    block = decontamination.Items([(1, "word " * 20), (2, "word " * 300 + "end"), (3, "word " * 5000), (4, "word other " * 10)])
    assert block.matches("word " * 20000) == [(1, 0, 20, 0), (2, 1, 301, 0), (3, 0, 5000, 0)]


def test_distances_by_bit_vectors():
    rng = random.Random(6)

    def distance(p, q):
        row = list(range(len(q) + 1))
        for i, u in enumerate(p):
            before, row[0] = row[0], i + 1
            for j, w in enumerate(q):
                before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (u != w))
        return row[-1]

    for _ in range(300):
        item, text = ([rng.randrange(a, 4) for _ in range(rng.randrange(a, 9))] for a in (1, 0))
        least, _, start = min((distance(item, text[i:j]), j, i) for j in range(len(text) + 1) for i in range(j + 1))
        got = decontamination.best_substring(np.array(item), np.array(text, np.int64))
        assert got == (least, start if least < len(item) else 0), (item, text)


def test_walks_are_the_same_for_the_same_strings():
    a = decontamination.Items([(1, "a b c d e f g h i j k l m n")])
    assert a.matches("x y a b c d e f g h i j k l m n z") == [(1, 0, 14, 2)]
    assert a.matches(None) == a.matches("") == []


def test_html():
    page = "<html><head><title>no</title></head><body><nav class=menu><a href=/>Home</a> <a href=/x>About</a></nav><div class='cookie-banner'>We use cookies</div><article><h1>Caf&eacute; news</h1><p>A first   sentence, with <b>bold</b>\nwords and more of them.</p><script>var x='<p>no</p>'</script><p>A second paragraph, long enough to be read as text.</p></article><footer>&copy; 2024 someone</footer></body></html>"
    got = html_extract.extract([page, None, "", "<p>unclosed &amp; fine text, as it stands, is read as it is.", "plain"], html_extract.model())
    assert got[0] == "Café news\n\nA first sentence, with bold words and more of them.\n\nA second paragraph, long enough to be read as text."
    assert got[1] == got[2] == ""
    p = html_extract.Page(page)
    kept = html_extract.decode(p, np.random.default_rng(1).normal(size=len(p.tags)))
    assert all(kept[p.parents[i]] for i in range(1, len(p.tags)) if kept[i])


@pytest.mark.parametrize("name", ["select", "svg", "math", "canvas", "object", "audio", "video", "head", "button", "template", "noscript"])
def test_html_after_an_element_without_end(name):
    page = f"<html><body><article><p>A first sentence, long enough to be read as text.</p><{name}><p>All that follows, long enough to be read as well.</p></article></body></html>"
    assert "All that follows, long enough to be read as well." in " ".join(t for _, t, _ in html_extract.Page(page).blocks)


def test_html_takes_time_in_proportion():
    def took(n):
        page = "<body><article><p>Text.</p>" + "<button>x</button><button><svg><body>" * n
        began = time.process_time()
        html_extract.Page(page)
        return time.process_time() - began

    took(100)
    assert min(took(16_000) for _ in range(3)) < 10 * min(took(4_000) for _ in range(3)) + 0.05


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"])
def test_html_after_raw_text_without_end(name):
    page = f"<body><p>Before.</p><{name}><p>Within.</p></body>"
    assert [t for _, t, _ in html_extract.Page(page).blocks] == ["Before."]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_html_of_pages(spark):
    got = queries.op2(spark, SF).toPandas().set_index("page_id")
    html = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id").html
    assert len(got) == len(html)
    for k, h in html.items():
        assert "&copy;" not in got.text[k] and "cookie" not in got.text[k].lower()
        if m := re.search(r"<article>(.*?)</article>", h, re.S):
            for p in re.findall(r"<p>([^<>&]{30,})</p>", m[1]):
                assert " ".join(p.split()) in got.text[k]


def test_html_of_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing columns, a very long page, elements that never end; no pages at all."""
    p = "<p>A paragraph that is long enough to be read as a part of the text, number %d.</p>"
    long = "<html><body><article>" + "".join(p % i for i in range(20_000)) + "</article></body></html>"
    open_ = "<html><body><article>" + p % 1 + "<button>" * 20_000 + p % 2 + "</article></body></html>"
    rows = [(1, "u", long, "x", 5), (2, None, None, "y", 6), (3, "", "", None, None), (None, "n", "<body><article>" + p % 7 + "</article>", "z", 1), (1, "u", long, "x", 5), (4, "o", open_, "t", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.main_text(pages).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter(r[:2] for r in rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"].count("number") == 20_000 and by[1]["text"].endswith("number 19999.")
    assert by[2]["text"] == by[3]["text"] == "" and by[2]["n_chars"] == 0
    assert by[None]["text"] == "A paragraph that is long enough to be read as a part of the text, number 7."
    assert "number 2" in by[4]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality.selected(docs, labels).collect()}
    truth = labels.toPandas().groupby("doc_id").agg({"quality": "min", "toxic": "max"})
    good = truth[(truth.quality == 1) & (truth.toxic == 0)].index
    bad = truth[truth.quality == 0].index
    assert np.mean([k in kept for k in good]) > 0.95 and np.mean([k in kept for k in bad]) < 0.1


def test_quality_of_odd_rows(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.selected(docs, none)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows if (r[1] or "").strip())
    some = spark.createDataFrame([(7, 1, 0), (7, 1, None), (8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, some).count() == len(rows)
    assert quality.selected(docs.limit(0), some).count() == 0


@pytest.mark.parametrize("share", [None, 0.3])
@pytest.mark.parametrize("langs", [31, 1])
def test_quality_against_brute_force(spark, share, langs, monkeypatch):
    """Counts, ratios, weights, Gumbel keys and the k largest, one row at a time; labels that repeat or lack something."""
    monkeypatch.setattr(quality.fit, "__defaults__", (*quality.fit.__defaults__[:-1], langs))
    rng = random.Random(12)
    docs = [(i, " ".join(words(rng, rng.randint(1, 60)) + ["!!"] * (i % 3)), rng.choice(["en", "fr", "xx", None])) for i in range(150)]
    docs += [(200, None, "en"), (201, "", "en"), (202, " \n", None), (203, "!?", "fr"), (None, "no key here", "en"), docs[5], docs[5]]
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 140, 2)] + [(6, 1, 1), (6, 1, None), (12, None, 0), (None, 1, 0), (999, 1, 0)]
    judged = {}
    for k, q, t in labels:
        if k is not None:
            judged.setdefault(k, []).append((q, t or 0))
    good = {k: min(q for q, _ in x if q is not None) == 1 and max(t for _, t in x) == 0 for k, x in judged.items() if any(q is not None for q, _ in x)}
    size = Counter(g for _, _, g in docs if g is not None)
    own = {g: g for g in sorted(size, key=lambda g: (-size[g], g))[:langs]}
    raw, target = {}, {}
    for k, t, g in docs:
        for counts in [raw] + [target] * bool(good.get(k)):
            counts.setdefault(own.get(g), Counter()).update(quality.features(t or "").tolist())
    ratio = {}
    for b in {b for c in raw.values() for b in c}:
        expected = sum(c[b] * sum(target.get(g, Counter()).values()) / sum(c.values()) for g, c in raw.items() if c)
        x = math.log((sum(c[b] for c in target.values()) + quality.PRIOR) / (expected + quality.PRIOR))
        ratio[b] = x if abs(x) >= quality.NOISE else 0.0
    keys = []
    for k, t, _ in docs:
        f = quality.features(t or "").tolist()
        weight = sum(ratio[b] for b in f) / len(f) if f else None
        u = quality_hash(k, t)
        keys.append((weight, None if weight is None else quality.LENGTH * weight - math.log(-math.log(((u >> 11) + 0.5) / (1 << 53)))))
    n = sum(x is not None for _, x in keys)
    least = sorted((x for _, x in keys if x is not None), reverse=True)[round((sum(good.values()) / len(good) if share is None else share) * n) - 1]
    want = Counter((k, None if w is None else round(w, 4), x is not None and x >= least - 1e-3) for (k, _, _), (w, x) in zip(docs, keys, strict=True))
    d, some = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, some, share=share).collect()
    assert Counter((r["doc_id"], None if r["weight"] is None else round(r["weight"], 4), r["kept"]) for r in got) == want


def quality_hash(k, t):
    """xxhash64 over the key, the text and the salt, each with the hash before as its seed; nulls are passed over."""
    h = 42
    for x in (None if k is None else k.to_bytes(8, "little", signed=True), None if t is None else t.encode(), quality.SALT.to_bytes(4, "little")):
        h = h if x is None else xxhash.xxh64_intdigest(x, h)
    return h


def test_kth_largest(spark):
    values = [5, -3, 5, 1 << 60, -(1 << 62), 0, 7]
    df = spark.createDataFrame([(v,) for v in values], "rank long")
    assert [quality.kth_largest(df, k) for k in range(1, 8)] == sorted(values, reverse=True)


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 15])
def test_token_counts_spliced(chunk):
    tok, rng = token_counts.tokenizer(queries.vocabulary(queries.COUNTING)), random.Random(1)
    texts = ["", " ", "a" * 3000, "x  \n\n y\t" * 500, "don't I'll 12345 <|endoftext|> ünïcödé 漢字 " * 200, "".join(rng.choice("ab \n'1é.") for _ in range(20_000)), "\n" * 999]
    assert token_counts.count_all(tok, texts, chunk) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts(spark, docs, rows):
    got = token_counts.token_counts(docs, queries.vocabulary(queries.COUNTING))
    assert got.count() == len(rows)
    assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.where("doc_id < 2").collect()} == {(0, 0, False)}
    assert token_counts.token_counts(docs.limit(0), queries.vocabulary(queries.COUNTING)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_flac_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (64, 128, 4096, 4160, 20_032):
        x = [rng.integers(0, 256, n), np.zeros(n), np.cumsum(rng.integers(-2, 3, n)) % 256, rng.integers(60, 70, n)][seed % 4].astype(np.uint8).tobytes()
        stored = flac.encode(x, partitions=seed % 3)
        assert flac.decode(stored) == x
        blocks = list(flac.Reader(stored).blocks(n // 2))
        assert blocks[0][0] <= n // 2 and (np.concatenate([b for _, b in blocks]) + 128).astype(np.uint8).tobytes() == x[blocks[0][0] :]
        broken = bytearray(stored)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            flac.decode(bytes(broken))


def flac_bits(value, size):
    return [(value >> i) & 1 for i in range(size - 1, -1, -1)]


def rice_bits(r, k):
    u = 2 * r if r >= 0 else -2 * r - 1
    return [0] * (u >> k) + [1] + flac_bits(u & ((1 << k) - 1), k)


def hand_made(x, taps, shift, precision, wide, plan):
    """The bits of a subframe with a general predictor; plan: for each partition a Rice parameter, or an escape's width."""
    order, out = len(taps), []
    out += flac_bits((31 + len(taps)) << 1, 8)
    for v in x[:order]:
        out += flac_bits(v & 255, 8)
    out += flac_bits(precision - 1, 4) + flac_bits(shift & 31, 5)
    for c in taps:
        out += flac_bits(c & ((1 << precision) - 1), precision)
    out += flac_bits(wide - 4, 2) + flac_bits(len(plan).bit_length() - 1, 4)
    residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(taps)) >> shift) for i in range(order, len(x))]
    at, size = 0, len(x) // len(plan)
    for p, (kind, k) in enumerate(plan):
        part = residual[at : at + size - (order if p == 0 else 0)]
        at += len(part)
        if kind == "rice":
            out += flac_bits(k, wide)
            for r in part:
                out += rice_bits(r, k)
        else:
            out += [1] * wide + flac_bits(k, 5)
            for r in part:
                out += flac_bits(r & ((1 << k) - 1), k)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_flac_streams_made_by_hand(seed):
    """General predictors, escaped partitions and five-bit Rice parameters, which the writer never makes."""
    rng = np.random.default_rng(seed)
    order, n, precision, shift = int(rng.integers(1, 9)), 64 * int(rng.integers(1, 5)), int(rng.integers(3, 13)), int(rng.integers(0, 8))
    x = (np.cumsum(rng.integers(-3, 4, n)) % 200 - 100).tolist()
    taps = rng.integers(-(1 << (precision - 1)), 1 << (precision - 1), order).tolist()
    wide, parts = (4, 5)[seed % 2], 1 << int(rng.integers(0, 3))
    plan = [("rice", int(rng.integers(4, 15 if wide == 4 else 25))) if rng.random() < 0.6 else ("escape", 24) for _ in range(parts)]
    bits = hand_made(x, taps, shift, precision, wide, plan)
    body = np.packbits(np.array(bits, np.uint8)).tobytes()
    got, used = flac._subframe(body + b"rest", n)
    assert got.tolist() == x and used == len(body)
    samples = np.array(x, np.int8).tobytes()
    head = b"\xff\xf8\x70\x02" + b"\x00" + (n - 1).to_bytes(2, "big")
    frame = head + bytes([flac.crc8(head)]) + body
    frame += flac.crc16(frame).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + len(frame).to_bytes(3, "big") * 2 + ((8000 << 44) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(samples).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode(stream) == bytes((v + 128) for v in x)
    with pytest.raises(ValueError):
        flac.decode(stream[:-1] + bytes([stream[-1] ^ 1]))


def test_flac_codings_that_are_reserved():
    for bits in ([*flac_bits(63 << 1, 8)] + [0] * 400, flac_bits(8 << 1, 8) + flac_bits(2, 2) + [0] * 400, flac_bits(32 << 1, 8) + flac_bits(0, 8) + [1] * 4 + [0] * 400, flac_bits(32 << 1, 8) + flac_bits(0, 8) + flac_bits(3, 4) + flac_bits(31, 5) + [0] * 400):
        with pytest.raises((ValueError, IndexError)):
            flac._subframe(np.packbits(np.array(bits, np.uint8)).tobytes(), 64)


def test_flac_of_no_documents(spark, docs):
    assert flac.digests(flac.media_columns(docs.limit(0))).count() == 0
    assert flac.pcm_blocks(flac.media_columns(docs.limit(0))).count() == 0


def test_flac_of_documents(spark, docs, rows):
    got = flac.digests(flac.media_columns(docs)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for k, t, *_ in rows:
        p = flac.payload_of((t or "").encode())
        want[k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert flac.pcm_blocks(flac.media_columns(docs)).where("doc_id = 5").count() > 10


def test_language(spark):
    rng, alphabets = random.Random(2), {"aa": "abcdef", "bb": "defghi"}
    rows = [(i, " ".join("".join(rng.choices(alphabets[g], k=5)) for _ in range(20)), g, 1) for i in range(300) for g in [rng.choice("ab") * 2]]
    rows += [(900, None, "aa", 1), (901, "123 !", None, 1), (None, "abc", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(d, langid.fit(d)).collect()}
    assert len(got) == len(rows) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[1] and r[2]]
    assert held and all(got[r[0]]["held_out"] and got[r[0]]["lang_pred"] == r[2] for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(d, langid.fit(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def brute_grams(text):
    """By bucket, n-grams of 1 to 3 code points, one at a time."""
    out, x = Counter(), [ord(c) for c in f" {text.lower()} "]
    for i in range(len(x)):
        h = 0
        for c in x[i : i + 3]:
            h = (h ^ c) * 0x9E3779B1 % (1 << 32)
            h ^= h >> 15
            out[(h * 0x85EBCA77 % (1 << 32)) >> (32 - 15)] += 1
    return out


def test_language_counts_of_whole_texts():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 50, 997, 998, 999, 1000, 1001, 2500):
        t = "".join(rng.choice("abé ΣI漢😀") for _ in range(n))
        for piece in (1, 2, 1000, 1 << 20):
            got = langid.counted(t, piece)
            assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == brute_grams(t)


def test_language_against_brute_force(spark, monkeypatch):
    """Naive Bayes with plain counters: ties, repeats, a language without a text, null keys; small blocks of the product."""
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices(a, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))), f"l{j}") for i in range(240) for j in [i % 6] for a in ["abcdefghijkl"[j : j + 7]]]
    rows += [(500, None, "l0"), (501, "", "l1"), (502, None, "empty"), (503, "?! 12", None), (None, "abc def", "l1"), rows[3], rows[3], (504, "mnop", None), (505, "É", None)]
    learned = [(k, t, g) for k, t, g in rows if g is not None and k is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    size = Counter(g for *_, g in learned)
    for most in (512, 3):
        langs = sorted(sorted(size, key=lambda g: (-size[g], g))[:most])
        counts = {g: sum((brute_grams(t) for _, t, x in learned if x == g and t), Counter()) for g in langs}
        want = Counter()
        for k, t, _ in rows:
            pred, score = "und", 0.0
            if t and any(c.isalpha() for c in t):
                f = brute_grams(t)
                joint = {g: math.log(size[g] / sum(size[x] for x in langs)) + sum(n * math.log((c[b] + langid.ALPHA) / (sum(c.values()) + langid.ALPHA * langid.BUCKETS)) for b, n in f.items()) for g, c in counts.items()}
                pred = max(langs, key=lambda g: joint[g])
                score = 1 / sum(math.exp(x - joint[pred]) for x in joint.values())
            want[k, k is not None and zlib.crc32(str(k).encode()) % 4 == 2, pred, round(score, 3)] += 1
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.identify(d, langid.fit(d, max_langs=most)).collect()
        assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in got) == want
        model = langid.fit(d, max_langs=most)
        texts = [t for _, t, _ in rows]
        whole = langid.predict(texts, *model)
        with monkeypatch.context() as m:
            m.setattr(langid, "HELD", 100)
            assert [g for g, _ in langid.predict(texts, *model)] == [g for g, _ in whole]


def test_language_of_very_long_texts(spark):
    rows = [(i, g * 40, g) for i, g in enumerate(["ab ", "cd "] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (a, _), (b, _) = langid.predict(["ab " * (1 << 19), "cd " * (1 << 19)], *model)
    assert (a, b) == ("ab ", "cd ")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, model).count() == 0


def test_packing(spark, docs, rows):
    path = queries.vocabulary(queries.PACKING)
    tok, got = token_counts.tokenizer(path), packing.pack(docs, path).toPandas()
    want = Counter()
    for k, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            want[-1 if k is None else k, i // 4096, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.iloc[0] == 0 and (s.offset.iloc[1:].values == (s.offset + s.length).iloc[:-1].values).all() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, rng.integers(1, 500)), minlength=65)
    used = np.zeros(65, int)
    for lengths, times in packing.plan(counts, 64):
        assert sum(lengths) <= 64
        np.add.at(used, lengths, times)
    assert (used == counts).all()


def test_warc(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b b/", "<p>x</p>"), (2, None, None), (5, "", ""), (4, "u", "ünï" * 5000), (1, "http://b b/", "<p>x</p>"), (9, "z", "<p>x</p>"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write(pages, limit=100)
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(archives).collect())
    want = Counter()
    for k, u, h in rows:
        h = h or ""
        first = min(x[0] for x in rows if (x[2] or "") == h and x[0] is not None)
        again = k is not None and k > first
        want[k, u, len(h.encode()), "revisit" if again else "response", first if again else None] += 1
    assert got == want and archives.count() > 1
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(b"\0" * 40))


def brute_removed(rows, window):
    """Rows in order of doc_id (null first) and a hash of the text; rows that repeat both are one document."""
    hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    seen, removed = set(), {}
    for k, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))):
        ws = split(t)
        cover = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            x = tuple(ws[j : j + window])
            if x in seen:
                cover[j : j + window] = [True] * window
            seen.add(x)
        removed[k, t] = cover
    out = []
    for k, t, *_ in rows:
        ws, cover = split(t), removed.get((k, t), [])
        out.append((k, len(ws), sum(cover), hashlib.sha256(" ".join(w for w, c in zip(ws, cover, strict=True) if not c).encode()).hexdigest()))
    return Counter(out)


#: As they are; split from the second string of a bucket on; parts taken apart at once; both.
SIZES = [{}, {"hot": 1}, {"held_bytes": 1}, {"hot": 1, "held_bytes": 4000, "part_bytes": 2000}]


@pytest.mark.parametrize("sizes", SIZES)
def test_substrings(spark, rows, sizes):
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    assert Counter(map(tuple, substring_dedup.digests(d, **sizes).collect())) == brute_removed(rows, 20)
    out = substring_dedup.clean(d, window=50, **sizes)
    assert out.columns == d.columns
    kept = Counter((k, sum(1 for _ in (t or "").split())) for k, t, *_ in map(tuple, out.collect()))
    want = Counter()
    for (k, n, g, _), c in brute_removed(rows, 50).items():
        want[k, n - g] += c
    assert kept == want
    assert substring_dedup.digests(d.limit(0), **sizes).count() == 0 and substring_dedup.clean(d.limit(0), **sizes).count() == 0


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("m", [1, 6, 20])
def test_substrings_of_keys_with_several_texts(spark, sizes, m):
    """Rows without a key, one key with texts of different lengths, repeated rows, and a passage in all of them."""
    rng = random.Random(6)
    a, b, c = (words(rng, n) for n in (60, 25, 300))
    rows = [(5, " ".join(a)), (7, "x y " + " ".join(a)), (7, " ".join(b + [f"own{i}" for i in range(60)])), (7, " ".join(c)), (7, " ".join(b)), (7, " ".join(b))]
    rows += [(None, " ".join(a[:30])), (None, " ".join(c + a)), (None, None), (None, ""), (9, " ".join(["same"] * 200)), (9, " ".join(["same"] * 30)), (-4, " ".join(c[::-1]))]
    rows += [(100 + i, " ".join([f"n{i}", *a[10:35], f"m{i}"])) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, substring_dedup.digests(d, m=m, **sizes).collect())) == brute_removed(rows, 20)


def test_records():
    columns = [np.array(x) for x in ([7, (1 << 32) - 1], [-(1 << 63), 5], [3, -4], [0, 70_000], [1, 65_535])]
    for strings in ([b"a b", b""], [b"", b"\xc3\xa9 x"]):
        got, ends, raw = substring_dedup.opened_records(substring_dedup.packed_records(columns, strings))
        assert [c.tolist() for c in got] == [c.tolist() for c in columns] and [raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)] == strings


def brute_components(rows, n, percent):
    sets = []
    for k, t, *_ in rows:
        ws = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows))


def test_near_duplicates(spark, docs, rows):
    got = minhash.near_duplicates(docs, shingle=4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"] if r["doc_id"] is not None else None) for r in got.collect()) == brute_components(rows, 4, 80)
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and left.where("doc_id in (7, 8)").count() == 0 and left.where("doc_id in (0, 1, 2)").count() == 3
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_keys_with_several_texts(spark):
    rng = random.Random(8)
    base = [words(rng, 60) for _ in range(6)]
    near = lambda b: " ".join([*b[:-1], "changed"])
    whole = [" ".join(b) for b in base]
    rows = [(k, t) for k, t in ((1, whole[0]), (1, whole[1]), (1, whole[2]), (8, near(base[0])), (9, near(base[1])), (10, near(base[2])))]  # copies of each text of key 1
    rows += [(-(1 << 62) - 1, whole[3]), (5, near(base[3])), (5, whole[4]), (5, None), (1 << 62, whole[5]), ((1 << 62) + 1, near(base[5])), ((1 << 62) + 1, near(base[4]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(d, shingle=4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 4, 80)
    left = {(r["doc_id"], r["text"]) for r in minhash.deduplicated(d, shingle=4).collect()}
    assert left == {*rows[:3], rows[6], rows[8], rows[9], rows[10]}


def test_chains_of_near_duplicates(spark):
    """Texts that drift: neighbours are alike, the ends are not."""
    rng = random.Random(4)
    text, rows = words(rng, 120), []
    for i in range(40):
        rows.append((39 - i, " ".join(text)))
        text = text[4:] + words(rng, 4)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(d, shingle=4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 4, 80)


def test_posterior_bounds():
    least = minhash.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 128
    a = np.arange(160, dtype=np.uint32)[None]
    assert minhash.verdicts(a, a, 0.8).all() and not minhash.verdicts(a, a + 1000, 0.8).any()
