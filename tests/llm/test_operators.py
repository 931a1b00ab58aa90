import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomtide.llm")

from loomtide.llm import bpe, chat, components, licenses, mixing, onebit, quality, setsketch, suffixes, topk, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, regs string, h long"
rng = np.random.default_rng(3)
WORDS = ["w%d" % i for i in range(400)]


def say(n):
    return " ".join(rng.choice(WORDS, n))


BASE = say(120)
TEXTS = [BASE, BASE, BASE.replace(" ", "\n", 3), say(90) + " " + BASE[:200], None, "", "  ", "one two", "ONE two", "a" * 300, "a" * 300 + "b", say(30), BASE.rsplit(" ", 4)[0] + " p q r s", "éè " * 60, "x éè " * 60, say(5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s%d" % (i % 3) if i % 5 else None, None, "clash", 1) for i, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates_against_all_pairs(docs, empty):
    sets = [shingles(t, 4) for t in TEXTS]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(docs, width=4).collect()}
    assert [got[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(sets))] == root
    assert setsketch.near_duplicates(empty).collect() == []


def test_a_chain_of_near_copies_is_one_component(spark):
    words = list(rng.choice(WORDS, 300))
    rows = [(i, " ".join(words[5 * i : 5 * i + 200])) for i in range(20)]
    got = {r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {0}


def test_a_family_about_the_threshold_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    base, rows = rng.choice(WORDS, 150), []
    for i in range(220):
        words = base.copy()
        words[rng.choice(150, rng.integers(2, 7), replace=False)] = "x%d" % i
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 4) for _, t in rows]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < len(root)
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert [got[i] for i in range(len(root))] == root


def test_components_of_chains_hubs_and_loops(spark):
    order = [int(x) for x in rng.permutation(100)]
    pairs = [*zip(order, order[1:], strict=False), *((200, x) for x in range(201, 260)), *((x, 199) for x in range(230, 240)), (300, 300), (400, None), (None, None), (501, 500), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = {x: 0 for x in order} | {x: 199 for x in range(199, 260)} | {300: 300, 500: 500, 501: 500}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_sketches_merge_and_estimate():
    a, b = (np.arange(x, x + 2000).astype(np.uint64) for x in (1, 401))
    mixed = setsketch.B.mix(np.union1d(a, b))
    ra, rb = (setsketch.registers_of(setsketch.B.mix(x)) for x in (a, b))
    assert (setsketch.merge_registers(ra, rb) == setsketch.registers_of(mixed)).all()
    est = setsketch.estimate([(ra > rb).sum()], [(ra < rb).sum()], [(ra == rb).sum()], [2000], [2000])[0]
    assert abs(est - 1600 / 2400) < 0.15


def test_repeats_against_windows(docs, empty):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        x = (t or "").encode()
        cover = np.zeros(len(x), bool)
        windows = [x[k : k + 50] for k in range(len(x) - 49)]
        for k, w in enumerate(windows):
            if w in seen:
                cover[k : k + 50] = True
        seen.update(windows)
        want[i] = (bytes(np.frombuffer(x, np.uint8)[~cover]), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()))
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], len(r["spans"]) // 2) for r in suffixes.remove_repeats(docs).collect()}
    assert got == want
    assert suffixes.remove_repeats(empty).collect() == []
    text = suffixes.remove_repeats(docs, as_text=True).where("doc_id = 0").first()["kept"]
    assert text == BASE


def brute_removed(texts, length=50):
    """(kept bytes, removed) of each text, in the order of their ids."""
    seen, out = set(), []
    for t in texts:
        x = (t or "").encode()
        cover = np.zeros(len(x), bool)
        windows = [x[k : k + length] for k in range(len(x) - length + 1)]
        for k, w in enumerate(windows):
            if w in seen:
                cover[k : k + length] = True
        seen.update(windows)
        out.append((bytes(np.frombuffer(x, np.uint8)[~cover]), int(cover.sum())))
    return out


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_unlike_texts_of_equal_structure_are_left_alone(spark):
    """Sums of powers of an odd number modulo 2^64 cannot tell these apart."""
    pairs = [(thue_morse(4096, "a", "b"), thue_morse(4096, "c", "d")), (thue_morse(2048, "ax", "by"), thue_morse(2048, "cx", "dy"))]
    for left, right in pairs:
        got = suffixes.remove_repeats(spark.createDataFrame([(1, left), (2, right)], "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0}
    words = [(1, thue_morse(2048, "a", "b")), (2, thue_morse(2048, "b", "a")), (3, thue_morse(2048, "a", "b").upper())]
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(words, "doc_id long, text string"), width=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_repeats_over_many_blocks_and_parts(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 3000), ("PART_ANCHORS", 64), ("PART_ENTRIES", 32), ("HOT", 3)):
        monkeypatch.setattr(suffixes, name, value)
    draw = np.random.default_rng(12)
    pool = [" ".join(draw.choice(WORDS, n)) for n in draw.integers(1, 60, 40)] + ["ab" * 90, "z" * 120, "\u00e9\u00e8" * 40]
    texts = [" ".join(pool[k] for k in draw.integers(0, len(pool), draw.integers(0, 9))) for _ in range(120)] + [None, "", "z" * 20_000]
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"]) for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)
    short = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"]) for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string"), length=17).collect()}
    assert [short[i] for i in range(40)] == brute_removed(texts[:40], 17)


def test_strings_that_share_a_hash_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(suffixes.B, "mix", lambda x: x * np.uint64(0))
    rows = np.frombuffer((b"x" * 75 + bytes([0, 25]) + bytes(3)) * 2 + b"y" * 75 + bytes([0, 25]) + bytes(3), np.uint8).reshape(3, 80).copy()
    assert suffixes.string_lows(rows, np.array([4, 2, 3]), 50)[:, 0].tolist() == [2, 2, 3]


def test_repeats_among_rows_that_repeat_an_id(spark):
    other = say(60)
    rows = [(1, BASE), (2, other + " " + BASE), (2, BASE[30:]), (2, "short"), (3, other), (3, other)]
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first, rest = other + " ", [(1, BASE), (2, ""), (2, "short"), (3, ""), (3, "")]
    assert [g for g in got if g[0] != 2 or g[1] in ("", "short")] == rest
    assert [g[1] for g in got if g not in rest] == [first]


def test_top_products_and_nearest(spark):
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 7)]) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [0.0] * 8), (403, rows[3][1]), (404, [1.0, None] + [0.0] * 6), (405, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(np.array(x, float)).all()}
    got = {}
    for r in topk.top_products(v, v.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in good if i % 50 == 0]:
        ints = {i: np.floor(1024 * x) for i, x in good.items()}
        best = sorted(((-int(ints[i] @ ints[q]), i) for i in good if i != q))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    hits = total = 0
    near = onebit.nearest(v, v.where("vec_id % 50 = 0")).collect()
    for q in [i for i in good if i % 50 == 0]:
        cos = {i: x @ good[q] / np.linalg.norm(x) / np.linalg.norm(good[q]) for i, x in good.items() if i != q and x.any()}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        mine = [r for r in near if r["query_id"] == q]
        assert all(abs(r["score"] - cos[r["vec_id"]]) < 1e-12 for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(best)), total + 5
    assert hits / total >= 0.9
    assert topk.top_products(v.limit(0), v).count() == 0 and onebit.nearest(v, v.limit(0)).count() == 0


def test_coordinate_pruning_is_exact():
    for _ in range(200):
        c = rng.normal(size=(200, 6)) + rng.normal(size=6) * 3
        q = c[0] + rng.normal(size=6) * 0.3
        floor = np.sort(c @ q)[-5]
        assert set(np.flatnonzero(c @ q >= floor)) <= set(topk.admitted(q, c, np.sqrt((c * c).sum(1)), floor))


def test_bpe_matches_the_library(docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.parse_ranks(open(path, "rb").read())
    known = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.round_trip(docs, path, tokenizers.PATTERN).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = known.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["valid_utf8"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    c = bpe.Codec(open(path, "rb").read(), tokenizers.PATTERN)
    pool = [chr(x) for x in [*range(0x250), 0x1C, 0x1F, 0x85, 0xA0, 0x2028, 0x3000, 0x180E, 0x200B, 0x4E00, 0x1F600, 0x301, 0x660]]
    for _ in range(500):
        text = "".join(rng.choice(pool, rng.integers(0, 60)))
        assert c.encode(text).tolist() == known.encode_ordinary(text)
    stream = bpe.StreamDecoder(c)
    split = np.array(known.encode_ordinary("\U0001f600"), "<u4")
    stream.feed(split[:1])
    assert len(split) == 1 or not stream.finish()
    stream.feed(split[1:])
    assert stream.finish()
    assert bpe.round_trip(empty, path, tokenizers.PATTERN).collect() == []


def test_license_sequences(spark, empty):
    rows = [
        (0, "x. Licensed under the MIT License. y"), (1, None), (2, ""), (3, "RELEASED under the\tMIT license.\nReleased under the MIT License."),
        (4, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        (5, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ]
    got = sorted((r["doc_id"], r["rule"], r["first_sentence"], r["last_sentence"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "mit-line-2", 1, 1), (3, "mit-line", 0, 0), (3, "mit-line", 1, 1), (4, "bsd-2-text", 0, 1)]
    assert licenses.scan(empty).collect() == []


def test_every_license_rule_finds_its_own_text(spark):
    rows = [(i, "Intro. " + "\n".join(sentences) + "\nend") for i, (_, _, sentences) in enumerate(licenses.RULES)]
    got = {(r["doc_id"], r["rule"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((i, rule) in got for i, (_, rule, _) in enumerate(licenses.RULES))
    i = next(i for i, (_, rule, _) in enumerate(licenses.RULES) if rule == "mpl-2.0-notice")
    assert (got[i, "mpl-2.0-notice"]["first_sentence"], got[i, "mpl-2.0-notice"]["last_sentence"]) == (1, 3)


def test_wrapped_and_commented_licenses(spark):
    import textwrap

    rows, want = [], []
    for i, (_, rule, sentences) in enumerate(licenses.RULES):
        for j, (width, mark) in enumerate([(72, ""), (60, " * "), (40, "# "), (25, "//  ")]):
            lines = [mark + x for s in sentences for x in [*textwrap.wrap(s, width), ""]]
            rows.append((10 * i + j, "\n".join(["/*", *lines, " */", "x = 1;"])))
            want.append((10 * i + j, rule))
    rows.append((900, "Permission is hereby granted,\nfree of cost.\nLicensed under\nthe MIT\nother License."))
    got = {(r["doc_id"], r["rule"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(want) <= got and not [g for g in got if g[0] == 900]


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Targets of sources in order, by sharing the excess again until none is above its limit."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    stopped, out = set(), {}
    while True:
        free = sum(sizes.values()) - sum(most * sizes[n] for n in stopped)
        out = {n: most * sizes[n] if n in stopped else free * weight[n] / sum(weight[m] for m in names if m not in stopped) for n in names}
        over = {n for n in names if n not in stopped and out[n] > most * sizes[n]}
        if not over:
            return out
        stopped |= over


def test_mix_meets_targets_and_repeats(spark, docs, empty):
    one = sorted(tuple(r) for r in mixing.taken_words(docs).collect())
    assert one == sorted(tuple(r) for r in mixing.taken_words(docs).collect())
    assert len(one) == len(TEXTS) and all(t <= 3 * s for _, s, _, _, t in one)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
    assert {i: s for i, s, *_ in one} == sizes
    assert mixing.taken_words(empty).collect() == []
    draw = np.random.default_rng(8)
    rows = [(None if i % 97 == 0 else i, "w " * int(draw.integers(0, 90)), [None, "a", "b", "c", "d"][int(draw.choice(5, p=[0.1, 0.02, 0.5, 0.3, 0.08]))]) for i in range(3000)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1))).collect()
    sizes, by = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + t.count("w")
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[source[r["doc_id"]]] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by[r["source_size"]] = by.get(r["source_size"], 0) + r["taken"]
    assert all(abs(by[sizes[s]] - want[s]) <= 90 for s in sizes)


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 500, "c": 300, None: 190}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got["a"] == 30 and got[None] == 570 and abs(got["b"] - 800 / 3) < 1e-9 and abs(got["c"] - 400 / 3) < 1e-9
    assert got == pytest.approx(brute_targets(sizes))


def test_every_draw_of_a_quota_takes_its_block_once(spark):
    rows = [(i, "w " * (1 + i % 40), "ab"[i % 3 == 0]) for i in range(2000)]
    stream, known = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_draws=16)
    taken = stream.groupBy("doc_id", "copy").count().where("count > 1").count()
    assert taken == 0 and stream.select("shard").distinct().count() > 2


def test_wide_draws_follow_the_distribution():
    draw = np.random.default_rng(4)
    exact = [mixing._wide_hypergeometric(draw, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(exact) - 30) < 0.3 and abs(np.var(exact) - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    big = [mixing._wide_hypergeometric(draw, 3 * 10**10, 7 * 10**10, 10**10) for _ in range(30)]
    assert all(abs(x - 3 * 10**9) < 8 * np.sqrt(1.9e9) for x in big) and len(set(big)) > 20


def test_shards_divide_the_quotas():
    quotas = np.array([100, 7, 0, 33])
    parts = [mixing.shard_quotas(s, 9, quotas, 1) for s in range(9)]
    assert (sum(n for _, n in parts) == quotas).all()
    for i in range(4):
        spans = sorted((int(s[i]), int(s[i] + n[i])) for s, n in parts if n[i])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(mixing.permuted(np.arange(1000), 1000, 3)) == list(range(1000))


def test_classifiers_learn(spark):
    bad = ["zorg", "blap"]
    rows = [(i, say(40) + (" " + bad[i % 2] if i % 3 == 0 else ""), "en", 1 if i % 3 == 0 else 0) for i in range(600)] + [(900, None, None, 0), (901, "", "xx", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxicity.score(df, model)
    held = got.where("doc_id % 5 = 0 and doc_id < 600").collect()
    assert sum((r["toxicity"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.95
    assert got.count() == len(rows) and got.where("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    none = toxicity.fit(df.drop("toxic").limit(0), df.select("doc_id", "toxic").limit(0))
    assert toxicity.score(df, none).where("toxicity > 0.01").count() == 0
    rows = [(i, say(40) if i % 2 else " | ".join(say(30).split()).upper() + "!!", i % 2) for i in range(400)] + [(900, None, None), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    described = quality.describe(df)
    q = quality.score(described, quality.fit(described, df.where("doc_id % 4 <> 2").select("doc_id", "quality")))
    held = q.where("doc_id % 4 = 2 or doc_id % 4 = 3").where("doc_id < 900").collect()
    assert sum((r["quality_score"] >= 0.7) == (r["doc_id"] % 2 == 1) for r in held) / len(held) > 0.95
    assert q.where("quality_score is null").count() == 0
    assert (np.diff(quality.isotonic(np.array([3.0, 1.0, 2.0, 5.0]), np.ones(4))) >= 0).all()


def test_thresholds_do_not_depend_on_the_share_held_out(spark):
    draw = np.random.default_rng(5)
    rows = [("en", int(y), bool(k % (3 if y else 2) == 0), float(1 / (1 + np.exp(-x)))) for y, n in ((1, 600), (0, 12000)) for k, x in enumerate(draw.normal(1.5 * y, 1, n))]
    rows = [(*r, int(np.floor(np.log(r[3] / (1 - r[3])) * toxicity.BINS))) for r in rows]
    got = toxicity.calibrate(spark.createDataFrame(rows, "lang string, label int, held boolean, score double, bin int"))
    y, s = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    f1 = lambda t: 2 * (y[s >= t]).sum() / ((s >= t).sum() + y.sum())
    assert got["en"] == got[""] and f1(got[""]) > 0.95 * max(f1(t) for t in s)


def test_thresholds_cover_rows_beyond_the_sample(spark):
    draw = np.random.default_rng(6)
    rows = [(i, say(20) + (" zorg" if draw.random() < (0.9 if i % 20 == 0 else 0.15) else "") + (" blap" if draw.random() < (0.6 if i % 20 == 0 else 0.02) else ""), "en", int(i % 20 == 0)) for i in range(10000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.where("doc_id < 5000").select("doc_id", "toxic"), positives=60, negatives=120)
    got = np.array([(r["toxic"], r["doc_id"] % 20 == 0, r["toxicity"]) for r in toxicity.score(df.drop("toxic"), model).where("doc_id >= 5000").collect()], float)
    f1 = lambda called: 2 * (called * got[:, 1]).sum() / (called.sum() + got[:, 1].sum())
    assert f1(got[:, 0]) > 0.9 * max(f1(got[:, 2] >= t) for t in np.unique(got[:, 2]))


def test_a_text_in_parts_scores_as_a_whole():
    draw = np.random.default_rng(7)
    words = [draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (500, 40, 41, 42, 79, 80, 81, 82, 1, 0)]
    model = toxicity.train(words, np.array([1.0, 0] * 5), steps=20)
    hashes, offsets = np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    model.out[:] = draw.normal(size=len(model.out))
    for f in model.filters:
        f[1:] *= -5  # so a window that ends in padding is often the largest
    want = model.scores(hashes, offsets)
    for piece in (3, 20, 40, 64):
        assert np.allclose(model.scores(hashes, offsets, piece), want, atol=1e-5)


def test_replies_in_a_cycle_take_no_part(spark):
    kinds = "tree long, node long, parent long, role string, text string, score double"
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (2, 0, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 0, 0), (3, 1, 0), (3, 7, None), (4, 5, 5)]
    got = chat.paths(spark.createDataFrame([(*r, "user", "x", 0.0) for r in rows], kinds)).collect()
    assert sorted((r["tree"], r["leaf"], r["node"], r["up"]) for r in got) == [(1, 2, 0, 2), (1, 2, 1, 1), (1, 2, 2, 0), (3, 7, 7, 0)]


def test_products_of_negative_repeated_and_large_ids(spark):
    rows = [(-100, [1.0, 2.0]), (-100, [3.0, 0.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (100, [0.0, -1.0]), (9, [2.0**20, 2.0**20]), (200, [2.0**20, 1.0])]
    v = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, id long, block long")
    got = topk.top_products(v, v.where("vec_id % 100 = 0"), k=3).collect()
    whole = [(i, [int(1024 * x) for x in e]) for i, e in rows]
    for q in (-100, 100, 200):
        asked = [e for i, e in whole if i == q]
        best = sorted((-max(sum(a * b for a, b in zip(e, x, strict=True)) for x in asked), i) for i, e in whole if i != q)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        if len(asked) == 1:
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(best[:3])]
        else:
            assert [m[2] for m in mine][0] == -best[0][0]
    near = onebit.nearest(v, v.where("vec_id % 100 = 0"), k=20).where("query_id = 100").collect()
    assert len(near) == len(rows) - 1
    big = spark.createDataFrame([(0, [2.0**24, 2.0**24]), (1, [2.0**24, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_products(big, big, scale=1 << 20).collect()


def test_chat_trees_and_reading_back(spark):
    texts = [r"\### Assistant: </turn> ok", "\\h\\l\\\\", None, "a </turn>\n### User: b", "\U0001f600 #<>\\"]
    roles = ["user", "assistant", "odd: role", "Assistant", "assistant"]
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, roles[i], texts[i], 1.0) for i in range(5)] + [(1, 10, 0, "assistant", "worse", 0.1), (2, 0, 99, "user", "alone", None)], "tree long, node long, parent long, role string, text string, score double")
    made = chat.read_back(chat.formatted(chat.conversations(nodes))).collect()
    assert {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in made} == {1: [(a, b or "") for a, b in zip(roles, texts, strict=True)], 2: [("user", "alone")]}
    one = next(r for r in made if r["tree"] == 1)
    spans = [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]]
    assert len(spans) == 2 and "\U0001f600" in spans[1]
    assert {r["leaf"] for r in chat.conversations(nodes, branches=2).where("tree = 1").collect()} == {4, 10}
    assert chat.conversations(nodes.limit(0)).collect() == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of the contract queries: the odd texts, copies with changed words, and labels for most."""
    at = str(tmp_path_factory.mktemp("tables"))
    more = [say(50) + (" zorg" if i % 3 == 0 else "") for i in range(120)]
    texts = [*TEXTS, *more, *(" ".join(["new", *t.split()[2:]]) for t in more[:30]), more[0].upper(), "pre " + more[1]]
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(at + "/documents.parquet")
    spark.createDataFrame([(i, int("new" not in (t or "")), int("zorg" in (t or ""))) for i, t, *_ in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    return at, rows


@pytest.mark.parametrize("name", ["op7_near_duplicates", "op8_suffix_dedup"])
def test_queries_against_their_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    from loomtide.llm import queries

    at, _ = tables
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    made = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in made.description]
    want = sorted(made.fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, at).select(*columns).collect()) == want
    assert sum(r[2] > 0 if name == "op8_suffix_dedup" else not r[3] for r in want) > 5


def test_mix_and_score_queries_keep_their_contracts(spark, tables):
    from loomtide.llm import queries

    at, rows = tables
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    by = {}
    for i, _, _, source, _ in rows:
        by[source] = by.get(source, 0) + sizes[i]
    want, source, taken = brute_targets(by), {r[0]: r[3] for r in rows}, dict.fromkeys(by, 0)
    mixed = queries.op4_mix_sources(spark, at).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(sizes)
    for r in mixed:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by[s]) and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(sizes[i] for i in sizes if source[i] == s) for s in by)
    for query, parts, rest, least in ((queries.op5_toxicity, 5, 0, 0.5), (queries.op9_quality, 4, 2, 0.7)):
        scored = query(spark, at).collect()
        assert sorted(r["doc_id"] for r in scored) == sorted(sizes)
        for r in scored:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    kinds = "doc_id long, text string, lang string, source string, n_chars int"
    texts = [say(60) for _ in range(7)]
    row = lambda i, t: (i, t, "en", "s", len(t))
    rows = [row(1, texts[0]), row(2, texts[1]), row(2, texts[1]), row(2, texts[2]), row(None, texts[3]), row(None, texts[4]), row(None, texts[4]), row(3, texts[0] + " tail"), row(4, ""), row(4, "")]
    once = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, kinds), "")
    distinct = sorted({(r[0], r[1]) for r in rows} - {(3, texts[0] + " tail")}, key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in once.collect()], key=str) == distinct
    cut = cp.cut_repeats(spark, spark.createDataFrame(rows[:4] + rows[4:6] + [row(9, texts[3]), row(None, texts[5]), row(None, texts[5])], kinds), "")
    got = cut.collect()
    assert len(got) == 9 and sum(r["doc_id"] is None for r in got) == 4 and sum(r["doc_id"] == 2 for r in got) == 3
    assert sum(r["text"] == texts[5] for r in got) == 1 and sum(r["text"] == texts[1] for r in got) == 1
    mixed = [r["text"] for r in cp.mix_sources(spark, spark.createDataFrame([row(1, texts[0]), row(1, texts[0]), row(None, texts[1]), row(None, texts[2]), row(5, texts[3])], kinds), "").collect()]
    assert {t: mixed.count(t) for t in set(mixed)} == {texts[0]: 2, texts[1]: 1, texts[2]: 1, texts[3]: 1}
