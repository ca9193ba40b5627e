"""Quality, mixing, packing, licences, media and the pipeline against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from helpers import awkward, documents, prose
from quillstone.llm import licences, media, mixing, packing, quality

# quality


def test_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    m = quality.train(x[:4000], y[:4000], pairs=2)
    assert ((m.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9 and (1, 0) in m.pairs
    y = (np.abs(x[:, 2] - 0.5) < 0.2).astype(float)
    assert ((quality.train(x[:4000], y[:4000], pairs=0).score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95


def trained_by_hand(x, y, rounds, pairs):
    """The same model by plain loops: cut points, tables of features and of pairs, as dictionaries of bins."""
    n, width = x.shape
    cuts = [sorted(set(np.quantile(x[:, f].astype(float), np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(width)]
    bins = [[sum(c <= float(v) for c in cuts[f]) for f, v in enumerate(row)] for row in x]
    base = np.log(y.mean() / (1 - y.mean()))
    tables, squares, z = [[0.0] * (len(c) + 1) for c in cuts], {}, [base] * n
    gain = lambda g, h: g * g / (h + 1)

    def slopes():
        p = [1 / (1 + np.exp(-v)) for v in z]
        return [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]

    def split(g, h):
        best = (0.0, 0) if len(g) < 2 else max(((gain(sum(g[:k]), sum(h[:k])) + gain(sum(g[k:]), sum(h[k:])) - gain(sum(g), sum(h)), -k) for k in range(1, len(g))))
        return best[0], abs(best[1])

    def tree(g, h, leaves):
        parts = [(0, len(g))]
        while len(parts) < leaves:
            got = [(*split(g[lo:hi], h[lo:hi]), k) for k, (lo, hi) in enumerate(parts)]
            v, cut, k = max(got)
            if v <= 1e-9:
                break
            lo, hi = parts[k]
            parts[k : k + 1] = [(lo, lo + cut), (lo + cut, hi)]
        out = [0.0] * len(g)
        for lo, hi in parts:
            out[lo:hi] = [sum(g[lo:hi]) / (sum(h[lo:hi]) + 1)] * (hi - lo)
        return out

    def pair(f, k, g, h):
        shape = len(tables[f]), len(tables[k])
        sg, sh = np.zeros(shape), np.zeros(shape)
        for b, u, v in zip(bins, g, h):
            sg[b[f], b[k]] += u
            sh[b[f], b[k]] += v
        best, at = 0.0, np.zeros(shape)
        for turn in (False, True):
            a, c = (sg.T, sh.T) if turn else (sg, sh)
            for cut in range(1, len(a), max(1, len(a) // 8)):
                v, out = -gain(a.sum(), c.sum()), np.zeros_like(a)
                for rows in (range(cut), range(cut, len(a))):
                    p, q = a[list(rows)].sum(0).tolist(), c[list(rows)].sum(0).tolist()
                    t = tree(p, q, 2)
                    for u in sorted(set(t)):
                        v += gain(sum(i for i, w in zip(p, t) if w == u), sum(i for i, w in zip(q, t) if w == u))
                    out[list(rows)] = t
                if v > best:
                    best, at = v, out.T if turn else out
        return best, at

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            hg, hh = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for b, u, v in zip(bins, g, h):
                hg[b[f]] += u
                hh[b[f]] += v
            step = [quality.RATE * v for v in tree(hg, hh, 3)]
            tables[f] = [a + b for a, b in zip(tables[f], step)]
            z = [v + step[b[f]] for v, b in zip(z, bins)]
    g, h = slopes()
    ranked = sorted((-pair(f, k, g, h)[0], f, k) for f in range(width) for k in range(f))
    squares = {(f, k): np.zeros((len(tables[f]), len(tables[k]))) for _, f, k in ranked[:pairs]}
    for _ in range(rounds // 6):
        for f, k in squares:
            step = quality.RATE * pair(f, k, *slopes())[1]
            squares[f, k] = squares[f, k] + step
            z = [v + step[b[f], b[k]] for v, b in zip(z, bins)]
    return [1 / (1 + np.exp(-v)) for v in z]


def test_training_and_scores_as_by_hand():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((160, 3)) * 9).astype(np.float32)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 5) | (x[:, 2] > 8)).astype(float)
    model = quality.train(x, y, rounds=6, pairs=2)
    assert np.allclose(model.score(x), trained_by_hand(x, y, 6, 2), atol=1e-6)
    z = [model.base + sum(t[sum(c <= v for c in model.cuts[f])] for f, (t, v) in enumerate(zip(model.tables, row))) + sum(t[sum(c <= row[f] for c in model.cuts[f]), sum(c <= row[k] for c in model.cuts[k])] for (f, k), t in model.pairs.items()) for row in x]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(z))))


def test_training_rows_are_bounded(spark):
    docs = documents(spark, [(i % 3, f"word {i} and more", "s") for i in range(60)])
    labels = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0)], "doc_id bigint, quality double")
    asked = []
    kept, quality.train = quality.train, lambda x, y: asked.append(len(x))
    try:
        quality.fit(docs, labels, max_rows=7)
    finally:
        quality.train = kept
    assert asked == [7]


def test_features_as_by_hand():
    x = quality.features(pa.array(["The THE 12 a| a!\nb# The THE 12 a|.", None, "", " \n", "ß"]))
    f = dict(zip(quality.FEATURES, x[0].tolist()))
    assert f["words"] == pytest.approx(np.log(11)) and f["distinct_words"] == pytest.approx(0.7) and f["words_a_line"] == pytest.approx(np.log(6))
    assert f["upper"] == pytest.approx(8 / 16) and f["digits"] == pytest.approx(4 / 25) and f["pipes"] == pytest.approx(2 / 25) and f["exclaims"] == pytest.approx(1 / 25)
    assert f["symbol_ends"] == pytest.approx(3 / 10) and f["repeated_grams"] == 0 and f["capitals"] == pytest.approx(0.4)
    assert not x[1:4].any() and x[4][quality.FEATURES.index("words")] > 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (got.keep == got.quality).mean() > 0.97 and got.keep[got.quality == 1].mean() > 0.98


def test_classifier_on_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (6, 1, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, awkward())
    model = quality.fit(docs, labels)
    assert quality.classify(docs, model).count() == len(awkward()) and quality.classify(docs, model).columns == ["doc_id", "score", "keep"]
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs, model).where("keep = 1").count()
    blank = quality.fit(docs, labels.limit(0))
    assert {r.keep for r in quality.classify(docs, blank).collect()} == {1} and quality.classify(documents(spark, []), blank).count() == 0


# mixing


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(3)
    for _ in range(200):
        mass = [rng.randrange(mixing.ONE + 1) for _ in range(rng.randrange(1, 40))]
        out = mixing.pivot(list(range(len(mass))), mass, rng.randrange(1 << 30))
        assert sum(out) == sum(mass) and sum(0 < m < mixing.ONE for m in out) <= 1 and all(0 <= m <= mixing.ONE for m in out)
    share = [mixing.ONE // 5, mixing.ONE // 2, mixing.ONE * 9 // 10, mixing.ONE // 3] * 3
    mean = np.mean([mixing.pivot(list(range(12)), share, s) for s in range(6000)], axis=0) / mixing.ONE
    assert np.abs(mean - np.array(share) / mixing.ONE).max() < 0.035


def due(rows, weights=None, budget=None):
    """Copies each (doc_id, source) is due, by hand."""
    chars, names = {}, sorted({s for _, _, s in rows}, key=repr)
    for _, t, s in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    w = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in names}
    whole = sum(chars.values()) if budget is None else budget
    return {(i, s): whole * w[s] / sum(w.values()) / chars[s] if chars[s] else 0 for i, _, s in rows}


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, None: 0.5}])
def test_copies_meet_their_due(spark, weights):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 30))), str(rng.choice(["a", "a", "a", "b", "c"]))) for i in range(900)] + [(1000 + i, "some text", None) for i in range(40)]
    want = due(rows, weights, 30_000)
    for parts in (1, 7):
        got = {(r.doc_id, r.source): r.copies for r in mixing.copies(documents(spark, rows).repartition(parts), weights, 30_000, leaf=16, fan=3).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1 for k in want)
        for s in ("a", "b", "c", None):
            assert abs(sum(n for (_, x), n in got.items() if x == s) - sum(n for (_, x), n in want.items() if x == s)) < 1 + 1e-6
        assert abs(sum(got.values()) - sum(want.values())) < 1 + 1e-6
        if parts == 1:
            first = got
    assert got == first  # whatever the partitions


def test_mixing_on_awkward_rows(spark):
    docs = documents(spark, awkward())
    got = mixing.copies(docs).collect()
    assert len(got) == len({(i, s) for i, _, s in awkward()})
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    have = {(r.doc_id, r.source): r.copies for r in got}
    rows = awkward()
    assert out.count() == sum(have[(i, s)] for i, _, s in rows)
    assert mixing.copies(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [(1, None, "a"), (2, "", None)])).count() == 0


# packing


def packed_by_hand(rows, window, end, apart=False):
    seen = {}
    number = [seen.update({r: seen.get(r, -1) + 1}) or seen[r] for r in rows]
    keys = [":".join(["null" if i is None else str(i), t or "", *([str(k)] if apart else [])]) for (i, t), k in zip(rows, number)]
    order = [r for _, r in sorted(zip((hashlib.md5(k.encode()).hexdigest() for k in keys), rows), key=lambda x: x[0])]
    flat = [(tok, i, n) for n, (i, t) in enumerate(order) for tok in re.split(r"[ \t\n\v\f\r]+", (t or "").strip(" \t\n\v\f\r")) + ([end] if end else []) if tok]
    out = []
    for k in range(0, len(flat), window):
        part = flat[k : k + window]
        starts = [j for j in range(len(part)) if j == 0 or part[j][2] != part[j - 1][2]]
        out.append((k // window, len(part), " ".join(t for t, _, _ in part), ",".join("null" if part[j][1] is None else str(part[j][1]) for j in starts), ",".join(map(str, starts))))
    return out


@pytest.mark.parametrize(("window", "end", "mb"), [(7, "<e>", 0.0005), (64, "<|endoftext|>", 0.002), (2048, "", 8), (100_000, "<e>", 8)])
def test_windows_as_by_hand(spark, window, end, mb):
    rng = np.random.default_rng(6)
    rows = [(i, t) for i, t, _ in awkward() if i not in (6, 7)] + [(20 + i, prose(rng, int(rng.integers(0, 90)))) for i in range(50)]
    got = packing.pack(documents(spark, [(i, t, "s") for i, t in rows]), window, end, mb).orderBy("window_id").collect()
    assert [tuple(r) for r in got] == packed_by_hand(rows, window, end)


def test_copies_are_packed_apart(spark):
    rng = np.random.default_rng(16)
    rows = [(i, prose(rng, 30)) for i in range(40)] + [(None, None)] * 3
    rows += [rows[5]] * 20
    got = packing.pack(documents(spark, [(i, t, "s") for i, t in rows]), 64, "<e>", 0.002, copies_apart=True).orderBy("window_id").collect()
    assert [tuple(r) for r in got] == packed_by_hand(rows, 64, "<e>", True)
    order = ",".join(r.doc_ids for r in got).split(",")
    assert max(len(list(g)) for k, g in itertools.groupby(order) if k == "5") < 20


def test_ranges_hold_equal_shares(spark):
    """One id, no id and one source for half of the rows make no range longer."""
    rng = np.random.default_rng(17)
    rows = [(7 if i % 4 == 0 else None if i % 4 == 1 else i, prose(rng, 60), "s") for i in range(2000)]
    df = documents(spark, rows)
    part = F.floor(F.conv(F.substring(packing._place(F.col("doc_id"), F.col("text")), 1, 8), 16, 10).cast("bigint") * 8 / F.lit(1 << 32))
    sizes = [r.n for r in df.groupBy(part.alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8


def test_packing_of_token_ids(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    rows = [(i, t, s) for i, t, s in awkward() if i is not None and i not in (2, 6, 7)]
    got = packing.pack(documents(spark, rows), 50, "50256", 0.001, path, pattern).orderBy("window_id").collect()
    flat = [int(x) for r in got for x in r.text.split()]
    texts, part = [], []
    for i in flat:
        if i == 50256:
            texts.append(packing._encoder(path, pattern).decode(part))
            part = []
        else:
            part.append(i)
    assert sorted(texts) == sorted(t or "" for _, t, _ in rows) and {r.n_tokens for r in got[:-1]} == {50}


def test_packing_of_long_texts_and_of_nothing(spark):
    got = packing.pack(documents(spark, awkward()), 1000).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) + 1 for _, t, _ in awkward()) and {r.n_tokens for r in got if r.window_id < len(got) - 1} == {1000}
    assert packing.pack(documents(spark, [])).count() == 0


# licences


def allowed_by_hand(expr, ok):
    """Evaluate by recursive descent, unlike the operator."""
    toks = re.findall(r"[()]|[^\s()]+", expr)

    def atom():
        t = toks.pop(0)
        if t == "(":
            v = either()
            assert toks.pop(0) == ")"
            return v
        v = t.rstrip("+") in ok
        if toks and toks[0] == "WITH":
            toks.pop(0)
            toks.pop(0)
        return v

    def both():
        v = atom()
        while toks and toks[0] == "AND":
            toks.pop(0)
            v = atom() & v
        return v

    def either():
        v = both()
        while toks and toks[0] == "OR":
            toks.pop(0)
            v = both() | v
        return v

    return either()


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["MIT", "GPL-3.0-only", "Apache-2.0+", "Zlib", "LGPL-2.1-only WITH LLVM-exception"]), lambda x: st.builds("({} {} {})".format, x, st.sampled_from(["AND", "OR"]), x) | st.builds("{} {} {}".format, x, st.sampled_from(["AND", "OR"]), x), max_leaves=8))
def test_expressions_as_by_recursive_descent(expr):
    assert licences.evaluate(expr)[0] == allowed_by_hand(expr, licences.ALLOWED)


@pytest.mark.parametrize("bad", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "()", "MIT WITH", "MIT ? ISC", "(MIT OR ISC) WITH X"])
def test_broken_expressions(bad):
    with pytest.raises(licences.Invalid):
        licences.evaluate(bad)


def notices_by_hand(text):
    flat, out, k = " ".join(text.lower().split()), [], 0
    while k < len(flat):
        fit = [p for p in licences.NOTICES if flat.startswith(p, k) and not (k and flat[k - 1].isalnum()) and not flat[k + len(p) : k + len(p) + 1].isalnum()]
        if fit:
            p = max(fit, key=len)
            out.append(licences.NOTICES[p])
            k += len(p)
        else:
            k += 1
    return out


def test_scans_as_by_hand(spark):
    rng = random.Random(4)
    phrases = list(licences.NOTICES) + ["submit license", "mit licenses", "plain words", "\n", "The  MIT\n License"]
    rows = [(i, " ".join(rng.choice([p, p.upper(), p.title()]) for p in rng.choices(phrases, k=rng.randrange(9))), "s") for i in range(200)]
    rows += [(900, "x\n// SPDX-License-Identifier: MIT OR GPL-2.0-only */\nmit license", "s"), (901, "SPDX-license-identifier: (MIT", "s"), (902, "SPDX-License-Identifier:\nGPL", "s"), (903, "Licensed under the " + "x " * 50_000 + " GNU General Public License, version 3.", "s")]
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, rows)).collect()}
    for i, t, _ in rows[:200]:
        want = notices_by_hand(t)
        assert got[i].notices == len(want) and got[i].licences == ",".join(sorted(set(want))) and got[i].allowed == int(all(n in licences.ALLOWED for n in want))
    assert (got[900].tags, got[900].notices, got[900].verdict, got[900].licences) == (1, 1, "allowed", "GPL-2.0-only,MIT")
    assert got[901].verdict == got[902].verdict == "invalid" and got[903].verdict == "restricted"


def test_scans_of_awkward_rows(spark):
    got = licences.scan_licences(documents(spark, awkward())).collect()
    assert len(got) == len(awkward()) and {r.verdict for r in got} == {"none"} and licences.scan_licences(documents(spark, [])).count() == 0


def test_licence_tables_are_parameters(spark):
    rows = [(1, "House Terms v2", "s"), (2, "SPDX-License-Identifier: X-1 WITH Y-2", "s"), (3, "MIT license", "s"), (4, "SPDX-License-Identifier: MIT\nxspdx-license-identifier: GPL-3.0-only", "s")]
    got = {r.doc_id: (r.verdict, r.licences, r.tags) for r in licences.scan_licences(documents(spark, rows), {"house terms v2": "House-2.0"}, {"House-2.0", "MIT"}, {("X-1", "Y-2")}).collect()}
    assert got == {1: ("allowed", "House-2.0", 0), 2: ("allowed", "X-1", 1), 3: ("none", "", 0), 4: ("allowed", "MIT", 1)}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "MIT license"), (None, None), ("b", "x")], "doc_id string, text string")
    assert {r.doc_id: r.notices for r in licences.scan_licences(df).collect()} == {"a": 1, None: 0, "b": 0}
    files = spark.createDataFrame([("f", media.mux(b"abc", 0))], "doc_id string, data binary")
    assert [(r.doc_id, r.samples) for r in media.media_columns(files).collect()] == [("f", 1)]
    assert packing.pack(df, 4, "<e>").agg(F.sum("n_tokens")).first()[0] == 6


# media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 8))
def test_ranges_hold_the_key_frames(payload, number):
    buf = media.mux(payload, number)
    (t,) = media.tracks(buf)
    got = [tuple(map(int, x.split(":"))) for x in t["ranges"].split(",") if x]
    step = media.SAMPLE * media.GROUP
    assert [buf[a : a + n] for a, n in got] == [payload[k : k + media.SAMPLE] for k in range(0, len(payload), step)]
    assert t["codec"] == media.CODECS[number // 3] and t["seconds"] == -(-len(payload) // media.SAMPLE) * media.DELTA / media.SCALE and (t["width"], t["height"]) == (640, 360)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2), st.integers(0, 3000), st.integers(0, 255), st.integers(0, 3000))
def test_damage_is_named_and_never_crashes(number, at, value, cut):
    buf = bytearray(media.mux(b"x" * 1500, number))
    buf[at % len(buf)] = value
    try:
        media.tracks(bytes(buf[: len(buf) - cut % 50]))
    except media.Broken:
        pass


def rewritten(buf, kind, at, fmt, *values):
    """A container with some numbers of a box replaced."""
    k = buf.index(kind) + 4 + at
    return buf[:k] + struct.pack(fmt, *values) + buf[k + struct.calcsize(fmt) :]


def test_counts_in_damaged_tables_ask_for_no_memory():
    buf, parts = media.mux(b"x" * 20_000, 0), media.mux(b"x" * 20_000, 2)
    hostile = [
        rewritten(buf, b"stsz", 4, ">II", 1, 0xFFFFFFF0), rewritten(buf, b"stsz", 4, ">II", 7, 3_000_000_000), rewritten(buf, b"stsc", 12, ">I", 0x7FFFFFFF),
        rewritten(buf, b"stsc", 8, ">I", 0xFFFFFFFF), rewritten(parts, b"trun", 0, ">II", 1, 0xFFFFFFF0), rewritten(buf, b"stts", 8, ">II", 0xFFFFFFFF, 0xFFFFFFFF),
    ]
    resource = pytest.importorskip("resource")
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    have = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (have + (1 << 30), hard))
    try:
        for x in hostile:
            try:
                assert sum(t["samples"] for t in media.tracks(x)) <= len(x)
            except media.Broken:
                pass
    finally:
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))
    for bad in hostile[:2] + hostile[4:5]:
        with pytest.raises(media.Broken):
            media.tracks(bad)


@settings(max_examples=300, deadline=None)
@given(number=st.integers(0, 2), at=st.integers(0, 4000), value=st.sampled_from([0, 1, 0x7FFFFFFF, 0xFFFFFFFF, 0xFFFFFFF0, 100_000]))
def test_any_rewritten_number_is_named_and_never_crashes(number, at, value):
    buf = media.mux(b"x" * 3000, number)
    at %= len(buf) - 4
    try:
        assert sum(t["samples"] for t in media.tracks(buf[:at] + struct.pack(">I", value) + buf[at + 4 :])) <= len(buf)
    except media.Broken:
        pass


def test_boxes_nest_to_any_depth():
    deep = b""
    for _ in range(3000):
        deep = media._box("udta", deep)
    assert media.tracks(media.mux(b"abc", 0) + deep)[0]["samples"] == 1


def test_media_with_compact_sizes():
    payload = b"ab" * 2600
    buf = media.mux(payload, 0)
    at = buf.index(b"stsz") - 4
    (length,) = struct.unpack_from(">I", buf, at)
    n = (length - 20) // 4
    sizes = struct.unpack_from(f">{n}I", buf, at + 20)
    small = media._full("stz2", "II", 16, n, rest=struct.pack(f">{n}H", *sizes))
    same = buf[:at] + small + media._box("free", bytes(length - len(small) - 8)) + buf[at + length :]
    assert media.tracks(same) == media.tracks(buf) and media.tracks(buf)[0]["samples"] == 11
    with pytest.raises(media.Broken):
        media.tracks(buf.replace(b"stsz", b"free"))
    for bits, rest in ((4, bytes([0x12, 0x3F, 0x50])), (8, bytes([1, 2, 3, 15, 5])), (16, struct.pack(">5H", 1, 2, 3, 15, 5))):
        box = media._full("stz2", "II", bits, 5, rest=rest)
        assert media._sizes(box, media._tree(box, 0, len(box))).tolist() == [1, 2, 3, 15, 5]


def test_media_on_awkward_rows(spark):
    good = media.mux(b"abc" * 900, 1)
    large = media._box("free") + media._full("uuid", "I", 1, rest=bytes(16)) + good
    rows = [(1, bytearray(good), "c"), (1, bytearray(good), "c"), (2, None, "c"), (3, bytearray(), "c"), (4, bytearray(b"not a file"), "c"), (None, bytearray(good), "c"), (5, bytearray(good[:-9]), "c"), (6, bytearray(large), "c")]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id bigint, data binary, codec string")).collect()
    assert sorted((r.doc_id or 0, r.problem is None) for r in got) == [(0, True), (1, True), (1, True), (4, False), (5, False), (6, True)]
    assert {r.samples for r in got if r.problem is None} == {6}
    assert all(r.codec is None and r.samples is None for r in got if r.problem)
    assert media.media_columns(spark.createDataFrame([], "doc_id bigint, data binary")).count() == 0
    pages = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "page_id bigint, html string")
    assert [(r.page_id, r.samples) for r in media.media_columns(media.muxed(pages, "page_id", "html"), "page_id").collect()] == [(2, 0)]


# pipeline


def test_stages_as_by_hand(spark):
    from test_dedup import jaccard, lines_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        before, after = docs.collect(), out.collect()
        rows[name] = after
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            assert {i for i, q in labels.items() if q} <= kept and not {i for i, q in labels.items() if not q} & kept
        elif name == "line_dedup":
            want = [(i, t) for i, t, _, _ in lines_by_hand([(r.doc_id, r.text) for r in before]) if t.strip()]
            assert sorted((r.doc_id, r.text) for r in after) == sorted(want) and all(r.n_chars == len(r.text) for r in after)
        elif name == "minhash_near_dedup":
            ids, texts = {r.doc_id for r in after}, {r.doc_id: r.text for r in before}
            gone = [r for r in before if r.doc_id not in ids]
            assert all(any(jaccard(r.text, texts[i]) > 0.4 for i in texts if i < r.doc_id) for r in gone)
            assert not any(jaccard(a.text, b.text) >= 0.7 for k, a in enumerate(after) for b in after[:k])
        else:
            want = due([(r.doc_id, r.text, r.source) for r in before])
            n = {}
            for r in after:
                n[(r.doc_id, r.source)] = n.get((r.doc_id, r.source), 0) + 1
            assert all(abs(n.get(k, 0) - v) < 1 for k, v in want.items()) and n.keys() <= want.keys()
        docs = spark.createDataFrame(after, out.schema)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("window_id").collect()
    assert [tuple(r) for r in got] == packed_by_hand([(r.doc_id, r.text) for r in after], packing.WINDOW, packing.END, True)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got))


def test_stages_take_awkward_rows(spark):
    df, rows = documents(spark, awkward()), awkward()
    out = {name: stage(spark, df, SF).collect() for name, stage in corpus_pipeline.STAGES}
    key = lambda got: sorted(((r[0], r[1]) for r in got), key=repr)
    model = quality.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    assert key(out["quality_classifier"]) == key([r for r, s in zip(rows, model.score(quality.features(pa.array([t for _, t, _ in rows])))) if s >= quality.LEAST])
    kept = key(out["line_dedup"])
    assert {i for i, _ in kept} == {1, 2, 6, 8, 10, 11, 12, 13} - {2} or {i for i, _ in kept} == {1, 6, 8, 10, 11, 12, 13}
    assert all((t or "").strip() for _, t in kept)
    near = key(out["minhash_near_dedup"])
    assert [i for i, _ in near if i is None] == [None, None] and {2, 7, 9}.isdisjoint({i for i, _ in near}) and {1, 3, 4, 5, 6, 8, 10, 12, 13} <= {i for i, _ in near}
    have = {(i, t) for i, t, _ in rows}
    assert set(key(out["source_mixing"])) <= have and any(i is None for i, _ in key(out["source_mixing"]))
    assert [tuple(r) for r in sorted(out["packing"], key=lambda r: r.window_id)] == packed_by_hand([(i, t) for i, t, _ in rows], packing.WINDOW, packing.END, True)


def test_stages_take_nothing(spark):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, documents(spark, []), SF)
        assert got.count() == 0 and (name == "packing" or got.columns == list(corpus_pipeline.COLUMNS))
