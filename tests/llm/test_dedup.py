"""Line, near, passage and embedding dedup against brute force, and on awkward rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents, edited, prose
from quillstone.llm import embedding_dedup, fuzzy_dedup, line_dedup, near_dedup, suffix_dedup
from quillstone.llm._components import components, label


def grouped(pairs, nodes):
    at = {n: i for i, n in enumerate(sorted(nodes))}
    root = label(np.array([at[a] for a, _ in pairs], int), np.array([at[b] for _, b in pairs], int), len(at))
    return {n: sorted(nodes)[root[i]] for n, i in at.items()}


# components


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components_of_random_graphs(spark, bound):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs + [(None, 1)], "a bigint, b bigint"), bound).collect()}
    assert got == grouped(pairs, {x for p in pairs for x in p})


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).count() == components(none, 0).count() == 0


# line dedup


WHITE = " \t\n\v\f\r"


def lines_by_hand(rows):
    """(doc_id, text, lines in, lines out) of each row."""
    order = sorted(set((i is None, i or 0, t) for i, t in rows if t is not None))
    first = {}
    for none, i, t in order:
        for k, x in enumerate(t.split("\n")):
            if x.strip(WHITE):
                first.setdefault(x, (none, i, t, k))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip(WHITE) or first[x] == (i is None, i or 0, t, k)]
        out.append((i, "\n".join(kept), len(t.split("\n")), len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_mb", [256, 0])
def test_line_dedup_as_by_hand(spark, filter_mb):
    rng = np.random.default_rng(8)
    pool = [prose(rng, 3) for _ in range(40)] + ["", "  ", "\u00a0", "\r", "é\x1f"]
    rows = awkward() + [(100 + i, "\n".join(rng.choice(pool, rng.integers(1, 9))), "z") for i in range(60)]
    got = line_dedup.dedup_lines(documents(spark, rows), filter_mb=filter_mb)
    assert sorted(((r.doc_id, r.text, r.lines_in, r.lines_out) for r in got.collect()), key=repr) == lines_by_hand([(i, t) for i, t, _ in rows])
    assert {r.group_id for r in got.collect()} == {"g"} and set(got.columns) >= {"key", "lines", "seal", "h1"}


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c\nd e f", "s"), (1, "x y z\na b c", "s"), (2, "d e f\nx y z\nnew", "s")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert sum(t.count("a b c") for _, t in got) == sum(t.count("d e f") for _, t in got) == 1 and (2, "new") in got


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# near dedup


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    for size, share in itertools.product((5, 40, 700, 3000), (0.2, 0.6, 0.9)):
        both = rng.integers(0, 2**63, size, dtype=np.uint64)
        errors = []
        for _ in range(12):
            other = np.where(rng.random(size) < share, both, rng.integers(0, 2**63, size, dtype=np.uint64))
            sig = near_dedup.superminhash(np.concatenate([both, other]), np.repeat([0, 1], size), 2)
            true = len(set(both.tolist()) & set(other.tolist())) / len(set(both.tolist()) | set(other.tolist()))
            errors.append((sig[0] == sig[1]).mean() - true)
            both = rng.permutation(both)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.06


def test_superminhash_depends_on_the_set_alone():
    items = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    again = np.concatenate([items[::-1], items[:50]])
    sig = near_dedup.superminhash(np.concatenate([items, again]), np.repeat([0, 1], [len(items), len(again)]), 2)
    assert (sig[0] == sig[1]).all()


def test_near_groups_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        t = prose(rng, int(rng.integers(30, 400)))
        rows.append((len(rows), t, "s"))
        rows += [(len(rows) + j, edited(rng, t, rng.choice([0, 0.01, 0.03])), "s") for j in range(int(rng.integers(0, 6)))]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    pairs = [(a, b) for (a, x, _), (b, y, _) in itertools.combinations(rows, 2) if jaccard(x, y) >= near_dedup.THRESHOLD]
    want = grouped(pairs, {r[0] for r in rows})
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(documents(spark, rows)).collect()}
    hit = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    assert hit >= 0.97 and all(want[i] == want[g] for i, g in got.items())


def test_every_pair_of_a_bucket_is_compared():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 60000, 128)
    rows = [base]
    for _ in range(40):  # a walk: neighbours are near, the ends are not
        step = rows[-1].copy()
        step[rng.choice(128, 20, replace=False)] = rng.integers(0, 60000, 20)
        rows.append(step)
    sig = np.array(rows, np.uint16)[rng.permutation(41)]
    a, b = near_dedup.link(sig, 0.8)
    assert len(set(label(a, b, 41))) == 1


def test_near_groups_on_awkward_rows(spark):
    got = {r.doc_id: (r.group_id, r.keep) for r in near_dedup.near_groups(documents(spark, awkward())).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 0) and got[7] == (6, 0) and got[9] == (8, 0)
    assert all(got[i] == (i, 1) for i in (3, 4, 5, 12, 13)) and None not in got and len(got) == 13
    assert near_dedup.near_groups(documents(spark, [])).count() == 0


# passages


def test_suffix_array_and_prefixes_as_by_hand():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(0, 50))
        s = rng.integers(1, int(rng.integers(2, 9)), n)
        want = sorted(range(n), key=lambda i: list(s[i:]))
        sa = suffix_dedup.suffix_array(s)
        assert list(sa) == want

        def shared(a, b):
            k = 0
            while a + k < n and b + k < n and s[a + k] == s[b + k]:
                k += 1
            return k

        lcp = suffix_dedup.common_prefixes(s, sa)
        assert list(lcp) == [shared(want[i - 1], want[i]) if i else 0 for i in range(n)]
        if n:
            own = rng.integers(0, 3, n)
            assert list(suffix_dedup._other(lcp, own[sa])) == [max([shared(i, j) for j in range(n) if own[j] != own[i]], default=0) for i in want]


def ranges_by_hand(rows, least):
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for i, t in rows:
        w, open_ = (t or "").split(), None
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                if open_ and k <= open_[1]:
                    open_[1] = k + least
                else:
                    if open_:
                        out.add((i, *open_))
                    open_ = [k, k + least]
        if open_:
            out.add((i, *open_))
    return out


def passages(rng, n=60):
    shared = [prose(rng, int(k)) for k in rng.integers(22, 160, 12)]
    rows = []
    for i in range(n):
        parts = [prose(rng, int(rng.integers(0, 80)))]
        for k in rng.choice(12, int(rng.integers(0, 4))):
            p = shared[k].split(" ")
            cut = int(rng.integers(0, 20))
            parts += [" ".join(p[cut:]) if rng.random() < 0.5 else shared[k], prose(rng, int(rng.integers(0, 40)))]
        rows.append((i, "\n".join(parts), "s"))
    return rows


def test_suffix_arrays_of_long_texts():
    rng = np.random.default_rng(2)
    for s in (rng.integers(0, 3, 20_000), np.tile(rng.integers(0, 5, 40), 300), np.zeros(5000, int), np.concatenate([np.tile(rng.integers(0, 9, 90), 40), np.arange(3000)])):
        order = np.zeros(len(s), np.int64)  # prefix doubling
        rank, width = np.unique(s, return_inverse=True)[1] + 1, 1
        while width < 2 * len(s):
            after = np.concatenate([rank[width:], np.zeros(min(width, len(s)), np.int64)])
            order = np.lexsort((after, rank))
            new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])])
            rank = np.empty(len(s), np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        assert (suffix_dedup.suffix_array(s) == order).all()


@pytest.mark.parametrize(("shard", "hot"), [(1 << 20, 256), (500, 256), (1 << 20, 2), (500, 1)])
def test_repeats_as_by_brute_force(spark, shard, hot):
    rows = [r for r in passages(np.random.default_rng(9)) + [(900, "z " * 300, "s"), (901, "z " * 120, "s")] + [(1000 + (i or 0), t, s) for i, t, s in awkward() if i is not None]]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeats(documents(spark, rows + [(None, rows[0][1], "s")]), least=24, shard=shard, hot=hot).collect()}
    assert got == ranges_by_hand([(i, t) for i, t, _ in rows], 24)
    assert suffix_dedup.repeats(documents(spark, [])).count() == 0


def test_chains_are_the_best_ones():
    rng = np.random.default_rng(7)
    for _ in range(60):
        runs = np.stack([rng.integers(0, 200, 9), rng.integers(0, 200, 9), rng.integers(8, 30, 9)], 1)

        def score(path):
            total = int(runs[path[0]][2])
            for x, y in zip(path, path[1:]):
                (b0, a0, n), (b1, a1, m) = runs[x], runs[y]
                if b0 + n > b1 or a0 + n > a1:
                    return -1
                total += m - fuzzy_dedup.GAP * ((b1 - b0 - n) + (a1 - a0 - n))
            return total

        best = max(score(p) for k in range(1, 5) for p in itertools.permutations(range(9), k))
        assert score(fuzzy_dedup.chain(runs)[0]) >= best - 1e-9


def test_fuzzy_passages_are_found(spark):
    rng = np.random.default_rng(12)
    shared = [prose(rng, 90) for _ in range(8)]
    rows, planted = [], set()
    for i in range(48):
        body = prose(rng, 60)
        if i % 6:
            body += " " + edited(rng, shared[i % 8], 0.03) + " " + prose(rng, 50)
            planted.add(i)
        rows.append((i, body, "s"))
    got = fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect()
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    assert found <= planted and len(found) >= 0.9 * len(planted)
    for r in got:
        assert r.doc_id % 8 == r.other_id % 8 and 50 <= r.end_word - r.start_word <= 100 and r.identity >= 0.75 and r.start_word >= 55


def test_fuzzy_passages_cover_exact_repeats(spark):
    rows = passages(np.random.default_rng(21), 120)
    want = ranges_by_hand([(i, t) for i, t, _ in rows], 50)
    held = {}
    for r in fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect():
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        held.setdefault(r.other_id, set()).update(range(r.other_start, r.other_end))
    total = sum(e - s for _, s, e in want)
    assert sum(len(held.get(i, set()) & set(range(s, e))) for i, s, e in want) >= 0.95 * total


def test_fuzzy_passages_between_excerpts(spark):
    """Every pair of documents that hold a passage, with many others before and between them that quote parts of it."""
    rng = np.random.default_rng(8)
    shared = prose(rng, 200).split(" ")
    whole = {0: 0, 150: 0, 301: 0, 302: 30}
    rows = []
    for i in range(-60, 303):
        cut = rng.integers(0, 161)
        own = shared[whole[i] :] if i in whole else shared[cut : cut + 40]
        rows.append((i, " ".join([prose(rng, 30), *own, prose(rng, 30)]), "s"))
    got = {(r.doc_id, r.other_id): r.end_word - r.start_word for r in fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect()}
    for b, a in itertools.combinations(sorted(whole, reverse=True), 2):
        assert got.get((b, a), 0) >= 165


def agree(x, y, least=50, identity=0.75):
    """Whether two texts have a passage along some diagonal, by trying every one that begins and ends with an agreeing word."""
    x, y = np.array(x.split(" ")), np.array(y.split(" "))
    for d in range(-len(y) + least, len(x) - least + 1):
        n = min(len(x) - max(d, 0), len(y) + min(d, 0))
        same = np.flatnonzero(x[max(d, 0) :][:n] == y[max(-d, 0) :][:n])
        if len(same) >= identity * least:
            size, hits = same[None, :] - same[:, None] + 1, np.arange(len(same))[None, :] - np.arange(len(same))[:, None] + 1
            if ((size >= least) & (hits >= identity * size)).any():
                return True
    return False


def test_fuzzy_passages_with_many_edits(spark):
    rng = np.random.default_rng(33)
    rows, cases = [], {}
    for share in (0.05, 0.1, 0.15, 0.2):
        for n in (50, 60, 80, 100):
            for _ in range(25):
                p, i = prose(rng, n), len(rows)
                rows += [(i + k, " ".join([prose(rng, 40), t, prose(rng, 40)]), "s") for k, t in enumerate((p, edited(rng, p, share)))]
                if agree(rows[i][1], rows[i + 1][1]):
                    cases.setdefault((share, n), set()).add((i + 1, i))
    got = {(r.doc_id, r.other_id) for r in fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect()}
    for share in (0.05, 0.1, 0.15, 0.2):
        want = set().union(*(v for (e, _), v in cases.items() if e == share))
        assert len(want) >= 60 and len(want & got) >= 0.9 * len(want)
    assert all(b == a + 1 and a % 2 == 0 for b, a in got)


def test_fuzzy_passages_among_documents_of_a_hot_line(spark):
    """Many documents hold a line too short for a passage; some two go on alike, with an edit every four words."""
    rng = np.random.default_rng(44)
    line, pairs = prose(rng, 34), {(130, 20), (47, 31), (149, 90)}
    tails = {i: t for pair in sorted(pairs) for t in [prose(rng, 20).split(" ")] for i in pair}
    rows = []
    for i in range(150):
        tail = [f"y{i}-{k}" if k % 4 == 3 else w for k, w in enumerate(tails.get(i, prose(rng, 20).split(" ")))]
        rows.append((i, " ".join([prose(rng, 40), line, *tail, prose(rng, 40)]), "s"))
    got = fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == pairs
    assert len({r.class_id for r in got}) == 3 and all(r.class_id.split(":")[0] == str(r.other_id) for r in got)


def test_fuzzy_passages_beside_runs_of_one_word(spark, monkeypatch):
    """Many documents repeat one word 15 to 23 times, too few for a passage: those with nothing else in common aren't aligned
    in pairs.  Some two go on alike or begin alike; one has the word on both sides, and a long run holds it all."""
    rng = np.random.default_rng(45)
    after, before = {(50, 20), (33, 7), (59, 58)}, {(48, 31), (13, 11)}
    alike = [{i: t for pair in sorted(pairs) for t in [prose(rng, 40).split(" ")] for i in pair} for pairs in (before, after)]
    rows = []
    for i in range(60):
        left, right = (" ".join(f"y{i}-{k}" if k % 4 == 3 else w for k, w in enumerate(x.get(i, prose(rng, 40).split(" ")))) for x in alike)
        run = "zz " * (60 if i == 12 else 15 + i % 9)
        if i == 40:
            run = "zz zz zz x1 " * 6 + "zz " * 15 + "x2 zz zz zz " * 6
        rows.append((i, f"{prose(rng, 30)} {left} {run}{right} {prose(rng, 30)}", "s"))
    aligned, save = [], fuzzy_dedup.save

    def counted(df, name):
        out = save(df, name)
        if name == "chains":
            aligned.append(out.select("b", "a").distinct().count())
        return out

    monkeypatch.setattr(fuzzy_dedup, "save", counted)
    got = fuzzy_dedup.fuzzy_passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == after | before | {(40, 12)}
    assert len(got) <= 20 and aligned[1] <= 30  # of 1,770 pairs


def test_common_words_and_stretches_as_by_hand():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x, y = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in range(2))
        got = fuzzy_dedup.common(x, y)
        want = max(k for k in range(len(x) + 1) if any(all(c in it for c in sub) for sub in itertools.combinations(x, k) for it in [iter(y)]))
        assert len(got) == want and all(x[i] == y[j] for i, j in got) and all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
    b = np.concatenate([np.arange(60), np.arange(100, 160), np.arange(400, 430)])
    assert sorted(fuzzy_dedup.stretches(b, b, 50, 0.75)) == [(0, 120)] and sorted(fuzzy_dedup.stretches(b, b, 50, 0.9)) == [(0, 60), (60, 120)]


def test_fuzzy_passages_on_awkward_rows(spark):
    got = {(r.doc_id, r.other_id) for r in fuzzy_dedup.fuzzy_passages(documents(spark, awkward())).collect()}
    assert (2, 1) in got and (7, 6) in got and got <= {(2, 1), (7, 6), (11, 10)}
    assert fuzzy_dedup.fuzzy_passages(documents(spark, [])).count() == 0


# embeddings


@pytest.mark.parametrize("share", [40_000, 150])
def test_embedding_groups_as_by_brute_force(spark, share):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((700, 48))
    for i in range(300):
        x[700 - 1 - i] = x[rng.integers(0, 300)] + rng.standard_normal(48) * rng.choice([0.0, 0.1, 0.3])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    pairs = [(a, b) for a, b in zip(*np.nonzero(sims >= 0.9)) if a < b]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, keep string")
    got = {r.vec_id: r.group_id for r in embedding_dedup.embedding_groups(df, share=share, leaf=32).collect()}
    want = grouped(pairs, set(range(700)))
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs) and all(want[i] == want[g] for i, g in got.items())


@pytest.mark.parametrize("sample_mb", [64, 1])
def test_embedding_recall_through_upper_levels(spark, sample_mb):
    """Pairs of a cosine of about 0.9 to 0.95, apart by routing (64 shares) as well as within shares; brute force knows them."""
    rng = np.random.default_rng(41)
    x = rng.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:600] + rng.standard_normal((600, 32)) * (0.42 / np.sqrt(32))
    every = np.concatenate([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    want = {(i, 12_000 + i) for i in range(600) if every[i] @ every[12_000 + i] >= 0.9}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.group_id for r in embedding_dedup.embedding_groups(df, share=200, leaf=64, sample_mb=sample_mb).collect()}
    hit = sum(got[a] == got[b] for a, b in want) / len(want)
    assert len(want) > 200 and hit >= 0.95


@pytest.mark.parametrize("share", [40_000, 20])
def test_embedding_groups_of_two_lengths(spark, share):
    rng = np.random.default_rng(15)
    rows = []
    for dim, n in ((8, 60), (5, 40)):
        for _ in range(n):
            v = rng.standard_normal(dim)
            rows += [(len(rows), v.tolist()), (len(rows) + 1, v.tolist()), (len(rows) + 2, (v + 0.01).tolist())]
    got = {r.vec_id: r.group_id for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), share=share, leaf=16).collect()}
    assert all(got[i] == got[i - i % 3] for i in got) and all((got[i] < 180) == (i < 180) for i in got) and len(got) == 300


def test_embedding_groups_on_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, v), (10, [2.0, 4.0, 6.0])]
    got = {r.vec_id: (r.group_id, r.keep) for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 10: (1, 0)} | {i: (i, 1) for i in range(3, 10)}
    copies = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0) + (F.col("id") % 2) * 1e-4, F.lit(2.0)).alias("embedding"))
    assert {r.group_id for r in embedding_dedup.embedding_groups(copies, leaf=16).collect()} == {0}
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
