"""Near-duplicates, language, decontamination, language models, passages, WARC: brute force and edges."""

import collections
import gzip
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import decontam, language, lm, neardup, passages, warc

from cases import PASSAGE, ROWS, clashing, documents, folder


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def near_rows():
    """Groups of near copies around the threshold, one large, and exact copies in other case."""
    r, rows = random.Random(4), []
    for size, edits in ((40, 2), (5, 1), (6, 4), (3, 0), (8, 3)):
        base = [f"v{r.randrange(10**6)}" for _ in range(120)]
        rows += [edited(r, base, r.randint(0, edits)) for _ in range(size)]
    rows += [["a", "b"], ["A", "B"], ["a", "b", "c", "d", "e"], ["c"]]
    r.shuffle(rows)
    return [(100 + 3 * i, " ".join(w).upper() if i % 9 == 0 else " ".join(w), "en", "a") for i, w in enumerate(rows)]


def sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(s):
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 85 * (len(s[a]) + len(s[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in s}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, block):
    rows = near_rows()
    s = sets(rows)
    want = brute_components(s)
    got = neardup.near_duplicates(documents(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[i]), want[i], want[i] == i)


def test_long_sets_make_small_blocks(spark, monkeypatch):
    rows = near_rows()
    want = brute_components(sets(rows))
    monkeypatch.setattr(neardup, "WEIGHT", 200)
    monkeypatch.setattr(neardup, "SHARD_ROWS", 3)
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_edges(spark):
    got = neardup.near_duplicates(documents(spark)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[2][0]["component_id"] == 1 and not by[2][0]["kept"] and by[1][0]["kept"]
    assert by[3][0]["n_shingles"] == 0 and by[3][0]["kept"] and by[5][0]["component_id"] == 5
    assert by[11][0]["component_id"] == 10 and [r["component_id"] for r in by[9]] == [8, 8]
    assert sorted((r["component_id"], r["kept"]) for r in by[None] if r["n_shingles"]) == [(1, False)]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    out = neardup.without_near_duplicates(clashing(spark))
    assert out.columns == clashing(spark).columns and {r["doc_id"] for r in out.collect()} == {1, 3, 4, 5, None, 7, 8, 10, 12, 13}


def test_one_row_of_each_group_stays(spark):
    more = [(21, "one more text of its own here", "en", "a")] * 2 + [(None, "nameless text of six words here", "en", "a")] * 3 + [(None, "NAMELESS text of six words here", "en", "b"), (22, "", "en", "a"), (22, "", "en", "a")]
    got = collections.Counter((r["doc_id"], (r["text"] or "").lower()) for r in neardup.without_near_duplicates(documents(spark, [*ROWS, *more])).collect())
    assert got[21, more[0][1]] == 1 and got[None, more[2][1]] == 1 and got[22, ""] == 2
    again = [(x[0], x[1], x[2], f"s{i}") for i, x in enumerate([more[0]] * 40)]
    one = [neardup.without_near_duplicates(documents(spark, rows)).collect() for rows in (again, again[::-1])]
    assert len(one[0]) == 1 and one[0] == one[1]


def test_every_labelled_language_is_learned(spark):
    rows = [(i, "the cat sat on the mat and ate", "en", "a") for i in range(5)] + [(7, "der hund lief weit " * 200_000, "de", "a"), (8, "und der hund", "de", "a")]
    trees = language.train(documents(spark, rows), train_bytes=2000)
    assert trees.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(documents(spark, [(1, "der hund lief", None, "a"), (2, "the cat sat", None, "a")]), trees).collect()}
    assert got == {1: "de", 2: "en"}


def test_all_labelled_text_is_counted(spark):
    trees = language.train(documents(spark, [(1, "a" * 6_000_000, "en", "a"), (2, "b" * 10, "en", "a")]))
    cost = dict(zip(trees.keys[0].tolist(), trees.cost[0][:, 0].tolist(), strict=True))
    assert cost[ord("b")] == pytest.approx(math.log2((6_000_010 + 2) / 10), abs=1e-12)


def test_discounts_are_above_zero():
    assert lm.discounts([10, 1, 9, 50])[1:] == (0.5, 0.5) and all(0 < d <= k for d, k in zip(lm.discounts([900, 300, 100, 60]), (1, 2, 3), strict=True))


def test_counts_beyond_32_bits(spark):
    big = [lm._dealt(np.array([5], lm.U), [np.array([4_000_000_000], np.uint32)], 1, 0).column(2)[0].as_py()] * 2
    h, c = lm._summed(big, ["<u4"])
    assert h.tolist() == [5] and c[0].astype(np.uint64).tolist() == [8_000_000_000]


def test_pruning_keeps_similar_pairs():
    limits = neardup.bounds()
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 32, (1, neardup.HASHES), dtype=np.uint64).astype(np.uint32)
    def pair(p):
        b = np.where(r.random(neardup.HASHES) < p, a[0], a[0] + 1).astype(np.uint32)[None]
        return len(neardup.surviving(np.vstack([a, b]), np.array([0]), np.array([1]), limits)[0])
    assert sum(pair(0.85) for _ in range(300)) == 300
    assert sum(pair(0.4) for _ in range(300)) == 0


def test_code_lengths_are_those_of_the_trees(spark):
    texts = {"en": "the cat sat on the mat and the dog ate the hat " * 4, "de": "der hund und die katze sind in dem haus und der garten " * 4}
    trees = language.train(documents(spark, [(i, t, k, "a") for i, (k, t) in enumerate(texts.items())]))
    counts = {k: [collections.Counter() for _ in range(4)] for k in texts}
    for k, t in texts.items():
        b = language.START + t.encode().translate(language.FOLD)
        for i in range(3, len(b)):
            for o in range(4):
                counts[k][o][b[i - o : i + 1]] += 1

    def bits(k, ctx, sym):
        total = 0.0
        for o in range(3, -1, -1):
            c = ctx[3 - o :]
            seen = {g[-1]: n for g, n in counts[k][o].items() if g[:-1] == c}
            n, d = sum(seen.values()), len(seen)
            if n and sym in seen:
                return total + math.log2((n + d) / seen[sym])
            if n:
                total += math.log2((n + d) / d)
        return total + 8

    probe = language.START + "the hund qx was".encode().translate(language.FOLD)
    got = trees.lengths(language.grams(probe[3:]))
    for i in range(3, len(probe)):
        for j, k in enumerate(trees.langs):
            assert got[i - 3, j] / language.UNIT == pytest.approx(bits(k, probe[i - 3 : i], probe[i]), abs=2e-3)


def test_language_held_out_accuracy(spark, sf):
    got = language.op3_language(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert right >= 0.97 * n


def test_language_edges(spark):
    trees = language.train(documents(spark))
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identified(clashing(spark), trees).collect()}
    assert got[3] == got[4] == got[5] == got[12] == ("und", 0.0) and got[13][0] == "es"
    assert language.identified(documents(spark, []), trees).count() == 0
    nothing = language.train(documents(spark, [(1, "abc", None, "a")]))
    assert language.identified(documents(spark), nothing).filter("lang_pred <> 'und'").count() == 0


def test_decontamination(spark):
    r = random.Random(7)
    words = [f"t{i}o" for i in range(3000)] + ["the", "of", "and"] * 300
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(12, 50)))) for i in range(30)]
    rows, want = [], set()
    for i in range(120):
        ws = prose(r.randint(60, 400))
        if i % 4 == 0:
            k = i % 30
            own = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: one word in five is another
                own = [w if j % 5 else "other" for j, w in enumerate(own)]
            at = r.randrange(len(ws))
            ws[at:at] = own
            want.add((i, k))
        rows.append((i, " ".join(ws), "en", "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(documents(spark, rows), bench).collect()}
    assert got == want
    left = {x["doc_id"] for x in decontam.without_benchmark(documents(spark, rows), bench).collect()}
    assert left == set(range(120)) - {i for i, _ in want}


def test_short_items_amid_unique_words(spark):
    """Verbatim copies between words seen once in a large corpus are found, whatever these weigh."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(150)]
    items = [(i, " ".join(r.sample(common, r.choice((15, 27, 40))))) for i in range(20)]
    rows = [(i, " ".join(r.choice(common) for _ in range(40)), "en", "a") for i in range(3000)]
    for i, text in items:
        rows.append((10_000 + i, " ".join([f"u{i}x{j}" for j in range(60)] + [text] + [f"u{i}y{j}" for j in range(60)]), "en", "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(documents(spark, rows), bench).collect()}
    assert {(10_000 + i, i) for i, _ in items} <= got and not {d for d, _ in got if d < 10_000}


def planted(r, items, docs, share, kept=3):
    """One copy of each item in a document of its own, ``share`` of its words replaced by words of documents, some rare ones spared."""
    pool = [w for t in docs for w in t.split()]
    count = collections.Counter(w for t in docs for w in set(t.split()))
    rows = []
    for i, t in items:
        ws = t.split()
        spared = set(sorted(range(len(ws)), key=lambda k: count[ws[k]])[:kept])
        at = r.sample([k for k in range(len(ws)) if k not in spared], min(round(share * len(ws)), len(ws) - len(spared)))
        for k in at:
            ws[k] = r.choice(pool)
        around = [r.choice(pool) for _ in range(120)]
        rows.append((10**6 + i, " ".join([*around[:60], *ws, *around[60:]]), "en", "a"))
    return rows


def exhaustive(rows, items, answers):
    """Every item against every stretch of twice its length and more of every text, by the same bars."""
    kinds = collections.Counter(w for _, ws in items for w in set(ws))
    rarity = {w: math.log((1 + len(items)) / (1 + n)) + 0.1 for w, n in kinds.items()}
    found = set()
    for d, t, *_ in rows:
        h = decontam.term_hashes([(t or "").encode()])[0].tolist()
        for (i, ws), answer in zip(items, answers, strict=True):
            n, own = len(ws), set(ws)
            at = decontam._positions(ws)
            for a in range(0, max(1, len(h) - 3 * n + 1), max(1, n // 2)):
                part = h[a : a + 3 * n]
                if sum(w in own for w in part) >= decontam.PARAPHRASE * n:
                    share, there = decontam.lcs(at, n, part) / n, set(part)
                    told = answer <= there if answer else sum(rarity[w] for w in own & there) >= decontam.ANSWER * sum(rarity[w] for w in own)
                    if share >= decontam.SURE or share >= decontam.PARAPHRASE and told:
                        found.add((d, i))
                        break
    return found


@pytest.mark.parametrize("answered", [False, True])
def test_paraphrases_equal_exhaustive_search(spark, sf, answered):
    """Recall against the exhaustive search at three rates of replaced words, and nothing beyond it in the corpus."""
    r = random.Random(17)
    bench = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(x["doc_id"], x["text"], "en", "a") for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [t for _, t, *_ in docs if t]
    items = [(i, decontam.term_hashes([t.encode()])[0].tolist()) for i, t in bench]
    count = collections.Counter(w for t in texts for w in set(t.split()))
    told = [" ".join(sorted(t.split(), key=lambda w: count[w])[:3]) if answered else None for _, t in bench]
    answers = [set(decontam.term_hashes([(a or "").encode()])[0].tolist()) for a in told]
    table = spark.createDataFrame([(i, t, a) for (i, t), a in zip(bench, told, strict=True)], "item_id bigint, text string, answer string")
    for share in (0.25, 0.35, 0.42):
        rows = planted(r, bench, texts, share)
        want = exhaustive(rows, items, answers)
        got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(documents(spark, docs + rows), table if answered else table.drop("answer")).collect()}
        own = {(10**6 + i, i) for i, _ in bench}
        assert len(got & own) >= 0.9 * len(own), (share, len(got & own))
        assert len(got & want) >= 0.95 * len(want)
        clean = {(d, i) for d, i in got if d < 10**6}
        assert clean <= exhaustive([x for x in docs if x[0] in {d for d, _ in clean}], items, answers)


def test_answer_must_be_there(spark):
    ws = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(ws), "q39"), (2, "", "q1")], "item_id bigint, text string, answer string")
    part = [w if i % 5 < 3 else f"x{i}" for i, w in enumerate(ws)]
    rows = [(1, " ".join(part), "en", "a"), (2, " ".join([*part[:39], "q39"]), "en", "a")]
    rows += [(9 + i, f"other words of no item {i}", "en", "a") for i in range(60)]
    assert [tuple(x)[:2] for x in decontam.contaminated(documents(spark, rows), bench).collect()] == [(2, 1)]
    assert sorted(tuple(x)[:2] for x in decontam.contaminated(documents(spark, rows), bench.drop("answer")).collect()) == [(1, 1), (2, 1)]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, " ")], "item_id bigint, text string")
    assert sorted(tuple(x)[:2] for x in decontam.contaminated(documents(spark), bench).collect()) == [(8, 1), (9, 1)]
    assert decontam.contaminated(documents(spark), bench.limit(0)).count() == 0
    assert decontam.contaminated(documents(spark, []), bench).count() == 0
    out = decontam.without_benchmark(clashing(spark), bench)
    assert out.columns == clashing(spark).columns and out.count() == len(ROWS) - 3


def test_svd_finds_the_space(spark):
    r = np.random.default_rng(0)
    a = r.standard_normal((200, 4)) @ r.standard_normal((4, 30))
    df = spark.createDataFrame([(list(range(30)), x.tolist()) for x in a], "ids array<int>, v array<double>").repartition(3)
    v = decontam.latent_space(df, 30, 4)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6)


def test_lcs_equals_table():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd").encode() for _ in range(r.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(decontam._positions(a), len(a), b) == t[-1][-1]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_definition(spark, order):
    r = random.Random(order)
    rows = [*ROWS, *[(100 + i, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 60))), "en", "a") for i in range(40)], (200, "one two three " * 400, "en", "a")]
    tok = [(x[1] or "").encode().lower().split() + [lm.END] for x in rows]
    n, uni = sum(map(len, tok)), collections.Counter(w for t in tok for w in t)

    def grams(k):
        return (tuple(([lm.BEGIN] * (k - 1) + t)[i : i + k]) for t in tok for i in range(len(t)))

    counts = [collections.Counter(grams(order))]
    while len(next(iter(counts[0]))) > 1:
        counts.insert(0, collections.Counter(g[1:] for g in counts[0]))
    ds = [lm.discounts([sum(k == j for k in c.values()) for j in (1, 2, 3, 4)]) for c in counts]
    ctx, fol = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for c in counts:
        for g, k in c.items():
            ctx[g[:-1]] += k
            fol[g[:-1]][min(k, 3) - 1] += 1

    def p(g):
        if not g:
            return 1 / (len(uni) + 1)
        low, k, d = p(g[1:]), counts[len(g) - 1][g], ds[len(g) - 1]
        if not ctx[g[:-1]]:
            return low
        return (max(k - d[min(k, 3) - 1], 0) / ctx[g[:-1]] if k else 0) + sum(a * b for a, b in zip(d, fol[g[:-1]], strict=True)) / ctx[g[:-1]] * low

    model = lm.train(documents(spark, rows), order=order)
    probe = [*rows, (99, "never seen the quick words", "en", "a"), (98, "b a unseen c d one two one two three", "en", "a")]
    got = lm.scored(documents(spark, probe).select("doc_id", "text", F.xxhash64("text").alias("h")), model).collect()
    want = collections.Counter()
    for x in probe:
        t = (x[1] or "").encode().lower().split() + [lm.END]
        padded = [lm.BEGIN] * (order - 1) + t
        want[len(t), round(sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in t), 4), round(sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(t))), 4)] += 1
    assert collections.Counter((r["n_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == want
    seen = (b"a", b"b")[: order - 1]
    assert sum(p((*seen, w)) for w in uni) + p((*seen, b"-")) == pytest.approx(1)


def test_lm_edges(spark):
    assert lm.scored(documents(spark), lm.train(documents(spark, []), order=3)).count() == len(ROWS)
    none = lm.train(documents(spark, []))
    got = lm.scored(documents(spark), none).collect()
    assert len(got) == len(ROWS) and {(r["base_score"], r["n_known"]) for r in got} == {(0.0, 0)}
    model = lm.train(clashing(spark))
    assert lm.scored(documents(spark, []), model).count() == 0
    assert lm.scored(clashing(spark), model).count() == len(ROWS)


def stripped(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("width", [35, 3])
def test_passages(spark, width):
    rows = [*ROWS, (30, "a b a b a b a b", "en", "a"), (31, PASSAGE + " " + PASSAGE, "en", "a")]
    got = passages.without_repeats(documents(spark, rows).withColumn("kept", F.lit(1)), width=width).collect()
    have = collections.Counter((r["n_words"], r["n_removed"], r["text"] or "") for r in got)
    assert have == collections.Counter(stripped([x[1] for x in rows], width))
    assert passages.without_repeats(documents(spark, [])).count() == 0


def test_sketch_never_undercounts(spark):
    rows = [(i, " ".join(f"q{(i // 2) * 100 + k}" for k in range(60)), "en", "a") for i in range(60)]
    assert {r["n_removed"] for r in passages.without_repeats(documents(spark, rows), block=8).collect()} == {60}


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 2000
    rows = [(1, "u\r\n x", None), (None, None, big), (3, "http://a", big), (3, "http://a", big), (2, "b", big), (9, "c", "x"), (8, "d", "x"), (-5, "e", "<p>\r\n\r\n</p>" * 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit(1))
    for name in ("one", "two"):
        warc.write_archives(pages.repartition(3), str(tmp_path / name), shard_bytes=2000, roll_bytes=900)
    got = warc.read_archives(spark, str(tmp_path / "one")).collect()
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == collections.Counter(
        [(1, "response", None, 0), (None, "revisit", 3, 4000), (3, "response", None, 4000), (3, "response", None, 4000), (2, "revisit", 3, 4000), (9, "response", None, 1), (8, "response", None, 1), (-5, "response", None, 3300)]
    )
    assert {r["html"] for r in got if r["page_id"] == -5} == {rows[-1][2]}
    files = {n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.gz")} for n in ("one", "two")}
    assert files["one"] == files["two"] and len(files["one"]) > 3
    assert gzip.decompress(next(iter(files["one"].values()))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not [p for p in (tmp_path / "one").iterdir() if p.name.endswith(".tmp")]
    with pytest.raises(FileExistsError):
        warc.write_archives(pages.filter("page_id = 2"), str(tmp_path / "one"))
    (tmp_path / "three" / ".manifest.0.tmp").mkdir(parents=True)
    warc.write_archives(pages, str(tmp_path / "three"), shard_bytes=2000, roll_bytes=900)
    assert warc.read_archives(spark, str(tmp_path / "three")).count() == len(rows)
    empty = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_an_id_of_many_rows_fills_several_shards(spark, tmp_path):
    rows = [(None, None, f"{i % 60:04d}" * 400) for i in range(120)] + [(i, "u", f"{i:04d}" * 400) for i in range(50, 70)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "a"), shard_bytes=8000).collect()
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    most = max(r["records"] for r in files)
    assert most < 40 and sum(r["records"] for r in files) == len(got) == 140
    assert all(r["record_type"] == "response" for r in got if r["page_id"] is not None)
    nameless = collections.Counter((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None)
    assert nameless == {("response", None): 100, **{("revisit", i): 2 for i in range(50, 60)}}


def test_learning_sides_follow_the_key(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", language.remainder(F.col("doc_id"), 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in rows)


def test_queries_run_on_awkward_tables(spark, tmp_path):
    d = folder(spark, tmp_path, benchmark=spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string"))
    for q in (neardup.op2_neardup, language.op3_language, lm.op7_lm, passages.op8_passages):
        assert q(spark, d).count() == len(ROWS)
    assert decontam.op4_decontam(spark, d).count() == 2
