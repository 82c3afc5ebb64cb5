"""Every pair feature, and the reference features, against a plain implementation a pair at a time."""

import math

import numpy as np
import plain as p
import pytest
from pyspark.sql import functions as F

from kinlink.functions import constants as K
from kinlink.functions import kernels as P
from kinlink.functions import text as X
from kinlink.operators import blocking as B
from kinlink.operators import features, models, retrieval
from kinlink.plans import baseline

SCHEMA = "entity_id string, business_name string, business_address string, country string"
S1 = [
    ("S1-1", "Tata Steel Pvt Ltd", "12/4 Main Road, Pune 411001 Maharashtra", "India"), ("S1-2", "École Française SARL", "7 rue de l'Est 75001", "France"),
    ("S1-3", "Steel Tata Trading", "124 Main Street Pune 411001", "India"), ("S1-4", "x Box 0156 Philips", "", "India"), ("S1-5", "Tata Steel", "no 9", "India"),
]
TARGETS = [
    ("S2-1", "टाटा स्टील", "12 Main Rd, Pune 411001 MH", "India"), ("S3-1", "Tata Stele Private Limited", "", "India"), ("S2-2", "Ecole Francaise", "7 Rue de l Est 75002", "France"),
    ("S3-3", "Steel Enterprises", "1240 Main St, Pune 411002", "India"), ("S2-4", "Filips xbox", "00012 main road", "India"), ("S2-9", "", "", "India"), ("S3-7", "tata steel", "12 Main Road Pune 411001", "India"),
]


def record(r):
    _, n, a, _ = r
    low = str.maketrans(K.UPPER, K.LOWER)
    core, addr, roman = p.core_words(n), p.address_words(a), p.core_words(p.romanize(n))
    num = lambda v: [t for t in v if t.isascii() and t.isdigit()]
    runs = sorted({x.lstrip("0") or "0" for x in p.re.findall("[0-9]+", a)})
    first = p.re.search("[0-9]+", a)
    return {
        "nw": p.words(n), "aw": p.words(a), "core": core, "addr": addr, "nc": p.compact(n.translate(low)), "ac": p.compact(a.translate(low)), "cc": p.compact(" ".join(core)), "aj": " ".join(addr),
        "first": (first[0].lstrip("0") or "0") if first else "", "indic": any("ऀ" <= c <= "෿" for c in n), "core_n": "".join(w + "|" for w in p.words(n) if w not in K.LEGAL), "a": a,
        "nums": num(addr), "al": [t for t in addr if t not in num(addr)], "postal": [t for t in num(addr) if len(t) in (5, 6)], "ini": "".join(w[0] for w in core), "roman": roman, "sound": p.sound_words(n),
        "rc": p.compact(" ".join(roman)), "digits": runs, "mixed": [w for w in p.words(a) if any(c in "0123456789" for c in w)], "ra": p.address_words(p.romanize(a)),
    }


def eq(a, b):
    return float(a == b and len(a) > 0)


def ratio(a, b):
    x, y = len(a.encode()), len(b.encode())
    return min(x, y) / max(x, y) if max(x, y) else 0.0


def inside(a, b, least=3):
    return float(min(len(a.encode()), len(b.encode())) >= least and (a in b or b in a))


def vector(q, t, tid, score, rank, frequency):
    edit, fuzzy = P.edit_similarity, P.fuzzy_overlap
    nd, ad, no, ao = p.dice(q["nc"], t["nc"], 3), p.dice(q["ac"], t["ac"], 3), p.overlap(q["nw"], t["nw"]), p.overlap(q["aw"], t["aw"])
    digit = lambda v: [w for w in v if w[0] in "0123456789" and len(w.encode()) >= 2]
    both, sx = q["first"] != "" and t["first"] != "", float(q["indic"] != t["indic"])
    out = [1, nd, no, p.jaccard(q["nw"], t["nw"]), ad, ao, p.jaccard(q["aw"], t["aw"]), p.overlap(digit(q["aw"]), digit(t["aw"])), inside(q["nc"], t["nc"], 6), nd * ad, no * ao, max(nd, ad), min(nd, ad),
           eq(q["nc"], t["nc"]), eq(q["core_n"], t["core_n"]), float(t["a"] == ""), float(both and q["first"] == t["first"]), float(both and q["first"] != t["first"]), sx, sx * ad]
    both_n = len(set(q["nums"]) & set(t["nums"]))
    letters = p.overlap(q["al"], t["al"])
    f, g = fuzzy(q["core"], t["core"]), fuzzy(t["core"], q["core"])
    shared_postal = p.overlap(q["postal"], t["postal"])
    ends = P.common_ends(q["cc"], t["cc"])
    part = lambda a, b: float(len(a.encode()) > 1 and a in b)
    al = lambda r: " ".join(r["al"])
    out += [eq(q["cc"], t["cc"]), p.dice(q["cc"], t["cc"], 3), edit(q["cc"], t["cc"]), p.overlap(q["core"], t["core"]), p.jaccard(q["core"], t["core"]), inside(q["cc"], t["cc"]), ratio(q["cc"], t["cc"]),
            ratio(q["nc"], t["nc"]), edit(q["nc"], t["nc"]), p.dice(q["aj"], t["aj"], 3), edit(q["aj"], t["aj"]), p.overlap(q["addr"], t["addr"]), p.jaccard(q["addr"], t["addr"]), eq(q["aj"], t["aj"]),
            ratio(q["aj"], t["aj"]), letters, p.dice(al(q), al(t), 3), p.overlap(q["nums"], t["nums"]), p.jaccard(q["nums"], t["nums"]), both_n, len(q["nums"]) - both_n, len(t["nums"]) - both_n,
            eq(q["nums"], t["nums"]), len(q["nums"]), len(t["nums"]), edit(q["first"], t["first"]), float(both), f[0], g[0], f[1], g[1], len(q["core"]), len(t["core"]), len(q["addr"]), len(t["addr"]),
            float(q["a"] == ""), float(q["indic"]), float(t["indic"]), math.log1p(score / 1e6), math.log1p(rank), math.log1p(frequency), len(q["nc"].encode()), len(t["nc"].encode()), float(tid.startswith("S2")),
            eq(q["ini"], t["ini"]), part(q["ini"], t["cc"]), part(t["ini"], q["cc"]), p.dice(q["cc"], t["cc"], 2), p.dice(q["aj"], t["aj"], 2), float(both and q["first"] != t["first"] and letters > 0.8),
            eq(al(q), al(t)), shared_postal, float(bool(q["postal"] and t["postal"]) and not shared_postal), *ends, inside(q["aj"], t["aj"])]
    sj = lambda r: " ".join(r["sound"])
    two = lambda c: (fuzzy(q[c], t[c]), fuzzy(t[c], q[c]))
    (rf, rg), (sf, sg), (df, dg), (mf, mg) = two("roman"), two("sound"), two("digits"), two("mixed")
    both_d = len(set(q["digits"]) & set(t["digits"]))
    out += [eq(q["rc"], t["rc"]), p.dice(q["rc"], t["rc"], 3), edit(q["rc"], t["rc"]), p.overlap(q["roman"], t["roman"]), p.jaccard(q["roman"], t["roman"]), rf[0], rg[0], eq(sj(q), sj(t)), p.dice(sj(q), sj(t), 2),
            edit(sj(q), sj(t)), p.overlap(q["sound"], t["sound"]), p.jaccard(q["sound"], t["sound"]), sf[0], sg[0], sf[1], sg[1], p.overlap(q["digits"], t["digits"]), p.jaccard(q["digits"], t["digits"]),
            len(q["digits"]) - both_d, len(t["digits"]) - both_d, df[0], dg[0], p.overlap(q["mixed"], t["mixed"]), p.jaccard(q["mixed"], t["mixed"]), mf[0], mg[0], p.dice(" ".join(q["ra"]), " ".join(t["ra"]), 3),
            p.overlap(q["ra"], t["ra"]), p.jaccard(q["ra"], t["ra"]), len(q["sound"]), len(t["sound"])]
    return [float(x) for x in out]


@pytest.fixture(scope="module")
def tables(spark):
    q, t = (B.prepare(spark.createDataFrame(r, SCHEMA)) for r in (S1, TARGETS))
    hits = q.select(F.col("entity_id").alias("qid")).crossJoin(t.select(F.col("entity_id").alias("tid"))).withColumns({"score": F.lit(2_500_000).cast("bigint"), "rank": F.lit(3).cast("bigint")})
    return q, t, features.pair_features(hits, q, t).persist()


def test_all_107_values(spark, tables):
    rows = tables[2].collect()
    qs, ts = {r[0]: record(r) for r in S1}, {r[0]: record(r) for r in TARGETS}
    country = {r[0]: r[3] for r in S1 + TARGETS}
    assert len(rows) == len(S1) * len(TARGETS)
    for r in rows:
        own = qs[r["qid"]]["cc"]
        frequency = sum(t["cc"] == own and own != "" and country[k] == country[r["qid"]] for k, t in ts.items())
        want = vector(qs[r["qid"]], ts[r["tid"]], r["tid"], 2_500_000, 3, frequency)
        for name, x in zip(baseline.ALL, want, strict=True):
            assert r[name] == pytest.approx(x, abs=1e-9), (r["qid"], r["tid"], name)


def test_reference_features(spark, tables):
    q, t, pairs = tables
    at = {n: i for i, n in enumerate(baseline.ALL)}
    model = models.Trees(107, 0.0, 1.0, -9.0, [([at["core_dice"], at["address_normalized_dice"]], [0.3, 0.3], [0.0, 4.0, 3.0, 12.0]), ([at["retrieval_rank"], at["roman_edit"]], [1.0, 0.4], [0.0, 0.5, 1.0, 2.0])])
    full = baseline.second_stage(pairs, q, t, model).collect()
    qs, ts = {r[0]: record(r) for r in S1}, {r[0]: record(r) for r in TARGETS}
    country = {r[0]: r[3] for r in S1 + TARGETS}
    rivals = {(r["qid"], r["tid"]) for r in retrieval.reverse_retrieve(t, q).collect()}
    assert len(full) == len(S1) * len(TARGETS) and {len([r for r in full if r["reference_checked"] == c]) > 0 for c in (0.0, 1.0)} == {True}
    name_count = lambda r, c: math.log1p(sum(v["cc"] == r["cc"] and r["cc"] != "" and country[k] == c for k, v in qs.items()))

    def idf(w, c):
        df = sum(w in v["core"] for k, v in qs.items() if country[k] == c) if len(w.encode()) >= 3 else 0
        return min(12.0, math.log1p(len(qs) / (1 + df)))

    def evidence(a, b, c):
        best = [max((1.0 if w == v else P.edit_similarity(w, v) for v in b), default=0.0) for w in a]
        ws = [idf(w, c) for w in a]
        if not a:
            return 0.0, 0.0, 0.0
        return sum(x * y for x, y in zip(ws, best, strict=True)) / sum(ws), sum(x for x, y in zip(ws, best, strict=True) if y == 1) / sum(ws), best[ws.index(max(ws))]

    def sub(a, b):
        it = iter(b)
        return a != "" and len(a) < len(b) and all(c in it for c in a)

    def numbers(a, b):
        gone = [w for w in a if w not in b]
        return sum(any(sub(v, w) for v in b) for w in gone), sum(len(w) >= 3 for w in gone), sum(len(w) < 3 for w in gone)

    for r in full:
        got = [r[c] for c in features.REFERENCE]
        if r["logit"] <= -8:
            assert got == [0.0] * 26
            continue
        a, b, c = qs[r["qid"]], ts[r["tid"]], country[r["qid"]]
        values = sorted((float(model.score(np.array([vector(v, b, r["tid"], 2_500_000, 3, round(math.expm1(r["name_frequency"])))], np.float32))[0]) for k, v in qs.items() if k != r["qid"] and (r["tid"], k) in rivals), reverse=True)
        top = [*values, -30.0, -30.0]
        e, f = evidence(a["roman"], b["roman"], c), evidence(b["roman"], a["roman"], c)
        x, y = a["first"], b["first"]
        both = x != "" and y != ""
        far = abs(float(x or 0) - float(y or 0)) if both else 0.0
        n, m = numbers(a["digits"], b["digits"]), numbers(b["digits"], a["digits"])
        want = [1, top[0], top[1], r["logit"] - top[0], sum(v > r["logit"] for v in values), sum(v > 2.2 for v in values), name_count(a, c), name_count(b, country[r["tid"]]), e[0], f[0], e[1], f[1], e[2], f[2],
                len(y) - len(x) if both else 0, ratio(x, y), float(both and (x in y or y in x)), float(sub(x, y) or sub(y, x)), math.log1p(min(far, 1e12)), float(both and far == 1), n[0], m[0], n[1], m[1], n[2], m[2]]
        assert got == pytest.approx(want, abs=1e-9), (r["qid"], r["tid"])


def test_native_scripts_equal_plain(spark):
    texts = ["टाटा स्टील", "দিল্লি ১২৩", "ਪੰਜਾਬ ਟਾਟਾ", "தமிழ்நாடு", "ಬೆಂಗಳೂರು ಕ‍ಷ", "മലയാളം ൧", "ગુજરાત ઓડિયો", "é é œuvre", "Philips Xbox kxxs", "", "क्‍ष ॐ", "తెలంగాణ", "ଓଡ଼ିଶା"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    rows = df.select("s", X.romanize(F.col("s")).alias("r"), X.phonetic(F.col("s")).alias("p")).withColumn("w", X.core_words(F.col("r"))).select("*", X.sound_words(F.col("w")).alias("k"))
    tagged = lambda v, t: F.transform(v, lambda x: F.concat(x, F.lit(f":{t}")))
    keys = F.concat(*[tagged(v, t) for t, v in X.sound_keys(F.col("k"))])
    for r in rows.withColumn("b", keys).collect():
        assert r["r"] == p.romanize(r["s"]) and r["p"] == p.phonetic(r["s"]) and r["k"] == p.sound_words(r["s"])
        assert r["b"] == [f"{k}:{t}" for k, t in p.sound_keys(r["s"])]
