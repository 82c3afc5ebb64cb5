"""Registered queries of record linkage, each with its SQL where SQL can state it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernels as P
from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking as B
from ..operators import compared, context, decide, evaluate, features, models, retrieval, sampling, validate, vectors
from ..sources import tsv
from . import baseline
from . import fixtures as fx
from . import oracles as o

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The caps that candidates are drawn with.
BASE = {"cap": 800, "per_family": 5, "budget": 1800, "k": 80}
ENHANCED = {"cap": 12_000, "per_type": 8, "budget": 30_000, "first": 600, "k": 160}
REVERSE = {"cap": 12_000, "per_type": 7, "budget": 12_000, "first": 120, "k": 12}
#: The published settings of both trainings (trees at most; growth ends where held rows gain no more).
PAIR_TREES = {"trees": 1800, "depth": 7, "rate": 0.06, "l2": 6.0, "bins": 128, "wait": 150}
CONTEXT_TREES = {"trees": 1000, "depth": 6, "rate": 0.045, "l2": 8.0, "bins": 128, "wait": 120}
#: Caps that bind on small tables, so that selection is exercised there too (queries named _tight).
TIGHT_BASE = {"cap": 40, "per_family": 3, "budget": 200, "k": 20}
TIGHT_ENHANCED = {"cap": 60, "per_type": 3, "budget": 250, "first": 40, "k": 20}
TIGHT_REVERSE = {"cap": 60, "per_type": 3, "budget": 200, "first": 30, "k": 12}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def all_records(spark, d) -> DataFrame:
    s1, s2, s3 = fx.sources(spark, d)
    return s1.unionByName(s2).unionByName(s3)


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    s1, s2, s3 = fx.sources(spark, d)
    return B.prepare(s1), B.prepare(s2.unionByName(s3))


def bar(c) -> F.Column:
    return F.array_join(c, "|")


# scalar normalisation: one query each over all records; no session is needed to import them
SCALARS = {
    "op_lower": (lambda: X.lower_ascii(F.col("business_name")), o.low("business_name")),
    "op_words": (lambda: bar(X.words(F.col("business_name"))), o.join(o.words("business_name"))),
    "op_compact": (lambda: X.compact(X.lower_ascii(F.col("business_address"))), o.compact(o.low("business_address"))),
    "op_first_number": (lambda: X.first_number(F.col("business_address")), o.first_number("business_address")),
    "op_digit_runs": (lambda: bar(X.digit_runs(F.col("business_address"))), o.join(o.digit_runs("business_address"))),
    "op_mixed_numbers": (lambda: bar(X.mixed_numbers(X.words(F.col("business_address")))), o.join(f"list_filter({o.words('business_address')}, lambda t: regexp_matches(t, '[0-9]'))")),
    "op_fold_text": (lambda: X.fold_text(F.col("business_name")), o.fold("business_name")),
    "op_core_words": (lambda: bar(X.core_words(F.col("business_name"))), o.join(o.core_words("business_name"))),
    "op_consonants": (lambda: X.consonants(F.col("business_name")), "translate(business_name, 'aeiou', '')"),
    "op_address_words": (lambda: bar(X.address_words(F.col("business_address"))), o.join(o.address_words("business_address"))),
    "op_indic_flag": (lambda: X.is_indic(F.col("business_name")), r"regexp_matches(business_name, '[\x{0900}-\x{0DFF}]')"),
    "op_id_number": (lambda: tsv.id_number(F.col("entity_id")), "CAST(regexp_extract(entity_id, '^S[0-9]-([0-9]+)$', 1) AS BIGINT)"),
}
for _name, (_c, _s) in SCALARS.items():
    query(_name, o.records({"v": _s}))(lambda spark, d, c=_c: all_records(spark, d).select("entity_id", c().alias("v")))

PREPARED = {
    "op_core_name": (lambda: F.col("core_n"), "core_n"),
    "op_loose_core": (lambda: X.loose_core(F.col("core")), o.LOOSE),
    "op_index_words": (lambda: bar(X.index_words(F.col("name_words"), 4)), o.join("name_top")),
    "op_pair_words": (lambda: bar(X.pair_words(F.col("addr_raw"))), o.join("addr_pair")),
    "op_pair_keys": (lambda: F.array_join(X.all_pairs(X.pair_words(F.col("name_words"))), ","), f"array_to_string({o.every_pair('name_pair')}, ',')"),
    "op_number_blocks": (lambda: F.array_join(X.number_blocks(F.col("business_address"), F.col("addr")), ","), f"array_to_string({o.BLOCKS_OF_NUMBERS}, ',')"),
    "op_initials": (lambda: F.col("initials"), "initials"),
    "op_postal_tokens": (lambda: bar(F.col("postal")), o.join("postal")),
    "op_letter_tokens": (lambda: bar(F.col("letters")), o.join("letters")),
}
for _name, (_c, _s) in PREPARED.items():
    query(_name, o.prepared({"v": _s}))(lambda spark, d, c=_c: B.prepare(all_records(spark, d)).select("entity_id", c().alias("v")))


# sources
@query("scan_sources", f"WITH {o.RECORDS} SELECT * FROM records")
def scan_sources(spark, d):
    return all_records(spark, d)


@query("union_targets", f"WITH {o.RECORDS} SELECT entity_id, business_name, CAST(substr(entity_id, 2, 1) AS INTEGER) AS source, CAST(substr(entity_id, 4) AS BIGINT) AS number FROM records WHERE {o.TARGETS}")
def union_targets(spark, d):
    _, s2, s3 = fx.sources(spark, d)
    return tsv.union_targets(s2, s3).select("entity_id", "business_name", "source", "number")


@query("semi_targets", f"WITH {o.RECORDS} SELECT entity_id, business_name FROM records WHERE {o.TARGETS} AND entity_id IN (SELECT tid FROM truth WHERE CAST(substr(qid, 4) AS BIGINT) % 7 = 1)")
def semi_targets(spark, d):
    _, s2, s3 = fx.sources(spark, d)
    wanted = fx.truth(spark, d).filter(tsv.id_number(F.col("qid")) % 7 == 1).select(F.col("tid").alias("entity_id"))
    return tsv.semi_targets(s2.unionByName(s3), wanted).select("entity_id", "business_name")


@query("lookup_records", f"WITH {o.RECORDS} SELECT entity_id, business_name FROM records WHERE {o.TARGETS} AND entity_id IN (SELECT tid FROM truth WHERE CAST(substr(qid, 4) AS BIGINT) % 11 = 2)")
def lookup_records(spark, d):
    """By id; an id without a record would fail the query."""
    _, s2, s3 = fx.sources(spark, d)
    wanted = fx.truth(spark, d).filter(tsv.id_number(F.col("qid")) % 11 == 2).select(F.col("tid").alias("entity_id"))
    return tsv.lookup(s2.unionByName(s3), wanted).select("entity_id", "business_name")


@query("prefix_queries", f"WITH {o.RECORDS} SELECT entity_id, country FROM s1 ORDER BY entity_id LIMIT 128")
def prefix_queries(spark, d):
    return tsv.prefix(fx.sources(spark, d)[0], 128).select("entity_id", "country")


# similarities over true pairs and their neighbours
PAIRS = f"""WITH {o.PREPARED}, k AS (SELECT qid, tid FROM truth UNION ALL SELECT 'S1-' || (doc_id + 1), 'S2-' || doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id + 1 < (SELECT count(*) FROM documents)),
pair AS (SELECT k.qid, k.tid, q.* EXCLUDE (entity_id), t.name_c AS t_name_c, t.addr_c AS t_addr_c, t.name_words AS t_name_words, t.addr_raw AS t_addr_raw, t.addr AS t_addr, t.core AS t_core, t.core_c AS t_core_c, t.addr_j AS t_addr_j,
  t.nums AS t_nums, t.first AS t_first, t.business_address AS t_address FROM k JOIN prepared q ON q.entity_id = k.qid JOIN prepared t ON t.entity_id = k.tid)"""


def near_pairs(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    other = docs.filter("doc_id % 5 <> 0").select(F.concat(F.lit("S1-"), (F.col("doc_id") + 1).cast("string")).alias("qid"), F.concat(F.lit("S2-"), F.col("doc_id").cast("string")).alias("tid"))
    q, t = sides(spark, d)
    return features.pairs(fx.truth(spark, d).unionByName(other), q, t)


def _six(c) -> F.Column:
    return F.round(c.cast("double"), 6)


q_, t_ = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
SIMILARITIES = {
    "sim_dice3": (lambda: S.dice3(q_("name_c"), t_("name_c")), o.dice("name_c", "t_name_c", 3)),
    "sim_dice2": (lambda: S.dice2(q_("core_c"), t_("core_c")), o.dice("core_c", "t_core_c", 2)),
    "sim_token_overlap": (lambda: S.token_overlap(q_("name_words"), t_("name_words")), o.overlap("name_words", "t_name_words")),
    "sim_token_jaccard": (lambda: S.token_jaccard(q_("addr"), t_("addr")), o.jaccard("addr", "t_addr")),
    "sim_number_overlap": (lambda: S.number_overlap(q_("addr_raw"), t_("addr_raw")), o.overlap("list_filter(addr_raw, lambda t: regexp_matches(t, '^[0-9]') AND strlen(t) >= 2)", "list_filter(t_addr_raw, lambda t: regexp_matches(t, '^[0-9]') AND strlen(t) >= 2)")),
    "sim_length_ratio": (lambda: S.length_ratio(q_("name_c"), t_("name_c")), o.ratio("name_c", "t_name_c")),
    "sim_contained": (lambda: S.contained(q_("name_c"), t_("name_c")).cast("int"), f"CAST({o.contained('name_c', 't_name_c')} AS INTEGER)"),
    "sim_sigmoid": (lambda: S.sigmoid(S.length_ratio(q_("name_c"), t_("name_c")) * 50 - 25, 20.0), o.sigmoid(o.ratio("name_c", "t_name_c") + " * 50 - 25", 20)),
}
for _name, (_c, _s) in SIMILARITIES.items():
    query(_name, f"{PAIRS} SELECT qid, tid, round(CAST({_s} AS DOUBLE), 6) AS v FROM pair")(lambda spark, d, c=_c: near_pairs(spark, d).select("qid", "tid", _six(c()).alias("v")))

@query("sim_numeric_evidence", f"""{PAIRS}, runs AS (SELECT qid, tid, {o.digit_runs('business_address')} AS a, {o.digit_runs('t_address')} AS b FROM pair),
gone AS (SELECT *, list_filter(a, lambda w: NOT list_contains(b, w)) AS g FROM runs)
SELECT qid, tid, CAST(len(list_filter(g, lambda w: len(list_filter(b, lambda v: strlen(v) < strlen(w) AND regexp_matches(w, regexp_replace(v, '([0-9])', '\\1.*', 'g')))) > 0)) AS BIGINT) AS omissions,
  CAST(len(list_filter(g, lambda w: strlen(w) >= 3)) AS BIGINT) AS long, CAST(len(list_filter(g, lambda w: strlen(w) < 3)) AS BIGINT) AS short FROM gone""")
def sim_numeric_evidence(spark, d):
    v = S.numeric_evidence(X.digit_runs(q_("business_address")), X.digit_runs(t_("business_address")))
    return near_pairs(spark, d).select("qid", "tid", *[c.cast("bigint").alias(k) for k, c in v.items()])


EDIT_PAIRS = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)


@query("sim_edit_osa", f"{EDIT_PAIRS}, wanted AS (SELECT DISTINCT name_c AS a, t_name_c AS b FROM pair), {o.edits('wanted')} SELECT qid, tid, round(s, 6) AS v FROM pair JOIN edits ON a = name_c AND b = t_name_c")
def sim_edit_osa(spark, d):
    edit = F.pandas_udf(lambda a, b: pd.Series([P.edit_similarity(x, y) for x, y in zip(a, b, strict=True)]), "double")
    return near_pairs(spark, d).select("qid", "tid", F.round(edit("q_name_c", "t_name_c"), 6).alias("v"))


_FUZZY = "CASE WHEN a = b THEN 1 WHEN least(strlen(a), strlen(b)) >= 3 AND least(strlen(a), strlen(b)) > 0.5 * greatest(strlen(a), strlen(b)) THEN s ELSE 0 END"


@query("sim_fuzzy", f"""{EDIT_PAIRS}, tokens AS (SELECT qid, tid, a, unnest(CASE WHEN len(t_core) > 0 THEN t_core ELSE [''] END) AS b FROM (SELECT qid, tid, unnest(core) AS a, t_core FROM pair)),
wanted AS (SELECT DISTINCT a, b FROM tokens), {o.edits('wanted')}, best AS (SELECT qid, tid, a, max({_FUZZY}) AS m FROM tokens JOIN edits USING (a, b) GROUP BY qid, tid, a),
per AS (SELECT qid, tid, avg(m) AS mean, count(*) FILTER (WHERE m < 0.75::DOUBLE) AS lost FROM best GROUP BY qid, tid)
SELECT qid, tid, round(coalesce(mean, 0), 6) AS mean, coalesce(lost, 0) AS lost FROM pair LEFT JOIN per USING (qid, tid)""")
def sim_fuzzy(spark, d):
    fuzzy = F.pandas_udf(lambda a, b: pd.DataFrame([P.fuzzy_overlap(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["mean", "lost"]), "mean double, lost bigint")
    return near_pairs(spark, d).select("qid", "tid", fuzzy("q_core", "t_core").alias("f")).select("qid", "tid", F.round("f.mean", 6).alias("mean"), "f.lost")


def _evidence(side: str, own: str, other: str) -> str:
    """Tokens of one side, each with its best match, its weight and its place."""
    return f"SELECT qid, tid, '{side}' AS side, country, i, {own}[i] AS a, unnest(CASE WHEN len({other}) > 0 THEN {other} ELSE [''] END) AS b FROM (SELECT *, unnest(range(1, len({own}) + 1)) AS i FROM heard)"


@query("sim_name_idf", f"""{EDIT_PAIRS.replace(o.PREPARED, o.SOUNDS)}, heard AS (SELECT p.qid, p.tid, q.country, q.roman, t.roman AS t_roman FROM pair p JOIN sounding q ON q.entity_id = p.qid JOIN sounding t ON t.entity_id = p.tid),
tokens AS ({_evidence('query', 'roman', 't_roman')} UNION ALL {_evidence('target', 't_roman', 'roman')}), wanted AS (SELECT DISTINCT a, b FROM tokens), {o.edits('wanted')},
df AS (SELECT country, w, count(*) AS n FROM (SELECT country, unnest({o.long('core')}) AS w FROM prepared WHERE {o.QUERIES}) GROUP BY ALL),
best AS (SELECT qid, tid, side, country, i, a, max(s) AS s FROM tokens JOIN edits USING (a, b) GROUP BY ALL),
weighed AS (SELECT b.*, least(12, ln(1 + CAST((SELECT count(*) FROM s1) AS DOUBLE) / (1 + coalesce(n, 0)))) AS idf FROM best b LEFT JOIN df ON df.country = b.country AND df.w = b.a),
per AS (SELECT qid, tid, side, sum(idf * s) / sum(idf) AS fuzzy, sum(CASE WHEN s = 1 THEN idf ELSE 0 END) / sum(idf) AS exact, arg_max(s, {{'w': idf, 'i': -i}}) AS rarest FROM weighed GROUP BY ALL)
SELECT p.qid, p.tid, {', '.join(f'round(coalesce(max({v}) FILTER (WHERE side = {chr(39)}{k}{chr(39)}), 0), 6) AS {n}' for k in ('query', 'target') for v, n in (('fuzzy', f'name_idf_fuzzy_{k}'), ('exact', f'name_idf_exact_{k}'), ('rarest', f'name_rarest_{k}_similarity')))}
FROM pair p LEFT JOIN per USING (qid, tid) GROUP BY p.qid, p.tid""")
def sim_name_idf(spark, d):
    found = features.name_evidence(near_pairs(spark, d), sides(spark, d)[0])
    return found.select("qid", "tid", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query("op_romanize", o.records({"v": o.romanize("business_name")}))
def op_romanize(spark, d):
    return all_records(spark, d).select("entity_id", X.romanize(F.col("business_name")).alias("v"))


@query("op_phonetic", o.prepared({"v": o.phonetic("core_c")}))
def op_phonetic(spark, d):
    return B.prepare(all_records(spark, d)).select("entity_id", X.phonetic(F.col("core_c")).alias("v"))


@query("op_sound_words", f"WITH {o.SOUNDS} SELECT entity_id, {o.join('sound')} AS v FROM sounding")
def op_sound_words(spark, d):
    return B.prepare(all_records(spark, d)).select("entity_id", bar(F.col("sound")).alias("v"))


@query("block_index_sound", f"WITH {o.SOUNDS} SELECT country, type, key, entity_id FROM ({o.keys(o.SOUND_KEYS, o.TARGETS, 3).replace('FROM prepared', 'FROM sounding')})")
def block_index_sound(spark, d):
    return B._postings(sides(spark, d)[1], B.sound_blocks(), 3)


# blocking and retrieval
@query("block_index_base", f"WITH {o.PREPARED} SELECT country, type, key, entity_id FROM ({o.BASE_KEYS})")
def block_index_base(spark, d):
    return B.base_postings(sides(spark, d)[1])


@query("block_index_enhanced", f"WITH {o.PREPARED} SELECT country, type, key, entity_id FROM ({o.ENHANCED_KEYS})")
def block_index_enhanced(spark, d):
    return B.enhanced_postings(sides(spark, d)[1])


@query("reference_index", f"WITH {o.PREPARED} SELECT country, type, key, entity_id FROM ({o.REFERENCE_KEYS})")
def reference_index(spark, d):
    return B.reference_postings(sides(spark, d)[0])


@query("block_stats", f"WITH {o.PREPARED}, postings AS ({o.ENHANCED_KEYS}) SELECT country, type, key, n FROM ({o.sizes('postings', 12000)})")
def block_stats(spark, d):
    return B.block_sizes(B.enhanced_postings(sides(spark, d)[1]), 12_000)


def _base(c: dict) -> str:
    return f"WITH RECURSIVE {o.PREPARED}, postings AS ({o.BASE_KEYS}), lookups AS ({o.BASE_LOOKUPS}), sizes AS ({o.sizes('postings', c['cap'])}), {o.selected_base(c['per_family'], c['budget'])}"


def _sorted(keys: str, lookups: str, c: dict) -> str:
    return f"WITH {o.PREPARED}, postings AS ({keys}), lookups AS ({lookups}), sizes AS ({o.sizes('postings', c['cap'])}), blocks AS ({o.selected(c['per_type'], c['budget'])})"


def _ranked(blocks: str, kinds: dict, weights: tuple, c: dict) -> str:
    return f"{blocks}, hits AS ({o.hits(kinds)}), first AS ({o.top('hits', c['first'])}) {o.reranked('first', weights, c['k'])}"


def _candidates(c: dict) -> str:
    return f"{_base(c)}, hits AS ({o.hits(K.BASE_WEIGHTS)}), candidates AS ({o.top('hits', c['k'])})"


CAND = _candidates(BASE)


def _retrieval(suffix: str, b: dict, e: dict, r: dict) -> None:
    """The queries of retrieval under one set of caps."""
    forward, back = _sorted(o.ENHANCED_KEYS, o.ENHANCED_LOOKUPS, e), _sorted(o.REFERENCE_KEYS, o.REVERSE_LOOKUPS, r)

    @query(f"block_select_base{suffix}", f"{_base(b)} SELECT qid, country, type, key, n FROM blocks")
    def block_select_base(spark, d):
        q, t = sides(spark, d)
        return B.select_base(B.base_lookups(q), B.block_sizes(B.base_postings(t), b["cap"]), b["per_family"], b["budget"])

    @query(f"block_select_enhanced{suffix}", f"{forward} SELECT qid, country, type, key, n FROM blocks")
    def block_select_enhanced(spark, d):
        q, t = sides(spark, d)
        return B.select_sorted(B.enhanced_lookups(q).distinct(), B.block_sizes(B.enhanced_postings(t), e["cap"]), e["per_type"], e["budget"])

    @query(f"retrieve_base{suffix}", f"{_candidates(b)} SELECT qid, tid, score, rank FROM candidates")
    def retrieve_base(spark, d):
        return retrieval.retrieve_base(*sides(spark, d), **b)

    @query(f"retrieve_enhanced{suffix}", _ranked(forward, K.ENHANCED_WEIGHTS, (12, 8, 8, 12), e))
    def retrieve_enhanced(spark, d):
        return retrieval.retrieve_enhanced(*sides(spark, d), **e)

    @query(f"reverse_retrieve{suffix}", _ranked(back, K.REVERSE_WEIGHTS, (15, 10, 10, 20), r))
    def reverse_retrieve(spark, d):
        q, t = sides(spark, d)
        return retrieval.reverse_retrieve(t, q, **r)


_retrieval("", BASE, ENHANCED, REVERSE)
_retrieval("_tight", TIGHT_BASE, TIGHT_ENHANCED, TIGHT_REVERSE)


def retrieve_base(spark, d):
    return QUERIES["retrieve_base"](spark, d)


@query("retrieve_sound")
def retrieve_sound(spark, d):
    """Enhanced candidates with phonetic blocks on both sides."""
    return retrieval.retrieve_enhanced(*sides(spark, d), more=B.sound_blocks, **ENHANCED)


@query("name_frequency", f"WITH {o.PREPARED} SELECT country, core_c, count(*) AS frequency FROM prepared WHERE {o.TARGETS} AND core_c <> '' GROUP BY ALL")
def name_frequency(spark, d):
    return features.name_frequency(sides(spark, d)[1])


@query("label_join", f"{CAND} SELECT c.qid, c.tid, CAST(t.tid IS NOT NULL AS INTEGER) AS label FROM candidates c LEFT JOIN truth t USING (qid, tid)")
def label_join(spark, d):
    return baseline.labelled(retrieve_base(spark, d), fx.truth(spark, d)).select("qid", "tid", "label")


@query("membership_flags", f"{CAND} SELECT t.qid, t.tid, 1 AS label, CAST(c.tid IS NOT NULL AS INTEGER) AS in_baseline FROM truth t LEFT JOIN candidates c USING (qid, tid)")
def membership_flags(spark, d):
    truth = fx.truth(spark, d)
    return baseline.labelled(truth, truth, retrieve_base(spark, d)).select("qid", "tid", "label", "in_baseline")


# features, scores, rules
def _rounded(df, keys, names):
    return df.select(*keys, *[F.round(F.col(n), 6).alias(n) for n in names])


@query("feat_legacy", f"{CAND}, x AS ({o.LEGACY_SQL}) SELECT qid, tid, {', '.join(f'round({n}, 6) AS {n}' for n in features.LEGACY)} FROM x")
def feat_legacy(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    return compared.legacy_pairs(s1, s2.unionByName(s3), places=6, **BASE).select("qid", "tid", *features.LEGACY)


@query("score_logistic", f"{CAND}, x AS ({o.LEGACY_SQL}) SELECT qid, tid, round({o.logistic_sql()}, 6) AS p FROM x")
def score_logistic(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    return baseline.match_baseline(s1, s2.unionByName(s3), **BASE).select("qid", "tid", F.round("p", 6).alias("p"))


_P = "p"
_CHOSEN = f"({_P} >= 0.83::DOUBLE OR (core_equal > 0.5 AND target_address_missing > 0.5 AND name_dice > 0.7::DOUBLE) OR (script_mismatch > 0.5 AND address_dice >= 0.72::DOUBLE AND address_overlap >= 0.72::DOUBLE AND number_conflict < 0.5)) AND NOT (number_conflict > 0.5 AND name_dice < 0.7::DOUBLE AND name_overlap < 0.7::DOUBLE)"


@query("rule_decide", f"{CAND}, x AS ({o.LEGACY_SQL}), y AS (SELECT *, {o.logistic_sql()} AS p FROM x) SELECT qid, tid, {_CHOSEN} AS chosen FROM y")
def rule_decide(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    return baseline.match_baseline(s1, s2.unionByName(s3), bits=7, **BASE).select("qid", "tid", "chosen")


MATCH = f"{CAND}, x AS ({o.LEGACY_SQL}), y AS (SELECT qid, tid, {o.logistic_sql()} AS p FROM x), links AS (SELECT y.qid, y.tid, c.rank FROM y JOIN candidates c USING (qid, tid) WHERE p >= 0.83::DOUBLE)"


def _links(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    return s1, s2.unionByName(s3), baseline.match_baseline(s1, s2.unionByName(s3), **BASE)


@query("baseline_match_min", f"{MATCH} SELECT qid, tid FROM links")
def baseline_match_min(spark, d):
    return _links(spark, d)[2].filter("chosen").select("qid", "tid")


@query("match_lists", f"{MATCH} SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT qid, string_agg(tid, ',' ORDER BY rank) AS ids FROM links GROUP BY qid) ON qid = entity_id")
def match_lists(spark, d):
    s1, _, found = _links(spark, d)
    return tsv.id_lists(s1, found.filter("chosen"))


@query("candidate_lists", f"{CAND} SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1 LEFT JOIN (SELECT qid, string_agg(tid, ',' ORDER BY rank) AS ids FROM candidates GROUP BY qid) ON qid = entity_id")
def candidate_lists(spark, d):
    s1, _, _ = fx.sources(spark, d)
    return tsv.id_lists(s1, retrieve_base(spark, d), "candidate_entity_ids")


@query("feature_full")
def feature_full(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    return baseline.candidates_and_features(s1, s2.unionByName(s3), places=6, **ENHANCED).select("qid", "tid", "score", "rank", *baseline.ALL)


_TWO = {"query": ("a", "b"), "target": ("b", "a")}


def _gone(side: str) -> str:
    u, v = _TWO[side]
    return f"list_filter({u}, lambda w: NOT list_contains({v}, w))"


_NUMBERS = {
    "first_digits_length_change": "CASE WHEN f <> '' AND g <> '' THEN CAST(strlen(g) - strlen(f) AS DOUBLE) ELSE 0 END", "first_digits_length_ratio": o.ratio("f", "g"),
    "first_digits_containment": "CAST(f <> '' AND g <> '' AND (contains(f, g) OR contains(g, f)) AS DOUBLE)",
    "first_digits_subsequence": "CAST((f <> '' AND strlen(f) < strlen(g) AND regexp_matches(g, regexp_replace(f, '([0-9])', '\\1.*', 'g'))) OR (g <> '' AND strlen(g) < strlen(f) AND regexp_matches(f, regexp_replace(g, '([0-9])', '\\1.*', 'g'))) AS DOUBLE)",
    "first_numeric_distance": "CASE WHEN f <> '' AND g <> '' THEN ln(1 + least(abs(CAST(f AS DOUBLE) - CAST(g AS DOUBLE)), 1e12)) ELSE 0 END",
    "first_numeric_one_apart": "CAST(f <> '' AND g <> '' AND abs(try_cast(f AS DOUBLE) - try_cast(g AS DOUBLE)) = 1 AS DOUBLE)",
    **{f"digit_omission_{k}": f"CAST(len(list_filter({_gone(k)}, lambda w: len(list_filter({v[1]}, lambda x: strlen(x) < strlen(w) AND regexp_matches(w, regexp_replace(x, '([0-9])', '\\1.*', 'g')))) > 0)) AS DOUBLE)" for k, v in _TWO.items()},
    **{f"unmatched_{n}_{k}_numbers": f"CAST(len(list_filter({_gone(k)}, lambda w: strlen(w) {c} 3)) AS DOUBLE)" for n, c in (("long", ">="), ("short", "<")) for k in _TWO},
}


@query("feat_reference_numbers", f"{PAIRS}, x AS (SELECT qid, tid, first AS f, t_first AS g, {o.digit_runs('business_address')} AS a, {o.digit_runs('t_address')} AS b FROM pair) SELECT qid, tid, {', '.join(f'round({v}, 6) AS {k}' for k, v in _NUMBERS.items())} FROM x")
def feat_reference_numbers(spark, d):
    return near_pairs(spark, d).select("qid", "tid", *[F.round(c, 6).alias(k) for k, c in features.reference_numbers().items()])


TREES = models.Trees(20, 0.0, 1.0, -0.5, [([1, 4], [0.6, 0.5], [-2.0, 0.5, 0.25, 3.0]), ([17, 14], [0.5, 0.5], [0.0, -1.0, 1.0, 0.25])])


def _leaf(which, border, leaves) -> str:
    at = " + ".join(f"{1 << k} * CAST(CAST(round({features.LEGACY[f]}, 6) AS FLOAT) > CAST({b} AS FLOAT) AS INTEGER)" for k, (f, b) in enumerate(zip(which, border, strict=True)))
    return f"list_extract({leaves}::DOUBLE[], 1 + {at})"


@query("score_trees", f"{CAND}, x AS ({o.LEGACY_SQL}) SELECT qid, tid, round({' + '.join(_leaf(*t) for t in TREES.trees)} + {TREES.bias}::DOUBLE, 6) AS logit FROM x")
def score_trees(spark, d):
    return models.tree_score(feat_legacy(spark, d), TREES, features.LEGACY).select("qid", "tid", F.round("logit", 6).alias("logit"))


def _labelled_legacy(spark, d) -> DataFrame:
    """The rows of ``feat_legacy`` with labels, which are given where pairs are found."""
    s1, s2, s3 = fx.sources(spark, d)
    return compared.legacy_pairs(s1, s2.unionByName(s3), fx.truth(spark, d), places=6, **BASE).select("qid", "tid", "label", *features.LEGACY)


@query("train_logistic")
def train_logistic(spark, d):
    from ..sources.workspace import kept

    rows = kept(_labelled_legacy(spark, d).select("label", *features.LEGACY), "labelled")
    w = models.train_logistic(rows, features.LEGACY)
    return spark.createDataFrame(list(zip(features.LEGACY, [round(x, 4) for x in w], strict=True)), "feature string, weight double")


@query("train_trees")
def train_trees(spark, d):
    from ..sources.workspace import kept

    rows = kept(_labelled_legacy(spark, d), "labelled")
    model = models.train_trees(rows, features.LEGACY, trees=4, depth=2)
    return rows.select("qid", "tid", "label", F.round(models.tree_column(model, features.LEGACY), 6).alias("logit"))


# context, decisions, evaluation on scores without a model
def scores(spark, d):
    return fx.pseudo_scores(spark, d)


def truths(spark, d):
    k = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(k.alias("q"), ((k % 5 != 0).cast("bigint") + (k % 3 != 0).cast("bigint")).alias("truth"))


TIE = ["t", "source"]
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t, source) - 1 AS rank, row_number() OVER (PARTITION BY q, source ORDER BY p DESC, t) - 1 AS sr FROM (SELECT *, {o.sigmoid('score', 40)} AS p FROM scores))"


@query("context_loo", f"""WITH {o.SCORES}, {_RANKED},
lists AS (SELECT q, list(p ORDER BY rank) AS ps, sum(p) AS total, {', '.join(f'sum(CAST(p >= {c}::DOUBLE AS BIGINT)) AS c{k}' for k, c in context.CUTS.items())} FROM ranked GROUP BY q),
own AS (SELECT r.*, l.*, list_concat(ps[1:r.rank], ps[r.rank + 2:]) AS others FROM ranked r JOIN lists l USING (q))
SELECT q, t, source, rank, {', '.join(f'round(coalesce(others[{i + 1}], 0), 6) AS other_{n}' for i, n in enumerate(['best', 'second', 'third', 'fourth']))}, round(total - p, 6) AS other_sum,
  {', '.join(f'CAST(c{k} - CAST(p >= {c}::DOUBLE AS BIGINT) AS BIGINT) AS other_count_{k}' for k, c in context.CUTS.items())}, round(p / total, 6) AS share, round(p - coalesce(others[1], 0), 6) AS gap FROM own""")
def context_loo(spark, d):
    names = ["other_best", "other_second", "other_third", "other_fourth", "other_sum", "share", "gap"]
    r = context.loo(scores(spark, d), TIE)
    return r.select("q", "t", "source", F.col("rank").cast("bigint").alias("rank"), *[F.round(n, 6).alias(n) for n in names], *[F.col(f"other_count_{k}").cast("bigint").alias(f"other_count_{k}") for k in context.CUTS])


@query("context_source", f"""WITH {o.SCORES}, {_RANKED},
pairs AS (SELECT a.q, a.t, a.source, b.p, b.source = a.source AS same FROM ranked a JOIN ranked b ON b.q = a.q WHERE NOT (a.t = b.t AND a.source = b.source))
SELECT r.q, r.t, r.source, round(coalesce(max(p.p) FILTER (WHERE same), 0), 6) AS same_best, round(coalesce(sum(p.p) FILTER (WHERE same), 0), 6) AS same_sum,
  count(*) FILTER (WHERE same AND p.p >= 0.5) AS same_50, count(*) FILTER (WHERE same AND p.p >= 0.9::DOUBLE) AS same_90,
  round(coalesce(max(p.p) FILTER (WHERE NOT same), 0), 6) AS opposite_best, round(coalesce(sum(p.p) FILTER (WHERE NOT same), 0), 6) AS opposite_sum,
  count(*) FILTER (WHERE NOT same AND p.p >= 0.5) AS opposite_50, count(*) FILTER (WHERE NOT same AND p.p >= 0.9::DOUBLE) AS opposite_90
FROM ranked r LEFT JOIN pairs p ON p.q = r.q AND p.t = r.t AND p.source = r.source GROUP BY r.q, r.t, r.source""")
def context_source(spark, d):
    r = context.by_source(scores(spark, d), TIE)
    real, whole = ["same_best", "same_sum", "opposite_best", "opposite_sum"], ["same_50", "same_90", "opposite_50", "opposite_90"]
    return r.select("q", "t", "source", *[F.abs(F.round(n, 6)).alias(n) for n in real], *[F.col(n).cast("bigint").alias(n) for n in whole])


@query("competitor_stats", f"""WITH {o.SCORES}, pairs AS (SELECT a.q, a.t, a.score, b.q AS rival, b.score AS value FROM scores a JOIN scores b ON b.t = a.t AND b.source = a.source WHERE a.source = 2)
SELECT q, t, round(coalesce(max(value) FILTER (WHERE rival <> q), -30), 6) AS best_logit, round(coalesce(list_sort(list(value) FILTER (WHERE rival <> q), 'DESC')[2], -30), 6) AS second_logit,
  count(*) FILTER (WHERE rival <> q AND value > score) AS better, count(*) FILTER (WHERE rival <> q AND value > 2.2::DOUBLE) AS confident, round(score - coalesce(max(value) FILTER (WHERE rival <> q), -30), 6) AS margin
FROM pairs GROUP BY q, t, score HAVING count(*) FILTER (WHERE rival <> q) > 0""")
def competitor_stats(spark, d):
    s = scores(spark, d).filter("source = 2")
    r = context.competitors(s.select("q", "t", "score").join(s.select(F.col("q").alias("rival"), "t", F.col("score").alias("value")), "t"))
    return r.select("q", "t", *[F.round(c, 6).alias(c) for c in ("best_logit", "second_logit", "margin")], "better", "confident")


@query("decide_threshold", f"WITH {o.SCORES} SELECT q, t, source, score >= 1.5 AS chosen FROM scores")
def decide_threshold(spark, d):
    return decide.threshold(scores(spark, d), 1.5).select("q", "t", "source", "chosen")


def _expected(source: str, keys: str, logit: str) -> str:
    return f"""ex AS (SELECT *, row_number() OVER w AS k, round(1.25::DOUBLE * sum(p) OVER (PARTITION BY {keys} ORDER BY score DESC, t, source ROWS UNBOUNDED PRECEDING) / (row_number() OVER w + 0.25::DOUBLE * sum(p) OVER (PARTITION BY {keys})), 12) AS u,
  round(exp(sum(ln(1 - least(p, 1 - 1e-15))) OVER (PARTITION BY {keys})), 12) AS e FROM (SELECT *, {o.sigmoid(logit, 50)} AS p FROM {source}) WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, t, source)),
picked AS (SELECT *, max(u) OVER (PARTITION BY {keys}) > e AND k <= arg_min(k, {{'u': -u, 'k': k}}) OVER (PARTITION BY {keys}) AS chosen FROM ex)"""


@query("decide_expected_f", f"WITH {o.SCORES}, {_expected('scores', 'q', 'score')} SELECT q, t, source, chosen FROM picked")
def decide_expected_f(spark, d):
    return decide.expected_f(scores(spark, d), TIE).select("q", "t", "source", "chosen")


@query("sweep_threshold", f"""WITH {o.SCORES}, cuts AS (SELECT DISTINCT score AS c FROM scores),
per AS (SELECT c, s.q, sum(label) AS tp, count(*) AS n FROM cuts JOIN scores s ON s.score >= c GROUP BY ALL),
macro AS (SELECT c, (SELECT count(*) FROM truths WHERE truth = 0) + sum({o.f_half('tp', 'n - tp', 'truth')} - CASE WHEN truth = 0 THEN 1 ELSE 0 END) AS total FROM per JOIN truths USING (q) GROUP BY c)
SELECT arg_max(c, {{'m': round(total, 7), 'c': c}}) AS threshold, round(max(total) / (SELECT count(*) FROM truths), 6) AS macro FROM macro""")
def sweep_threshold(spark, d):
    return decide.sweep(scores(spark, d), truths(spark, d))


THRESHOLDS = [-2.0, -1.0, 0.0, 1.0, 2.0, 4.0]


@query("grid_threshold", f"""WITH {o.SCORES}, cells AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold),
per AS (SELECT threshold, q, sum(label) AS tp, count(*) AS n FROM cells JOIN scores ON score >= threshold GROUP BY ALL)
SELECT threshold, round(avg({o.f_half('coalesce(tp, 0)', 'coalesce(n, 0) - coalesce(tp, 0)', 'truth')}), 6) AS macro FROM cells CROSS JOIN truths LEFT JOIN per USING (threshold, q) GROUP BY threshold""")
def grid_threshold(spark, d):
    return decide.grid(scores(spark, d), truths(spark, d), THRESHOLDS)


SCALES, SHIFTS = [0.75, 1.0, 1.5], [-1.0, 0.0, 1.0]


@query("grid_scale_shift", f"""WITH {o.SCORES}, cells AS (SELECT scale, shift FROM (SELECT unnest({SCALES}::DOUBLE[]) AS scale) CROSS JOIN (SELECT unnest({SHIFTS}::DOUBLE[]) AS shift)),
wide AS (SELECT * FROM scores CROSS JOIN cells), {_expected('wide', 'scale, shift, q', 'score * scale + shift')},
per AS (SELECT scale, shift, q, sum(label) AS tp, count(*) AS n FROM picked WHERE chosen GROUP BY ALL)
SELECT scale, shift, round(avg({o.f_half('coalesce(tp, 0)', 'coalesce(n, 0) - coalesce(tp, 0)', 'truth')}), 6) AS macro FROM cells CROSS JOIN truths LEFT JOIN per USING (scale, shift, q) GROUP BY scale, shift""")
def grid_scale_shift(spark, d):
    return decide.scale_shift(scores(spark, d), truths(spark, d), SCALES, SHIFTS, TIE)


RULE_THRESHOLDS = [0.65, 0.75, 0.85, 0.95]


def _rules_sql(p: str, t: str, bits: str) -> str:
    on = lambda k: f"({bits} & {k}) <> 0"
    return (f"({p} >= {t} OR ({on(1)} AND core_equal > 0.5 AND target_address_missing > 0.5 AND name_dice > 0.7::DOUBLE) OR ({on(2)} AND script_mismatch > 0.5 AND address_dice >= 0.72::DOUBLE AND address_overlap >= 0.72::DOUBLE AND number_conflict < 0.5))"
            f" AND NOT ({on(4)} AND number_conflict > 0.5 AND name_dice < 0.7::DOUBLE AND name_overlap < 0.7::DOUBLE)")  # fmt: skip


@query("grid_rules", f"""{CAND}, x AS ({o.LEGACY_SQL}), y AS (SELECT x.*, {o.logistic_sql()} AS p, CAST(t.tid IS NOT NULL AS INTEGER) AS label FROM x LEFT JOIN truth t USING (qid, tid)),
cells AS (SELECT threshold, rules FROM (SELECT unnest({RULE_THRESHOLDS}::DOUBLE[]) AS threshold) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS rules)),
per AS (SELECT threshold, rules, qid, sum(label) AS tp, count(*) AS n FROM cells JOIN y ON {_rules_sql('p', 'threshold', 'rules')} GROUP BY ALL),
every AS (SELECT 'S1-' || doc_id AS qid, CAST(doc_id % 5 <> 0 AS INTEGER) + CAST(doc_id % 3 <> 0 AS INTEGER) AS truth FROM documents)
SELECT threshold, rules, round(avg({o.f_half('coalesce(tp, 0)', 'coalesce(n, 0) - coalesce(tp, 0)', 'truth')}), 6) AS macro FROM cells CROSS JOIN every LEFT JOIN per USING (threshold, rules, qid) GROUP BY threshold, rules""")
def grid_rules(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    q, t = B.prepare(s1), B.prepare(s2.unionByName(s3))
    both = features.pairs(retrieval.retrieve_base(q, t, **BASE), q, t)
    x = both.select("qid", "tid", *[c.alias(k) for k, c in features.legacy().items()]).withColumn("score", models.logistic())
    counts = truths(spark, d).select(F.concat(F.lit("S1-"), F.col("q").cast("string")).alias("q"), "truth")
    return decide.rule_grid(baseline.labelled(x, fx.truth(spark, d)).withColumn("q", F.col("qid")), counts, RULE_THRESHOLDS)


def named(spark, d, threshold: float):
    s = scores(spark, d).filter(F.col("score") >= threshold)
    links = s.select(F.concat(F.lit("S1-"), F.col("q").cast("string")).alias("qid"), F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), F.col("t").cast("string")).alias("tid"))
    entities = fx.sources(spark, d)[0].select(F.col("entity_id").alias("qid"), "country")
    return evaluate.entity_counts(links, fx.truth(spark, d), entities)


def _counts(threshold: str, name: str = "counts") -> str:
    return f"""{name} AS (SELECT 'S1-' || x.q AS qid, coalesce(lang, '') AS country, truth, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, {o.f_half('coalesce(tp, 0)', 'coalesce(n, 0) - coalesce(tp, 0)', 'truth')} AS f
  FROM truths x JOIN documents ON doc_id = x.q LEFT JOIN (SELECT q, CAST(sum(label) AS BIGINT) AS tp, count(*) AS n FROM scores WHERE score >= {threshold} GROUP BY q) USING (q))"""


COUNTS = f"WITH {o.SCORES}, {_counts('1.5')}"
_METRICS = """count(*) AS entities, round(avg(f), 6) AS macro, round(stddev_samp(f) / sqrt(count(*)), 6) AS se, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(truth - tp) AS BIGINT) AS fn,
  round(sum(tp) / CAST(nullif(sum(tp + fp), 0) AS DOUBLE), 6) AS precision, round(sum(tp) / CAST(nullif(sum(truth), 0) AS DOUBLE), 6) AS recall, round(avg(CASE WHEN truth = 0 THEN CAST(fp = 0 AS DOUBLE) END), 6) AS singletons"""


@query("entity_f05", f"{COUNTS} SELECT qid, truth, tp, fp, round(f, 6) AS f FROM counts")
def entity_f05(spark, d):
    return named(spark, d, 1.5).select("qid", "truth", "tp", "fp", F.round("f", 6).alias("f"))


@query("macro_metrics", f"{COUNTS} SELECT {_METRICS} FROM counts")
def macro_metrics(spark, d):
    return evaluate.macro_metrics(named(spark, d, 1.5))


@query("by_country", f"{COUNTS} SELECT country, {_METRICS} FROM counts GROUP BY country")
def by_country(spark, d):
    return evaluate.macro_metrics(named(spark, d, 1.5), ["country"])


@query("paired_ci", f"""WITH {o.SCORES}, {_counts('1.5', 'a')}, {_counts('3.0', 'b')}, x AS (SELECT b.f - a.f AS d FROM a JOIN b USING (qid))
SELECT round(avg(d), 6) AS mean, round(avg(d) - 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)), 6) AS high FROM x""")
def paired_ci(spark, d):
    return evaluate.paired_ci(named(spark, d, 1.5), named(spark, d, 3.0))


@query("recall_at_k", f"{CAND}, r AS (SELECT c.rank FROM truth t LEFT JOIN candidates c USING (qid, tid)) SELECT k, round(count(*) FILTER (WHERE rank < k) / CAST(count(*) AS DOUBLE), 6) AS recall FROM r, (VALUES (1), (5), (20)) v(k) GROUP BY k")
def recall_at_k(spark, d):
    return evaluate.recall_at(retrieve_base(spark, d), fx.truth(spark, d), [1, 5, 20])


@query("candidate_recall", f"""{CAND}, per AS (SELECT s.entity_id, count(t.tid) AS truth, count(c.tid) AS tp FROM s1 s LEFT JOIN truth t ON t.qid = s.entity_id LEFT JOIN candidates c ON c.qid = t.qid AND c.tid = t.tid GROUP BY s.entity_id)
SELECT round(sum(tp) / CAST(sum(truth) AS DOUBLE), 6) AS recall, round(avg({o.f_half('tp', '0', 'truth')}), 6) AS oracle_macro FROM per""")
def candidate_recall(spark, d):
    return evaluate.candidate_recall(retrieve_base(spark, d), fx.truth(spark, d), fx.sources(spark, d)[0].select(F.col("entity_id").alias("qid")))


@query("missed_links", f"{CAND} SELECT t.qid, t.tid FROM truth t LEFT JOIN candidates c ON c.qid = t.qid AND c.tid = t.tid AND c.rank < 5 WHERE c.qid IS NULL ORDER BY t.qid, t.tid LIMIT 25")
def missed_links(spark, d):
    return evaluate.missed(retrieve_base(spark, d), fx.truth(spark, d), 5, 25)


@query("confusion", f"{MATCH} SELECT coalesce(l.qid, t.qid) AS qid, coalesce(l.tid, t.tid) AS tid, CASE WHEN l.qid IS NULL THEN 'FN' WHEN t.qid IS NULL THEN 'FP' ELSE 'TP' END AS kind FROM links l FULL JOIN truth t ON t.qid = l.qid AND t.tid = l.tid")
def confusion(spark, d):
    return evaluate.confusion(_links(spark, d)[2].filter("chosen"), fx.truth(spark, d))


@query("error_sample", f"{MATCH}, c AS (SELECT coalesce(l.qid, t.qid) AS qid, coalesce(l.tid, t.tid) AS tid, CASE WHEN l.qid IS NULL THEN 'FN' WHEN t.qid IS NULL THEN 'FP' ELSE 'TP' END AS kind FROM links l FULL JOIN truth t ON t.qid = l.qid AND t.tid = l.tid) SELECT qid, tid, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY qid, tid) AS n FROM c) WHERE n <= 5")
def error_sample(spark, d):
    return evaluate.error_sample(_links(spark, d)[2].filter("chosen"), fx.truth(spark, d), 5).select("qid", "tid", "kind")


@query("run_counters", f"{MATCH} SELECT (SELECT count(*) FROM s1) AS queries, (SELECT count(*) FROM candidates) AS pairs, (SELECT count(*) FROM links) AS links")
def run_counters(spark, d):
    s1, _, found = _links(spark, d)
    totals = found.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("chosen"), 1)).alias("links"))
    return s1.agg(F.count("*").alias("queries")).join(F.broadcast(totals))


# sampling
@query("sample_hash", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100")
def sample_hash(spark, d):
    return sampling.sample(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id", 100, 7)


@query("split_disjoint", "SELECT doc_id, CASE WHEN n <= 60 THEN 'train' WHEN n <= 90 THEN 'tune' ELSE 'audit' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':2026'), doc_id) AS n FROM documents) WHERE n <= 120")
def split_disjoint(spark, d):
    return sampling.split(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id", {"train": 60, "tune": 30, "audit": 30}, 2026)


@query("negative_sampling", f"WITH {o.SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t, source) - 1 AS rank FROM scores) SELECT q, t, source FROM r WHERE label = 1 OR rank <= 2 OR t % 16 = 0")
def negative_sampling(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("q").orderBy(F.col("score").desc(), *TIE)
    rows = scores(spark, d).withColumns({"rank": F.row_number().over(by) - 1, "number": F.col("t")})
    return sampling.fewer_negatives(rows, 2, 16).select("q", "t", "source")


@query("entity_weights", f"WITH {o.SCORES} SELECT q, round(pow(1.0::DOUBLE + truth, -0.5) / (SELECT avg(pow(1.0::DOUBLE + truth, -0.5)) FROM truths), 6) AS weight FROM truths")
def entity_weights(spark, d):
    return sampling.entity_weights(truths(spark, d)).select("q", F.round("weight", 6).alias("weight"))


# validation of lists with planted faults
def _faulty(spark, d):
    s1, s2, s3 = fx.sources(spark, d)
    links = fx.truth(spark, d).withColumn("rank", F.col("tid"))
    cand = tsv.id_lists(s1, links, "candidate_entity_ids")
    match = tsv.id_lists(s1, links)
    k = tsv.id_number(F.col("source1_entity_id"))
    ids = F.col("matched_entity_ids")
    bad = F.when(k == 1, F.concat(ids, F.lit(","), ids)).when(k == 2, F.concat(ids, F.lit(",S1-2"))).when(k == 4, "S9-4").when(k == 7, "S2-8").otherwise(ids)
    match = match.filter(k != 11).withColumn("matched_entity_ids", bad)
    extra = spark.createDataFrame([("S1-x", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    return match.unionByName(match.filter(k == 3)).unionByName(extra), cand, s1, s2.unionByName(s3)


FAULTY = f"""WITH {o.RECORDS},
good AS (SELECT entity_id AS e, coalesce(string_agg(tid, ',' ORDER BY tid), '') AS ids FROM s1 LEFT JOIN truth ON qid = entity_id GROUP BY entity_id),
cand AS (SELECT e, ids FROM good),
m0 AS (SELECT e, CASE e WHEN 'S1-1' THEN ids || ',' || ids WHEN 'S1-2' THEN ids || ',S1-2' WHEN 'S1-4' THEN 'S9-4' WHEN 'S1-7' THEN 'S2-8' ELSE ids END AS ids FROM good WHERE e <> 'S1-11'),
mat AS (SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE e = 'S1-3' UNION ALL SELECT 'S1-x', 'S2-1')"""


def _checks(kind: str, t: str) -> list[str]:
    ids = f"(SELECT e, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS t FROM {t})"
    return [
        f"SELECT '{kind}_duplicate_row' AS rule, e AS x FROM {t} GROUP BY e HAVING count(*) > 1",
        f"SELECT '{kind}_duplicate_id', e || '>' || t FROM {ids} GROUP BY e, t HAVING count(*) > 1",
        f"SELECT '{kind}_self', e FROM {ids} WHERE e = t",
        f"SELECT '{kind}_bad_prefix', e || '>' || t FROM {ids} WHERE NOT regexp_matches(t, '^S[23]-')",
        f"SELECT '{kind}_missing_entity', entity_id FROM s1 WHERE entity_id NOT IN (SELECT e FROM {t})",
        f"SELECT '{kind}_unknown_entity', e FROM {t} WHERE e NOT IN (SELECT entity_id FROM s1)",
        f"SELECT '{kind}_unknown_id', t FROM {ids} WHERE t NOT IN (SELECT entity_id FROM s2 UNION ALL SELECT entity_id FROM s3)",
    ]


_ALL = " UNION ALL ".join([*_checks("match", "mat"), *_checks("candidate", "cand"), "SELECT 'match_not_candidate', e || '>' || t FROM (SELECT e, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS t FROM mat) m WHERE NOT EXISTS (SELECT 1 FROM (SELECT e, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS t FROM cand) c WHERE c.e = m.e AND c.t = m.t)"])


@query("validate_submission", f"{FAULTY}, broken AS ({_ALL}) SELECT rule, count(*) AS n, array_to_string(list_sort(list_distinct(list(x)))[1:5], ',') AS examples FROM broken GROUP BY rule")
def validate_submission(spark, d):
    return validate.violations(*_faulty(spark, d))


@query("validate_stream", f"""{FAULTY}, a AS (SELECT e, list_filter(string_split(ids, ','), lambda x: x <> '') AS m FROM mat), b AS (SELECT e, list_filter(string_split(ids, ','), lambda x: x <> '') AS c FROM cand)
SELECT coalesce(a.e, b.e) AS source1_entity_id, a.e IS NOT NULL AND b.e IS NOT NULL AS in_both, len(coalesce(m, [])) = len(list_distinct(coalesce(m, []))) AND len(coalesce(c, [])) = len(list_distinct(coalesce(c, []))) AS unique_ids,
  len(list_filter(coalesce(m, []), lambda x: NOT list_contains(coalesce(c, []), x))) = 0 AS subset FROM a FULL JOIN b ON a.e = b.e""")
def validate_stream(spark, d):
    match, cand, _, _ = _faulty(spark, d)
    return validate.stream_check(match, cand)


@query("stream_match", SQL["baseline_match_min"])
def stream_match(spark, d):
    """The baseline over a stream of source-1 records: all that is there is processed, then read back."""
    from ..sources.workspace import workspace
    from ..streaming.incremental import match_stream

    s1, s2, s3 = fx.sources(spark, d)
    place = workspace(spark, "stream")
    s1.write.parquet(f"{place}/in")
    records = spark.readStream.schema(s1.schema).parquet(f"{place}/in")
    match_stream(records, s2.unionByName(s3), f"{place}/out", f"{place}/state", **BASE).awaitTermination()
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out").select("qid", "tid")


@query("round_trip_tsv", f"WITH {o.RECORDS} SELECT * FROM records")
def round_trip_tsv(spark, d):
    """Written as plain tab-separated lines and read again."""
    from ..sources.workspace import workspace

    place = workspace(spark, "tsv")
    tsv.write_tsv(all_records(spark, d), place)
    return tsv.read_tsv(spark, place, skip_malformed=False)


# training and enhanced matching
def _entities(spark, d) -> dict[str, int]:
    """Sizes of the splits: half of source 1 trains the pair model, the rest is parted in three."""
    n = fx.sources(spark, d)[0].count()
    return {"train": n // 2, "context": n // 4, "tune": n // 8, "audit": n - n // 2 - n // 4 - n // 8}


def _trained(spark, d):
    """The stages of training, each written and read by the next: pairs, pair model, reference features, second model."""
    from ..sources.workspace import workspace
    from . import training

    s1, s2, s3 = fx.sources(spark, d)
    targets, place = s2.unionByName(s3), workspace(spark, "training")
    training.export(spark, s1, targets, fx.truth(spark, d), f"{place}/pairs", _entities(spark, d), ENHANCED, BASE)
    pair_model, _ = training.train_pair(spark, f"{place}/pairs", **PAIR_TREES)
    training.prepare_reference(spark, f"{place}/pairs", f"{place}/full", s1, targets, pair_model, caps=REVERSE)
    context_model, _ = training.train_context(spark, f"{place}/full", **CONTEXT_TREES)
    return place, pair_model, context_model


@query("feature_reference")
def feature_reference(spark, d):
    """Context and reference features (107 to 155) of enhanced candidates, scored by two fixed trees."""
    from ..sources.workspace import kept

    q, t = sides(spark, d)
    pairs = kept(vectors.enhanced_pairs(q, t, **ENHANCED), "pairs")
    at = {n: i for i, n in enumerate(baseline.ALL)}
    model = models.Trees(len(baseline.ALL), 0.0, 1.0, -5.0, [([at["core_dice"], at["address_normalized_dice"]], [0.6, 0.5], [-6.0, 2.0, 1.0, 7.0]), ([at["name_fuzzy_query"], at["numbers_exact"]], [0.7, 0.5], [-1.0, 1.5, 0.5, 2.5])])
    full = baseline.second_stage(pairs, q, t, model, **REVERSE)
    return full.select("qid", "tid", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in [*baseline.CONTEXT, *features.REFERENCE]])


@query("match_trees")
def match_trees(spark, d):
    """From tab-separated sources to both lists: two boosted stages trained here, candidates of all entities, context
    and competing references, expected-F0.5 sets, checked and published, read back."""
    from . import training

    place, pair_model, context_model = _trained(spark, d)
    training.package(spark, f"{place}/package", pair_model, context_model, {"rule": "expected_f"})
    for k, rows in enumerate(fx.sources(spark, d), 1):
        tsv.write_tsv(rows, f"{place}/test_source{k}.tsv")
    baseline.predict_trees(spark, place, "test", f"{place}/out", f"{place}/package", reverse=REVERSE, **ENHANCED)
    lists = {c: tsv.read_tsv(spark, f"{place}/out/{f}", tsv.T.StructType.fromDDL(f"source1_entity_id string, {c} string"), skip_malformed=False) for f, c in (("matching_results.tsv", "matched_entity_ids"), ("candidate_pairs.tsv", "candidate_entity_ids"))}
    return lists["matched_entity_ids"].join(lists["candidate_entity_ids"], "source1_entity_id")
