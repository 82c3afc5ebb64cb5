"""SQL for the registered queries: the same results, written independently for DuckDB."""

from __future__ import annotations

from ..functions import constants as K
from ..functions import scripts as S
from .fixtures import SCORES_SQL, SOURCES_SQL

SEP = K.SEPARATOR


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def low(x: str) -> str:
    return f"translate({x}, '{K.UPPER}', '{K.LOWER}')"


def strip(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN '' ELSE coalesce(nullif(ltrim({x}, '0'), ''), '0') END)"


def tidy(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def words(x: str) -> str:
    return tidy(f"list_transform(list_filter(string_split_regex({low(x)}, '{SEP}'), lambda t: t <> ''), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN {strip('t')} ELSE t END)")


def compact(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]', '', 'g')"


def fold(x: str) -> str:
    accents = "".join(K.ACCENTS.values())
    plain = "".join(k * len(v) for k, v in K.ACCENTS.items())
    out = f"translate({x}, '{accents}{K.UPPER}', '{plain}{K.LOWER}')"
    for a, b in K.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def core_words(x: str) -> str:
    kept = f"list_filter({words(fold(x))}, lambda t: NOT list_contains({_list(K.CORE_STOP)}, t))"
    return tidy(f"list_transform({kept}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN t ELSE translate(t, '0156', 'olsg') END)")


def phrases(x: str) -> str:
    """First occurrences only: DuckDB's regexp_replace without the option g."""
    out = fold(x)
    for a, b in K.ADDRESS_PHRASES.items():
        out = f"regexp_replace({out}, '{a}', '{b}')"
    return out


def address_words(x: str) -> str:
    alias = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in K.ADDRESS_ALIASES.items()) + "}"
    kept = f"list_filter({words(phrases(x))}, lambda t: NOT list_contains({_list(K.ADDRESS_STOP)}, t))"
    return tidy(f"list_transform({kept}, lambda t: coalesce({alias}[t], t))")


def numbers(x: str) -> str:
    return f"list_filter({x}, lambda t: regexp_full_match(t, '[0-9]+'))"


def letters(x: str) -> str:
    return f"list_filter({x}, lambda t: NOT regexp_full_match(t, '[0-9]+'))"


def first_number(x: str) -> str:
    return strip(f"regexp_extract({x}, '[0-9]+')")


def digit_runs(x: str) -> str:
    return tidy(f"list_transform(regexp_extract_all({x}, '[0-9]+'), lambda t: {strip('t')})")


def salience(x: str, least: int, most: int) -> str:
    size = "strlen(t) + CASE WHEN regexp_full_match(t, '[0-9]+') AND strlen(t) >= 3 THEN 12 ELSE 0 END"
    return f"list_transform(list_sort(list_transform(list_filter({x}, lambda t: strlen(t) >= {least}), lambda t: {{'r': -({size}), 't': t}}))[1:{most}], lambda s: s.t)"


def adjacent(x: str) -> str:
    return f"list_transform(range(2, len({x}) + 1), lambda i: least({x}[i - 1], {x}[i]) || '|' || greatest({x}[i - 1], {x}[i]))"


def every_pair(x: str) -> str:
    return f"flatten(list_transform(range(1, len({x}) + 1), lambda i: list_transform(range(i + 1, len({x}) + 1), lambda j: least({x}[i], {x}[j]) || '|' || greatest({x}[i], {x}[j]))))"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) ELSE 0 END)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END)"


def dice(a: str, b: str, n: int) -> str:
    grams = lambda x: f"list_transform(range(1, strlen({x}) - {n} + 2), lambda i: substr(hex(encode({x})), 2 * i - 1, {2 * n}))"
    u, v = grams(a), grams(b)
    shared = f"coalesce(list_sum(list_transform(list_distinct({u}), lambda g: least(len(list_filter({u}, lambda y: y = g)), len(list_filter({v}, lambda y: y = g))))), 0)"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN strlen({a}) < {n} OR strlen({b}) < {n} THEN 0 ELSE 2.0::DOUBLE * {shared} / (strlen({a}) + strlen({b}) - {2 * (n - 1)}) END)"


_AFTER = "\ue000"


def romanize(x: str) -> str:
    """Each consonant gets an a behind a mark, which goes if a sign follows the mark; then letters become sounds one by one."""
    c = S.classes()
    out = f"regexp_replace({fold(x)}, '{c['silent']}', '', 'g')"
    out = f"regexp_replace({out}, '({c['consonant']})', '\\1{_AFTER}', 'g')"
    out = f"replace(regexp_replace({out}, '{_AFTER}({c['taking']})', '\\1', 'g'), '{_AFTER}', 'a')"
    for sound in sorted({s for form in S.letters().values() for s in form.values()}):
        which = "".join(ch for form in S.letters().values() for ch, s in form.items() if s == sound)
        out = f"regexp_replace({out}, '[{which}]', '{sound}', 'g')"
    return f"(CASE WHEN regexp_matches({x}, '{c['any']}') THEN {out} ELSE {fold(x)} END)"


def phonetic(x: str) -> str:
    out = f"translate(regexp_replace(replace({x}, 'ph', 'f'), '[^a-z]|[aeiouh]', '', 'g'), 'cqwz', 'kkvs')"
    for ch in "bdfgjklmnprstvy":
        out = f"regexp_replace({out}, '{ch}+', '{ch}', 'g')"
    return f"replace(regexp_replace({out}, 'xs', 'x', 'g'), 'x', 'ks')"


def sound_words(roman: str) -> str:
    return tidy(f"list_filter(list_transform({roman}, lambda t: {phonetic('t')}), lambda t: t <> '' AND NOT list_contains({_list(K.PHONETIC_LEGAL)}, t))")


def edits(source: str) -> str:
    """Edit similarity of the distinct pairs (a, b) of ``source``, as edits(a, b, s): rows of the table of optimal string
    alignment one after the other, over bytes as hexadecimal digits. A cell's way from the left is the smallest
    of all cells before it plus the distance."""
    chars = lambda v: f"list_transform(range(0, least(192, strlen({v}))), lambda i: substr(hex(encode({v})), 2 * i + 1, 2))"
    swap = "CASE WHEN i >= 1 AND j >= 2 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN old[j - 1] + 1 ELSE 1000 END"
    cell = f"CASE WHEN j = 0 THEN i + 1 ELSE least(cur[j + 1] + 1, cur[j] + CAST(x[i + 1] <> y[j] AS BIGINT), {swap}) END"
    return f"""strings AS (SELECT DISTINCT a, b, {chars('a')} AS x, {chars('b')} AS y FROM {source} WHERE a <> '' AND b <> '' AND a <> b),
steps AS (SELECT a, b, x, y, CAST(0 AS BIGINT) AS i, range(0, len(y) + 1) AS cur, range(0, len(y) + 1) AS old FROM strings
  UNION ALL SELECT a, b, x, y, i + 1, list_transform(range(0, len(y) + 1), lambda j: list_min(far[1:j + 1]) + j), cur FROM (
    SELECT a, b, x, y, i, cur, list_transform(range(0, len(y) + 1), lambda j: {cell} - j) AS far FROM steps WHERE i < len(x))),
edits AS (SELECT a, b, 1 - CAST(cur[len(y) + 1] AS DOUBLE) / greatest(len(x), len(y)) AS s FROM steps WHERE i = len(x)
  UNION ALL SELECT DISTINCT a, b, CAST(a <> '' AND a = b AS DOUBLE) FROM {source} WHERE a = '' OR b = '' OR a = b)"""


def grams(x: str, n: int) -> str:
    """Grams of a record's string, each with its number among equal ones."""
    plain = f"list_transform(range(1, strlen({x}) - {n} + 2), lambda i: substr(h, 2 * i - 1, {2 * n}))"
    return f"(SELECT list_transform(g, lambda y, i: y || '#' || len(list_filter(g[1:i], lambda z: z = y))) FROM (SELECT {plain} AS g FROM (SELECT hex(encode({x})) AS h)))"


def dice_of(a: str, b: str, ga: str, gb: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN least(len({ga}), len({gb})) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect({ga}, {gb})) / (len({ga}) + len({gb})) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(strlen({a}), strlen({b})) > 0 THEN CAST(least(strlen({a}), strlen({b})) AS DOUBLE) / greatest(strlen({a}), strlen({b})) ELSE 0 END)"


def contained(a: str, b: str, least: int = 3) -> str:
    return f"(least(strlen({a}), strlen({b})) >= {least} AND (contains({a}, {b}) OR contains({b}, {a})))"


def join(x: str) -> str:
    return f"array_to_string({x}, '|')"


#: Every record of the three sources in one table, with what most queries need.
RECORDS = f"""{SOURCES_SQL},
records AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""

PREPARED = f"""{RECORDS},
p0 AS (SELECT *, {words('business_name')} AS name_words, {words('business_address')} AS addr_raw, {core_words('business_name')} AS core, {address_words('business_address')} AS addr,
  {compact(low('business_name'))} AS name_c, {compact(low('business_address'))} AS addr_c, {first_number('business_address')} AS first,
  regexp_matches(business_name, '[\\x{{0900}}-\\x{{0DFF}}]') AS indic FROM records),
prepared AS MATERIALIZED (SELECT *, {grams('name_c', 3)} AS name_g, {grams('addr_c', 3)} AS addr_g, {grams('core_c', 3)} AS core_g FROM (SELECT *, {compact("array_to_string(core, ' ')")} AS core_c, array_to_string(addr, ' ') AS addr_j, {numbers('addr')} AS nums, {letters('addr')} AS letters,
  list_filter({numbers('addr')}, lambda t: strlen(t) IN (5, 6)) AS postal, array_to_string(list_transform(core, lambda t: substr(t, 1, 1)), '') AS initials,
  array_to_string(list_transform(list_filter(name_words, lambda t: NOT list_contains({_list(K.LEGAL)}, t)), lambda t: t || '|'), '') AS core_n,
  {salience('name_words', 3, 4)} AS name_top, {salience('addr_raw', 3, 6)} AS addr_top, {salience('name_words', 2, 5)} AS name_pair, {salience('addr_raw', 2, 5)} AS addr_pair FROM p0))"""


def records(columns: dict[str, str]) -> str:
    return f"WITH {RECORDS} SELECT entity_id, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM records"


def prepared(columns: dict[str, str]) -> str:
    return f"WITH {PREPARED} SELECT entity_id, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM prepared"


def keys(parts: list[tuple[int, str]], source: str, least: int, id_name: str = "entity_id") -> str:
    rows = " UNION ".join(f"SELECT country, {t} AS type, unnest({v}) AS key, entity_id AS {id_name} FROM prepared WHERE {source}" for t, v in parts)
    return f"SELECT * FROM ({rows}) WHERE strlen(key) >= {least}"


TARGETS, QUERIES = "entity_id NOT LIKE 'S1-%'", "entity_id LIKE 'S1-%'"


def long(x: str) -> str:
    return f"list_filter({x}, lambda t: strlen(t) >= 3)"


BLOCKS_OF_NUMBERS = f"""flatten(list_transform(
  list_transform(list_sort(list_transform(CASE WHEN first <> '' AND NOT list_contains(nums, first) THEN list_append(nums, first) ELSE nums END,
    lambda n, i: {{'f': CAST(n <> first AS INTEGER), 'l': -strlen(n), 'i': i, 't': n}}))[1:3], lambda s: s.t),
  lambda n: list_transform(list_sort(list_transform({long('letters')}, lambda w: {{'l': -strlen(w), 't': w}}))[1:4], lambda s: n || '|' || s.t)))"""
LOOSE = f"array_to_string(list_filter(core, lambda t: NOT list_contains({_list(K.GENERIC)}, t)), '')"

BASE_KEYS = keys([(1, "name_top"), (2, "addr_top"), (3, "CASE WHEN strlen(name_c) >= 4 THEN [name_c] ELSE [] END"), (4, adjacent("name_pair")), (5, adjacent("addr_pair"))], TARGETS, 1)
BASE_LOOKUPS = keys([(1, long("name_words")), (2, long("addr_raw")), (3, "CASE WHEN strlen(name_c) >= 4 THEN [name_c] ELSE [] END"), (4, every_pair("name_pair")), (5, every_pair("addr_pair"))], QUERIES, 1, "qid")
_CONS = "translate(core_c, 'aeiou', '')"
ENHANCED_KEYS = keys(
    [(1, "name_top"), (2, "addr_top"), (3, "[name_c]"), (4, adjacent("name_pair")), (5, adjacent("addr_pair")), (6, "[core_c]"), (7, "[addr_j]"), (8, f"[{_CONS}]"),
     (9, f"list_filter({long('addr')}, lambda t: NOT list_contains(addr_top, t))"), (10, BLOCKS_OF_NUMBERS), (11, f"[{LOOSE}]"), (12, f"list_filter({long('core')}, lambda t: NOT list_contains(name_top, t))")], TARGETS, 3)
ENHANCED_LOOKUPS = keys(
    [(1, f"list_concat({long('name_words')}, {long('core')})"), (2, f"list_concat({long('addr_raw')}, {long('addr')})"), (3, "[name_c]"), (4, every_pair("name_pair")), (5, every_pair("addr_pair")),
     (6, "[core_c]"), (7, "[addr_j]"), (8, f"[{_CONS}]"), (9, long("addr")), (10, BLOCKS_OF_NUMBERS), (11, f"[{LOOSE}]"), (12, long("core"))], QUERIES, 2, "qid")
REFERENCE_KEYS = keys([(6, "[core_c]"), (7, "[addr_j]"), (12, long("core")), (9, long("addr")), (10, BLOCKS_OF_NUMBERS), (4, adjacent("core"))], QUERIES, 2)
REVERSE_LOOKUPS = keys([(6, "[core_c]"), (7, "[addr_j]"), (12, long("core")), (9, long("addr")), (10, BLOCKS_OF_NUMBERS), (4, every_pair("core"))], TARGETS, 2, "qid")


def sizes(postings: str, cap: int) -> str:
    return f"SELECT country, type, key, count(*) AS n FROM {postings} GROUP BY ALL HAVING count(*) <= {cap}"


def selected(per_type: int, budget: int) -> str:
    """From lookups and sizes: smallest blocks first, per-type cap, running budget."""
    return f"""SELECT qid, country, type, key, n FROM (
  SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY n, type, key ROWS UNBOUNDED PRECEDING) AS total FROM (
    SELECT l.qid, l.country, l.type, l.key, s.n, row_number() OVER (PARTITION BY l.qid, l.type ORDER BY s.n, l.key) AS r
    FROM (SELECT DISTINCT * FROM lookups) l JOIN sizes s USING (country, type, key)) WHERE r <= {per_type}) WHERE total <= {budget}"""


def selected_base(per_family: int, budget: int) -> str:
    """The fold over at most five times ``per_family`` blocks, as a recursive query."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_position([3, 4, 5, 1, 2], type), r) AS i FROM (
  SELECT l.qid, l.country, l.type, l.key, s.n, row_number() OVER (PARTITION BY l.qid, l.type ORDER BY s.n, l.key) AS r FROM lookups l JOIN sizes s USING (country, type, key)) WHERE r <= {per_family}),
fold AS (SELECT qid, i, n, CASE WHEN n <= {budget} THEN n ELSE 0 END AS used, n <= {budget} AS ok FROM ordered WHERE i = 1
  UNION ALL SELECT o.qid, o.i, o.n, CASE WHEN f.used + o.n <= {budget} THEN f.used + o.n ELSE f.used END, f.used + o.n <= {budget} FROM fold f JOIN ordered o ON o.qid = f.qid AND o.i = f.i + 1),
blocks AS (SELECT o.qid, o.country, o.type, o.key, o.n FROM ordered o JOIN fold f USING (qid, i) WHERE f.ok)"""


def weight(kinds: dict[int, float]) -> str:
    base = "CASE type " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in kinds.items()) + " END"
    return f"CAST(round({base} * (1 + ln(1 + 800.0::DOUBLE / n)) * 1000000) AS BIGINT)"


def hits(kinds: dict[int, float]) -> str:
    return f"SELECT b.qid, p.entity_id AS tid, CAST(sum({weight(kinds)}) AS BIGINT) AS score FROM blocks b JOIN postings p USING (country, type, key) GROUP BY ALL"


def top(source: str, k: int) -> str:
    return f"SELECT qid, tid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) - 1 AS rank FROM {source}) WHERE rank < {k}"


def reranked(source: str, w: tuple, k: int) -> str:
    a, b, d, e = (f"{x}::DOUBLE" for x in w)
    nd, no, ao = dice_of("q.core_c", "t.core_c", "q.core_g", "t.core_g"), overlap("q.core", "t.core"), overlap("q.addr", "t.addr")
    inner = f"SELECT qid, tid, CAST(score + round(({a} * nd + {b} * no + {d} * ao + {e} * nd * ao) * 1000000) AS BIGINT) AS score FROM (SELECT h.qid, h.tid, h.score, {nd} AS nd, {no} AS no, {ao} AS ao FROM {source} h JOIN prepared q ON q.entity_id = h.qid JOIN prepared t ON t.entity_id = h.tid)"
    return top(f"({inner})", k)


LEGACY_SQL = f"""SELECT qid, tid, 1.0::DOUBLE AS const, nd AS name_dice, no AS name_overlap, nj AS name_jaccard, ad AS address_dice, ao AS address_overlap, aj AS address_jaccard, nm AS number_overlap,
  nc AS name_contained, nd * ad AS name_address_dice, no * ao AS name_address_overlap, greatest(nd, ad) AS max_dice, least(nd, ad) AS min_dice, ne AS name_equal, ce AS core_equal,
  ma AS target_address_missing, fe AS number_equal, fc AS number_conflict, sx AS script_mismatch, sx * ad AS script_address FROM (
  SELECT h.qid, h.tid, {dice_of('q.name_c', 't.name_c', 'q.name_g', 't.name_g')} AS nd, {dice_of('q.addr_c', 't.addr_c', 'q.addr_g', 't.addr_g')} AS ad, {overlap('q.name_words', 't.name_words')} AS no, {jaccard('q.name_words', 't.name_words')} AS nj,
    {overlap('q.addr_raw', 't.addr_raw')} AS ao, {jaccard('q.addr_raw', 't.addr_raw')} AS aj,
    {overlap("list_filter(q.addr_raw, lambda t: regexp_matches(t, '^[0-9]') AND strlen(t) >= 2)", "list_filter(t.addr_raw, lambda t: regexp_matches(t, '^[0-9]') AND strlen(t) >= 2)")} AS nm,
    CAST({contained('q.name_c', 't.name_c', 6)} AS DOUBLE) AS nc, CAST(q.name_c <> '' AND q.name_c = t.name_c AS DOUBLE) AS ne, CAST(q.core_n <> '' AND q.core_n = t.core_n AS DOUBLE) AS ce,
    CAST(t.business_address = '' AS DOUBLE) AS ma, CAST(q.first <> '' AND q.first = t.first AS DOUBLE) AS fe, CAST(q.first <> '' AND t.first <> '' AND q.first <> t.first AS DOUBLE) AS fc,
    CAST(q.indic <> t.indic AS DOUBLE) AS sx FROM candidates h JOIN prepared q ON q.entity_id = h.qid JOIN prepared t ON t.entity_id = h.tid)"""


def logistic_sql() -> str:
    from ..operators.features import LEGACY

    total = " + ".join(f"{n} * {w}::DOUBLE" for n, w in zip(LEGACY, K.LOGISTIC, strict=True))
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-20, least(20, {total}))))"


def f_half(tp: str, fp: str, truth: str) -> str:
    return f"(CASE WHEN 1.25::DOUBLE * ({tp}) + ({fp}) + 0.25::DOUBLE * (({truth}) - ({tp})) > 0 THEN 1.25::DOUBLE * ({tp}) / (1.25::DOUBLE * ({tp}) + ({fp}) + 0.25::DOUBLE * (({truth}) - ({tp}))) ELSE 1 END)"


def sigmoid(x: str, clip: int) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-{clip}, least({clip}, {x})))))"


SCORES = f"{SCORES_SQL}, truths AS (SELECT doc_id AS q, CAST(CAST(doc_id % 5 <> 0 AS INTEGER) + CAST(doc_id % 3 <> 0 AS INTEGER) AS BIGINT) AS truth FROM documents)"


#: Romanised core words and sounds of every record.
SOUNDS = f"{PREPARED}, sounding AS (SELECT *, {sound_words('roman')} AS sound FROM (SELECT *, {core_words(romanize('business_name'))} AS roman FROM prepared))"
_SOUND_PAIRS = f"CASE WHEN len(sound) <= 8 THEN list_filter({every_pair('sound')}, lambda k: strlen(k) >= 6) ELSE [] END"
SOUND_KEYS = [(13, "CASE WHEN len(sound) > 0 THEN [array_to_string(sound, ' ')] ELSE [] END"), (14, "list_filter(sound, lambda t: strlen(t) >= 3)"), (15, _SOUND_PAIRS)]
