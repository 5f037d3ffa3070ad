"""DuckDB SQL for the registered queries, composed from common table expressions."""

from __future__ import annotations

from .functions import tables as V


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _clean(c: str) -> str:
    closed = rf"regexp_replace(lower(strip_accents(coalesce({c}, ''))), '\b([a-z])\.([a-z])\b', '\1\2', 'g')"
    return rf"trim(regexp_replace(regexp_replace(replace({closed}, '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _sound(c: str) -> str:
    for a, b in V.DIGRAPHS:
        c = f"replace({c}, '{a}', '{b}')"
    return rf"translate(regexp_replace({c}, 'c([eiy])', 's\1', 'g'), '{V.SOUND_CLASSES[0]}', '{V.SOUND_CLASSES[1]}')"


def _phonetic(c: str) -> str:
    merged = _sound(c)
    lead = f"CASE WHEN regexp_matches({merged}, '^[{V.SOUND_VOWELS}]') THEN 'a' ELSE '' END"
    for x in "pvktsjlmnr0123456789":
        merged = f"regexp_replace({merged}, '{x}+', '{x}', 'g')"
    return f"({lead} || regexp_replace({merged}, '[{V.SOUND_VOWELS}]', '', 'g'))"


def _leet(c: str) -> str:
    letters = f"length(regexp_replace({c}, '[^a-z]', '', 'g'))"
    return rf"CASE WHEN regexp_matches({c}, '^[a-z]*$|^\d+[a-z]?$|^\d+(st|nd|rd|th)$') OR {letters} < 2 OR length({c}) - {letters} > 2 THEN {c} ELSE translate({c}, '{V.LEET[0]}', '{V.LEET[1]}') END"


def _name_tokens(c: str) -> str:
    every = f"list_transform({_words(c)}, lambda x: {_leet('x')})"
    body = f"CASE WHEN ({every})[1] = 'm' AND ({every})[2] = 's' THEN ({every})[3:] ELSE {every} END"
    kept = rf"list_filter({body}, lambda y: y NOT IN {_list(V.LEGAL_TOKENS + V.FILLER_TOKENS)} AND NOT regexp_matches(y, '^\d{{4,}}$'))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {every} END"


def _address_tokens(c: str) -> str:
    bare = lambda x: f"CASE WHEN regexp_matches({x}, '^0+$') THEN '0' ELSE ltrim({x}, '0') END"
    number = r"regexp_extract(x, '^(\d+)[a-z]+$', 1)"
    each = rf"CASE WHEN regexp_matches(x, '^\d+$') THEN [{bare('x')}] WHEN {number} <> '' THEN [x, {bare(number)}] ELSE [x] END"
    return f"flatten(list_transform(list_filter({_words(c)}, lambda z: z NOT IN {_list(V.ADDRESS_STOPS)}), lambda x: {each}))"


REC = f"""rec AS (
    SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id || '-' || n AS id, lang AS country, doc_id % 3 + 1 AS src, array_to_string(w[n * 14 + 1:n * 14 + 6], ' ') AS name, array_to_string(w[n * 14 + 7:n * 14 + 14], ' ') AS address, doc_id, n
    FROM (SELECT doc_id, lang, w, unnest(range(0, greatest(1, (len(w) + 13) // 14))) AS n FROM (SELECT doc_id, lang, {_words('c')} AS w FROM (SELECT doc_id, lang, {_clean('text')} AS c FROM documents)))
)"""
TRUTH = """cls AS (SELECT id, src, doc_id, n, md5(name || '|' || address) AS h FROM rec),
    truth AS (SELECT a.id AS q, b.id AS t FROM cls a JOIN (SELECT arg_min(id, doc_id * 1000000 + n) AS id, h FROM cls WHERE src <> 1 GROUP BY src, h) b USING (h) WHERE a.src = 1)"""
EDGES = """e AS (
    SELECT q, t, t % 2 AS src, score, ((q + t) % 100) / 100e0 AS name_sim,
           CASE WHEN (q * 31 + t * 17) % 40 = 0 THEN 0.5e0 + ((q + t) % 50) / 100e0 ELSE ((q * 7 + t) % 100) / 10000e0 END AS p
    FROM (SELECT l_orderkey AS q, l_partkey AS t, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
)"""


def _grams(text: str) -> str:
    s = f"('^' || {text} || '$')"
    return f"CASE WHEN {text} = '' THEN [] WHEN length({s}) <= 3 THEN [{s}] ELSE list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3)) END"


def _pairs(tokens: str) -> str:
    o = f"list_sort(list_distinct({tokens}))"
    return f"flatten(list_transform(range(1, len({o}) + 1), lambda i: list_transform(({o})[i + 1:], lambda b: ({o})[i] || '|' || b)))"


_SOUNDS = f"list_filter(list_transform(nt, lambda x: {_phonetic('x')}), lambda k: length(k) >= 2)"
VIEWS = {
    "name_char": _grams("array_to_string(nt, '')"),
    "name_phon": _grams(f"array_to_string(list_transform(nt, lambda x: {_phonetic('x')}), '')"),
    "name_word": "nt",
    "name_pkey": _SOUNDS,
    "name_affix": "list_concat(list_transform(list_filter(nt, lambda x: regexp_matches(x, '^[a-z]{4,}$')), lambda x: 'p:' || substr(x, 1, 4)), list_transform(list_filter(nt, lambda x: regexp_matches(x, '^[a-z]{6,}$')), lambda x: 's:' || right(x, 4)))",
    "name_compact": "CASE WHEN length(array_to_string(nt, '')) >= 6 THEN [substr(array_to_string(nt, ''), 1, 8)] ELSE [] END",
    "name_del": "flatten(list_transform(list_filter(nt, lambda x: regexp_matches(x, '^[a-z]{5,}$')), lambda x: list_concat([x], list_transform(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1)))))",
    "name_pair": _pairs("nt"),
    "name_pkey_pair": _pairs(_SOUNDS),
    "addr_word": "ad",
    "addr_num": r"list_filter(ad, lambda x: regexp_matches(x, '^\d+$'))",
    "addr_bigram": "list_transform(range(1, len(ad)), lambda i: ad[i] || '_' || ad[i + 1])",
    "name_addr": "flatten(list_transform(nt, lambda a: list_transform(ad, lambda b: a || '|' || b)))",
    "addr_numstreet": r"list_transform(list_filter(range(1, len(ad)), lambda i: regexp_matches(ad[i], '^\d+$') AND regexp_matches(ad[i + 1], '^[a-z]+$')), lambda i: ad[i] || '_' || ad[i + 1])",
}


def _view(name: str) -> str:
    return f"WITH {REC}, tok AS (SELECT id, string_split(name, ' ') AS nt, string_split(doc_id || ' ' || address, ' ') AS ad FROM rec) SELECT id, unnest(list_distinct({VIEWS[name]})) AS key FROM tok"


def _weighted(views: list[str], where: str = "true") -> str:
    keys = " UNION ALL ".join(f"SELECT id, country, src, '{v}' AS view, unnest(list_distinct({VIEWS[v]})) AS key FROM tok" for v in views)
    side = lambda name, rows, parts: f"{name} AS (SELECT *, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id, part, src, view)) AS w FROM (SELECT k.id, p.part, p.src, k.view, k.key, df, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT * FROM keys WHERE {rows}) k JOIN {parts} p ON k.id = p.id JOIN sizes s ON s.part = p.part AND s.src = p.src LEFT JOIN df d ON d.part = p.part AND d.src = p.src AND d.view = k.view AND d.key = k.key))"
    return f"""{REC}, tok AS MATERIALIZED (SELECT id, country, src, {_name_tokens('name')} AS nt, {_address_tokens('address')} AS ad FROM rec WHERE {where}),
    keys AS MATERIALIZED ({keys}), tgt AS (SELECT * FROM tok WHERE src <> 1), there AS (SELECT DISTINCT src, country FROM tgt),
    asked AS (SELECT q.id, s.src, CASE WHEN th.country IS NULL THEN '*' ELSE q.country END AS part FROM (SELECT id, country FROM tok WHERE src = 1) q CROSS JOIN (SELECT DISTINCT src FROM tgt) s LEFT JOIN there th ON th.src = s.src AND th.country = q.country),
    held AS (SELECT id, src, country AS part FROM tgt UNION ALL SELECT id, src, '*' FROM tgt WHERE src IN (SELECT src FROM asked WHERE part = '*')),
    sizes AS (SELECT part, src, count(*) AS n FROM held GROUP BY ALL),
    df AS (SELECT part, k.src, view, key, count(*) AS df FROM keys k JOIN held h ON k.id = h.id GROUP BY ALL),
    {side('qw', 'src = 1', 'asked')}, {side('tw', 'src <> 1', 'held')}"""


def _scored(name: str, weights: dict[str, float], k: int = 50, least: float = 0.05, max_df: int = 1000) -> str:
    weight = "CASE q.view " + " ".join(f"WHEN '{v}' THEN {w}e0" for v, w in weights.items()) + " END"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY round(score, 9) DESC, t) - 1 AS rank FROM (SELECT q.id AS q, t.id AS t, q.src, sum(q.w * t.w * {weight}) AS score FROM qw q JOIN tw t ON q.part = t.part AND q.src = t.src AND q.view = t.view AND q.key = t.key WHERE q.view IN {_list(weights)} AND t.df <= {max_df} GROUP BY ALL)) WHERE rank < {k} AND score >= {least})"


_NAME = {"name_word": 1, "name_pair": 1}
_ADDR = {"addr_word": 1, "addr_bigram": 1}
_MIX = {"name_addr": 1, "name_pair": 0.5, "addr_bigram": 0.5}
_FOUR = [*_NAME, *_ADDR]


def _retrieve(weights: dict[str, float], where: str = "true") -> str:
    return f"WITH {_weighted(list(weights), where)}, {_scored('r', weights)} SELECT q, t, src, round(score, 6) AS score, rank FROM r"


_UNION = f"""{_weighted(_FOUR)}, {_scored('rn', _NAME)}, {_scored('ra', _ADDR)},
    u AS (SELECT q, t, src, coalesce(max(sn), 0e0) AS score_name, coalesce(max(sa), 0e0) AS score_addr, min(rank) AS best_rank FROM (SELECT q, t, src, score AS sn, NULL AS sa, rank FROM rn UNION ALL SELECT q, t, src, NULL, score, rank FROM ra) GROUP BY ALL)"""

_MARGIN = "{s} - CASE WHEN row_number() OVER w_{n} = 1 THEN nth_value({s}, 2) OVER a_{n} ELSE first_value({s}) OVER a_{n} END"


def _windows(s: str, **groups: tuple[str, str]) -> str:
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return "WINDOW " + ", ".join(f"w_{n} AS (PARTITION BY {g} ORDER BY {s} DESC, {tie}), a_{n} AS (PARTITION BY {g} ORDER BY {s} DESC, {tie} {whole}), g_{n} AS (PARTITION BY {g})" for n, (g, tie) in groups.items())


_EXPECTED = """x AS (SELECT *, row_number() OVER o AS k, sum(pu) OVER (PARTITION BY q ORDER BY pu DESC, t ROWS UNBOUNDED PRECEDING) AS prefix, sum(pu) OVER (PARTITION BY q) AS total, exp(sum(ln(1 - least(pu, 1 - 1e-12))) OVER (PARTITION BY q)) * exp(-0.05e0) AS none FROM base WINDOW o AS (PARTITION BY q ORDER BY pu DESC, t)),
    y AS (SELECT *, 1.25e0 * prefix / (k + 0.25e0 * (total + 0.05e0)) AS ef FROM x), z AS (SELECT *, max(ef) OVER (PARTITION BY q) AS best FROM y),
    s AS (SELECT *, k <= min(CASE WHEN ef >= best - 1e-12 THEN k END) OVER (PARTITION BY q) AND best > none AS selected FROM z)"""

_F = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1e0 WHEN n_hit = 0 THEN 0e0 ELSE 1.25e0 * n_hit / n_pred * n_hit / n_true / (0.25e0 * n_hit / n_pred + n_hit / n_true) END"
_PER = f"""{EDGES}, pred AS (SELECT q, t FROM e WHERE p >= 0.5), tru AS (SELECT q, t FROM e WHERE p >= 0.7 OR (q % 11 = 0 AND src = 1)),
    c AS (SELECT q, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(n_hit, 0) AS n_hit FROM (SELECT DISTINCT q FROM e) LEFT JOIN (SELECT q, count(*) AS n_pred FROM pred GROUP BY q) USING (q) LEFT JOIN (SELECT q, count(*) AS n_true FROM tru GROUP BY q) USING (q) LEFT JOIN (SELECT q, count(*) AS n_hit FROM pred JOIN tru USING (q, t) GROUP BY q) USING (q)),
    per AS (SELECT *, {_F} AS f05 FROM c)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY round(score, 9) DESC, t) - 1 AS source_rank FROM e)"


def _region_codes(out: str) -> str:
    for code, name in sorted(V.US_REGIONS.items(), key=lambda r: (-len(r[1].split()), r[1])):
        out = rf"regexp_replace({out}, '(^| ){name}( |$)', '\1{code}\2', 'g')"
    return out


def _states() -> str:
    coded = _region_codes("concat_ws(' ', name, ['new york', 'north carolina', 'ohio', 'in', 'west virginia'][doc_id % 5 + 1])")
    return f"WITH {REC} SELECT id, {coded} AS coded FROM rec"


def _expanded(c: str, france: str) -> str:
    table = lambda pairs: "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in pairs.items()) + "}"
    get = lambda pairs: f"coalesce({table(pairs)}[x], x)"
    return f"array_to_string(list_transform({_words(c)}, lambda x: CASE WHEN country = '{france}' THEN {get(V.ADDRESS_FRANCE)} ELSE {get(V.ADDRESS_GENERIC)} END), ' ')"


def _expand() -> str:
    return f"WITH {REC} SELECT id, {_expanded('a', 'fr')} AS expanded FROM (SELECT id, country, '12 st r av ' || address AS a FROM rec)"


def _clean_addresses() -> str:
    return f"""WITH {REC}, a AS (SELECT id, ['us', 'france', 'peru'][doc_id % 3 + 1] AS country, concat_ws(' ', '12, St. R. Av;', address, ['New York', 'North Carolina', 'Ohio', 'IN', 'West Virginia'][doc_id % 5 + 1]) AS a FROM rec),
    c AS (SELECT id, country, {_clean('a')} AS c FROM a), x AS (SELECT id, country, {_expanded('c', 'france')} AS e FROM c)
    SELECT id, country, CASE WHEN country = 'us' THEN {_region_codes('e')} ELSE e END AS clean_address FROM x"""


def _pair_structure() -> str:
    number = r"lambda x: regexp_matches(x, '^\d+$')"
    inter = lambda f: f"len(list_intersect(a.{f}, b.{f}))"
    columns = []
    for view, field in (("name", "names"), ("addr", "addrs"), ("num", "nums")):
        known = "CASE WHEN a.has AND b.has THEN {} END" if view == "addr" else "{}"
        jaccard = f"round({inter(field)} / nullif(len(a.{field}) + len(b.{field}) - {inter(field)}, 0), 6)"
        columns += [f"{known.format(inter(field))} AS {view}_inter", f"{known.format(jaccard)} AS {view}_jaccard", f"len(a.{field}) AS {view}_count_q", f"len(b.{field}) AS {view}_count_c"]
    return f"""WITH {REC}, h AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN '' ELSE ['12', '12', '1', '120', '7'][doc_id % 5 + 1] || ' ' || address END AS address) FROM rec),
    tok AS (SELECT id, src, doc_id, n, {_name_tokens('name')} AS nt, {_address_tokens('address')} AS ad FROM h),
    f AS (SELECT id, src, doc_id, n, list_distinct(nt) AS names, list_distinct(ad) AS addrs, list_filter(list_distinct(ad), {number}) AS nums, list_filter(ad, {number})[1] AS house, nt[1] AS first, length(array_to_string(nt, '')) AS len, len(ad) > 0 AS has FROM tok)
    SELECT a.id AS q, b.id AS t, {', '.join(columns)}, CASE WHEN len(a.nums) > 0 AND len(b.nums) > 0 THEN ({inter('nums')} = 0)::INT END AS num_conflict, (a.house = b.house)::INT AS house_eq,
           (starts_with(a.house, b.house) OR starts_with(b.house, a.house))::INT AS house_prefix, coalesce((a.first = b.first)::INT, 0) AS first_token_eq, a.len AS name_len_q, b.len AS name_len_c, a.has::INT AS has_addr_q, b.has::INT AS has_addr_c, (b.src = 2)::INT AS is_s2
    FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 AND b.n = a.n WHERE a.src = 1"""


_ROLES = """WITH f AS (SELECT q, (CAST('0x' || substr(md5(q || '|0'), 1, 8) AS BIGINT) % 2)::INT AS fold, md5(q || '|42') AS draw FROM (SELECT DISTINCT l_orderkey AS q FROM lineitem)),
    p AS (SELECT q, fold, row_number() OVER (PARTITION BY fold ORDER BY draw, q) AS place FROM f)
    SELECT q, fold, CASE WHEN place <= 20 THEN 'stop' WHEN place <= 200 THEN 'train' ELSE 'rest' END AS role FROM p"""
_SPLIT = f"""WITH {REC}, cls AS (SELECT id, src, md5(name || '|' || address) AS h, md5(id || '|42') AS draw FROM rec),
    q AS (SELECT id, h, draw, h IN (SELECT h FROM cls WHERE src <> 1) AS matched FROM cls WHERE src = 1),
    picked AS (SELECT id, h, matched FROM q QUALIFY row_number() OVER (PARTITION BY matched ORDER BY draw, id) <= CASE WHEN matched THEN 38 ELSE 2 END),
    tru AS (SELECT id FROM cls WHERE src <> 1 AND h IN (SELECT h FROM picked WHERE matched))
    SELECT 'query' AS kind, id FROM picked UNION ALL SELECT 'target', id FROM tru
    UNION ALL (SELECT 'target', id FROM cls WHERE src <> 1 AND id NOT IN (SELECT id FROM tru) ORDER BY draw, id LIMIT 60)"""
_NUMBERED = "regexp_matches(run, '(^| )[0-9]+( |$)')"
_STATES = ", ".join(f"({i}, '{name}', '{code}')" for i, (name, code) in enumerate((n, c) for c, names in V.INDIA_REGIONS.items() for n in names if len(n) > 2))
_REGIONS = f"""WITH RECURSIVE {REC}, r AS (SELECT id, {_words("address || ' ' || ['maharashtr', 'karnatak', 'tamil nadu', 'dilli', 'or'][doc_id % 5 + 1]")} AS ws FROM rec),
    runs AS (SELECT id, i, w, array_to_string(ws[i:i + w - 1], ' ') AS run FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM r), (SELECT unnest(range(1, 9)) AS w) WHERE i + w - 1 <= len(ws)),
    names(place, name, code) AS (VALUES {_STATES}),
    heard AS (SELECT sound, arg_min(code, place) AS code FROM (SELECT place, code, {_phonetic("replace(name, ' ', '')")} AS sound FROM names) WHERE length(sound) >= 5 GROUP BY sound),
    sounds AS (SELECT run, CASE WHEN length(run) >= 5 THEN {_phonetic("replace(run, ' ', '')")} END AS sound FROM (SELECT DISTINCT run FROM runs) WHERE NOT {_NUMBERED}),
    coded AS (SELECT run, coalesce(n.code, h.code) AS code FROM sounds LEFT JOIN names n ON n.name = run LEFT JOIN heard h USING (sound) WHERE coalesce(n.code, h.code) IS NOT NULL),
    hits AS (SELECT id, i, max(w) AS w, arg_max(code, w) AS code FROM runs JOIN coded USING (run) GROUP BY id, i),
    chosen AS (SELECT id, i, w, code FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1
        UNION ALL SELECT h.id, h.i, h.w, h.code FROM chosen c JOIN hits h ON h.id = c.id AND h.i >= c.i + c.w QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY h.i) = 1),
    each AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM r)
    SELECT e.id, string_agg(coalesce(c.code, e.word), ' ' ORDER BY e.p) AS coded FROM each e LEFT JOIN chosen c ON c.id = e.id AND e.p BETWEEN c.i AND c.i + c.w - 1 WHERE c.i IS NULL OR c.i = e.p GROUP BY e.id"""
_LETTER = "[" + ", ".join(f"'{x}'" for x in V.INDIC_CONSONANTS.values()) + "]"
_AT = lambda k: f"{_LETTER}[c_custkey * {k} % {len(V.INDIC_CONSONANTS)} + 1]"
_LATIN = f"SELECT c_custkey, {_AT(1)} || 'a' || {_AT(7)} || 'a' || CASE WHEN {_AT(11)}[1] IN ('p', 'b', 'm') THEN 'm' ELSE 'n' END || {_AT(11)} || {_AT(13)} AS latin FROM customer"
_FORM = r"\s*(?:" + "|".join(rf"\b{form}\b" for form in V.LEGAL_FORMS) + r")\s*$"
_ONLY_WORDS = f"WITH {REC}, words AS (SELECT DISTINCT word FROM (SELECT unnest({_words('name')}) AS word FROM rec))"

ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "business_name_suffix": f"WITH {REC}, n AS (SELECT doc_id, trim(name || ' ' || ['inc', 'pvt ltd', '', 'co ltd', 'sarl'][doc_id % 5 + 1]) AS clean_name FROM rec) SELECT doc_id, clean_name, trim(regexp_replace(clean_name, '{_FORM}', '')) AS core_name, trim(regexp_extract(clean_name, '({_FORM})', 1)) AS legal_suffix FROM n",
    "postal_code": r"SELECT doc_id, country, CASE country WHEN 'india' THEN regexp_extract(a, '\b([1-9][0-9]{5})\b', 1) WHEN 'us' THEN regexp_extract(a, '\b([0-9]{5})(?:-[0-9]{4})?\b', 1) WHEN 'france' THEN regexp_extract(a, '\b([0-9]{5})\b', 1) ELSE regexp_extract(a, '\b([0-9]{5,6})\b', 1) END AS postal_code FROM (SELECT doc_id, ['india', 'us', 'france', 'peru'][doc_id % 4 + 1] AS country, '12 Main Rd, Town ' || (10000 + doc_id * 137) || '-1234' AS a FROM documents)",
    "numeric_tokens": rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_clean('text')}, '\b(\d+)\b', 1))), ',') AS numbers FROM documents",
    "address_expand": _expand(),
    "clean_address": _clean_addresses(),
    "record_text": f"WITH {REC}, x AS (SELECT id, concat_ws(' | ', name, nullif(address, '')) AS text, list_filter(list_transform(string_split(concat_ws(' , ,', id, country, id), ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM rec) SELECT id, substr(id, 2, 1)::TINYINT AS src, text, len(ids)::INT AS n_ids, array_to_string(ids, '|') AS ids FROM x",
    "region_codes_us": _states(),
    "sample_roles": _ROLES,
    "val_split": _SPLIT,
    "region_codes_india": _REGIONS,
    "transliterate": _LATIN,
    "phonetic_keys": f"{_ONLY_WORDS} SELECT word, {_phonetic('word')} AS sound FROM words",
    "fix_leet": f"{_ONLY_WORDS}, l AS (SELECT DISTINCT translate(word, 'oe', '03') AS word FROM words) SELECT word, {_leet('word')} AS fixed FROM l",
    "name_tokens": f"WITH {REC}, n AS (SELECT id, name || ' ltd 2024' AS c FROM rec) SELECT id, array_to_string({_name_tokens('c')}, ' ') AS tokens FROM n",
    "address_tokens": f"WITH {REC}, n AS (SELECT id, 'h number 007 127a ' || doc_id || ' ' || address AS c FROM rec) SELECT id, array_to_string({_address_tokens('c')}, ' ') AS tokens FROM n",
    **{f"view_{v}": _view(v) for v in VIEWS},
    "doc_freq_idf": f"WITH {_weighted(['name_word'])} SELECT part, src, key, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM df JOIN sizes USING (part, src)",
    "tfidf_norms": f"WITH {_weighted(['name_word', 'addr_word'])} SELECT id, src, view, key, round(w, 6) AS w FROM qw",
    "posting_stats": f"WITH {_weighted(list(_NAME))}, k AS (SELECT count(*) AS n FROM tw WHERE df <= 1000 GROUP BY part, src, view, key) SELECT count(*) AS keys, sum(n)::BIGINT AS postings, max(n) AS longest FROM k",
    "retrieve_name": _retrieve(_NAME),
    "retrieve_addr": _retrieve(_ADDR),
    "retrieve_name_addr": _retrieve(_MIX),
    "retrieve_fallback_country": _retrieve(_NAME, "NOT (country = 'es' AND src = 2)"),
    "union_passes": f"WITH {_UNION} SELECT q, t, src, round(score_name, 6) AS score_name, round(score_addr, 6) AS score_addr, best_rank FROM u",
    "candidate_budget": f"""WITH {_UNION}, sims AS (SELECT u.q, u.t, u.src, sum(CASE WHEN a.view = 'name_word' THEN a.w * b.w ELSE 0e0 END) AS sn, sum(CASE WHEN a.view = 'addr_word' THEN a.w * b.w ELSE 0e0 END) AS sa FROM u LEFT JOIN qw a ON a.id = u.q AND a.src = u.src AND a.view IN ('name_word', 'addr_word') LEFT JOIN tw b ON b.id = u.t AND b.part = a.part AND b.view = a.view AND b.key = a.key GROUP BY ALL),
        f AS (SELECT q, t, src, coalesce(sn, 0e0) AS sn, coalesce(sa, 0e0) AS sa, round(2e0 * coalesce(sn, 0e0) + 3e0 * coalesce(sa, 0e0), 6) AS candidate_score FROM sims), g AS (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY candidate_score DESC, t) - 1 AS source_rank FROM f)
        SELECT q, t, src, round(sn, 6) AS sim_name_word, round(sa, 6) AS sim_addr_word, candidate_score, source_rank FROM g WHERE source_rank < 15""",
    "dense_topk": "WITH s AS (SELECT a.vec_id AS q, b.vec_id AS t, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, t) - 1 AS rank FROM s) SELECT q, t, round(score, 6) AS score, rank FROM r WHERE rank < 5 AND score >= 0",
    "context_features": f"""WITH {EDGES}, m AS (SELECT q, t, src, score, name_sim, row_number() OVER w_q - 1 AS q_rank, count(*) OVER g_q AS q_size, {_MARGIN.format(s='score', n='q')} AS q_margin, {_MARGIN.format(s='score', n='qs')} AS qs_margin, row_number() OVER w_t - 1 AS t_rank, count(*) OVER g_t AS t_competitors, {_MARGIN.format(s='score', n='t')} AS t_margin, score / CASE WHEN first_value(score) OVER a_q > 0 THEN first_value(score) OVER a_q ELSE 1e0 END AS rel FROM e {_windows('score', q=('q', 't'), qs=('q, src', 't'), t=('t', 'q'))})
        SELECT q, t, src, score, name_sim, q_rank, q_size, round(q_margin, 6) AS q_margin, round(qs_margin, 6) AS qs_margin, t_rank, t_competitors, round(t_margin, 6) AS t_margin, round(rel, 6) AS q_rel_score, count(*) FILTER (rel >= 0.9) OVER (PARTITION BY q) AS q_n_strong, count(*) FILTER (name_sim >= 0.9) OVER (PARTITION BY q) AS q_n_name_dupes, count(*) FILTER (name_sim >= 0.9) OVER (PARTITION BY t) AS t_n_name_dupes FROM m""",
    "prob_context_features": f"""WITH {EDGES} SELECT q, t, p, row_number() OVER w_q - 1 AS pq_rank, count(*) OVER g_q AS pq_size, round({_MARGIN.format(s='p', n='q')}, 6) AS pq_margin, row_number() OVER w_t - 1 AS pt_rank, count(*) OVER g_t AS pt_size, round({_MARGIN.format(s='p', n='t')}, 6) AS pt_margin,
        round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) AS logit, round(sum(p) OVER g_q, 6) AS pq_sum, round(sum(p) OVER g_t, 6) AS pt_sum, count(*) FILTER (p >= 0.5) OVER g_q AS pq_likely FROM e {_windows('p', q=('q', 't'), t=('t', 'q'))}""",
    "owner_normalize": f"WITH {EDGES} SELECT q, t, round(p / greatest(1e0, sum(p) OVER (PARTITION BY t)), 6) AS p_used FROM e",
    "select_threshold": f"WITH {EDGES} SELECT q, t, p FROM e WHERE p >= 0.5",
    "select_expected_f": f"WITH {EDGES}, base AS (SELECT q, t, p AS pu FROM e), {_EXPECTED} SELECT q, t, selected FROM s",
    "apply_rule": f"WITH {EDGES}, base AS (SELECT q, t, p / greatest(1e0, sum(p) OVER (PARTITION BY t)) AS pu FROM e), {_EXPECTED} SELECT q, t, round(pu, 6) AS p_used FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY pu DESC, q) AS first FROM s WHERE selected) WHERE first = 1",
    "pair_structure": _pair_structure(),
    "candidate_score": f"WITH {EDGES} SELECT q, t, (q + t) % 3 = 0 AS missing_address, round(CASE WHEN (q + t) % 3 = 0 THEN name_sim * 2 * (5e0 / 2) ELSE name_sim * 2 + p * 3 END, 6) AS candidate_score FROM e",
    "jaccard_tokens": f"WITH {REC}, {TRUTH}, r AS (SELECT id, list_distinct({_name_tokens('name')}) AS names, ({_name_tokens('name')})[1] AS first FROM rec) SELECT q, t, len(list_intersect(a.names, b.names)) AS name_inter, round(len(list_intersect(a.names, b.names)) / (len(a.names) + len(b.names) - len(list_intersect(a.names, b.names))), 6) AS name_jaccard, a.first = b.first AS first_eq FROM truth JOIN r a ON a.id = q JOIN r b ON b.id = t",
    "jaro_winkler": "SELECT c_custkey AS a, s_suppkey AS b, round(jaro_winkler_similarity(c_name || ' ' || c_mktsegment, s_name || ' machinery'), 6) AS sim FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey",
    "macro_f05": f"WITH {_PER} SELECT count(*) AS n_queries, round(avg(f05), 6) AS macro_f05, round(sum(n_hit) / sum(n_pred), 6) AS precision, round(sum(n_hit) / sum(n_true), 6) AS recall, round(avg((n_true = 0)::INT), 6) AS singleton_share, round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT END), 6) AS singleton_accuracy, round(avg((n_pred = 0)::INT), 6) AS empty_share, round(avg(n_pred), 6) AS mean_predictions FROM per",
    "per_query_f05": f"WITH {_PER} SELECT q, n_pred, n_true, n_hit, round(f05, 6) AS f05 FROM per",
    "threshold_sweep": f"WITH {_PER}, cuts AS (SELECT round(i * 0.02e0 + 0.3e0, 2) AS threshold FROM range(31) r(i)), n AS (SELECT threshold, q, count(*) AS n_pred, count(u.t) AS n_hit FROM cuts JOIN e ON p >= threshold LEFT JOIN tru u USING (q, t) GROUP BY ALL), every AS (SELECT cuts.threshold, c.q, c.n_true, coalesce(n.n_pred, 0) AS n_pred, coalesce(n.n_hit, 0) AS n_hit FROM c CROSS JOIN cuts LEFT JOIN n ON n.threshold = cuts.threshold AND n.q = c.q) SELECT threshold, round(avg({_F}), 6) AS macro_f05 FROM every GROUP BY threshold",
    "recall_at_budgets": f"WITH {EDGES}, {_RANKED} SELECT " + ", ".join(f"round(count(*) FILTER (p >= 0.5 AND source_rank < {b}) / 1000, 6) AS recall_{b}" for b in (1, 2, 3)) + " FROM ranked",
    "candidate_report": f"""WITH {_PER}, {_RANKED}, kept AS (SELECT * FROM ranked WHERE source_rank < 2), found AS (SELECT tru.q, tru.t, source_rank FROM tru LEFT JOIN kept USING (q, t)), by_q AS (SELECT q, count(*) AS n, count(source_rank) AS h FROM found GROUP BY q),
        a AS (SELECT avg((source_rank IS NOT NULL)::INT) AS pair_recall, {', '.join(f'avg((coalesce(source_rank, 1e9) < {k})::INT) AS recall_at_{k}' for k in (1, 5, 10, 15))} FROM found),
        b AS (SELECT avg(CASE WHEN n IS NULL THEN 1e0 WHEN h = 0 THEN 0e0 ELSE 1.25e0 * h / n / (0.25e0 + h / n) END) AS f05_ceiling, avg(CASE WHEN n IS NOT NULL THEN (h = n)::INT END) AS full_recall_share, avg(CASE WHEN n IS NOT NULL THEN (h = 0)::INT END) AS zero_recall_share, count(*) AS n_queries FROM c LEFT JOIN by_q USING (q)), k AS (SELECT count(*) AS n_pairs FROM kept)
        SELECT n_queries, n_pairs, round(pair_recall, 6) AS pair_recall, {', '.join(f'round(recall_at_{k}, 6) AS recall_at_{k}' for k in (1, 5, 10, 15))}, round(f05_ceiling, 6) AS f05_ceiling, round(full_recall_share, 6) AS full_recall_share, round(zero_recall_share, 6) AS zero_recall_share, round(1 - n_pairs / (n_queries * 1000e0), 6) AS reduction_ratio FROM a, b, k""",
    "candidate_statistics": f"WITH {EDGES}, {_RANKED}, n AS (SELECT q, count(*) FILTER (source_rank < 2) AS n FROM ranked GROUP BY q) SELECT count(*) AS n_queries, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, count(*) FILTER (n = 0) AS zero_candidate_queries FROM n",
    "recall_by_source": f"WITH {_PER}, {_RANKED} SELECT 'S' || (t % 2 + 2) AS source, count(*) AS n_true, round(avg((coalesce(source_rank, 9) < 1)::INT), 6) AS recall FROM tru LEFT JOIN ranked USING (q, t) GROUP BY 1",
    "recall_by_country": f"WITH {_PER}, {_RANKED} SELECT ['us', 'india', 'france'][q % 3 + 1] AS country, count(*) AS n_true, round(avg((coalesce(source_rank, 9) < 1)::INT), 6) AS recall FROM tru LEFT JOIN ranked USING (q, t) GROUP BY 1",
    "match_report": f"""WITH {_PER}, {_RANKED}, h AS (SELECT q, count(*) AS n_found FROM ranked JOIN tru USING (q, t) WHERE source_rank < 2 GROUP BY q),
        x AS (SELECT *, ['us', 'india', 'france'][q % 3 + 1] AS country, coalesce(n_found, 0) / nullif(n_true, 0) AS r FROM per LEFT JOIN h USING (q)), y AS (SELECT *, CASE WHEN n_true = 0 THEN 1e0 WHEN r = 0 THEN 0e0 ELSE 1.25e0 * r / (0.25e0 + r) END AS ceil FROM x)
        SELECT country, count(*) AS n_queries, round(avg(f05), 6) AS macro_f05, round(avg(ceil), 6) AS macro_f05_ceiling, round(coalesce(sum(n_hit) / nullif(sum(n_pred), 0), 0), 6) AS pair_precision, round(coalesce(sum(n_hit) / nullif(sum(n_true), 0), 0), 6) AS pair_recall, round(avg((n_true = 0)::INT), 6) AS singleton_share, round(coalesce(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT END), 1), 6) AS singleton_accuracy, round(coalesce(avg(CASE WHEN n_true > 0 THEN f05 END), 1), 6) AS matched_query_f05, round(avg((n_pred = 0)::INT), 6) AS predicted_empty_share, round(avg(n_pred), 6) AS mean_predictions FROM y GROUP BY ROLLUP (country)""",
    "output_statistics": f"WITH {EDGES}, per AS (SELECT q, ['us', 'india', 'france'][q % 3 + 1] AS country, count(*) FILTER (q % 5 <> 0) AS n, count(*) FILTER (q % 5 <> 0 AND p >= 0.5) AS m FROM e GROUP BY q) SELECT country, count(*) FILTER (n > 0) AS queries, count(*) FILTER (n = 0) AS without_candidates, sum(n)::BIGINT AS pairs, round(avg(CASE WHEN n > 0 THEN (m = 0)::INT END), 6) AS predicted_empty_share, round(avg(CASE WHEN n > 0 THEN m END), 6) AS mean_matches FROM per GROUP BY country",
    "matching_results": f"WITH {EDGES} SELECT q, coalesce(string_agg(CASE WHEN p >= 0.5 THEN t::VARCHAR END, ',' ORDER BY p DESC, t::VARCHAR), '') AS ids FROM e GROUP BY q",
    "validator_violations": f"""WITH {REC}, {TRUTH}, lists AS (SELECT q AS id, list(t) AS ids FROM truth GROUP BY q UNION ALL SELECT * FROM (VALUES ('S1-none', ['S2-x', 'S2-x', 'Q9', 'S1-none']), ('S1-twice', ['S3-y']), ('S1-twice', []::VARCHAR[])) AS bad(id, ids)), x AS (SELECT id, unnest(ids) AS t FROM lists), req AS (SELECT id FROM rec WHERE src = 1)
        SELECT rule, count(*) AS n FROM (
            SELECT 'duplicate rows' AS rule, id AS x FROM lists GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'repeated ids', id FROM lists WHERE len(list_distinct(ids)) < len(ids)
            UNION ALL SELECT 'missing query', id FROM req WHERE id NOT IN (SELECT id FROM lists) UNION ALL SELECT DISTINCT 'extra query', id FROM lists WHERE id NOT IN (SELECT id FROM req)
            UNION ALL SELECT DISTINCT 'self match', t FROM x WHERE t LIKE 'S1-%' UNION ALL SELECT DISTINCT 'wrong prefix', t FROM x WHERE NOT regexp_matches(t, '^S[123]-')
            UNION ALL SELECT DISTINCT 'unknown id', t FROM x WHERE regexp_matches(t, '^S[23]-') AND t NOT IN (SELECT id FROM rec WHERE src <> 1)) GROUP BY rule""",
}
