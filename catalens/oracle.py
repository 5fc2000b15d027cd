"""The same answers in SQL over the same tables, for a second engine to check (DuckDB dialect).

Written from the definitions, not from the Spark plans: for example all-pairs similarity is a plain term self-join here.
"""

from __future__ import annotations

from math import exp, factorial

from catalens.fixtures import SEED_TITLES, view_sql
from catalens.functions.stopwords import load_stop_words

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
SEEDS = ", ".join(f"'{t}'" for t in SEED_TITLES)
STOP = ", ".join(f"'{w}'" for w in load_stop_words())
# Poster folder, picture for a missing poster, page address.
IMAGE = "http://image.tmdb.org/t/p/w500"
NO_IMAGE = "https://via.placeholder.com/500x750?text=No+Image+Available"
PAGE = "https://www.themoviedb.org/movie/"

# --- common table expressions -------------------------------------------------------------------------------------

PARTS = {name: view_sql(name) for name in ("laptop_raw", "requests_raw", "movies_raw", "credits_raw", "posters", "lists_raw")}


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}'), lambda w: w <> '')"


_FIRST = "split_part(replace(replace(memory, 'GB', ''), 'TB', '000'), '+', 1)"
_PLAIN = "replace(replace(memory, 'GB', ''), 'TB', '000')"
_SECOND = f"CASE WHEN strpos({_PLAIN}, '+') > 0 THEN substr({_PLAIN}, strpos({_PLAIN}, '+') + 1) ELSE '0' END"


def _size(part: str) -> str:
    return f"CAST(regexp_replace({part}, '[^0-9]', '', 'g') AS INT)"


def _kind(kind: str) -> str:
    return (
        f"{_size('first_part')} * CAST(contains(first_part, '{kind}') AS INT)"
        f" + {_size('second_part')} * CAST(contains(second_part, '{kind}') AS INT)"
    )


PARTS["laptop_cut"] = f"""SELECT *, {_FIRST} AS first_part, {_SECOND} AS second_part,
 array_to_string({_words('cpu')}[1:3], ' ') AS cpu_name,
 CAST(regexp_extract(replace(split_part(screen_resolution, 'x', 1), ',', ''), '(\\d+\\.?\\d+)', 1) AS INT) AS x_res,
 CAST(split_part(screen_resolution, 'x', 2) AS INT) AS y_res FROM laptop_raw"""
PARTS["laptop"] = f"""SELECT unnamed_0, company, type_name, inches,
 CAST(replace(ram, 'GB', '') AS INT) AS ram, CAST(replace(weight, 'kg', '') AS FLOAT) AS weight,
 CAST(contains(screen_resolution, 'Touchscreen') AS INT) AS touchscreen,
 CAST(contains(screen_resolution, 'IPS') AS INT) AS ips, x_res, y_res,
 sqrt(CAST(x_res AS DOUBLE) * CAST(x_res AS DOUBLE) + CAST(y_res AS DOUBLE) * CAST(y_res AS DOUBLE)) / inches AS ppi,
 cpu_name,
 CASE WHEN cpu_name IN ('Intel Core i7', 'Intel Core i5', 'Intel Core i3') THEN cpu_name
  WHEN split_part(cpu_name, ' ', 1) = 'Intel' THEN 'Other Intel Processor' ELSE 'AMD Processor' END AS cpu_brand,
 {_kind('HDD')} AS hdd, {_kind('SSD')} AS ssd, {_kind('Hybrid')} AS hybrid, {_kind('Flash Storage')} AS flash_storage,
 split_part(gpu, ' ', 1) AS gpu_brand,
 CASE WHEN op_sys IN ('Windows 10', 'Windows 7', 'Windows 10 S') THEN 'Windows'
  WHEN op_sys IN ('macOS', 'Mac OS X') THEN 'Mac' ELSE 'Others/No OS/Linux' END AS os, price
 FROM laptop_cut"""
PARTS["features"] = """SELECT unnamed_0, company, type_name, ram, CAST(weight AS DOUBLE) AS weight, touchscreen, ips, ppi,
 cpu_brand, hdd, ssd, gpu_brand, os, price, ln(price) AS label FROM laptop WHERE gpu_brand IS DISTINCT FROM 'ARM'"""
PARTS["model_rows"] = """SELECT *, substr(md5(concat(CAST(unnamed_0 AS VARCHAR), '|2')), 1, 4) < '2666' AS is_test
 FROM features WHERE gpu_brand IS NOT NULL"""

PARTS["movie_rows"] = """SELECT id, movie_id, title, overview, genres, keywords, "cast", crew
 FROM movies_raw JOIN credits_raw USING (title) WHERE overview IS NOT NULL AND genres IS NOT NULL
 AND keywords IS NOT NULL AND "cast" IS NOT NULL AND crew IS NOT NULL"""


def _names(c: str) -> str:
    return f"list_transform(CAST({c} AS JSON[]), lambda x: x->>'name')"


def _closed(c: str) -> str:
    return f"list_transform({c}, lambda x: replace(x, ' ', ''))"


# Python notation to JSON, piece by piece: texts in quotes, and what stands between them.
_QUOTES = r"""(?s)"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|[^"'']+"""
PARTS["list_pieces"] = f"SELECT doc_id, items, regexp_extract_all(items, '{_QUOTES}') AS pieces FROM lists_raw"
PARTS["list_json"] = r"""SELECT doc_id, CASE WHEN array_to_string(pieces, '') = items THEN array_to_string(list_transform(pieces,
 lambda p: CASE WHEN left(p, 1) IN ('''', '"') THEN '"' || replace(replace(replace(regexp_replace(replace(replace(
 substr(p, 2, length(p) - 2), '\\', chr(57344)), '\''', ''''), '\\x([0-9A-Fa-f]{2})', '\\u00\1', 'g'), '\"', '"'), '"', '\"'),
 chr(57344), '\\') || '"' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\bNone\b', 'null', 'g'),
 '\bTrue\b', 'true', 'g'), '\bFalse\b', 'false', 'g'), ',(\s*[\]}])', '\1', 'g') END), '') END AS items FROM list_pieces"""
PARTS["list_read"] = """SELECT doc_id, CASE WHEN json_valid(items) AND json_type(items) = 'ARRAY' AND len(list_filter(
 CAST(items AS JSON[]), lambda x: json_type(x) <> 'OBJECT')) = 0 THEN CAST(items AS JSON[]) END AS items FROM list_json"""
PARTS["facets"] = f"""SELECT id, movie_id, title, {_words('overview')} AS overview, {_names('genres')} AS genres,
 {_names('keywords')} AS keywords, {_names('"cast"')}[1:3] AS actors,
 list_transform(list_filter(CAST(crew AS JSON[]), lambda x: x->>'job' = 'Director'), lambda x: x->>'name')[1:1]
 AS director FROM movie_rows"""
PARTS["tags"] = f"""SELECT id, movie_id, title, lower(array_to_string(overview || {_closed('genres')} ||
 {_closed('keywords')} || {_closed('actors')} || {_closed('director')}, ' ')) AS tags FROM facets"""
PARTS["genre_tags"] = "SELECT id, movie_id, title, lower(array_to_string(genres, ' ')) AS tags FROM facets"
PARTS["seeds"] = f"""SELECT title AS seed_title, id AS seed_id, movie_id AS seed_movie_id, actors AS seed_actors,
 director AS seed_director FROM facets WHERE title IN ({SEEDS})
 QUALIFY row_number() OVER (PARTITION BY title ORDER BY id, movie_id) = 1"""


def _vector_parts(name: str, source: str, n_terms: int) -> dict[str, str]:
    return {
        f"{name}_tc": f"""SELECT id, movie_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, movie_id,
 unnest(regexp_extract_all(tags, '{TOKEN}')) AS term FROM {source}) WHERE term NOT IN ({STOP}) GROUP BY ALL""",
        f"{name}_vocab": f"""SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM {name}_tc GROUP BY term
 ORDER BY n DESC, term LIMIT {n_terms}""",
        f"{name}_v": f"SELECT id, movie_id, term, tf FROM {name}_tc JOIN {name}_vocab USING (term)",
        f"{name}_norm": f"SELECT id, movie_id, CAST(sum(tf * tf) AS BIGINT) AS n2 FROM {name}_v GROUP BY ALL",
    }


PARTS |= _vector_parts("content", "tags", 5000) | _vector_parts("genre", "genre_tags", 13)
for _n in ("content", "genre"):
    PARTS[f"{_n}_top"] = f"""SELECT s.seed_title, v.id, v.movie_id,
 CAST(sum(v.tf * q.tf) AS BIGINT) / sqrt(CAST(any_value(a.n2) * any_value(b.n2) AS DOUBLE)) AS score
 FROM seeds s JOIN {_n}_v q ON q.id = s.seed_id AND q.movie_id = s.seed_movie_id JOIN {_n}_v v ON v.term = q.term
 JOIN {_n}_norm a ON a.id = v.id AND a.movie_id = v.movie_id
 JOIN {_n}_norm b ON b.id = q.id AND b.movie_id = q.movie_id
 WHERE NOT (v.id = s.seed_id AND v.movie_id = s.seed_movie_id) GROUP BY s.seed_title, v.id, v.movie_id
 QUALIFY row_number() OVER (PARTITION BY s.seed_title ORDER BY score DESC, v.id, v.movie_id) <= 5"""
    PARTS[f"{_n}_answer"] = f"""SELECT t.seed_title, '{_n}' AS facet,
 row_number() OVER (PARTITION BY t.seed_title ORDER BY t.score DESC, t.id, t.movie_id) AS rank,
 t.id, t.movie_id, f.title, t.score FROM {_n}_top t JOIN facets f USING (id, movie_id)"""
    PARTS[f"{_n}_pairs"] = f"""SELECT a.id, a.movie_id, b.id AS near_id, b.movie_id AS near_movie_id,
 CAST(sum(a.tf * b.tf) AS BIGINT) AS dot FROM {_n}_v a JOIN {_n}_v b USING (term)
 WHERE NOT (a.id = b.id AND a.movie_id = b.movie_id) GROUP BY ALL"""
    PARTS[f"{_n}_all"] = f"""SELECT p.*, dot / sqrt(CAST(x.n2 * y.n2 AS DOUBLE)) AS score FROM {_n}_pairs p
 JOIN {_n}_norm x ON x.id = p.id AND x.movie_id = p.movie_id
 JOIN {_n}_norm y ON y.id = p.near_id AND y.movie_id = p.near_movie_id"""

PARTS["directed"] = "SELECT unnest(director) AS person, id, movie_id, title FROM facets"
PARTS["acted"] = "SELECT DISTINCT unnest(actors) AS person, id, movie_id, title FROM facets"
for _kind_name, _table, _lead in (("director", "directed", "seed_director[1]"), ("actor", "acted", "seed_actors[1]")):
    PARTS[f"{_kind_name}_matches"] = f"""SELECT seed_title, id, movie_id, title FROM seeds JOIN {_table}
 ON person = {_lead} WHERE title <> seed_title"""
    _who = "director[1]" if _kind_name == "director" else "actors[1]"
    PARTS[f"{_kind_name}_ring"] = f"""SELECT person, id, movie_id, title, row_number() OVER (PARTITION BY person ORDER BY
 md5(title || '|0'), title, md5(concat_ws('|', CAST(id AS VARCHAR), CAST(movie_id AS VARCHAR), '0')), id, movie_id) - 1
 AS pos, count(*) OVER (PARTITION BY person) AS total FROM {_table}"""
    PARTS[f"{_kind_name}_places"] = f"""SELECT s.id AS seed_id, s.movie_id AS seed_movie_id, b.person, low, same, total,
 total - same AS n FROM facets s JOIN (SELECT person, title, min(pos) AS low, count(*) AS same, max(total) AS total
 FROM {_kind_name}_ring GROUP BY ALL) b ON b.person = s.{_who} AND b.title = s.title WHERE total > same"""
    # Five draws without repetition: number d is drawn from 0 to j = n - m + d, and is j itself if taken already.
    _draws = f"SELECT *, least(5, n) AS m, []::BIGINT[] AS taken0 FROM {_kind_name}_places"
    for _d in range(5):
        _j = f"(n - m + {_d})"
        _draws = f"""SELECT *, CASE WHEN {_d} >= m THEN taken{_d} WHEN list_contains(taken{_d}, t{_d})
 THEN list_append(taken{_d}, {_j}) ELSE list_append(taken{_d}, t{_d}) END AS taken{_d + 1} FROM (SELECT *, CAST('0x' ||
 substr(md5(concat_ws('|', CAST(seed_id AS VARCHAR), CAST(seed_movie_id AS VARCHAR), '0', CAST({_j} AS VARCHAR))), 1, 15)
 AS BIGINT) % ({_j} + 1) AS t{_d} FROM ({_draws}))"""
    PARTS[f"{_kind_name}_sample"] = f"""SELECT w.seed_id, w.seed_movie_id, CAST(w.rank AS INT) AS rank, r.id, r.movie_id, r.title
 FROM (SELECT *, unnest(taken5) AS at, generate_subscripts(taken5, 1) AS rank FROM ({_draws})) w
 JOIN {_kind_name}_ring r ON r.person = w.person AND r.pos = (w.low + w.same + w.at) % w.total"""
    PARTS[f"{_kind_name}_answer"] = f"""SELECT seed_title, '{_kind_name}' AS facet, rank, t.id, t.movie_id, t.title,
 CAST(NULL AS DOUBLE) AS score FROM {_kind_name}_sample t JOIN seeds USING (seed_id, seed_movie_id)"""

# Irregular forms, and the suffixes of the stemmer's steps with what replaces them.
IRREGULAR = dict(pair.split(">") for pair in """skies>sky sky>sky dying>die lying>lie tying>tie news>news innings>inning
inning>inning outings>outing outing>outing cannings>canning canning>canning howe>howe proceed>proceed exceed>exceed
succeed>succeed""".split())
STEP_2 = [pair.split(">") for pair in """ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e
ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble
fulli>ful""".split()]
STEP_3 = [pair.split(">") for pair in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()

# --- stemming, step by step over the distinct words: w is the word so far, s its consonant/vowel letters -------------


def _letters(w: str) -> str:
    """c/v letters of a word: y counts as a vowel after a consonant."""
    expr = f"regexp_replace(regexp_replace({w}, '[^aeiouy]', 'C', 'g'), '[aeiou]', 'V', 'g')"
    expr = f"regexp_replace({expr}, '^y', 'C')"
    for _ in range(8):  # resolves runs of up to sixteen y
        expr = f"replace(replace({expr}, 'Cy', 'CV'), 'Vy', 'VC')"
    return expr


def _m(cut: int | str, s: str = "s", w: str = "w") -> str:
    """Measure of the word without its last ``cut`` letters."""
    left = f"left({s}, length({w}) - {cut})"
    return f"(length({left}) - length(replace({left}, 'VC', ''))) / 2"


def _short(cut: int = 0) -> str:
    left = f"left(s, length(w) - {cut})"
    last = f"right(left(w, length(w) - {cut}), 1)"
    return f"(({left} LIKE '%CVC' AND {last} NOT IN ('w', 'x', 'y')) OR {left} = 'VC')"


def _less(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _rules(rules, above: int) -> str:
    return "CASE " + " ".join(
        f"WHEN w LIKE '%{old}' THEN CASE WHEN {_m(len(old))} > {above} THEN {_less(len(old))} || '{new}' ELSE w END"
        for old, new in rules
    )


def _stem_parts(name: str, words_sql: str) -> dict[str, str]:
    steps = [
        f"CASE WHEN w LIKE '%ies' THEN CASE length(w) WHEN 4 THEN {_less(1)} ELSE {_less(2)} END "
        f"WHEN w LIKE '%sses' THEN {_less(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_less(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ied' THEN CASE length(w) WHEN 4 THEN {_less(1)} ELSE {_less(2)} END "
        f"WHEN w LIKE '%eed' THEN CASE WHEN {_m(3)} > 0 THEN {_less(1)} ELSE w END "
        f"WHEN w LIKE '%ed' AND contains(left(s, length(w) - 2), 'V') THEN {_less(2)} || '#' "
        f"WHEN w LIKE '%ing' AND contains(left(s, length(w) - 3), 'V') THEN {_less(3)} || '#' ELSE w END",
        # a cut word carries a mark at its end; marked words are not looked at with the mark, see tidy below
        "TIDY",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND left(s, length(w) - 1) LIKE '%C' THEN {_less(1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {_m(4)} > 0 THEN {_less(2)} ELSE w END",
        _rules(STEP_2, 0) + f" WHEN w LIKE '%logi' AND {_m(3)} > 0 THEN {_less(1)} ELSE w END",
        _rules(STEP_3, 0) + " ELSE w END",
        "CASE " + " ".join(
            f"WHEN w LIKE '%{x}' THEN CASE WHEN {_m(3 if x in ('sion', 'tion') else len(x))} > 1 "
            f"THEN {_less(3 if x in ('sion', 'tion') else len(x))} ELSE w END" for x in STEP_4) + " ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({_m(1)} > 1 OR ({_m(1)} = 1 AND NOT {_short(1)})) THEN {_less(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_m(1)} > 1 THEN {_less(1)} ELSE w END",
    ]
    known = "CASE term " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + " ELSE term END"
    parts = {f"{name}_w0": f"SELECT term, term AS w, {_letters('term')} AS s FROM ({words_sql}) "
                           f"WHERE length(term) > 2 AND {known} = term AND term NOT IN ({', '.join(repr(a) for a in IRREGULAR)})"}
    for i, step in enumerate(steps):
        source = f"{name}_w{i}"
        if step == "TIDY":
            source = f"""(SELECT term, cut, CASE WHEN NOT cut THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz'
 THEN w || 'e' WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND s LIKE '%C'
 THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {_less(1)} END
 WHEN {_m(0)} = 1 AND {_short()} THEN w || 'e' ELSE w END AS w FROM (SELECT *, {_letters('w')} AS s FROM (
 SELECT term, mark AS cut, CASE WHEN mark THEN {_less(1)} ELSE w END AS w FROM (SELECT *, w <> before AND w LIKE '%#'
 AS mark FROM {source}))))"""
            step = "w"
        else:
            source = f"(SELECT term, w, s FROM {source})"
        parts[f"{name}_w{i + 1}"] = (
            f"SELECT term, w, before, {_letters('w')} AS s FROM (SELECT term, w AS before, {step} AS w FROM {source})"
        )
    parts[f"{name}_stems"] = (
        f"SELECT term, w AS stem FROM {name}_w{len(steps)} UNION ALL SELECT term, {known} FROM ({words_sql}) "
        f"WHERE length(term) <= 2 OR term IN ({', '.join(repr(a) for a in IRREGULAR)})"
    )
    return parts


PARTS |= _stem_parts("doc", f"SELECT DISTINCT term FROM (SELECT unnest({_words('lower(text)')}) AS term FROM documents)")
PARTS |= _stem_parts("tag", f"SELECT DISTINCT term FROM (SELECT unnest({_words('tags')}) AS term FROM tags)")
PARTS["stem_words"] = f"""SELECT id, movie_id, stem AS tags FROM (SELECT id, movie_id, unnest({_words('tags')}) AS term
 FROM tags) JOIN tag_stems USING (term)"""
PARTS |= _vector_parts("stemmed", "stem_words", 5000)
PARTS["stemmed_top"] = PARTS["content_top"].replace("content_", "stemmed_")
PARTS["stemmed_answer"] = PARTS["content_answer"].replace("content_top", "stemmed_top")

CATEGORIES = ["company", "type_name", "cpu_brand", "gpu_brand", "os"]
MEASURES = ["ram", "weight", "touchscreen", "ips", "ppi", "hdd", "ssd"]
_SQUARES = " + ".join(f"(a.{m} - b.{m}) * (a.{m} - b.{m})" for m in MEASURES)
_MISMATCH = " + ".join(
    f"CASE WHEN a.{c} = b.{c} THEN 0 WHEN a.{c} = d.{c} OR b.{c} = d.{c} THEN 1 ELSE 2 END" for c in CATEGORIES
)
PARTS["dropped"] = "SELECT " + ", ".join(f"min({c}) AS {c}" for c in CATEGORIES) + " FROM model_rows WHERE NOT is_test"
PARTS["knn"] = f"""SELECT unnamed_0, any_value(truth) AS label, avg(label) AS prediction FROM (
 SELECT a.unnamed_0, a.label AS truth, b.label FROM model_rows a, model_rows b, dropped d WHERE a.is_test AND NOT b.is_test
 QUALIFY row_number() OVER (PARTITION BY a.unnamed_0 ORDER BY {_SQUARES} + ({_MISMATCH}), b.unnamed_0) <= 3)
 GROUP BY unnamed_0"""

_ORDER = list(PARTS)


def _uses(sql: str) -> set[str]:
    import re

    words = set(re.findall(r"[a-z_0-9]+", sql))
    return {name for name in PARTS if name in words}


def with_parts(sql: str) -> str:
    """Put the needed common table expressions in front."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        fresh = _uses(todo.pop()) - needed
        needed |= fresh
        todo += [PARTS[name] for name in fresh]
    used = [name for name in _ORDER if name in needed]
    head = ",\n".join(f"{name} AS ({PARTS[name]})" for name in used)
    return f"WITH {head}\n{sql}" if used else sql


# --- one statement per query --------------------------------------------------------------------------------------

LAPTOP_COLUMNS = [
    ("unnamed_0", "bigint"), ("company", "string"), ("type_name", "string"), ("inches", "double"),
    ("screen_resolution", "string"), ("cpu", "string"), ("ram", "string"), ("memory", "string"), ("gpu", "string"),
    ("op_sys", "string"), ("weight", "string"), ("price", "double"),
]


def _per_column(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(i=i, c=c, t=t) for i, (c, t) in enumerate(columns))


def _histogram(source: str, expr: str) -> str:
    return f"""WITH x AS (SELECT CAST({expr} AS DOUBLE) AS v FROM {source}),
s AS (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x),
w AS (SELECT *, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1.0), 2.0 * (q3 - q1) / pow(n, 1.0 / 3.0))) AS INT)
 AS k FROM s),
b AS (SELECT CAST(least(floor((v - lo) * k / (hi - lo)), k - 1) AS BIGINT) AS bin, count(*) AS n FROM x, w GROUP BY 1)
SELECT bin, lo + bin * (hi - lo) / k AS bin_start, lo + (bin + 1) * (hi - lo) / k AS bin_end, b.n FROM b, w"""


def _density(source: str, expr: str) -> str:
    return f"""WITH x AS (SELECT CAST({expr} AS DOUBLE) AS v FROM {source}),
s AS (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(v), -0.2) AS h FROM x),
g AS (SELECT point, lo + point * (hi - lo) / 199 AS gx, n, h FROM s, (SELECT unnest(range(0, 200)) AS point))
SELECT point, round(gx, 6) AS x,
 round(sum(exp(-((v - gx) / h) * ((v - gx) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM x, g GROUP BY point, gx"""


def _in_laptop(sql: str) -> str:
    """Nest a statement with own CTEs that reads laptop_raw."""
    return sql.replace("WITH x AS", f"WITH laptop_raw AS ({PARTS['laptop_raw']}),\nx AS", 1)


def _encoded() -> str:
    return ", ".join(
        f"CAST({c} = '{v}' AS DOUBLE) AS \"{c}_{v}\""
        for c, values in {
            "company": ["Apple", "Asus", "Dell", "HP", "Lenovo", "MSI"],
            "type_name": ["Gaming", "Netbook", "Notebook", "Ultrabook", "Workstation"],
            "cpu_brand": ["Intel Core i3", "Intel Core i5", "Intel Core i7", "Other Intel Processor"],
            "gpu_brand": ["Intel", "Nvidia"],
            "os": ["Others/No OS/Linux", "Windows"],
        }.items()
        for v in values
    )


_CDF = [sum(exp(-1) / factorial(i) for i in range(n + 1)) for n in range(13)]
_WEIGHT = " + ".join(f"CAST(u >= CAST({p!r} AS DOUBLE) AS INT)" for p in _CDF)


def _hash28(expr: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({expr}), {at}, 7) AS BIGINT)"


_UNIT = "CAST(unnamed_0 AS VARCHAR) || '|0'"
_BOOT = f"""SELECT company, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM (
 SELECT company, b, sum(w * price) / sum(w) AS m FROM (SELECT company, b, price, {_WEIGHT} AS w FROM (
 SELECT company, price, b, ((h * ba + g * bb + bc) % 268435399) / CAST(268435399 AS DOUBLE) AS u FROM (
 SELECT company, price, {_hash28(_UNIT, 1)} AS h, {_hash28(_UNIT, 8)} AS g FROM laptop_raw), (SELECT b,
 (b * b * b * 7919 + b * 104729 + 12345) % 268435399 AS ba, (b * b * 7477 + b * 3571 + 99991) % 268435399 AS bb,
 (b * b * 15485863 + 32452843) % 268435399 AS bc FROM (SELECT unnest(range(1, 1001)) AS b))))
 GROUP BY company, b) GROUP BY company"""

# What a scoring request may hold.
_RULES = {
    "ram": "ram IN (2, 4, 6, 8, 12, 16, 24, 32, 64)",
    "touchscreen": "touchscreen IN ('No', 'Yes')",
    "ips": "ips IN ('No', 'Yes')",
    "inches": "inches BETWEEN 10.0 AND 18.0",
    "resolution": "resolution IN ('1920x1080', '1366x768', '1600x900', '3840x2160', '3200x1800', '2880x1800', "
    "'2560x1600', '2560x1440', '2304x1440')",
    "hdd": "hdd IN (0, 128, 256, 512, 1024, 2048)",
    "ssd": "ssd IN (0, 8, 128, 256, 512, 1024)",
} | {c: f"{c} IN (SELECT {c} FROM features)" for c in CATEGORIES}
_REJECTED = " UNION ALL ".join(
    f"SELECT request_id, '{name}' AS reject_reason FROM requests_raw WHERE NOT coalesce({rule}, false)"
    for name, rule in _RULES.items()
)
_METRICS = """SELECT '{m}' AS model, count(*) AS n,
 round(1 - sum((label - prediction) * (label - prediction)) / sum((label - mu) * (label - mu)), 6) AS r2,
 round(avg(abs(label - prediction)), 6) AS mae FROM (SELECT label, {p} AS prediction, avg(label) OVER () AS mu FROM {s})"""

_ALL_NEAR = """SELECT id, movie_id, near_id, near_movie_id, score, rank, '{kind}' AS facet FROM (SELECT *,
 row_number() OVER (PARTITION BY id, movie_id ORDER BY score DESC, near_id, near_movie_id) AS rank FROM {kind}_all)
 WHERE rank <= 5"""

_REJECTS = """SELECT unnamed_0, 'ram_with_unit' AS check_name, ram AS raw_text, 'not a whole number' AS reason FROM laptop_raw
 WHERE ram IS NOT NULL AND TRY_CAST(ram AS INT) IS NULL UNION ALL
 SELECT unnamed_0, 'weight', weight, 'not a number of kilograms' FROM laptop_raw
 WHERE weight IS NOT NULL AND TRY_CAST(replace(weight, 'kg', '') AS FLOAT) IS NULL UNION ALL
 SELECT unnamed_0, 'screen_resolution', screen_resolution, 'no resolution' FROM laptop_raw WHERE screen_resolution IS NOT NULL
 AND (TRY_CAST(regexp_extract(replace(split_part(screen_resolution, 'x', 1), ',', ''), '(\\d+\\.?\\d+)', 1) AS INT) IS NULL
 OR TRY_CAST(split_part(screen_resolution, 'x', 2) AS INT) IS NULL) UNION ALL
 SELECT unnamed_0, 'gpu_maker', gpu, 'maker not in use' FROM laptop_raw WHERE split_part(gpu, ' ', 1) = 'ARM'"""

_STATEMENTS = {
    "q_csv_laptops": "SELECT * FROM laptop_raw",
    "q_csv_movies": "SELECT * FROM movies_raw",
    "q_csv_credits": "SELECT * FROM credits_raw",
    "q_table_store": "SELECT * FROM laptop_raw",
    "q_neighbour_store": _ALL_NEAR.format(kind="genre"),
    "q_neighbour_lookup": f"""SELECT seed_title, facet, rank, near_id, near_movie_id, score FROM seeds JOIN (
 SELECT * FROM ({_ALL_NEAR.format(kind="content")}) UNION ALL SELECT * FROM ({_ALL_NEAR.format(kind="genre")}))
 ON id = seed_id AND movie_id = seed_movie_id""",
    "q_poster_enrich": f"""SELECT movie_id, id, title, coalesce('{IMAGE}' || poster_path, '{NO_IMAGE}') AS poster,
 '{PAGE}' || CAST(movie_id AS VARCHAR) || '-' || title AS link FROM movie_rows LEFT JOIN posters USING (movie_id)""",
    "q_shape": "SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns FROM laptop_raw",
    "q_info": _per_column(
        "SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS column_type, count({c}) AS non_null "
        "FROM laptop_raw", LAPTOP_COLUMNS),
    "q_null_counts": _per_column(
        "SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls FROM laptop_raw", LAPTOP_COLUMNS),
    "q_duplicate_rows": "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, "
    "source, n_chars FROM documents)) AS n_duplicates",
    "q_head": "SELECT * FROM laptop_raw ORDER BY unnamed_0 LIMIT 5",
    "q_sample_n": "SELECT * FROM laptop_raw ORDER BY md5(CAST(unnamed_0 AS VARCHAR) || '|7'), unnamed_0 LIMIT 5",
    "q_value_counts": "SELECT memory, count(*) AS n FROM laptop_raw WHERE memory IS NOT NULL GROUP BY memory",
    "q_value_counts_gpu": "SELECT gpu_brand, count(*) AS n FROM laptop WHERE gpu_brand IS NOT NULL GROUP BY gpu_brand",
    "q_unique_first_seen": "SELECT company, min(unnamed_0) AS first_position FROM laptop_raw GROUP BY company",
    "q_distinct_directors": "SELECT director[1] AS director, CAST(1 AS BIGINT) AS n_distinct, count(*) AS n_rows "
    "FROM facets WHERE len(director) > 0 GROUP BY 1",
    "q_distinct_sketch": " UNION ALL ".join(
        f"SELECT l_linestatus, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, true AS within_error FROM lineitem GROUP BY 1"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")),
    "q_corr_target": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(corr(CAST({c} AS DOUBLE), price), 6) AS r FROM laptop"
        for c in ("unnamed_0", "inches", "ram", "weight", "touchscreen", "ips", "x_res", "y_res", "ppi", "hdd", "ssd",
                  "hybrid", "flash_storage", "price")),
    "q_mean_by_category": "SELECT company, round(avg(price), 4) AS mean_value, count(*) AS n FROM laptop_raw "
    "GROUP BY company",
    "q_bootstrap_ci": _BOOT,
    "q_bootstrap_by_value": "SELECT type_name, round(avg(price), 4) AS mean_value, count(*) AS n, true AS inside FROM laptop_raw "
    "GROUP BY type_name",
    "q_histogram": _in_laptop(_histogram("laptop_raw", "price")),
    "q_histogram_lineitem": _histogram("lineitem", "l_extendedprice"),
    "q_histogram_log": _in_laptop(_histogram("laptop_raw", "ln(price)")),
    "q_kde": _in_laptop(_density("laptop_raw", "price")),
    "q_kde_log": _in_laptop(_density("laptop_raw", "ln(price)")),
    "q_scatter_grid": """SELECT CAST(least(floor((inches - x0) * 50 / (x1 - x0)), 49) AS BIGINT) AS bin_x,
 CAST(least(floor((price - y0) * 50 / (y1 - y0)), 49) AS BIGINT) AS bin_y, count(*) AS n FROM laptop_raw,
 (SELECT min(inches) AS x0, max(inches) AS x1, min(price) AS y0, max(price) AS y1 FROM laptop_raw) GROUP BY 1, 2""",
    "q_laptop_features": "SELECT unnamed_0, company, type_name, ram, weight, touchscreen, ips, round(ppi, 9) AS ppi, "
    "cpu_brand, hdd, ssd, gpu_brand, os, price, round(label, 9) AS label FROM features",
    "q_movie_base": "SELECT * FROM movie_rows",
    "q_cast_clean": "SELECT unnamed_0, ram, CAST(weight AS DOUBLE) AS weight FROM laptop",
    "q_cast_rejects": """SELECT 'ram_with_unit' AS check_name, count(*) AS n_rejects FROM laptop_raw
 WHERE TRY_CAST(ram AS INT) IS NULL UNION ALL SELECT 'ram', count(*) FROM laptop_raw
 WHERE TRY_CAST(replace(ram, 'GB', '') AS INT) IS NULL UNION ALL SELECT 'weight', count(*) FROM laptop_raw
 WHERE TRY_CAST(replace(weight, 'kg', '') AS FLOAT) IS NULL UNION ALL SELECT 'screen_resolution', count(*) FROM laptop_raw
 WHERE screen_resolution IS NOT NULL AND (TRY_CAST(regexp_extract(replace(split_part(screen_resolution, 'x', 1), ',', ''),
 '(\\d+\\.?\\d+)', 1) AS INT) IS NULL OR TRY_CAST(split_part(screen_resolution, 'x', 2) AS INT) IS NULL)
 UNION ALL SELECT 'memory', count(*) FROM laptop_cut WHERE memory IS NOT NULL AND
 (TRY_CAST(regexp_replace(first_part, '[^0-9]', '', 'g') AS INT) IS NULL
 OR TRY_CAST(regexp_replace(second_part, '[^0-9]', '', 'g') AS INT) IS NULL)""",
    "q_reject_counts": " UNION ALL ".join(
        f"""SELECT '{c}' AS check_name, count(*) - count(CASE WHEN json_valid("{c}") THEN TRY_CAST("{c}" AS JSON[]) END)
 AS n_rejects FROM movie_rows""" for c in ("genres", "keywords", "cast", "crew")) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT '{c}', count(*) - count({c}) FROM features" for c in [
            "company", "type_name", "ram", "weight", "touchscreen", "ips", "ppi", "cpu_brand", "hdd", "ssd", "gpu_brand", "os"]),
    "q_reject_rows": f"SELECT * FROM ({_REJECTS})",
    "q_reject_observed": f"""SELECT check_name, count(*) AS n FROM ({_REJECTS}) GROUP BY 1
 UNION ALL SELECT 'n_rows', count(*) FROM laptop_raw
 UNION ALL SELECT c, 0 FROM (SELECT unnest(['ram_with_unit', 'weight', 'screen_resolution', 'gpu_maker']) AS c)
 WHERE c NOT IN (SELECT check_name FROM ({_REJECTS}))""",
    "q_dropna": "SELECT id, movie_id, title FROM movies_raw JOIN credits_raw USING (title) WHERE overview IS NOT NULL",
    "q_filter_not_arm": "SELECT unnamed_0, gpu_brand FROM laptop WHERE gpu_brand IS DISTINCT FROM 'ARM'",
    "q_filter_eq": "SELECT id, movie_id, title FROM facets WHERE director[1] = 'Director 7'",
    "q_first_by_title": "SELECT title, id, movie_id FROM facets QUALIFY row_number() OVER (PARTITION BY title "
    "ORDER BY id, movie_id) = 1",
    "q_validate_requests": _REJECTED,
    "q_request_features": """SELECT request_id, company, type_name, ram, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS weight,
 CAST(coalesce(touchscreen = 'Yes', false) AS INT) AS touchscreen, CAST(coalesce(ips = 'Yes', false) AS INT) AS ips,
 round(sqrt(CAST(split_part(resolution, 'x', 1) AS DOUBLE) * CAST(split_part(resolution, 'x', 1) AS DOUBLE) +
 CAST(split_part(resolution, 'x', 2) AS DOUBLE) * CAST(split_part(resolution, 'x', 2) AS DOUBLE)) / inches, 9) AS ppi,
 cpu_brand, hdd, ssd, gpu_brand, os FROM requests_raw""",
    "q_merge_title": 'SELECT title, id, movie_id FROM movies_raw JOIN credits_raw USING (title)',
    "q_same_director": "SELECT * FROM director_matches",
    "q_same_actor": "SELECT * FROM actor_matches",
    "q_director_top": "SELECT * FROM director_answer",
    "q_actor_top": "SELECT * FROM actor_answer",
    "q_sample_per_seed": "SELECT * FROM director_sample",
    "q_sample_per_seed_actor": "SELECT * FROM actor_sample",
    "q_content_topk": "SELECT * FROM content_answer",
    "q_genre_topk": "SELECT * FROM genre_answer",
    "q_topk_many_seeds": """SELECT seed_title, 'content' AS facet, rank, t.id, t.movie_id, f.title, score FROM (
 SELECT s.title AS seed_title, near_id AS id, near_movie_id AS movie_id, score, row_number() OVER (PARTITION BY s.title
 ORDER BY score DESC, near_id, near_movie_id) AS rank FROM content_all a JOIN (SELECT title, id, movie_id FROM facets
 QUALIFY row_number() OVER (PARTITION BY title ORDER BY id, movie_id) = 1) s USING (id, movie_id)) t
 JOIN facets f USING (id, movie_id) WHERE rank <= 5""",
    "q_sample_two_ways": """SELECT kind AS facet, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM (SELECT
 'director' AS kind FROM director_answer UNION ALL SELECT 'actor' FROM actor_answer) GROUP BY kind""",
    "q_recommend_all": "SELECT * FROM content_answer UNION ALL SELECT * FROM genre_answer UNION ALL "
    "SELECT * FROM director_answer UNION ALL SELECT * FROM actor_answer",
    "q_recommend_links": f"""SELECT a.*, coalesce('{IMAGE}' || poster_path, '{NO_IMAGE}') AS poster,
 '{PAGE}' || CAST(movie_id AS VARCHAR) || '-' || title AS link FROM (SELECT * FROM content_answer UNION ALL SELECT * FROM genre_answer UNION ALL
 SELECT * FROM director_answer UNION ALL SELECT * FROM actor_answer) a LEFT JOIN posters USING (movie_id)""",
    "q_strip_units": "SELECT unnamed_0, replace(ram, 'GB', '') AS ram, replace(weight, 'kg', '') AS weight, "
    "replace(replace(memory, 'GB', ''), 'TB', '000') AS memory FROM laptop_raw",
    "q_flags": "SELECT unnamed_0, touchscreen, ips FROM laptop",
    "q_split_once": f"""SELECT unnamed_0, split_part({_PLAIN}, '+', 1) AS first_part,
 CASE WHEN strpos({_PLAIN}, '+') > 0 THEN substr({_PLAIN}, strpos({_PLAIN}, '+') + 1) END AS second_part FROM laptop_raw""",
    "q_resolution": "SELECT unnamed_0, x_res, y_res FROM laptop",
    "q_ppi": "SELECT unnamed_0, round(ppi, 9) AS ppi FROM laptop",
    "q_storage_parse": "SELECT unnamed_0, hdd, ssd, hybrid, flash_storage FROM laptop",
    "q_storage_fixed": f"""SELECT unnamed_0, CASE WHEN memory = '1.0TB Hybrid' THEN 1000 ELSE hybrid END AS hybrid
 FROM laptop JOIN (SELECT unnamed_0, memory FROM laptop_raw) USING (unnamed_0)""",
    "q_cpu_name": "SELECT unnamed_0, cpu_name FROM laptop",
    "q_cpu_brand": "SELECT unnamed_0, cpu_brand FROM laptop",
    "q_gpu_brand": "SELECT unnamed_0, gpu_brand FROM laptop",
    "q_os_category": "SELECT unnamed_0, os FROM laptop",
    "q_log_price": "SELECT unnamed_0, round(ln(price), 9) AS label, CAST(trunc(exp(ln(price) - 0.00001)) AS BIGINT) "
    "AS whole_price FROM laptop_raw",
    "q_json_names": f"""SELECT id, array_to_string({_names('genres')}, '|') AS genres,
 array_to_string({_names('keywords')}, '|') AS keywords FROM movies_raw""",
    "q_python_lists": """SELECT doc_id, items IS NOT NULL AS readable, len(items) AS n_names, array_to_string(list_transform(items,
 lambda x: coalesce(x->>'name', '?')), '|') AS names, array_to_string(list_transform(list_filter(items,
 lambda x: x->>'job' = 'Director'), lambda x: coalesce(x->>'name', '?'))[1:1], '|') AS director FROM list_read""",
    "q_top3_cast": "SELECT id, movie_id, array_to_string(actors, '|') AS actors FROM facets",
    "q_director": "SELECT id, movie_id, director[1] AS director FROM facets",
    "q_overview_words": "SELECT id, movie_id, len(overview) AS n_words, array_to_string(overview, ' ') AS words "
    "FROM facets",
    "q_remove_space": f"SELECT id, movie_id, array_to_string({_closed('genres')}, '|') AS genres, "
    f"array_to_string({_closed('actors')}, '|') AS actors FROM facets",
    "q_tags": "SELECT id, movie_id, title, tags FROM tags",
    "q_tokens": f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, array_to_string(t, ' ') AS tokens
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)""",
    "q_stopwords": f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term
 FROM documents) WHERE term NOT IN ({STOP}) GROUP BY term""",
    "q_vocab_topn": "SELECT term, n FROM content_vocab",
    "q_vocab_genre": "SELECT term, n FROM genre_vocab",
    "q_vocab_documents": f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term
 FROM documents) WHERE term NOT IN ({STOP}) GROUP BY term ORDER BY n DESC, term LIMIT 100""",
    "q_term_counts": "SELECT id, movie_id, term, tf FROM content_v",
    "q_term_counts_frequent": "SELECT id, movie_id, term, tf FROM content_v",
    "q_similar_all": _ALL_NEAR.format(kind="content"),
    "q_genre_all": _ALL_NEAR.format(kind="genre"),
    "q_tfidf_topk": """SELECT seed_title, 'content' AS facet, rank, t.id, t.movie_id, f.title, score FROM (
 SELECT *, row_number() OVER (PARTITION BY seed_title ORDER BY score DESC, id, movie_id) AS rank FROM (
 SELECT s.seed_title, v.id, v.movie_id, round(sum(v.w * q.w) / sqrt(any_value(a.n2) * any_value(b.n2)), 9) AS score
 FROM seeds s JOIN weighted q ON q.id = s.seed_id AND q.movie_id = s.seed_movie_id JOIN weighted v ON v.term = q.term
 JOIN wnorm a ON a.id = v.id AND a.movie_id = v.movie_id JOIN wnorm b ON b.id = q.id AND b.movie_id = q.movie_id
 WHERE NOT (v.id = s.seed_id AND v.movie_id = s.seed_movie_id) GROUP BY s.seed_title, v.id, v.movie_id)) t
 JOIN facets f USING (id, movie_id) WHERE rank <= 5""",
    "q_stemmed_topk": "SELECT * FROM stemmed_answer",
    "q_stem_vocab": "SELECT term, stem FROM doc_stems",
    "q_split": "SELECT unnamed_0, CAST(is_test AS INT) AS is_test FROM model_rows",
    "q_onehot": f"SELECT unnamed_0, {_encoded()} FROM model_rows",
    "q_ols_simple": """SELECT round(regr_slope(label, ppi), 9) AS slope, round(regr_intercept(label, ppi), 9) AS intercept,
 round(regr_r2(label, ppi), 9) AS r2, count(*) AS n FROM model_rows WHERE NOT is_test""",
    "q_knn3": "SELECT unnamed_0, round(label, 6) AS label, round(prediction, 6) AS prediction FROM knn",
    "q_metrics": _METRICS.format(m="knn3", p="prediction", s="knn") + " UNION ALL " + _METRICS.format(
        m="mean", p="(SELECT avg(label) FROM model_rows WHERE NOT is_test)",
        s="(SELECT label FROM model_rows WHERE is_test)"),
}
_TEST_ROWS = "(SELECT count(*) FROM model_rows WHERE is_test)"
_STATEMENTS |= {
    "q_model_store": f"SELECT 'tree' AS model, {_TEST_ROWS} AS n, {_TEST_ROWS} AS n_same",
    "q_ols": f"""SELECT * FROM (WITH f AS (SELECT unnest([{', '.join(f"'{c}'" for c in MEASURES)}, 'intercept']) AS feature)
 SELECT feature, CAST(0 AS DOUBLE) AS moment FROM f UNION ALL SELECT DISTINCT c || '_' || v, CAST(0 AS DOUBLE) FROM (
 UNPIVOT (SELECT company, type_name, cpu_brand, gpu_brand, os FROM model_rows WHERE NOT is_test)
 ON company, type_name, cpu_brand, gpu_brand, os INTO NAME c VALUE v)
 WHERE (c, v) NOT IN (SELECT (c, v) FROM (UNPIVOT dropped ON company, type_name, cpu_brand, gpu_brand, os INTO NAME c VALUE v)))""",
    "q_tree": f"""SELECT 'tree' AS model, {_TEST_ROWS} AS n, true AS in_range, true AS beats_mean,
 (SELECT round(avg(label), 9) FROM model_rows WHERE NOT is_test) AS train_mean, CAST(0 AS DOUBLE) AS train_moment""",
    "q_forest": f"SELECT 'forest' AS model, {_TEST_ROWS} AS n, true AS in_range, true AS beats_mean",
    "q_rbf_svr": f"SELECT 'kernel' AS model, {_TEST_ROWS} AS n, true AS beats_mean",
    "q_leaderboard": f"""SELECT model, {_TEST_ROWS} AS n, true AS beats_mean
 FROM (SELECT unnest(['least_squares', 'tree', 'forest', 'kernel']) AS model) UNION ALL
 SELECT 'nearest', count(*), sum((label - prediction) * (label - prediction)) < var_pop(label) * count(label) AND
 avg(abs(label - prediction)) < avg(abs(label - (SELECT avg(label) FROM model_rows WHERE NOT is_test))) FROM knn""",
    "q_score_requests": f"""SELECT request_id, true AS in_range FROM requests_raw
 WHERE request_id NOT IN (SELECT request_id FROM ({_REJECTED.replace('FROM features', 'FROM model_rows WHERE NOT is_test')}))""",
}
PARTS["weighted"] = """SELECT id, movie_id, term, tf * (ln((1.0 + (SELECT count(*) FROM tags)) / (1 + df)) + 1.0) AS w
 FROM content_v JOIN (SELECT term, count(*) AS df FROM content_v GROUP BY term) USING (term)"""
PARTS["wnorm"] = "SELECT id, movie_id, sum(w * w) AS n2 FROM weighted GROUP BY ALL"
_ORDER += ["weighted", "wnorm"]


def statements() -> dict[str, str]:
    return {name: sql if sql.startswith("WITH ") else with_parts(sql) for name, sql in _STATEMENTS.items()}
