"""Catalogue-shaped inputs derived from the driver's ``part`` and ``documents`` tables (see FIXTURES.md).

Each view is a list of (expression, alias); the expressions give equal rows in Spark SQL and in DuckDB, so the same list
builds the Spark input and the CTE in front of the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_OF = {
    "laptop_raw": "part",
    "requests_raw": "part",
    "movies_raw": "documents",
    "credits_raw": "documents",
    "posters": "documents",
    "lists_raw": "documents",
}

_TITLE = "CONCAT('Title ', CAST(doc_id - CASE WHEN doc_id % 97 = 1 THEN 1 ELSE 0 END AS STRING))"


def _cycle(number: str, values: list[str]) -> str:
    """CASE over ``number % len(values)``."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {number} % {len(values)} {arms} ELSE '{values[-1]}' END"


def _part_div(n: int) -> str:
    return f"CAST(floor(p_partkey / {n}) AS BIGINT)"


_BRANDS = ["Acer", "Apple", "Asus", "Dell", "HP", "Lenovo", "MSI"]
_TYPES = ["Ultrabook", "Notebook", "Netbook", "Gaming", "2 in 1 Convertible", "Workstation"]
_SCREENS = [
    "IPS Panel Retina Display 2560x1600", "1440x900", "Full HD 1920x1080", "1366x768",
    "IPS Panel Full HD / Touchscreen 1920x1080", "4K Ultra HD / Touchscreen 3840x2160", "Touchscreen 1366x768",
    "Quad HD+ 3200x1800",
]
_CPUS = [
    "Intel Core i5 2.3GHz", "Intel Core i7 7500U 2.7GHz", "Intel Core i3 6006U 2GHz", "AMD A9-Series 9420 3GHz",
    "Intel Celeron Dual Core N3350 1.1GHz", "Samsung Cortex A72 2.0GHz",
]
_MEMORY = [
    "128GB SSD", "128GB Flash Storage", "512GB SSD", "1TB HDD", "256GB SSD +  1TB HDD", "1.0TB Hybrid",
    "64GB Flash Storage +  1TB HDD", "128GB SSD +  2TB HDD",
]
_GPUS = [
    "Intel Iris Plus Graphics 640", "AMD Radeon R5", "Nvidia GeForce MX150", "Intel HD Graphics 620",
    "ARM Mali T860 MP4",
]
_SYSTEMS = ["macOS", "No OS", "Windows 10", "Mac OS X", "Linux", "Windows 10 S", "Chrome OS", "Windows 7"]
_GENRES = [
    '[{"id": 28, "name": "Action"}, {"id": 878, "name": "Science Fiction"}]',
    '[{"id": 35, "name": "Comedy"}]',
    '[{"id": 18, "name": "Drama"}, {"id": 10749, "name": "Romance"}]',
    '[]',
    '[{"id": 10770, "name": "TV Movie"}, {"id": 35, "name": "Comedy"}]',
    '[{"id": 878, "name": "Science Fiction"}, {"id": 53, "name": "Thriller"}, {"id": 28, "name": "Action"}]',
]
_KEYWORDS = [
    '[{"id": 1, "name": "culture clash"}, {"id": 2, "name": "future"}]',
    '[{"id": 3, "name": "space war"}]',
    '[]',
    '[{"id": 4, "name": "based on novel"}, {"id": 2, "name": "future"}]',
]


def _actor(offset: int) -> str:
    number = f"(doc_id * 7 + {offset}) % 50" if offset else "(doc_id * 7) % 50"
    return f"""'{{"order": {offset}, "name": "Actor ', CAST({number} AS STRING), '"}}'"""


def _list(text: str) -> str:
    """A list with the row's number for each #, ~ for a single quote and ^ for a backslash."""
    numbered = ", CAST(doc_id AS STRING), ".join(f"'{piece}'" for piece in text.split("#"))
    return f"REPLACE(REPLACE(CONCAT({numbered}, ''), '~', CHR(39)), '^', CHR(92))"


# Lists of objects as JSON and in Python notation: keywords, mixed quotes, escapes, odd types; some that nothing can read.
_LISTS = [
    '[{"id": 1, "name": "Plain #", "job": "Director"}]',
    "[{~id~: 1, ~name~: ~Single #~, ~job~: ~Director~, ~poster~: None}]",
    '[{~id~: 2, ~name~: "It~s #", ~job~: ~Editor~, ~adult~: True}, {~id~: 3, ~name~: ~Say "hi" #~, ~job~: ~Director~, ~adult~: False}]',
    "[{~name~: ~None of True #~, ~id~: None}, ]",
    "[{~id~: 4, ~name~: ~Back^~s ^^ ^x41 ^u00e9 #~, ~job~: ~Director~, ~cast~: [None, {~order~: 1, }]}]",
    "[]",
    "[{~id~: 4, ~name~: ~broken #}]",
    "[{~id~: ~five~, ~name~: None, ~job~: ~Director~}, {~name~: ~Second #~, ~on~: True}]",
    "[None, #]",
    "no list #",
]


VIEWS: dict[str, list[tuple[str, str]]] = {
    "laptop_raw": [
        ("p_partkey", "unnamed_0"),
        (_cycle("p_partkey", _BRANDS), "company"),
        (_cycle(_part_div(7), _TYPES), "type_name"),
        ("CAST(100 + p_partkey % 81 AS DOUBLE) / 10", "inches"),
        (_cycle("p_partkey", _SCREENS), "screen_resolution"),
        (_cycle(_part_div(3), _CPUS), "cpu"),
        (_cycle(_part_div(2), ["2GB", "4GB", "8GB", "12GB", "16GB", "32GB"]), "ram"),
        (_cycle(_part_div(5), _MEMORY), "memory"),
        (f"CASE WHEN p_partkey % 211 = 0 THEN NULL ELSE {_cycle(_part_div(11), _GPUS)} END", "gpu"),
        (_cycle(_part_div(13), _SYSTEMS), "op_sys"),
        ("CONCAT(CAST(1 + p_partkey % 4 AS STRING), '.', LPAD(CAST(p_partkey % 100 AS STRING), 2, '0'), 'kg')",
         "weight"),
        ("p_retailprice * 20 + CAST(floor(p_partkey / 2) AS BIGINT) % 6 * 3000", "price"),
    ],
    # One scoring request per part, with out-of-domain values mixed in so that every rule rejects something.
    "requests_raw": [
        ("p_partkey", "request_id"),
        (_cycle("p_partkey", [*_BRANDS, "Unheard Of"]), "company"),
        (_cycle(_part_div(5), _TYPES), "type_name"),
        ("CASE WHEN p_partkey % 23 = 0 THEN 7 ELSE 2 * (1 + p_partkey % 4) END", "ram"),
        ("CAST(100 + p_partkey % 250 AS DOUBLE) / 100", "weight"),
        (_cycle("p_partkey", ["No", "Yes", "No", "Yes", "No", "Yes", "Maybe"]), "touchscreen"),
        (_cycle(_part_div(3), ["Yes", "No"]), "ips"),
        ("CAST(98 + p_partkey % 83 AS DOUBLE) / 10", "inches"),
        (_cycle(_part_div(2), ["1920x1080", "1366x768", "1600x900", "3840x2160", "2560x1440", "1024x768"]),
         "resolution"),
        (_cycle("p_partkey", ["Intel Core i5", "Intel Core i7", "AMD Processor", "Other Intel Processor",
                              "Intel Core i3"]), "cpu_brand"),
        ("CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1024 WHEN 2 THEN 2048 ELSE 512 END", "hdd"),
        ("CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 128 WHEN 2 THEN 256 WHEN 3 THEN 512 WHEN 4 THEN 1024 "
         "ELSE 333 END", "ssd"),
        (_cycle(_part_div(2), ["Intel", "AMD", "Nvidia"]), "gpu_brand"),
        (_cycle(_part_div(4), ["Windows", "Mac", "Others/No OS/Linux"]), "os"),
    ],
    "movies_raw": [
        ("doc_id", "id"),
        (_TITLE, "title"),
        ("CASE WHEN doc_id % 101 = 0 THEN NULL ELSE text END", "overview"),
        (_cycle("doc_id", _GENRES), "genres"),
        (_cycle("CAST(floor(doc_id / 6) AS BIGINT)", _KEYWORDS), "keywords"),
    ],
    "credits_raw": [
        ("doc_id", "movie_id"),
        (_TITLE, "title"),
        (f"CASE WHEN doc_id % 53 = 0 THEN '[]' ELSE CONCAT('[', {_actor(0)}, ', ', {_actor(1)}, ', ', {_actor(2)}, "
         f"', ', {_actor(3)}, ']') END", "cast"),
        ("""CASE WHEN doc_id % 29 = 0 THEN '[{"job": "Editor", "name": "Editor 1"}]' ELSE """
         """CONCAT('[{"job": "Editor", "name": "Editor 1"}, {"job": "Director", "name": "Director ', """
         """CAST(doc_id % 40 AS STRING), '"}, {"job": "Director", "name": "Second Director"}]') END""", "crew"),
    ],
    "lists_raw": [
        ("doc_id", "doc_id"),
        ("CASE CAST(doc_id % 10 AS INT) " + " ".join(f"WHEN {i} THEN {_list(x)}" for i, x in enumerate(_LISTS)) + " END", "items"),
    ],
    "posters": [
        ("doc_id", "movie_id"),
        ("CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CONCAT('/p', CAST(doc_id AS STRING), '.jpg') END", "poster_path"),
    ],
}

_WHERE = {"posters": "doc_id % 7 <> 0"}

# Titles asked for by the single-movie queries: ordinary, shared by two movies, no director, empty cast, dropped, absent.
SEED_TITLES = ["Title 5", "Title 97", "Title 29", "Title 53", "Title 101", "No Such Title"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a Spark DataFrame."""
    df = table(spark, sf_dir, TABLE_OF[name])
    if name in _WHERE:
        df = df.where(_WHERE[name])
    return df.selectExpr(*[f"{expr} AS `{alias}`" for expr, alias in VIEWS[name]])


def view_sql(name: str) -> str:
    """The same view as a SELECT for the oracle."""
    cols = ",\n ".join(f'{expr} AS "{alias}"' for expr, alias in VIEWS[name])
    where = f" WHERE {_WHERE[name]}" if name in _WHERE else ""
    return f"SELECT {cols} FROM {TABLE_OF[name]}{where}"
