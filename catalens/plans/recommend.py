"""The four recommenders (content, genre, director, lead actor) over one prepared catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from catalens.operators import lsh, sampling, similar, vectors
from catalens.plans import movies
from catalens.session import materialize

KEYS = movies.KEYS
# Vocabulary sizes and the answer size.
CONTENT_TERMS = 5000
GENRE_TERMS = 13
TOP = 5


@dataclass
class Catalogue:
    """What the recommenders read; each table is stored once and read by every query.

    ``titles``  (id, movie_id, title, cast, director), one row per movie row
    ``content`` tag-text vectors, ``genre`` genre vectors
    """

    titles: DataFrame
    content: DataFrame | None
    genre: DataFrame | None


def build(
    raw_movies: DataFrame, raw_credits: DataFrame, stop_words: list[str], parts=("content", "genre"),
    stem: bool = False, tfidf: bool = False,
) -> Catalogue:
    # One join, stored with what the parts need: every facet and every text is read from it.
    texts = ["overview_text", "keywords", "genres"] if "content" in parts else ["genres"] if "genre" in parts else []
    rows = movies.facets(movies.merged(raw_movies, raw_credits)).select(*KEYS, "title", "cast", "director", *texts)
    rows = materialize(rows, "titles")
    titles = rows.select(*KEYS, "title", "cast", "director")
    content = genre = None
    if "content" in parts:
        content = vectors.document_vectors(movies.tags(rows, stem), KEYS, "tags", stop_words, CONTENT_TERMS, tfidf)
    if "genre" in parts:
        genre = vectors.document_vectors(movies.genre_texts(rows), KEYS, "tags", stop_words, GENRE_TERMS)
    return Catalogue(titles, content, genre)


def seed_rows(titles: DataFrame, wanted: list[str]) -> DataFrame:
    """First row of every wanted title as (seed_title, id, movie_id), stored, as every facet reads it.

    A title that is not there gives no row, and so an empty answer. Any number of titles may be wanted.
    """
    found = movies.first_by_title(titles.where(F.col("title").isin(wanted)))
    return materialize(found.withColumnRenamed("title", "seed_title"), "seeds")


def nearest(catalogue: Catalogue, kind: str, wanted: list[str], k: int = TOP, digits: int | None = None) -> DataFrame:
    """Content or genre neighbours of the wanted titles, the seed row itself excluded by key."""
    return nearest_to(catalogue, kind, seed_rows(catalogue.titles, wanted), k, digits)


def nearest_to(catalogue: Catalogue, kind: str, seeds: DataFrame, k: int = TOP, digits: int | None = None) -> DataFrame:
    """The same for any table of seeds (seed_title, id, movie_id)."""
    vecs = catalogue.content if kind == "content" else catalogue.genre
    found = similar.similar_to(vecs, KEYS, seeds, "seed_title", k, digits)
    return catalogue.titles.select(*KEYS, "title").join(found, KEYS).select(
        "seed_title", F.lit(kind).alias("facet"), "rank", *KEYS, "title", "score"
    )


def members(titles: DataFrame, kind: str) -> DataFrame:
    """(person, id, movie_id, title): the director, or each of the first three cast members once."""
    people = F.col("director") if kind == "director" else F.array_distinct("cast")
    return titles.select(F.explode(people).alias("person"), *KEYS, "title")


def lead(kind: str):
    """The person a seed stands for; null when there is none, which matches nothing."""
    return F.get(F.col("director" if kind == "director" else "cast"), 0)


def same_person(
    catalogue: Catalogue, kind: str, wanted: list[str], k: int | None = TOP, salt: int = 0
) -> DataFrame:
    """Other titles with the seed's director, or with its first-billed actor among their first three.

    ``k`` of them at random, the same that ``same_person_all`` gives for the seed's row; all of them if ``k`` is None.
    """
    return _same_person(catalogue, kind, seed_rows(catalogue.titles, wanted), k, salt)


def _same_person(catalogue: Catalogue, kind: str, seeds: DataFrame, k: int | None, salt: int) -> DataFrame:
    titles = catalogue.titles
    people = titles.join(seeds, KEYS).select("seed_title", *KEYS, lead(kind).alias("person")).where("person IS NOT NULL")
    every = members(titles, kind)
    if k is None:
        return sampling.related_to(people.select("seed_title", "person"), every, KEYS)
    own = people.select(*[F.col(c).alias(f"seed_{c}") for c in KEYS], F.col("seed_title").alias("title"), "person")
    # The ring of a person does not depend on other persons, so those that no seed asks for are left out.
    found = sampling.related_to_all(own, every.join(own.select("person").distinct(), "person", "left_semi"), KEYS, k, salt)
    names = seeds.select("seed_title", *[F.col(c).alias(f"seed_{c}") for c in KEYS])
    return found.join(names, [f"seed_{c}" for c in KEYS]).select(
        "seed_title", F.lit(kind).alias("facet"), "rank", *KEYS, "title", F.lit(None).cast("double").alias("score")
    )


def same_person_all(catalogue: Catalogue, kind: str, k: int = TOP, salt: int = 0) -> DataFrame:
    """The same for every movie row of the catalogue, without forming the pairs within a person."""
    seeds = catalogue.titles.select(
        *[F.col(c).alias(f"seed_{c}") for c in KEYS], "title", lead(kind).alias("person")
    ).where("person IS NOT NULL")
    return sampling.related_to_all(seeds, members(catalogue.titles, kind), KEYS, k, salt)


def nearest_all(catalogue: Catalogue, kind: str, k: int = TOP) -> DataFrame:
    """Neighbour table of every movie row: (id, movie_id, near_id, near_movie_id, score, rank, facet)."""
    vecs = catalogue.content if kind == "content" else catalogue.genre
    return similar.similar_all(vecs, KEYS, k).withColumn("facet", F.lit(kind))


def nearest_some(catalogue: Catalogue, kind: str, k: int = TOP, **options) -> DataFrame:
    """``nearest_all`` by a stored index of bands: most of the same neighbours, with exact scores; see ``lsh.similar_lsh``."""
    vecs = catalogue.content if kind == "content" else catalogue.genre
    return lsh.similar_lsh(vecs, KEYS, k, **options).withColumn("facet", F.lit(kind))


def stored_neighbours(catalogue: Catalogue, stored: DataFrame, wanted: list[str]) -> DataFrame:
    """(seed_title, facet, rank, near_id, near_movie_id, score) of the wanted titles from a stored neighbour table.

    The ids of the wanted titles, one per title, are put into the filter, so that only their buckets are read.
    """
    seeds = seed_rows(catalogue.titles, wanted)
    ids = [r["id"] for r in seeds.select("id").collect()]  # at most one for each wanted title
    found = stored.where(F.col("id").isin(ids))
    return found.join(F.broadcast(seeds), KEYS).select("seed_title", "facet", "rank", "near_id", "near_movie_id", "score")


def recommend(catalogue: Catalogue, wanted: list[str], salt: int = 0) -> DataFrame:
    """All four facets of the wanted titles; a facet without matches is simply empty."""
    seeds = seed_rows(catalogue.titles, wanted)
    out = nearest_to(catalogue, "content", seeds).unionByName(nearest_to(catalogue, "genre", seeds))
    for kind in ("director", "actor"):
        out = out.unionByName(_same_person(catalogue, kind, seeds, TOP, salt))
    return out
