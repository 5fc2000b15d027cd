import pytest

from catalens.plans import movies, recommend

MOVIES = [
    (1, "One", "a tale", '[{"id": 1, "name": "Science Fiction"}]', "[]"),
    (2, "Twin", "first twin", "[]", '[{"id": 2, "name": "space war"}]'),
    (3, "Twin", "second twin", "[]", "[]"),
    (4, "Gone", None, "[]", "[]"),
    (5, "Bad", "text", "oops", "[]"),
]
CREDITS = [
    (1, "One", '[{"name": "Lead A"}, {"name": "B"}, {"name": "C"}, {"name": "D"}]', '[{"job": "Director", "name": "Dir X"}]'),
    (2, "Twin", "[]", '[{"job": "Editor", "name": "E"}]'),
    (3, "Twin", '[{"name": "B"}, {"name": "Lead A"}]', '[{"job": "Director", "name": "Dir X"}]'),
    (4, "Gone", "[]", "[]"),
    (5, "Bad", "[]", "[]"),
]


def frames(spark):
    return (
        spark.createDataFrame(MOVIES, "id long, title string, overview string, genres string, keywords string"),
        spark.createDataFrame(CREDITS, "movie_id long, title string, cast string, crew string"),
    )


def test_merge_repeats_shared_titles_and_drops_incomplete_rows(spark):
    rows = movies.merged(*frames(spark))
    assert sorted((r["id"], r["movie_id"]) for r in rows.collect()) == [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (5, 5)]


def test_tags_close_up_names_but_genre_texts_do_not(spark):
    facets = movies.facets(movies.merged(*frames(spark)))
    tags = {(r["id"], r["movie_id"]): r["tags"] for r in movies.tags(facets).collect()}
    assert tags[1, 1] == "a tale sciencefiction leada b c dirx"
    assert tags[2, 2] == "first twin spacewar"
    assert tags[5, 5] is None  # unreadable list
    genres = {r["id"]: r["tags"] for r in movies.genre_texts(facets).collect()}
    assert genres[1] == "Science Fiction"


def test_first_by_title(spark):
    got = {r["title"]: (r["id"], r["movie_id"]) for r in movies.first_by_title(movies.merged(*frames(spark))).collect()}
    assert got == {"One": (1, 1), "Twin": (2, 2), "Bad": (5, 5)}


def test_missing_people_and_titles_give_empty_facets(spark):
    catalogue = recommend.build(*frames(spark), ["the"])
    # "Twin" stands for row (2, 2): no director, no cast.
    for kind in ("director", "actor"):
        got = recommend.same_person(catalogue, kind, ["Twin", "Gone", "Nowhere"]).collect()
        assert got == []
    got = recommend.same_person(catalogue, "actor", ["One"]).collect()
    assert sorted((r["id"], r["movie_id"], r["title"]) for r in got) == [(2, 3, "Twin"), (3, 3, "Twin")]
    assert recommend.nearest(catalogue, "content", ["Nowhere"]).collect() == []


def test_many_titles(spark):
    catalogue = recommend.build(*frames(spark), [], parts=())
    got = recommend.same_person(catalogue, "actor", ["One", *(str(i) for i in range(3000))]).collect()
    assert len(got) == 2
