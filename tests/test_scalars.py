from pyspark.sql import functions as F

from catalens.functions import scalars as S
from catalens.plans import laptops


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "c string")
    return tuple(df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).first())




def test_null_in_null_out(spark):
    checks = [
        S.strip_literal(F.col("c"), "GB"), S.flag(F.col("c"), "IPS"), *S.split_once(F.col("c"), "x"), S.first_number(F.col("c")), *S.resolution(F.col("c")),
        *S.storage_parts(F.col("c")), S.digits(F.col("c")), S.words(F.col("c")), S.first_words(F.col("c"), 3), S.first_word(F.col("c")), S.cpu_brand(F.col("c")),
        S.os_category(F.col("c")), S.json_names(F.col("c")), S.first_names(F.col("c"), 3), S.names_with_job(F.col("c"), "Director", 1),
    ]
    assert one(spark, None, *checks) == (None,) * len(checks)


def test_resolution(spark):
    assert one(spark, "IPS Panel Retina Display 2560x1600", *S.resolution(F.col("c"))) == (2560, 1600)
    assert one(spark, "1440x900", *S.resolution(F.col("c"))) == (1440, 900)
    assert one(spark, "4K Ultra HD / Touchscreen 3840x2160", *S.resolution(F.col("c"))) == (3840, 2160)


def test_first_number_needs_two_digits(spark):
    assert one(spark, "4K or 8", S.first_number(F.col("c"))) == (None,)
    assert one(spark, "1,920 wide", S.first_number(F.col("c"))) == ("1920",)
    assert one(spark, "at 13.3 inches", S.first_number(F.col("c"))) == ("13.3",)


def storage(spark, text, fix=False):
    first, second = S.storage_parts(F.col("c"), fix)
    return {
        name: one(spark, text, S.storage_of_kind(first, second, kind, S.digits(first), S.digits(second)))[0]
        for name, kind in laptops.STORAGE_KINDS.items()
    }


def test_storage(spark):
    assert storage(spark, "256GB SSD +  1TB HDD") == {"hdd": 1000, "ssd": 256, "hybrid": 0, "flash_storage": 0}
    assert storage(spark, "64GB Flash Storage +  1TB HDD") == {"hdd": 1000, "ssd": 0, "hybrid": 0, "flash_storage": 64}
    assert storage(spark, "256GB SSD +  256GB SSD")["ssd"] == 512
    assert storage(spark, "1.0TB Hybrid")["hybrid"] == 10000
    assert storage(spark, "1.0TB Hybrid", fix=True)["hybrid"] == 1000


def test_words(spark):
    assert one(spark, "  two\t words here\n", S.words(F.col("c"))) == (["two", "words", "here"],)
    assert one(spark, "", S.words(F.col("c")), S.first_words(F.col("c"), 3), S.first_word(F.col("c"))) == ([], "", None)
    assert one(spark, " Intel  Core i7 7500U", S.first_words(F.col("c"), 3), S.first_word(F.col("c"))) == ("Intel Core i7", "Intel")


def test_cpu_brand(spark):
    for name, brand in [
        ("Intel Core i7", "Intel Core i7"), ("Intel Core i5", "Intel Core i5"), ("Intel Core i3", "Intel Core i3"),
        ("Intel Core M", "Other Intel Processor"), ("Intel Xeon E3-1505M", "Other Intel Processor"),
        ("AMD A9-Series 9420", "AMD Processor"), ("Samsung Cortex A72", "AMD Processor"),
    ]:
        assert one(spark, name, S.cpu_brand(F.col("c"))) == (brand,)


def test_os_category(spark):
    for name, group in [
        ("Windows 10", "Windows"), ("Windows 10 S", "Windows"), ("Windows 7", "Windows"), ("macOS", "Mac"),
        ("Mac OS X", "Mac"), ("Linux", "Others/No OS/Linux"), ("No OS", "Others/No OS/Linux"),
        ("windows 10", "Others/No OS/Linux"),
    ]:
        assert one(spark, name, S.os_category(F.col("c"))) == (group,)


def test_flag_is_case_sensitive(spark):
    assert one(spark, "IPS Panel touchscreen", S.flag(F.col("c"), "IPS"), S.flag(F.col("c"), "Touchscreen")) == (1, 0)


def test_json_lists(spark):
    text = '[{"id": 1, "name": "A B"}, {"id": 2, "name": "C"}, {"name": "D", "order": 9}, {"name": "E"}]'
    assert one(spark, text, S.json_names(F.col("c")), S.first_names(F.col("c"), 3)) == (["A B", "C", "D", "E"], ["A B", "C", "D"])
    assert one(spark, "[{'id': 1, 'name': 'single quoted'}]", S.json_names(F.col("c"))) == (["single quoted"],)
    assert one(spark, "[]", S.json_names(F.col("c")), S.names_with_job(F.col("c"), "Director", 1)) == ([], [])
    assert one(spark, "not json", S.json_names(F.col("c"))) == (None,)
    crew = '[{"job": "Editor", "name": "X"}, {"job": "Director", "name": "Y Z"}, {"job": "Director", "name": "W"}]'
    assert one(spark, crew, S.names_with_job(F.col("c"), "Director", 1)) == (["Y Z"],)


def test_tag_text(spark):
    df = spark.createDataFrame([(["Big", "Hit."], ["Science Fiction"], [])], "a array<string>, b array<string>, c array<string>")
    assert df.select(S.tag_text(F.col("a"), S.close_up(F.col("b")), F.col("c"))).first()[0] == "big hit. sciencefiction"


def test_whole_price_cuts_off(spark):
    df = spark.createDataFrame([(2.999999 ** 0.0,)], "p double")
    assert df.select(S.whole_price(F.log(F.lit(1999.999)))).first()[0] == 1999


def test_python_notation(spark):
    """What the language itself reads as a list of dicts gives the same names."""
    import ast

    texts = [
        "[{'name': 'a', 'x': None}]", """[{'name': "it's", 'on': True}, {"name": 'say "x"'}]""", r"""[{'name': 'b\'s \\ \" \x41 \n'}]""",
        "[{'name': 'None, True ,]'}, ]", "[{'name': 'x', 'y': [1, 2, ], 'z': {'name': None, }}]", "[]", "[ ]", "[{'name': 'é 東京 \\u00e9'}]",
        "[{'name': 'v'}, {'id': False}]", """[{'name': "\\\\"}, {'name': '\\\\\\''}]""", "[{'id': 'word', 'name': None, 'cast': [None]}]",
    ]
    for text in texts:
        want = [None if x.get("name") is None else str(x["name"]) for x in ast.literal_eval(text)]
        assert one(spark, text, S.json_names(F.col("c"))) == (want,), text
    for text in ("[{'name': 'open}]", "None", "[None]", "[1, None]", "[{'name': 'a'} {]", "'a'", "x", " "):
        assert one(spark, text, S.json_names(F.col("c"))) == (None,), text
    assert one(spark, '{"a": [true, null, "None"]}', S.python_to_json(F.col("c"))) == ('{"a": [true, null, "None"]}',)
    long = "[{'name': '" + "x y\\'" * 20_000 + "', 'n': None}]"
    assert one(spark, long, S.json_names(F.col("c"))) == (["x y'" * 20_000],)
    assert one(spark, None, S.python_to_json(F.col("c"))) == (None,)


def test_spaced_text_is_the_words_joined(spark):
    for text in ("", " ", "a", " a  b ", "a b\tc\n\nd \u2003e\x85", "\t a\x1c b \x0bc", "a\u00a0b \u3000 c  ", None):
        joined, spaced = one(spark, text, F.array_join(S.words(F.col("c")), " "), S.spaced(F.col("c")))
        assert joined == spaced
