import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import payload
from loomstone.functions import text as T
from loomstone.functions import vectors as V

DOCS = [
    (1, '{"cat": "news", "price": 42, "tags": ["clean"], "ok": true}'), (2, '{"cat": "blog", "price": 42}'), (3, '{"cat": "news", "price": 3}'), (4, '{"cat": "news", "price": 42, "tag": "spam"}'),
    (5, '{"a": {"b": 3}, "items": [{"n": 1}, {"n": 5}], "e": [], "z": null}'), (6, "{bad}"), (7, None), (8, '{"a": {"b": 3}, "cat": ["news"], "price": "42"}'),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, doc string")


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ({"must": [{"key": "cat", "match": {"value": "news"}}], "should": [{"key": "price", "range": {"gte": 10, "lt": 100}}], "must_not": [{"key": "tag", "match": {"any": ["spam", "junk"]}}]}, {1}),
        ({"must": [{"key": "a.b", "range": {"gte": 2}}, {"has_id": [5, 9]}]}, {5}),
        ({"must": [{"key": "items.n", "match": {"value": 5}}]}, {5}),
        ({"must": [{"key": "price", "match": {"value": 42.0000000001}}]}, {1, 2, 4}),
        ({"must": [{"key": "price", "match": {"value": "42"}}]}, {8}),
        ({"must": [{"key": "ok", "match": {"value": True}}]}, {1}),
        ({"must": [{"is_empty": {"key": "e"}}, {"is_empty": {"key": "z"}}, {"key": "a.b", "match": {"value": 3}}]}, {5, 8}),
        ({"must_not": [{"is_empty": {"key": "cat"}}]}, {1, 2, 3, 4, 8}),
        ({"must": [{"key": "tags", "match": {"value": "clean"}}]}, set()),
    ],
)
def test_filters(docs, spec, ids):
    got = {r["id"] for r in docs.where(payload.compile_filter(spec, F.col("doc"), F.col("id"))).collect()}
    assert got == ids


@pytest.mark.parametrize("spec", ["{}", "nope", {"must": []}, {"must": [{"x": 1}]}, {"must": [{"key": "a", "match": {}}]}, {"must": [{"key": "a", "range": {"ne": 1}}]}])
def test_filters_that_are_errors(spec):
    with pytest.raises(payload.FilterError):
        payload.compile_filter(spec, F.lit("{}"), F.lit(1))


def test_facets(docs):
    rows = docs.select(F.explode(payload.labels(F.col("doc"), "price")).alias("v")).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in rows} == {"42": 4, "3": 1}
    assert {r["v"] for r in docs.select(F.explode(payload.labels(F.col("doc"), "items.n")).alias("v")).collect()} == {"1", "5"}
    assert [r["v"] for r in docs.select(F.explode(payload.labels(F.col("doc"), "ok")).alias("v")).collect()] == ["true"]


@settings(max_examples=200)
@given(st.text(alphabet="ab*?[]-", max_size=6), st.text(alphabet="ab*?-", max_size=6))
def test_globs_without_escapes(pattern, text):
    import re

    if "[" in pattern or "]" in pattern:
        return
    assert bool(re.match(T.glob_to_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern)


@pytest.mark.parametrize(("pattern", "text", "hit"), [("cust:[0-4]?", "cust:37", 1), ("cust:[0-4]?", "cust:57", 0), ("[^st]ea", "pea", 1), ("[^st]ea", "sea", 0), ("50\\*", "50*", 1), ("50\\*", "500", 0), ("*", "two\nlines", 1), ("w?ft", "weft", 1), ("w?ft", "wft", 0)])
def test_globs(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(T.glob_match(F.col("t"), pattern)).first()[0] == bool(hit)


def test_numbers_and_tokens(spark):
    df = spark.createDataFrame([(5.0,), (5.25,), (float("inf"),), (float("-inf"),), (-3.0,)], "x double")
    assert [r[0] for r in df.select(T.number_text(F.col("x"))).collect()] == ["5", "5.25", "inf", "-inf", "-3"]
    assert spark.sql("select 1").select(T.tokens(F.lit("The Rust-lang, rust of 42 é éé"))).first()[0] == ["rust", "lang", "rust", "éé"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0], [0.0, 0.0], [-3.0, 4.0])], "a array<float>, z array<float>, b array<float>")
    r = df.select(V.cosine_distance("a", "a"), V.cosine_distance("a", "z"), V.cosine_distance("a", "b"), V.category("a"), V.quantize_int8(V.normalized("a")), V.agreement("a", "b"), V.softmax_entropy("z")).first()
    assert [round(x, 6) if isinstance(x, float) else x for x in r] == [0.0, 1.0, 2.0, 1, [76, -102], 0.0, 0.693147]
