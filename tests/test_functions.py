"""Worked values of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocabula.functions import naming, similarity, tokens
from vocabula.operators import mapping
from vocabula.semantics import round_half_up


def value(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'array<string>' if isinstance(row[n], list) else 'double' if isinstance(row[n], float) else 'string'}" for n in names)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [("HTTPClient", ["http", "client"]), ("parseJSONData", ["parse", "json", "data"]), ("user_profile-v2", ["user", "profile"]), ("", []), (None, []), ("  ", []), ("결제 한도", ["결제", "한도"]), ("a.b/Cd", ["cd"])],
)
def test_tokenize(spark, text, expected):
    assert value(spark, tokens.tokenize(F.col("s")), s=text) == expected


def test_paths_sentences_names(spark):
    assert value(spark, tokens.tokenize_path(F.col("s")), s="src/auth/auth-service.ts") == ["auth", "service"]
    assert value(spark, tokens.tokenize_sentence(F.col("s")), s="The auth-flow of a user, déjà vu!") == ["auth-flow", "user", "vu"]
    assert value(spark, tokens.normalize(F.col("s")), s="  Auth_Service-2 (new)! ") == "auth service 2 new"
    assert value(spark, tokens.tokenize(F.col("s")), s="x" * 200_000) == ["x" * 200_000]


def test_overlaps(spark):
    over = similarity.partial_overlap(F.col("a"), F.col("b"))
    assert value(spark, over, a=["auth"], b=["auth", "service"]) == pytest.approx(0.7071, abs=1e-4)
    assert value(spark, over, a=[], b=["x"]) == 0.0
    assert value(spark, similarity.jaccard(F.col("a"), F.col("b")), a=["a1", "b1"], b=["b1", "c1"]) == pytest.approx(1 / 3)


words = st.lists(st.sampled_from(["auth", "authentication", "au", "service", "serv", "user", "us", "authx"]), unique=True, max_size=5)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_expression_and_arrow_pass_agree(spark, pairs):
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", similarity.partial_overlap(F.col("a"), F.col("b")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(mapping._overlap(mapping._Tokens(r["a"]), mapping._Tokens(r["b"])), abs=1e-12)


def test_names(spark):
    exact = similarity.exact_name(F.col("a"), F.col("b"))
    for a, b in (("auth service", "authservice"), ("auth", "auth"), ("auth", "reauthorize"), ("ab", "abc"), ("", "x"), ("reauthorize", "auth")):
        assert value(spark, exact, a=a, b=b) == mapping._exact(a, b)
    assert value(spark, naming.camel_case(F.col("s")), s="Iteration throughput") == "iterationThroughput"
    assert [value(spark, naming.convention(F.col("s")), s=s) for s in ("a_b", "a-b", "AbC", "aB", "ab")] == ["snake_case", "kebab-case", "PascalCase", "camelCase", "unknown"]
    assert value(spark, naming.humanize(F.col("s")), s="getHTTPUser_byId") == "Get HTTP User By Id"
    assert value(spark, round_half_up(F.col("x"), 3), x=0.5005) == 0.5
    assert value(spark, F.regexp_like(F.lit("a.b(c"), F.concat(F.lit("^"), naming.quoted(F.col("s")), F.lit("$"))), s="a.b(c")
