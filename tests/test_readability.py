"""Syllables counted by one pattern over a text's words, against the SQL and the rule word by word."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import strings
from plumbline.operators import text
from plumbline.plans import catalog


def by_rule(word):
    low = word.replace("İ", "i").lower()
    return max(len(re.findall("[aeiouy]+", low)) - bool(re.search("[^aeiouyl]e$", low)), 1)


def test_syllables_equal_sql_and_rule(spark, tmp_path):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "E", "e", "e", "y", "l", "L", "t", "s", "İ", "é", "ß", "7", "_", "字", "𝒳", " ", " ", "-", ". ", "\n"]) for _ in range(r.randrange(60))) for _ in range(600)]
    texts += [None, "", " ", "e", "le", "the", "E. THE. tle", "ale ae", "aİa", "-e-te-", "été", "rhythm shh", "_e 7e e7"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "readability_score", "average_syllable_length", "sentences_count"]
    want = con.sql(catalog.oracle_sql()["text_readability"]).project(", ".join(columns)).fetchall()
    df = catalog.queries()["text_readability"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in df.select(columns).collect()) == sorted(want)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strings.split_words(F.col("t")).alias("w"), strings.syllables_count(F.col("t")).alias("y")).collect()
    assert [x.y for x in rows] == [None if x.w is None else sum(map(by_rule, x.w)) for x in rows]


@pytest.mark.parametrize("properties, times", [(["readability_score", "average_syllable_length"], 1), (["lexical_density"], 0)])
def test_syllables_are_counted_once_a_text(spark, properties, times):
    plan = text.text_properties(spark.createDataFrame([("One two.",)], "t string"), "t", properties)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[aeiouy") == times and "aggregate(" not in plan
