"""What a review found to be less than the whole job."""

import pytest

from driftwell.operators import extraction
from driftwell.operators.components import connected_components
from driftwell.plans import basics


def test_quotes_keep_a_documents_own(spark):
    class Corpus:
        notes = spark.createDataFrame([("p", "> words of another source\n\n> quoted words from document 2")], "path string, content string")

    assert sorted(r["item"] for r in basics.quotes(Corpus).collect()) == ["quoted words from document 2", "words of another source"]


def test_list_questions(spark):
    n = spark.createDataFrame([("p", "- What changed in v1.2?\n* Is it the same here?\nWhy would it be so?")], "path string, content string")
    items = [r["item"] for r in extraction.questions(n).collect()]
    assert {"What changed in v1.2?", "Is it the same here?", "Why would it be so?"} <= set(items) and len(items) == len(set(items))


def test_components_that_do_not_converge_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        connected_components(chain, most_rounds=1)
