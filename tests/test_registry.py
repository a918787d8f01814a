"""The registry names what the library has; the cheap queries are built over the given tables."""

import ast
import inspect
import types

import pytest

import __spark_entry__
import registry.queries


def test_modules_have_what_the_registry_takes_from_them():
    tree = ast.parse(inspect.getsource(registry.queries))
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            held = getattr(registry.queries, node.value.id, None)
            assert not isinstance(held, types.ModuleType) or hasattr(held, node.attr), f"{node.value.id}.{node.attr}"


@pytest.mark.parametrize("name", ["txt1_word_count", "txt2_token_estimate", "txt3_sizes", "tok1_token_kinds", "url3_normalize_url"])
def test_query_builds(spark, name):
    queries = __spark_entry__.queries()
    assert name not in queries or queries[name](spark, "/root/testdata/sf0.001").schema.names


def test_no_counterpart_without_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
