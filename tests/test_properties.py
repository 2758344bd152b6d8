"""Properties that hold for any input, without Spark."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.formula import parse, quote_column, quote_text
from tessella.operators.columns import builder_tree, conditional_formula
from tessella.operators.rows import sample_positions
from tessella.plans.project import Project
from tessella.sources.excel import column_letters, column_number
from tessella.types import unique_names


@given(st.lists(st.one_of(st.none(), st.text(max_size=5)), max_size=12))
def test_names_are_distinct_and_not_blank(names):
    out = unique_names(names)
    assert len(set(out)) == len(out) == len(names) and all(n.strip() for n in out)


@given(st.text(min_size=1, max_size=20), st.text(max_size=20))
def test_quoting_round_trips(column, text):
    n = parse(f"{quote_column(column)} = {quote_text(text)}")
    assert (n.args[0].value, n.args[1].value) == (column, text)


@given(st.integers(1, 18_278))
def test_column_letters_round_trip(n):
    assert column_number(column_letters(n)) == n


@settings(max_examples=60)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(-(2**31), 2**31))
def test_sampled_places_are_distinct(n, k, seed):
    k = min(n, k)
    places = sample_positions(n, k, seed)
    assert len(set(places)) == k and all(0 <= p < n for p in places)


@given(st.lists(st.tuples(st.sampled_from(["eq", "ne", "gt", "in", "not_in", "contains", "null"]), st.text(max_size=8)), max_size=4), st.sampled_from(["and", "or"]))
def test_built_filters_parse(conds, join):
    spec = {"join": join, "conds": [{"col": "a]b", "op": op, "value": v, "values": [v, 3, None, True]} for op, v in conds]}
    n = builder_tree(spec)
    assert (n is None) == (not conds)

    def count(x):
        return x.kind == "binary" and x.value == join and count(x.args[0]) + 1

    assert not conds or count(n) == len(conds) - 1


def test_conditions_nest():
    n = parse(conditional_formula({"rules": [{"when": "[a] > 1", "then": "1"}, {"when": "[a] > 0", "then": "2"}]}))
    assert n.kind == "if" and n.args[2].kind == "if" and n.args[2].args[2].value is None


@given(st.text(max_size=10), st.integers(1, 5000))
def test_projects_round_trip(name, rows):
    p = Project.from_json(f'{{"queries": [], "settings": {{"previewRows": {rows}}}}}')
    assert Project.from_json(p.to_json()).preview_rows == rows
