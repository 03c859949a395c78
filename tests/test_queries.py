import pytest

import __spark_entry__
from inkwell.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, sf, duck, same, name):
    same(Q.QUERIES[name](spark, sf).toArrow(), duck.sql(Q.SQL[name]).to_arrow_table())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "document_id", "field_index", "term_indices", "body"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(Q.QUERIES) <= set(__spark_entry__.queries())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spelling_of_all_terms(spark, sf):
    """Accented terms are compared like others."""
    terms = [r[0] for r in Q.documents_index(spark, sf).vocabulary.select("term").collect()]
    assert not all(t.isascii() for t in terms)
    found = {(r["word"], r["term"]): r["dist"] for r in Q.edit_distance_pairs(spark, sf).collect()}
    assert found == {(w, t): distance(w, t) for w in Q.LOOKED_UP for t in terms}
    grams = lambda t: {f"${t}$"[i : i + 3] for i in range(len(t))}
    expected = set()
    for _, w, last in Q.SPELLED:
        near = [(0 if last and t.startswith(w) else distance(w, t), len(t.encode()), t.encode(), t) for t in terms if grams(t) & grams(w)]
        expected |= {(w, last, t, d, k) for k, (d, _, _, t) in enumerate(sorted(x for x in near if x[0] <= 10)[:10])}
    assert {(r["term"], r["is_last"], r["candidate"], r["dist"], r["rank"]) for r in Q.spelling_candidates(spark, sf).collect()} == expected
