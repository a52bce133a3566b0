import pytest

from sigloom.plans import cleaning as _c  # noqa: F401
from sigloom.plans import evidence as _e  # noqa: F401
from sigloom.plans import models as _m  # noqa: F401
from sigloom.plans import populations as _p  # noqa: F401
from sigloom.plans import queries as _  # noqa: F401
from sigloom.plans import registry


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: int(v) if isinstance(v, bool) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    q = duck.execute(registry.SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(q.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_and_repeats(spark, small, name):
    f = registry.QUERIES[name]
    once, again = (sorted(map(repr, f(spark, small).collect())) for _ in range(2))
    assert once == again


def test_scan_reads_only_needed_columns(spark, small, capsys):
    registry.QUERIES["class_summary"](spark, small).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
