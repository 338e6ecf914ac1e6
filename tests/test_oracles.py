"""Every query with SQL gives the SQL's rows; every other one runs with a stable schema."""

import pytest

from fathomline.plans import registry

from .compare import SF, check

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    check(spark, name, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    first, again = (registry.queries()[name](spark, SF) for _ in range(2))
    assert first.schema == again.schema
    assert first.collect() is not None


def test_walk_and_window_agree(spark):
    """The state machine and the window form of the follow windows, where no user turn or end cuts in."""
    q = registry.queries()
    walked = {(r.session, r.opened): r.calls for r in q["tracker"](spark, SF).collect()}
    counted = {(r.session, r.opened): r.calls for r in q["follow_window_counts"](spark, SF).collect()}
    assert walked == counted
