import pytest

from tidemark import SqlSyntaxError, parse_sql
from tidemark.plans.sql import Insert, lower


def test_select_lowers_to_a_scan():
    q = lower(parse_sql("select host, AVG(value) as a, max(value) FROM m WHERE ts >= 'now-1h' AND ts < 900 AND host = web1 AND code NOT IN (1, 'x', NULL) AND tag IS NOT NULL GROUP BY host ORDER BY value ASC LIMIT 5 OFFSET 2;"), 3_600_500)
    assert (q.start, q.end, q.group_by, q.agg, q.order, q.limit, q.offset) == (500, 900, ["host"], {"value": ["avg", "max"]}, "asc", 5, 2)
    assert [tuple(c) for c in q.where] == [("host", "eq", "web1"), ("code", "nin", [1, "x", None]), ("tag", "isNotNull", None)]


def test_bounds_on_time():
    q = lower(parse_sql("SELECT * FROM m WHERE ts > 5 AND ts > 3 AND ts = 4 AND ts <= 9"))
    assert (q.start, q.end, q.select) == (3, 9, ()) and [tuple(c) for c in q.where] == [("ts", "eq", 4)]


def test_literals():
    text = 'say ""x""'
    q = parse_sql(f"INSERT INTO t (a, b, c, d, e) VALUES ('it''s', \"{text}\", -1.5e2, TRUE, null), (word, 2, 3, false, 0)")
    assert q == Insert("t", ["a", "b", "c", "d", "e"], [["it's", 'say "x"', -150, True, None], ["word", 2, 3, False, 0]])


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("SELEC a FROM t", 0), ("SELECT count(*) FROM t", 13), ("SELECT a FROM t WHERE a = 1 OR b = 2", 28), ("SELECT median(a) FROM t", 7), ("SELECT a FROM t WHERE a LIKE 'x'", 24),
        ("SELECT a FROM t LIMIT -1", 22), ("SELECT a FROM t WHERE a = 'x", 26), ("SELECT a FROM t HAVING a", 16), ("SELECT DISTINCT a FROM t", 16), ("INSERT INTO t (a) VALUES (1, 2)", 25), ("SELECT a FROM t JOIN u", 16), ("", 0),
    ],
)
def test_syntax_errors_say_where(text, at):
    with pytest.raises(SqlSyntaxError) as e:
        parse_sql(text)
    assert e.value.position == at
