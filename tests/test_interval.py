import pytest

from tidemark import interval as i
from tidemark import is_code, parse_retention
from tidemark.errors import TidemarkError


@pytest.mark.parametrize(("text", "ms"), [("250ms", 250), ("5s", 5000), ("15m", 900_000), ("1 h", 3_600_000), ("1d", 86_400_000), ("2w", 1_209_600_000), ("1mon", 2_592_000_000), ("1y", 31_536_000_000), ("42", 42)])
def test_durations(text, ms):
    assert i.parse_interval(text) == ms


@pytest.mark.parametrize(("text", "code"), [("1M", "INT_UNIT_UNKNOWN"), ("1.5h", "INT_PARSE"), ("-1h", "INT_PARSE"), ("", "INT_PARSE"), ("h", "INT_PARSE")])
def test_bad_durations(text, code):
    with pytest.raises(TidemarkError) as e:
        i.parse_interval(text)
    assert is_code(e.value, code)


def test_moments_keep_their_sign():
    assert i.moment("now-1h-30m", 10_000_000) == 10_000_000 - 5_400_000
    assert i.moment("now - 1h + 5s", 10_000_000) == 10_000_000 - 3_600_000 + 5000
    assert i.moment("1700000000000", 0) == 1_700_000_000_000


def test_periods():
    assert i.period("now-7d:now", now=10**12) == (10**12 - 7 * 86_400_000, 10**12)
    assert i.period("now-1h", 123 + 10**12, 10**12) == (10**12 - 3_600_000, 10**12 + 123)
    for bad, code in ((("now", "now-1s"), "INT_RANGE_ORDER"), (("now-7d",), "INT_PERIOD_FORMAT"), ((float("nan"), 1), "INT_RESOLVE")):
        with pytest.raises(TidemarkError) as e:
            i.period(*bad, now=10**12)
        assert e.value.code == code


def test_rounding_and_grids():
    assert i.round_time(125, 60) == 120
    assert i.round_time(-125, 60) == -120
    assert i.grid(10, 130, 60) == [0, 60, 120]
    assert i.step_for_count(0, 100, 3) == 33
    with pytest.raises(TidemarkError):
        i.round_time(1.5, 60)


def test_retention():
    assert [(t.res_ms, t.ttl_ms) for t in parse_retention(" 5s:1d, 15s:1w,, 1m:1mon ")] == [(5000, 86_400_000), (15_000, 604_800_000), (60_000, 2_592_000_000)]
    for text, code in (("", "TBL_RETENTION_STRING"), (",", "TBL_RETENTION_EMPTY"), ("5s", "TBL_RETENTION_TIER_FORMAT"), ("0s:1d", "TBL_RETENTION_RES_POS"), ("5s:0d", "TBL_RETENTION_TTL_POS"), ("15s:1d,5s:1w", "TBL_RETENTION_RES_ASC"), ("5s:1w,15s:1d", "TBL_RETENTION_TTL_ASC"), ("x:1d", "TBL_RETENTION_RES")):
        with pytest.raises(TidemarkError) as e:
            parse_retention(text)
        assert e.value.code == code
