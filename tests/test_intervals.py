import pytest

from tidelog.functions.intervals import columnar_interval, document_interval

HOUR, DAY = 3_600, 86_400


@pytest.mark.parametrize(
    ("fixed", "calendar", "seconds"),
    [
        ("", None, DAY),
        ("1d", None, DAY),
        ("1h", None, HOUR),
        ("30m", None, 1_800),
        ("10x", None, DAY),
        (None, "1d", DAY),
        (None, "1w", 7 * DAY),
        (None, "1M", 30 * DAY),
        (None, "1y", 365 * DAY),
        (None, "10x", DAY),
        ("15s", "1d", 15),
        ("100ms", None, DAY),
        ("d", None, DAY),
        ("0s", None, DAY),
        ("-5m", None, DAY),
        ("99999999999999999999y", None, DAY),
    ],
)
def test_document_intervals(fixed, calendar, seconds):
    assert document_interval(fixed, calendar).seconds == seconds


@pytest.mark.parametrize(
    ("fixed", "calendar", "count", "unit", "is_calendar"),
    [
        (None, None, 1, "h", False),
        ("30s", None, 30, "s", False),
        ("2d", "1y", 2, "d", False),
        ("1w", None, 1, "h", False),
        ("100ms", None, 1, "h", False),
        ("xd", None, 1, "h", False),
        (None, "2d", 2, "d", False),
        (None, "2w", 2, "w", True),
        (None, "3M", 3, "M", True),
        (None, "1y", 1, "y", True),
        (None, "1m", 1, "m", False),
        (None, "4q", 1, "h", False),
    ],
)
def test_columnar_intervals(fixed, calendar, count, unit, is_calendar):
    found = columnar_interval(fixed, calendar)
    assert (found.count, found.unit, found.calendar) == (count, unit, is_calendar)


def test_only_calendar_months_and_years_have_months():
    assert columnar_interval(None, "2y").months == 24
    assert columnar_interval(None, "5M").months == 5
    assert columnar_interval(None, "1w").months is None
    assert document_interval(None, "1M").months is None


def test_long_intervals_are_taken_or_refused():
    assert document_interval("300y", None).seconds == 300 * 31_536_000
    assert columnar_interval("3000000h", None).count == 3_000_000
    with pytest.raises(ValueError, match="too long"):
        document_interval(f"{2**62}d", None)
    assert document_interval(f"{2**63}d", None) == document_interval(None, None)
