import pytest

from tidemark.plans.windows import WINDOWS, WindowDef, chosen, common_span, frame, lookback_ms, validate


def test_thirteen_definitions(spark):
    assert len(WINDOWS) == 13 and frame(spark).count() == 13
    assert validate(WINDOWS) == WINDOWS
    assert chosen("6h")[0].cadence_ms == 6_000_000


@pytest.mark.parametrize(
    "bad",
    [
        [WindowDef("a", 10, 5, 5), WindowDef("a", 10, 5, 5)],
        [WindowDef(" ", 10, 5, 5)],
        [WindowDef("a", 0, 5, 5)],
        [WindowDef("a", 10, 0, 5)],
        [WindowDef("a", 10, 11, 5)],
        [WindowDef("a", 10, 5, 0)],
        [WindowDef("a", 10, 5, 11)],
    ],
)
def test_bad_definitions(bad):
    with pytest.raises(ValueError):
        validate(bad)


def test_periods_never_cross_spans():
    assert all(common_span(WINDOWS) % w.cadence_ms == 0 for w in WINDOWS)


def test_lookback():
    day = 86_400_000
    assert [lookback_ms(i) for i in ("5s", "5m", "10m", "30m", "1h", "24h")] == [45 * day, 60 * day, 60 * day, 90 * day, 120 * day, 45 * day]
