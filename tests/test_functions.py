import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions import scoring as SC
from tidewell.functions import text as X


def test_normalize_and_aliases(values):
    names = ["The Black Temple", "An Enchant", "  Gruul   the   Dragonkiller ", "theory", "A  Thing"]
    assert values(X.normalize_name, names) == ["black temple", "enchant", "gruul the dragonkiller", "theory", "thing"]
    assert values(X.resolve_canonical, ["the BT", "SnD", "Unknown Name"]) == ["black temple", "slice and dice", "unknown name"]


def test_slug_and_path(values):
    assert values(X.slugify, ["Gruul's Lair: Part 2!", "--x--"]) == ["gruuls-lair-part-2", "x"]
    assert values(lambda c: X.derive_path(F.lit("combat"), F.lit("gear"), c), ["Best Items"]) == ["combat/gear/best-items.md"]


def test_check_interval(values):
    urls = ["https://www.wowhead.com/x", "https://WARCRAFTLOGS.com/r/1", "https://wowhead.com:8080/", "https://other.org"]
    assert values(X.check_interval, urls) == [720, 24, 168, 168]


def test_content_hash_of_blank_is_empty(values):
    got = values(X.content_hash, ["  \n ", "a"])
    assert got[0] == "" and len(got[1]) == 64


def test_number_before_unit(values):
    assert values(X.number_before, ["1234 DPS", "about 1,234.5 DPS", "950 dps", "no number"]) == [1234.0, 1234.5, 950.0, None]
    got = values(lambda c: X.first_number(c, fixed.RATE_PATTERNS), ['{"mean_dps": 1523.4}', "average DPS: 12", "DPS: 7", "1234.5 mean DPS", "x"])
    assert got == [1523.4, 12.0, 7.0, 1234.5, None]


def test_quoted_fields(values):
    got = values(X.quoted_fields, ['A,"b, c",d', 'x, "y" ,', '"open,still', "a,,b"])
    assert got == [["A", "b, c", "d"], ["x", "y"], ["open,still"], ["a", "", "b"]]


def test_log_time(values):
    stamps = ["1/2 00:00:01.5", "3/4 12:34:56.789", "nonsense"]
    assert values(X.log_time_ms, stamps) == [1005, 45296789, 0]
    assert values(X.log_order_ms, ["1/1 23:59:59.0", "1/2 00:00:01.0"]) == [86399000, 86401000]


def test_talents(values):
    assert values(X.talent_totals, ["20/41/0", "41/20/1", "1/2", "a/1/2", "-1/3/4"]) == [[20, 41, 0], None, None, None, None]
    assert values(X.digit_sums, ["005-052-1"]) == [[5, 7, 1]]
    assert values(X.spec_from_digits, ["500-1-0", "1-5", "5"]) == ["assassination_mutilate", "combat_swords", "combat_swords"]


def test_display_name(values):
    assert values(X.display_name, ["slice_and_dice", "sinister_strike"]) == ["Slice and Dice", "Sinister Strike"]
    assert values(X.title_case, ["gruul's_lair", "2h_sword", "talent_tree", ""]) == ["gruul's_lair".replace("_", " ").title(), "2H Sword", "Talent Tree", ""]


def test_clip(values):
    long = "a" * 1500 + "b" * 1500
    got = values(X.clip_middle, [long, "short"])
    assert values(lambda c: X.clip(c, 3), ["abcd", "abc"]) == ["abc...", "abc"]
    assert got[0] == "a" * 1000 + fixed.CLIP_MARKER + "b" * 1000 and got[1] == "short"


def test_player_names(values):
    assert values(X.valid_player_name, ["Alice", "D'Artagnan-2", "bad name", "--", "x" * 51, None]) == [True, True, False, False, False, False]


@pytest.mark.parametrize("expected, observed, pct, status", [
    (1020.0, 1000.0, 2.0, "pass"), (1080.0, 1000.0, 8.0, "warn"), (1200.0, 1000.0, 20.0, "fail"), (100.0, 0.0, 100.0, "fail"),
    (800.0, 1000.0, -20.0, "fail"), (0.0, 0.0, 0.0, "pass")])
def test_drift(spark, expected, observed, pct, status):
    df = spark.createDataFrame([(expected, observed)], "expected double, observed double")
    row = df.select(SC.relative_drift("expected", "observed").alias("p")).select("p", SC.drift_status("p", (5.0, 10.0)).alias("s")).first()
    assert row.p == pytest.approx(pct) and row.s == status


def test_range_accuracy(values):
    got = values(lambda c: SC.range_accuracy(c, F.lit(1100.0), F.lit(1200.0)), [1150.0, 1100.0, 1097.5, 900.0], "double")
    assert got == pytest.approx([1.0, 1.0, 0.5, 0.0])
    assert values(lambda c: SC.range_accuracy(c, F.lit(1.0), F.lit(2.0)), [None], "double") == [None]
    assert values(SC.clamp, [None, -1.0, 0.5, 7.0], "double") == [None, 0.0, 0.5, 1.0]


def test_recency(values):
    got = values(lambda c: SC.recency(c, F.lit("2024-06-01 00:00:00").cast("timestamp")), ["2024-06-01 00:00:00", "2024-01-01T00:00:00", "bad", None, "2025-01-01"])
    assert got[0] == 1.0 and got[1] == pytest.approx(math.exp(-152 / 30)) and got[2:4] == [0.5, 0.5] and got[4] == 1.0


def test_trust_bounds(values):
    got = values(lambda c: SC.trust_with_events(F.lit(0.7), c), [-0.1, 0.05, -0.6, 0.35, None], "double")
    assert got == pytest.approx([0.6, 0.75, 0.1, 1.0, 0.7])
    assert values(SC.base_trust, ["guide", "nothing"]) == [0.75, 0.3]


def test_active_rate_and_quality(values):
    assert values(lambda c: SC.active_rate(F.lit(5000), c), [2000, 0, None], "int") == [2500.0, 0.0, 0.0]
    assert values(SC.strategy_quality, [1, 9], "int") == [0.6, 1.0]
