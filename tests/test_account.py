"""Tier, source and survey features over hand-made members."""

import datetime as dt

from retainly.operators.account import SOURCES, TIERS, account_standing


def test_every_code_is_reached_and_missing_values_have_theirs(spark):
    tiers, sources = [*TIERS, "Gold", "unlisted", None], [*SOURCES, "Social", "unlisted", None]
    rows = [(i, tiers[i % len(tiers)], sources[i % len(sources)]) for i in range(70)]
    members = spark.createDataFrame(rows, "customer_id long, membership_tier string, acquisition_source string")
    day = lambda d: dt.datetime(2024, 1, 1) - dt.timedelta(days=d)
    surveys = spark.createDataFrame([(0, day(10), 5), (0, day(20), 2), (0, day(400), 1), (1, day(366), 1), (2, day(5), None), (None, day(1), 1), (3, day(365), 4)],
                                    "customer_id long, survey_date timestamp_ntz, rating int")
    got = {r.customer_id: r for r in account_standing(members, surveys, "2024-01-01 00:00:00").collect()}
    assert len(got) == 70 and {r.membership_tier for r in got.values()} == {1, 2, 3, 4} and {r.referral_source for r in got.values()} == {1, 2, 3, 4, 5}
    for i, tier, source in rows:
        assert got[i].membership_tier == TIERS.get((tier or "").lower(), 1)
        assert got[i].referral_source == SOURCES.get((source or "").lower(), 1)
    assert [got[i].customer_service_rating_avg for i in range(5)] == [3.5, 3.0, 3.0, 4.0, 3.0]


def test_without_surveys_or_members(spark):
    members = spark.createDataFrame([(1, "gold", None)], "customer_id long, membership_tier string, acquisition_source string")
    surveys = spark.createDataFrame([], "customer_id long, survey_date timestamp_ntz, rating int")
    assert [tuple(r) for r in account_standing(members, surveys, "2024-01-01 00:00:00").collect()] == [(1, 3, 1, 3.0)]
    assert account_standing(members.limit(0), surveys, "2024-01-01 00:00:00").count() == 0
