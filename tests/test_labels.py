"""Edges of the label rules and the first-day window."""

import pytest
from events import HOUR, MINUTE, log

from ebbtide.operators.engagement import latest_device, user_flags
from ebbtide.plans.user_dataset import user_dataset
from ebbtide.sources.sql_text import SQL_FOLDER, run_sql_file

DAY = 24 * HOUR


@pytest.fixture(scope="module")
def events(spark):
    return log(
        spark,
        [
            ("ten_minutes", 0), ("ten_minutes", 10 * MINUTE),
            ("past_ten", 0), ("past_ten", 10 * MINUTE + 1),
            ("one_day", 0), ("one_day", DAY),
            ("almost_a_day", 0), ("almost_a_day", DAY - 1),
            ("single", 5 * HOUR),
            ("at_censor", 5 * DAY - 48 * HOUR),
            ("after_censor", 5 * DAY - 48 * HOUR + 1),
            ("last", 0), ("last", 5 * DAY),
            # later than the last engagement: must not move the end of the log
            ("last", 9 * DAY, "post_score"),
            # window: before the first engagement, at its end, one past its end
            ("window", 10 * HOUR), ("window", 40 * HOUR),
            ("window", 1 * HOUR, "post_score"),
            ("window", 10 * HOUR + DAY, "ad_reward"),
            ("window", 10 * HOUR + DAY + 1, "ad_reward"),
            ("never_engaged", 3 * HOUR, "post_score"),
            (None, 2 * HOUR), (None, 3 * HOUR, "post_score"),
        ],
    )


@pytest.fixture(scope="module")
def rows(events):
    return {r["user_pseudo_id"]: r for r in user_dataset(events).collect()}


@pytest.mark.parametrize(
    "user, bounced, churned",
    [
        ("ten_minutes", 1, 1), ("past_ten", 0, 1), ("one_day", 0, 0), ("almost_a_day", 0, 1),
        ("single", 1, 1), ("last", 0, 0),
    ],
)
def test_bounced_and_churned(rows, user, bounced, churned):
    assert (rows[user]["bounced"], rows[user]["churned"]) == (bounced, churned)


def test_censoring_is_inclusive_and_ends_with_the_last_engagement(rows):
    assert rows["at_censor"]["is_enable"] == 1
    assert rows["after_censor"]["is_enable"] == 0


def test_window_is_inclusive_and_has_no_lower_bound(rows):
    window = rows["window"]
    assert (window["cnt_post_score"], window["cnt_ad_reward"]) == (1, 1)
    assert window["cnt_user_engagement"] == 1
    assert window["cnt_use_extra_steps"] == 0


def test_users_without_engagement_are_left_out(rows):
    assert "never_engaged" not in rows


def test_missing_user_id_is_one_user_without_device_and_counters(rows):
    nobody = rows[None]
    assert nobody["bounced"] == 1
    assert nobody["country_name"] is None and nobody["cnt_user_engagement"] is None


def test_flags_alone_agree(events, rows):
    for flag in user_flags(events).collect():
        assert rows[flag["user_pseudo_id"]]["churned"] == flag["churned"]


def test_sql_text_gives_the_same(spark, events, rows):
    args = {"engagement_event": "user_engagement", "churn_hours": 24, "censor_hours": 48, "bounce_minutes": 10}
    frame = run_sql_file(spark, SQL_FOLDER / "user_dataset.sql", args, {"events": events})
    assert {r["user_pseudo_id"]: r for r in frame.collect()} == rows


def test_latest_device_ties_go_to_the_greater_event_id(spark):
    events = log(
        spark,
        [
            dict(user="a", at=0, country="Peru"),
            dict(user="a", at=HOUR, country="Chile", system="IOS"),
            dict(user="a", at=HOUR, country="Kenya", system="ANDROID"),
            dict(user="a", at=2 * HOUR, country="Spain", name="post_score"),
        ],
    )
    assert latest_device(events).collect()[0]["country_name"] == "Kenya"
    assert user_dataset(events).collect()[0]["device_os"] == "ANDROID"
