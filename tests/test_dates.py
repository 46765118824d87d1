import pytest

from factloom.functions import lunar
from factloom.functions.dates import range_one, resolve_one


@pytest.mark.parametrize(
    ("phrase", "anchor", "prefer", "wanted"),
    [
        ("yesterday", "2023/05/20 (Sat) 10:00", "past", "2023-05-19"),
        ("the day: tomorrow morning", "2023-05-20", "past", "2023-05-21"),
        ("now", "2023-05-20", "past", "2023-05-20"),
        ("two weeks ago", "2023-05-20", "past", "2023-05-06"),
        ("about 3 months ago", "2023-05-31", "past", "2023-02-28"),
        ("in 2 days", "2023-05-20", "past", "2023-05-22"),
        ("a few days ago", "2023-05-20", "past", None),
        ("99999 years ago", "2023-05-20", "past", None),
        ("9999 years ago", "2023-05-20", "past", None),
        ("last friday", "2023-05-20", "past", "2023-05-12"),
        ("on friday", "2023-05-20", "past", "2023-05-19"),
        ("saturday", "2023-05-20", "past", "2023-05-20"),
        ("saturday", "2023-05-20", "future", "2023-05-27"),
        ("next weekend", "2023-05-17", "past", "2023-05-27"),
        ("march 3", "2023-02-01", "future", "2023-03-03"),
        ("march 3", "2023-02-01", "past_event", "2022-03-03"),
        ("march 3rd, 2021", "2023-02-01", "past", "2021-03-03"),
        ("february 30", "2023-02-01", "past", None),
        ("march 2021", "2023-02-01", "past", "2021-03"),
        ("last march", "2023-02-01", "past", "2022-03"),
        ("mid-march", "2023-02-01", "past", "2022-03"),
        ("last month", "2023-01-15", "past", "2022-12"),
        ("next year", "2023-01-15", "past", "2024"),
        ("thanksgiving", "2023-12-01", "past", "2023-11-23"),
        ("last thanksgiving", "2023-11-01", "past", "2022-11-24"),
        ("end of last month", "2023-03-15", "past", "2023-02-28"),
        ("the 15th", "2023-03-20", "past", "2023-03-15"),
        ("13/2/22", "2023-03-20", "past", "2022-02-13"),
        ("2/13", "2023-03-20", "past", "2023-02-13"),
        ("at 7:05 pm", "2023-03-20", "past", "2023-03-20T19:05"),
        ("昨天", "2023-03-20", "past", "2023-03-19"),
        ("三天前", "2023-03-20", "past", "2023-03-17"),
        ("上周三", "2023-03-20", "past", "2023-03-15"),
        ("2022年5月", "2023-03-20", "past", "2022-05"),
        ("去年", "2023-03-20", "past", "2022"),
        ("十五天前", "2023-03-20", "past", "2023-03-05"),
        ("二十天前", "2023-03-20", "past", "2023-02-28"),
        ("二十一天后", "2023-03-20", "past", "2023-04-10"),
        ("大概三个礼拜之前", "2023-03-20", "past", "2023-02-27"),
        ("三个月前", "2023-03-31", "past", "2022-12-31"),
        ("三月前", "2023-03-20", "past", None),
        ("9月10日前", "2023-10-20", "past", None),
        ("2019年前", "2023-10-20", "past", None),
        ("new year day", "2023-03-20", "past", "2023-01-01"),
        ("春节", "2023-03-20", "past", "2023-01-22"),
        ("春节", "2023-01-10", "future", "2022-02-01"),
        ("next spring festival", "2023-03-20", "past", "2024-02-10"),
        ("during last chinese new year's eve", "2023-03-20", "past", "2023-01-21"),
        ("mid-autumn festival", "2023-12-01", "past", "2023-09-29"),
        ("端午节那天", "2023-12-01", "past", "2023-06-22"),
        ("this 重阳节", "2023-01-01", "past", "2023-10-23"),
        ("腊八节", "2024-03-01", "past", "2024-01-18"),
        ("labor day (china)", "2023-12-01", "past", "2023-05-01"),
        ("children's day", "2023-12-01", "past", "2023-06-01"),
        ("十一", "2023-12-01", "past", "2023-10-01"),
        ("whenever", "2023-03-20", "past", None),
        ("yesterday", "no day", "past", None),
        (None, None, "past", None),
    ],
)
def test_phrases(phrase, anchor, prefer, wanted):
    assert resolve_one(phrase, anchor, prefer) == wanted


@pytest.mark.parametrize(
    ("phrase", "wanted"),
    [("last week", ("2023-05-08", "2023-05-14")), ("past two months", ("2023-03-20", "2023-05-20")), ("for a week", ("2023-05-13", "2023-05-20")), ("过去三天", ("2023-05-17", "2023-05-20")), ("过去二十五天", ("2023-04-25", "2023-05-20")), ("soon", None)],
)
def test_ranges(phrase, wanted):
    assert range_one(phrase, "2023-05-20") == wanted


@pytest.mark.parametrize(
    ("lunar_date", "wanted"),
    [
        ((1912, 1, 1), "1912-02-18"), ((1949, 1, 1), "1949-01-29"), ((1985, 1, 1), "1985-02-20"), ((2000, 1, 1), "2000-02-05"), ((2020, 1, 1), "2020-01-25"),
        ((2021, 1, 1), "2021-02-12"), ((2025, 1, 1), "2025-01-29"), ((2026, 1, 1), "2026-02-17"), ((2033, 1, 1), "2033-01-31"), ((2034, 1, 1), "2034-02-19"),
        ((2020, 8, 15), "2020-10-01"), ((2025, 8, 15), "2025-10-06"), ((2033, 8, 15), "2033-09-08"), ((2020, 5, 5), "2020-06-25"), ((2024, 12, 8), "2025-01-07"), ((1899, 1, 1), None),
    ],
)
def test_lunar_days(lunar_date, wanted):
    found = lunar.day_of(*lunar_date)
    assert (found and found.isoformat()) == wanted
