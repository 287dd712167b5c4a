import datetime as dt
import random
import zoneinfo

import pytest

from sluicebox.operators.timestamps import days_from_civil, normalise_column, normalise_timestamps

UTC = dt.timezone.utc
BERLIN, YORK = "Europe/Berlin", "America/New_York"


def us(*parts, micro=0, offset=0):
    moment = dt.datetime(*parts, tzinfo=UTC) - dt.timedelta(minutes=offset)
    return int((moment - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micro


CASES = [
    ("2023-02-01", BERLIN, us(2023, 1, 31, 23)), ("02/01/2023", "UTC", us(2023, 2, 1)), ("01-02-2023", "UTC", us(2023, 2, 1)), ("2023/02/01", "UTC", us(2023, 2, 1)),
    ("2023-02-01T10:20:30Z", YORK, us(2023, 2, 1, 10, 20, 30)), ("2023-02-01T10:20:30z", YORK, us(2023, 2, 1, 10, 20, 30)), ("2023-02-01 10:20:30,482 -05:00", BERLIN, us(2023, 2, 1, 15, 20, 30, micro=482000)),
    ("2023-02-01T10:20:30.123456789+05:45", BERLIN, us(2023, 2, 1, 4, 35, 30, micro=123456)), ("2023-02-01T10:20:30+01:00[Europe/Berlin]", YORK, us(2023, 2, 1, 9, 20, 30)),
    ("2023-02-01 10:20:30 America/New_York", BERLIN, us(2023, 2, 1, 15, 20, 30)), ("20230201T102030", "UTC", us(2023, 2, 1, 10, 20, 30)), ("20230201T102030.5Z", YORK, us(2023, 2, 1, 10, 20, 30, micro=500000)),
    ("Wed, 01 Feb 2023 10:20:30 -0500", BERLIN, us(2023, 2, 1, 15, 20, 30)), ("1 Feb 2023 10:20:30", "UTC", us(2023, 2, 1, 10, 20, 30)), ("February 1, 2023 12:05 am", "UTC", us(2023, 2, 1, 0, 5)),
    ("02/01/2023 12:05 PM", "UTC", us(2023, 2, 1, 12, 5)), ("Feb 1, 2023 10:20:30 EST", BERLIN, us(2023, 2, 1, 15, 20, 30)), ("2023-07-01 10:20:30 CEST", YORK, us(2023, 7, 1, 8, 20, 30)),
    ("1675247430", BERLIN, 1675247430000000), ("1675247430123", BERLIN, 1675247430123000), ("1675247430123456", BERLIN, 1675247430123456), ("  2023-02-01\t", "UTC", us(2023, 2, 1)),
    ("2024-02-29", "UTC", us(2024, 2, 29)), ("01-02-2023 23:59 +02:00", YORK, us(2023, 2, 1, 21, 59)),
    # no instant
    ("2023-02-29", "UTC", None), ("2023/00/10", "UTC", None), ("13/25/2024", "UTC", None), ("2024-05", "UTC", None), ("2023-11-08 27:15:00", "UTC", None), ("12 Foo 2023 10:00:00", "UTC", None),
    ("0000-00-00", "UTC", None), ("yesterday", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("2023-02-01 10:20", None, None), ("2023-02-01", "No/Zone", None), ("2023-02-01T10:61:00Z", "UTC", None),
    ("02/01/2023 13:05 PM", "UTC", None), ("12345", "UTC", None), ("٢٠٢٣-٠٢-٠١", "UTC", None),
    # occurs twice, never, and twice but with an offset
    ("2023-10-29 02:30:00", BERLIN, None), ("2023-03-26 02:30:00", BERLIN, None), ("2023-10-29T02:30:00+02:00", BERLIN, us(2023, 10, 29, 0, 30)), ("2023-11-05 01:30:00", YORK, None), ("2023-03-12 02:30", YORK, None),
    ("2023-10-29 03:00:00", BERLIN, us(2023, 10, 29, 2)), ("2023-03-26 03:00:00", BERLIN, us(2023, 3, 26, 1)),
]


@pytest.mark.parametrize(("text", "zone", "want"), CASES)
def test_case(text, zone, want):
    found = normalise_column([text], [zone])
    assert (None if found.mask[0] else int(found[0])) == want


def test_against_the_calendar():
    rng = random.Random(4)
    for _ in range(2000):
        day = dt.date(rng.randint(1600, 2400), 1, 1) + dt.timedelta(days=rng.randint(0, 364))
        assert days_from_civil(*(__import__("numpy").int64(x) for x in (day.year, day.month, day.day))) == (day - dt.date(1970, 1, 1)).days


def test_local_times_against_zoneinfo():
    rng, texts, zones, want = random.Random(5), [], [], []
    for _ in range(3000):
        zone = rng.choice([BERLIN, YORK, "Australia/Sydney", "Asia/Kathmandu", "America/Sao_Paulo", "Europe/London", "Africa/Casablanca"])
        local = dt.datetime(2022, 1, 1) + dt.timedelta(minutes=rng.randint(0, 3 * 365 * 24 * 60))
        tz = zoneinfo.ZoneInfo(zone)
        instants = {local.replace(tzinfo=tz, fold=f).astimezone(UTC) for f in (0, 1)}
        real = {i for i in instants if i.astimezone(tz).replace(tzinfo=None) == local}
        texts.append(local.strftime("%Y-%m-%d %H:%M:%S"))
        zones.append(zone)
        want.append(int(next(iter(real)).timestamp()) * 1_000_000 if len(real) == 1 else None)
    found = normalise_column(texts, zones)
    assert [None if m else int(v) for v, m in zip(found.data, found.mask)] == want


def test_tables(spark):
    df = spark.createDataFrame([("2023-02-01", "UTC", 7)] * 2 + [("x" * 100_000, "UTC", 8), (None, None, 9)], "t string, z string, epoch_us int")
    out = normalise_timestamps(df, "t", "z")
    assert out.columns == ["t", "z", "epoch_us"] and sorted(r.epoch_us or 0 for r in out.collect()) == [0, 0, us(2023, 2, 1), us(2023, 2, 1)]
    assert normalise_timestamps(df.where("false"), "t", "z").count() == 0
