import random

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorcast.config import Chunking
from sensorcast.operators import chunks

HOUR = 3_600_000_000


def series(seed, lengths, burst=False):
    rnd = random.Random(seed)
    out = {}
    for i, n in enumerate(lengths):
        if burst and i == 0:
            # Nearly all readings within a small part of the time span.
            hours = sorted({*range(5000, 5000 + n), 0, 20_000})
        else:
            hours = sorted(rnd.sample(range(n * 3), n))
        out[f"s{i}"] = [(h, rnd.random() * 100) for h in hours]
    return out


def row_windows(df, chunking):
    w = chunks.chunk_window()
    placed = chunks.with_row_halo(df, ["pm25"], 3, 5, chunking)
    return chunks.drop_halo(
        placed.withColumns(
            {
                "lag1": F.lag("pm25", 1).over(w),
                "lag3": F.lag("pm25", 3).over(w),
                "mean3": F.round(F.avg("pm25").over(w.rowsBetween(-3, -1)), 9),
                "lead5": F.lead("pm25", 5).over(w),
            }
        )
    )


@pytest.mark.parametrize("burst", [False, True])
@pytest.mark.parametrize("per_chunk", [1, 2, 7, 60])
def test_row_windows_do_not_depend_on_chunks(make_readings, per_chunk, burst):
    df = make_readings(series(per_chunk, [80, 25, 3, 1], burst))
    split = row_windows(df, Chunking(per_chunk))
    whole = row_windows(df, None)
    assert split.select(chunks.CHUNK).distinct().count() > 2
    assert rows_of(split.drop(chunks.CHUNK)) == rows_of(whole.drop(chunks.CHUNK))


@pytest.mark.parametrize("per_chunk", [2, 10, 40])
def test_time_windows_do_not_depend_on_chunks(make_readings, per_chunk):
    df = make_readings(series(per_chunk, [90, 30, 2]))

    def windows(chunking):
        w = Window.partitionBy("location_id", chunks.CHUNK).orderBy(F.unix_micros("timestamp"))
        placed = chunks.with_time_halo(df, 3 * HOUR, 6 * HOUR, chunking)
        shifted = placed.withColumns(
            {
                "lag1": F.max("pm25").over(w.rangeBetween(-HOUR, -HOUR)),
                "mean3": F.round(F.avg("pm25").over(w.rangeBetween(-3 * HOUR, -1)), 9),
                "lead6": F.max("pm25").over(w.rangeBetween(6 * HOUR, 6 * HOUR)),
            }
        )
        return rows_of(chunks.drop_halo(shifted).drop(chunks.CHUNK))

    assert windows(Chunking(per_chunk)) == windows(None)


@pytest.mark.parametrize("burst", [False, True])
def test_rank_and_size_over_chunks(make_readings, burst):
    df = make_readings(series(5, [70, 20, 1], burst)).select("location_id", "timestamp")
    split = chunks.with_series_rank(df, Chunking(6)).drop(chunks.CHUNK)
    whole = chunks.with_series_rank(df, None).drop(chunks.CHUNK)
    assert rows_of(split) == rows_of(whole)


def test_bursts_are_cut_again(make_readings):
    df = make_readings(series(1, [300], burst=True))
    sizes = chunks.with_chunks(df, Chunking(20)).groupBy(chunks.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 40


def test_number_of_chunks_is_bounded(make_readings):
    df = make_readings(series(2, [300, 200]))
    assert chunks.with_chunks(df, Chunking(1, max_chunks=5)).select("location_id", chunks.CHUNK).distinct().count() <= 20


def test_short_stations_stay_whole(make_readings):
    df = make_readings(series(3, [10, 10]))
    assert chunks.with_chunks(df, Chunking(10)).filter(f"{chunks.CHUNK} <> -1").isEmpty()
