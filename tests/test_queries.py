import duckdb

from parley.plans import queries

#: A user of sf0.1 whose mean over 32 frames is 60.0196875, half way between two results, but for the last bit.
TIE = [67.46, 86.07, 48.96, 163.81, 56.96, 68.86, 11.68, 106.22, 59.1, 40.8, 59.91, 38.5, 81.54, 78.57, 22.65, 92.27, 50.8, 42.21, 6.63, 30.06, 13.27, 30.05, 1.05, 86.83, 26.08, 112.64, 16.07, 241.17, 153.03, 1.35, 67.87, 20.67, 4.95, 22.25, 184.64, 58.64, 15.91, 85.67, 7.84, 48.47, 17.66, 76.08, 18.8, 0.93, 12.66, 0.28, 130.73, 133.98, 8.32, 101.94, 54.07, 37.14, 120.45, 41.32, 87.33, 72.11, 15.89, 32.58, 8.94, 4.69, 24.24, 29.47, 62.65, 56.26, 5.62, 2.63, 37.01, 54.43, 39.61, 14.35, 85.15, 44.41, 23.93, 48.34, 155.83, 42.91, 43.65, 95.05, 4.29, 10.98, 10.87, 5.85, 3.32, 29.07, 90.45]


def test_means_half_way_are_rounded_as_the_sql_rounds(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CAST(7 AS BIGINT) AS user_id, 'view' AS event_type, ({TIE}::DOUBLE[])[i + 1] AS value, '' AS props FROM range({len(TIE)}) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(queries.ORACLES["hysteresis_segments"]).fetchall()
    got = [tuple(r) for r in queries.hysteresis_segments(spark, str(tmp_path)).select("meeting_id", "seg_idx", "start_ms", "end_ms", "energy_db").collect()]
    assert sorted(got) == sorted(want) and (7, 0, 10, 345, 60.019688) in got
